import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from compare import DATA, check  # noqa: E402

from symweave.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the generated tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    check(spark, QUERIES[name], ORACLES.get(name))


def test_columns(spark):
    if not os.path.isdir(DATA):
        pytest.skip("the generated tables are not here")
    want = {"p4_found": ["rollout_id"], "p5_found": ["verdict_id", "label"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id_a", "doc_id_b"]}
    for name, columns in want.items():
        out = QUERIES[name](spark, DATA)
        assert out.columns == columns and out.count() == out.distinct().count()
