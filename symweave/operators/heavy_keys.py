"""Per-key results where a few keys own much of the rows.

Every result of a key is built from counts that merge: degree, number of distinct partners, and value
quantiles found by *distributed exact selection*. For the quantiles the value range of a key is cut into
``BUCKETS`` parts, the parts are counted with map-side partial sums, the part that holds the wanted rank
is cut again, and so on until a part is one value. No step gathers the values of a key: the largest
group any task sees is ``BUCKETS`` counts of one key and rank.

Defined results: a key with a null part is left out on its side and still counts in the total of edges.
Re-delivered edges count once; where deliveries disagree the one with the largest ``loaded_at`` holds
(a null ``loaded_at`` is the smallest, ties break by a hash of the row).
All edges with a null id count as one. A null ``line`` counts in the
degree and not in the quantiles; a key without any line has null quantiles. The p-quantile of n values is
the value of rank ``max(1, ceil(p * n))``, always one of the values. Paths are compared in plain form.
An empty table gives no rows. Columns that are not named here are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symweave.functions.paths import normalize_path
from symweave.operators.skew import HOT, key_hash, salt_all, salt_many
from symweave.runtime import cut

BUCKETS = 1024
#: A key with more distinct values than this is salted, so that no task joins all of them.
WIDE = 50_000

_PARTS = ("file", "name", "kind")


def _whole(prefix: str) -> Column:
    f, n, k = (F.col(f"{prefix}_{p}").isNotNull() for p in _PARTS)
    return f & n & k


def _hash(prefix: str) -> tuple[Column, Column]:
    """The key as two hashes, null where any part of it is null."""
    hi, lo = key_hash(normalize_path(F.col(f"{prefix}_file")), F.col(f"{prefix}_name"), F.col(f"{prefix}_kind"))
    return F.when(_whole(prefix), hi), F.when(_whole(prefix), lo)


def _latest(edges: DataFrame, **values: Column) -> DataFrame:
    """One row for each edge_id: the values of its latest delivery.

    All values are numbers, so that the grouping stays a hash aggregation.
    """
    at = F.coalesce(F.try_multiply(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(1024)), F.lit(-(2**62)))
    rows = edges.select("edge_id", *[v.alias(k) for k, v in values.items()], at.alias("at"))
    order = F.col("at") + F.pmod(F.xxhash64(*values), F.lit(1024))
    return rows.groupBy("edge_id").agg(*[F.max_by(k, order).alias(k) for k in values])


def _sides(*rest: str) -> Column:
    """Both ends of an edge as rows ``side, hi, lo, other``."""
    ends = [("to", "to", "src"), ("from", "src", "to")]
    parts = [F.struct(F.lit(side).alias("side"), F.col(f"{x}_hi").alias("hi"), *[F.col(f"{x}_{r}").alias(r) for r in rest], F.col(f"{y}_hi").alias("other")) for side, x, y in ends]
    return F.explode(F.array(*parts)).alias("s")


def key_quantiles(rows: DataFrame, key: list[str], value: str, quantiles: list[float], buckets: int = BUCKETS) -> DataFrame:
    """Exact quantiles of an integer column for each key: ``key..., q, quantile``.

    ``rows`` may carry a column ``n`` with the multiplicity of a row. Integer arithmetic only, so ties and
    huge multiplicities are exact.
    """
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    work = rows.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("bigint").alias("v"), n.cast("bigint").alias("n"))
    counts = work.groupBy(*key, "v").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    spans = counts.groupBy(*key).agg(F.min("v").alias("least"), F.max("v").alias("most"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("values"))
    name = F.xxhash64(*key)
    wide = spans.where(F.col("values") > WIDE).orderBy(F.desc("values"), name).limit(HOT)
    hot = [r[0] for r in wide.select(name).collect()]
    salted = counts.withColumn("salt", salt_many(name, F.col("v"), hot))
    qs = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("total"))).cast("bigint")
    wanted = cut(spans.select(*key, "least", "most", "total", qs).select(*key, "q", "least", "most", rank.alias("rank")))
    done: list[DataFrame] = []
    ids = [*key, "q"]
    while True:
        done.append(wanted.where("least = most").select(*ids, F.col("least").alias("quantile")))
        wanted = wanted.where("least < most")
        if wanted.isEmpty():
            break
        asked = wanted.withColumn("salt", F.explode(salt_all(name, hot)))
        inside = salted.join(asked, [*key, "salt"]).where((F.col("v") >= F.col("least")) & (F.col("v") <= F.col("most")))
        part = F.expr(f"(v - least) div (((most - least) div {buckets}L) + 1L)")
        parts = inside.groupBy(*ids, "rank", part.alias("part")).agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*ids).orderBy("part"))
        hit = parts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        wanted = cut(hit.select(*ids, "least", "most", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _named(edges: DataFrame) -> DataFrame:
    """``hi, lo, named`` of all keys of the edges; each task sends a key once."""
    parts = []
    for prefix in ("dst", "src"):
        named = F.struct(normalize_path(F.col(f"{prefix}_file")).alias("file"), F.col(f"{prefix}_name").alias("name"), F.col(f"{prefix}_kind").alias("kind"))
        hi, lo = _hash(prefix)
        parts.append(edges.where(_whole(prefix)).select(hi.alias("hi"), lo.alias("lo"), named.alias("named")))
    return parts[0].unionByName(parts[1]).groupBy("hi", "lo").agg(F.min("named").alias("named"))


def key_results(edges: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9), min_share: float = 0.0) -> DataFrame:
    """``side, file, name, kind, degree, partners, line_p50, line_p90, share`` for each key of either side.

    On side ``to`` partners are callers, on side ``from`` callees. With ``min_share`` only keys that hold
    at least this share of all distinct edges come out; then the number of keys is bounded by
    ``2 / min_share`` and the details are computed for their rows only. Keys travel as two hashes of their
    parts; the names are put back at the end.
    """
    (to_hi, to_lo), (src_hi, src_lo) = _hash("dst"), _hash("src")
    one = _latest(edges, to_hi=to_hi, to_lo=to_lo, src_hi=src_hi, src_lo=src_lo, line=F.col("line").cast("bigint"))
    one = cut(one if min_share > 0 else one.drop("edge_id"))
    total = one.count()
    least = math.ceil(min_share * total * (1 - 1e-12))
    key = ["side", "hi", "lo"]
    rest = [c for c in one.columns if c in ("line", "edge_id")]
    sides = one.select(_sides("lo"), *rest).select("s.*", *rest).where(F.col("hi").isNotNull())
    if min_share > 0:
        counts = sides.groupBy("side", "hi").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= F.lit(least))
        heavy = [(r.side, r.hi) for r in counts.collect()]  # at most 1 / min_share for each side
        of = {s: [h for side, h in heavy if side == s] for s in ("to", "from")}
        sides = sides.where(((F.col("side") == "to") & F.col("hi").isin(of["to"])) | ((F.col("side") == "from") & F.col("hi").isin(of["from"])))
    pairs = sides.groupBy(*key, "other").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy(*key).agg(F.sum("n").alias("degree"), F.count("other").alias("partners"))
    if min_share > 0:  # few keys: one edge of each tells its name
        out = cut(out.where(F.col("degree") >= F.lit(least)))
        seen = sides.groupBy(*key).agg(F.min("edge_id").alias("edge_id")).collect()
        known = F.col("edge_id").isin([r.edge_id for r in seen if r.edge_id is not None])
        edges = edges.where(known | F.col("edge_id").isNull() if any(r.edge_id is None for r in seen) else known)
    found = key_quantiles(sides.groupBy(*key, "line").agg(F.count(F.lit(1)).alias("n")), key, "line", list(quantiles))
    labels = [f"line_p{round(q * 100)}" for q in quantiles]
    wide = found.groupBy(*key).agg(*[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(c) for q, c in zip(quantiles, labels)])
    out = out.join(wide, key, "left").join(_named(edges), ["hi", "lo"])
    return out.select("side", "named.*", "degree", "partners", *labels, (F.col("degree") / F.lit(float(max(total, 1)))).alias("share"))
