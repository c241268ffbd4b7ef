"""Laying texts into containers of one capacity.

Harmonic packing: the lengths are parted into reciprocal classes, a text of t tokens belonging to class i when
``C / (i + 1) < t <= C / i``. A container of class i is opened for a fixed count of i texts of that class,
whatever their exact lengths; a class has at most one container of fewer, its last. Workers are independent of
each other, so every partition of the scan packs its own texts and nothing is shuffled. As class i alone
leaves up to ``C / (i + 1)`` of a container unused, the room that is left is then given to texts of higher
classes, the longest that fits first, before those classes open containers of their own (``top_up``). A
partition leaves at most one container that is less than half full.

Defined results: null texts have no row. Texts without tokens take no room and come out in the partition's
first container. A text longer than a container is divided into full containers, each of class 1, and a rest;
no other text is divided. Equal lengths and repeated rows are texts of their own; the order of ids settles
ties. An empty table gives no rows. Other columns are ignored. Ids may be null.
"""

from __future__ import annotations

import base64
import functools
import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary of a public tokenizer; a parameter of all functions that count tokens.
VOCABULARY = os.environ.get("SYMWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits a text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CAPACITY = 2048


@functools.cache
def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Stock:
    """Items by length, for the longest of at most a given length in almost constant time."""

    def __init__(self, sizes: list[int], capacity: int):
        self.items: list[list[int]] = [[] for _ in range(capacity + 1)]
        for item in range(len(sizes) - 1, -1, -1):
            self.items[sizes[item]].append(item)
        self.next: list[int] = list(range(capacity + 1))

    def longest(self, room: int) -> int:
        """The largest stocked length up to ``room``, 0 if there is none."""
        root = room
        while root and not self.items[root]:
            root = self.next[root] if self.next[root] != root else root - 1
        while room > root:  # later searches jump over what is used up; nothing is added
            room, self.next[room] = (self.next[room] if self.next[room] != room else room - 1), root
        return root

    def take(self, size: int) -> int:
        return self.items[size].pop()


def pack(sizes: list[int], capacity: int, top_up: bool = True) -> list[tuple[int, int, int, int, int]]:
    """``(item, container, class, position, offset)`` for items of 1 to ``capacity`` tokens, in the order of containers."""
    stock = _Stock(sizes, capacity)
    members = Counter(capacity // s for s in sizes)
    out = []
    container = 0
    for i in sorted(members):
        while members[i]:
            room, position = capacity, 0

            def put(size: int) -> None:
                nonlocal room, position
                out.append((stock.take(size), container, i, position, capacity - room))
                members[capacity // size] -= 1
                room, position = room - size, position + 1

            for _ in range(min(i, members[i])):  # the class's own fixed count
                put(stock.longest(capacity // i))
            while top_up and (size := stock.longest(min(room, capacity // (i + 1)))):
                put(size)
            container += 1
    return out


def layout(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", top_up: bool = True) -> DataFrame:
    """``key, piece, container, container_class, position, offset, tokens``: one row for each text, or each piece of a long one.

    ``container`` is unique over all partitions; ``offset`` is where the tokens begin in the container.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoding(vocabulary).encode_ordinary
        empty: list = []
        items: list[tuple] = []
        for b in batches:
            for k, t in zip(b["k"], b["t"]):
                items.append((k, len(encode(t.encode("utf-8", "replace").decode())) if t else 0))
        items.sort(key=lambda x: (-x[1], x[0] is None, x[0]))
        rest, sizes = [], []
        container = TaskContext.get().partitionId() << 32
        rows = []
        for k, n in items:
            full, left = divmod(n, capacity)
            for p in range(full):
                rows.append((k, p, container, 1, 0, 0, capacity))
                container += 1
            if left:
                rest.append((k, full))
                sizes.append(left)
            elif not n:
                empty.append(k)
        for item, c, own, position, offset in pack(sizes, capacity, top_up):
            rows.append((*rest[item], container + c, own, position, offset, sizes[item]))
        first, own = min(((r[2], r[3]) for r in rows), default=(container, 0))
        last = sum(1 for r in rows if r[2] == first)
        rows += [(k, 0, first, own, last + i, 0, 0) for i, k in enumerate(empty)]
        for i in range(0, len(rows), 50_000):
            yield pd.DataFrame(rows[i : i + 50_000], columns=["k", "piece", "container", "container_class", "position", "offset", "tokens"])

    kind = dict(documents.dtypes)[key]
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {kind}, piece int, container bigint, container_class int, position int, offset int, tokens int").withColumnRenamed("k", key)


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, texts, divided texts, tokens and the share of room in use."""
    total = placed.agg(F.count_distinct("container").alias("containers"), F.count_if(F.col("piece") == 0).alias("texts"), F.count_if(F.col("piece") > 0).alias("further_pieces"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    return total.withColumn("used", F.col("tokens") / F.greatest(F.col("containers") * capacity, F.lit(1)))


def classes(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """For each class of containers: how many there are, the texts of the class itself and those on top, the room both take."""
    own = F.col("tokens") * F.col("container_class") + F.col("tokens") > capacity
    size = F.greatest(F.count_distinct("container") * capacity, F.lit(1))
    found = placed.where("tokens > 0").groupBy("container_class").agg(
        F.count_distinct("container").alias("containers"), F.count_if(own).alias("own_texts"), F.count_if(~own).alias("texts_on_top"),
        (F.sum(F.when(own, F.col("tokens")).otherwise(0)) / size).alias("used_by_class"), (F.sum("tokens") / size).alias("used"),
    )
    return found
