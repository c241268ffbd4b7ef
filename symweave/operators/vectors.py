"""Nearest vectors by cosine similarity, exact: queries in blocks against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Queries sent to the tasks at once; more queries take further passes.
BLOCK = 2048


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, similarity`` of the k nearest other vectors of each query.

    Every task keeps k candidates of each query and batch, so what is shuffled is bounded by the queries.
    Null and zero vectors have no neighbours; ties go to the smaller key.
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        rows = part.where(F.col(value).isNotNull()).select(key, value).collect()
        ids = np.array([r[0] for r in rows], np.int64)
        matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), len(rows[0][1]) if rows else 0)
        length = np.linalg.norm(matrix, axis=1)
        sent = spark.sparkContext.broadcast((ids[length > 0], matrix[length > 0] / length[length > 0][:, None]))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            q, m = sent.value
            for batch in batches:
                own = np.array(batch["v"].tolist(), np.float64).reshape(len(batch), -1)
                size = np.linalg.norm(own, axis=1)
                keep = size > 0
                other = batch["k"].to_numpy(np.int64)[keep]
                if not len(q) or not len(other):
                    continue
                scores = np.round(m @ (own[keep] / size[keep][:, None]).T, 9)
                scores[q[:, None] == other[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(other, scores.shape), -scores), axis=1)[:, : k]
                i = np.repeat(np.arange(len(q)), order.shape[1])
                s = np.take_along_axis(scores, order, 1).ravel()
                found = pd.DataFrame({"query_id": q[i], "vec_id": other[order.ravel()], "similarity": s})
                yield found[np.isfinite(s)]

        given = vectors.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).alias("v"))
        hits = given.mapInPandas(run, "query_id bigint, vec_id bigint, similarity double")
        out = hits if out is None else out.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")
