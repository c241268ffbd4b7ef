"""The graph as a stream: file events in, tables kept current.

Events are rows ``path, op (upsert | delete), ts, content``. Within a batch only the last event of a path
counts; across batches a repeated content is dropped by its hash while the watermark lasts. A batch is
applied in :func:`apply_batch` by path and content, so replaying it changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symweave.functions.paths import is_test_path
from symweave.runtime import cut
from symweave.sources.index import Index, Renewal, applied, language_of, load, renew, store_renewal
from symweave.sources.scan import Ignore, relevant

EVENTS = "path string, op string, ts timestamp, content string"


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each path; a deletion wins at equal times."""
    return events.groupBy("path").agg(F.max_by(F.struct("op", "ts", "content"), F.struct("ts", (F.col("op") == "delete"), F.xxhash64("content"))).alias("e")).select("path", "e.*")


def debounce(events: DataFrame, gap: str = "100 milliseconds", key: str = "path", ts: str = "ts") -> DataFrame:
    """``key, start, end, n``: bursts of events of a key that are less than a gap apart. Works on streams, too."""
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last")).select(key, F.col("w.start").alias("start"), "last", "n")


def changed_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of events without repeats of the same content of a path within the watermark."""
    hashed = events.withWatermark("ts", delay).withColumn("content_hash", F.sha2(F.concat_ws("\x00", "op", F.coalesce("content", F.lit(""))), 256))
    return hashed.dropDuplicatesWithinWatermark(["path", "content_hash"])


def renewal(index: Index, batch: DataFrame, crate: str | None = None, rules: list | None = None) -> Renewal:
    """What a batch of events makes new. Files that the batch leaves untouched are neither read nor extracted."""
    events = cut(last_events(batch))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    alive = events.where("op != 'delete'").select(
        "path", F.col("path").alias("rel_path"), ext.alias("ext"), language_of("path").alias("language"), "content",
        F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_hash"), is_test_path(F.col("path")).alias("is_test_path"),
    )
    return renew(index, alive, events.select(F.col("path").alias("file")), crate, rules)


def apply_batch(index: Index, batch: DataFrame, crate: str | None = None, rules: list | None = None) -> Index:
    """The graph after a batch of events."""
    return applied(index, renewal(index, batch, crate, rules))


def maintain(events: DataFrame, store: str, checkpoint: str, crate: str | None = None, rules: list | None = None, trigger: dict | None = None, ignore: Ignore | None = None) -> StreamingQuery:
    """Keeps the graph in ``store`` current: each batch writes the buckets it affects and moves the pointer to them.

    Events of hidden and ignored files are left out.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        index = load(batch.sparkSession, store)
        if index is None:
            raise RuntimeError(f"no graph in {store}; build it with a cold index first")
        store_renewal(renewal(index, batch, crate, rules), store)

    return changed_stream(relevant(events, ignore or Ignore())).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def edit_positions(log: DataFrame) -> DataFrame:
    """A stream of ``file, name, kind, seq``: the last edit of each symbol, kept as state by key."""

    def last(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else -1
        for b in batches:
            best = max(best, int(b["seq"].max()))
        state.update((best,))
        yield pd.DataFrame({"file": [key[0]], "name": [key[1]], "kind": [key[2]], "seq": [best]})

    return log.groupBy("file", "name", "kind").applyInPandasWithState(last, "file string, name string, kind string, seq bigint", "seq bigint", "update", "NoTimeout")


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is available now."""
    df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
