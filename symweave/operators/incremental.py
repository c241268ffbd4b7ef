"""Keeping a graph current: file hashes, changed files, removal, edit log.

Tables never change in place: removing a file is an anti-join, inserting is a union. Edges into a removed
file stay, so they are found dangling until the file comes back, when they join again by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symweave.functions.paths import extension
from symweave.runtime import cut
from symweave.schema import KEY


def file_hashes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("content_hash"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change`` (added, deleted, changed, same) from two tables of ``path, content_hash``."""
    a = old.groupBy("path").agg(F.max("content_hash").alias("h0"))
    b = new.groupBy("path").agg(F.max("content_hash").alias("h1"))
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("h0").isNull() & F.col("h1").isNotNull(), "added").when(F.col("h1").isNull(), "deleted").when(F.col("h0") == F.col("h1"), "same").otherwise("changed")
    return both.select("path", change.alias("change"))


#: Files of one folder-like group whose hashes are folded together before the root is made.
FANOUT = 4096


def merkle_root(hashes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row ``root, n_files``: a hash over all ``path, content_hash`` pairs, whatever their order.

    Paths are dealt to ``fanout`` groups by their own hash; each group folds its pairs in order of the path,
    the root folds the groups. So no task sorts all files, and the driver gets one row.
    """
    groups = hashes.groupBy(F.substring(F.sha2("path", 256), 1, len(f"{fanout - 1:x}")).alias("bucket")).agg(
        F.array_sort(F.collect_list(F.struct("path", "content_hash"))).alias("pairs"), F.count(F.lit(1)).alias("n")
    )
    one = F.sha2(F.array_join(F.transform("pairs", lambda p: F.concat(p["path"], F.lit("\x00"), p["content_hash"])), "\n"), 256)
    folded = groups.select("bucket", "n", one.alias("h"))
    all_ = F.array_sort(F.collect_list(F.struct("bucket", "h")))
    return folded.agg(F.sha2(F.array_join(F.transform(all_, lambda x: x["h"]), "\n"), 256).alias("root"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


def directory_hashes(hashes: DataFrame) -> DataFrame:
    """``path, hash`` of every directory, from its children's names and hashes, bottom up by depth."""
    level = hashes.select("path", F.col("content_hash").alias("hash")).withColumn("depth", F.size(F.split("path", "/")))
    deepest = level.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")
    out, carried = None, None
    for d in range(deepest, 0, -1):
        here = level.where(F.col("depth") == d).select("path", "hash")
        here = here if carried is None else here.unionByName(carried)
        carried = here.groupBy(parent.alias("dir")).agg(F.array_sort(F.collect_list(F.struct(F.regexp_replace("path", r"^.*/", "").alias("name"), "hash"))).alias("c"))
        carried = carried.select(F.col("dir").alias("path"), F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit("\x00"), x["hash"])), "\n"), 256).alias("hash"))
        if d % 16 == 0:  # keeps the plans of deep trees short
            carried = cut(carried)
        out = carried if out is None else out.unionByName(carried)
    return out if out is not None else hashes.select("path", F.col("content_hash").alias("hash")).limit(0)


def remove_files(gone: DataFrame, symbols: DataFrame, edges: DataFrame, imports: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The graph without the files of ``gone`` (``file``): their symbols, outgoing edges and library imports."""
    files = gone.select("file").distinct()
    return (
        symbols.join(files, "file", "left_anti"),
        edges.join(files.select(F.col("file").alias("src_file")), "src_file", "left_anti"),
        None if imports is None else imports.join(files, "file", "left_anti"),
    )


def upsert_files(old: tuple[DataFrame, DataFrame, DataFrame], new: tuple[DataFrame, DataFrame, DataFrame], touched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph after the touched files were read again."""
    kept = remove_files(touched, *old)
    return tuple(k.unionByName(n, allowMissingColumns=True) for k, n in zip(kept, new))


def dangling_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges into names that no symbol of the target file has; module anchors are no symbols and stay out."""
    named = symbols.select(F.col("file").alias("dst_file"), F.col("name").alias("dst_name")).distinct()
    return edges.where("dst_name != ''").join(named, ["dst_file", "dst_name"], "left_anti")


def edits_ago(log: DataFrame) -> DataFrame:
    """``file, name, kind, edits_ago``: records logged after the last one of each symbol.

    Counted from dense sequence numbers; the log's end is one number, not a window over the log.
    """
    last = log.groupBy(*KEY).agg(F.max("seq").alias("last"))
    end = log.agg(F.max("seq")).first()[0]
    return last.select(*KEY, (F.lit(end).cast("bigint") - F.col("last")).alias("edits_ago"))


def calls_ago(log: DataFrame) -> DataFrame:
    """``file, name, kind, calls_ago``: edits (distinct moments ``ts``) logged after the last one of each symbol.

    One edit may log many symbols; here it counts once. Moments are few beside records: they are counted per
    day with map-side sums, so that no window runs over the log.
    """
    moments = log.select("ts").distinct()
    days = moments.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    later = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("ts"))) - 1
    placed = moments.withColumn("day", F.to_date("ts")).withColumn("within", within).join(days.withColumn("later", later), "day")
    last = log.groupBy(*KEY).agg(F.max("ts").alias("ts"))
    return last.join(placed, "ts").select(*KEY, (F.col("within") + F.col("later")).alias("calls_ago"))


def append_edits(log: DataFrame, edits: DataFrame) -> DataFrame:
    """The log with further edits (``ts, file, name, kind``), numbered on from its end in order of time."""
    end = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    number = F.row_number().over(Window.orderBy("ts", *KEY)).cast("bigint")  # the edits of one call, not the log
    new = edits.select((number + F.lit(end)).alias("seq"), "ts", *KEY)
    return log.select("seq", "ts", *KEY).unionByName(new)


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def status(symbols: DataFrame, edges: DataFrame, files: DataFrame, edits: DataFrame) -> DataFrame:
    """One row: numbers of symbols, edges, files, edits, and the languages' extensions in order."""
    ext = F.when(extension(F.col("file")) != "", extension(F.col("file")))
    n = F.count(F.lit(1))
    parts = [
        symbols.agg(n.alias("symbols")),
        edges.agg(n.alias("edges")),
        files.agg(n.alias("files"), F.array_join(F.array_sort(F.collect_set(ext)), ", ").alias("extensions")),
        edits.agg(n.alias("edits")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in ("symbols", "edges", "files", "extensions", "edits")])
