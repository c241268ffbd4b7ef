"""Building, storing and renewing the graph of a project.

A stored graph is a folder of versions. Every relation is parted by a hash of its file into ``BUCKETS`` buckets,
and a pointer names the version that holds each bucket: a renewal writes the buckets of the files it affects and
moves the pointer, readers see one state whole. Versions that neither the pointer nor the one before it names
are removed.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symweave import schema
from symweave.functions.paths import stem
from symweave.operators import incremental, resolve
from symweave.runtime import cut
from symweave.sources import scan
from symweave.sources.extract import EXTENSIONS, EXTRACTED, extract_files, extract_row, relations


@dataclass
class Index:
    """The relations of a project's graph."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    library_imports: DataFrame
    #: Library imports as extracted, before those were dropped that turned out to lie in the project.
    raw_imports: DataFrame


def language_of(path: str | F.Column) -> F.Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]


def _sibling_paths() -> Column:
    folder = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", r"[^/]*$", "")).otherwise("")
    return F.array(F.concat(folder, "library", F.lit(".rs")), F.concat(folder, "library", F.lit("/mod.rs")))


def sibling_modules(edges: DataFrame, imports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rust imports of a module that lies beside the importing file become certain imports of that file."""
    rust = imports.where(F.endswith("file", F.lit(".rs")))
    each = rust.select("*", F.explode(_sibling_paths()).alias("path"))
    hits = each.join(files.select("path"), "path").groupBy("file", "library", "line").agg(F.min("path").alias("path"))
    made = hits.select(F.col("file").alias("src_file"), stem(F.col("file")).alias("src_name"), F.lit("Module").alias("src_kind"), F.col("path").alias("dst_file"), F.lit("").alias("dst_name"), F.lit("Module").alias("dst_kind"), F.lit("Imports").alias("kind"), "line", F.lit("Certain").alias("confidence"), F.col("library").alias("spec"))
    return edges.unionByName(made), imports.join(hits.select("file", "library", "line"), ["file", "library", "line"], "left_anti")


def resolve_all(symbols: DataFrame, edges: DataFrame, imports: DataFrame, files: DataFrame, rules: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges and library imports after the import pass, the pruning of libraries and the call pass."""
    spark = edges.sparkSession
    table = spark.createDataFrame(rules, "prefix string, wildcard boolean, targets array<string>") if rules else None
    edges, imports = sibling_modules(edges, imports, files)
    edges = cut(resolve.resolve_imports(edges, files, language_of("src_file"), table))
    language = language_of("src_file")
    inside = edges.where((F.col("kind") == "Imports") & (F.col("confidence") == "Certain") & F.col("spec").isNotNull())
    heads = inside.select(F.col("src_file").alias("file"), resolve.library_head(F.regexp_replace("spec", r"^\.+", ""), language).alias("library"))
    imports = resolve.prune_libraries(imports, heads)
    return resolve.resolve_calls(edges, symbols), imports


def cold_index(spark: SparkSession, root: str) -> Index:
    """The graph of a source tree: walk, read and extract in one pass, resolve imports, resolve calls."""
    crate = scan.read_crate_name(root)
    extracted = cut(scan.read_files(spark, root, also=lambda p, text: extract_row(p, text, crate), columns=EXTRACTED))
    files = extracted.drop("failed", "symbols", "edges", "imports")
    symbols, edges, raw = relations(extracted.withColumnRenamed("path", "file"))
    edges, imports = resolve_all(symbols, edges, raw, files, scan.load_alias_rules(root))
    return Index(files, symbols, edges, imports, raw)


def unresolved(edges: DataFrame) -> DataFrame:
    """Edges as the extraction left them, so that a renewed resolution starts from the same rows."""
    return edges.where(~((F.col("kind") == "Imports") & (F.col("confidence") == "Certain") & F.endswith("src_file", F.lit(".rs")) & ~F.col("spec").rlike("^(crate|self|super)(::|$)"))).select(
        *[c for c in edges.columns if c not in ("dst_file", "dst_kind", "confidence")],
        F.when(F.col("kind") == "Imports", F.col("spec")).otherwise(F.col("src_file")).alias("dst_file"),
        F.when(F.col("kind") == "Calls", "Function").otherwise(F.col("dst_kind")).alias("dst_kind"),
        F.lit("Unresolved").alias("confidence"),
    )


@dataclass
class Renewal:
    """What a change of files makes new: the touched files, all files whose edges may change, and the new rows of these."""

    touched: DataFrame
    affected: DataFrame
    rows: Index


def affected_files(index: Index, touched: DataFrame, moved: DataFrame, rules: list | None = None) -> DataFrame:
    """``file``: the touched files, those that import one of them, and those with an import that a ``moved`` (added or deleted) file may settle."""
    spark = index.edges.sparkSession
    table = spark.createDataFrame(rules, "prefix string, wildcard boolean, targets array<string>") if rules else None
    imports = index.edges.where("kind = 'Imports'")
    by_target = imports.where("confidence = 'Certain'").join(touched.select(F.col("file").alias("dst_file")), "dst_file", "left_semi").select(F.col("src_file").alias("file"))
    given = imports.where("spec is not null").select("src_file", "spec", "line")
    may = resolve.with_candidates(given, language_of("src_file"), table).select(F.col("src_file").alias("file"), F.explode("candidates").alias("path"))
    beside = index.raw_imports.where(F.endswith("file", F.lit(".rs"))).select("file", F.explode(_sibling_paths()).alias("path"))
    by_path = may.unionByName(beside).join(moved.select("path"), "path", "left_semi").select("file")
    return touched.select("file").unionByName(by_target).unionByName(by_path).distinct()


def renew(index: Index, fresh: DataFrame, touched: DataFrame, crate: str | None = None, rules: list | None = None) -> Renewal:
    """The rows that change when the ``touched`` files (``file``) are replaced by ``fresh`` ones (rows of the files table).

    Only edges of affected files are resolved again; edges of a file depend on no other file's edges.
    """
    touched = cut(touched.select("file").distinct())
    fresh = cut(fresh)
    extracted = cut(extract_files(fresh, crate))
    symbols, edges, raw = relations(extracted)
    fresh = fresh.drop("partial_parse").join(extracted.select(F.col("file").alias("path"), "partial_parse"), "path", "left")
    paths = touched.select(F.col("file").alias("path"))
    was, now = index.files.select("path").join(paths, "path", "left_semi"), fresh.select("path")
    moved = was.join(now, "path", "left_anti").unionByName(now.join(was, "path", "left_anti"))
    affected = cut(affected_files(index, touched, moved, rules))
    also = affected.join(touched, "file", "left_anti")  # as they are, but resolved anew
    again = unresolved(index.edges.join(also.select(F.col("file").alias("src_file")), "src_file", "left_semi"))
    known = index.files.select("path").join(paths, "path", "left_anti").unionByName(now)
    all_symbols = index.symbols.join(touched, "file", "left_anti").unionByName(symbols)
    raw_again = index.raw_imports.join(also, "file", "left_semi").unionByName(raw)
    edges, imports = resolve_all(all_symbols, again.unionByName(edges, allowMissingColumns=True), raw_again, known, rules)
    return Renewal(touched, affected, Index(fresh, symbols, cut(edges), cut(imports), raw))


def applied(index: Index, r: Renewal) -> Index:
    """The graph, or the buckets of it that were loaded, after a renewal."""
    def put(old: DataFrame, new: DataFrame, gone: DataFrame, column: str) -> DataFrame:
        return old.join(gone.select(F.col("file").alias(column)), column, "left_anti").unionByName(new, allowMissingColumns=True)

    return Index(
        put(index.files, r.rows.files, r.touched, "path"), put(index.symbols, r.rows.symbols, r.touched, "file"), put(index.edges, r.rows.edges, r.affected, "src_file"),
        put(index.library_imports, r.rows.library_imports, r.affected, "file"), put(index.raw_imports, r.rows.raw_imports, r.touched, "file"),
    )


def warm_start(spark: SparkSession, root: str, store: str) -> Index:
    """The stored graph, renewed for the files that changed; a cold index where nothing usable is stored.

    Equal roots of all hashes mean that nothing changed. Otherwise only the changed files are read and extracted,
    and the buckets of the files they affect are written.
    """
    old = load(spark, store)
    if old is None:
        fresh = cold_index(spark, root)
        save(fresh, store)
        return load(spark, store) or fresh
    hashes = cut(scan.hash_files(spark, root))
    new_root = incremental.merkle_root(hashes).first().root
    if new_root == _root_of(spark, store, old):
        return old
    changes = cut(incremental.changed_files(old.files.select("path", "content_hash"), hashes).where("change != 'same'"))
    fresh = scan.read_files(spark, root, changes.where("change != 'deleted'").select("path"))
    r = renew(old, fresh, changes.select(F.col("path").alias("file")), scan.read_crate_name(root), scan.load_alias_rules(root))
    store_renewal(r, store, new_root)
    return load(spark, store) or applied(old, r)


_PARTS = {"files": "path", "symbols": "file", "edges": "src_file", "library_imports": "file", "raw_imports": "file"}
_POINTER = "schema_version int, version string, part string, bucket int, schema string, root string"


def _bucket(column: str) -> Column:
    return F.pmod(F.crc32(F.encode(F.col(column), "UTF-8")), F.lit(scan.BUCKETS)).cast("int")


def _root_of(spark: SparkSession, store: str, old: Index) -> str:
    row = next((r for r in _pointer(spark, store) if r.root), None)
    return row.root if row else incremental.merkle_root(old.files.select("path", "content_hash")).first().root


def store_renewal(r: Renewal, store: str, root: str | None = None) -> str:
    """Writes the buckets of the affected files in their new state."""
    spark = r.affected.sparkSession
    buckets = sorted(x[0] for x in r.affected.select(_bucket("file")).distinct().collect())
    part = load(spark, store, buckets)
    if part is None:
        raise RuntimeError(f"no graph in {store}; build it with a cold index first")
    return save(applied(part, r), store, buckets, root)


def save(index: Index, store: str, buckets: list[int] | None = None, root: str | None = None) -> str:
    """Writes all buckets of a graph, or those given, as a new version, and then moves the pointer; readers see one state whole."""
    spark = index.files.sparkSession
    before = _pointer(spark, store)
    version = uuid.uuid4().hex
    pointer = [tuple(r) for r in before if r.part != "" and buckets is not None and r.bucket not in buckets]
    for name, column in _PARTS.items():
        df = getattr(index, name).withColumn("bucket", _bucket(column))
        kind = df.drop("bucket").schema.json()
        if name in ("edges", "library_imports"):  # the others still lie as they were read, by bucket
            df = df.repartition("bucket")
        df.write.partitionBy("bucket").parquet(f"{store}/{version}/{name}")
        pointer += [(schema.VERSION, version, name, b, kind, root) for b in _written(spark, f"{store}/{version}/{name}")]
        pointer.append((schema.VERSION, version, name, -1, kind, root))  # the schema, whether or not there are rows
    pointer = [(*r[:5], root) for r in pointer if r[3] >= 0 or r[1] == version]
    spark.createDataFrame(pointer, _POINTER).coalesce(1).write.mode("overwrite").json(f"{store}/{NEXT}")
    _move(spark, f"{store}/{NEXT}", f"{store}/{CURRENT}")
    _remove_old(spark, store, {r[1] for r in pointer} | {r.version for r in before})
    return version


def _folders(spark: SparkSession, at: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []


def _written(spark: SparkSession, at: str) -> list[int]:
    return sorted(int(x.removeprefix("bucket=")) for x in _folders(spark, at) if x.startswith("bucket="))


def _remove_old(spark: SparkSession, store: str, keep: set[str]) -> None:
    for x in _folders(spark, store):
        if x not in keep and x not in (CURRENT, NEXT):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{x}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


CURRENT, NEXT = "current", "next"


def _move(spark: SparkSession, source: str, target: str) -> None:
    """Puts a folder in another's place, on any file system that Spark can write to."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(path(target), True)
    if not fs.rename(path(source), path(target)):
        raise OSError(f"{source} could not be moved to {target}")


def _pointer(spark: SparkSession, store: str) -> list:
    """The rows of the pointer. Between the two steps of a move it is found under its next name."""
    for name in (CURRENT, NEXT):
        if _folders(spark, f"{store}/{name}"):
            return spark.read.schema(_POINTER).json(f"{store}/{name}").collect()
    return []


def load(spark: SparkSession, store: str, buckets: list[int] | None = None) -> Index | None:
    """The stored graph, or some buckets of it; None where there is none or its schema has another version."""
    rows = _pointer(spark, store)
    if not rows or any(r.schema_version != schema.VERSION for r in rows):
        return None
    parts = []
    for name in _PARTS:
        own = [r for r in rows if r.part == name]
        kind = StructType.fromJson(json.loads(next(r.schema for r in own if r.bucket < 0)))
        paths = [f"{store}/{r.version}/{name}/bucket={r.bucket}" for r in own if r.bucket >= 0 and (buckets is None or r.bucket in buckets)]
        parts.append(spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind))
    return Index(*parts)
