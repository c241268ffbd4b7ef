"""References to records that do not exist: direct and inherited orphans over a graph of foreign keys.

The operator walks the foreign-key graph to a fixpoint. Round 0 finds *direct* orphans: rows with a
complete reference for which no parent is alive at the row's reference time. Every further round
semi-joins the children of the rows found in the round before; a child whose parent is alive but itself
orphaned is an *inherited* orphan, with the depth at which it was reached. A row is reported once, with
its smallest depth, so the walk ends even where tables refer to themselves or to each other in a ring.

Defined results: a reference with a null part refers to nothing and is no orphan. A null reference time
means "now": only parents that are not removed count as alive. A null ``valid_from`` means "always was".
Repeated rows give one result. An empty child table gives no rows; an empty parent table makes every
complete reference a direct orphan. Columns that the keys do not name are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.functions.paths import normalize_path
from symweave.operators.skew import hot_values, key_hash, salt_all, salt_many
from symweave.runtime import cut, table


@dataclass(frozen=True)
class Relation:
    """A table and the columns that identify a row in it."""

    df: DataFrame
    ids: tuple[str, ...]


@dataclass(frozen=True)
class ForeignKey:
    """``child.cols`` refers to ``parent.parent_cols``; both sides may be arbitrary string expressions."""

    name: str
    child: str
    parent: str
    cols: tuple[str | Column, ...]
    parent_cols: tuple[str | Column, ...]
    at: str | None = None
    valid_from: str | None = None
    valid_to: str | None = None
    where: Column | None = None
    parent_where: Column | None = None
    salts: int = field(default=32)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _when(name: str | None, default: int) -> Column:
    """A time as microseconds, ``default`` where there is none."""
    return F.coalesce(F.unix_micros(F.col(name).cast("timestamp")), F.lit(default)) if name else F.lit(default)


_NEVER, _ALWAYS, _NOW = 2**62, -(2**62), 2**62 - 1


def _children(rel: Relation, fk: ForeignKey) -> DataFrame:
    df = rel.df if fk.where is None else rel.df.where(fk.where)
    cols = [_col(c) for c in fk.cols]
    for c in cols:
        df = df.where(c.isNotNull())
    hi, lo = key_hash(*cols)
    return df.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(rel.ids)], hi.alias("_hi"), lo.alias("_lo"), _when(fk.at, _NOW).alias("_at"))


def _parents(rel: Relation, fk: ForeignKey) -> DataFrame:
    df = rel.df if fk.parent_where is None else rel.df.where(fk.parent_where)
    hi, lo = key_hash(*[_col(c) for c in fk.parent_cols])
    return df.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(rel.ids)], hi.alias("_hi"), lo.alias("_lo"), _when(fk.valid_from, _ALWAYS).alias("_from"), _when(fk.valid_to, _NEVER).alias("_to"))


def _referring(children: DataFrame, parents: DataFrame, hot: list[int], how: str, salts: int) -> DataFrame:
    """Children with (``left_semi``) or without (``left_anti``) a parent alive at their time. Hot keys are salted."""
    many = children.withColumn("_salt", salt_many(F.col("_hi"), F.struct(*_id_cols(children)), hot, salts))
    lives = parents.select(F.col("_hi").alias("_phi"), F.col("_lo").alias("_plo"), "_from", "_to").distinct()
    few = lives.withColumn("_psalt", F.explode(salt_all(F.col("_phi"), hot, salts)))
    on = (F.col("_hi") == F.col("_phi")) & (F.col("_salt") == F.col("_psalt")) & (F.col("_lo") == F.col("_plo")) & (F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col("_to"))
    return many.join(few, on, how)


def _id_cols(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in df.columns if c.startswith("_id")]


def cascade(relations: dict[str, Relation], keys: list[ForeignKey]) -> dict[str, DataFrame]:
    """Orphans per child table: its id columns, ``fk``, ``status`` (direct or inherited) and ``depth``.

    The result of every round is written to the shared folder; a round joins only the rows that the
    round before has found, and rows already reported are left out by an anti-join on the id.
    """
    hot = {fk.name: hot_values(_children(relations[fk.child], fk), "_hi") for fk in keys}

    def report(found: DataFrame, fk: ForeignKey, depth: int) -> DataFrame:
        return found.select(*_id_cols(found), F.lit(fk.name).alias("fk"), F.lit(depth).alias("depth"))

    def first(parts: list[DataFrame]) -> DataFrame:
        """One row for each id: the first key by name."""
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        ids = [c for c in df.columns if c.startswith("_id")]
        return df.groupBy(*ids, "depth").agg(F.min("fk").alias("fk"))

    def spread(found: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], bool]:
        kept = {t: cut(df) for t, df in found.items()}
        return kept, any(not df.isEmpty() for df in kept.values())

    fresh: dict[str, list[DataFrame]] = {}
    for fk in keys:
        broken = _referring(_children(relations[fk.child], fk), _parents(relations[fk.parent], fk), hot[fk.name], "left_anti", fk.salts)
        fresh.setdefault(fk.child, []).append(report(broken, fk, 0))
    frontier, more = spread({t: first(parts) for t, parts in fresh.items()})
    known = {t: [df] for t, df in frontier.items()}
    depth = 0
    while more:
        depth += 1
        fresh = {}
        for fk in keys:
            if fk.parent not in frontier or frontier[fk.parent].isEmpty():
                continue
            parents = _parents(relations[fk.parent], fk)
            ids = [c for c in parents.columns if c.startswith("_id")]
            fallen = parents.join(frontier[fk.parent].select(*ids), ids, "left_semi")
            hit = _referring(_children(relations[fk.child], fk), fallen, hot[fk.name], "left_semi", fk.salts)
            fresh.setdefault(fk.child, []).append(report(hit, fk, depth))
        found = {}
        for t, parts in fresh.items():
            df = first(parts)
            ids = [c for c in df.columns if c.startswith("_id")]
            for old in known.get(t, []):
                df = df.join(old.select(*ids), ids, "left_anti")
            found[t] = df
        frontier, more = spread(found)
        for t, df in frontier.items():
            known.setdefault(t, []).append(df)
    out = {}
    for t, parts in known.items():
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        named = [F.col(f"_id{i}").alias(c) for i, c in enumerate(relations[t].ids)]
        out[t] = df.select(*named, "fk", F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("status"), "depth")
    return out


def resolved(confidence: Column) -> Column:
    """Whether a confidence, in any spelling, calls the target resolved."""
    return F.lower(F.regexp_replace(confidence, r"^\s+|\s+$", "")).isin("certain", "inferred")


def graph_relations(spark, sf_dir: str) -> tuple[dict[str, Relation], list[ForeignKey]]:
    """The code graph's own foreign keys: files <- symbols <- edges, and files <- import edges."""
    files = table(spark, sf_dir, "source_files").select("file", "indexed_at", "removed_at")
    life = ["file", "name", "kind", "indexed_at", "removed_at"]
    own = table(spark, sf_dir, "symbols").select(*life, F.lit("symbols").alias("origin"))
    shared = table(spark, sf_dir, "prelude_symbols").select(*life, F.lit("prelude_symbols").alias("origin"))
    edges = table(spark, sf_dir, "edges").select("edge_id", "dst_file", "dst_name", "dst_kind", "confidence", "seen_at")
    is_file = (F.col("dst_name") == "") & (F.col("dst_kind") == "Module")
    to = (normalize_path(F.col("dst_file")), "dst_name", "dst_kind")
    span = {"at": "seen_at", "valid_from": "indexed_at", "valid_to": "removed_at"}
    relations = {
        "source_files": Relation(files, ("file", "indexed_at")),
        "symbols": Relation(own.unionByName(shared), ("file", "name", "kind", "indexed_at")),
        "edges": Relation(edges, ("edge_id",)),
    }
    keys = [
        ForeignKey("file", "symbols", "source_files", (normalize_path(F.col("file")),), (normalize_path(F.col("file")),), at="indexed_at", valid_from="indexed_at", valid_to="removed_at", where=F.col("origin") == "symbols"),
        ForeignKey("to_symbol", "edges", "symbols", to, (normalize_path(F.col("file")), "name", "kind"), where=resolved(F.col("confidence")) & ~is_file, **span),
        ForeignKey("to_file", "edges", "source_files", to[:1], (normalize_path(F.col("file")),), where=resolved(F.col("confidence")) & is_file, **span),
    ]
    return relations, keys


def orphan_edges(spark, sf_dir: str) -> DataFrame:
    """Orphaned edges: ``edge_id, fk, status, depth``."""
    relations, keys = graph_relations(spark, sf_dir)
    return cascade(relations, keys)["edges"]


def orphan_report(spark, sf_dir: str) -> DataFrame:
    """Orphaned edges per table they should be in, month of ``seen_at`` and status.

    A target under the shared package's paths should be in ``prelude_symbols``, any other symbol in
    ``symbols``, a module anchor in ``source_files``. Re-delivered edges count once, with the first month.
    """
    found = orphan_edges(spark, sf_dir)
    edges = table(spark, sf_dir, "edges").select("edge_id", "dst_file", F.date_format("seen_at", "yyyy-MM").alias("month"))
    one = edges.join(found, "edge_id").groupBy("edge_id", "fk", "status").agg(F.min("month").alias("month"), F.min(normalize_path(F.col("dst_file"))).alias("path"))
    target = F.when(F.col("fk") == "to_file", "source_files").when(F.startswith("path", F.lit("prelude/")), "prelude_symbols").otherwise("symbols")
    return one.groupBy(target.alias("target_table"), "month", "status").agg(F.count(F.lit(1)).alias("orphans"))
