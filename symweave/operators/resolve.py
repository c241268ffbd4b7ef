"""Resolving imports and calls by joins instead of file-system probes.

Every import becomes a list of candidate paths in order of priority; one equi-join with the files keeps
those that exist, and the smallest priority wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.functions.paths import normalize_path

# The suffixes tried for script imports, in order.
SCRIPT_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def _folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def _joined(folder: Column, rest: Column) -> Column:
    return normalize_path(F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as the variable of a list of one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _with_suffixes(base: Column) -> Column:
    """As it is, with each suffix added, then with a known extension replaced."""

    def all_of(b: Column) -> Column:
        bare = F.regexp_replace(b, r"\.(m|c)?(j|t)sx?$", "")
        added = F.transform(F.array(*map(F.lit, SCRIPT_SUFFIXES)), lambda s: F.concat(b, s))
        replaced = F.transform(F.array(*map(F.lit, SCRIPT_SUFFIXES[1:7])), lambda s: F.concat(bare, s))
        return F.concat(added, F.when(bare != b, replaced).otherwise(F.array().cast("array<string>")))

    return _let(base, all_of)


def script_candidates(src: Column, spec: Column, mapped: Column | None = None) -> Column:
    """Candidate paths of a script import; ``mapped`` holds the bases that alias rules give, best first."""
    near = F.when(F.startswith(spec, F.lit(".")), _with_suffixes(_joined(_folder(src), spec))).when(F.startswith(spec, F.lit("/")), _with_suffixes(normalize_path(F.substring(spec, 2, 1 << 30))))
    none = F.array().cast("array<string>")
    if mapped is None:
        return F.coalesce(near, none)
    return F.concat(F.flatten(F.transform(F.coalesce(mapped, none), lambda m: _with_suffixes(normalize_path(m)))), F.coalesce(near, none))


def python_candidates(src: Column, spec: Column) -> Column:
    """Dots climb from the importing package, never above the root; else under ``src``, then from the root."""
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    rest = F.translate(F.regexp_replace(spec, r"^\.+", ""), ".", "/")
    parts = F.split(_folder(src), "/")
    up = F.greatest(F.size(parts) - F.greatest(dots - 1, F.lit(0)), F.lit(0))
    package = F.array_join(F.slice(parts, F.lit(1), up), "/")
    base = F.when(package == "", rest).otherwise(F.concat(package, F.lit("/"), rest))
    relative = F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    absolute = F.array(*[F.concat(F.lit(p), rest, F.lit(s)) for p in ("src/", "") for s in (".py", "/__init__.py")])
    return F.when(dots > 0, relative).otherwise(absolute)


def rust_candidates(spec: Column, root: str = "src") -> Column:
    """``crate``, ``self`` and ``super`` start at the crate root; the longest module path comes first."""
    parts = F.split(F.regexp_replace(spec, r"^(crate|self|super)(::|$)", ""), "::")
    own = spec.rlike(r"^(crate|self|super)::")
    lengths = F.reverse(F.sequence(F.lit(1), F.size(parts)))
    paths = F.flatten(F.transform(lengths, lambda n: F.transform(F.array(F.lit(".rs"), F.lit("/mod.rs")), lambda s: F.concat(F.lit(root + "/"), F.array_join(F.slice(parts, F.lit(1), n), "/"), s))))
    return F.when(own, paths).otherwise(F.array().cast("array<string>"))


def alias_bases(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """``import_id, mapped``: the bases that alias rules give for a spec, longest prefix first.

    ``rules`` (``prefix, wildcard, targets``) comes from one configuration file; it is joined by prefix, so
    its size must be that of a configuration: more than 10 000 rules are refused.
    """
    if rules.count() > 10_000:
        raise ValueError("alias rules are configuration; more than 10 000 are not joined by prefix")
    hit = (F.col("wildcard") & F.startswith("spec", F.col("prefix"))) | (~F.col("wildcard") & (F.col("spec") == F.col("prefix")))
    rest = F.substring("spec", F.length("prefix") + 1, F.lit(1 << 30))
    bases = F.transform("targets", lambda t: F.when(F.col("wildcard"), F.replace(t, F.lit("*"), rest)).otherwise(t))
    found = imports.select("import_id", "spec").join(F.broadcast(rules), hit)
    ordered = F.array_sort(F.collect_list(F.struct((-F.length("prefix")).alias("o"), F.col("prefix").alias("p"), bases.alias("b"))))
    return found.groupBy("import_id").agg(F.flatten(F.transform(ordered, lambda x: x["b"])).alias("mapped"))


def pick_existing(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``import_id, resolved_file`` from ``import_id, candidates``: the first candidate that is a file."""
    each = imports.select("import_id", F.posexplode("candidates").alias("priority", "path")).where(F.col("path").isNotNull())
    hits = each.join(files.select("path").distinct(), "path")
    return hits.groupBy("import_id").agg(F.min_by("path", "priority").alias("resolved_file"))


def with_candidates(work: DataFrame, languages: Column, rules: DataFrame | None = None, rust_root: str = "src") -> DataFrame:
    """Import edges with an ``import_id`` and the ``candidates`` for their target, the best first."""
    work = work.withColumn("import_id", F.xxhash64("src_file", "spec", "line")).withColumn("lang", languages)
    mapped = F.lit(None).cast("array<string>")
    if rules is not None:
        work = work.join(alias_bases(work.where(F.col("lang").isin("typescript", "javascript")).dropDuplicates(["import_id"]), rules), "import_id", "left")
        mapped = F.col("mapped")
    src, spec = F.col("src_file"), F.col("spec")
    found = (
        F.when(F.col("lang").isin("typescript", "javascript"), script_candidates(src, spec, mapped))
        .when(F.col("lang") == "python", python_candidates(src, spec))
        .when(F.col("lang") == "rust", rust_candidates(spec, rust_root))
    )
    return work.withColumn("candidates", found)


def resolve_imports(edges: DataFrame, files: DataFrame, languages: Column, rules: DataFrame | None = None, rust_root: str = "src") -> DataFrame:
    """Import edges with their target file and Certain where a candidate exists; others stay as they are."""
    is_import = F.col("kind") == "Imports"
    work = with_candidates(edges.where(is_import & (F.col("confidence") == "Unresolved")), languages, rules, rust_root)
    got = pick_existing(work.dropDuplicates(["import_id"]), files)
    done = work.join(got, "import_id", "left")
    hit = F.col("resolved_file").isNotNull()
    resolved = done.select(*[c for c in edges.columns if c not in ("dst_file", "dst_name", "dst_kind", "confidence")], F.coalesce("resolved_file", "dst_file").alias("dst_file"), F.when(hit, "").otherwise(F.col("dst_name")).alias("dst_name"), F.when(hit, "Module").otherwise(F.col("dst_kind")).alias("dst_kind"), F.when(hit, "Certain").otherwise(F.col("confidence")).alias("confidence"))
    rest = edges.where(~(is_import & (F.col("confidence") == "Unresolved")) | F.col("confidence").isNull() | F.col("kind").isNull())
    return rest.unionByName(resolved)


def library_head(spec: Column, language: Column) -> Column:
    """The package a spec belongs to, by the language's own separators."""
    scoped = F.regexp_extract(spec, r"^(@[^/]+/[^/]+)", 1)
    script = F.when(F.startswith(spec, F.lit("@")), scoped).otherwise(F.substring_index(spec, "/", 1))
    return F.when(language == "python", F.substring_index(spec, ".", 1)).when(language == "rust", F.substring_index(spec, "::", 1)).otherwise(script)


def prune_libraries(imports: DataFrame, resolved: DataFrame) -> DataFrame:
    """Library imports without those whose package was resolved to a file (``file, library`` of ``resolved``)."""
    return imports.join(resolved.select("file", "library").distinct(), ["file", "library"], "left_anti")


def resolve_calls(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Unresolved calls with their target where it is clear.

    A name that the caller's own file declares stays there: with another kind the kind is corrected
    (Inferred), with the same kind nothing changes. Otherwise the files that the caller's file certainly
    imports are searched; exactly one file with the name makes the call Inferred. Within a file the
    declaration with the smallest line counts.
    """
    open_call = (F.col("kind") == "Calls") & (F.col("confidence") == "Unresolved")
    calls = edges.where(open_call)
    needed = symbols.join(calls.select(F.col("dst_name").alias("name")).distinct(), "name", "left_semi")
    decl = needed.groupBy("file", "name").agg(F.min_by("kind", F.struct("line_start", "kind")).alias("decl_kind"), F.collect_set("kind").alias("kinds"))
    own = decl.select(F.col("file").alias("src_file"), F.col("name").alias("dst_name"), F.col("decl_kind").alias("own_kind"), F.col("kinds").alias("own_kinds"))
    names = calls.select("src_file", "dst_name").distinct()
    imported = edges.where((F.col("kind") == "Imports") & (F.col("confidence") == "Certain")).select("src_file", F.col("dst_file").alias("file")).distinct()
    # most open names belong to libraries: those that no file declares go before names meet imports
    declared = decl.select(F.col("name").alias("dst_name")).distinct()
    wanted = names.join(own.select("src_file", "dst_name"), ["src_file", "dst_name"], "left_anti").join(declared, "dst_name", "left_semi")
    there = wanted.join(imported, "src_file").join(decl.select("file", F.col("name").alias("dst_name"), "decl_kind"), ["file", "dst_name"])
    only = there.groupBy("src_file", "dst_name").agg(F.count_distinct("file").alias("n"), F.min("file").alias("far_file"), F.min("decl_kind").alias("far_kind")).where("n = 1").drop("n")
    done = calls.join(own, ["src_file", "dst_name"], "left").join(only, ["src_file", "dst_name"], "left")
    here = F.col("own_kind").isNotNull()
    fixed = here & ~F.array_contains("own_kinds", F.col("dst_kind"))
    far = ~here & F.col("far_file").isNotNull()
    out = done.select(
        *[c for c in edges.columns if c not in ("dst_file", "dst_kind", "confidence")],
        F.when(far, F.col("far_file")).otherwise(F.col("dst_file")).alias("dst_file"),
        F.when(far, F.col("far_kind")).when(fixed, F.col("own_kind")).otherwise(F.col("dst_kind")).alias("dst_kind"),
        F.when(far | fixed, "Inferred").otherwise(F.col("confidence")).alias("confidence"),
    )
    return edges.where(~F.coalesce(open_call, F.lit(False))).unionByName(out)
