"""Path expressions, all evaluated by the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def normalize_path(path: Column) -> Column:
    """The plain form of a path: forward slashes, no empty or ``.`` parts, ``x/..`` resolved.

    ``..`` parts that climb above the start of a relative path are kept; above the root of an absolute
    path they vanish. Null stays null, the empty path stays empty.
    """
    p = F.translate(path, "\\", "/")
    rooted = F.startswith(p, F.lit("/"))

    def step(acc: Column, part: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        climbs = (part == "..") & last.isNotNull() & (last != "..")
        stuck = (part == "..") & last.isNull() & rooted
        return (
            F.when(part.isin("", ".") | stuck, acc)
            .when(climbs, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.concat(acc, F.array(part)))
        )

    parts = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    plain = ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit("//")) & ~F.contains(path, F.lit("/.")) & ~F.startswith(path, F.lit(".")) & ~F.endswith(path, F.lit("/"))
    return F.when(plain, path).otherwise(joined)


def basename(path: Column) -> Column:
    """The last part of a path."""
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The last part of a path without its extension; a leading dot starts no extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The extension in lower case without its dot, empty when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1))


def is_test_path(path: Column) -> Column:
    """Whether any part of the path marks a test: a tests folder, or a test-like file name."""
    return F.exists(
        F.split(F.translate(path, "\\", "/"), "/"),
        lambda c: c.isin("tests", "__tests__")
        | F.contains(c, F.lit(".test."))
        | F.contains(c, F.lit(".spec."))
        | F.contains(c, F.lit("_test"))
        | F.startswith(c, F.lit("test_")),
    )


def has_suffix(path: Column, suffix: str) -> Column:
    """Whether the path ends with the whole parts of ``suffix``."""
    return F.endswith(F.concat(F.lit("/"), path), F.lit("/" + suffix.strip("/")))


def relative_to(path: Column, root: str) -> Column:
    """The path without the prefix ``root``; paths outside of it stay as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)
