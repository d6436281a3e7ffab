"""Column functions: vectors as arrays of double, texts as tokens, and hashes that order rows alike on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def normalised(x: Column, least: float = 1e-12) -> Column:
    size = F.greatest(norm(x), F.lit(least))
    return F.transform(x, lambda v: v / size)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def all_finite(x: Column) -> Column:
    return F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))


def tokens(text: Column) -> Column:
    """The default tokenizer: runs of a-z and digits of the lower-cased text. Any column of arrays can take its place."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def without(ids: Column, special: Column) -> Column:
    """ids but the special ones; repeats stay, unlike with array_except."""
    return F.filter(ids, lambda t: ~F.array_contains(special, t))


def shuffle_key(id_: Column, seed: int | str) -> Column:
    """Orders rows at random, but alike on any partitioning and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_.cast("string")))


def hashed_int(id_: Column, seed: int | str) -> Column:
    """An integer below 2^32 for each id."""
    return F.conv(F.substring(shuffle_key(id_, seed), 1, 8), 16, 10).cast("long")


def uniform(id_: Column, seed: int | str) -> Column:
    """In (0, 1), with 32 bits."""
    return (hashed_int(id_, seed) + 0.5) / 4294967296.0


def first_text(*columns: Column) -> Column:
    """The first that isn't blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def escaped_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\\n"))
