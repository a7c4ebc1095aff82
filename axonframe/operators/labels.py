"""Text labels: joining, ordered classification by patterns, named seed sets, audits and substitutions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_label(cols: Iterable[str], sep: str = " | ") -> Column:
    """Trimmed columns with a separator between; null parts are empty, not dropped."""
    return F.concat_ws(sep, *[F.coalesce(F.trim(F.col(c)), F.lit("")) for c in cols])


def matches(label: Column | str, pattern: str) -> Column:
    return F.coalesce((F.col(label) if isinstance(label, str) else label).rlike(f"(?i){pattern}"), F.lit(False))


def first_match(label: Column | str, rules: list[tuple[str, int]], otherwise: Column | int) -> Column:
    """The code of the first pattern that matches, whatever the case; else the fallback."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for pattern, code in reversed(rules):
        out = F.when(matches(label, pattern), F.lit(code)).otherwise(out)
    return out


def sub_family(population: str, inside: int, label: str, rules: list[tuple[str, int]], other: int) -> Column:
    """A second code only inside one population (``other`` if nothing matches there), 0 outside."""
    return F.when(F.col(population) == inside, first_match(label, rules, other)).otherwise(F.lit(0))


def seed_sets(nodes: DataFrame, id_col: str, label: str, sets: list[tuple[str, str]]) -> DataFrame:
    """``set, rank, id``: a row for each named set that a node's label matches; ranks in the order given."""
    found = F.array(*[F.when(matches(label, p), F.struct(F.lit(n).alias("set"), F.lit(k).alias("rank"))) for k, (n, p) in enumerate(sets)])
    return nodes.select(F.col(id_col).alias("id"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s")).select("s.set", "s.rank", "id")


def ordered_seeds(seeds: DataFrame) -> DataFrame:
    """Each id once, under its first set: ``id, rank``."""
    return seeds.groupBy("id").agg(F.min("rank").alias("rank"))


def landmark_counts(nodes: DataFrame, label: str, patterns: dict[str, str]) -> DataFrame:
    """One row: how many labels match each pattern."""
    return nodes.agg(*[F.count_if(matches(label, p)).alias(n) for n, p in patterns.items()])


def parsed_point(text: str, scale: float = 1.0) -> list[Column]:
    """x, y, z of a text ``x,y,z``; 0 for what is missing or no number."""
    return [(F.coalesce(F.expr(f"try_cast(trim(get(split(`{text}`, ','), {k})) AS double)"), F.lit(0.0)) * scale).alias(n) for k, n in enumerate("xyz")]


def substituted(text: str, table: list[tuple[str, str]]) -> Column:
    """All substitutions, one after another, of literal strings."""
    return reduce(lambda c, fix: F.replace(c, F.lit(fix[0]), F.lit(fix[1])), table, F.col(text))


def audit(docs: DataFrame, id_col: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """``id, pattern, hits``: how often stale patterns stand in each text, only where they do; one pass over the texts."""
    hits = F.array(*[F.struct(F.lit(n).alias("pattern"), F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long").alias("hits")) for n, p in patterns.items()])
    return docs.select(F.col(id_col).alias("id"), F.explode(hits).alias("h")).select("id", "h.pattern", "h.hits").filter("hits > 0")


def ladder(value: str, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The text of the first threshold that the value reaches, from the highest down."""
    out = F.lit(otherwise)
    for at, text in sorted(steps):
        out = F.when(F.col(value) >= at, F.lit(text)).otherwise(out)
    return out


def dominant(options: list[tuple[str, str]], default: str) -> Column:
    """The name of the largest column; only a strictly larger one displaces an earlier name; ``default`` if none is over 0."""
    best, name = F.lit(0.0), F.lit(default)
    for n, c in options:
        value = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        name = F.when(value > best, F.lit(n)).otherwise(name)
        best = F.greatest(best, value)
    return name
