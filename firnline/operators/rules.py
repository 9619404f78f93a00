"""Correction rules and aliases from field notes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.snow import case_when
from firnline.operators.joins import left_join


def apply_corrections(
    df: DataFrame, rules: DataFrame, keys: Sequence[str], target: str
) -> DataFrame:
    """Add the offset of the first matching rule to `target`.

    `rules` has the key columns, `rank` and `offset`; a NULL key in a rule matches anything.
    Rules are joined once per set of keys they name, on equality, and reduced to the lowest
    rank per key beforehand, so a row never multiplies.
    """
    def naming(chosen: Sequence[str]) -> Column:
        tests = [F.col(k).isNotNull() if k in chosen else F.col(k).isNull() for k in keys]
        return reduce(lambda a, b: a & b, tests)

    first = F.min(F.struct("rank", "offset"))
    found: list[Column] = []
    out = df
    for size in range(len(keys), 0, -1):
        for chosen in combinations(keys, size):
            slot = f"_rule_{len(found)}"
            best = rules.where(naming(chosen)).groupBy(*chosen).agg(first.alias(slot))
            out = left_join(out, best, list(chosen), na_matches=False)
            found.append(F.col(slot))
    everywhere = rules.where(naming(())).agg(first)
    winner = F.array_min(F.array(*found, everywhere.scalar()))
    shift = F.coalesce(winner.getField("offset"), F.lit(0.0))
    return out.withColumn(target, F.col(target) + shift).select(*df.columns)


def override(df: DataFrame, target: str, arms: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Recompute `target` where a condition holds; the first that does wins."""
    return df.withColumn(target, case_when(arms, F.col(target)))


def apply_aliases(
    df: DataFrame, aliases: DataFrame, key: str, old: str = "old", new: str = "new"
) -> DataFrame:
    """Replace an id by its alias where it has one. `aliases` holds each old id once."""
    lookup = aliases.select(F.col(old).alias(key), F.col(new).alias("_alias"))
    joined = left_join(df, lookup, [key], na_matches=False)
    return joined.withColumn(key, F.coalesce("_alias", key)).drop("_alias")


def default_value(df: DataFrame, col: str, value: Any) -> DataFrame:
    """A literal where the column is missing or blank."""
    c = F.col(col)
    if df.schema[col].dataType.simpleString() == "string":
        c = F.when(c != "", c)
    return df.withColumn(col, F.coalesce(c, F.lit(value)))
