"""Left joins that treat a missing key as a value and keep clashing columns apart.

No join carries a broadcast hint: a small right side is broadcast by Spark's own size check
(statistics first, measured sizes under AQE), a large one is shuffled, and AQE splits a skewed
left partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from firnline.operators.skew import join_keys


def left_join(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str],
    suffixes: tuple[str, str] = ("_x", "_y"),
    na_matches: bool = True,
) -> DataFrame:
    """Left join on shared key names; other shared names get a suffix.

    `na_matches=False` is the plain equality join, for keys known to be present on the right.
    The many rows belong on the left; for the reverse see `dimension_left_join`.
    """
    a, b = _apart(a, b, keys, suffixes)
    if na_matches:
        return join_keys(a, b, keys, "left")
    return a.join(b, list(keys), "left").select(
        *a.columns, *[c for c in b.columns if c not in keys]
    )


def natural_left_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Left join on every name the two tables share."""
    keys = [c for c in a.columns if c in b.columns]
    if not keys:
        raise ValueError("the tables share no column name")
    return left_join(a, b, keys)


def dimension_left_join(
    dimension: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Every row of the dimension with its facts, or without any.

    An outer join could not split a hot key of the facts, the side it must not lose rows of
    being the other one. So the facts look up the dimension (broadcast if small, and splittable
    by AQE if not), and the rows of the dimension without facts are appended.
    """
    dimension, facts = _apart(dimension, facts, keys, suffixes)
    rest = [c for c in facts.columns if c not in keys]
    matched = join_keys(facts, dimension, keys, "inner").select(*dimension.columns, *rest)
    lonely = join_keys(dimension, facts.select(*keys).distinct(), keys, "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)


def _apart(
    a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a suffix on the names they share beside the keys."""
    clash = [c for c in b.columns if c in a.columns and c not in keys]
    return (
        a.withColumnsRenamed({c: c + suffixes[0] for c in clash}),
        b.withColumnsRenamed({c: c + suffixes[1] for c in clash}),
    )
