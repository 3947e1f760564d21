"""Joins of facts with reference tables.

No join here carries a broadcast hint.  Spark broadcasts a side only when its
estimated or, at run time, measured size is below
``spark.sql.autoBroadcastJoinThreshold``; a larger reference table is joined by
sort-merge, where adaptive execution splits hot keys of the fact side.
:func:`skew_join` finds hot keys by a sketch and splits only these;
:func:`spread_join` splits every key, for a side that is known to be hot all over.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def ci_lookup(fact: DataFrame, dim: DataFrame, on: Mapping[str, str],
              carry: Mapping[str, str] | Sequence[str], how: str = "left",
              unique: bool = True) -> DataFrame:
    """Case-insensitive equality lookup over one or more key columns.

    ``on`` maps fact column -> dim column; ``carry`` names the dim columns to
    bring along (a mapping renames them).  Keys are folded once per side.  With
    ``unique`` repeated dim rows are collapsed so that exact copies of a
    reference row cannot multiply facts.
    """
    names = carry if isinstance(carry, Mapping) else {c: c for c in carry}
    keys = [f"__k{i}" for i in range(len(on))]
    side = dim.select(
        *[F.lower(F.col(d)).alias(k) for k, d in zip(keys, on.values())],
        *[F.col(src).alias(dst) for src, dst in names.items()],
    )
    if unique:
        side = side.distinct()
    match = None
    for key, column in zip(keys, on):
        term = F.lower(F.col(column)) == F.col(key)
        match = term if match is None else match & term
    return fact.join(side, match, how).drop(*keys)


def role_lookup(fact: DataFrame, dim: DataFrame, key: str, value: str,
                roles: Mapping[str, str]) -> DataFrame:
    """One dimension in several roles: ``roles`` maps fact column -> output name."""
    for column, output in roles.items():
        fact = ci_lookup(fact, dim, {column: key}, {value: output})
    return fact


def spread_join(big: DataFrame, small: DataFrame, on: Mapping[str, str],
                carry: Sequence[str], grain: Sequence[str], how: str = "left",
                salts: int = 16) -> DataFrame:
    """Equality join that cuts every key of ``big`` into ``salts`` parts.

    ``small`` (one row per key, too large to broadcast) is repeated once per
    salt, so a key holding a third of ``big`` is handled by ``salts`` tasks.
    The salt comes from ``grain``, columns that tell the rows of ``big`` apart, so a
    retried task repeats it exactly.
    """
    keys = [f"__k{i}" for i in range(len(on))]
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*grain), F.lit(salts)).cast("int"))
    side = small.select(
        *[F.col(d).alias(k) for k, d in zip(keys, on.values())],
        *carry,
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__part"),
    )
    match = F.col("__salt") == F.col("__part")
    for key, column in zip(keys, on):
        match = match & (F.col(column) == F.col(key))
    return salted.join(side, match, how).drop("__salt", "__part", *keys)


#: Parts that rows without a key are dealt to; they match nothing, so nothing is copied for them.
_KEYLESS_PARTS = 4096


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = 0.02, most: int = 40,
             tracked: int = 10_000) -> Column:
    """Fingerprints of the keys that hold at least ``share`` of the rows of ``df``, as a scalar subquery.

    A frequent-items sketch finds them in one pass over the key columns; it keeps ``tracked`` counters a task and merges
    them, so its size does not grow with the data, and a key of more than one part in ``tracked`` cannot be missed.  Give
    the table in which the keys stand, not the result of joins: the subquery reads it once more, its key columns only.
    """
    if most * share < 0.5:
        raise ValueError("most * share must reach 0.5")
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    counted = known.select(F.xxhash64(*keys).alias("key")).agg(
        F.call_function("approx_top_k", F.col("key"), F.lit(most), F.lit(tracked)).alias("top"),
        F.count(F.lit(1)).alias("rows"))
    hot = F.filter("top", lambda e: e["count"] >= F.col("rows") * share)
    return counted.select(F.transform(hot, lambda e: e["item"]).alias("hot")).scalar()


def copied_for(small: DataFrame, types: Mapping[str, str], on: Mapping[str, str], carry: Sequence[str],
               hot: Column | None, salts: int) -> DataFrame:
    """The small side of :func:`skew_join`: rows of hot keys once for each salt, all others once."""
    keys = [f"__k{i}" for i in range(len(on))]
    side = small.select(*[F.col(d).cast(types[b]).alias(k) for k, (b, d) in zip(keys, on.items())], *carry)
    # Also without hot keys the part comes out of a generator: a constant would be folded into the join's condition, and
    # rows would be dealt by their key alone.
    parts = F.array(F.lit(0))
    if hot is not None:
        is_hot = F.array_contains(hot, F.xxhash64(*keys))
        parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(parts)
    return side.withColumn("__part", F.explode(parts))


def skew_join(big: DataFrame, small: DataFrame, on: Mapping[str, str], carry: Sequence[str], grain: Sequence[str],
              hot: Column | None = None, how: str = "left", salts: int = 16) -> DataFrame:
    """Equality join that splits hot keys and rows without a key, and leaves everything else as it is.

    ``hot`` comes from :func:`hot_keys`; the rows of ``big`` with such a key are dealt to ``salts`` parts, and only the
    rows of ``small`` with such a key are copied.  Rows of ``big`` with a null key match nothing and are dealt out evenly
    instead of meeting in one task.  Without ``hot`` only the latter is done, and nothing is copied.  ``grain`` names
    columns that tell the rows of ``big`` apart, so that a retried task deals them out alike.
    """
    types = {c: big.schema[c].dataType for c in on}
    keys = [f"__k{i}" for i in range(len(on))]
    dealt = F.xxhash64(*grain)
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    salt = F.when(no_key, F.pmod(dealt, F.lit(_KEYLESS_PARTS)))
    if hot is not None:
        salt = salt.when(F.array_contains(hot, F.xxhash64(*on)), F.pmod(dealt, F.lit(salts)))
    salted = big.withColumn("__salt", salt.otherwise(0).cast("int"))
    match = F.col("__salt") == F.col("__part")
    for key, column in zip(keys, on):
        match = match & (F.col(column) == F.col(key))
    return salted.join(copied_for(small, types, on, carry, hot, salts), match, how).drop("__salt", "__part", *keys)


def exists_flag(df: DataFrame, keys: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Adds a boolean: does the key occur in ``keys``?  Never multiplies rows."""
    marked = keys.select(*on).distinct().withColumn("__hit", F.lit(True))
    return df.join(marked, list(on), "left").withColumn(
        flag, F.coalesce(F.col("__hit"), F.lit(False))).drop("__hit")


def count_by_key(df: DataFrame, keys: Sequence[str], output: str,
                 counted: Column | str = "*") -> DataFrame:
    """Attach ``count(counted)`` of the row's group to every row.

    Same result as a whole-partition window count, but the rows of a group are
    never brought together: the counts are pre-aggregated per task, and only
    the small table of counts is joined back.
    """
    value = F.lit(1) if isinstance(counted, str) and counted == "*" else (
        F.col(counted) if isinstance(counted, str) else counted)
    names = [f"__k{i}" for i in range(len(keys))]
    totals = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
        F.count(value).alias(output))
    match = None
    for key, name in zip(keys, names):
        term = F.col(key).eqNullSafe(F.col(name))
        match = term if match is None else match & term
    return df.join(totals, match, "left").drop(*names)
