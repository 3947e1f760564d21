"""Text sheets: typed columns, rejects in a column of their own, counts taken in the pass that uses the rows.

Uploaded sheets are text.  A cell that cannot be read must neither stop a report nor turn silently into nothing, so every
cell is read with ``try_cast``, what could not be read is named in a reject column, and observed metrics count the rejects
while the report runs, without a pass of their own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

REJECT = "reject"
_BROKEN = "__broken_line"


def unreadable_cell(column: str, kind: str) -> Column:
    """True where a text is there but cannot be read as ``kind``; blank text counts as missing."""
    text = F.trim(F.col(column).cast("string"))
    return F.coalesce((text != "") & text.try_cast(kind).isNull(), F.lit(False))


def typed(df: DataFrame, types: Mapping[str, str], reject: str = REJECT) -> DataFrame:
    """``df`` with the columns of ``types`` read as these types, and ``reject``.

    A cell that cannot be read becomes null and stands in ``reject`` as ``column=text``, several joined by ``; ``; null
    where all could be read.  A reject that is there already comes first.
    """
    notes = [F.when(unreadable_cell(c, kind), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c, kind in types.items()]
    before = [F.col(reject)] if reject in df.columns else []
    note = F.nullif(F.concat_ws("; ", *before, *notes), F.lit(""))
    read = {c: F.trim(F.col(c).cast("string")).try_cast(kind) for c, kind in types.items()}
    return df.withColumns({**read, reject: note})


def read_sheet(spark: SparkSession, path: str, types: Mapping[str, str], sep: str = ",", header: bool = True,
               reject: str = REJECT, **options) -> DataFrame:
    """A delimited text sheet with the columns of ``types`` and ``reject``.

    Spark reads the files, so they may be in any store it reaches, and splits large ones.  A line with too few or too many
    cells is kept: what could be split off is read, and the whole line is its reject.
    """
    if reject in types:
        raise ValueError(f"the sheet has a column named {reject}")
    names = ", ".join(f"`{c}` string" for c in types)
    raw = (
        spark.read.schema(f"{names}, {_BROKEN} string").option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BROKEN).csv(path, sep=sep, header=header, **options))
    return typed(raw.withColumnRenamed(_BROKEN, reject), types, reject)


def observe_rejects(df: DataFrame, name: str, reject: str = REJECT) -> tuple[DataFrame, Observation]:
    """``df`` that counts ``rows`` and ``rejects`` while whatever uses it runs; read ``Observation.get`` afterwards.

    The counts are of the rows that pass this point, so observe before filters and limits.
    """
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count(reject).alias("rejects")), seen


def observe_text(df: DataFrame, name: str, types: Mapping[str, str]) -> tuple[DataFrame, Observation]:
    """A reference table whose numbers are text, unchanged; counts ``rows`` and, by column, the texts that the report
    which uses it cannot read."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[
        F.count_if(unreadable_cell(c, kind)).alias(c) for c, kind in types.items()]), seen


def rejected_cells(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``column, rows, filled, rejects``: how much of each column of a table could be read, in one aggregate."""
    figures = df.agg(F.count(F.lit(1)).alias("rows"), *[a for c, kind in types.items() for a in (
        F.count(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias(f"filled_{c}"),
        F.count_if(unreadable_cell(c, kind)).alias(f"rejects_{c}"))])
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"filled_{c}").alias("filled"),
                               F.col(f"rejects_{c}").alias("rejects")) for c in types])
    return figures.select(F.inline(lines))
