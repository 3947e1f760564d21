"""Registry of checked queries.

A query states its result columns once (``"week:i region:s rate:f"``).  The
same projection is put around the Spark result and around the oracle SQL, so
that both sides name and type their columns alike:

i bigint · f double rounded to 4 digits (both sides lifted by 1e-9, so that sums
taken in another order cannot land on different sides of a tie; no negative zero) · s text · t 'yyyy-MM-dd HH:mm:ss' ·
d 'yyyy-MM-dd'
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from waybill.session import use_report_clock

from . import oracle_views  # noqa: F401  (fills the oracle side)
from .views import views_of, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.rsplit(":", 1)) for part in spec.split()]


def _spark_column(name: str, kind: str):
    c = F.col(f"`{name}`")
    return {
        "i": lambda: c.cast("bigint"), "s": lambda: c.cast("string"),
        "f": lambda: F.round(c.cast("double") + F.lit(1e-9), 4) + F.lit(0.0),
        "t": lambda: F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss"),
        "d": lambda: F.date_format(c.cast("date"), "yyyy-MM-dd"),
    }[kind]().alias(name)


def _duck_column(name: str, kind: str) -> str:
    q = f'"{name}"'
    return {
        "i": f"CAST({q} AS BIGINT)", "s": f"CAST({q} AS VARCHAR)",
        "f": f"round(CAST({q} AS DOUBLE) + 1e-9, 4) + 0.0",
        "t": f"strftime(CAST({q} AS TIMESTAMP), '%Y-%m-%d %H:%M:%S')",
        "d": f"strftime(CAST({q} AS DATE), '%Y-%m-%d')",
    }[kind] + f" AS {q}"


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(v: Views) -> DataFrame`` under ``name``."""
    spec = _columns(columns)

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_report_clock(spark)
            df = fn(views_of(spark, sf_dir))
            if name.startswith("rep_"):
                unlisted = set(df.columns) - {n for n, _ in spec}
                if unlisted:
                    raise ValueError(f"columns of {name} without a check: {sorted(unlisted)}")
            return df.select(*[_spark_column(n, k) for n, k in spec])

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            picked = ", ".join(_duck_column(n, k) for n, k in spec)
            ORACLES[name] = with_views(f"SELECT {picked} FROM (\n{sql.strip()}\n) AS q")
        return fn

    return register
