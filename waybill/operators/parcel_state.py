"""State per parcel that merges: a daily report reads one day of the log and the state, not the whole log.

A state row holds what the reports need of a parcel's events: for each milestone its first or last second, and the seconds
of its earliest attempts with how many events fell on them.  Both merge exactly, in any order: the earliest of two parts is
the earliest of all, and the earliest few seconds of all are among the earliest few of each part.  So events that arrive
late only have to be in the log of the day they arrive.

The parts that are merged must not share an event; a day that is loaded again replaces its part (write the parts
partitioned by day, or keep yesterday's state until today's is complete).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import REPORT_SHIFT, event_epoch, from_epoch
from .milestones import KEY, Milestone

ATTEMPTS = "attempts"


def day_state(log: DataFrame, spec: Mapping[str, Milestone], attempt: str | Sequence[str] = (), upto: int = 3,
              key: str = KEY, actual: str = "actual_time", ctime: str = "ctime",
              reason: str = "reason_description") -> DataFrame:
    """The state of the events of ``log``: ``key``, a second for each milestone, and ``attempts``.

    ``attempts`` is an array of (second, n, reason) of the ``upto`` earliest seconds with an event whose code is in
    ``attempt``: n events, the smallest of their reasons.  Milestones and attempts are an aggregate each, with the code
    filter pushed into its scan; both end up partitioned by parcel and meet without a further shuffle.  A hot parcel sends
    a row per task, and a few seconds per task for its attempts.  Parcels without a listed event are absent.
    """
    attempt = [attempt] if isinstance(attempt, str) else list(attempt)
    clocks = {"actual": event_epoch(actual), "reconciled": event_epoch(actual, ctime)}
    wanted: dict[str, list] = {}
    for m in spec.values():
        wanted.setdefault(m.column, []).extend(m.codes)
    listed = F.lit(False)
    for column, values in wanted.items():
        listed = listed | F.col(column).isin(*dict.fromkeys(values))

    def seconds(m: Milestone) -> Column:
        return F.when(F.col(m.column).isin(*m.codes), clocks[m.clock])

    times = log.where(listed).groupBy(key).agg(*[_pick(m)(seconds(m)).alias(n) for n, m in spec.items()])
    if not attempt:
        return times.withColumn(ATTEMPTS, F.lit(None).cast(_ENTRIES)).withColumn(ATTEMPTS, _known())
    counted = log.where(F.col("tracking_code").isin(*attempt) & F.col(actual).isNotNull()).groupBy(
        key, F.col(actual).alias("second")).agg(F.count(F.lit(1)).alias("n"), F.min(reason).alias("reason"))
    order = Window.partitionBy(key).orderBy("second")
    first = counted.withColumn("pos", F.dense_rank().over(order)).where(F.col("pos") <= upto)
    attempts = first.groupBy(F.col(key).alias("__key")).agg(
        F.array_sort(F.collect_list(F.struct("second", "n", "reason"))).alias(ATTEMPTS))
    both = times.join(attempts, F.col(key).eqNullSafe(F.col("__key")), "full")
    return both.select(F.coalesce(key, "__key").alias(key), *spec, _known().alias(ATTEMPTS))


_ENTRIES = "array<struct<second:bigint,n:bigint,reason:string>>"


def _known() -> Column:
    return F.coalesce(F.col(ATTEMPTS), F.array().cast(_ENTRIES))


def _pick(m: Milestone):
    return F.min if m.pick == "first" else F.max


def merge_states(parts: Sequence[DataFrame], spec: Mapping[str, Milestone], upto: int = 3, key: str = KEY) -> DataFrame:
    """The state of all events of ``parts`` (states of disjoint logs).

    A parcel has at most one row in each part, so what is collected for it is ``upto`` entries for each part.
    """
    if not parts:
        raise ValueError("nothing to merge")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy(key).agg(
        *[_pick(m)(n).alias(n) for n, m in spec.items()],
        F.flatten(F.collect_list(ATTEMPTS)).alias(ATTEMPTS))
    return merged.withColumn(ATTEMPTS, _earliest(F.col(ATTEMPTS), upto))


def _earliest(entries: Column, upto: int) -> Column:
    """One entry for each of the ``upto`` earliest seconds: events added up, the smallest known reason."""
    seconds = F.slice(F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["second"]))), 1, upto)

    def of(second: Column) -> Column:
        same = F.filter(entries, lambda e: e["second"] == second)
        return F.struct(
            second.alias("second"), F.aggregate(same, F.lit(0).cast("bigint"), lambda n, e: n + e["n"]).alias("n"),
            F.array_min(F.transform(same, lambda e: e["reason"])).alias("reason"))

    return F.transform(seconds, of)


def state_milestones(state: DataFrame, spec: Mapping[str, Milestone], key: str = KEY,
                     shift: int = REPORT_SHIFT) -> DataFrame:
    """What :func:`~waybill.operators.milestones.milestones` gives for the log behind ``state`` (listed events only)."""
    return state.select(key, *[from_epoch(n, shift).alias(n) for n in spec])


def state_attempts(state: DataFrame, upto: int = 3, prefix: str = "dli", key: str = KEY) -> DataFrame:
    """What :func:`~waybill.operators.attempts.attempts_wide` gives for the log behind ``state``.

    The rank of an entry is one plus the events at earlier seconds, so ties skip ranks.
    """
    def rank(entries: Column) -> Column:
        return F.transform(entries, lambda e, i: F.struct(
            (F.aggregate(F.slice(entries, F.lit(1), i), F.lit(0).cast("bigint"), lambda n, x: n + x["n"]) + 1).alias("rank"),
            e["second"].alias("second"), e["reason"].alias("reason")))

    ranked = state.where(F.size(ATTEMPTS) > 0).select(key, rank(F.col(ATTEMPTS)).alias("ranked"))
    def of_rank(i: int) -> Column:
        return F.try_element_at(F.filter("ranked", lambda e: e["rank"] == i), F.lit(1))

    out = []
    for i in range(1, upto + 1):
        entry = of_rank(i)
        out += [from_epoch(entry["second"], REPORT_SHIFT).alias(f"{prefix}_{i}_time"),
                entry["reason"].alias(f"{prefix}_{i}_reason")]
    return ranked.select(key, *out)
