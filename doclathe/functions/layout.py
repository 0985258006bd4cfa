"""Grouping of sorted places: runs of a sorted array, as Spark columns and as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a run's next value is held against: its mean, its first value or its last.
MEAN, FIRST, LAST = "mean", "first", "last"


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is made once: as the one element of an array."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def once(df: DataFrame, **made: Column) -> DataFrame:
    """Adds columns that are made once a row: neither filters nor projections above move into the row that an inline yields."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def runs(items: Column, near: float, by: str = MEAN, value: str = "v", share: tuple[str, float] | None = None) -> Column:
    """The runs of an array of structs sorted by `value`: an array of arrays.

    An item stays in the run if its value is within `near` of the run's mean (or first, or last value),
    or within share[1] times the run's mean of the field share[0], if that is more; otherwise
    a new run starts. With ascending values no earlier run can take an item that the last one
    doesn't take, so this is first fit among all runs as well. One pass in the JVM: the state
    is a few numbers and the runs' starts.
    """
    zero, none = F.lit(0.0), F.array().cast("array<int>")
    start = F.struct(none.alias("starts"), F.lit(0).alias("i"), F.lit(0).alias("n"), zero.alias("ref"), zero.alias("sum"), zero.alias("extra"))

    def step(s: Column, x: Column) -> Column:
        v, extra = x[value].cast("double"), (x[share[0]].cast("double") if share else zero)
        ref = s["sum"] / s["n"] if by == MEAN else s["ref"]
        reach = F.greatest(F.lit(float(near)), share[1] * s["extra"] / s["n"]) if share else F.lit(float(near))
        stays = (s["n"] > 0) & (F.abs(v - ref) <= reach)
        of = lambda starts, n, ref, total, more: F.struct(starts.alias("starts"), (s["i"] + 1).alias("i"), n.alias("n"), ref.alias("ref"), total.alias("sum"), more.alias("extra"))
        on = of(s["starts"], s["n"] + 1, v if by == LAST else s["ref"], s["sum"] + v, s["extra"] + extra)
        return F.when(stays, on).otherwise(of(F.concat(s["starts"], F.array(s["i"])), F.lit(1), v, v, extra))

    return bound(items, lambda xs: _parted(xs, F.aggregate(xs, start, step, lambda s: s["starts"])))


def _parted(items: Column, starts: Column) -> Column:
    return bound(starts, lambda begun: F.transform(begun, lambda at, k: F.slice(items, at + 1, F.coalesce(F.get(begun, k + 1), F.size(items)) - at)))


def split_where(items: Column, new: Callable[[Column], Column]) -> Column:
    """An array parted before each item for which `new` holds, and before the first."""
    at = lambda xs: F.filter(F.transform(xs, lambda x, i: F.when((i == 0) | new(x), i)), lambda i: i.isNotNull())
    return bound(items, lambda xs: _parted(xs, at(xs)))


def nearest(value: Column, middles: Column) -> Column:
    """Position from 0 of the middle that is nearest; of equally near ones the first. Null without any."""
    return bound(F.transform(middles, lambda m: F.abs(value - m)), lambda far: (F.array_position(far, F.array_min(far)) - 1).cast("int"))


def duck_runs(values: str, near: str, by: str = MEAN, extra: str = "0.0", share: float = 0.0) -> str:
    """SQL of DuckDB for the run number, from 1, of each row of a sorted list of structs with field v."""
    ref = "s.total / s.n" if by == MEAN else "s.ref"
    stays = f"(s.n > 0 AND abs(e.ref - {ref}) <= greatest({near}, {share} * s.extra / greatest(s.n, 1)))"
    item = "{{'k': CAST([] AS INTEGER[]), 'n': 0, 'ref': {0}, 'total': CAST(0 AS DOUBLE), 'extra': {1}}}"
    return f"""list_reduce(list_prepend({item.format("CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)")}, list_transform({values}, lambda x: {item.format("CAST(x.v AS DOUBLE)", f"CAST({extra} AS DOUBLE)")})),
  lambda s, e: {{'k': list_append(s.k, CASE WHEN {stays} THEN s.k[-1] ELSE coalesce(s.k[-1], 0) + 1 END), 'n': CASE WHEN {stays} THEN s.n + 1 ELSE 1 END, 'ref': CASE WHEN {stays} THEN s.ref ELSE e.ref END,
  'total': CASE WHEN {stays} THEN s.total + e.ref ELSE e.ref END, 'extra': CASE WHEN {stays} THEN s.extra + e.extra ELSE e.extra END}}).k"""
