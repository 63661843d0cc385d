"""Array columns: running state over an array, without a shuffle or a window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 32


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``out(state, item)`` of every item, where ``step`` moves the state on; ``kind`` is the result's type.

    What has been found so far is copied with each item, so long arrays are folded in chunks first and each chunk is run from
    its own state; what ``out`` gives should be small. ``items`` is read several times: it should be a column or a lambda's variable.
    """

    def item(k: Column) -> Column:
        return F.get(items, k)

    def run(places: Column, state: Column) -> Column:
        start = F.struct(state.alias("state"), F.array().cast(kind).alias("outs"))

        def merge(a: Column, k: Column) -> Column:
            return F.struct(step(a["state"], item(k)).alias("state"), F.concat(a["outs"], F.array(out(a["state"], item(k))).cast(kind)).alias("outs"))

        return F.aggregate(places, start, merge, lambda a: a["outs"])

    def chunk(i: Column) -> Column:
        return F.sequence(i * CHUNK, F.least((i + 1) * CHUNK, F.size(items)) - 1)

    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int"))
    first = F.struct(zero.alias("state"), F.slice(F.array(zero), 1, 0).alias("starts"))
    starts = F.aggregate(
        numbers,
        first,
        lambda a, i: F.struct(F.aggregate(chunk(i), a["state"], lambda state, k: step(state, item(k))).alias("state"), F.concat(a["starts"], F.array(a["state"])).alias("starts")),
        lambda a: a["starts"],
    )
    return F.when(F.size(items) <= CHUNK, run(positions(items), zero)).otherwise(F.flatten(F.zip_with(numbers, starts, lambda i, state: run(chunk(i), state))))


def positions(items: Column, first: int = 0) -> Column:
    """The places ``first`` to the last of an array; empty if there are none."""
    return F.when(F.size(items) > first, F.sequence(F.lit(first), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))


def each(frame: DataFrame, keys: list[str], items: Column | str, place: str | None = None) -> DataFrame:
    """A row for each item of an array of structs: ``keys``, its place if named, and its fields.

    An outer explode: of an inner one the optimiser would test the array's size first, and move that test below the
    projections that build the array, which repeats their work once for each use.
    """
    if place is None:
        rows = frame.select(*keys, F.explode_outer(items).alias("_x"))
    else:
        rows = frame.select(*keys, F.posexplode_outer(items).alias(place, "_x"))
    return rows.where(F.col("_x").isNotNull()).select(*keys, *([place] if place else []), "_x.*")
