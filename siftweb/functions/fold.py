"""Running states along an array inside a row, in time that grows with the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftweb.functions.urls import bind

#: items whose states are appended to one short array; a fold copies its state at every step, so its arrays must stay short
CHUNK = 256


def scan(items: Column, start: Column, step, kind: str) -> Column:
    """An array of struct<item, state> (its type is ``kind``): every item with the state before it.

    ``step(state, item)`` gives the next state. Items go by chunks: the states of a chunk are appended to an array of
    their own, the chunks' arrays are joined once at the end.
    """

    def along(part: Column, state: Column) -> Column:
        empty = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, empty, lambda acc, x: F.struct(
            step(acc["state"], x).alias("state"), F.array_append(acc["out"], F.struct(x.alias("item"), acc["state"].alias("state"))).alias("out")))

    def by_chunks(whole: Column) -> Column:
        empty = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        firsts = F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), F.lit(CHUNK))
        return F.flatten(F.aggregate(firsts, empty, lambda acc, at: bind(
            along(F.slice(whole, at, F.lit(CHUNK)), acc["state"]),
            lambda done: F.struct(done["state"].alias("state"), F.array_append(acc["out"], done["out"]).alias("out"))))["out"])

    return bind(items, by_chunks)
