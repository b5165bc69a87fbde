"""Folds over the items of one row that put out a list, at a cost that does not grow with its square."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallypact.functions.binding import let

#: Items of an array that are folded into one list before that list is set aside.
BLOCK = 128


def fold_out(items: Column, carry: Column, step: Callable[[Column, Column], tuple[Column, Column]],
             out_type: str, block: int = BLOCK) -> Column:
    """STRUCT(carry, out) after ``step(carry, item) -> (carry, array to put out)`` over all items.

    Appending to an array copies it. Here a list is copied only inside its block of ``block`` items; finished
    blocks are kept as a list of lists and flattened once, so n items cost n x block + (n / block)^2 copies. NULL items
    give NULL.
    """
    def nothing():
        return F.array().cast(f"array<{out_type}>")

    def inner(state, item):
        after, out = step(state["carry"], item)
        return F.struct(after.alias("carry"), F.concat(state["out"], out).alias("out"))

    def outer(state, part):
        folded = F.aggregate(part, F.struct(state["carry"].alias("carry"), nothing().alias("out")), inner)
        return let(folded, lambda f: F.struct(
            f["carry"].alias("carry"), F.concat(state["done"], F.array(f["out"])).alias("done")))

    def all_of(every):
        count = F.ceil(F.size(every) / block).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        parts = F.transform(numbers, lambda n: F.slice(every, n * block + 1, F.lit(block)))
        start = F.struct(carry.alias("carry"), F.array().cast(f"array<array<{out_type}>>").alias("done"))
        return F.aggregate(parts, start, outer, lambda state: F.struct(
            state["carry"].alias("carry"), F.flatten(state["done"]).alias("out")))

    return let(items, all_of)
