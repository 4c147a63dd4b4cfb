"""Greedy batches under a budget, for any number of rows: jump pointers over running sums."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftweb.scale import numbered_by_range
from siftweb.session import cut_lineage

#: rows of a block
BLOCK_ROWS = 1 << 16


def _reach(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running sums, and for every row as the first of a batch: how far that batch reaches, and the first row of the next one."""
    total = np.cumsum(sizes)
    reach = np.maximum(total - sizes + budget, total)  # a batch holds its first row whatever its size
    return total, reach, np.searchsorted(total, reach, side="right")


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("rank")


def _block_map(budget: int):
    """Of one block: every row that may start its first own batch, and how far the block's last batch reaches beyond it then."""

    def run(table: pa.Table) -> pa.Table:
        sizes = _sorted(table.select(["rank", "size"])).column("size").to_numpy()
        total, reach, following = _reach(sizes, budget)
        last = np.where(following == len(sizes), np.arange(len(sizes)), following)
        while (last[last] != last).any():  # doubling inside the block
            last = last[last]
        before = total - sizes
        n = int(np.searchsorted(before, budget, side="right"))
        return pa.table({"block": pa.array([table.column("block")[0].as_py()] * n, pa.int64()), "entry": pa.array(np.arange(n)), "low": pa.array(before[:n]),
                         "high": pa.array(total[:n]), "carry": pa.array((reach[last] - total[-1])[:n])})

    return run


def _block_batches(budget: int):
    """Rows of one block with the number of their batch in it, -1 for rows of a batch that began before."""

    def run(table: pa.Table) -> pa.Table:
        rows = _sorted(table)
        _, _, following = _reach(rows.column("size").to_numpy(), budget)
        heads, at = np.zeros(rows.num_rows, np.int64), int(rows.column("entry")[0].as_py())
        while at < rows.num_rows:
            heads[at] = 1
            at = int(following[at])
        return rows.select(["block", "rank"]).append_column("inside", pa.array(np.cumsum(heads) - 1))

    return run


def _entries(blocks: DataFrame) -> DataFrame:
    """The row at which every block's first own batch starts: the orbit of the first block's first row, by pointer doubling over the blocks' maps."""
    maps = cut_lineage(blocks)
    following = maps.select((F.col("block") - 1).alias("block"), F.col("entry").alias("next_entry"), "low", "high")
    jumps = maps.select("block", "entry", "carry").join(following, "block").filter((F.col("low") <= F.col("carry")) & (F.col("carry") < F.col("high"))).select(
        "block", "entry", (F.col("block") + 1).alias("to_block"), F.col("next_entry").alias("to_entry"))
    reached = maps.filter("block = 0 AND entry = 0").select("block", "entry")
    n = maps.agg(F.max("block")).first()[0] or 0
    done = 1
    while done <= n:
        jumps = cut_lineage(jumps)
        ahead = reached.join(jumps, ["block", "entry"]).select(F.col("to_block").alias("block"), F.col("to_entry").alias("entry"))
        reached = cut_lineage(reached.unionByName(ahead))
        then = jumps.select(F.col("block").alias("to_block"), F.col("entry").alias("to_entry"), F.col("to_block").alias("far_block"), F.col("to_entry").alias("far_entry"))
        jumps = jumps.join(then, ["to_block", "to_entry"]).select("block", "entry", F.col("far_block").alias("to_block"), F.col("far_entry").alias("to_entry"))
        done *= 2
    return reached


def batch_by_budget(df: DataFrame, order: list[Column], size: Column, budget: int, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, batch): rows in ``order`` go into a batch until the next one would pass ``budget``; a new batch starts with it.

    ``order`` must be total. Rows are numbered by ranges and cut into blocks. Where a block's first own batch starts depends
    on how far the batch before reaches into it, which leaves few rows to start at; for each of them the block knows how far its own
    last batch reaches. These maps, a few rows per block, are composed by doubling; then every block marks its batches by itself.
    Sizes must be positive. A row larger than the budget is a batch of its own.
    """
    rows = numbered_by_range(df.select(key, size.cast("long").alias("size"), *[c.alias(f"_o{i}") for i, c in enumerate(order)]),
                             [F.col(f"_o{i}") for i in range(len(order))], "rank").select(key, "size", "rank")
    least = max(block_rows, budget + 1)  # so that no batch spans a whole block
    rows = cut_lineage(rows.withColumn("block", F.floor(F.col("rank") / least).cast("long")))
    narrow = rows.select("block", "rank", "size")
    maps = narrow.groupBy("block").applyInArrow(_block_map(budget), "block long, entry long, low long, high long, carry long")
    placed = narrow.join(_entries(maps), "block").groupBy("block").applyInArrow(_block_batches(budget), "block long, rank long, inside long")
    placed = cut_lineage(placed)
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("block").agg((F.max("inside") + 1).alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row per block
    return rows.select(key, "rank").join(placed.join(bases, "block"), "rank").select(key, (F.col("base") + F.col("inside")).cast("int").alias("batch"))
