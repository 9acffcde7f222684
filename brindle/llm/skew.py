"""Joins and numbering that deal out hot keys, so that no key needs a task of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from brindle.session import materialize

#: A key is hot above this share of the rows; there are at most so many hot keys as the share's inverse.
HOT_SHARE = 1 / 500
#: With fewer rows no key is hot.
LEAST_HOT = 500
SALTS = 64
#: Up to so many rows of some numbers each are broadcast.
BROADCAST_ROWS = 500_000


def hot_above(total: int) -> int:
    """The rows above which a key is hot among total rows."""
    return max(LEAST_HOT, int(total * HOT_SHARE))


def hot_keys(counts: DataFrame, keys: list[str], total: int, n: str = "_n") -> DataFrame:
    """Those of counts (keys, n) above HOT_SHARE of total rows, so at most 1 / HOT_SHARE of them; total must be no less than the sum of n."""
    return counts.where(F.col(n) > hot_above(total)).select(*keys, F.lit(True).alias("_hot"))


def salted_join(
    many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", *, salts: int = SALTS, spread: list[str] | None = None, hot: DataFrame | None = None
) -> DataFrame:
    """many joined to one on keys, the rows of many with a hot key being dealt over ``salts`` keys by a hash of ``spread``.

    one has few rows for each key; those of hot keys are repeated for each salt. how: inner or left. Hot keys are given as
    hot_keys() tells them, or are found by a pre-aggregated count, so at most 1 / HOT_SHARE of them are broadcast. Rows of
    many with a null key match nothing."""
    if hot is None:
        counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        total = counts.agg(F.sum("_n")).first()[0] or 0
        hot = materialize(hot_keys(counts, keys, total).coalesce(1), "hot-keys")
    no_key = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    dealt = F.pmod(F.xxhash64(*(spread or [c for c in many.columns if c not in keys])), F.lit(salts)).cast("int")
    left = many.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot") | no_key, dealt).otherwise(0)).drop("_hot")
    salt = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = one.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(salt)).drop("_hot")
    return left.hint("merge").join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def row_numbers(rows: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """rows with row, the number from 0 of each among those with its keys, in the order given; equal rows stand in any order.

    All are sorted together over many tasks, so a key needs no task of its own; what a task holds of each key before it is
    told from one count for each key and task."""
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*keys, *order, "_tie").drop("_tie")
    placed = materialize(placed.withColumn("_at", F.monotonically_increasing_id()), name)
    task = F.shiftright("_at", 33)
    shares = placed.groupBy(*keys, task.alias("_task")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = materialize(shares.select(*keys, "_task", (F.col("_first") - before).alias("_zero")), f"{name}-shares")
    few = shares.count() <= BROADCAST_ROWS
    out = placed.withColumn("_task", task).join(F.broadcast(shares) if few else shares.hint("merge"), [*keys, "_task"])
    return out.select(*rows.columns, (F.col("_at") - F.col("_zero")).alias("row"))
