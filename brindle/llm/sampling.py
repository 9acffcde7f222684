"""Bounded samples of labelled rows, chosen by a hash of the id, without a shuffle of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def id_hash(column: str) -> Column:
    """CRC-32 of an id's decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def bounded_sample(rows: DataFrame, label: str, key: str, per_class: int, seed: int = 11) -> DataFrame:
    """About per_class rows of each label (all of a smaller class), the same ones in every run; null labels are left out.

    Labels are counted first, which sends one row per label to the driver."""
    counts = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return rows.where(F.lit(False))
    scale = 1 << 30
    share = F.lit(0)
    for value, n in sorted(counts.items()):
        share = F.when(F.col(label) == F.lit(value), F.lit(int(scale * min(1.0, per_class / n)))).otherwise(share)
    return rows.where(F.col(label).isNotNull() & (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(scale)) < share))
