"""Bounded samples of labelled rows, the same on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthant.storage import materialize

_BITS = 53


def row_hash(identity: Sequence[str | Column]) -> Column:
    """A non-negative hash of 53 bits of a row's identity."""
    return F.xxhash64(*identity).bitwiseAND(F.lit((1 << _BITS) - 1))


def row_sample(rows: DataFrame, group: str, identity: Sequence[str | Column], n: int) -> DataFrame:
    """``group`` and ``row_hash`` of the ``n`` rows of each group with the smallest hashes of ``identity``.

    Exactly ``n`` of them, or all if there are fewer; rows equal in
    ``identity`` are one. Rows without a group are left out. A sketch of a
    group's number of distinct rows gives the hash below which a little more
    than ``n`` of them lie for certain; only these few are compared, so no task
    meets a group, whatever its share of the rows and however often rows repeat.
    """
    slim = rows.where(F.col(group).isNotNull()).select(F.col(group), row_hash(identity).alias("row_hash"))
    sizes = materialize(slim.groupBy(group).agg(F.approx_count_distinct("row_hash", 0.02).alias("size")), "sizes")
    reach = n + 8 * n**0.5 + 64  # far beyond the spread of the number below the bound
    unit = F.col("row_hash") / float(1 << _BITS)
    near = slim.join(sizes, group).where(unit * F.col("size") * 0.9 < reach).select(group, "row_hash")  # 0.9: five errors of the sketch
    near = materialize(near.distinct(), "near")
    last = near.groupBy(group).agg(F.get(F.sort_array(F.collect_list("row_hash")), F.lit(n - 1)).alias("last"))
    return near.join(last, group).where(F.col("last").isNull() | (F.col("row_hash") <= F.col("last"))).select(group, "row_hash")
