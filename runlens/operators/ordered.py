"""Tables in one order over all their rows, without a task that holds them all: places, strict zips, running values.

Rows are dealt by ranges of their order and written down sorted; a row's number is its place in its part and the number of rows in
the parts before. What is carried from part to part is one row a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import materialise


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows, written down in order, with `_part` and `_at`, the place within it."""
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    known = materialise(rows.sparkSession, own)
    return known.select(*rows.columns, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))


def _before() -> Window:
    return Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Adds the number of each row in the order, from 0; equal rows in any order."""
    p = placed(rows, order)
    first = p.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_first"))
    return p.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first")


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two tables side by side by place, as `left` and `right` structs with `position`; unequal lengths are an error."""
    a = numbered(left, left_order, "_position").select(F.col("_position").alias("position"), F.struct(*left.columns).alias("left"))
    b = numbered(right, right_order, "_position").select(F.col("_position").alias("position"), F.struct(*right.columns).alias("right"))
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"{n} rows beside {m}")
    return a.join(b, "position", "full_outer")


def running(rows: DataFrame, order: list[str], flag: Column, value: Column) -> DataFrame:
    """Adds `n_so_far`, the flagged rows up to each row in the order, itself included, and `latest`, the value of the last of them."""
    p = placed(rows, order)
    own = p.withColumn("_value", F.when(flag, value)).withColumn("_flag", F.coalesce(flag, F.lit(False)).cast("bigint"))
    parts = own.groupBy("_part").agg(F.sum("_flag").alias("_n"), F.max_by("_value", F.when(F.col("_flag") == 1, F.col("_at"))).alias("_last"))
    carried = parts.select("_part", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_n"), F.last("_last", ignorenulls=True).over(_before()).alias("_last"))
    upto = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = own.withColumns({"_count": F.sum("_flag").over(upto), "_latest": F.last("_value", ignorenulls=True).over(upto)})
    out = local.join(F.broadcast(carried), "_part")
    return out.select(*rows.columns, (F.col("_n") + F.col("_count")).alias("n_so_far"), F.coalesce("_latest", "_last").alias("latest"))
