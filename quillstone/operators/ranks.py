"""Values by their rank among all rows, and sums of those before, without sorting all of them or taking them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstone.sources.scratch import removed, written

#: Rows that are sorted in the end.
SORTED = 100_000


def prefix_sums(rows: DataFrame, value: Column, *order: Column) -> DataFrame:
    """rows with before, a double: the sum of a value over all rows that come before in an order without ties.

    Sums have the value's type: a decimal one is summed without the errors that a long run of doubles gathers. Rows are range-partitioned; the driver holds one sum a partition, and a window runs within each.
    """
    ranged = written(rows.withColumn("__v", value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "prefix")
    part = F.shiftright("__id", 33)
    sums = ranged.groupBy(part.alias("__part")).agg(F.sum("__v").alias("s")).orderBy("__part")
    offsets, total, kind = [], None, sums.schema["s"].dataType
    for r in sums.collect():
        offsets.append((r["__part"], r["s"] - r["s"] if total is None else total))
        total = r["s"] if total is None else total + r["s"]
    offsets = rows.sparkSession.createDataFrame(offsets, f"__part long, __before {kind.simpleString()}")
    within = F.coalesce(F.sum("__v").over(W.partitionBy("__part").orderBy("__id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__part", part).withColumn("__within", within).join(F.broadcast(offsets), "__part").select(*rows.columns, (F.col("__before") + F.col("__within")).cast("double").alias("before"))


def exact_median(df: DataFrame, value: Column) -> float | None:
    """The median; the mean of the two middle values of an even number, null for no values.

    Approximate percentiles bracket it, rows outside the bracket are counted and left behind, and so on until few are left
    or all are equal. df is read a few times, so it should be cheap or written.
    """
    rows = df.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    n = rows.count()
    if not n:
        return None
    first, last = (n - 1) // 2, n // 2
    while n > SORTED:
        around = [F.lit(max(first / n - 0.01, 0.0)), F.lit(min(last / n + 0.01, 1.0))]
        low, high = rows.agg(F.percentile_approx("v", F.array(*around), F.lit(1000)).alias("q")).first()["q"]
        below, within = rows.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if low == high and below <= first and last < below + within:
            return low
        if not (below <= first and last < below + within < n + below) or within == n:
            # Few distinct values fill the bracket: they are counted, which shrinks them before any shuffle.
            counts = written(rows.groupBy("v").agg(F.count("*").alias("n")), "values")
            upto = written(prefix_sums(counts, F.col("n"), F.col("v")), "upto")
            middle = upto.where((F.col("before") <= last) & (F.col("before") + F.col("n") > first)).agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
            removed(counts, upto)
            return (middle["a"] + middle["b"]) / 2
        rows, n, first, last = rows.where(F.col("v").between(low, high)), within, first - below, last - below
    found = [r["v"] for r in rows.orderBy("v").offset(first).limit(last - first + 1).collect()]
    return sum(found) / len(found)
