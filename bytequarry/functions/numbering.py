"""Dense numbers for new rows, without an order over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1_024


def largest(df: DataFrame, column: str = "id") -> int:
    """The largest id, 0 if there is none or it is negative."""
    return max(0, df.agg(F.max(column)).head()[0] or 0)


def numbered(df: DataFrame, keys: list[str], start: int = 0, name: str = "id", buckets: int = BUCKETS) -> DataFrame:
    """df with the numbers start + 1, start + 2, ... in `name`. `keys` must tell the rows apart. Rows are dealt into buckets by
    the hash of the keys and numbered in each; what lies before a bucket is a sum of the others' counts (BUCKETS rows)."""
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    counts = sorted(tuple(r) for r in dealt.groupBy("_bucket").count().collect())  # at most BUCKETS rows
    before, rows = start, []
    for b, n in counts:
        rows.append((b, before))
        before += n
    offsets = df.sparkSession.createDataFrame(rows, "_bucket long, _before long")
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return dealt.join(F.broadcast(offsets), "_bucket").withColumn(name, (F.col("_before") + place).cast("long")).drop("_bucket", "_before")
