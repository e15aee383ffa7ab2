"""A total order over whole tables without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.session import checkpoint


def global_rank(rows: DataFrame, order: list[Column], name: str = "place", partitions: int | None = None) -> DataFrame:
    """Adds the 1-based place of each row in the given order.

    Rows are range-partitioned by the order (a sampled total order, as in a global sort), numbered
    within their partition, and shifted by the sizes of the partitions before, of which there are
    only as many as partitions. Ties get places in any order unless the order breaks them.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_part", "_shift")
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    # one row a partition: a proven bound for the broadcast
    return ranged.withColumn("_within", within).join(F.broadcast(shift), "_part").withColumn(name, F.col("_within") + F.col("_shift")).drop("_part", "_within", "_shift")
