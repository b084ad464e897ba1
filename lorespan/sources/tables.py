"""The given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType, TimestampNTZType, TimestampType

# Tables whose rows are worth seconds of work per megabyte.
HEAVY = ("documents", "pages")
# Session setting: partitions that heavy tables are dealt to after the scan. Unset, they stay as they were read.
READ_PARTITIONS = "spark.lorespan.readPartitions"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table below ``root``.

    Event times are read as UTC timestamps by schema instead of by cast: they can then carry a watermark, and filters
    on them still reach the Parquet scan.
    """
    path = f"{root.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path)
    dealt = spark.conf.get(READ_PARTITIONS, None)
    if name in HEAVY and dealt:
        return df.repartition(int(dealt))
    if name != "events":
        return df
    fields = [
        StructField(f.name, TimestampType() if isinstance(f.dataType, TimestampNTZType) else f.dataType, f.nullable)
        for f in df.schema.fields
    ]
    return spark.read.schema(StructType(fields)).parquet(path)
