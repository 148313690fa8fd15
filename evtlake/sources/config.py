"""Configuration (interface files, contracts, rules) as tables whose size Spark knows.

A table made from Python rows has no known size, so Spark may broadcast the events instead of it, or shuffle them by its
few keys. Tables held here are local relations, joined by broadcast because they are known to be small.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows up to which `sized` holds and broadcasts a table.
BROADCAST_ROWS = 50_000


def config_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Python rows as a local relation."""
    fields = StructType.fromDDL(schema)
    wanted = to_arrow_schema(fields)
    columns = list(zip(*rows)) or [()] * len(wanted)
    items = [[list(v.items()) if isinstance(v, dict) else v for v in column] for column in columns]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(items, wanted)], schema=wanted), fields)


def held(df: DataFrame) -> DataFrame:
    """df, computed once and held by the driver; for tables whose size is that of the configuration."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def sized(df: DataFrame) -> DataFrame:
    """df, held and broadcast if it has at most BROADCAST_ROWS rows; else as it is, for a join by shuffle."""
    first = df.limit(BROADCAST_ROWS + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(first, df.schema)) if first.num_rows <= BROADCAST_ROWS else df
