"""What the operators need of a session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    """``spark.checkpoint.dir`` as the cluster sets it; where it is unset, a temporary folder for a
    local master and a folder beside the warehouse for a cluster."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().isDefined():
        return
    local = sc.master == "local" or sc.master.startswith("local[")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="thicket-ck-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, its lineage cut by a reliable checkpoint."""
    ensure_checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def small_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A local table of a few rows: the optimiser sees its values, and no Python task makes them."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    table = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema=schema)
