"""Tables that cut lineage, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read back; a local folder only where that is unset in local mode."""
    spark = df.sparkSession
    at, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "local")
    if not at and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{(at or 'file:///tmp/checkpoints/tessella').rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
