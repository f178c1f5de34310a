"""Tables of a run in the shared folder, for iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Writes a table and reads it back: cuts the lineage in a way that outlives a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self._n = spark, 0
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
            base = tempfile.mkdtemp(prefix="tidewell-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(where)
        fs.deleteOnExit(where)

    def table(self, df: DataFrame) -> DataFrame:
        self._n += 1
        df.write.mode("overwrite").parquet(f"{self.path}/{self._n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self._n}")
