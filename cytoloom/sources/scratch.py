"""Tables between the steps of an iteration, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Written tables cut the lineage of iterations, so that a lost executor costs the step it was in and no more. They lie in a folder of
    their own under spark.checkpoint.dir; a session in one process without that setting uses a temporary folder, on a cluster it is an
    error. What a lazy result reads is kept for the shared folder's owner to clear; drop() deletes the rest."""

    def __init__(self, spark: SparkSession):
        top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not top:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="scratch-")
        self.spark, self.folder, self.made = spark, f"{top}/scratch-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """df, written and read again."""
        self.made += 1
        path = f"{self.folder}/{'keep' if keep else 'step'}/{self.made}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def sweep(self) -> None:
        """Has the driver collect its garbage: only then does Spark delete the files of shuffles whose tables have been written."""
        self.spark._jvm.System.gc()

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/step")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
