"""A growing table of finished work: each commit is there in full or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import discard


class Ledger:
    """A folder of commits, in whatever store it lies.

    A commit is a folder of JSON lines that Spark's committer marks as whole when
    its job ends.  Readers take marked folders only, so what a killed job left
    behind is never seen; ``clear_unfinished`` removes it.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folders(self, pattern: str) -> list[str]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
        return sorted(status.getPath().toString() for status in found or [])

    def commits(self) -> list[str]:
        """Folders of the finished commits."""
        return [marker.rsplit("/", 1)[0] for marker in self._folders("commit-*/_SUCCESS")]

    def clear_unfinished(self) -> None:
        for folder in set(self._folders("commit-*")) - set(self.commits()):
            discard(self.spark, folder)

    def append(self, df: DataFrame) -> None:
        df.write.json(f"{self.path}/commit-{uuid.uuid4().hex}")

    def read(self) -> DataFrame:
        folders = self.commits()
        if not folders:
            # Known to be empty when it is planned: joins with it cost no job.
            row = F.from_json(F.lit(None).cast("string"), self.schema).alias("row")
            return self.spark.range(1).where(F.lit(False)).select(row).select("row.*")
        return self.spark.read.schema(self.schema).json(folders)
