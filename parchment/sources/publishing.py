"""Publishing in chunks, all or nothing: chunks are staged under a run, and one small write makes the run visible."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Published:
    """A table at ``path`` whose readers see the newest committed run and never a part of one.

    ``runs/run=R/chunk=K`` holds the staged rows, each written whole by Spark's committer; ``commits`` has a row a run, written
    when every chunk is staged.  A chunk that fails leaves what was visible before, and staging it again replaces it alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, run: str, chunk: int | None = None) -> str:
        return f"{self.path}/runs/run={run}" + ("" if chunk is None else f"/chunk={chunk}")

    def _commits(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def stage(self, run: str, chunk: int, rows: DataFrame) -> None:
        """Writes a chunk of a run; a chunk that was staged before, whole or in part, is replaced."""
        rows.write.mode("overwrite").parquet(self._place(run, chunk))

    def staged(self, run: str, chunks: Iterable[int]) -> list[int]:
        """Those of the chunks that are staged whole."""
        context = self.spark.sparkContext
        hadoop = context._jvm.org.apache.hadoop.fs
        held = []
        for k in chunks:
            done = hadoop.Path(f"{self._place(run, k)}/_SUCCESS")
            if done.getFileSystem(context._jsc.hadoopConfiguration()).exists(done):
                held.append(k)
        return held

    def commit(self, run: str, chunks: Iterable[int]) -> None:
        """Makes a run visible; refuses while one of its chunks isn't staged.  Committing a run again changes nothing."""
        wanted = list(chunks)
        lacking = sorted(set(wanted) - set(self.staged(run, wanted)))
        if lacking:
            raise ValueError(f"chunks {lacking} of run {run} aren't staged")
        commits = self._commits()
        last = commits.agg(F.max("place")).first()[0] if commits is not None else 0
        if commits is None or commits.where(F.col("run") == run).isEmpty():
            self.spark.createDataFrame([(run, last + 1, wanted)], "run string, place long, chunks array<int>").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def publish(self, run: str, chunks: dict[int, DataFrame]) -> None:
        """Stages the chunks that aren't staged yet, then commits; after a failure the same call goes on where it stopped."""
        held = set(self.staged(run, chunks))
        for k, rows in chunks.items():
            if k not in held:
                self.stage(run, k, rows)
        self.commit(run, chunks)

    def read(self) -> DataFrame | None:
        """The rows of the newest committed run, without anything that was only staged; None before the first commit."""
        commits = self._commits()
        if commits is None:
            return None
        run, _, chunks = commits.orderBy(F.desc("place")).first()
        return self.spark.read.option("basePath", self._place(run)).parquet(*[self._place(run, k) for k in chunks])
