"""Codebook metrics of batches that arrive over days: counts are stored per batch, and reduced once.

The state is a folder with the counts of distinct tuples of each batch, which is all that the
metrics need. Adding a batch reads only that batch; reducing reads counts, never old codes. A batch
that is added again replaces what it held, so a replay changes nothing. An attempt counts only
once its success marker is written; one that died half-way is ignored.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.codes import quality, tuple_counts, with_all
from tesserae.workspace import store


class CodeCounts:
    """Mergeable usage and tuple counts in one or several folders; batches are added to the first.

    A batch that lies in several folders counts once, with its newest attempt, so the states of
    parallel runs may overlap. All batches must be added with the same ``size`` and ``keys``.
    """

    def __init__(self, spark: SparkSession, *folders: str, size: int, keys: tuple[str, ...] = ("category",)):
        self.spark, self.folders, self.size, self.keys = spark, folders, size, keys

    def add(self, codes: DataFrame, batch: str) -> None:
        """Stores the counts of a batch, in place of what was stored under its name."""
        attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        path = f"{self.folders[0]}/batch={quote(str(batch), safe='')}/attempt={attempt}"
        tuple_counts(codes, self.size, self.keys).write.parquet(path)

    def attempts(self) -> dict[str, str]:
        """The folder of the newest complete attempt of each batch. The driver lists one marker per attempt."""
        found: dict[str, str] = {}
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for folder in self.folders:
            pattern = hadoop(f"{folder}/batch=*/attempt=*/_SUCCESS")
            markers = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
            for marker in markers or []:
                attempt = marker.getPath().getParent()
                batch = attempt.getParent().getName()
                if batch not in found or hadoop(found[batch]).getName() < attempt.getName():
                    found[batch] = attempt.toString()
        return found

    def tuples(self) -> DataFrame:
        """``keys, ids, n`` over all batches, as ``codes.tuple_counts`` gives them for all codes at once."""
        paths = sorted(self.attempts().values())
        if not paths:
            raise ValueError("no batch was added")
        rows = self.spark.read.parquet(*paths)
        return rows.groupBy(*self.keys, "ids").agg(F.sum("n").alias("n"))

    def quality(self, code_range: int, totals: bool = True) -> DataFrame:
        """Metrics per group, and over all categories under ``codes.ALL`` if asked."""
        tuples = store(self.tuples(), "tuples")
        if totals and self.keys == ("category",):
            tuples = store(with_all(tuples), "tuples")
        return quality(tuples, code_range, self.keys)

    def usage(self) -> DataFrame:
        """``keys, pos, code, n``: how often each code stands at each position; unknown codes are -1."""
        rows = self.tuples().select(*self.keys, F.posexplode("ids").alias("pos", "code"), "n")
        return rows.groupBy(*self.keys, "pos", "code").agg(F.sum("n").alias("n"))

    def trend(self, code_range: int) -> DataFrame:
        """Metrics of each batch on its own, over all its groups, by ``batch``: the whole is never their mean."""
        parts = [
            self.spark.read.parquet(path).select(F.lit(batch.removeprefix("batch=")).alias("batch"), "ids", "n")
            for batch, path in sorted(self.attempts().items())
        ]
        if not parts:
            raise ValueError("no batch was added")
        rows = reduce(DataFrame.unionByName, parts).groupBy("batch", "ids").agg(F.sum("n").alias("n"))
        return quality(store(rows, "batch-tuples"), code_range, ("batch",))
