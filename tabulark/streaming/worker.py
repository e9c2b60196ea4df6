"""A polling worker as a stream: every micro-batch claims queued tasks under its batch number, works on them and keeps the results.

A batch may run again after a failure anywhere, so each of its steps is repeatable. Arrivals, claims and results are tables
in folders named by the batch; a step whose folder is complete is read instead of done again, an incomplete one is replaced. Claims
of one number are thus the same ones whenever it runs, tasks claimed by earlier numbers are never claimed again, and every
task has one result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

DONE = "_SUCCESS"


class Worker:
    """`work` maps claimed tasks (key and others) to results with their key. `most` is the worker's capacity for one batch: the tasks
    of highest `order` are claimed then, and the others wait; without it all are."""

    def __init__(self, spark: SparkSession, folder: str, tasks: T.StructType, work: Callable[[DataFrame], DataFrame], most: int | None = None, order: tuple = ("since", "key")):
        self.spark, self.folder, self.tasks, self.work, self.most, self.order = spark, folder, tasks, work, most, order

    def _complete(self, step: str, number: int) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{step}/batch={number}/{DONE}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _step(self, step: str, number: int, rows: Callable[[], DataFrame]) -> None:
        if not self._complete(step, number):
            rows().write.mode("overwrite").parquet(f"{self.folder}/{step}/batch={number}")

    def _table(self, step: str, schema: T.StructType, before: int | None = None) -> DataFrame:
        """The rows of all complete batches, with `batch`; only of those before a number if one is given."""
        full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        last = before if before is not None else 1 << 62
        numbers = [n for n in self._numbers(step) if n < last and self._complete(step, n)]
        if not numbers:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", f"{self.folder}/{step}").parquet(*[f"{self.folder}/{step}/batch={n}" for n in numbers])

    def _numbers(self, step: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{step}")
        system = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in system.listStatus(root)] if system.exists(root) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def poll(self, arrivals: DataFrame, number: int) -> None:
        """One batch: new tasks are queued, some are claimed, worked on, and their results kept."""
        self._step("arrived", number, lambda: arrivals.select(*self.tasks.names).dropDuplicates(["key"]))
        self._step("claims", number, lambda: self._claimable(number))
        claimed = self.spark.read.schema(self.tasks).parquet(f"{self.folder}/claims/batch={number}")
        self._step("results", number, lambda: self.work(claimed))

    def _claimable(self, number: int) -> DataFrame:
        queued = self._table("arrived", self.tasks, number + 1).drop("batch").dropDuplicates(["key"])
        free = queued.join(self._table("claims", self.tasks, number).select("key"), "key", "left_anti").select(*self.tasks.names)
        return free.orderBy(*self.order).limit(self.most) if self.most else free

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        """Poll with every micro-batch of a stream of tasks; by default until all that is there has been taken."""
        query = stream.writeStream.foreachBatch(self.poll).option("checkpointLocation", f"{self.folder}/checkpoint")
        return query.trigger(**(trigger or {"availableNow": True})).start()

    def claims(self) -> DataFrame:
        return self._table("claims", self.tasks)

    def results(self, schema: T.StructType) -> DataFrame:
        return self._table("results", schema)
