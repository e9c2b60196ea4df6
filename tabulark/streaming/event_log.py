"""An append-only event log without doubles: events may be delivered several times and out of order.

Event ids are kept in state until the watermark has passed their event by `delay`, and only first deliveries reach the sink,
Spark's own file sink, whose log of committed files makes a batch that runs again invisible to readers. A delivery that comes
later than the watermark is dropped, whether it is a double or not, and counted.
"""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Sums, for each query by its id (which restarts keep), the rows that its operators dropped for being late."""

    def __init__(self):
        self.dropped, self.ended, self.changed = Counter(), set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self.changed:
            self.dropped[str(event.progress.id)] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def of(self, query: StreamingQuery, seconds: float = 30) -> int:
        """Late rows of an ended query: events reach a listener after they happen, the end after all progress."""
        with self.changed:
            self.changed.wait_for(lambda: str(query.runId) in self.ended, seconds)
            return self.dropped[str(query.id)]


def once(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first delivery of each event of a stream with a `ts`."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def append_once(events: DataFrame, folder: str, keys: list[str] = ["event_id"], delay: str = "1 day", **trigger) -> StreamingQuery:  # noqa: B006
    """Start the stream that appends to the log in `folder`, by day; by default it takes what is there and ends."""
    rows = once(events, keys, delay).withColumn("day", F.to_date("ts"))
    writer = rows.writeStream.format("parquet").option("path", f"{folder}/log").option("checkpointLocation", f"{folder}/checkpoint").partitionBy("day").outputMode("append")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_log(spark, folder: str, schema) -> DataFrame:
    """The log; batches that have not been committed are not seen."""
    return spark.read.schema(schema).parquet(f"{folder}/log")
