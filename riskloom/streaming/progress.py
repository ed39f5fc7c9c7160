"""What a running query tells about itself, and a bound on the messages it takes."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from riskloom.streaming.velocity import ARRIVED


def arrived(progress) -> int:
    """Rows of a micro-batch: as the query observes them, or else as its sources count them."""
    observed = progress["observedMetrics"] if isinstance(progress, dict) else progress.observedMetrics
    row = (observed or {}).get(ARRIVED)
    if row is not None:
        return row["rows"]
    n = progress["numInputRows"] if isinstance(progress, dict) else progress.numInputRows
    return max(0, n)


class ProgressLog(StreamingQueryListener):
    """Prints the rows so far whenever another `every` of them have gone by."""

    def __init__(self, every: int = 1000, tell=print):
        self.every, self.tell = every, tell
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event):
        progress = event.progress
        before = self.rows.get(str(progress.id), 0)
        after = before + arrived(progress)
        self.rows[str(progress.id)] = after
        if after // self.every > before // self.every:
            self.tell(f"{after} messages, {progress.processedRowsPerSecond:.0f} a second")

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.tell(f"{self.rows.pop(str(event.id), 0)} messages in all")


def report_progress(spark: SparkSession, every: int = 1000, tell=print) -> ProgressLog:
    log = ProgressLog(every, tell)
    spark.streams.addListener(log)
    return log


def stop_after(query, max_messages: int, poll_s: float = 1.0) -> int:
    """Stop a query once its finished batches hold `max_messages`; the number they do hold.

    Batches are finished whole, so it may be up to a batch more.
    """
    while not query.awaitTermination(poll_s):
        if sum(map(arrived, query.recentProgress)) >= max_messages:
            query.stop()
    return sum(map(arrived, query.recentProgress))
