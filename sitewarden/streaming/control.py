"""Commands for a crawl whose offers come as a stream: start, cancel and resume, one at a time, and what happened lately."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sitewarden.streaming import admission

#: Fixed value: how many events are kept; older ones are counted as dropped.
EVENTS = 32


class Crawl:
    """The crawl whose state is in a folder. Every command that can't be followed raises RuntimeError and says why."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.query: StreamingQuery | None = None

    @property
    def active(self) -> bool:
        return self.query is not None and self.query.isActive

    def _begun(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/checkpoint")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def start(self, offers: DataFrame, trigger: dict | None = None) -> None:
        if self.active:
            raise RuntimeError("a crawl is running")
        if self._begun():
            raise RuntimeError("the folder has a crawl: resume it")
        self.query = admission.follow_offers(offers, self.folder, trigger)

    def resume(self, offers: DataFrame, trigger: dict | None = None) -> None:
        """Go on where the last committed batch ended; a batch that was cut off is run again."""
        if self.active:
            raise RuntimeError("a crawl is running")
        if not self._begun():
            raise RuntimeError("there is no crawl to resume")
        self.query = admission.follow_offers(offers, self.folder, trigger)

    def cancel(self) -> bool:
        """Stop after the batch at hand; False if nothing runs."""
        if not self.active:
            return False
        self.query.stop()
        return True

    def wait(self) -> None:
        if self.query is not None:
            self.query.awaitTermination()

    def events(self) -> tuple[list[tuple[int, int]], int]:
        """(the last batches as (number, rows), how many older ones are left out)."""
        if self.query is None:
            return [], 0
        found = {p.batchId: p.numInputRows for p in self.query.recentProgress}
        last = sorted(found.items())[-EVENTS:]
        return last, (last[0][0] if last else 0)
