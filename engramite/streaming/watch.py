"""Change feeds: a polled directory, ingestion in micro-batches, and the timer of consolidation."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engramite.operators.consolidate import consolidated
from engramite.schema import ConsolidationConfig
from engramite.sources.filesystem import diff, event_nodes, snapshot

POLL_MS = 1000
LOG = logging.getLogger(__name__)


@dataclass
class WatchStats:
    cycles: int = 0
    added: int = 0
    modified: int = 0
    removed: int = 0
    failed: int = 0


class Watch:
    """Snapshots a directory again and again and hands the changes to ``ingest``.

    ``ingest`` gets a DataFrame of events; if it raises, the cycle counts as failed and the earlier
    snapshot stays, so the same changes come again; with ``on_error`` "log" the error is logged, with "ignore" it isn't.
    ``on_cycle`` gets the statistics; what it raises is logged.  With ``ingest_on_start`` the first snapshot's files come as additions, outside the counts.
    """

    def __init__(self, spark: SparkSession, root: str, ingest: Callable[[DataFrame], None], poll_ms: int = POLL_MS, ingest_on_start: bool = False, on_cycle: Callable[[dict], None] | None = None, on_error: str = "log", **options) -> None:
        self.spark, self.root, self.ingest, self.on_cycle, self.options = spark, root, ingest, on_cycle, options
        self.poll_ms = poll_ms if isinstance(poll_ms, int) and poll_ms > 0 else POLL_MS
        self.quiet = on_error == "ignore"
        self.stats, self._stop, self._thread = WatchStats(), threading.Event(), None
        self.held = self._facts(snapshot(spark, root, **options))
        if ingest_on_start:
            ingest(snapshot(spark, root, **options).withColumn("type", F.lit("added")))

    def _facts(self, shot: DataFrame) -> DataFrame:
        """Small columns of a snapshot, as of now."""
        rows = shot.select("path", "relative_path", "size", "mtime_us", "sig").collect()
        return self.spark.createDataFrame(rows, "path string, relative_path string, size long, mtime_us long, sig string")

    def cycle(self) -> dict[str, int]:
        self.stats.cycles += 1
        try:
            shot = snapshot(self.spark, self.root, **self.options)
            now = self._facts(shot)
            changes = diff(self.held, now, ("size", "mtime_us", "sig"))
            counts = {r["type"]: r["count"] for r in changes.groupBy("type").count().collect()}
            if counts:
                there = shot.select("path", "relative_path", "size", "mtime_us", "content")
                gone = self.held.select("path", F.col("relative_path").alias("__was"))
                events = changes.join(there, "path", "left").join(gone, "path", "left").withColumn("relative_path", F.coalesce("relative_path", "__was")).drop("__was")
                self.ingest(events)
            self.held = now
            for kind, n in counts.items():
                setattr(self.stats, kind, getattr(self.stats, kind) + n)
        except Exception:
            self.stats.failed += 1
            if not self.quiet:
                LOG.exception("a cycle of the watch over %s failed", self.root)
        if self.on_cycle:
            try:
                self.on_cycle(asdict(self.stats))
            except Exception:  # a listener can't stop the watch
                LOG.exception("the listener of the watch over %s failed", self.root)
        return asdict(self.stats)

    def start(self) -> Watch:
        def loop() -> None:
            while not self._stop.wait(self.poll_ms / 1000):
                self.cycle()

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> dict[str, int]:
        self._stop.set()
        if self._thread:
            self._thread.join()
        return asdict(self.stats)


def ingest_stream(events: DataFrame, append: Callable[[DataFrame], object], checkpoint: str, processing_ms: int | None = None) -> StreamingQuery:
    """Streamed events as nodes, a micro-batch at a time; ``append`` is a table's own, so a batch that came before is replaced by key."""
    def each(batch: DataFrame, _: int) -> None:
        append(event_nodes(batch).drop("read_state"))

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if processing_ms is None else {"processingTime": f"{processing_ms} milliseconds"}
    return writer.trigger(**trigger).start()


def consolidation_timer(nodes: Callable[[], DataFrame], replace: Callable[[DataFrame], object], config: ConsolidationConfig = ConsolidationConfig(), cycles: int | None = None) -> int:  # noqa: B008
    """A cycle every ``interval_ms``, for ever or so many times; gives the number of cycles."""
    done = 0
    while cycles is None or done < cycles:
        if done:
            time.sleep(config.interval_ms / 1000)
        replace(consolidated(nodes(), config))
        done += 1
    return done
