"""Jobs as state: a response is given when the last page of its job is there, once.

Scored pages and refusals arrive in any order and any number of batches. The state of a job holds how many pages it has
and those seen so far. A page or request that comes again is dropped, also after the response. A job that is not
complete in time is given up; time is that of the batches the rows came in (the watermark), so a repeated batch does the
same again. Nothing about a job lives on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.requests import ANSWERS

EVENTS = "job_id string, n_pages int, pos int, visit_id string, predicted_label string, prediction double, decision boolean, reason string"
RESPONSES = "job_id string, status string, part int, last boolean, response string"
# Pages in one row of a response; a larger job has several parts.
PART_PAGES = 10_000
# An incomplete job is given up, and an answered one forgotten, after a day.
EXPIRE_MS = 24 * 3600 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN, DONE, REFUSED, EXPIRED = "open", "done", "refused", "expired"


def job_events(scored: DataFrame | None, refused: DataFrame | None = None) -> DataFrame:
    """Scored pages (job_id, n_pages, pos, visit_id, answers) and refusals (job_id, reason) as one kind of row."""
    fields = dict(f.split(" ") for f in EVENTS.split(", "))

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in fields.items()])

    parts = [shaped(df).filter(F.col("job_id").isNotNull()) for df in (scored, refused) if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class Jobs(StatefulProcessor):
    """Pages of one job until all are there."""

    def __init__(self, expire_ms: int = EXPIRE_MS, part_pages: int = PART_PAGES):
        self.expire_ms, self.part_pages = expire_ms, part_pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, n_pages int, seen int")
        self.pages = handle.getMapState("pages", "pos int", "visit_id string, predicted_label string, prediction double, decision boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.job.exists():
            status, n_pages, seen = self.job.get()
        else:
            status, n_pages, seen = OPEN, None, 0
        known = status != OPEN or n_pages is not None
        stored = seen > 0  # a job that is complete at once never writes its pages
        fresh: dict[int, tuple] = {}
        reason = None
        for row in rows:
            if not known:
                self.handle.registerTimer(int(row.received.timestamp() * 1000) + self.expire_ms)
                known = True
            if status != OPEN:
                continue
            if row.reason is not None:
                status, reason = REFUSED, row.reason
                continue
            n_pages = row.n_pages if n_pages is None else n_pages
            if row.pos in fresh or row.pos >= n_pages or (stored and self.pages.containsKey((row.pos,))):
                continue
            fresh[row.pos] = (row.visit_id, *[row[c] for c in ANSWERS])
            seen += 1
            if len(fresh) >= self.part_pages:
                self._store(fresh)
                stored = True
        if status == REFUSED and reason is not None:
            self.pages.clear()
            yield Row(job_id=key[0], status=REFUSED, part=0, last=True, response=json.dumps({"error": reason}))
        elif status == OPEN and n_pages is not None and seen >= n_pages:
            status = DONE
            yield from self._response(key[0], n_pages, fresh)
            self.pages.clear()
        elif status == OPEN and fresh:
            self._store(fresh)
        self.job.update((status, n_pages, seen))

    def _store(self, fresh: dict[int, tuple]) -> None:
        for pos, page in fresh.items():
            self.pages.updateValue((pos,), page)
        fresh.clear()

    def _response(self, job_id: str, n_pages: int, fresh: dict[int, tuple]) -> Iterator[Row]:
        parts = max(1, -(-n_pages // self.part_pages))
        for part in range(parts):
            places = range(part * self.part_pages, min(n_pages, (part + 1) * self.part_pages))
            pages = [fresh.get(p) or self.pages.getValue((p,)) for p in places]
            body = {"visit_id": [p[0] for p in pages]}
            for i, shown in enumerate(ANSWERS.values(), 1):
                if any(p[i] is not None for p in pages):
                    body[shown] = [p[i] for p in pages]
            text = json.dumps(body, separators=(",", ":"), ensure_ascii=False)
            yield Row(job_id=job_id, status=DONE, part=part, last=part == parts - 1, response=text)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status = self.job.get()[0] if self.job.exists() else DONE
        self.job.clear()
        self.pages.clear()
        if status == OPEN:
            yield Row(job_id=key[0], status=EXPIRED, part=0, last=True, response=None)

    def close(self) -> None:
        pass


def job_responses(events: DataFrame, expire_ms: int = EXPIRE_MS, part_pages: int = PART_PAGES) -> DataFrame:
    """Responses (job_id, status, part, last, response) of a stream of events."""
    timed = events.withColumn("received", F.current_timestamp()).withWatermark("received", "0 seconds")
    return timed.groupBy("job_id").transformWithState(Jobs(expire_ms, part_pages), RESPONSES, "Append", "EventTime")


def start_responses(
    events: DataFrame, results: str, checkpoint: str, expire_ms: int = EXPIRE_MS, part_pages: int = PART_PAGES, once: bool = True
) -> StreamingQuery:
    """Write every response once to the Parquet folder `results`. The state lies in the checkpoint folder."""
    spark = events.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)  # a query keeps the settings it was started with
    try:
        writer = (
            job_responses(events, expire_ms, part_pages).writeStream.format("parquet").outputMode("append")
            .option("path", results).option("checkpointLocation", checkpoint)
        )
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)


def stored_events(spark: SparkSession, results: str, models: list[str], rejects: str) -> DataFrame:
    """What continuous scoring has written, as a stream of events: the pages of all models, and the refusals."""
    frames = [spark.read.parquet(f"{results}/model={m}").schema for m in models]
    scored = None
    for model, schema in zip(models, frames):
        pages = job_events(spark.readStream.schema(schema).parquet(f"{results}/model={model}"))
        scored = pages if scored is None else scored.unionByName(pages)
    refused = spark.readStream.schema(spark.read.parquet(rejects).schema).parquet(rejects)
    return scored.unionByName(job_events(None, refused))
