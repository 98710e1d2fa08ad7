"""Operators whose result depends on the order of time, over streams whose rows come late and out of order."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_timers(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state where timers can be found by time; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class NearRepeats(StatefulProcessor):
    """The greedy dedupe of the batch engine: a row is dropped if a kept row of its key is near it in time and magnitude.

    Rows wait in blocks of time.  When the watermark has passed a block's end, none can come for it any more: its timer fires, and all such blocks
    are walked in order.  The state of a key is the blocks that wait and the rows kept within a gap of the last block walked.
    """

    def __init__(self, key: str, gap_us: int, dmag: float, block_us: int):
        self.key, self.gap, self.dmag, self.block = key, gap_us, dmag, block_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "block long", "id array<long>, t array<long>, m array<double>")
        self.kept = handle.getValueState("kept", "t array<long>, m array<double>")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            frame = frame[frame["id"].notna()]
            for block, some in frame.groupby(frame["t_us"] // self.block):
                end = (int(block) + 1) * self.block
                if end <= passed:
                    continue  # walked already
                old = self.waiting.getValue((int(block),)) or ([], [], [])
                more = [some["id"].astype("int64").tolist(), some["t_us"].astype("int64").tolist(), some["mag"].astype("float64").tolist()]
                if not old[0]:
                    self.handle.registerTimer(end // 1000)
                self.waiting.updateValue((int(block),), tuple(list(a) + b for a, b in zip(old, more)))
        yield pd.DataFrame({self.key: [], "id": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        passed = timerValues.getCurrentWatermarkInMs() * 1000
        kept = list(zip(*self.kept.get())) if self.kept.exists() else []
        out = []
        for block in sorted(b for (b,) in self.waiting.keys()):
            if (block + 1) * self.block > passed:
                break
            ids, times, mags = self.waiting.getValue((block,))
            for t, i, m in sorted(zip(times, ids, mags)):
                kept = [(a, b) for a, b in kept if t - a <= self.gap]
                if all(abs(m - b) > self.dmag for _, b in kept):
                    kept.append((t, m))
                    out.append(i)
            self.waiting.removeKey((block,))
            kept = [(a, b) for a, b in kept if (block + 1) * self.block - a <= self.gap]
        self.kept.update(([int(a) for a, _ in kept], [float(b) for _, b in kept]))
        yield pd.DataFrame({self.key: [key[0]] * len(out), "id": out})

    def close(self) -> None:
        pass


def without_near_repeats(stream: DataFrame, key: str, gap_us: int, dmag: float, late: str = "1 day", at: str = "ts", block_us: int | None = None) -> DataFrame:
    """key and id of the rows (key, id, t_us, mag, ``at``) that the greedy dedupe keeps, whatever the order of the stream within ``late``.  ``t_us``
    are microseconds of ``at`` since 1970.  Rows come out once the watermark has passed their block; later ones are dropped."""
    kind = dict(stream.dtypes)[key]
    timed = stream.withWatermark(at, late)
    processor = NearRepeats(key, gap_us, dmag, block_us or 24 * gap_us)
    return timed.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, id long", "append", "EventTime")


def closing_row(schema, at: str, spark: SparkSession) -> DataFrame:
    """One row with nothing but a time after all others, which lets the watermark pass every row before it."""
    far = F.lit("2200-01-01").cast(schema[at].dataType)
    return spark.range(1).select(*[far.alias(f.name) if f.name == at else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
