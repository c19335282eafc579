"""Streams of notation events: latest-wins upserts of batches, windowed counts under a watermark, and valid prefixes kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, at: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts by time window and kind; rows later than the watermark are not waited for. Runs on streams and tables alike."""
    watermarked = events.withWatermark(at, late)
    counted = watermarked.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    """Sessions of a key: stretches without a pause longer than the gap."""
    found = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n")


def latest_view(history: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """What the appended history says now: per key the row that comes last in the order."""
    rest = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def run_to_end(counted: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What an aggregated stream says once all that is there is taken in: each batch writes the whole result anew under its number, and the last one counts."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = counted.sparkSession.read.option("basePath", path).parquet(path)
    last = found.agg(F.max("batch")).first()[0]
    return found.where(F.col("batch") == F.lit(last)).drop("batch")


def append_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Appends each batch to a folder of its own number, so that a batch that is run again replaces itself; later rows supersede earlier
    ones when latest_view reads the history. Runs until all that is there is taken in."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def valid_prefixes(events: DataFrame, key: str, number: str, valid: str) -> DataFrame:
    """Rows (key, number from 0, valid) in any order; for each key and batch the length of the contiguous valid prefix so far and
    whether it is closed by an invalid row. Rows ahead of a gap wait in the state, the only way a late note can still be put in order."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length, closed, waiting = state.get if state.exists else (0, False, "")
        ahead = {int(n): v == "1" for n, v in (x.split(":") for x in waiting.split(",") if x)}
        for batch in batches:
            ahead |= dict(zip(batch[number].astype(int), batch[valid].astype(bool), strict=True))
        while not closed and length in ahead:
            if ahead.pop(length):
                length += 1
            else:
                closed = True
        ahead = {} if closed else {n: v for n, v in ahead.items() if n > length}
        state.update((length, closed, ",".join(f"{n}:{int(v)}" for n, v in sorted(ahead.items()))))
        yield pd.DataFrame({key: [k[0]], "length": [length], "closed": [closed]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, length long, closed boolean", "length long, closed boolean, waiting string", "update", GroupStateTimeout.NoTimeout
    )
