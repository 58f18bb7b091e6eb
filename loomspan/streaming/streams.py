"""Structured Streaming forms of rate limits, logs, resumable crawls and conversation memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.operators.logs import over_limit
from loomspan.sources.snapshots import Snapshots


def rate_limited(requests: DataFrame, most: int, window: str = "1 minute", late: str = "2 minutes", key: str = "user_id", at: str = "ts") -> DataFrame:
    """Requests per key and fixed window with a flag over the limit; late rows are waited for."""
    timed = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return over_limit(timed, most, window, key, at)


def new_contents(files: DataFrame, late: str = "1 day", digest: str = "sha256", at: str = "ts") -> DataFrame:
    """Files whose content has not been seen within the watermark."""
    return files.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([digest])


def apply_updates(path: str, key: str = "id", order: str = "seq") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that keeps the latest row per key as files of a folder per batch.

    A batch that is run again after a failure replaces its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
        latest.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(updates: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row per key over all batches that ``apply_updates`` wrote."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*updates.columns), order).alias("_r")).select("_r.*")


def converted_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """A stream of a growing folder's files with their digests: name, sha256, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("sha256"), "content")


def convert_new(path: str, convert: Callable[[DataFrame], DataFrame], force: bool = False) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that converts each content once and keeps a manifest of what it has converted.

    ``convert`` takes rows of name, sha256 and content and returns rows with name and sha256 that have a null in ``error`` where they
    were converted; its result goes to ``path/output``. The manifest (``path/manifest``: name, sha256, error) holds what a
    batch has tried; a content with an error is tried again when its file comes again. Both have a folder per batch, the manifest's written last.
    A batch that is run again after a failure replaces both, and doesn't take its own earlier try as done.
    With ``force`` all files of a batch are converted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        manifest = Snapshots(spark, f"{path}/manifest")
        done = manifest.read("files", "name string, sha256 string, error string, batch long").filter(F.col("error").isNull() & (F.col("batch") != number))
        first = batch.groupBy("sha256").agg(F.min_by(F.struct("name", "content"), "name").alias("_f")).select("_f.name", "sha256", "_f.content")
        new = first if force else first.join(done.select("sha256").distinct(), "sha256", "left_anti")
        made = convert(new)
        made.write.mode("overwrite").parquet(f"{path}/output/batch={number}")
        tried = spark.read.schema(made.schema).parquet(f"{path}/output/batch={number}").select("name", "sha256", "error", F.lit(number).cast("long").alias("batch"))
        if manifest.read("files", tried.schema).filter(F.col("batch") == number).isEmpty():
            manifest.write(more=True, files=tried)

    return write


def convert_folder(spark: SparkSession, folder: str, path: str, convert: Callable[[DataFrame], DataFrame], glob: str = "*.pdf", force: bool = False) -> None:
    """Convert what is new in a folder and end; called again, it takes up what has come since, or what a killed run has left."""
    files = converted_files(spark, folder, glob)
    query = files.writeStream.foreachBatch(convert_new(path, convert, force)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def with_memory(turns: DataFrame, most: int = 6, dropped: int = 2, timeout_ms: int = 3_600_000) -> DataFrame:
    """Each conversation's memory after its latest turns: beyond ``most`` turns the oldest ``dropped`` go."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        for batch in batches:
            for text in batch.sort_values("turn")["text"]:
                held.append(text)
                if len(held) > most:
                    held = held[dropped:]
        state.update((held,))
        state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "memory": [held]})

    return turns.groupBy("conv_id").applyInPandasWithState(
        update, "conv_id long, memory array<string>", "memory array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout
    )
