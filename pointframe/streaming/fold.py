"""Recurrences over sorted rows, and streams that are run over what is there."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointframe.session import shared_folder

FILE_ROWS = 250_000  # of a file of a staged micro-batch, about
SLOTS = 256  # groups of keys that a stream with many small keys keeps its state by
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold_sorted(df: DataFrame, key: str, order: list[str], start: Callable[[Any], Any], step: Callable[[Any, tuple], tuple | None], schema: str | T.StructType) -> DataFrame:
    """For each key, its rows in order go through step(state, row), which changes the state and may give a row of schema.

    start(key) makes the state of a key. Keys are dealt by hash and sorted by the engine; a task reads its rows as a
    stream of batches and carries the state of one key, so a long key takes time but no memory.
    """
    names = df.columns
    at = names.index(key)
    fields = [f.name for f in (schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now, first = None, None, True
        for pdf in batches:
            out = []
            for row in zip(*(pdf[c].tolist() for c in names), strict=True):
                if first or row[at] != now:
                    state, now, first = start(row[at]), row[at], False
                made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield pd.DataFrame(out, columns=fields)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def slot(*keys: str) -> Column:
    """The number of the group of keys that a key's rows are kept in by a stream.

    A call into a processor and each access to its state cost about as much as hundreds of rows, so keys of few rows go in
    groups. A group's waiting rows are read and written whenever it has rows; SLOTS is part of a stream's state.
    """
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS))


def run_available(stream: DataFrame, mode: str = "append", before: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over all that its sources hold now, exactly once, and return the rows it made.

    Rows, offsets and state are kept under a new folder in that of the checkpoints, which all machines share. State
    goes to RocksDB, which keeps timers and lists of state outside of the heap.
    """
    spark = stream.sparkSession
    home = shared_folder(spark, "stream")
    setting = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(setting)
    spark.conf.set(setting, ROCKS)
    try:
        query = stream.writeStream.format("parquet").outputMode(mode).option("path", home + "/rows").option("checkpointLocation", home + "/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, had)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(home + "/rows")


def staged(rows: DataFrame, arrival: str) -> tuple[str, DataFrame]:
    """(folder, stream): rows written as files in the order of arrival, a micro-batch for each value; the column goes.

    Values of arrival are few whole numbers. The rows are made once, by all tasks, and then copied out a value at a time: each
    value as equally many files of about FILE_ROWS, empty ones if it has few rows, since a micro-batch is a number of files.
    """
    spark = rows.sparkSession
    home, made = shared_folder(spark, "source"), shared_folder(spark, "arrivals")
    rows.filter(rows[arrival].isNotNull()).write.partitionBy(arrival).parquet(made)
    kept = rows.drop(arrival)
    read = spark.read.schema(rows.schema).parquet(made)
    sizes = read.groupBy(arrival).agg(F.count("*").alias("n")).orderBy(arrival).collect()  # one row for each micro-batch
    files = min(-(-max((r["n"] for r in sizes), default=0) // FILE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))) or 1
    empty = spark.createDataFrame([], kept.schema)  # written as one file
    for k, r in enumerate(sizes):
        read.filter(read[arrival] == r[arrival]).drop(arrival).coalesce(files).write.mode("append").parquet(home)
        for _ in range(len(spark.read.schema(kept.schema).parquet(home).inputFiles()), files * (k + 1)):
            empty.write.mode("append").parquet(home)
    if not sizes:
        empty.write.parquet(home)
    return home, spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", files).parquet(home)
