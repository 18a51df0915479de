"""Rows of a written table picked by where they stand in it, so that what they hold is never shuffled.

A table gets a number a row before it is written: its partition and its place there. Numbers to pick are written in a folder a
partition; a task that scans the table reads the lists of the partitions that it meets, each no longer than that partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.arrow import filesystem
from cairn.session import scratch

#: monotonically_increasing_id() has the partition above this bit.
SHIFT = 33


def with_rows(df: DataFrame) -> DataFrame:
    """Adds `row`; to be written before it is used."""
    return df.withColumn("row", F.monotonically_increasing_id())


def write(rows: DataFrame, name: str) -> str:
    """Writes numbers (row) down; the folder."""
    path = scratch(rows.sparkSession, name)
    listed = rows.select("row", F.shiftright("row", SHIFT).alias("part"))
    listed.repartition("part").sortWithinPartitions("part", "row").write.partitionBy("part").parquet(path)
    return path


@lru_cache(maxsize=8)
def _listed(folder: str, part: int) -> np.ndarray:
    system, path = filesystem(f"{folder}/part={part}")
    found = [np.zeros(0, np.int64)]
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                found.append(pq.read_table(f, columns=["row"]).column("row").to_numpy())
    return np.sort(np.concatenate(found))


def _among(rows: np.ndarray, folder: str) -> np.ndarray:
    parts, found = rows >> SHIFT, np.zeros(len(rows), bool)
    for part in np.unique(parts).tolist():
        wanted = _listed(folder, part)
        own = np.flatnonzero(parts == part)
        if len(wanted):
            found[own] = wanted[np.minimum(np.searchsorted(wanted, rows[own]), len(wanted) - 1)] == rows[own]
    return found


def pick(table: DataFrame, folder: str, listed: bool = True, then=None, schema: str | None = None) -> DataFrame:
    """The rows of `table` (row, ...) whose numbers are listed in the folder, or else those that aren't.

    `then` turns their batches into batches of `schema`, in the same worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            use = _among(batch.column("row").to_numpy(), folder) == listed
            if use.any():
                yield batch.filter(pa.array(use))

    return table.mapInArrow((lambda batches: then(run(batches))) if then else run, schema or table.schema)
