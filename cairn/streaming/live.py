"""Streams: incremental commits and files, and rate limits whose windows begin with a first call."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from cairn.functions.arrow import filesystem
from cairn.operators.chunks import chunk
from cairn.operators.ranking import numbered
from cairn.operators.upsert import diff, replace_sources
from cairn.session import materialise


def read_files(spark: SparkSession, folder: str, schema: str, per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def upsert_stream(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every new batch to `apply` once, with its number, and ends when all there is has been read."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Buckets of a table of chunks, fixed when it is begun; about one for each GB is a good number.
BUCKETS = 64
INDEX = "source string, chunk_index int, text string, line_start int, line_end int, id string"


def _versions(path: str) -> list[tuple[int, str]]:
    """Numbers and files of a table's versions, in order."""
    system, root = filesystem(f"{path}/versions")
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted((int(f.base_name.removesuffix(".parquet")), f.path) for f in found if f.base_name.endswith(".parquet"))


def _version(path: str, before: int | None = None, number: int | None = None) -> tuple[dict[int, int], int]:
    """The batch that wrote each bucket, and how many buckets the table has, in the last version (before a batch) or that of a number."""
    files = [f for n, f in _versions(path) if (before is None or n < before) and number in (None, n)]
    if not files:
        if number is not None:
            raise ValueError(f"version {number} of {path} has expired")
        return {}, 0
    system, _ = filesystem(path)
    with system.open_input_file(files[-1]) as f:
        rows = pq.read_table(f)
    return dict(zip(rows["bucket"].to_pylist(), rows["batch"].to_pylist())), int(rows.schema.metadata[b"buckets"])


def read_index(spark: SparkSession, path: str, buckets: list[int] | None = None, before: int | None = None, version: int | None = None) -> DataFrame:
    """The last version of a table that `refresh_buckets` keeps, or a leased one, or some of its buckets; empty if there is none."""
    own = [f"{path}/data/batch={b}/bucket={k}" for k, b in sorted(_version(path, before, version)[0].items()) if buckets is None or k in buckets]
    return spark.read.schema(INDEX).parquet(*own) if own else spark.createDataFrame([], INDEX)


#: Versions that stay though nobody has leased them: the last one, and that before it, on which a repeated batch builds.
KEEP = 2


def _leases(path: str) -> list[tuple[int, float, str]]:
    """(version, end in seconds, file) of all leases."""
    system, root = filesystem(f"{path}/leases")
    names = [(f.base_name.split("-"), f.path) for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name[:1] != "."]
    return [(int(number), float(end), file) for (number, end, _), file in names]


@contextmanager
def leased(path: str, seconds: float = 3600) -> Iterator[int | None]:
    """The number of the last version, for `read_index`, which stays whole for so long or until the block ends; None if there is no version.

    The lease is written first and the version looked for again afterwards, so that one that expires meanwhile isn't given out.
    """
    system, root = filesystem(f"{path}/leases")
    system.create_dir(root, recursive=True)
    while found := _versions(path):
        number = found[-1][0]
        file = f"{root}/{number:012}-{time.time() + seconds:.0f}-{uuid.uuid4().hex}"
        with system.open_output_stream(file):
            pass
        if any(n == number for n, _ in _versions(path)):
            try:
                yield number
            finally:
                if system.get_file_info(file).type == fs.FileType.File:
                    system.delete_file(file)
            return
        system.delete_file(file)
    yield None


def expire(path: str, keep: int = KEEP) -> None:
    """Removes versions that are neither among the last `keep` nor leased, then the buckets that no version left names.

    To be called by the table's one writer. Buckets of batches after the last version aren't touched.
    """
    system, root = filesystem(path)
    now, versions = time.time(), _versions(path)
    for _, end, file in _leases(path):
        if end < now:
            system.delete_file(file)
    # the last versions are named first: leases are read after that, and a later one is of one of these
    held = {n for n, _ in versions[-max(keep, 1) :]} | {n for n, _, _ in _leases(path)}
    for n, file in versions:
        if n not in held:
            system.delete_file(file)
    left = [n for n, _ in versions if n in held]
    named = {(b, k) for n in left for k, b in _version(path, number=n)[0].items()}
    folders = lambda at, prefix: [(int(f.base_name.removeprefix(prefix)), f.path) for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith(prefix)]
    for batch, folder in folders(f"{root}/data", "batch="):
        if not left or batch > left[-1]:
            continue
        own = folders(folder, "bucket=")
        gone = [p for k, p in own if (batch, k) not in named]
        for p in [folder] if len(gone) == len(own) else gone:
            system.delete_dir(p)


def refresh_buckets(path: str, fresh: DataFrame, sources: DataFrame, batch: int = 0, buckets: int = BUCKETS) -> None:
    """Replaces the chunks of `sources` in a table laid out by bucket of the source.

    Only buckets that hold such a source are read, and written anew beside the old ones. A small file then names the batch that each bucket
    is read from; buckets without a row are in no version. `expire` removes superseded ones. Readers see a batch whole or not at all, and a batch that is repeated gives the same table.
    """
    spark = fresh.sparkSession
    last, held = _version(path, batch)
    buckets = held or buckets
    put = F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int")
    touched = sources.agg(F.collect_set(put).alias("b")).first().b  # `buckets` numbers at most
    kept = replace_sources(read_index(spark, path, touched, batch), fresh.select(*[c.split()[0] for c in INDEX.split(", ")]), sources)
    # small buckets get a file each, large ones are split
    kept.withColumn("bucket", put).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={batch}")
    system, root = filesystem(f"{path}/data/batch={batch}")
    written = [int(f.base_name.removeprefix("bucket=")) for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("bucket=")]
    now = {k: b for k, b in last.items() if k not in touched} | {k: batch for k in written}
    rows = pa.table({"bucket": pa.array(list(now), pa.int32()), "batch": pa.array(list(now.values()), pa.int64())}).replace_schema_metadata({"buckets": str(buckets)})
    system, root = filesystem(f"{path}/versions")
    system.create_dir(root, recursive=True)
    pq.write_table(rows, f"{root}/.{batch:012}", filesystem=system)
    system.move(f"{root}/.{batch:012}", f"{root}/{batch:012}.parquet")


def index_stream(files: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the chunks of a stream of files (path, content) in a table; a file that comes again replaces its chunks, an empty one has none.

    Versions expire as new ones come: who reads one for longer than a batch takes should lease it.
    """

    def apply(batch: DataFrame, number: int) -> None:
        # of a file that comes twice in a batch one content counts
        own = batch.groupBy("path").agg(F.max("content").alias("content"))
        fresh = chunk(own).withColumn("id", F.md5(F.concat("source", F.lit(":"), F.col("chunk_index").cast("string"), F.lit(":"), "text")))
        refresh_buckets(path, materialise(fresh, "chunks"), own.select(F.col("path").alias("source")), number, buckets)
        expire(path)

    return upsert_stream(files, apply, checkpoint)


def changed_paths(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status) to purge or to index again."""
    return diff(previous, current).where("status <> 'unchanged'")


def call_windows(calls: DataFrame, window: str, late: str) -> DataFrame:
    """(start, tool, n, failures) in clock windows of a stream; calls later than `late` are dropped."""
    seen = calls.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "tool").agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failures"))
    return seen.select(F.col("w.start").alias("start"), "tool", "n", "failures")


def admit(times: list[float], start: float | None, count: int, window: float, limit: int) -> tuple[list[bool], float, int]:
    """Which calls, in order of time, are let through: `limit` in each window, which begins with its first call."""
    passed = []
    for t in times:
        if start is None or t - start >= window:
            start, count = t, 0
        ok = count < limit
        count += ok
        passed.append(ok)
    return passed, start, count


#: Calls of a tool that one block holds.
CALLS = 1 << 16
#: The start of no window yet, and a time after all others.
NEVER, LAST = -(1 << 62), (1 << 63) - 1


def _leads(at: np.ndarray, window: int) -> pd.DataFrame:
    """(at, start, count) of a block's calls: a window that ends by `at`, and after the row before, is followed in the block by others, of which
    the last begins at `start` with `count` of the block's calls. The row of LAST is for a window that outlasts the block; there is none where no window can."""
    near = int(np.searchsorted(at, at[0] + window)) + 1  # an earlier block's window begins by at[0]
    times, last = np.unique(at[:near], return_index=True)
    while True:
        after = np.searchsorted(at, at[last] + window)
        if (after == len(at)).all():
            break
        last = np.where(after < len(at), after, last)
    keep = np.append(last[1:] != last[:-1], True)
    on = [[LAST], [NEVER], [len(at)]] if near > len(at) else [[], [], []]
    return pd.DataFrame({"at": [*times[keep], *on[0]], "start": [*at[last[keep]], *on[1]], "count": [*(len(at) - last[keep]), *on[2]]}, dtype="int64")


#: Parts that a group of the tree of blocks has.
FAN = 64


def _after(at: np.ndarray, to: np.ndarray, n: np.ndarray, start: np.ndarray, count: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows (start, count) that others become over a part of a tool's calls, whose rows (at, start, count) are `at`, `to` and `n`."""
    row = np.searchsorted(at, start + step)
    on = to[row] == NEVER  # the window outlasts the part
    return np.where(on, start, to[row]), np.where(on, count + n[row], n[row])


def _parts(rows: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, at, start, count) in order of time."""
    rows = rows.sort_values(["part", "at"])
    part, *columns = (rows[c].to_numpy() for c in ("part", "at", "start", "count"))
    numbers, first = np.unique(part, return_index=True)
    for n, a, b in zip(numbers, first, [*first[1:], len(part)]):
        yield int(n), *(c[a:b] for c in columns)


def rate_limit(calls: DataFrame, window: float, limit: int, fan: int = FAN, block: int = CALLS) -> DataFrame:
    """(event_id, tool, allowed) of a batch of calls (event_id, tool, ts), per tool in order of time and event_id.

    Tools are few and may hold any share of the calls, in moments too, so each tool's calls are numbered and cut into blocks of as many calls. Each block says where
    the windows that can enter it lead. What several blocks do one after the other can be said in the same form, so `fan` at a time are put
    together, up to one group a tool; from there down each part is told the window it begins in, and the
    blocks are then decided apart. No group has more than `fan` parts, nor more rows of each than there are different times in a window. A call without a time has a window to itself.
    """
    step = math.ceil(round(window * 1e6, 3))
    own = calls.select("event_id", "tool", F.coalesce(F.concat(F.lit("="), F.col("tool").cast("string")), F.lit("")).alias("key"), F.unix_micros("ts").alias("at"))
    alone = own.where("at is null") if step > 0 else own
    alone = alone.select("event_id", "tool", F.lit(limit > 0).alias("allowed"))
    if step <= 0:
        return alone
    timed = numbered(materialise(own.where("at is not null"), "calls"), ["at", "event_id"], "key", "calls")
    blocks = materialise(timed.withColumn("part", F.expr(f"position div {block}L")), "calls-blocks")
    most = blocks.agg(F.max("part")).first()[0]
    if most is None:
        return alone

    def lead(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _leads(np.sort(rows["at"].to_numpy()), step).assign(key=key[0], part=key[1])[["key", "part", "at", "start", "count"]]

    def put_together(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        (_, at, start, count), *others = _parts(rows)
        for _, *other in others:
            onto = at[-1] == LAST  # windows that outlast what came before meet this part's calls
            if onto:
                at, start, count, held = at[:-1], start[:-1], count[:-1], count[-1]
            start, count = _after(*other, start, count, step)
            if onto:
                at, start = np.append(at, other[0]), np.append(start, other[1])
                count = np.append(count, other[2] + np.where(other[1] == NEVER, held, 0))
            keep = np.append((start[1:] != start[:-1]) | (count[1:] != count[:-1]), True)
            at, start, count = at[keep], start[keep], count[keep]
        return pd.DataFrame({"key": key[0], "part": key[1], "at": at, "start": start, "count": count})

    def tell(rows: pd.DataFrame, start: int, count: int) -> pd.DataFrame:
        found, now = [], (np.array([start]), np.array([count]))
        for part, *own in _parts(rows):
            found.append((rows["key"].iloc[0], part, int(now[0][0]), int(now[1][0])))
            now = _after(*own, *now, step)
        return pd.DataFrame(found, columns=["key", "part", "start", "count"])

    def decide(rows: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        at, rank, begin = rows["at"].to_numpy(), np.arange(len(rows)) + int(entry["count"].iloc[0]), int(entry["start"].iloc[0])
        while (i := int(np.searchsorted(at, begin + step))) < len(at):
            rank[i:] = np.arange(len(at) - i)
            begin = int(at[i])
        return rows[["event_id", "tool"]].assign(allowed=rank < limit)

    row, entry = "key string, part long, at long, start long, count long", "key string, part long, start long, count long"
    above = F.expr(f"part div {fan}L").alias("above")
    tree, n = [materialise(blocks.select("key", "part", "at").groupBy("key", "part").applyInPandas(lead, row), "leads")], most + 1
    while n > fan:
        tree.append(materialise(tree[-1].groupBy("key", above).applyInPandas(put_together, row), "leads"))
        n = -(-n // fan)
    entries = tree.pop().groupBy("key").applyInPandas(lambda rows: tell(rows, NEVER, 0), entry)
    while tree:
        begun = entries.withColumnRenamed("part", "above").groupBy("key", "above")
        entries = tree.pop().groupBy("key", above).cogroup(begun).applyInPandas(lambda rows, at: tell(rows, int(at["start"].iloc[0]), int(at["count"].iloc[0])), entry)
    kind = calls.schema["tool"].dataType.simpleString()
    done = blocks.drop("total").groupBy("key", "part").cogroup(entries.groupBy("key", "part")).applyInPandas(decide, f"event_id long, tool {kind}, allowed boolean")
    return done.unionByName(alone)


class _Admission(StatefulProcessor):
    """A tool's window (start, count) as its state, which is dropped once no call that may still come can fall into it."""

    def __init__(self, window: float, limit: int):
        self.window, self.limit = window, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("window", "start double, count int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        start, count = self.state.get() if self.state.exists() else (None, 0)
        rows = pd.concat(list(rows)).sort_values(["at", "event_id"])
        timed = rows["at"].notna()
        yield rows[~timed][["event_id", "tool"]].assign(allowed=self.limit > 0)
        if timed.any():
            rows = rows[timed]
            passed, start, count = admit(rows["at"].tolist(), start, count, self.window, self.limit)
            self.state.update((start, count))
            self.handle.registerTimer(math.ceil((start + self.window) * 1000))
            yield rows[["event_id", "tool"]].assign(allowed=passed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists() and (self.state.get()[0] + self.window) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate_limit_stream(calls: DataFrame, window: float, limit: int, late: str = "1 day") -> DataFrame:
    """The same for a stream. Calls later than `late` are dropped, other late ones count when they come.

    A tool's window is state until a timer in the time of the calls says that it is over, so tools that are no longer called hold none.
    Sets the session's state store to RocksDB, which such state needs.
    """
    calls.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own = calls.withWatermark("ts", late).select("event_id", "tool", F.col("ts").cast("double").alias("at"), "ts")
    return own.groupBy("tool").transformWithStateInPandas(_Admission(window, limit), "event_id long, tool string, allowed boolean", "append", "eventTime")
