"""Pieces that the operators of this subpackage have in common.

Texts reach Python as Arrow batches.  :func:`over_texts` cuts each batch into
slices of bounded bytes and hands the raw UTF-8 buffer with its offsets to a
vectorised function, so no Python code runs per byte or per word.  A null text
is an empty one there.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one slice holds, unless a single text is longer.
SLICE_BYTES = 1 << 20

#: Odd constant of the SplitMix64 sequence, and the multipliers of its finaliser (fixed values).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one that was set for checkpoints.

    Where neither is set, one process that is driver and executor in one gets a
    temporary folder; a cluster has to name a folder that all its machines share.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if place is None:
        if given.isDefined():
            return given.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="checkpoints-")
    if not given.isDefined():
        spark.sparkContext.setCheckpointDir(place)
    return place


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared checkpoint folder; their lineage ends there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: With it Spark gives up a query's shuffle files when the query ends, not when the driver's memory happens to be collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the shared checkpoint folder and read from there: for large results, as it compresses.

    The shuffle files of the write are gone when this returns.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(place)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(place)


def discarded(*tables: DataFrame) -> None:
    """Delete what :func:`stored` wrote; nothing may read these tables any more."""
    for df in tables:
        spark = df.sparkSession
        for place in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the SplitMix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of each ordered pair of 64-bit names."""
    return mix(a * MIX_B + np.uint64(0x2545F4914F6CDD1D) + mix(b + GOLDEN))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column and the n + 1 offsets between them."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch whose texts together stay below the limit, or one longer row."""
    names = batch.schema.names
    _, at = texts_of(batch.column(names.index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


#: What this worker process keeps between tasks: the tables of one operator at most.
_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]):
    """The object of this key, made once per worker process; objects of other keys are dropped, as workers serve one operator after the other."""
    if key not in _kept:
        _dropped()
        _kept[key] = make()
    return _kept[key]


def _dropped() -> None:
    """Forget what was kept and give its memory back before anything takes its place."""
    if _kept:
        _kept.clear()
        release()


def release() -> None:
    """Give freed memory back to the system, for the executor's other processes."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def over_texts(df: DataFrame, fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | None], schema: str, column: str = "text", keeps: bool = False) -> DataFrame:
    """fn(slice, raw bytes, offsets) over all rows; its record batches are the result.

    Each task gets an fn of its own, which may so remember what it has seen.  keeps: fn uses :func:`kept`.
    """

    limit = SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _dropped()
        for batch in batches:
            for part in slices(batch, column, limit):
                raw, at = texts_of(part.column(part.schema.names.index(column)))
                made = fn(part, raw, at)
                if made is not None and made.num_rows:
                    yield made
        release()

    return df.mapInArrow(run, schema)


#: ASCII white space: space and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: A fixed random word for each byte value.
_BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
#: An odd base of the rolling hash and its inverse modulo 2**64.
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, np.uint64)
        np.cumprod(np.full(size - 1, base, np.uint64), out=have[1:])
        _powers[base] = have
    return have[:n]


def rolling(names: np.ndarray) -> np.ndarray:
    """Prefix sums of names[i] * BASE**i; :func:`span_hash` reads any span from them."""
    sums = np.zeros(len(names) + 1, np.uint64)
    np.cumsum(names * powers(_BASE, len(names)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, stop), equal for equal spans wherever they lie."""
    unplaced = (sums[stop] - sums[start]) * powers(_INVERSE, len(sums))[start]
    return mix(unplaced + (stop - start).astype(np.uint64) * GOLDEN)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop byte of every word [^\\x20\\x09-\\x0D]+, and n + 1 offsets of the texts' words."""
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = at[(at > 0) & (at < len(raw))]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def word_names(raw: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit name of each word, the words' starts and stops, and n + 1 offsets of the texts' words."""
    start, stop, of = words(raw, at)
    sums = rolling(_BYTE_NAMES[_LOWER[raw] if lower else raw])
    return span_hash(sums, start, stop), start, stop, of


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.names.index(name))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


#: Ids that may be broadcast: a hash table of so many longs takes a few tens of MB.
BROADCAST_IDS = 400_000


def having(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is among the ids (distinct, cheap to count): broadcast if few, else a shuffled semi-join."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
