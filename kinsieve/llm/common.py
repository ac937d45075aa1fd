"""Pieces shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: Bytes up to which a table may be broadcast; measured before each use.
BROADCAST_BYTES = 32 << 20

#: A key is hot with more rows than one in HOT_SHARE (there can't be more hot keys than that) and more than a task can take without notice.
HOT_SHARE, HOT_ROWS = 10_000, 2_000

#: Bytes of text that a Python worker takes up at once; a longer text is taken alone.
SLICE_BYTES = 1 << 19

#: Rows and bytes of a batch on its way to a Python worker; both ends hold it whole, outside the heap.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}

#: What a task leaves in its worker for later tasks of its own function; the next task of another one gives it up.
HELD: dict = {}

#: Bytes in a window of the word hashes.
WINDOW_BYTES = 1 << 18

#: Word separators: space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by Spark's own reader, so that any path Spark opens will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the cluster's shared checkpoint folder and cut the lineage.

    The folder named in spark.checkpoint.dir is used where it is set; otherwise
    (tests, local mode) a temporary folder is set once.  Spark's cleaner deletes
    the files when the frame is no longer referenced.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tight(df: DataFrame, rows: int, each: int = 20_000) -> DataFrame:
    """A materialised table of known rows in tasks of about ``each`` rows; few rows in many partitions would be mostly overhead."""
    return df.coalesce(max(1, -(-rows // each)))


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files and checkpoints that nothing refers to any more.

    It learns of them only when the driver's garbage is collected, which may be much later than
    they die; iterative jobs would meanwhile fill the executors' disks.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _bytes(df: DataFrame) -> Column:
    """Sum of the bytes of rows: 16 and 16 for each column, and for strings, binaries and arrays their length."""
    wide = [F.octet_length(f.name) if f.dataType.typeName() != "array" else F.size(f.name) * 8 for f in df.schema if f.dataType.typeName() in ("string", "binary", "array")]
    return F.coalesce(F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16 + 16 * len(df.columns))).cast("long")), F.lit(0))


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table whose bytes were measured; beyond the bound a shuffle join is left to Spark."""
    return F.broadcast(df) if df.agg(_bytes(df)).first()[0] <= BROADCAST_BYTES else df


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with keyed (one row for each key) in which hot keys don't gather in one task.

    ``count`` of keyed says how many of the ``total`` rows have the key; it is dropped.  A small table is
    broadcast whole.  Otherwise hot keys, those with more than HOT_ROWS rows and more than one in HOT_SHARE, are
    at most HOT_SHARE however large the data: they are broadcast, and the others joined by a shuffle.
    Both tables should be cheap to read twice.
    """
    whole, most = keyed.drop(count), max(HOT_ROWS, total // HOT_SHARE)
    size, hottest = keyed.agg(_bytes(whole), F.coalesce(F.max(count), F.lit(0))).first()
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(whole), keys)
    if hottest <= most:
        return rows.join(whole, keys)
    hot = F.broadcast(keyed.where(F.col(count) > most).drop(count))
    rest = keyed.where(F.col(count) <= most).drop(count)
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(rest, keys))


ROW = "_kinsieve_row"


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The needed columns beside each whole row as one struct, so that further columns of any name can't clash."""
    return docs.select(F.struct("*").alias(ROW), *columns)


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(f"{ROW}.*")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  In local mode one of our own where it is unset; a cluster must name it."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinsieve-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that Spark wrote, by the file system that its path names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH.  Spark reads these settings when a plan runs, so they stay; smaller ones are kept."""
    for name, most in BATCH.items():
        now = re.match(r"(\d+)b?$", spark.conf.get(name), re.IGNORECASE)
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of consecutive rows with at most ``most`` bytes of strings, binaries and lists, or of one row; at most 1000 rows.

    So a worker's memory follows the longest single row, not the number of rows that Spark puts into a batch.
    """
    used = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            used += np.asarray(pc.binary_length(column).fill_null(0)).astype(np.int64)
        elif pa.types.is_list(column.type):
            used += np.asarray(pc.list_value_length(column).fill_null(0)).astype(np.int64) * 8
    total, at = np.cumsum(used), 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        end = min(max(at + 1, int(np.searchsorted(total, before + most, side="right"))), at + 1000, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _arrow_schema(schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema)
    return fields, to_arrow_schema(fields)


def _give_back() -> None:
    """Return what this worker has freed to the system: idle workers of one executor share its memory with the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not a glibc system
        pass


def _begin(keep: bool = False) -> None:
    """Give up what tasks of other functions left in HELD, before this one takes memory of its own."""
    if HELD and not keep:
        HELD.clear()
        gc.collect()
        _give_back()


def on_texts(fn: Callable[[list], list], kind: pa.DataType, *columns: Column, once: bool = False) -> Column:
    """A column of fn over bounded lists of the rows' values (one list for each column), in the order of the rows.

    once: Spark may not copy the call into a filter on the column, which would run it twice in a task, in two workers.
    """

    def run(*arrays: pa.Array) -> pa.Array:
        _begin()
        parts = [pa.array(fn(*(c.to_pylist() for c in part.columns)), kind) for part in slices(pa.RecordBatch.from_arrays(list(arrays), [str(k) for k in range(len(arrays))]))]
        _give_back()
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    bounded_batches(SparkSession.active())
    one = lambda a: run(a)
    two = lambda a, b: run(a, b)
    f = (one, two)[len(columns) - 1]
    f.__annotations__ = {"a": pa.Array, "return": pa.Array} | ({"b": pa.Array} if len(columns) == 2 else {})
    udf = F.arrow_udf(f, from_arrow_type(kind))
    return (udf.asNondeterministic() if once else udf)(*columns)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str, keep: bool = False) -> DataFrame:
    """mapInArrow for functions from a bounded slice of rows to a dict of columns; empty batches are skipped.  keep: fn goes on with what is in HELD."""
    bounded_batches(df.sparkSession)
    fields, arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(keep)
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        _give_back()

    return df.mapInArrow(run, fields)


def flat_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow for functions over the whole stream of a partition, in bounded slices, that yield dicts of columns."""
    bounded_batches(df.sparkSession)
    fields, arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        for out in fn(part for batch in batches for part in slices(batch)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        _give_back()

    return df.mapInArrow(run, fields)


# --- vectorised word hashing ------------------------------------------------------------------
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix generator: spreads every input bit over 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse; those of one window are kept."""
    if n <= 2 * WINDOW_BYTES and _POWERS:
        return [p[:n] for p in _POWERS]
    out = []
    for r in (_R, _R_INV):
        p = np.full(max(n, 2 * WINDOW_BYTES), r, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    if n <= 2 * WINDOW_BYTES:
        _POWERS[:] = out
    return [p[:n] for p in out]


class Words:
    """Words of a list of texts (ASCII lower-cased): which document each is in, and 64-bit hashes.

    data: the bytes of all texts, lower-cased, joined by newlines; start, end: byte
    bounds of each word there; doc: index of its text; hash: polynomial hash mod 2**64,
    mixed with the word's length.  Everything is computed by array operations, in windows
    of WINDOW_BYTES that end between words, so what lasts is 40 bytes for each word.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        data = b"\n".join(raw).translate(_LOWER)
        self.data = data
        a = np.frombuffer(data, np.uint8)
        sizes = np.fromiter((len(x) for x in raw), np.int64, len(raw))
        first = np.cumsum(sizes + 1) - (sizes + 1)
        starts, ends, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        while at < len(a):
            end = self._between(a, min(len(a), at + WINDOW_BYTES))
            own = a[at:end]
            edge = np.diff((~_SPACE[own]).view(np.int8), prepend=0, append=0)
            start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            power, inverse = _powers(len(own) + 1)
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(_TABLE[own] * power[: len(own)], dtype=np.uint64, out=total[1:])
            h = (total[stop] - total[start]) * inverse[start]
            hashes.append(mix(h ^ ((stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
            starts.append(start + at), ends.append(stop + at)
            at = end
        self.start, self.end, self.hash = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        self.doc = np.searchsorted(first, self.start, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(raw)).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])

    @staticmethod
    def _between(a: np.ndarray, end: int) -> int:
        """The first place from ``end`` on that isn't inside a word."""
        while end < len(a):
            part = _SPACE[a[end : end + 4096]]
            if part.any():
                return end + int(part.argmax())
            end += 4096
        return len(a)
