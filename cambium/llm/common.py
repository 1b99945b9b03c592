"""What the corpus operators share: table access, batches of text as byte arrays, word hashes, durable cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch on its way to Python (a longer row stands alone); a batch of texts is cut further, see `slices`.
BATCH_BYTES = 4 << 20
#: Slots of the bitmap of `told_apart`: 2**17 rows of 64 at most.
SLOTS = 1 << 23
#: Bytes of text that a vectorised kernel works on at once.
SLICE_BYTES = 2 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, U64), np.ones(1, U64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batched(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes: a batch of whole texts has to fit beside another task's. Batches of few bytes a row, such as series, stay as long as they were."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one in local mode; on a cluster an error, as executors don't share local folders."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        chosen = context.getConf().get("spark.checkpoint.dir")
        if chosen is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(chosen or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df cut from its lineage through files that all executors see."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def told_apart(rows: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be in `keys`, rows that aren't), by a bitmap of the one long column of keys; a null key isn't in it.

    For keys that few rows have: only the first part needs a join, and wide rows of the second aren't shuffled. The
    bitmap is broadcast as a table of at most SLOTS / 64 rows, whatever the input; once it is full, all rows are in the
    first part. Both parts together are the rows, each row once.
    """
    word, bits, slot = fresh("word"), fresh("bits"), F.pmod(F.xxhash64(F.col(keys.columns[0])), F.lit(SLOTS))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    table = durable(keys.select(F.call_function("shiftright", slot, F.lit(6)).alias(word), bit(slot).alias("b")).groupBy(word).agg(F.bit_or("b").alias(bits)))
    own = F.pmod(F.xxhash64(key), F.lit(SLOTS))
    joined = rows.withColumn(word, F.call_function("shiftright", own, F.lit(6))).join(F.broadcast(table), word, "left")
    there = F.coalesce(F.col(bits).bitwiseAND(bit(own)) != 0, F.lit(False)) & key.isNotNull()
    return joined.where(there).select(rows.columns), joined.where(~there).select(rows.columns)


def fresh(name: str) -> str:
    """A column name that clashes with none of a caller's."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0: such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each have about `most` bytes (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        part = np.cumsum(lengths) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of a string column as one byte array, and n + 1 offsets; null counts as empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def words_of(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word [^\\x20\\x09-\\x0D]+, and for each text the index of its first word (n + 1)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~space[buf]
    before = np.empty_like(ink)
    before[0], before[1:] = False, ink[:-1]
    after = np.empty_like(ink)
    after[-1], after[:-1] = False, ink[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(buf)]] = False
    inner = cuts[cuts > 0] - 1
    after[inner] = False
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(max(n, SLICE_BYTES + 1024), base, U64)
            grown[0] = 1
            _POWERS[i] = np.cumprod(grown, dtype=U64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64, for `ranged`."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values.astype(U64) * up[:-1], out=out[1:])
    return out


def ranged(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each range of what `prefix` has summed; equal ranges have equal hashes."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


#: What each byte counts as in a hash.
SPREAD = mixed(np.arange(1, 257, dtype=U64))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ranged(prefix(SPREAD[buf]), starts, ends)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; numpy's own `unique` hashes, which is many times slower on integers."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read again: smaller than a checkpoint, as durable."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Four bits of a byte in lanes of 16 bits each, for sums over many bytes at once, and how many a lane can hold.
_LANES = [np.array([sum((b >> (4 * half + i) & 1) << (16 * i) for i in range(4)) for b in range(256)], U64) for half in (0, 1)]
_MOST_LANE = 60_000


def bit_sums(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many hashes of each group, which begin at `at`, have each of 64 bits."""
    edges = np.unique(np.concatenate([at, np.arange(0, len(hashes), _MOST_LANE)]))  # no lane overflows
    raw = hashes.view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(at), 64), np.int64)
    group = np.searchsorted(at, edges, side="right") - 1
    for byte in range(8):
        for half, lanes in enumerate(_LANES):
            sums = np.add.reduceat(lanes[raw[:, byte]], edges)
            for i in range(4):
                out[:, 8 * byte + 4 * half + i] = np.bincount(group, (sums >> U64(16 * i) & U64(0xFFFF)).astype(np.float64), len(at))
    return out
