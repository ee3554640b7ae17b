"""Shared plumbing: table access, durable intermediates, Arrow helpers, word scanning."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: ASCII white space of the word pattern [^\x20\x09-\x0D]+
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table of that name under the scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. A folder of this machine would be lost on other executors, so none is made up."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and kept.isDefined():
        found = kept.get()
        spark.conf.set("spark.checkpoint.dir", found)
    if not found and spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="tessera-")  # one machine runs the driver and all tasks
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if kept.isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write df to Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    gc.collect()  # lets Spark's cleaner drop the shuffle files that only finished jobs needed
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing yet to be run reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], text_index: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Split Arrow batches so that each holds about `limit` bytes of text, and at least one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(batch.column(text_index)).to_numpy(zero_copy_only=False), dtype=np.float64))
        part = ((np.cumsum(sizes) - sizes) // limit).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def row_key(id_col: str, text_col: str):
    """A 128-bit key of a row: rows that repeat both id and text share it, and count as one document."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null"))
    return F.unhex(F.md5(F.concat_ws("\n", ident, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary")))


#: Keys that hold more than one in so many rows meet their partners by broadcast; there are at most so many of them.
HOT_KEYS = 1000


def hot_join(rows: DataFrame, partners: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with partners, one for each key, whose column count says how many rows they have: no task gets all rows of a very frequent key.

    Both sides are to be tables that are read from files, as each is read twice.
    """
    most = rows.count() // HOT_KEYS + 1
    frequent = F.broadcast(partners.where(F.col(count) > most))  # HOT_KEYS rows at most
    rest = rows.join(frequent.select(*keys), keys, "left_anti").join(partners.where(F.col(count) <= most), keys)
    return rows.join(frequent, keys).unionByName(rest)


def hash_bound(column: str, total: int, most: int):
    """Holds for little more than `most` of `total` rows, by a hash of a column; surely enough for that many."""
    share = min(1.0, (most + 6 * most**0.5 + 10) / max(1, total))
    return F.shiftrightunsigned(F.xxhash64(column), 11) <= F.lit(int(share * (1 << 53)))


def first_by_hash(rows: DataFrame, column: str, total: int, most: int) -> DataFrame:
    """The first `most` of `total` rows by a hash of a unique column: those below a hash bound go on, so few rows are sorted at any size."""
    return rows.where(hash_bound(column, total, most)).orderBy(F.shiftrightunsigned(F.xxhash64(column), 11), column).limit(most)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max([1 << max(16, (n - 1).bit_length()), *_POWERS])
    if size not in _POWERS:
        _POWERS.clear()
        up = np.full(size, _ODD, np.uint64)
        up[0] = 1
        down = np.full(size, pow(int(_ODD), -1, 1 << 64), np.uint64)
        down[0] = 1
        _POWERS[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS[size]


#: Masks of the first 0 to 8 bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(joined: bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes at a time, so words of up to eight bytes and one length never collide."""
    step = np.ndarray((len(joined) + 1,), "<u8", joined + bytes(8), strides=(1,))
    size = end - start
    out = size.astype(np.uint64) * _ODD + np.uint64(seed)
    at, first, more, own = slice(None), start, size, out  # own: the hashes of words that are longer than k bytes
    for k in range(0, 64, 8):
        if k:
            longer = np.flatnonzero(more > 8)
            at = longer if k == 8 else at[longer]
            first, more, own = first[longer] + 8, more[longer] - 8, own[longer]
        if not len(first):
            break
        part = step[first] & _FIRST.take(np.minimum(more, 8))
        part ^= own
        own = mix64(part)
        own += np.uint64(k)
        out[at] = own
    for w in np.flatnonzero(size > 64).tolist():
        out[w] = (int(out[w]) + xxh64_intdigest(joined[start[w] : end[w]], seed)) & 0xFFFFFFFFFFFFFFFF
    return mix64(out)


def scan_words(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words of many texts at once.

    Returns (hash64, start, end, words per text, joined bytes): a hash depends on the word's bytes
    alone; start and end index the joined bytes.
    """
    joined = b"\n".join(texts)
    if lower:
        joined = joined.lower()
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, np.zeros(len(texts), np.int64), joined
    word = np.zeros(len(data) + 2, bool)
    np.greater(data - np.uint8(9), 4, out=word[1:-1])  # not 9 to 13: less than 9 wraps around
    word[1:-1] &= data != 32
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[0::2], edge[1::2]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(lengths + 1)))
    counts = np.diff(np.searchsorted(start, bounds))
    return word_hashes(joined, start, end), start, end, counts, joined
