"""What the text operators share: word splitting, hashing, worker set-up, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, about; a single larger row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Bytes, about, that a worker's cache of words may hold, what an entry takes besides its word, and the longest word that is kept.
CACHE_BYTES, ENTRY_BYTES, CACHED_WORD = 20 << 20, 200, 64
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII letters to lower case, ASCII other than letters and digits to a blank.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did, and bound what they get at a time by bytes, as texts may be long."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the whole cluster sees; where that is unset, a temporary one in local mode alone."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set: the stages need a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gf-shared-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/gf-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors.  Its shuffle files go once it is written."""
    spark, path = df.sparkSession, shared(df.sparkSession)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Drop what stored() wrote, as soon as nothing reads it any more."""
    for df in frames:
        for path in {x.rpartition("/")[0] for x in df.inputFiles() if "/gf-" in x}:
            hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def per_batch(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """Arrow batches as dicts of Python lists through make()'s function; what make() sets up lives as long as the task."""
    arrow = _arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                out = step({k: batch.column(i).to_pylist() for i, k in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def text_bytes(name: str = "text"):
    """The text in UTF-8; null stays null."""
    return F.col(name).cast("string").cast("binary").alias(name)


class Kept(dict):
    """What of() gives for a word, kept for the short words seen lately, up to ``most`` bytes in all: a younger half, and an older one that goes when the younger is full."""

    def __init__(self, of: Callable[[bytes], object], most: int = CACHE_BYTES):
        self.find, self.most, self.size, self.old = of, most, 0, {}

    def __missing__(self, word: bytes):
        got = self.old[word] if word in self.old else self.find(word)
        if len(word) <= CACHED_WORD:
            self.size += ENTRY_BYTES + len(word)
            if self.size > self.most // 2:
                self.old = dict(self)
                self.clear()
                self.size = ENTRY_BYTES + len(word)
            self[word] = got
        return got


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; constants are those of the public splitmix64."""
    out = h >> np.uint64(30)
    out ^= h
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


#: Bytes hashed at a time, and the longest word that the table hashes; others go to xxhash one by one.
SLICE, LONGEST = 1 << 20, 64
#: A number for each byte at each place of a word (tabulation hashing).
TABLE = mixed(np.arange(1, 256 * LONGEST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _hashed(line: bytes) -> np.ndarray:
    """The hash of each word of a line, words parted by one blank."""
    b = np.frombuffer(line, np.uint8)
    gaps = np.flatnonzero(b == 32)
    starts = np.concatenate([[0], gaps + 1])
    sizes = np.diff(np.append(starts, len(b) + 1))
    at = np.arange(len(b), dtype=np.int32)
    at -= np.repeat(starts.astype(np.int32), sizes)[: len(b)]
    long = np.flatnonzero(sizes > LONGEST + 1)
    if sizes.max() > LONGEST:  # long words, and the blank after one of LONGEST bytes
        np.minimum(at, LONGEST - 1, out=at)
    at <<= 8
    at |= b
    value = TABLE.take(at)
    value[gaps] = 0
    out = mixed(np.add.reduceat(value, starts))
    for i in long:
        out[i] = xxhash.xxh64_intdigest(line[starts[i] : starts[i] + sizes[i] - 1])
    return out


class Ids:
    """Words to 64-bit hashes, a whole text's at a time."""

    @staticmethod
    def of(words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        line = b" ".join(words)
        if len(line) <= SLICE:
            return _hashed(line)
        out, now, size = [], [], 0
        for w in words:
            if len(w) > SLICE:
                out += [*([_hashed(b" ".join(now))] if now else []), np.array([xxhash.xxh64_intdigest(w)], np.uint64)]
                now, size = [], 0
                continue
            now.append(w)
            size += len(w)
            if size > SLICE:
                out.append(_hashed(b" ".join(now)))
                now, size = [], 0
        return np.concatenate([*out, *([_hashed(b" ".join(now))] if now else [])])


def windows(h: np.ndarray, k: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of each k consecutive hashes."""
    if len(h) < k:
        return h[:0]
    n, half, by = len(h) - k + 1, np.uint64(32), np.uint64(0xD6E8FEB86659FD93)
    out, part = np.full(n, seed, np.uint64), np.empty(n, np.uint64)
    for j in range(k):
        out ^= h[j : n + j]
        out *= by
        np.right_shift(out, half, out=part)
        out ^= part
    return mixed(out)
