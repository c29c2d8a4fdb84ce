"""Shared plumbing of the corpus operators: tables, the shared scratch folder, Arrow batches, byte words.

Every operator of this subpackage takes DataFrames and returns DataFrames.  What must be cut from its lineage is
written as Parquet below ``spark.checkpoint.dir`` (a folder that driver and executors share), so a lost executor
costs a re-read and never a wrong or partial result.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII lower-casing as a byte table; UTF-8 continuation bytes are untouched.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_own_dir: str | None = None
#: Tables of this process in the shared folder, in the order made; what is left goes when the process ends.
_made: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset and all runs in one process (tests), one of our own."""
    global _own_dir
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="strata-shared-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/strata-{name}-{uuid.uuid4().hex[:12]}"
    _made[path] = spark
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once in the shared folder and read it back: the lineage ends at a replicated file."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strata_path = path
    return out


def drop_cut(*tables: DataFrame) -> None:
    """Remove tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_strata_path", None):
            drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables cut inside go at the end, but for those put in the list: what is read later must be among these."""
    before, keep = set(_made), []
    yield keep
    kept = {getattr(df, "_strata_path", None) for df in keep}
    for path in [p for p in _made if p not in before and p not in kept]:
        drop_path(spark, path)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the cluster may be gone
            drop_path(spark, path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@contextlib.contextmanager
def bounded_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Inside, Arrow batches to Python hold at most ``rows`` texts and 16 MB, so that long texts can't fill a worker."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}
    before = {k: spark.conf.get(k) for k in bounds}
    if 0 < int(before["spark.sql.execution.arrow.maxRecordsPerBatch"]) < rows:
        del bounds["spark.sql.execution.arrow.maxRecordsPerBatch"]
    for k, v in bounds.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in bounds:
            spark.conf.set(k, before[k])


def text_check(text_col: str) -> Column:
    """64 bits that stand for a text where its row is found again by identifier and text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def without(docs: DataFrame, goes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose identifier and text aren't among ``goes`` (id, check), with all their columns.

    Rows of one identifier with different texts are told apart; a null identifier is one like any other.
    """
    goes = cut(goes.select(F.col("id").alias("__goes"), F.col("check").alias("__check")).distinct(), "goes")
    text = F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit("")))
    return docs.join(goes, docs[f"`{id_col}`"].eqNullSafe(goes["__goes"]) & (text == goes["__check"]), "left_anti")


def crc_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of an identifier's decimal text, modulo ``mod``; a null identifier counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text of an Arrow column; null counts as empty."""
    for value in column.cast(pa.large_binary()) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else column:
        yield value.as_py() or b""


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+``; bytes.split() parts at just these six bytes."""
    return text.translate(LOWER).split()


_RANDOM_BYTE = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)
_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)


@functools.lru_cache
def _byte_values(table: bytes) -> np.ndarray:
    """A random number for each byte as ``table`` translates it; 0 for what parts words then."""
    parts = np.zeros(256, bool)
    parts[[0x20, *range(0x09, 0x0E)]] = True
    return _RANDOM_BYTE[list(table)] * ~parts[list(table)]


def word_hashes(column: pa.Array, table: bytes = LOWER, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts of an Arrow column, and how many each text has; null counts as empty.

    Words are those of ``text.translate(table).split()``.  A hash is a polynomial in the word's bytes, mixed; ``step``
    bounds memory.
    """
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]] if len(column) else np.zeros(0, np.uint8)
    edges = edges - edges[0] if len(column) else np.zeros(1, np.int64)
    values_of = _byte_values(table)
    solid = (values_of != 0)[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inside = edges[:-1][edges[:-1] < len(data)]
    first[inside] = solid[inside]
    starts = np.flatnonzero(first)
    out = np.empty(len(starts), np.uint64)
    ends = np.append(starts[1:], len(data))
    i = 0
    while i < len(starts):
        k = max(i + 1, int(np.searchsorted(starts, starts[i] + step)))
        lengths = ends[i:k] - starts[i:k]
        powers = np.cumprod(np.full(int(lengths.max()), _POWER))
        at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        values = values_of[data[starts[i] : ends[k - 1]]] * powers[at]
        out[i:k] = np.add.reduceat(values, starts[i:k] - starts[i])
        i = k
    return mix64(out), np.diff(np.searchsorted(starts, edges))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, kept for repeated words up to ``limit`` entries (then it starts anew)."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        super().__init__()
        import xxhash

        self._hash, self._seed, self._limit = xxhash.xxh64_intdigest, seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._limit:
            self.clear()
        value = self[word] = self._hash(word, self._seed)
        return value

    def of(self, words: Iterable[bytes], n: int = -1) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=n)
