"""Helpers that the text operators share: tables in the shared folder, word splitting, hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch. Texts may be very long, so batches are kept small.
TEXT_ROWS_PER_BATCH = 128

#: Rows of a narrow table in one file.
ROWS_PER_FILE = 100_000

_own_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see, from ``spark.checkpoint.dir``.

    Only a local session may leave it unset; such a session gets a temporary folder of its own.
    """
    global _own_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="terrane-")
    return "file://" + _own_root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone at exit; the folder is the cluster's to clean then
        return


#: Folders of the tables that ``materialize`` has made and nobody has dropped, in order.
_made: dict[str, SparkSession] = {}


def _drop_rest() -> None:
    for path, spark in list(_made.items()):
        _remove(spark, path)


atexit.register(_drop_rest)


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of the table, not a recomputation, and rows that were
    made by a non-deterministic split of the input stay as they are. The table goes when it is dropped, or when the program
    ends.

    ``rows`` is a bound of the rows of a narrow table, if one is known: such a table is written in files of ROWS_PER_FILE
    rows and up to twice as many files as there are cores, instead of one small file for each shuffle partition. A file
    costs far more than its few rows. Only a stage whose inputs are as small as its output may name a bound.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/terrane-llm/{name}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(1, min(2 * spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_FILE)))) if rows <= 2 * spark.sparkContext.defaultParallelism * ROWS_PER_FILE else df
    df.write.parquet(path)
    _made[path] = spark
    for paths in _scopes.get():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(*tables: DataFrame) -> None:
    """Remove tables made by ``materialize`` that no later step reads."""
    for df in tables:
        for f in df.inputFiles()[:1]:
            path = f.rsplit("/", 1)[0]
            _remove(df.sparkSession, path)
            for known in [k for k in _made if path.endswith(k.rsplit("/", 1)[1])]:
                del _made[known]


#: For each open ``scope`` the folders of the tables made in it; a thread has scopes of its own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def scope() -> Iterator[list[str]]:
    """Folders of the tables that are made inside, for ``drop_made`` once nothing reads them any more."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield paths
    finally:
        _scopes.reset(token)


def drop_made(paths: list[str]) -> None:
    """Remove the tables in these folders that are still there."""
    for path in paths:
        if path in _made:
            _remove(_made.pop(path), path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of text small, so that very long texts don't pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as remainder null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(raw: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; bytes.lower and bytes.split touch ASCII only."""
    return raw.lower().split()


class WordHashes(dict):
    """64-bit hash by word. Forgets all words when it holds too many, so that it stays bounded."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_MIX1, _MIX2, _GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` words; of the whole sequence when it is shorter; empty for no words."""
    n = len(word_hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(size, n)
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = mix64(h * _GOLDEN + word_hashes[k : n - width + 1 + k])
    return h


def union_find(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Smallest member of each component of a small graph; for tests and bounded tiles."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def batches_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in it if b.num_rows)
