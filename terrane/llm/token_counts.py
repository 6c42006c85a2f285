"""Token counts through a digest cache.

Each text gives a narrow row (id, bytes, content digest). The distinct digests are joined to the counts stored under the
tokenizer's own digest, only those without a stored count are encoded, each once, and their counts are appended to the cache.
Texts move only for that: copies are folded within each partition before the shuffle, so a text that stands a million times is
sent once a task. When few digests are new, they are broadcast and nothing else of the texts moves at all.

Content is normalised before its digest: null becomes empty. Byte-level vocabularies count every byte, so nothing else may be
changed for them. The tokenizer's digest covers its file and the library and version that read it; a new version starts anew.

The cache is a folder of Parquet files by tokenizer digest. A run that is lost leaves no rows, as Spark commits a table at its
end; two runs at once may append a digest twice, with the same count, and readers fold that.

Defined cases: null and empty texts have 0 bytes and 0 tokens; null and repeated ids keep their rows, one each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm.common import drop_table, materialize, raw_texts, shared_root, small_batches
from terrane.llm.packing import encoder, tokenizer_file

#: Distinct new digests, of 32 bytes each, up to which they are broadcast to the texts instead of sending texts to them.
BROADCAST_DIGESTS = 100_000
LIMIT_TOKENS = 512

_counters: dict[str, Callable[[bytes], int]] = {}


def library_of(path: str) -> str:
    for end, name in ((".json", "tokenizers"), (".model", "sentencepiece")):
        if path.endswith(end):
            return name
    raise ValueError(f"no library is known for {path}")


def tokenizer_digest(path: str) -> str:
    """sha256 over the tokenizer's file and the library and version that read it."""
    name = library_of(path)
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{name} {importlib.metadata.version(name)}".encode()).hexdigest()


def _byte_level(path: str) -> bool:
    t = Tokenizer.from_file(path)
    return t.normalizer is None and type(t.pre_tokenizer).__name__ == "ByteLevel"


def counter(path: str) -> Callable[[bytes], int]:
    """Number of tokens of a text, without begin, end or added special tokens; one for each file and Python worker."""
    if path not in _counters:
        if library_of(path) == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _counters[path] = lambda raw: len(model.encode(raw.decode("utf-8", "replace"), num_threads=1))
        elif _byte_level(path):
            encode = encoder(path).encode
            _counters[path] = lambda raw: len(encode(raw)) // 4
        else:
            whole = Tokenizer.from_file(path)
            whole.no_truncation()
            whole.no_padding()
            _counters[path] = lambda raw: len(whole.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids)
    return _counters[path]


def cached(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) stored for this tokenizer digest; empty while the folder is not there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/{tokenizer}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    stored = spark.read.schema("digest binary, n_tokens long").parquet(f"{cache}/{tokenizer}")
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_distinct(texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of (digest, text)."""
    small_batches(texts.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in it:
            yield pa.record_batch([batch.column("digest"), pa.array([count(raw) for raw in raw_texts(batch.column("text"))], pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, path: str | None = None, cache: str | None = None, limit: int = LIMIT_TOKENS, broadcast_digests: int = BROADCAST_DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cache_hit (its digest was stored before this run).

    ``cache`` is a folder that the cluster shares; without one this run fills a cache of its own in the shared folder, so its
    result doesn't depend on earlier runs.
    """
    spark, path = docs.sparkSession, path or tokenizer_file()
    cache = cache or f"{shared_root(spark)}/terrane-llm/token-cache-{uuid.uuid4().hex}"
    version = tokenizer_digest(path)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    keyed = materialize(src.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "token-rows")
    looked = materialize(keyed.select("digest").distinct().join(cached(spark, cache, version), "digest", "left"), "token-looked")
    fresh = looked.where("n_tokens IS NULL").select("digest")
    n_fresh = fresh.count()
    if n_fresh:
        if n_fresh <= broadcast_digests:
            texts = src.join(F.broadcast(fresh), "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
        else:
            texts = src.groupBy("digest").agg(F.first("text").alias("text")).join(fresh.hint("merge"), "digest", "left_semi")
        encode_distinct(texts, path).write.mode("append").parquet(f"{cache}/{version}")
    counts = cached(spark, cache, version).join(looked.select("digest", F.col("n_tokens").isNotNull().alias("cache_hit")), "digest")
    counts = materialize(counts, "token-counts")
    drop_table(looked)
    out = keyed.join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cache_hit")
