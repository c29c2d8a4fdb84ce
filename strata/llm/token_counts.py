"""Token counts through a digest cache.

The cache is a Parquet table (text_digest, tokenizer_digest, n_bytes, n_tokens).  Documents are joined to it on the
SHA-256 of the normalised text and the SHA-256 of the tokenizer file and its settings; only distinct misses are
encoded, appended to the cache, and all rows get their count from it.  Of a group of copies one representative is
encoded: the digests, not the texts, are grouped, and a copy's text never meets the others in one task.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, new_path, path_exists, table

CACHE_SCHEMA = "text_digest string, tokenizer_digest string, n_bytes long, n_tokens long"


@functools.lru_cache(maxsize=2)  # a worker process serves many tasks and reads the vocabulary once
def load_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts: tokenizers for .json, sentencepiece for .model, library defaults."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    raise ValueError(f"no library for {path!r}")


def tokenizer_digest(path: str, version: str) -> str:
    """SHA-256 of the file and of what else decides the counts: library, its version, our settings."""
    h = hashlib.sha256(version.encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def token_counts(docs: DataFrame, tokenizer_path: str, *, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, limit: int = 2048) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty (0 bytes, 0 tokens); repeated rows come out repeated; an empty table is empty.
    ``normalise`` maps the text column before digest and encoding (default: no change; n_bytes is of the result).
    ``cache_path``: a cache that outlives the call; without one, a new one in the shared folder.
    """
    import importlib.metadata as meta

    spark = docs.sparkSession
    library = "tokenizers" if tokenizer_path.endswith(".json") else "sentencepiece"
    version = tokenizer_digest(tokenizer_path, f"{library} {meta.version(library)} no-special no-truncation no-padding")
    cache_path = cache_path or new_path(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t")).withColumn("text_digest", F.sha2(F.col("t").cast("binary"), 256))
    digests = cut(rows.select("id", "text_digest", F.octet_length("t").cast("long").alias("n_bytes")), "text-digests")
    wanted = digests.groupBy("text_digest").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id")).alias("k"))
    if path_exists(spark, cache_path):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
        wanted = wanted.join(known.select("text_digest"), "text_digest", "left_anti")
    wanted = cut(wanted.select(F.col("text_digest").alias("d"), F.col("k.id").alias("i")), "misses")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(tokenizer_path)
        for batch in batches:
            n = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), batch.column(2), pa.array(n, pa.int64())], ["text_digest", "tokenizer_digest", "n_bytes", "n_tokens"])

    # Joined on digest and id: the one row of each digest that is encoded; its copies find no partner.
    misses = rows.join(wanted, (F.col("text_digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")))
    misses = misses.select("text_digest", "t", F.octet_length("t").cast("long").alias("n_bytes"))
    with bounded_batches(spark, 256):
        misses.mapInArrow(kernel, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
    # Written, so that the join stands on two plain exchanges: only then can Spark split a digest that many rows share.
    known = cut(known.groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens")), "known-counts")
    out = digests.join(known, "text_digest", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
