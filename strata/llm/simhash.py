"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text's fingerprint has the majority bit of the XXH64 of its shingles at each of 64 places.  Two fingerprints
within an even radius r meet at some value within r/2 of both, so every distinct fingerprint emits all such variants
(65 at r = 2), the variants are shuffled, and fingerprints with a common variant are compared.  At most 65 distinct
fingerprints can share a variant, whatever the size of the corpus, so a bucket is bounded by construction and no pair
is ever skipped; all members of a bucket are within r of each other, so a star from the least of them has the same
connectivity as all its pairs, and every link of the star is verified by its Hamming distance.  Copies collapse to one
fingerprint before anything is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, drop_cut, table, text_check, texts_of, without, words_of
from .components import components

_BLOCK = 255 * 64


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of one text, unsigned; no words: zero.  A bit is 1 if it is set in over half of the hashes."""
    import xxhash

    words, h = words_of(text), xxhash.xxh64_intdigest
    if not words:
        return 0
    if len(words) <= shingle:
        return h(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    spans = list(zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True))
    for i in range(0, n, _BLOCK):
        part = spans[i : i + _BLOCK]
        hashes = np.zeros(len(part) + -len(part) % 255, dtype=">u8")  # padded with hashes that have no bits
        hashes[: len(part)] = [h(line[a:b], seed) for a, b in part]
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += np.add.reduce(bits.reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, check, fp), written: fp is the fingerprint as a signed long.  Null texts count as empty."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("check", T.LongType()), T.StructField("fp", T.LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x, shingle, seed) for x in texts_of(batch.column(2))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["id", "check", "fp"])

    with bounded_batches(docs.sparkSession):
        return cut(docs.select(F.col(id_col).alias("id"), text_check(text_col).alias("check"), F.col(text_col).alias("t")).mapInArrow(kernel, schema), "fingerprints")


def ball_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints ``fps`` (fp) that connect all within ``radius`` bits."""
    if radius < 2 or radius % 2:
        raise ValueError("radius must be an even number of 2 or more: half of it is the ball of variants")
    masks = [0]
    for k in range(1, radius // 2 + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(64), k)]
    flips = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    variants = fps.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = variants.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("least"))
    links = met.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def _classes(marked: DataFrame, radius: int) -> DataFrame:
    """(id, check, fp) -> (fp, component_id) of every distinct fingerprint."""
    groups = cut(marked.groupBy("fp").agg(F.min("id").alias("least_id")), "classes")
    roots = components(ball_links(groups.select("fp"), radius))
    joined = groups.join(roots, groups.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = cut(joined.join(least, "root").select("fp", "component_id"), "components")
    drop_cut(groups, roots)
    return classes


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Texts without words have fingerprint zero and link like any other.  Null ids count for no component_id (it is
    null where a component has no other); repeated rows come out as often as they went in; an empty table is empty.
    """
    marked = fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed)
    classes = _classes(marked, radius)
    return marked.join(classes, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component; rows that repeat that id there stay, null ids stay.

    Rows are known by id and text: of rows that share an id, each is judged by its own text's component.
    """
    marked = fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed)
    found = marked.join(_classes(marked, radius), "fp", "left")
    return without(docs, found.where(F.col("id") != F.col("component_id")), id_col, text_col)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
