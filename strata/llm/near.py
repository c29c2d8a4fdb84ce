"""Near copies by word shingles: all texts that Jaccard similarity of their shingle sets links, each link verified.

First SimHash, as op1 has it: fingerprints of the same shingles, whose balls of variants meet, link texts within two
bits.  Two bits are far closer than the similarity asked for, so further candidates share a band of MinHash values: with 40 bands of 5 a pair of similarity s is missed with probability
(1 - s^5)^40, 1.3e-7 at 0.8 and less above.  Every text of a bucket is compared with one of the bucket's texts,
another one in each of its bands; in buckets that still hold several components, with one of another component
(``most_rounds`` times, while that links any); then all pairs across components (pairs inside one can't change it), each in the
first bucket that both share.  So every candidate pair is either compared or already connected.  Pairs across
components are first held against bitmaps of the sets: bits that differ are a lower bound of the elements that differ,
so no pair of the similarity is lost, and just the others are compared by their sets.  Every link is verified by the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, bounded_batches, cut, drop_cut, mix64, text_check, texts_of, without, words_of
from .components import components
from .simhash import ball_links, fingerprint

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, hashes: WordHashes, shingle: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, no words are none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h, k = hashes.of(words, len(words)), min(shingle, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix64((out + _STEP) ^ h[i : i + n])
    return np.unique(out)


def band_keys(shingles: np.ndarray, bands: int = 40, rows: int = 5, seed: int = 42) -> np.ndarray:
    """One 64-bit key a band: a hash of its MinHash values and of its number."""
    factors = np.random.default_rng(seed).integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        part = shingles[i : i + 4096]
        buffer = np.empty_like(part)
        for j, f in enumerate(factors):
            np.multiply(part, f, out=buffer)
            least[j] = min(least[j], buffer.min())
    keys = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = mix64((keys + _STEP) ^ column)
    return keys


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """The set folded to 1024 bits, as 16 longs."""
    bits = np.zeros(1024, bool)
    bits[shingles & np.uint64(1023)] = True
    return np.packbits(bits).view(np.int64)


def sketches(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, fp, n, bands, bits, sim), written: fp stands for the text (64 bits), n is the number of distinct shingles, sim
    the SimHash fingerprint."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("sim", T.LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(x, hashes, shingle) for x in texts_of(batch.column(2))]
            sims = np.array([fingerprint(x, shingle) for x in texts_of(batch.column(2))], np.uint64).view(np.int64)
            keys = [band_keys(s, bands, rows).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([bitmap(s) for s in sets], pa.list_(pa.int64())), pa.array(sims)], ["id", "fp", "n", "bands", "bits", "sim"])

    text = F.coalesce(F.col(text_col), F.lit("")).alias("t")
    with bounded_batches(docs.sparkSession):
        return cut(docs.select(F.col(id_col).alias("id"), text_check(text_col).alias("fp"), text).mapInArrow(kernel, schema), "sketches")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(fp, t) -> (fp, shingles), written."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(x, hashes, shingle).view(np.int64) for x in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "shingles"])

    with bounded_batches(texts.sparkSession):
        return cut(texts.mapInArrow(kernel, "fp long, shingles array<long>"), "sets")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar; two empty sets are equal."""
    side = lambda c: sets.select(F.col("fp").alias(c), F.col("shingles").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.where(both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 40, rows: int = 5) -> DataFrame:
    """One row per input row: id, component_id (smallest id reachable over links of ``similarity`` or more).

    Null texts count as empty, and texts without words are copies of each other.  Null ids count for no component_id.
    """
    marked = sketches(docs, id_col=id_col, text_col=text_col, shingle=shingle, bands=bands, rows=rows)
    return _placed(docs, marked, text_col, shingle, similarity).select(F.col("id").alias(id_col), "component_id")


def simhash_pairs(groups: DataFrame) -> DataFrame:
    """(fp, sim) of distinct texts -> pairs (a, b), a > b, within two bits: of one fingerprint each text with the least,
    and the least texts of fingerprints that ``ball_links`` links."""
    least = groups.groupBy("sim").agg(F.min("fp").alias("least"))
    same = groups.join(least, "sim").where("fp <> least").select("fp", "least")
    side = lambda c: least.select(F.col("sim").alias(c), F.col("least").alias(f"least_{c}"))
    links = ball_links(least.select(F.col("sim").alias("fp"))).join(side("a"), "a").join(side("b"), "b").select("least_a", "least_b")
    return same.union(links).toDF("x", "y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _placed(docs: DataFrame, marked: DataFrame, text_col: str, shingle: int, similarity: float, most_rounds: int = 1) -> DataFrame:
    """(id, fp, component_id) of every row of ``marked``."""
    groups = cut(marked.groupBy("fp").agg(F.min("id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.first("sim").alias("sim")), "classes")
    keys = groups.select("fp", "n", F.explode("bands").alias("key"))
    heads = keys.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp", "key"), "fp", "n")).alias("head"), F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most")
    met = cut(keys.join(heads.select("key", "head"), "key"), "met")  # the buckets that hold several texts
    text, fp = F.coalesce(F.col(text_col), F.lit("")).alias("t"), text_check(text_col).alias("fp")
    balls = cut(simhash_pairs(groups), "balls")
    wanted = met.select("fp").unionByName(balls.select(F.explode(F.array("a", "b")).alias("fp"))).distinct()
    sets = shingle_sets(docs.select(fp, text).join(wanted, "fp", "left_semi").dropDuplicates(["fp"]), shingle)

    alike = lambda m, n: F.least(m, n) >= F.lit(similarity) * F.greatest(m, n)  # noqa: E731  (else no overlap is enough)
    pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    first = met.where(F.col("fp") != F.col("head.fp")).where(alike(F.col("n"), F.col("head.n"))).select(*pair("fp", "head.fp"))
    tried = cut(first.unionByName(balls).distinct(), "star")
    found = [cut(_similar(tried, sets, similarity), "similar")]
    roots, stars, gone = components(found[0]), [tried], []
    for turn in range(1, most_rounds + 2):
        placed = cut(met.join(roots, met.fp == roots.node, "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root")), "placed")
        open_keys = placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
        left = cut(placed.join(open_keys, "key", "left_semi"), "open")
        gone += [placed, left]
        if turn > most_rounds:
            break
        heads = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("fp", "key", F.lit(turn)), "fp", "n", "root")).alias("head"))
        star = left.join(heads, "key").where(F.col("root") != F.col("head.root")).where(alike(F.col("n"), F.col("head.n"))).select(*pair("fp", "head.fp")).distinct()
        star = cut(star.join(reduce(DataFrame.unionByName, stars), ["a", "b"], "left_anti"), "star")
        stars.append(star)
        more = cut(_similar(star, sets, similarity), "similar")
        if not more.limit(1).count():
            gone.append(more)
            break
        found.append(more)
        gone.append(roots)
        roots = components(reduce(DataFrame.unionByName, found))
    left = left.join(groups.select("fp", "bits", "bands"), "fp")
    other = left.select("key", F.col("fp").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("bits").alias("bits_b"), F.col("bands").alias("bands_b"))
    differ = reduce(add, [F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(16)])
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("n") + F.col("m")) + F.lit(1e-6)
    once = F.get(F.array_intersect("bands", "bands_b"), F.lit(0)) == F.col("key")
    across = left.join(other, "key").where("fp > b and root <> other").where(alike(F.col("n"), F.col("m"))).where(differ <= most).where(once)
    across = cut(across.select(F.col("fp").alias("a"), "b").join(reduce(DataFrame.unionByName, stars), ["a", "b"], "left_anti"), "across")
    more = cut(_similar(across, sets, similarity), "similar")
    if more.limit(1).count():
        gone.append(roots)
        roots = components(reduce(DataFrame.unionByName, [*found, more]))

    joined = groups.join(roots, groups.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    least = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = cut(joined.join(least, "root").select("fp", "component_id"), "components")
    drop_cut(groups, met, balls, sets, across, more, roots, *stars, *found, *gone)
    return marked.join(classes, "fp", "left").select("id", "fp", "component_id")


def keep_one_of_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bands: int = 40, rows: int = 5) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component; rows that repeat that id there stay, null ids stay.

    Rows are known by id and text: of rows that share an id, each is judged by its own text's component.
    """
    marked = sketches(docs, id_col=id_col, text_col=text_col, shingle=shingle, bands=bands, rows=rows)
    found = _placed(docs, marked, text_col, shingle, similarity)
    return without(docs, found.where(F.col("id") != F.col("component_id")).select("id", F.col("fp").alias("check")), id_col, text_col)
