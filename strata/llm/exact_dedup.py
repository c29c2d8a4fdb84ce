"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition sorts its digests into a run and collapses equal ones.  Runs then meet in binomial rounds: in a
round, the runs of ``fan_in`` neighbouring nodes are exchanged (dealt by node and digest, so that the work of one
round spreads over all tasks), merged in digest order, and of equal digests only the preferred identifier and the
number of copies survive.  After log(runs)/log(fan_in) rounds one logical run is left, in as many sorted pieces as
there are shuffle partitions.  Only digests travel, never texts; a digest with a third of all rows is a single row of
each run before it is first exchanged, so no task sees its copies.

A group is verified at every level: rows merge only if SHA-256, byte length and an independent XXH64 all agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

KEY = ("digest", "n_bytes", "check")


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse runs of equal keys in a sorted partition: first row wins, counts add up.  Holds one batch and one row."""
    carry = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if carry is not None:
            part = pa.concat_tables([carry, part])
        if not part.num_rows:
            continue
        part = part.combine_chunks()
        new = np.ones(part.num_rows, dtype=bool)
        if part.num_rows > 1:
            differs = np.zeros(part.num_rows - 1, dtype=bool)
            for name in KEY:
                column = part[name].combine_chunks()
                differs |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = differs
        starts = np.flatnonzero(new)
        copies = np.add.reduceat(part["copies"].to_numpy(), starts)
        part = part.take(pa.array(starts))
        at = part.schema.get_field_index("copies")
        part = part.set_column(at, part.schema.field(at), pa.array(copies, pa.int64()))
        carry = part.slice(part.num_rows - 1)
        yield from part.slice(0, part.num_rows - 1).to_batches()
    if carry is not None:
        yield from carry.to_batches()


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row a document (id, row number, digests), written in the shared folder: texts are read once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    )
    return cut(rows.select("*", F.monotonically_increasing_id().alias("row")), "digests")


def tree_merge(digests: DataFrame, keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """One row per distinct digest: keep_id, keep_row and copies.

    ``keep``: 'smallest' or 'largest' identifier; null identifiers lose, and of rows with the same identifier the
    earliest row number stays.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    if fan_in < 2:
        raise ValueError("fan_in must be 2 or more")
    first = F.col("keep_id").asc_nulls_last() if keep == "smallest" else F.col("keep_id").desc_nulls_last()
    order = [*map(F.col, KEY), first, F.col("keep_row")]
    runs = digests.select(*KEY, F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("copies"), F.spark_partition_id().alias("node"))
    left = max(1, digests.rdd.getNumPartitions())
    runs = runs.sortWithinPartitions(*order).mapInArrow(_merge_sorted, runs.schema)
    while left > 1:
        left = -(-left // fan_in)
        node = F.floor(F.col("node") / fan_in).cast("int") if left > 1 else F.lit(0)
        runs = runs.withColumn("node", node).repartition("node", "digest").sortWithinPartitions(*order)
        runs = runs.mapInArrow(_merge_sorted, runs.schema)
    return runs.drop("node")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null equals the empty text.  Exactly one row of each group is kept, also if
    rows repeat whole (then the earliest row) or identifiers are null (they are kept only if the group has no other).
    An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    digests = digest_table(docs, id_col, text_col)
    winners = tree_merge(digests, keep, fan_in)
    joined = digests.join(winners, list(KEY), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", fan_in: int = 16) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Texts are not shuffled where no two rows share both identifier and text; those that do meet in a distinct step.
    """
    digests = digest_table(docs, id_col, text_col)
    winners = tree_merge(digests, keep, fan_in)
    # Rows that repeat the winner's identifier: they can't be told apart by (id, digest).
    same = digests.join(winners, list(KEY)).where(F.col("id").eqNullSafe(F.col("keep_id")))
    same = cut(same.groupBy(*KEY, "keep_id").agg(F.count("*").alias("same")), "winners")
    text = F.coalesce(F.col(text_col), F.lit(""))
    clash = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in clash.items()], F.sha2(text.cast("binary"), 256).alias("digest"), F.xxhash64(text).alias("check"), F.octet_length(text).cast("long").alias("n_bytes"))
    hit = rows.join(same, [rows[k] == same[k] for k in KEY] + [rows[clash[id_col]].eqNullSafe(same["keep_id"])]).select(*clash.values(), rows["digest"], "same")
    once = hit.where("same = 1").select(*clash.values())
    repeated = hit.where("same > 1").dropDuplicates([clash[id_col], "digest"]).select(*clash.values())
    both = once.unionByName(repeated)
    return both.select(*[F.col(a).alias(c) for c, a in clash.items()])


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP9_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
