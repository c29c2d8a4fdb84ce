"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash.  A source that gets r times its size takes floor(r) whole copies and, for the
fraction, the documents below a hash threshold (or, for more than half, all but those below one).  The threshold comes from a histogram of tokens by source and hash
bucket: the running sum finds the bucket in which the budget ends, and only that bucket is dealt into finer buckets,
four times, 15 bits each.  No documents are sorted.

What the document at the threshold would overshoot is a budget of its own: of the documents above it that are no larger
than this rest, those below a second threshold are taken, and so on (``rounds``), for sources whose rest is over
``tolerance`` of their target.  So a source with few and long documents comes near its target too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BITS, LEVELS = 15, 4


def n_words(text: str | Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``, from 0 by code point, null last; no task holds them all."""
    spark = sources.sparkSession
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = cut(dealt, "by-name")
    sizes = {r.part: r["count"] for r in dealt.groupBy("part").count().collect()}  # as many as shuffle partitions
    before, first = [], 0
    for part in sorted(sizes):
        before.append((part, first))
        first += sizes[part]
    offset = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("inside", inside).join(offset, "part").withColumn("rank", F.col("before") + F.col("inside") - 1).drop("part", "before", "inside")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3) -> DataFrame:
    """One row per source (skey): source_size, target.

    Sources by code point, null last, have the weights in turn and share the sum of all sizes; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight until none is above.  Each turn sums
    what is at its bound and what is open; the level rises with every turn, and ends after as many as bounds are met.
    """
    s = sized.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = _ranked(s).select("skey", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("cap"))
    s = cut(s, "sources")
    total, open_weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    level, at_bound = (total or 0) / (open_weight or 1.0), 0
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        n, size, weight = s.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == at_bound or not weight:
            break
        level, at_bound = (total - (size or 0.0)) / weight, n
    return s.select("skey", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def _threshold(rows: DataFrame, budgets: DataFrame, name: str) -> DataFrame:
    """(skey, at, left_over, step): rows (skey, size, h) below hash ``at`` fill the budget but for ``left_over``; those
    at it have ``step`` words, more than is left over (0 where all rows fit)."""
    edge = budgets.select("skey", F.lit(0).cast("long").alias("prefix"), "left_over", F.lit(0.0).alias("step"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        bucket = F.shiftrightunsigned(F.col("h"), shift)
        inside = rows.join(edge.select("skey", "prefix"), "skey").where(F.shiftrightunsigned(F.col("h"), shift + BITS) == F.col("prefix"))
        if level == 1:
            # The boundary buckets hold one row in 32768: the finer levels read these alone.
            rows = inside = cut(inside.select("skey", "size", "h"), name)
        cells = inside.groupBy("skey", bucket.alias("bucket")).agg(F.sum("size").cast("double").alias("words"))
        run = F.sum("words").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("upto", run).join(edge.select("skey", "left_over"), "skey")
        # The first bucket whose running sum passes the budget is the boundary; the ones before it are taken whole.
        past = F.when(F.col("upto") > F.col("left_over"), F.struct("bucket", "upto", "words"))
        found = cells.groupBy("skey").agg(F.min(past).alias("at"), F.first("left_over").alias("was"), F.max("bucket").alias("last"), F.max("upto").alias("all"))
        edge = found.select(
            "skey",
            F.coalesce(F.col("at.bucket"), F.col("last") + 1).alias("prefix"),
            F.coalesce(F.col("was") - (F.col("at.upto") - F.col("at.words")), F.col("was") - F.col("all")).alias("left_over"),
            F.coalesce(F.col("at.words"), F.lit(0.0)).alias("step"),
        )
        edge = cut(edge, name)
    return edge.withColumnRenamed("prefix", "at")


def mix_to_targets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, salt: str = "mix", rounds: int = 4, tolerance: float = 0.002) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words taken, repeats counted).

    Null texts have size 0, a null source is a source of its own, whole repeated rows share a hash and are taken
    together.  A source misses its target by ``tolerance`` of it at most, or by what its last round leaves: no more
    than half the smallest document (or group of rows with one hash) that stopped a round.  Empty table: empty result.
    Same input, same choice.
    """
    hash60 = F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.col(id_col), F.col(text_col)), 4)
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("skey"),
        n_words(text_col).alias("size"),
        hash60.alias("h"),
    )
    sized = cut(sized, "sizes")
    plan = source_targets(sized, weights, most)
    # Whole copies by division; what is left is the budget of the threshold.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut(plan.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))), "plan")
    # taken: stretches of hashes (from, below) with the largest size taken there; error: what the source then misses;
    # left_over: the budget of the next round, from hash ``next`` on.
    stretch = "array<struct<from:long,below:long,most:double>>"
    flip = F.col("rest") * 2 > F.col("source_size")
    budget = F.when(flip, F.col("source_size") - F.col("rest")).otherwise(F.col("rest"))
    state = plan.where("rest > 0").select("skey", "target", budget.alias("left_over"), F.lit(0).cast("long").alias("next"), F.array().cast(stretch).alias("taken"), budget.alias("error"), F.array().cast(stretch).alias("best"))
    narrow = sized.where("size > 0").select("skey", "size", "h")
    for k in range(rounds):
        going = state if k == 0 else state.where(F.col("left_over") > tolerance * F.col("target"))
        if k and not going.limit(1).count():
            break
        asked = going.select("skey", F.col("next").alias("from"), F.col("left_over").alias("most"))
        rows = narrow if k == 0 else narrow.join(asked, "skey").where("h >= from and size <= most").select("skey", "size", "h")
        edge = _threshold(rows, going.select("skey", "left_over"), f"edge{k}").select("skey", "at", F.col("left_over").alias("rest"), "step")
        most_here = F.lit(float("inf")) if k == 0 else F.col("left_over")
        upto = lambda end, m=most_here: F.concat(F.col("taken"), F.array(F.struct(F.col("next").alias("from"), end.alias("below"), m.alias("most"))))
        met = state.join(edge, "skey", "left")
        # The rows at the threshold come too where that is nearer to the target than anything so far.
        over = F.when((F.col("step") > 0) & (F.col("step") - F.col("rest") < F.least("error", "rest")), F.col("step") - F.col("rest"))
        without = F.when(F.col("rest") < F.col("error"), F.col("rest"))
        state = met.select(
            "skey",
            "target",
            F.coalesce(F.when(F.col("step") > 0, F.col("rest")), F.lit(0.0)).alias("left_over"),
            F.coalesce(F.col("at") + 1, F.col("next")).alias("next"),
            F.when(F.col("at").isNotNull(), upto(F.col("at"))).otherwise(F.col("taken")).alias("taken"),
            F.coalesce(over, without, F.col("error")).alias("error"),
            F.when(over.isNotNull(), upto(F.col("at") + 1)).when(without.isNotNull(), upto(F.col("at"))).otherwise(F.col("best")).alias("best"),
        )
        state = cut(state, f"state{k}")
    plan = plan.withColumn("flip", flip).join(state.select("skey", "best"), "skey", "left")
    below = F.exists("best", lambda b: (F.col("h") >= b["from"]) & (F.col("h") < b["below"]) & (F.col("size") <= b["most"]))
    picked = F.col("best").isNotNull() & (below != F.col("flip"))
    times = F.least(F.lit(most).cast("long"), F.col("whole") + picked.cast("long"))
    out = sized.join(plan, "skey")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents that the mix takes, with all their columns, and ``copies``: how often the mix takes each.

    Joined back by id; of rows that share an id, each keeps the number its own text got (the largest, if whole rows
    repeat).  A column ``copies`` that ``docs`` has already is replaced.
    """
    taken = mix_to_targets(docs.withColumn("__id", F.struct(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("x"), F.col(source_col).alias("s"))), id_col="__id", text_col=text_col, source_col=source_col, **how)
    taken = taken.where("taken > 0").groupBy("__id").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    taken = cut(taken.select(F.col("__id.i").alias("__i"), F.col("__id.x").alias("__x"), F.col("__id.s").alias("__s"), "copies"), "taken")
    on = docs[id_col].eqNullSafe(taken["__i"]) & (F.xxhash64(docs[text_col]) == taken["__x"]) & docs[source_col].eqNullSafe(taken["__s"])
    return docs.join(taken, on).select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() != "copies"], taken["copies"])


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(table(spark, sf_dir, "documents"))
