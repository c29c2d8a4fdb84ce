"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of a document is addressed by the SHA-256 of its content.  The ledger (Parquet: blob, rule_version,
spans) says which blobs were scanned by which version of the rules.  A run scans only (blob, rule version) pairs that
it lacks, one representative row for a blob however many paths hold it, appends them, and joins the findings back
to all paths.  Ledger rows of clean blobs have no spans: they are remembered too.

Spans come from marks: a rule's matches are put between two control characters (text that has them already is
changed to a third one first, which no rule matches), and lengths of the parts give code-point offsets.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, path_exists, table

LEDGER_SCHEMA = "blob string, rule_version string, spans array<struct<start:int,kind:int,stop:int>>"
_CHUNK = 256
_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"


@dataclass(frozen=True)
class Rule:
    """Leftmost, non-overlapping matches of ``pattern`` (Java syntax) whose ``group`` has ``least`` characters or more.
    ``hint``: a text without it can't match (None: no such text is known)."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    hint: str | None = None


BASE_RULES = (
    Rule("assign", r"""((?i)(?:password|passwd|secret|token|api_?key))(?-i)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("signed_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*+", hint="eyJ"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("chat_hook", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
)


def rule_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, kind, stop>> of one rule; code points, stop exclusive."""
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    marked = F.regexp_replace(text, F.lit(rule.pattern), F.lit(f"{_OPEN}$0{_CLOSE}"))

    def step(state: Column, part: Column) -> Column:
        match = F.substring_index(part, _CLOSE, 1)
        length = F.char_length(match)
        kept = (F.char_length(F.regexp_extract(match, rule.pattern, rule.group)) if rule.group else length) >= rule.least
        span = F.struct(state["at"].alias("start"), F.lit(number).alias("kind"), (state["at"] + length).alias("stop"))
        return F.struct((state["at"] + F.char_length(part) - 1).alias("at"), F.when(kept, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    def behind(state: Column, c: Column) -> Column:
        moved = F.transform(c["found"], lambda x: F.struct((x["start"] + state["at"]).alias("start"), x["kind"].alias("kind"), (x["stop"] + state["at"]).alias("stop")))
        return F.struct((state["at"] + c["at"]).alias("at"), F.concat(state["found"], F.array(moved)).alias("found"))

    def folded(parts: Column) -> Column:
        """A fold copies its list for every match, so matches are folded in chunks, and lists of these."""
        chunk = lambda i: F.aggregate(F.slice(parts, i * _CHUNK + 2, F.lit(_CHUNK)), F.struct(F.lit(0).alias("at"), none.alias("found")), step)
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / _CHUNK).cast("int")), chunk)
        start = F.struct(F.char_length(F.element_at(parts, 1)).alias("at"), F.array().cast("array<array<struct<start:int,kind:int,stop:int>>>").alias("found"))
        return F.flatten(F.aggregate(chunks, start, behind, lambda s: s["found"]))

    found = F.get(F.transform(F.array(F.split(marked, _OPEN)), folded), F.lit(0))  # the parts are made once, as a lambda's variable
    possible = F.contains(text, F.lit(rule.hint)) if rule.hint else text.rlike(rule.pattern)
    return F.when(possible, found).otherwise(none)


def scan(text: Column, rules: tuple[Rule, ...]) -> Column:
    """All spans of a text by start, then rule."""
    safe = F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)
    return F.array_sort(F.concat(*[_spans(safe, r, n) for n, r in enumerate(rules)]))


def scan_versions(docs: DataFrame, *, ledger_path: str | None = None, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row (path or version): id, blob, spans (array of start, kind number, stop).

    Null texts count as empty and share its blob; repeated rows come out repeated; a second run over the same ledger
    scans nothing that it holds; an empty table appends nothing.  Without ``ledger_path`` the ledger is a new one in
    the shared folder.
    """
    spark, version = docs.sparkSession, rule_version(rules)
    ledger_path = ledger_path or new_path(spark, "ledger")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.sha2(text.cast("binary"), 256).alias("blob"))
    paths = cut(rows.select("id", "blob"), "paths")
    unseen = paths.groupBy("blob").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id")).alias("k"))
    if path_exists(spark, ledger_path):
        known = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path).where(F.col("rule_version") == version)
        unseen = unseen.join(known.select("blob"), "blob", "left_anti")
    unseen = cut(unseen.select(F.col("blob").alias("b"), F.col("k.id").alias("i")), "unseen")
    # By blob and id: only one row of a group of copies has a partner, and the copies spread over all tasks.
    todo = rows.join(unseen, (F.col("blob") == F.col("b")) & F.col("id").eqNullSafe(F.col("i")))
    todo.select("blob", F.lit(version).alias("rule_version"), scan(F.col("t"), rules).alias("spans")).write.mode("append").parquet(ledger_path)
    ledger = spark.read.schema(LEDGER_SCHEMA).parquet(ledger_path).where((F.col("rule_version") == version) & (F.size("spans") > 0))
    ledger = ledger.groupBy("blob").agg(F.max("spans").alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    return paths.join(ledger, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", none).alias("spans"))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = BASE_RULES + MORE_RULES
    found = scan_versions(table(spark, sf_dir, "documents"), rules=rules)
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_RULES))
    of_kind = lambda n: F.filter("spans", lambda s: s["kind"] == n)  # noqa: E731  (a second parameter would be the place in the array)
    counts = [F.size(of_kind(n)).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(_listed(base, rules).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans"), rules).alias("spans"))
