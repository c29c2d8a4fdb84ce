"""Field-level patches between two versions of entities, and ordered diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def node_patches(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = ("x", "y", "width", "height")) -> DataFrame:
    """One row per changed field; a value that disappears is null."""
    o = old.select("graph_id", "node_id", *[F.col(f).alias(f"old_{f}") for f in fields])
    both = new.select("graph_id", "node_id", *fields).join(o, ["graph_id", "node_id"])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old"), F.col(f).alias("new")) for f in fields])
    return both.select("graph_id", "node_id", F.inline(rows)).where(~F.col("old").eqNullSafe(F.col("new")))


def merge_diffs(diffs: DataFrame) -> DataFrame:
    """(graph_id, id, seq, op, value) -> one net change an entity: added then removed cancels, removed then added is an
    update, anything else is its last value.  ``add`` of a present or ``remove`` of an absent entity is an error row."""
    per = diffs.groupBy("graph_id", "id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "value"))).alias("d"))
    first, last = F.element_at("d", 1), F.element_at("d", -1)
    wrong = F.exists(F.transform("d", lambda x, i: (i > 0) & F.when(x["op"] == "add", F.get("d", i - 1)["op"] != "remove").otherwise(F.get("d", i - 1)["op"] == "remove")), lambda x: x)
    net = F.when(wrong, "conflict").when((first["op"] == "add") & (last["op"] == "remove"), "none").when(first["op"] == "add", "add").when(last["op"] == "remove", "remove").otherwise("update")
    return per.select("graph_id", "id", net.alias("op"), F.when(net.isin("add", "update"), last["value"]).alias("value")).where("op <> 'none'")


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(graph_id, id, value) after net changes."""
    c = changes.select("graph_id", "id", "op", F.col("value").alias("new"))
    both = state.join(c, ["graph_id", "id"], "full_outer").where("op is null or op <> 'remove'")
    return both.select("graph_id", "id", F.when(F.col("op").isin("add", "update"), F.col("new")).otherwise(F.col("value")).alias("value"))
