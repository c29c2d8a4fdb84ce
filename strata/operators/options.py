"""Options as rows: scopes that override each other, long and short names, values by default."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_name(name: Column) -> Column:
    """The last part of a dotted name."""
    return F.substring_index(name, ".", -1)


def merged_options(options: DataFrame, scopes: Sequence[str]) -> DataFrame:
    """(graph_id, scope, name, value) -> one value per graph and short name: that of the first of ``scopes`` that sets
    it; in one scope the name with fewer dots wins, then the lesser name.  Options of other scopes don't count."""
    rank = F.array_position(F.array(*map(F.lit, scopes)), F.col("scope"))
    dots = F.size(F.split("name", r"\."))
    best = F.min_by(F.struct("value", "scope"), F.struct(rank.alias("r"), dots.alias("d"), F.col("name").alias("n")))
    out = options.where(rank > 0).groupBy("graph_id", short_name(F.col("name")).alias("option")).agg(best.alias("b"))
    return out.select("graph_id", "option", "b.value", "b.scope")


def with_defaults(merged: DataFrame, graphs: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """(graph_id, option, value, is_default) for every graph and every option that has a default."""
    names = F.array(*[F.struct(F.lit(k).alias("option"), F.lit(v).alias("fallback")) for k, v in sorted(defaults.items())])
    every = graphs.select("graph_id").distinct().select("graph_id", F.inline(names))
    return every.join(merged.select("graph_id", "option", "value"), ["graph_id", "option"], "left").select("graph_id", "option", F.coalesce("value", "fallback").alias("value"), F.col("value").isNull().alias("is_default"))
