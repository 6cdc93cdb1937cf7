"""Attribution helpers: top-k of a contribution map (L2) and global importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_contributions(m: str | Column, k: int = 6) -> Column:
    """L2: the k entries of largest |value| (sign kept), ties in map order.  A pure
    array expression per row: no shuffle, no explode."""
    m = F.col(m) if isinstance(m, str) else m
    ranked = F.transform(F.map_entries(m), lambda e, i: F.struct(
        (-F.abs(e["value"])).alias("a"), i.alias("i"), e["key"].alias("key"), e["value"].alias("value")))
    top = F.slice(F.array_sort(ranked), 1, k)
    return F.map_from_entries(F.transform(top, lambda s: F.struct(s["key"], s["value"])))


def global_importance(df: DataFrame, m: str = "shap_values") -> DataFrame:
    """Mean |contribution| per feature, largest first.  ``explode`` then a
    partial (map-side) aggregation: the shuffle carries one row per feature per task."""
    e = df.select(F.explode(m).alias("feature", "value"))
    return (e.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs"))
             .orderBy(F.desc("mean_abs"), "feature"))
