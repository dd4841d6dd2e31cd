"""Themes of a period: ids, cubes over weeks, policy areas, noise votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.functions.calendar import week_ordinals
from topicspark.operators.terms import majority

KNN, AGREE = 15, 0.5
OTHER_AREA = "weitere"


def sizes(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    return rows.filter(F.col(cluster) >= 0).groupBy(cluster).agg(F.count("*").alias("n"))


def ranked_themes(rows: DataFrame) -> DataFrame:
    """(cluster, theme, n): theme 0 is the largest cluster; of equal ones the lower id. The table has one row per cluster."""
    return sizes(rows).withColumn("theme", F.row_number().over(Window.orderBy(F.desc("n"), "cluster")) - 1)


def top_values(rows: DataFrame, group: str, value: str, order: str, k: int = 3) -> DataFrame:
    """(group, rank, value, n) of the commonest values; of equal ones the first seen."""
    n = rows.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("f"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "f"))
    return n.withColumn("rank", rank).filter(F.col("rank") <= k).select(group, "rank", value, "n")


def unassigned(rows: DataFrame, weeks: DataFrame) -> DataFrame:
    n = rows.groupBy("week").agg(F.count_if(F.col("theme") == -1).alias("unassigned"))
    return weeks.select("week").distinct().join(n, "week", "left").withColumn("unassigned", F.coalesce("unassigned", F.lit(0)))


def week_share(counts: DataFrame) -> DataFrame:
    whole = F.sum("n").over(Window.partitionBy("week"))
    return counts.withColumn("share", F.when(whole > 0, F.col("n") / whole).otherwise(0.0))


def strongest_weeks(counts: DataFrame, k: int = 3) -> DataFrame:
    """(theme, rank, week, n, peak)."""
    own = Window.partitionBy("theme").orderBy(F.desc("n"), "week")
    return counts.withColumns({"rank": F.row_number().over(own), "peak": F.first("week").over(own)}).filter(F.col("rank") <= k).select("theme", "rank", "week", "n", "peak")


def areas(terms: DataFrame, stems: DataFrame) -> DataFrame:
    """(theme, area): each term at rank r (from 0) of a theme's n terms gives n - r to every area with a stem that begins it; the
    most wins, of equal areas the one declared first. `stems` (area, area_order, stem) is a small table of the user's."""
    n = F.max("rank").over(Window.partitionBy("theme")) + 1
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("term"), F.lit(1))), lambda k: F.substr("term", F.lit(1), k)))
    begun = terms.withColumn("gain", n - F.col("rank")).withColumn("stem", cut)
    hits = begun.join(F.broadcast(stems), "stem").select("theme", "term", "rank", "gain", "area", "area_order").distinct()
    score = hits.groupBy("theme", "area", "area_order").agg(F.sum("gain").alias("score"))
    best = Window.partitionBy("theme").orderBy(F.desc("score"), "area_order")
    won = score.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("theme", "area")
    return terms.select("theme").distinct().join(won, "theme", "left").withColumn("area", F.coalesce("area", F.lit(OTHER_AREA)))


def area_totals(themes: DataFrame) -> DataFrame:
    return themes.groupBy("area").agg(F.count("*").alias("themes"), F.sum("n").alias("speeches"))


def noise_vote(near: DataFrame, k: int = KNN, agree: float = AGREE) -> DataFrame:
    """(id, theme) of noise rows whose `k` nearest core rows agree: `near` has id and theme, k rows per id (with fewer, none is
    changed). Of equal votes the lower theme."""
    n = near.groupBy("id", "theme").agg(F.count("*").alias("n"))
    best = Window.partitionBy("id").orderBy(F.desc("n"), "theme")
    x = n.withColumns({"rn": F.row_number().over(best), "all": F.sum("n").over(Window.partitionBy("id"))})
    return x.filter((F.col("rn") == 1) & (F.col("all") >= k) & (F.col("n") / k >= agree)).select("id", "theme")


def expanded(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Each row once per part of its speech; by its own id if the parts aren't known. `parts` has id and part_ids."""
    return rows.join(parts, "id", "left").withColumn("part_id", F.explode(F.coalesce("part_ids", F.array("id")))).drop("part_ids")


def week_summary(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(week, dates, speeches, topics): topics are the top-3 terms of each cluster, the largest first. `terms` has week, cluster
    and an array terms."""
    days = rows.groupBy("week").agg(F.array_sort(F.collect_set("date")).alias("dates"), F.count("*").alias("speeches"))
    n = rows.filter("cluster >= 0").groupBy("week", "cluster").agg(F.count("*").alias("n"))
    topics = n.join(terms, ["week", "cluster"]).groupBy("week").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "cluster", F.slice("terms", 1, 3).alias("t")))), lambda x: x["t"]).alias("topics"))
    return days.join(topics, "week", "left")


def theme_of(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """`rows` (week, id) with `theme`, that of `assigned` (week, id, theme) or else -1."""
    return rows.join(assigned.select("week", "id", "theme"), ["week", "id"], "left").withColumn("theme", F.coalesce("theme", F.lit(-1)))


def union_weeks(*tables: DataFrame) -> DataFrame:
    """Distinct weeks of all tables with `week_idx` from 0."""
    every = reduce(lambda a, b: a.union(b), [t.select("week").distinct() for t in tables])
    return week_ordinals(every)


def overview(assigned: DataFrame, points: DataFrame, described: DataFrame, stems: DataFrame) -> dict[str, DataFrame]:
    """What an index of the period shows, as tables: `cells` (theme, week, week_idx, n, focus), dense over the weeks of the model
    and of the built weeks, focus being the week's cluster that holds most of the cell's rows (null if none does; of equal ones
    that seen first); `themes`, `described` with its area; `weeks` (week, week_idx, unassigned).

    `assigned` has week, id and theme (-1 for none), `points` week, id and cluster, `described` theme, n and terms; `stems` is a
    small table of the user's."""
    weeks = union_weeks(assigned, points)
    placed = assigned.filter("theme >= 0").select("week", "id", "theme").join(points.select("week", "id", "cluster"), ["week", "id"], "left")
    n = placed.groupBy("theme", "week").agg(F.count("*").alias("n"))
    grid = described.select("theme").distinct().crossJoin(F.broadcast(weeks))
    focus = majority(placed, ["theme", "week"], "cluster", "id", F.col("cluster") >= 0).select("theme", "week", F.col("cluster").alias("focus"))
    cells = grid.join(n, ["theme", "week"], "left").join(focus, ["theme", "week"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = described.select("theme", F.posexplode("terms").alias("rank", "term"))
    named = described.join(areas(ranked, stems), "theme", "left").withColumn("area", F.coalesce("area", F.lit(OTHER_AREA)))
    return {"cells": cells, "themes": named, "weeks": weeks.join(unassigned(assigned, weeks), "week")}


def refreshed_overview(before: dict[str, DataFrame], assigned: DataFrame, points: DataFrame, described: DataFrame, stems: DataFrame, weeks: list[str]) -> dict[str, DataFrame]:
    """`overview` of an unchanged model after some weeks were built anew: their rows alone are read and counted, and the cells of other
    weeks are those of `before`, the overview's tables until now. Ordinals are given anew, as weeks may have come or gone."""
    some = lambda df: df.filter(F.col("week").isin(weeks))
    new = overview(some(assigned), some(points), described, stems)
    old = {n: before[n].filter(~F.col("week").isin(weeks)).drop("week_idx") for n in ("cells", "weeks")}
    both = {n: old[n].unionByName(new[n].drop("week_idx")) for n in old}
    ordinals = week_ordinals(both["weeks"])
    return {n: df.join(ordinals, "week").select(*before[n].columns) for n, df in both.items()} | {"themes": new["themes"]}


def index_tables(rows: DataFrame, week_clusters: DataFrame, shown: dict[str, DataFrame] | None = None, origins: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of the index page: `summaries` of the built weeks, and the overview's tables and the origins where there are any.
    `rows` has week, date and cluster, `week_clusters` week, cluster and terms."""
    return {"summaries": week_summary(rows, week_clusters)} | (shown or {}) | ({"origins": origins} if shown and origins is not None else {})
