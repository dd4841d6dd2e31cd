"""Models of weeks and of the whole period, the tables made from them, and their rebuild.

Rows have id, week, text, vec and agenda. Every table stays flat (a row per point, cluster or part), so that no week or theme has to
fit in one row; tables of weeks are partitioned by week.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.functions import names
from topicspark.operators import corpus, density, neighbours, terms, themes
from topicspark.sources import snapshots, tables

WEEK_LEAST, PERIOD_LEAST = 8, 60
WEEK_TERMS, PERIOD_TERMS = 4, 6


def _texts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.col("id").alias("doc_id"), "text", "cluster")


def term_lists(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, terms) in order of rank."""
    return ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))


def week_model(rows: DataFrame, stopwords: list[str] = (), least: int = WEEK_LEAST, top: int = WEEK_TERMS) -> tuple[DataFrame, DataFrame]:
    """(week, id, cluster) and (week, cluster, n, terms, agenda) of all weeks in one job: clusters and vocabularies are each
    week's own; agenda is the commonest item of a cluster. Noise is cluster -1 and has no row in the second table."""
    found = tables.stored_alone(rows.sparkSession, lambda: density.density_clusters(rows.select("week", "id", "vec"), least, keys=("week",)))
    full = rows.select("week", "id", "text").join(found, ["week", "id"])
    listed = term_lists(terms.cluster_terms(_texts(full, "week"), stopwords, top, keys=("week",)), ["week", "cluster"])
    core = rows.select("week", "id", "agenda").join(found.filter("cluster >= 0"), ["week", "id"])
    n = core.groupBy("week", "cluster").agg(F.count("*").alias("n"))
    agenda = terms.majority(core, ["week", "cluster"], "agenda", "id").drop("n")
    clusters = n.join(listed, ["week", "cluster"], "left").join(agenda, ["week", "cluster"], "left")
    return found, clusters.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def period_model(rows: DataFrame, stopwords: list[str] = (), least: int = PERIOD_LEAST, top: int = PERIOD_TERMS, dims: int = 5) -> tuple[DataFrame, DataFrame]:
    """(id, week, theme) and (theme, n, terms, agendas): clusters of the reduced vectors, with noise rows given to the theme on
    which their nearest core rows agree. Themes are numbered by size and described after that; theme -1 is what stays noise."""
    space = density.reduced(rows.select("id", "vec"), dims).select("id", "vec")
    space = tables.stored(space)
    found = tables.stored_alone(space.sparkSession, lambda: density.density_clusters(space, least))

    def settled() -> DataFrame:
        core, noise = (space.join(found.filter(c), "id", "left_semi") for c in ("cluster >= 0", "cluster < 0"))
        near = neighbours.boxed_nearest(noise, core, themes.KNN).select("id", "near_id")
        voted = themes.noise_vote(near.join(found.select(F.col("id").alias("near_id"), F.col("cluster").alias("theme")), "near_id"))
        given = found.join(voted, "id", "left").select("id", F.coalesce("theme", "cluster").alias("cluster"))
        return rows.select("id", "week", "agenda").join(given, "id")

    full = tables.stored_alone(space.sparkSession, settled)
    ranked = themes.ranked_themes(full)
    # texts are as large as all else together: they are met once, and not written again
    listed = term_lists(terms.cluster_terms(_texts(rows.select("id", "text").join(full.select("id", "cluster"), "id")), stopwords, top), ["cluster"])
    titles = themes.top_values(full.filter("cluster >= 0"), "cluster", "agenda", "id")
    titles = titles.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "agenda"))), lambda x: x["agenda"]).alias("agendas"))
    described = ranked.join(listed, "cluster", "left").join(titles, "cluster", "left").select("theme", "n", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), "agendas")
    return full.join(ranked.select("cluster", "theme"), "cluster", "left").select("id", "week", F.coalesce("theme", F.lit(-1)).alias("theme")), described


def week_points(rows: DataFrame, clusters: DataFrame, layout: DataFrame, near: DataFrame) -> DataFrame:
    """A row for each point of each week: the row's own columns but its text and vector, its cluster, place and similar ids, and
    `next`, the first speech after it, where rows have start and end. `near` is the nearest neighbours within each week; points
    without any have an empty list."""
    similar = neighbours.neighbour_lists(near)
    own = rows.drop("text", "vec")
    if {"start", "end"} <= set(own.columns):
        own = corpus.following(own, ["week"])
    out = own.join(clusters, ["week", "id"]).join(layout, "id", "left").join(similar, "id", "left")
    return out.withColumns({"x": F.bround("x", 3), "y": F.bround("y", 3), "similar": F.coalesce("near_ids", F.array().cast(dict(similar.dtypes)["near_ids"]))}).drop("near_ids")


def labelled_parts(assigned: DataFrame, described: DataFrame, parts: DataFrame, on: list[str], acronyms: list[str] = ()) -> DataFrame:
    """(part_id, `on`, label) for every part of each assigned row: `assigned` has id and `on`, the last of which is the cluster or
    theme; noise (below 0) is left out. A row whose parts aren't known stands under its own id."""
    label: Column = names.topic_label(F.col("terms"), list(acronyms))
    kept = assigned.filter(F.col(on[-1]) >= 0).join(described.select(*on, label.alias("label")), on)
    return themes.expanded(kept.select("id", *on, "label"), parts).select("part_id", *on, "label")


def rebuild(rows: DataFrame, parts: DataFrame, path: str, weeks: list[str] | None = None, overview: bool = True, *, embed: Callable[[DataFrame], DataFrame] | None = None, encoder: str = "", stopwords: list[str] = (), acronyms: list[str] = (), stems: DataFrame | None = None, decisions: DataFrame | None = None, least: tuple[int, int] = (WEEK_LEAST, PERIOD_LEAST), k: int = 5, floor: float = 0.88, dims: int = 5, keep: int = 2) -> int:
    """Writes a new version of the tables below `path` (read by `snapshots.read_snapshot`): week_clusters, week_points and (of
    `decisions` by agenda) week_decisions of the chosen weeks (others stay as they are), and with `overview` speech_themes of the
    period's model (taken up again if rows and parameters are as before) and, with `stems`, overview_cells, overview_themes and
    overview_weeks. Only a run over all weeks replaces speech_neighbours. Readers see all of it at once, when the last table is
    complete, or none of it; `keep` versions stay. The number of the version.

    `embed` gives rows their vectors where they have none yet, and `encoder` is the key of what it computes."""
    spark = rows.sparkSession
    version, before = snapshots.Version(spark, path), set(tables.made_folders(spark))
    with_vectors = (lambda df: df) if embed is None or "vec" in rows.columns else embed
    chosen = with_vectors(rows if weeks is None else rows.filter(F.col("week").isin(weeks)))
    found, clusters = week_model(chosen, stopwords, least[0])
    # few weeks have most of the work: not dealt by their bytes
    near = tables.stored(neighbours.nearest(chosen.select("week", "id", "vec"), chosen.select("week", "id", "vec"), k, keys=("week",), tasks=4 * spark.sparkContext.defaultParallelism))
    version.write_weeks("week_points", week_points(chosen, found, density.plane_map(chosen.select("id", "vec"), near), near), weeks)
    version.write_weeks("week_clusters", clusters, weeks)
    if decisions is not None:
        items = chosen.select("week", F.col("agenda").alias("agenda_item_id")).distinct()
        version.write_weeks("week_decisions", items.join(decisions, "agenda_item_id"), weeks)
    if overview:

        def build(all_rows: DataFrame) -> dict[str, DataFrame]:
            assigned, described = period_model(with_vectors(all_rows), stopwords, least[1], dims=dims)
            assigned = tables.stored(assigned)
            return {"assigned": assigned, "themes": described}

        params = {"least": least[1], "stopwords": sorted(stopwords), "encoder": encoder, "dims": dims, "terms": PERIOD_TERMS}
        model, anew = tables.build_if_changed(rows, params, f"{path}/period", build)
        version.write("speech_themes", labelled_parts(model["assigned"], model["themes"], parts, ["theme"], acronyms))
        if stems is not None:
            given = (model["assigned"], version.read("week_points"), model["themes"], stems)
            names = ("cells", "themes", "weeks")
            if weeks is None or anew or not all((f"overview_{n}", "") in version.held for n in names):
                shown = themes.overview(*given)
            else:
                shown = themes.refreshed_overview({n: version.read(f"overview_{n}") for n in names}, *given, weeks)
            for name, table in shown.items():
                version.write(f"overview_{name}", table)
    if weeks is None:
        v = chosen.select("id", "vec", F.col("agenda").alias("grp"))
        lists = neighbours.neighbour_lists(neighbours.pruned_nearest(v, v, k, floor=floor))
        version.write("speech_neighbours", themes.expanded(lists, parts).select("part_id", "near_ids"))
    number = version.commit()
    snapshots.clean(spark, path, keep)
    tables.clear_stored(spark, [p for p in tables.made_folders(spark) if p not in before])
    return number


def speech_clusters(spark: SparkSession, path: str, parts: DataFrame, acronyms: list[str] = ()) -> DataFrame:
    """(part_id, week, cluster, label) of every part from the week tables below `path`."""
    points, clusters = snapshots.read_snapshot(spark, path, "week_points"), snapshots.read_snapshot(spark, path, "week_clusters")
    return labelled_parts(points.select("id", "week", "cluster"), clusters, parts, ["week", "cluster"], acronyms)
