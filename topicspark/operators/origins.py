"""When topics came up, and who brought them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.functions import names
from topicspark.sources.tables import stored

ACTIVE_SHARE, GAP, LOOKBACK, LISTED = 0.04, 4, 8, 12


def dense(cells: DataFrame, themes: DataFrame, weeks: DataFrame, value: str) -> DataFrame:
    """A row for every theme and week, 0 where there is none. Themes and weeks are small tables of names."""
    grid = themes.select("theme").distinct().crossJoin(F.broadcast(weeks.select("week", "week_idx").distinct()))
    return grid.join(cells.select("theme", "week", value), ["theme", "week"], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def weekly_shares(rows: DataFrame, weeks: DataFrame, themes: DataFrame, amount: str = "words") -> DataFrame:
    """(theme, week, week_idx, share): part of all the week's words, unassigned (-1) ones counted; 0 in an empty week."""
    cells = rows.filter("theme >= 0").groupBy("theme", "week").agg(F.sum(amount).alias("own"))
    total = rows.groupBy("week").agg(F.sum(amount).alias("all"))
    out = dense(cells, themes, weeks, "own").join(total, "week", "left")
    return out.select("theme", "week", "week_idx", F.coalesce(F.col("own") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0)).alias("share"))


def episodes(shares: DataFrame, threshold: float | Column = ACTIVE_SHARE, gap: int = GAP, keys: tuple[str, ...] = ("theme",)) -> DataFrame:
    """(keys, episode, start, end, peak, share, period_start): runs of active weeks, with the largest and the first week's share, broken by `gap` or more inactive ones; the first is
    at the period's start if it begins before the gap could be seen."""
    order = Window.partitionBy(*keys).orderBy("week_idx")
    active = shares.filter(F.col("share") >= threshold).withColumn("prev", F.lag("week_idx").over(order))
    new = (F.col("prev").isNull() | (F.col("week_idx") - F.col("prev") - 1 >= gap)).cast("int")
    marked = active.withColumn("episode", F.sum(new).over(order) - 1)
    out = marked.groupBy(*keys, "episode").agg(F.min("week_idx").alias("start"), F.max("week_idx").alias("end"), F.max("share").alias("peak"), F.min_by("share", "week_idx").alias("share"))
    return out.withColumn("period_start", (F.col("episode") == 0) & (F.col("start") < gap))


def episode_sweep(shares: DataFrame, thresholds: list[float], gap: int = GAP) -> DataFrame:
    """(threshold, episodes, at_start): how many episodes each threshold gives."""
    marked = shares.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    found = episodes(marked, F.col("threshold"), gap, ("threshold", "theme"))
    return found.groupBy("threshold").agg(F.count("*").alias("episodes"), F.count_if("period_start").alias("at_start"))


def main_themes(rows: DataFrame) -> DataFrame:
    """(agenda, theme): the commonest theme of each agenda item, -1 competing; of equal ones the lower."""
    n = rows.filter(F.coalesce(F.col("agenda").cast("string"), F.lit("")) != "").groupBy("agenda", "theme").count()
    best = Window.partitionBy("agenda").orderBy(F.desc("count"), "theme")
    return n.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("agenda", "theme")


def initiators(papers: DataFrame, bridge: DataFrame, processes: DataFrame, name) -> DataFrame:
    """(number, names): the initiators of a paper's processes in order of process id, else its own originators; normalised by the
    column function `name`, each once."""
    met = papers.join(bridge, papers["id"] == bridge["paper_id"], "left").join(processes.select(F.col("id").alias("process_id"), "initiators"), "process_id", "left")
    own = F.transform(F.array_sort(F.collect_list(F.when(F.col("initiators").isNotNull(), F.struct("process_id", "initiators")))), lambda x: x["initiators"])
    each = met.groupBy("number").agg(F.flatten(own).alias("of"), F.first("originators").alias("own"))
    return each.select("number", F.array_distinct(F.transform(F.when(F.size("of") > 0, F.col("of")).otherwise(F.coalesce("own", F.array().cast("array<string>"))), name)).alias("names"))


def per_originator(items: DataFrame) -> DataFrame:
    """(originator, n) over items with an array `names`, each counted once per item."""
    return items.select(F.explode(F.array_distinct("names")).alias("originator")).groupBy("originator").agg(F.count("*").alias("n"))


def lookback(found: DataFrame, rows: DataFrame, back: int = LOOKBACK, keys: tuple[str, ...] = ("theme", "episode")) -> DataFrame:
    """Rows of the `back` weeks before each episode: an equi-join on the week, each episode's range being `back` rows."""
    spans = found.filter("NOT period_start").select(*[F.col(k).alias(f"of_{k}") for k in keys], F.explode(F.sequence(F.greatest(F.col("start") - back, F.lit(0)), F.col("start") - 1)).alias("week_idx"))
    return spans.join(rows, "week_idx")


def with_main(rows: DataFrame, main: DataFrame) -> DataFrame:
    """`rows` with `main`, the main theme of their agenda item, or -1; rows that have it already as they are."""
    return rows if "main" in rows.columns else rows.join(main.select("agenda", F.col("theme").alias("main")), "agenda", "left").withColumn("main", F.coalesce("main", F.lit(-1)))


def of_first_weeks(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of weeks in which an episode begins."""
    return rows.join(found.select(F.col("start").alias("week_idx")).distinct(), "week_idx", "left_semi")


def unprompted(found: DataFrame, rows: DataFrame, main: DataFrame, back: int = LOOKBACK) -> DataFrame:
    """(theme, episode, fraction, n, of): of all rows of a fraction in the look-back, those on the theme under an agenda item
    whose main theme is another."""
    rows = with_main(rows, main)
    hit = (F.col("theme") == F.col("of_theme")) & (F.col("main") != F.col("of_theme"))
    out = lookback(found, rows, back).groupBy("of_theme", "of_episode", "fraction").agg(F.count_if(hit).alias("n"), F.count("*").alias("of"))
    return out.filter("n > 0").select(F.col("of_theme").alias("theme"), F.col("of_episode").alias("episode"), "fraction", "n", "of")


def unprompted_listed(found: DataFrame, rows: DataFrame, main: DataFrame, back: int = LOOKBACK, listed: int = LISTED) -> DataFrame:
    """The first such rows of each episode in speaking order."""
    rows = with_main(rows, main)
    met = lookback(found, rows, back).filter((F.col("theme") == F.col("of_theme")) & (F.col("main") != F.col("of_theme")))
    rank = F.row_number().over(Window.partitionBy("of_theme", "of_episode").orderBy("week_idx", "id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= listed).select(F.col("of_theme").alias("theme"), F.col("of_episode").alias("episode"), "rank", "id")


def formal(found: DataFrame, rows: DataFrame, main: DataFrame) -> DataFrame:
    """(theme, episode, agenda): items of an episode's first week whose main theme it is."""
    items = of_first_weeks(rows.select("agenda", "week_idx"), found).distinct().join(main, "agenda")
    return found.select("theme", "episode", F.col("start").alias("week_idx")).join(items, ["theme", "week_idx"]).select("theme", "episode", "agenda")


def formal_items(found: DataFrame, rows: DataFrame, main: DataFrame, agenda: DataFrame | None = None, papers: DataFrame | None = None) -> DataFrame:
    """(theme, episode, agenda, title, date, originators, requested, papers): the formal items with who brought them: the fractions
    that asked for a topical debate, then the initiators of the papers in their order, each once.

    Title and date are those of the item's first row in that week. `agenda` has agenda, raw_title and numbers (array); an item that
    it lacks has the row's own `numbers`, if there are any, and no raw title. `papers` has number and names, as `initiators` gives
    them, and what else is to be shown; numbers that it lacks are left out."""
    optional = {"title": "string", "date": "string", "numbers": "array<string>"}
    rows = rows.withColumns({n: F.lit(None).cast(t) for n, t in optional.items() if n not in rows.columns})
    first = of_first_weeks(rows, found).groupBy("week_idx", "agenda").agg(F.min_by(F.struct("title", "date", "numbers"), "id").alias("f"))
    items = formal(found, rows, main).join(found.select("theme", "episode", F.col("start").alias("week_idx")), ["theme", "episode"]).join(first, ["week_idx", "agenda"])
    raw = (rows.sparkSession.createDataFrame([], f"agenda {dict(rows.dtypes)['agenda']}, raw_title string, numbers array<string>") if agenda is None else agenda).select("agenda", F.struct("raw_title", "numbers").alias("raw"))
    items = items.join(raw, "agenda", "left").select("theme", "episode", "agenda", "f.title", "f.date", names.requested_by(F.col("raw.raw_title")).alias("requested"), F.coalesce(F.when(F.col("raw").isNotNull(), F.coalesce("raw.numbers", F.array().cast("array<string>"))), "f.numbers", F.array().cast("array<string>")).alias("numbers"))
    if papers is None:
        papers = rows.sparkSession.createDataFrame([], "number string, names array<string>")
    told = items.select("theme", "episode", "agenda", F.posexplode("numbers").alias("pos", "number")).join(papers.select("number", F.col("names").alias("originators"), *[c for c in papers.columns if c not in ("number", "names")]), "number")
    each = told.groupBy("theme", "episode", "agenda").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("number", *[c for c in told.columns if c not in ("theme", "episode", "agenda", "pos", "number")]).alias("paper")))), lambda x: x["paper"]).alias("papers"))
    out = items.drop("numbers").join(each, ["theme", "episode", "agenda"], "left")
    tabled = F.coalesce(F.flatten(F.transform("papers", lambda x: x["originators"])), F.array().cast("array<string>"))
    return out.withColumn("originators", F.array_distinct(F.concat(F.coalesce("requested", F.array().cast("array<string>")), tabled)))


def origins(shares: DataFrame, rows: DataFrame, threshold: float = ACTIVE_SHARE, gap: int = GAP, back: int = LOOKBACK, agenda: DataFrame | None = None, papers: DataFrame | None = None) -> DataFrame:
    """One row per theme with its episodes, each with its formal items, how many each originator brought, and, unless at the
    period's start, the unprompted mentions: per fraction, in all, and the first LISTED of them."""
    # all are looked at several times
    found, main = stored(episodes(shares, threshold, gap)), stored(main_themes(rows))
    rows = stored(with_main(rows, main))
    brought = formal_items(found, rows, main, agenda, papers)
    items = brought.groupBy("theme", "episode").agg(F.array_sort(F.collect_list(F.struct("agenda", "title", "date", "originators", "requested", "papers"))).alias("formal"))
    by = brought.select("theme", "episode", F.explode("originators").alias("originator")).groupBy("theme", "episode", "originator").agg(F.count("*").alias("n"))
    by = by.groupBy("theme", "episode").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "originator", "n"))), lambda x: F.struct(x["originator"].alias("originator"), x["n"].alias("n"))).alias("by_originator"))
    said = unprompted(found, rows, main, back).groupBy("theme", "episode").agg(F.array_sort(F.collect_list(F.struct("fraction", "n", "of"))).alias("unprompted"), F.sum("n").alias("n_unprompted"))
    listed = unprompted_listed(found, rows, main, back).groupBy("theme", "episode").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("listed"))
    each = found
    for more in (items, by, said, listed):
        each = each.join(more, ["theme", "episode"], "left")
    return each.groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("episode", "start", "end", F.bround("share", 3).alias("share"), "period_start", "formal", "by_originator", "unprompted", F.when(~F.col("period_start"), F.coalesce("n_unprompted", F.lit(0))).alias("n_unprompted"), "listed"))).alias("episodes"))
