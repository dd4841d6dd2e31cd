"""Cutting a corpus: split turns re-joined, interruptions marked, optional tables joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.functions import calendar, names
from topicspark.functions.text import string_list
from topicspark.sources.tables import not_kind, stored

MIN_CHARS = 500
#: Words of the main speaker after which the same person interrupts anew, and paragraphs in which an announcement counts.
NEW_AFTER, LAST_PARAGRAPHS = 30, 6
ANNOUNCED = "Kurzintervention|Zwischenbemerkung"
#: Kinds of paragraphs that stand for another speech.
MARKERS = ("zwischenfrage", "kurzintervention", "antwort")


def joined_parts(parts: DataFrame, sittings: DataFrame, agenda: DataFrame) -> DataFrame:
    """Parts with their sitting (inner) and agenda item (left)."""
    return parts.join(sittings, "sitting_id").join(agenda, "agenda_item_id", "left")


def joined_paragraphs(paragraphs: DataFrame, parts: DataFrame, sittings: DataFrame) -> DataFrame:
    """Paragraphs (speech_id, and their own columns) with their part and its sitting (both inner). `parts` has id and sitting_id;
    columns of the paragraphs come first where names clash."""
    own = paragraphs.columns
    p = parts.withColumnRenamed("id", "speech_id")
    x = paragraphs.join(p.select("speech_id", *[c for c in p.columns if c not in own]), "speech_id")
    return x.join(sittings.select("sitting_id", *[c for c in sittings.columns if c not in x.columns]), "sitting_id")


def weeks_of(sittings: DataFrame, speeches: DataFrame) -> DataFrame:
    """(week, sittings in date order, speeches): sittings without a speech count 0. `sittings` has sitting_id, number, date and
    week."""
    n = speeches.groupBy("sitting_id").count()
    each = sittings.join(n, "sitting_id", "left").withColumn("n", F.coalesce("count", F.lit(0)))
    order = F.transform(F.array_sort(F.collect_list(F.struct("date", "number"))), lambda x: x["number"])
    return each.groupBy("week").agg(order.alias("sittings"), F.sum("n").alias("speeches"))


def rejoined(parts: DataFrame, keys: list[str], order: str, text: str, part_id: str, first: list[str]) -> DataFrame:
    """One row per `keys`: texts joined by a blank line in order, part ids, start, end, and `first` from the first part."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(part_id).alias("id"), F.col(text).alias("text"))))
    out = parts.groupBy(*keys).agg(pieces.alias("p"), *[F.min_by(c, order).alias(c) for c in first])
    return out.select(*keys, *first, F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), F.transform("p", lambda x: x["id"]).alias("part_ids"), F.get("p", F.lit(0))["o"].alias("start"), F.element_at("p", -1)["o"].alias("end"))


def n_comments(paragraphs: Column) -> Column:
    return F.size(F.filter(paragraphs, lambda p: p["kind"] == "comment"))


def kept(text: Column, interruption: Column, least: int = MIN_CHARS) -> Column:
    return (F.length(text) >= least) | interruption


def included(kind: Column, interruption: Column) -> Column:
    """Rows that count for the period: no question time and no interruption; a null kind is included."""
    return ~kind.eqNullSafe("befragung") & ~F.coalesce(interruption, F.lit(False))


def interruptions(parts: DataFrame, turns: Column | None = None) -> DataFrame:
    """`parts` (rede_id, position, person_id, part_id, text, chair: array of the chair's words by paragraph) with `interruption`
    and `interruption_start`.

    A part by someone else right after the main speaker interrupts: as announced by the chair in the last paragraphs before, else
    a question. The same person again within NEW_AFTER words of the main speaker continues the earlier one, as does one who
    follows another interrupter; none where `turns` holds."""
    rede = Window.partitionBy("rede_id").orderBy("position")
    whole = rede.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = F.lit(False) if turns is None else F.coalesce(turns, F.lit(False))
    x = parts.withColumns({"main": F.first("person_id").over(rede), "n_words": F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != ""))})
    x = x.withColumn("own", (F.col("person_id") == F.col("main")) | turns)
    # words of the main speaker's run before: runs are numbered by what interrupts right after the main speaker
    x = x.withColumns({"after_main": ~F.col("own") & (F.lag("person_id").over(rede) == F.col("main"))})
    x = x.withColumn("run", F.sum(F.col("after_main").cast("int")).over(whole))
    run = Window.partitionBy("rede_id", "run").orderBy("position")
    x = x.withColumn("run_words", F.sum(F.when(F.col("own"), F.col("n_words")).otherwise(0)).over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    before = F.coalesce(F.lag("run_words").over(rede), F.lit(0))
    announced = F.array_join(F.slice(F.lag("chair").over(rede), F.greatest(F.size(F.lag("chair").over(rede)) - LAST_PARAGRAPHS + 1, F.lit(1)), LAST_PARAGRAPHS), " ").rlike(ANNOUNCED)
    x = x.withColumns({"before": before, "announced": F.coalesce(announced, F.lit(False))})
    one = Window.partitionBy("rede_id", "person_id", "own").orderBy("position")
    first = F.row_number().over(one) == 1
    opens = ~F.col("own") & (first | F.col("after_main") & (F.col("before") >= NEW_AFTER))
    kind = F.when(F.col("after_main") & F.col("announced"), "kurzintervention").otherwise("zwischenfrage")
    x = x.withColumn("opened", F.when(opens, F.struct(kind.alias("kind"), F.col("part_id").alias("start"))))
    last = F.last("opened", ignorenulls=True).over(one.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("held", F.when(~F.col("own"), last))
    return x.select(*parts.columns, F.col("held.kind").alias("interruption"), F.col("held.start").alias("interruption_start"))


def markers(parts: DataFrame) -> DataFrame:
    """(rede_id, position, in_person, kind, target): where someone else starts to interrupt the main speaker, in the main
    speech before that place; and at the end of every other speech of the rede a marker back to the main one. `parts` has the
    columns of `interruptions`; targets are heads, the first part of each (rede, person)."""
    rede = Window.partitionBy("rede_id").orderBy("position")
    x = parts.withColumns({"main": F.first("person_id").over(rede), "main_head": F.first("part_id").over(rede), "before": F.lag("person_id").over(rede)})
    x = x.withColumn("head", F.first("part_id").over(Window.partitionBy("rede_id", "person_id").orderBy("position")))
    starts = x.filter((F.col("before") == F.col("main")) & (F.col("person_id") != F.col("main")) & (F.col("interruption_start") == F.col("part_id")))
    into = starts.select("rede_id", "position", F.col("main").alias("in_person"), F.col("interruption").alias("kind"), F.col("head").alias("target"))
    others = x.filter(F.col("person_id") != F.col("main")).groupBy("rede_id", "person_id").agg(F.max("position").alias("position"), F.first("main_head").alias("target"))
    return into.unionByName(others.select("rede_id", "position", F.col("person_id").alias("in_person"), F.lit("antwort").alias("kind"), "target"))


def load_weeks(parts: DataFrame, sittings: DataFrame, agenda: DataFrame, paragraphs: DataFrame, photos: DataFrame | None = None, least: int = MIN_CHARS) -> DataFrame:
    """Speeches of all weeks: split parts re-joined per (rede, person), with paragraphs and markers in speaking order, short units
    dropped, and what was dropped but is referred to in `linked`.

    `parts` has id, sitting_id, agenda_item_id, position, person_id, speaker_name, speaker_group, member_fraction, speaker_role, text,
    source_document_id, rede_id, interruption, interruption_start and maybe kind; `sittings` sitting_id, date, pdf_url; `agenda`
    agenda_item_id, top_id, title, drucksache_numbers (JSON), kind; `paragraphs` speech_id, position, kind, text. Without `photos`
    (person_id, credit) everyone has a portrait. A part without an agenda item has a null title and no papers; one without a rede_id
    belongs to no speech and is left out."""
    item = agenda.select("agenda_item_id", "top_id", F.col("title").alias("raw_title"), "drucksache_numbers", F.col("kind").alias("agenda_kind"))
    p = joined_parts(not_kind(parts).filter("rede_id IS NOT NULL"), sittings, item).withColumn("week", calendar.week_id(F.to_date("date")))
    rede = Window.partitionBy("week", "rede_id").orderBy("date", "position")
    own = Window.partitionBy("week", "rede_id", "person_id").orderBy("date", "position")
    p = p.withColumns({"main": F.first("person_id").over(rede), "main_id": F.first("id").over(rede), "before": F.lag("person_id").over(rede), "head": F.first("id").over(own)})
    other = F.col("person_id") != F.col("main")

    # what a speech holds, in order: paragraphs, where someone starts to interrupt the main speaker, and the way back at the end
    said = p.select("week", "rede_id", "id", F.struct("date", "position").alias("at"), "head", "main_id", "interruption", other.alias("other"), (other & (F.col("before") == F.col("main")) & (F.col("interruption_start") == F.col("id"))).alias("starts"))

    def lines(of: DataFrame, head: str, rank: int, place: Column, kind: Column, text: str) -> DataFrame:
        return of.select("week", "rede_id", F.col(head).alias("id"), F.struct("at", F.lit(rank).alias("rank"), place.cast("long").alias("place"), F.struct(kind.alias("kind"), F.col(text).alias("text")).alias("line")).alias("x"))

    none = F.lit(0)
    own_lines = said.join(paragraphs.select(F.col("speech_id").alias("id"), F.col("position").alias("place"), "kind", "text"), "id")
    back = said.filter("other").groupBy("week", "rede_id", "head", "main_id").agg(F.max("at").alias("at"))
    every = lines(own_lines, "head", 1, F.col("place"), F.col("kind"), "text").unionByName(lines(said.filter("starts"), "main_id", 0, none, F.col("interruption"), "head")).unionByName(lines(back, "head", 2, none, F.lit("antwort"), "main_id"))
    held = every.groupBy("week", "rede_id", "id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("paragraphs"))

    first = F.min(F.struct("date", "position", "id", "speaker_name", "speaker_group", "member_fraction", "agenda_kind", "speaker_role", "top_id", "agenda_item_id", "raw_title", "drucksache_numbers", "pdf_url", "source_document_id", (other & F.coalesce(F.col("interruption") == "zwischenfrage", F.lit(False))).alias("asks"))).alias("f")
    pieces = F.array_sort(F.collect_list(F.struct("date", "position", "id", "text"))).alias("p")
    speeches = p.groupBy("week", "rede_id", "person_id").agg(first, pieces).select(
        "week", "rede_id", "person_id", F.col("f.id").alias("id"), F.col("f.date").alias("date"), names.display_name(F.col("f.speaker_name")).alias("speaker"), names.recoded_group(F.col("f.speaker_group")).alias("fraction"),
        F.col("f.member_fraction").alias("member_fraction"), F.col("f.speaker_role").alias("role"), F.col("f.top_id").alias("top_id"), F.col("f.agenda_item_id").alias("agenda_item_id"), names.short_title(F.col("f.raw_title"), F.col("f.top_id")).alias("agenda_title"),
        F.col("f.agenda_kind").alias("agenda_kind"), string_list(F.col("f.drucksache_numbers")).alias("drucksachen"), F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\n\n").alias("text"), F.col("f.pdf_url").alias("pdf_url"), F.col("f.source_document_id").alias("source_document_id"),
        F.transform("p", lambda x: x["id"]).alias("part_ids"), F.struct("f.date", "f.position").alias("start"), F.struct(F.element_at("p", -1)["date"].alias("date"), F.element_at("p", -1)["position"].alias("position")).alias("end"), F.col("f.asks").alias("zwischenfrage"),
    )
    speeches = speeches.join(held, ["week", "rede_id", "id"], "left").withColumn("paragraphs", F.coalesce("paragraphs", F.expr("CAST(array() AS array<struct<kind:string,text:string>>)")))
    # looked at twice: what stays, and what was dropped but is the target of a marker in it
    speeches = stored(speeches)
    stays = kept(F.col("text"), F.col("zwischenfrage"), least)
    marks = said.filter("starts").select(F.col("main_id").alias("host"), F.col("head").alias("target")).union(back.select("head", "main_id"))
    found = linked(marks, speeches.filter(~stays).select("id", F.struct("speaker", "fraction", "paragraphs").alias("value"))).withColumnRenamed("host", "id")
    out = speeches.filter(stays).join(found, "id", "left").withColumn("linked", F.coalesce("linked", F.create_map().cast(found.schema["linked"].dataType)))
    return with_photo(out, photos).withColumns({"comments": n_comments(F.col("paragraphs")), "chars": F.length("text")})


def with_photo(people: DataFrame, photos: DataFrame | None, key: str = "person_id") -> DataFrame:
    """`photo` and `photo_credit`; true for everyone without a photo table."""
    if photos is None:
        return people.withColumns({"photo": F.lit(True), "photo_credit": F.lit(None).cast("string")})
    known = photos.select(F.col(key).alias("__key"), F.col("credit").alias("photo_credit")).dropDuplicates(["__key"])
    return people.join(known, people[key] == known["__key"], "left").withColumn("photo", F.col("__key").isNotNull()).drop("__key")


def linked(markers_: DataFrame, dropped: DataFrame) -> DataFrame:
    """(host, map of target to its struct) of the markers whose target was dropped. `markers_` has host and target, `dropped` has
    id and value."""
    met = markers_.join(dropped, markers_["target"] == dropped["id"]).select("host", "target", "value").distinct()
    return met.groupBy("host").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "value")))).alias("linked"))


def latest_membership(memberships: DataFrame) -> DataFrame:
    """(person_id, name): the open one first, then the latest."""
    order = Window.partitionBy("person_id").orderBy(F.col("to_date").isNull().desc(), F.col("from_date").desc(), "name")
    return memberships.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("person_id", "name")


def following(speeches: DataFrame, keys: list[str]) -> DataFrame:
    """`speeches` (keys, id, start, end) with `next`: the first speech whose start is after this one's end. A union of starts and
    ends under one window, where at equal places an end comes after a start. The window runs backwards, so that its frame only grows:
    one that shrinks from the other side is counted anew for every row."""
    starts = speeches.select(*keys, F.col("start").alias("at"), F.lit(0).alias("is_end"), F.col("id").alias("start_id"), F.lit(None).cast(dict(speeches.dtypes)["id"]).alias("of"))
    ends = speeches.select(*keys, F.col("end").alias("at"), F.lit(1).alias("is_end"), F.lit(None).cast(dict(speeches.dtypes)["id"]).alias("start_id"), F.col("id").alias("of"))
    ahead = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("is_end"), F.desc("start_id")).rowsBetween(Window.unboundedPreceding, -1)
    found = starts.union(ends).withColumn("next", F.last("start_id", ignorenulls=True).over(ahead)).filter("is_end = 1").select(*keys, F.col("of").alias("id"), "next")
    return speeches.join(found, [*keys, "id"], "left")


def resolved(ids: DataFrame, speeches: DataFrame) -> DataFrame:
    """(id, shown): the speech under which a part is shown; a dropped unit under the one it belongs to."""
    own = speeches.select(F.explode("part_ids").alias("id"), F.col("speech_id").alias("shown"), F.lit(0).alias("rank"))
    other = speeches.select(F.explode(F.map_keys("linked")).alias("id"), F.col("speech_id").alias("shown"), F.lit(1).alias("rank")) if "linked" in speeches.columns else own.limit(0)
    best = own.union(other).groupBy("id").agg(F.min_by("shown", F.struct("rank", "shown")).alias("shown"))
    return ids.select("id").distinct().join(best, "id", "left")


def decided(decisions: DataFrame, votes: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions of the agenda items, then their roll-call votes that no such decision refers to; a tie is `abgelehnt`."""
    own = decisions.join(items.select("agenda_item_id").distinct(), "agenda_item_id", "left_semi")
    first = own.select(F.lit(0).alias("source"), "agenda_item_id", "n", "result", F.coalesce(F.nullif("roll_call_vote_id", F.lit("")), F.col("id")).alias("page"))
    rest = votes.join(items.select("agenda_item_id").distinct(), "agenda_item_id", "left_semi").join(own.select(F.col("roll_call_vote_id").alias("id")), "id", "left_anti")
    second = rest.select(F.lit(1).alias("source"), "agenda_item_id", F.col("number").alias("n"), F.when(F.col("yes") > F.col("no"), "angenommen").otherwise("abgelehnt").alias("result"), F.col("id").alias("page"))
    return first.unionByName(second)
