"""Facets, search and profiles over a table of speeches."""

from __future__ import annotations

from array import array
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_automata: dict = {}


def facet_condition(lists: dict[str, list], together: tuple[str, ...] = ("day", "agenda"), leave: str | None = None) -> Column:
    """Values within a list are alternatives, lists are combined by and; the lists named in `together` form one group of
    alternatives; an empty list lets everything pass. `leave` skips one list."""
    live = {k: v for k, v in lists.items() if v and k != leave}
    group = [F.col(k).isin(live[k]) for k in together if k in live]
    rest = [F.col(k).isin(v) for k, v in live.items() if k not in together]
    return reduce(lambda a, b: a & b, [*rest, *([reduce(lambda a, b: a | b, group)] if group else [])], F.lit(True))


def facet_filter(df: DataFrame, lists: dict[str, list], **options) -> DataFrame:
    return df.filter(facet_condition(lists, **options))


def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """Made once per Python worker for a list of terms."""
    if terms not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            made.add_word(term, (k, len(term)))
        if terms:
            made.make_automaton()
        _automata[terms] = made
    return _automata[terms]


def distinct_terms(terms: list[str]) -> tuple[str, ...]:
    """The terms as they are looked for: lower-cased, each once, without empty ones."""
    return tuple(dict.fromkeys(t.lower() for t in terms if t))


def places_of(texts: pa.Array, sought: tuple[str, ...]) -> pa.Array:
    """A list of (term, place) for each lower-cased text, in order of place; what is found is held as two plain numbers each."""
    automaton, cut, term, at = _automaton(sought), array("i", [0]), array("i"), array("i")
    for t in texts:
        t = t.as_py()
        for place, k in sorted((end - n + 2, k) for end, (k, n) in automaton.iter(t)) if t and sought else ():
            term.append(k)
            at.append(place)
        cut.append(len(at))
    plain = lambda x: pa.array(np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32))
    return pa.ListArray.from_arrays(plain(cut), pa.StructArray.from_arrays([plain(term), plain(at)], ["term", "place"]))


def term_places(df: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """`df` with `places`: an array of (term, place) of every match of any term in any case, overlapping ones too, in order of place.
    Terms are counted from 0 in the order of `distinct_terms`, places from 1 in the lower-cased text. An Aho-Corasick automaton of all
    terms passes once over each text; a null text, or no term, gives an empty array."""
    sought = distinct_terms(terms)

    def run(texts: pa.Array) -> pa.Array:
        return places_of(texts, sought)

    return df.withColumn("places", F.arrow_udf(run, "array<struct<term: int, place: int>>")(F.lower(text)))


def term_filter(df: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """Rows that hold all terms, in any case, with the places of all matches as `term_places` gives them."""
    held = F.size(F.array_distinct(F.transform("places", lambda x: x["term"])))
    return term_places(df, terms, text).filter(held == len(distinct_terms(terms)))


def marked(text: Column, places: Column, lengths: list[int], begin: str = "<mark>", end: str = "</mark>") -> Column:
    """`text` with every match between `begin` and `end`: matches that overlap or touch are marked as one. `lengths` are those of the
    terms. For texts as long as their lower-cased form."""
    size = F.array(*[F.lit(n) for n in lengths])
    spans = F.transform(places, lambda x: F.struct(x["place"].alias("a"), (x["place"] + F.get(size, x["term"])).alias("b")))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), F.lit(0).alias("b"))

    def step(acc, x):
        joined = (acc["b"] > 0) & (x["a"] <= acc["b"])
        # up to the match before, which may still grow, then that match closed and the text between
        closed = F.concat(acc["out"], F.when(acc["b"] > 0, F.concat(F.substr(text, acc["at"], acc["b"] - acc["at"]), F.lit(end))).otherwise(F.lit("")))
        between = F.substr(text, F.greatest(acc["b"], F.lit(1)), x["a"] - F.greatest(acc["b"], F.lit(1)))
        return F.when(joined, F.struct(acc["out"].alias("out"), acc["at"].alias("at"), F.greatest(acc["b"], x["b"]).alias("b"))).otherwise(F.struct(F.concat(closed, between, F.lit(begin)).alias("out"), x["a"].alias("at"), x["b"].alias("b")))

    def finish(acc):
        return F.when(acc["b"] == 0, text).otherwise(F.concat(acc["out"], F.substr(text, acc["at"], acc["b"] - acc["at"]), F.lit(end), F.substr(text, acc["b"], F.greatest(F.length(text) - acc["b"] + 1, F.lit(0)))))

    return F.aggregate(spans, start, step, finish)


def default_visibility(lists: dict[str, list], question: Column, interruption: Column, show_questions: bool = False, show_interruptions: bool = False) -> Column:
    """Question times and interruptions are hidden unless asked for; a speaker filter shows both, an agenda filter the first."""
    q = show_questions or bool(lists.get("speaker")) or bool(lists.get("agenda"))
    i = show_interruptions or bool(lists.get("speaker"))
    return (F.lit(q) | ~F.coalesce(question, F.lit(False))) & (F.lit(i) | ~F.coalesce(interruption, F.lit(False)))


def facet_counts(df: DataFrame, facets: list[str], lists: dict[str, list] | None = None, **options) -> DataFrame:
    """(facet, value, n): each facet's values under the other facets' lists, in one pass over the rows."""
    lists = lists or {}
    pairs = F.explode(F.array(*[F.when(facet_condition(lists, leave=f, **options), F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"))) for f in facets]))
    return df.select(pairs.alias("p")).filter("p IS NOT NULL").groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def profile(df: DataFrame, selection: Column, facets: list[str], top: int = 12) -> DataFrame:
    """(facet, rank, value, n, bar): the commonest values of a selection, bars scaled to the largest; the rest as one row."""
    n = facet_counts(df.filter(selection), facets)
    best = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    x = n.withColumns({"rank": F.row_number().over(best), "most": F.max("n").over(Window.partitionBy("facet"))})
    shown = x.filter(F.col("rank") <= top).select("facet", "rank", "value", "n", (F.col("n") / F.col("most")).alias("bar"))
    rest = x.filter(F.col("rank") > top).groupBy("facet").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    return shown.union(rest.select("facet", F.lit(top + 1), F.lit("other"), "n", (F.col("n") / F.col("most")).alias("bar")))


def corpus_profile(df: DataFrame, group: str, text: str = "text", least: int = 500) -> DataFrame:
    """(group, n, median and quartiles of the length, share under `least`)."""
    size = F.length(text)
    return df.groupBy(group).agg(F.count("*").alias("n"), *[F.percentile(size, F.lit(p)).alias(a) for p, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))], F.avg((size < least).cast("double")).alias("short"))


#: Size of the quantile sketches, and the share of the rows by which the rank of what they give may be off (with odds of 0.99).
SKETCH, RANK_ERROR = 800, 0.005
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def length_sketches(df: DataFrame, *keys: str, text: str = "text", least: int = 500, size: int = SKETCH) -> DataFrame:
    """(keys, n, short, sketch): rows, rows under `least`, and a mergeable quantile sketch of the lengths, of a few KB at any number of
    rows. A table of it by week stands for the texts in profiles of any period. Null texts are counted as of no length."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(n < least).alias("short"), F.kll_sketch_agg_bigint(n, F.lit(size)).alias("sketch"))


def merged_profile(sketches: DataFrame, *group: str, size: int = SKETCH) -> DataFrame:
    """What `corpus_profile` gives, from sketches of parts of the rows: counts are exact, the rank of a quartile off by a share of
    RANK_ERROR."""
    m = sketches.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("short").alias("low"), F.kll_merge_agg_bigint("sketch", F.lit(size)).alias("s"))
    return m.select(*group, "n", *[F.kll_sketch_get_quantile_bigint("s", F.lit(p)).alias(a) for a, p in QUARTILES.items()], (F.col("low") / F.col("n")).alias("short"))


def similarity_sketches(near: DataFrame, *keys: str, size: int = SKETCH) -> DataFrame:
    """(keys, n, sketch) of the values of neighbours, for `floors_of_sketches`."""
    return near.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def floors_of_sketches(sketches: DataFrame, floors: list[float], size: int = SKETCH) -> DataFrame:
    """(floor, n, below): about how large a share of all pairs lies below each floor, off by RANK_ERROR."""
    m = sketches.agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("s"))
    each = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("floor"), F.kll_sketch_get_rank_double("s", F.lit(float(f))).alias("below")) for f in floors]))
    return m.filter("n > 0").select("n", each.alias("x")).select("x.floor", "n", "x.below")


def entity_counts(parts: DataFrame, sittings: DataFrame, agenda: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(entity, n) of a store: sittings, agenda items and those with speeches, speeches and speakers, and paragraphs of each kind.
    `parts` has id, agenda_item_id and person_id, `sittings` sitting_id, `agenda` agenda_item_id, `paragraphs` kind."""
    own = parts.agg(F.count("*").alias("speeches"), F.countDistinct("person_id").alias("speakers"), F.countDistinct("agenda_item_id").alias("agenda items with speeches"))
    rows = own.select(F.explode(F.array(*[F.struct(F.lit(c).alias("entity"), F.col(c).alias("n")) for c in own.columns])).alias("x")).select("x.*")
    for name, table, key in (("sittings", sittings, "sitting_id"), ("agenda items", agenda, "agenda_item_id")):
        rows = rows.union(table.agg(F.countDistinct(key).alias("n")).select(F.lit(name), "n"))
    return rows.union(paragraphs.groupBy("kind").count().select(F.concat(F.lit("paragraphs: "), F.coalesce("kind", F.lit("none"))), "count"))


def paragraph_kinds(paragraphs: DataFrame) -> DataFrame:
    """(kind, n, per_speech, chars): paragraphs of each kind, how many a speech that has any paragraph holds on average, and their mean
    length. `paragraphs` has speech_id, kind and text."""
    each = paragraphs.groupBy("speech_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    speeches = paragraphs.agg(F.countDistinct("speech_id").alias("speeches"))
    return each.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")).crossJoin(F.broadcast(speeches)).select("kind", "n", (F.col("n") / F.col("speeches")).alias("per_speech"), (F.col("chars") / F.col("n")).alias("chars"))
