"""The library's operators over the given tables, each beside its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.functions import calendar, names, text
from topicspark.operators import corpus, density, explore, landscape, neighbours, origins, terms, themes
from topicspark.plans.registry import query
from topicspark.sources import snapshots, tables
from topicspark.streaming import embedding

STOPWORDS = "the and der die das les des que und von los las".split()
ACRONYMS = ["ion", "ing"]
WEEK = "strftime({}, '%G-W%V')"
WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
COUNT = f"CAST(len({WORDS}) AS INTEGER)"


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:  # noqa: N802
    return tables.read_table(spark, f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


# Calendar

EVENT_WEEK = WEEK.format("ts")


@query(f"SELECT event_id, {EVENT_WEEK} AS week FROM events")
def p1_week_id(spark, d):
    return T(spark, d, "events").select("event_id", calendar.week_id(F.to_date("ts")).alias("week"))


@query(f"SELECT DISTINCT {WEEK.format('o_orderdate')} AS week, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS monday, strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS sunday FROM orders")
def p2_week_range(spark, d):
    w = T(spark, d, "orders").select(calendar.week_id(F.to_date("o_orderdate")).alias("week")).distinct()
    return w.withColumn("r", calendar.week_range(F.col("week"))).select("week", F.col("r.monday").cast("string").alias("monday"), F.col("r.sunday").cast("string").alias("sunday"))


@query("SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1")
def p3_in_week(spark, d):
    return T(spark, d, "events").filter(calendar.in_week(F.to_date("ts"), F.lit("2024-W02"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), n AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT {WEEK.format('date')} AS week, string_agg(CAST(day(date) AS VARCHAR), ',' ORDER BY date) AS sittings, CAST(sum(coalesce(n, 0)) AS BIGINT) AS speeches FROM s LEFT JOIN n USING (date) GROUP BY 1""")
def a1_weeks(spark, d):
    e = T(spark, d, "events").withColumn("date", F.to_date("ts"))
    sittings = e.select("date").distinct().select(F.col("date").alias("sitting_id"), F.dayofmonth("date").alias("number"), "date", calendar.week_id(F.col("date")).alias("week"))
    w = corpus.weeks_of(sittings, e.filter("event_type = 'click'").withColumn("sitting_id", F.col("date")))
    return w.select("week", F.array_join("sittings", ",").alias("sittings"), "speeches")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1")
def j3_zero_counts(spark, d):
    o = T(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return T(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


def order_weeks(spark, d):
    o = T(spark, d, "orders").withColumn("week", calendar.week_id(F.to_date("o_orderdate")))
    return o, calendar.week_ordinals(o)


ORDER_WEEKS = f"""o AS (SELECT *, {WEEK.format('o_orderdate')} AS week FROM orders),
weeks AS (SELECT week, CAST(row_number() OVER (ORDER BY week) - 1 AS INTEGER) AS week_idx FROM (SELECT DISTINCT week FROM o))"""


@query(f"WITH {ORDER_WEEKS} SELECT * FROM weeks")
def w6_week_ordinals(spark, d):
    return order_weeks(spark, d)[1]


# Predicates and text functions


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE length(text) >= 500 OR toxic = 1")
def p5_kept(spark, d):
    return T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id", "left").filter(corpus.kept(F.col("text"), F.col("toxic") == 1)).select("doc_id")


@query("SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'click' AND NOT value > 50")
def p6_included(spark, d):
    kind = F.when(F.col("event_type") == "click", "befragung")
    return T(spark, d, "events").filter(corpus.included(kind, F.col("value") > 50)).select("event_id")


@query("SELECT event_id FROM events WHERE event_type <> 'view'")
def p4_not_kind(spark, d):
    return tables.not_kind(T(spark, d, "events"), "view", "event_type").select("event_id")


@query("SELECT p_partkey, split_part(split_part(p_name, ',', 1), ' (', 1) AS name, CASE WHEN p_brand = 'Brand#11' THEN 'Sonstige' ELSE p_brand END AS grp FROM part")
def p8_p9_names(spark, d):
    return T(spark, d, "part").select("p_partkey", names.display_name(F.col("p_name")).alias("name"), names.recoded_group(F.col("p_brand"), "Brand#11").alias("grp"))


@query("SELECT l_orderkey, l_linenumber, 'abstimmungen/' || replace(l_orderkey || '/' || l_linenumber, '/', '-') || '.html' AS page FROM lineitem")
def p10_vote_page(spark, d):
    return T(spark, d, "lineitem").select("l_orderkey", "l_linenumber", names.vote_page(F.concat_ws("/", "l_orderkey", "l_linenumber")).alias("page"))


@query("SELECT doc_id, sha1(text) AS sha, CAST(length(text) AS INTEGER) AS chars, " + COUNT.format("text") + " AS words FROM documents")
def f2_f4_f7_text(spark, d):
    return T(spark, d, "documents").select("doc_id", F.sha1("text").alias("sha"), F.length("text").alias("chars"), text.word_count(F.col("text")).alias("words"))


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, part, i, {COUNT.format('part')} AS words FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
r AS (SELECT doc_id, i, 0 AS pos, words AS n FROM p WHERE i = 1
UNION ALL SELECT p.doc_id, p.i, CASE WHEN n + words <= 100 THEN pos ELSE pos + 1 END, CASE WHEN n + words <= 100 THEN n + words ELSE words END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
SELECT doc_id, pos, string_agg(part, chr(10) ORDER BY i) AS chunk FROM r JOIN p USING (doc_id, i) GROUP BY 1, 2""")
def f1_chunks(spark, d):
    return tables.spread(T(spark, d, "documents")).select("doc_id", F.posexplode(text.chunks(F.col("text"), 100, "\n")).alias("pos", "chunk"))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings")
def f3_norm(spark, d):
    return T(spark, d, "embeddings").select("vec_id", r6(F.sqrt(text.dot(F.col("embedding"), F.col("embedding")))).alias("norm"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type || '|' || json_extract_string(props, '$.k') END AS names, CASE WHEN event_type = 'error' THEN 0 ELSE 2 END AS n FROM events")
def s8_json(spark, d):
    e = T(spark, d, "events").withColumn("k", F.from_json("props", "k int")["k"].cast("string"))
    json = F.when(F.col("event_type") != "error", F.concat(F.lit('["'), "event_type", F.lit('", "'), "k", F.lit('"]')))
    listed = e.select("event_id", text.string_list(json).alias("x"))
    return listed.select("event_id", F.array_join("x", "|").alias("names"), F.size("x").alias("n"))


# Titles, names and classes: segments are put together from columns, so that what is to come out is known


@query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN p_name WHEN p_type = 'SMALL' THEN 'Haushalt: Verteidigung' WHEN p_type = 'LARGE' THEN 'Zum ' || p_name
WHEN p_type = 'STANDARD' THEN p_brand ELSE upper(p_name[1]) || p_name[2:] END AS title FROM part""")
def p7_short_title(spark, d):
    name, kind = F.col("p_name"), F.col("p_type")
    title = (
        F.when(kind == "ECONOMY", F.concat(F.lit("Erste Beratung | (Schluss der Aussprache) | "), name, F.lit(" | b) Beratung des Antrags | Anderes")))
        .when(kind == "SMALL", F.lit(None)).when(kind == "LARGE", F.concat(F.lit("Zweite Beratung des Entwurfs eines Ersten Gesetzes zum "), name))
        .when(kind == "STANDARD", F.lit("(Schluss der Sitzung)")).otherwise(F.concat(F.lit("Dritte Beratung des Entwurfs eines Gesetzes "), name))
    )
    top = F.when(kind == "SMALL", "Einzelplan 14").otherwise(F.col("p_brand"))
    return T(spark, d, "part").select("p_partkey", names.short_title(title, top).alias("title"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'SPD' WHEN c_mktsegment = 'MACHINERY' THEN 'Die Linke' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'BÜNDNIS 90/DIE GRÜNEN' ELSE c_name END AS name FROM customer")
def p11_fraction_name(spark, d):
    segment = F.col("c_mktsegment")
    given = F.when(segment == "BUILDING", " Fraktion der spd").when(segment == "MACHINERY", "Fraktion DIE LINKE ").when(segment == "HOUSEHOLD", "Fraktionen der Bündnis 90/Die Grünen").otherwise(F.concat(F.lit("Fraktion "), "c_name", F.lit(" ")))
    return T(spark, d, "customer").select("c_custkey", F.regexp_replace(names.fraction_name(given), "^Fraktion ", "").alias("name"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'CDU/CSU+' || c_name WHEN c_mktsegment = 'MACHINERY' THEN '' WHEN c_mktsegment = 'FURNITURE' THEN 'AfD' END AS names FROM customer")
def p12_requested_by(spark, d):
    segment = F.col("c_mktsegment")
    title = F.when(segment == "BUILDING", F.concat(F.lit("Aktuelle Stunde | auf Verlangen der Fraktionen der CDU/CSU und "), "c_name")).when(segment == "MACHINERY", F.concat(F.lit("Aktuelle Stunde | "), "c_name"))
    title = title.when(segment == "FURNITURE", "Aktuelle Stunde | ZP 3 Auf Verlangen der AfD").otherwise(F.concat(F.lit("Beratung | auf Verlangen der "), "c_name"))
    return T(spark, d, "customer").select("c_custkey", F.array_join(names.requested_by(title), "+").alias("names"))


@query("""SELECT doc_id, CASE WHEN lang = 'de' THEN 'befragung' WHEN lang = 'fr' THEN 'fragestunde' WHEN lang = 'es' THEN 'aktuelle_stunde' END AS kind,
CASE WHEN lang = 'de' THEN 'Bundesrat' WHEN lang = 'fr' THEN 'Bundesregierung' ELSE coalesce(source, 'Sonstige') END AS grp, split_part(source || '/' || doc_id, '-', 1) AS rede FROM documents""")
def p15_p16_p17_classes(spark, d):
    lang = F.col("lang")
    title = F.when(lang == "de", "Befragung der Bundesregierung").when(lang == "fr", "Fragestunde | 1").when(lang == "es", "Aktuelle Stunde | x").otherwise("Zur Aktuellen Stunde")
    role = F.when(lang == "de", "Senator (Berlin)").when(lang == "fr", "Parl. Staatssekretär beim Minister").otherwise(F.when(lang == "es", "Abgeordneter"))
    part = F.concat("source", F.lit("/"), "doc_id", F.when(lang == "en", "-3").otherwise(""))
    return T(spark, d, "documents").select("doc_id", names.agenda_kind(title).alias("kind"), names.speaker_group(role, F.col("source")).alias("grp"), names.rede_id(part).alias("rede"))


@query("SELECT doc_id, CASE WHEN lang <> 'en' THEN lang END AS lang, CASE WHEN n_chars > 1000 THEN source END AS source FROM documents")
def p14_sparse(spark, d):
    docs = T(spark, d, "documents")
    held = names.present(lang=(F.col("lang"), F.col("lang") != "en"), source=(F.col("source"), F.col("n_chars") > 1000))
    return docs.select("doc_id", held.alias("x")).select("doc_id", "x.lang", "x.source")


# Conversations: parts, joins, order

@query("SELECT conv_id, role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS part_ids, min(turn) AS start, max(turn) AS \"end\" FROM conversations GROUP BY 1, 2")
def a2_rejoined(spark, d):
    c = T(spark, d, "conversations").withColumn("part", F.col("turn").cast("string"))
    return corpus.rejoined(c, ["conv_id", "role"], "turn", "text", "part", []).withColumn("part_ids", F.array_join("part_ids", ","))


def _parts(spark, d):
    c = T(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("rede_id"), F.col("turn").alias("position"), F.col("role").alias("person_id"), F.concat_ws("-", "conv_id", "turn").alias("part_id"), "text", F.array("text").alias("chair"))


# The main speaker's words since they were last interrupted are those of their run; the tables' texts announce nothing.
INTERRUPTED = f"""p AS (SELECT conv_id AS rede_id, turn AS position, role AS person_id, conv_id || '-' || turn AS part_id, text, {COUNT.format('text')} AS words, first(role) OVER w AS main, first(conv_id || '-' || turn) OVER w AS main_head, lag(role) OVER w AS prev
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
a AS (SELECT *, person_id = main AS own, coalesce(person_id <> main AND prev = main, false) AS after_main FROM p),
r AS (SELECT *, sum(CAST(after_main AS INTEGER)) OVER (PARTITION BY rede_id ORDER BY position) AS run FROM a),
n AS (SELECT *, sum(CASE WHEN own THEN words ELSE 0 END) OVER (PARTITION BY rede_id, run) AS run_words, row_number() OVER (PARTITION BY rede_id, person_id ORDER BY position) AS nth FROM r),
b AS (SELECT *, coalesce(lag(run_words) OVER (PARTITION BY rede_id ORDER BY position), 0) AS since FROM n),
i AS (SELECT *, CASE WHEN NOT own THEN last_value(CASE WHEN NOT own AND (nth = 1 OR (after_main AND since >= 30)) THEN part_id END IGNORE NULLS) OVER (PARTITION BY rede_id, person_id ORDER BY position) END AS interruption_start,
CASE WHEN NOT own THEN 'zwischenfrage' END AS interruption, first(part_id) OVER (PARTITION BY rede_id, person_id ORDER BY position) AS head FROM b)"""


@query(f"WITH {INTERRUPTED} SELECT part_id, interruption, interruption_start FROM i")
def w4_interruptions(spark, d):
    return corpus.interruptions(_parts(spark, d)).select("part_id", "interruption", "interruption_start")


# Conversations of whose number there is a German document stand for question times, in which turns are no interruptions


@query(f"WITH {INTERRUPTED} SELECT part_id, CASE WHEN lang IS DISTINCT FROM 'de' THEN interruption END AS interruption, CASE WHEN lang IS DISTINCT FROM 'de' THEN interruption_start END AS interruption_start FROM i LEFT JOIN documents ON doc_id = rede_id")
def w4_question_times(spark, d):
    lang = T(spark, d, "documents").select(F.col("doc_id").alias("rede_id"), "lang")
    return corpus.interruptions(_parts(spark, d).join(lang, "rede_id", "left"), F.col("lang") == "de").select("part_id", "interruption", "interruption_start")


@query(f"""WITH {INTERRUPTED} SELECT rede_id, position, main AS in_person, interruption AS kind, head AS target FROM i WHERE after_main AND interruption_start = part_id
UNION ALL SELECT rede_id, max(position), person_id, 'antwort', first(main_head) FROM i WHERE NOT own GROUP BY rede_id, person_id""")
def w1_w2_markers(spark, d):
    return corpus.markers(corpus.interruptions(_parts(spark, d)))


# Week load: a conversation is a rede of the sitting of its number, its agenda item the document of that number; lines are paragraphs

LEAST_CHARS = 200


def week_parts(spark, d):
    given = corpus.interruptions(_parts(spark, d))
    person = F.col("person_id")
    parts = given.select(F.col("part_id").alias("id"), F.col("rede_id").alias("sitting_id"), F.when(person != "system", F.col("rede_id")).alias("agenda_item_id"), "position", "person_id", F.concat("person_id", F.lit(", a (b)")).alias("speaker_name"),
        F.when(person == "system", "Bundesrat").otherwise(person).alias("speaker_group"), person.alias("member_fraction"), F.lit(None).cast("string").alias("speaker_role"), "text", F.lit("src").alias("source_document_id"), "rede_id", "interruption", "interruption_start")
    sittings = parts.select("sitting_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("sitting_id") % 60).cast("int")).alias("date"), F.concat(F.lit("pdf"), "sitting_id").alias("pdf_url")).distinct()
    line = F.posexplode(F.split("text", "\n"))
    lines = given.select(F.col("part_id").alias("speech_id"), line.alias("position", "text")).select("speech_id", "position", F.when(F.col("text").endswith("."), "text").otherwise("comment").alias("kind"), "text")
    return parts, sittings, lines, given


def week_speeches(spark, d):
    parts, sittings, lines, _ = week_parts(spark, d)
    agenda = T(spark, d, "documents").select(F.col("doc_id").alias("agenda_item_id"), F.col("source").alias("top_id"), F.concat(F.lit("Beratung des Antrags | "), "lang").alias("title"), F.concat(F.lit('["'), "n_chars", F.lit('"]')).alias("drucksache_numbers"), F.lit(None).cast("string").alias("kind"))
    photos = T(spark, d, "region").select(F.lit("user").alias("person_id"), F.lit("me").alias("credit"))
    return parts, sittings, lines, corpus.load_weeks(parts, sittings, agenda, lines, photos, LEAST_CHARS)


SPOKEN = f"""{INTERRUPTED}, s AS (SELECT rede_id, person_id, head AS id, string_agg(text, chr(10) || chr(10) ORDER BY position) AS text, string_agg(part_id, ',' ORDER BY position) AS part_ids, min(position) AS start, max(position) AS "end",
person_id <> first(main) AS other, first(main_head) AS main_head FROM i GROUP BY 1, 2, 3),
l AS (SELECT rede_id, head AS id, position, 1 AS rank, n AS place, CASE WHEN ends_with(line, '.') THEN 'text' ELSE 'comment' END AS kind, line AS text FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM i)
UNION ALL SELECT rede_id, main_head, position, 0, 0, interruption, head FROM i WHERE after_main AND interruption_start = part_id
UNION ALL SELECT rede_id, id, "end", 2, 0, 'antwort', main_head FROM s WHERE other),
x AS (SELECT id, string_agg(kind || ':' || text, '|' ORDER BY position, rank, place) AS paragraphs, count(*) FILTER (kind = 'comment') AS comments FROM l GROUP BY 1),
k AS (SELECT *, length(text) >= {LEAST_CHARS} OR other AS kept, DATE '2024-01-01' + CAST(rede_id % 60 AS INTEGER) AS date FROM s)"""


@query(f"""WITH {SPOKEN}, g AS (SELECT host.id, string_agg(DISTINCT l.text, ',' ORDER BY l.text) AS linked FROM k host JOIN l ON l.id = host.id AND l.kind IN ('zwischenfrage', 'kurzintervention', 'antwort') JOIN k gone ON gone.id = l.text AND NOT gone.kept WHERE host.kept GROUP BY 1)
SELECT k.id, {WEEK.format('date')} AS week, strftime(date, '%Y-%m-%d') AS date, k.person_id AS speaker, CASE WHEN k.person_id = 'system' THEN 'Sonstige' ELSE k.person_id END AS fraction, CASE WHEN k.person_id <> 'system' THEN lang END AS agenda_title, coalesce(CASE WHEN k.person_id <> 'system' THEN CAST(n_chars AS VARCHAR) END, '') AS papers,
k.text, part_ids, start, "end", other AS zwischenfrage, paragraphs, CAST(comments AS INTEGER) AS comments, coalesce(linked, '') AS linked, k.person_id = 'user' AS photo FROM k JOIN x USING (id) LEFT JOIN g USING (id) LEFT JOIN documents ON doc_id = rede_id WHERE kept""")
def x1_load_weeks(spark, d):
    x = week_speeches(spark, d)[3]
    shown = F.array_join(F.transform("paragraphs", lambda p: F.concat(p["kind"], F.lit(":"), p["text"])), "|")
    return x.select("id", "week", F.col("date").cast("string").alias("date"), "speaker", "fraction", "agenda_title", F.array_join("drucksachen", ",").alias("papers"), "text", F.array_join("part_ids", ",").alias("part_ids"), F.col("start.position").alias("start"), F.col("end.position").alias("end"), "zwischenfrage", shown.alias("paragraphs"), F.col("comments"), F.array_join(F.array_sort(F.map_keys("linked")), ",").alias("linked"), "photo")


@query(f"""WITH {SPOKEN} SELECT part_id AS speech_id, n - 1 AS position, CASE WHEN ends_with(line, '.') THEN 'text' ELSE 'comment' END AS kind, strftime(DATE '2024-01-01' + CAST(rede_id % 60 AS INTEGER), '%Y-%m-%d') AS date
FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM i)""")
def j2_paragraphs(spark, d):
    parts, sittings, lines, _ = week_parts(spark, d)
    x = corpus.joined_paragraphs(lines, parts.drop("text"), sittings)
    return x.select("speech_id", F.col("position").cast("long").alias("position"), "kind", F.col("date").cast("string").alias("date"))


@query("SELECT conv_id, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS said FROM conversations GROUP BY 1")
def l1_speaking_order(spark, d):
    c = T(spark, d, "conversations").withColumn("part", F.concat_ws(":", "role", F.length("text")))
    return corpus.rejoined(c, ["conv_id"], "turn", "text", "part", []).select("conv_id", F.array_join("part_ids", " ").alias("said"))


@query("SELECT a.conv_id, a.turn AS id, (SELECT min(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn + 1) AS next FROM conversations a")
def j14_following(spark, d):
    c = T(spark, d, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"))
    return corpus.following(c, ["conv_id"]).select("conv_id", "id", "next")


@query("SELECT conv_id, turn, lang, n_chars FROM conversations LEFT JOIN documents ON doc_id = conv_id * 10 + turn")
def j1_parts(spark, d):
    docs = T(spark, d, "documents").select(F.col("doc_id").alias("agenda_item_id"), "lang", "n_chars")
    c = T(spark, d, "conversations").withColumns({"sitting_id": F.col("conv_id"), "agenda_item_id": F.col("conv_id") * 10 + F.col("turn")})
    return corpus.joined_parts(c, c.select("sitting_id").distinct(), docs).select("conv_id", "turn", "lang", "n_chars")


@query("SELECT conv_id || '-' || turn AS id, conv_id || '-' || min(turn) OVER (PARTITION BY conv_id, role) AS shown FROM conversations")
def p21_resolved(spark, d):
    p = _parts(spark, d)
    speeches = p.groupBy("rede_id", "person_id").agg(F.min_by("part_id", "position").alias("speech_id"), F.collect_list("part_id").alias("part_ids"))
    return corpus.resolved(p.select(F.col("part_id").alias("id")), speeches)


@query("SELECT o_custkey AS person_id, arg_max(o_orderpriority, (o_orderdate, -ascii(o_orderpriority))) AS name FROM orders GROUP BY 1")
def w5_latest(spark, d):
    o = T(spark, d, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("from_date"), F.lit(None).cast("date").alias("to_date"))
    return corpus.latest_membership(o)


@query("SELECT c_custkey, s_suppkey IS NOT NULL AS photo, s_name AS photo_credit FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def j4_photo(spark, d):
    photos = T(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("credit"))
    return corpus.with_photo(T(spark, d, "customer").select("c_custkey"), photos, "c_custkey")


# Filled orders are decisions, those of an even key taken by the roll call of the next order; the others are roll calls; all
# customers of a nation that has a supplier are agenda items

DECIDED = "items AS (SELECT c_custkey AS item FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)), d AS (SELECT o_custkey AS item, o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey + 1 AS VARCHAR) END AS vote, o_orderstatus AS result FROM orders JOIN items ON item = o_custkey WHERE o_orderstatus = 'F')"


@query(f"""WITH {DECIDED} SELECT 0 AS source, item AS agenda_item_id, id AS n, result, coalesce(vote, CAST(id AS VARCHAR)) AS page FROM d
UNION ALL SELECT 1, o_custkey, o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'angenommen' ELSE 'abgelehnt' END, CAST(o_orderkey AS VARCHAR) FROM orders JOIN items ON item = o_custkey
WHERE o_orderstatus <> 'F' AND CAST(o_orderkey AS VARCHAR) NOT IN (SELECT vote FROM d WHERE vote IS NOT NULL)""")
def j6_j7_u1_decisions(spark, d):
    o = T(spark, d, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    decisions = o.filter("o_orderstatus = 'F'").select("id", F.col("o_custkey").alias("agenda_item_id"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("result"), F.when(F.expr("o_orderkey % 2 = 0"), (F.col("o_orderkey") + 1).cast("string")).alias("roll_call_vote_id"))
    votes = o.filter("o_orderstatus <> 'F'").select("id", F.col("o_custkey").alias("agenda_item_id"), F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("yes"), F.lit(100000).alias("no"))
    held = T(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    items = T(spark, d, "customer").join(held, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("agenda_item_id"))
    return corpus.decided(decisions, votes, items)


# Terms and clusters


def topic_docs(spark, d):
    """All documents, those without a vector as noise."""
    e = T(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("int").alias("cluster"))
    return tables.spread(T(spark, d, "documents")).join(e, "doc_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))


TOPICS = "t AS (SELECT doc_id, text, source, lang, coalesce(CAST(label AS INTEGER), -1) AS cluster FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
VOCABULARY = f"""{TOPICS}, w AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS term FROM t)
WHERE regexp_full_match(term, '\\p{{L}}{{3,}}') AND term NOT IN ({STOP}) GROUP BY 1, 2),
v AS (SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.5 * (SELECT count(*) FROM t))"""
CTFIDF = f"""{VOCABULARY}, c AS (SELECT cluster, term, sum(w.n) AS n FROM w JOIN v USING (term) JOIN t USING (doc_id) WHERE cluster >= 0 GROUP BY 1, 2),
z AS (SELECT cluster, sum(n) AS size FROM c GROUP BY 1),
s AS (SELECT cluster, term, round(c.n / greatest(size, 1) * ln(1 + (SELECT sum(size) FROM z) / (SELECT count(DISTINCT cluster) FROM t WHERE cluster >= 0) / greatest(v.n, 1)), 9) AS score FROM c JOIN z USING (cluster) JOIN v USING (term)),
k AS (SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS INTEGER) AS rank, term, score FROM s)"""


@query(f"WITH {VOCABULARY} SELECT term, df, n FROM v")
def a5_vocabulary(spark, d):
    return terms.vocabulary(tables.spread(T(spark, d, "documents")), STOPWORDS)


@query(f"WITH {CTFIDF} SELECT cluster, rank, term, round(score, 6) AS score FROM k WHERE rank <= 4")
def a6_ctfidf(spark, d):
    return terms.cluster_terms(topic_docs(spark, d), STOPWORDS).withColumn("score", r6(F.col("score")))


@query(f"WITH {CTFIDF} SELECT cluster, string_agg(CASE WHEN term IN ('ion', 'ing') THEN upper(term) ELSE upper(term[1]) || term[2:] END, ' · ' ORDER BY rank) AS label FROM k WHERE rank <= 3 GROUP BY 1")
def p13_topic_label(spark, d):
    k = terms.cluster_terms(topic_docs(spark, d), STOPWORDS)
    each = k.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    return each.select("cluster", names.topic_label(F.col("terms"), ACRONYMS).alias("label"))


@query(f"WITH {TOPICS}, n AS (SELECT cluster, source, count(*) AS n, min(doc_id) AS f FROM t WHERE cluster >= 0 GROUP BY 1, 2) SELECT cluster, source, n FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) = 1")
def a7_majority(spark, d):
    return terms.majority(topic_docs(spark, d), "cluster", "source", "doc_id", F.col("cluster") >= 0)


@query("SELECT label AS cluster, CAST(row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS INTEGER) AS theme, count(*) AS n FROM embeddings GROUP BY 1")
def a8_a9_themes(spark, d):
    return themes.ranked_themes(T(spark, d, "embeddings").withColumnRenamed("label", "cluster")).select("cluster", "theme", "n")


@query(f"WITH {TOPICS}, n AS (SELECT cluster, source, count(*) AS n, min(doc_id) AS f FROM t GROUP BY 1, 2) SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY n DESC, f) AS INTEGER) AS rank, source, n FROM n QUALIFY rank <= 3")
def a10_top_values(spark, d):
    return themes.top_values(topic_docs(spark, d), "cluster", "source", "doc_id")


# Themes over weeks


def event_rows(spark, d):
    return T(spark, d, "events").select("event_id", F.col("event_type").alias("theme"), F.to_date("ts").cast("string").alias("week"), (F.col("user_id") % 5).alias("cluster"))


EVENT_ROWS = "e AS (SELECT event_id, event_type AS theme, strftime(ts, '%Y-%m-%d') AS week, user_id % 5 AS cluster FROM events)"
EVENT_CUBE = f"""{EVENT_ROWS}, n AS (SELECT theme, week, count(*) AS n FROM e GROUP BY 1, 2),
cube AS (SELECT theme, week, coalesce(n, 0) AS n FROM (SELECT DISTINCT theme FROM e) CROSS JOIN (SELECT DISTINCT week FROM e) LEFT JOIN n USING (theme, week))"""


def event_cube(spark, d):
    e = event_rows(spark, d)
    cells = e.groupBy("theme", "week").agg(F.count("*").alias("n"))
    return origins.dense(cells, e, calendar.week_ordinals(e), "n")


@query(f"WITH {EVENT_CUBE} SELECT theme, week, n FROM cube")
def a11_cube(spark, d):
    return event_cube(spark, d).select("theme", "week", "n")


@query(f"WITH {EVENT_ROWS}, n AS (SELECT theme, week, cluster, count(*) AS n, min(event_id) AS f FROM e GROUP BY 1, 2, 3) SELECT theme, week, cluster, n FROM n WHERE cluster > 0 QUALIFY row_number() OVER (PARTITION BY theme, week ORDER BY n DESC, f) = 1")
def a12_focus(spark, d):
    return terms.majority(event_rows(spark, d), ["theme", "week"], "cluster", "event_id", F.col("cluster") > 0).select("theme", "week", "cluster", "n")


@query(f"WITH {EVENT_ROWS} SELECT week, count(*) FILTER (cluster = 0) AS unassigned FROM e GROUP BY 1")
def a13_unassigned(spark, d):
    e = event_rows(spark, d).withColumn("theme", F.when(F.col("cluster") == 0, -1).otherwise(0))
    return themes.unassigned(e, e)


@query(f"WITH {EVENT_CUBE} SELECT theme, week, n, round(CASE WHEN sum(n) OVER (PARTITION BY week) > 0 THEN n / sum(n) OVER (PARTITION BY week) ELSE 0.0 END, 6) AS share FROM cube")
def a22_week_share(spark, d):
    return themes.week_share(event_cube(spark, d)).select("theme", "week", "n", r6(F.col("share")).alias("share"))


@query(f"WITH {EVENT_CUBE} SELECT theme, CAST(row_number() OVER (PARTITION BY theme ORDER BY n DESC, week) AS INTEGER) AS rank, week, n, first(week) OVER (PARTITION BY theme ORDER BY n DESC, week) AS peak FROM cube QUALIFY rank <= 3")
def a23_strongest_weeks(spark, d):
    return themes.strongest_weeks(event_cube(spark, d))


STEMS = [("one", 0, "the"), ("one", 0, "an"), ("two", 1, "er"), ("two", 1, "th"), ("three", 2, "ion"), ("three", 2, "es")]


@query(f"""WITH {CTFIDF}, stems AS (SELECT * FROM (VALUES {', '.join(str(s) for s in STEMS)}) x(area, area_order, stem)),
g AS (SELECT DISTINCT cluster, term, rank, area, area_order FROM k JOIN stems ON starts_with(term, stem) WHERE rank <= 4),
p AS (SELECT cluster, area, area_order, sum(5 - rank) AS score FROM g GROUP BY 1, 2, 3),
b AS (SELECT cluster, area FROM p QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, area_order) = 1)
SELECT cluster AS theme, coalesce(area, 'weitere') AS area FROM (SELECT DISTINCT cluster FROM k) LEFT JOIN b USING (cluster)""")
def f5_j12_areas(spark, d):
    k = terms.cluster_terms(topic_docs(spark, d), STOPWORDS).select(F.col("cluster").alias("theme"), (F.col("rank") - 1).alias("rank"), "term")
    return themes.areas(k, spark.createDataFrame(STEMS, "area string, area_order int, stem string"))


@query("SELECT lang AS area, count(DISTINCT source) AS themes, count(*) AS speeches FROM documents GROUP BY 1")
def a24_area_totals(spark, d):
    t = T(spark, d, "documents").groupBy(F.col("lang").alias("area"), "source").agg(F.count("*").alias("n"))
    return themes.area_totals(t)


# Shares, episodes and origins: week of the order, theme its priority, fraction its status, agenda item its customer

THRESHOLD, GAP, BACK = 0.22, 4, 8


def order_rows(spark, d):
    o, weeks = order_weeks(spark, d)
    rows = o.select(F.col("o_orderkey").alias("id"), "week", F.col("o_custkey").alias("agenda"), F.col("o_orderstatus").alias("fraction"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("theme"), F.lit(1).alias("words"))
    return rows.join(F.broadcast(weeks), "week"), weeks


ORDER_ROWS = f"""{ORDER_WEEKS}, r AS (SELECT o_orderkey AS id, week, week_idx, o_custkey AS agenda, o_orderstatus AS fraction, CAST(o_orderpriority[1] AS INTEGER) - 1 AS theme FROM o JOIN weeks USING (week)),
shares AS (SELECT theme, week, week_idx, coalesce(own, 0) / al AS share FROM (SELECT DISTINCT theme FROM r) CROSS JOIN weeks
LEFT JOIN (SELECT theme, week, count(*) AS own FROM r GROUP BY 1, 2) USING (theme, week) JOIN (SELECT week, count(*) AS al FROM r GROUP BY 1) USING (week))"""


def _episodes_sql(threshold: str, source: str = "shares", keys: str = "theme") -> str:
    return f"""a AS (SELECT *, lag(week_idx) OVER (PARTITION BY {keys} ORDER BY week_idx) AS prev FROM {source} WHERE share >= {threshold}),
m AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR week_idx - prev - 1 >= {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY week_idx) - 1 AS BIGINT) AS episode FROM a),
ep AS (SELECT {keys}, episode, min(week_idx) AS start, max(week_idx) AS "end", round(max(share), 6) AS peak, round(arg_min(share, week_idx), 6) AS share, episode = 0 AND min(week_idx) < {GAP} AS period_start FROM m GROUP BY {keys}, episode)"""


MAIN = "main AS (SELECT agenda, theme FROM (SELECT agenda, theme, count(*) AS n FROM r GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY agenda ORDER BY n DESC, theme) = 1)"


def order_shares(spark, d):
    rows, weeks = order_rows(spark, d)
    return rows, origins.weekly_shares(rows, weeks, rows)


@query(f"WITH {ORDER_ROWS} SELECT theme, week, week_idx, round(share, 6) AS share FROM shares")
def a14_weekly_shares(spark, d):
    return order_shares(spark, d)[1].withColumn("share", r6(F.col("share")))


@query(f"WITH {ORDER_ROWS}, {_episodes_sql(str(THRESHOLD))} SELECT * FROM ep")
def w3_episodes(spark, d):
    return origins.episodes(order_shares(spark, d)[1], THRESHOLD, GAP).withColumns({"peak": r6(F.col("peak")), "share": r6(F.col("share"))})


@query(f"WITH {ORDER_ROWS}, sw AS (SELECT *, unnest([0.2, 0.22, 0.24]::DOUBLE[]) AS threshold FROM shares), {_episodes_sql('threshold', 'sw', 'threshold, theme')} SELECT threshold, count(*) AS episodes, count(*) FILTER (period_start) AS at_start FROM ep GROUP BY 1")
def a28_episode_sweep(spark, d):
    return origins.episode_sweep(order_shares(spark, d)[1], [0.2, 0.22, 0.24], GAP)


@query(f"WITH {ORDER_ROWS}, {MAIN} SELECT * FROM main")
def a15_main_themes(spark, d):
    return origins.main_themes(order_rows(spark, d)[0])


@query(f"""WITH {ORDER_ROWS}, {_episodes_sql(str(THRESHOLD))}, {MAIN}
SELECT ep.theme, episode, r.fraction, count(*) FILTER (r.theme = ep.theme AND coalesce(main.theme, -1) <> ep.theme) AS n, count(*) AS "of"
FROM ep JOIN r ON r.week_idx >= ep.start - {BACK} AND r.week_idx < ep.start LEFT JOIN main USING (agenda) WHERE NOT period_start GROUP BY 1, 2, 3 HAVING n > 0""")
def a17_j13_unprompted(spark, d):
    rows, shares = order_shares(spark, d)
    return origins.unprompted(origins.episodes(shares, THRESHOLD, GAP), rows, origins.main_themes(rows), BACK)


@query(f"""WITH {ORDER_ROWS}, {_episodes_sql(str(THRESHOLD))}, {MAIN} SELECT DISTINCT ep.theme, episode, r.agenda FROM ep JOIN r ON r.week_idx = ep.start JOIN main ON main.agenda = r.agenda AND main.theme = ep.theme""")
def x6_formal(spark, d):
    rows, shares = order_shares(spark, d)
    return origins.formal(origins.episodes(shares, THRESHOLD, GAP), rows, origins.main_themes(rows))


def agenda_and_papers(spark, d):
    """Customers as agenda items, with the paper of their nation; a nation's process is its region's."""
    c, n = T(spark, d, "customer"), T(spark, d, "nation")
    title = F.when(F.col("c_mktsegment") == "BUILDING", "Aktuelle Stunde | auf Verlangen der Fraktion der AfD").otherwise("Beratung | Anderes")
    agenda = c.select(F.col("c_custkey").alias("agenda"), title.alias("raw_title"), F.array(F.col("c_nationkey").cast("string")).alias("numbers"))
    papers = n.select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").cast("string").alias("number"), F.array("n_name").alias("originators"))
    bridge = n.select(F.col("n_nationkey").alias("paper_id"), F.col("n_regionkey").alias("process_id"))
    told = F.when(F.col("r_regionkey") < 3, F.array(F.lit("Fraktion DIE LINKE"), F.col("r_name"))).otherwise(F.array().cast("array<string>"))
    processes = T(spark, d, "region").select(F.col("r_regionkey").alias("id"), told.alias("initiators"))
    return agenda, origins.initiators(papers, bridge, processes, names.fraction_name)


NAMES = "CASE WHEN r_regionkey < 3 THEN ['Die Linke', r_name] ELSE [n_name] END"


@query(f"SELECT CAST(n_nationkey AS VARCHAR) AS number, array_to_string({NAMES}, ',') AS names FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def j8_initiators(spark, d):
    return agenda_and_papers(spark, d)[1].select("number", F.array_join("names", ",").alias("names"))


BROUGHT = f"""{_episodes_sql(str(THRESHOLD))}, {MAIN}, it AS (SELECT DISTINCT ep.theme, episode, r.agenda FROM ep JOIN r ON r.week_idx = ep.start JOIN main ON main.agenda = r.agenda AND main.theme = ep.theme),
who AS (SELECT DISTINCT theme, episode, agenda, unnest(CASE WHEN c_mktsegment = 'BUILDING' THEN ['AfD'] ELSE []::VARCHAR[] END || {NAMES}) AS originator FROM it JOIN customer ON c_custkey = agenda JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)"""


@query(f"WITH {ORDER_ROWS}, {BROUGHT} SELECT theme, episode, agenda, string_agg(originator, ',' ORDER BY originator) AS originators FROM who GROUP BY 1, 2, 3")
def j9_formal_items(spark, d):
    rows, shares = order_shares(spark, d)
    found = origins.episodes(shares, THRESHOLD, GAP)
    items = origins.formal_items(found, rows, origins.main_themes(rows), *agenda_and_papers(spark, d))
    return items.select("theme", "episode", "agenda", F.array_join(F.array_sort("originators"), ",").alias("originators"))


@query(f"""WITH {ORDER_ROWS}, {BROUGHT}, n AS (SELECT theme, episode, originator, count(*) AS n FROM who GROUP BY 1, 2, 3), by_ AS (SELECT theme, episode, string_agg(originator || ':' || n, ',' ORDER BY n DESC, originator) AS by_originator FROM n GROUP BY 1, 2),
f AS (SELECT theme, episode, count(*) AS formal FROM it GROUP BY 1, 2),
u AS (SELECT ep.theme, episode, r.id, r.week_idx FROM ep JOIN r ON r.week_idx >= ep.start - {BACK} AND r.week_idx < ep.start AND r.theme = ep.theme LEFT JOIN main USING (agenda) WHERE NOT period_start AND coalesce(main.theme, -1) <> ep.theme),
l AS (SELECT theme, episode, string_agg(CAST(id AS VARCHAR), ',' ORDER BY week_idx, id) FILTER (k <= 12) AS listed, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY theme, episode ORDER BY week_idx, id) AS k FROM u) GROUP BY 1, 2)
SELECT ep.theme, ep.episode, ep.start, ep."end", ep.period_start, round_even(first_.share, 3) AS share, coalesce(formal, 0) AS formal, by_originator, CASE WHEN NOT ep.period_start THEN coalesce(l.n, 0) END AS unprompted, listed
FROM ep JOIN shares first_ ON first_.theme = ep.theme AND first_.week_idx = ep.start LEFT JOIN by_ ON by_.theme = ep.theme AND by_.episode = ep.episode
LEFT JOIN f ON f.theme = ep.theme AND f.episode = ep.episode LEFT JOIN l ON l.theme = ep.theme AND l.episode = ep.episode""")
def x6_origins(spark, d):
    rows, weeks = order_rows(spark, d)
    rows = tables.stored(rows)
    shares = origins.weekly_shares(rows, weeks, rows)
    x = origins.origins(shares, rows, THRESHOLD, GAP, BACK, *agenda_and_papers(spark, d))
    by = F.array_join(F.transform("e.by_originator", lambda x: F.concat(x["originator"], F.lit(":"), x["n"])), ",")
    return x.select("theme", F.explode("episodes").alias("e")).select(
        "theme", "e.episode", "e.start", "e.end", "e.period_start", "e.share", F.coalesce(F.size("e.formal"), F.lit(0)).cast("long").alias("formal"), by.alias("by_originator"), F.col("e.n_unprompted").alias("unprompted"), F.array_join(F.transform("e.listed", lambda i: i.cast("string")), ",").alias("listed"),
    )


@query("SELECT originator, count(*) AS n FROM (SELECT o_orderkey, o_orderstatus AS originator FROM orders UNION SELECT o_orderkey, o_orderpriority FROM orders) GROUP BY 1")
def a16_per_originator(spark, d):
    return origins.per_originator(T(spark, d, "orders").select(F.array("o_orderstatus", "o_orderpriority", "o_orderstatus").alias("names")))


# Vectors


def vectors(spark, d):
    return T(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").alias("grp"))


PAIRS = """p AS (SELECT a.vec_id AS id, b.vec_id AS near_id, a.label AS la, b.label AS lb, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS value,
list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS l2 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""


def _knn_sql(where: str, k: int, order: str = "value DESC", partition: str = "id") -> str:
    return f"WITH {PAIRS}, q AS (SELECT id, CAST(row_number() OVER (PARTITION BY {partition} ORDER BY {order}, near_id) AS INTEGER) AS rank, near_id, value, l2, la, lb FROM p WHERE {where} QUALIFY rank <= {k})"


@query(_knn_sql("la = lb", 5) + " SELECT la AS week, id, rank, near_id, round(value, 6) AS value FROM q")
def j15_knn_by_week(spark, d):
    v = vectors(spark, d).withColumnRenamed("grp", "week")
    return neighbours.nearest(v, v, 5, keys=("week",)).withColumn("value", r6(F.col("value")))


@query(_knn_sql("la <> lb AND value >= 0.3", 5) + " SELECT id, rank, near_id, round(value, 6) AS value FROM q")
def j16_knn_excluding(spark, d):
    v = vectors(spark, d)
    return neighbours.nearest(v, v, 5, floor=0.3).withColumn("value", r6(F.col("value")))


@query(_knn_sql("la <> lb AND value >= 0.3", 5) + " SELECT id, rank, near_id, round(value, 6) AS value FROM q")
def j16_l3_pruned(spark, d):
    v = vectors(spark, d)
    return neighbours.pruned_nearest(v, v, 5, floor=0.3).withColumn("value", r6(F.col("value")))


@query(_knn_sql("la = 0 AND lb <> 0", 15, "l2") + " SELECT id, rank, near_id, round(l2, 6) AS value FROM q")
def j17_pruned(spark, d):
    v = vectors(spark, d)
    near = neighbours.pruned_nearest(v.filter("grp = 0").drop("grp"), v.filter("grp <> 0").drop("grp"), 15, by="l2")
    return near.withColumn("value", r6(F.col("value")))


@query(_knn_sql("la <> lb AND value >= 0.3", 5) + " SELECT id, string_agg(CAST(near_id AS VARCHAR), ',' ORDER BY rank) AS near_ids FROM q GROUP BY 1")
def x5_neighbour_lists(spark, d):
    v = vectors(spark, d)
    return neighbours.neighbour_lists(neighbours.nearest(v, v, 5, floor=0.3)).withColumn("near_ids", F.array_join("near_ids", ","))


@query(_knn_sql("true", 5) + " SELECT round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END), 6) AS agreement, count(*) AS pairs FROM q")
def a25_knn_agreement(spark, d):
    v = vectors(spark, d)
    return neighbours.agreement(neighbours.nearest(v.drop("grp"), v.drop("grp"), 5), v)


@query(_knn_sql("true", 5) + ", f AS (SELECT unnest([0.3, 0.4]::DOUBLE[]) AS floor), g AS (SELECT floor, id, count(*) FILTER (value < floor) AS low, count(*) FILTER (value >= floor) AS high FROM q, f GROUP BY 1, 2) SELECT floor, CAST(sum(low) AS BIGINT) AS dropped, count(*) FILTER (high = 0) AS emptied FROM g GROUP BY 1")
def a27_floor_study(spark, d):
    v = vectors(spark, d).drop("grp")
    return neighbours.floor_study(neighbours.nearest(v, v, 5), [0.3, 0.4], v)


# Rows of label 0 stand for noise, those of all other labels for core rows


@query(_knn_sql("la = 0 AND lb <> 0", 15, "l2") + ", n AS (SELECT id, lb AS theme, count(*) AS n FROM q GROUP BY 1, 2) SELECT id, theme FROM n WHERE n / 15 >= 0.25 QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, theme) = 1")
def a29_j17_noise_vote(spark, d):
    v = vectors(spark, d)
    near = neighbours.nearest(v.filter("grp = 0").drop("grp"), v.filter("grp <> 0").drop("grp"), 15, by="l2")
    return themes.noise_vote(near.join(v.select(F.col("id").alias("near_id"), F.col("grp").alias("theme")), "near_id"), 15, 0.25)


@query()
def m5_density(spark, d):
    return density.density_clusters(vectors(spark, d).drop("grp"), 8)


@query()
def m2_layout(spark, d):
    return density.layout(vectors(spark, d).drop("grp"))


@query()
def m3_map(spark, d):
    v = vectors(spark, d).drop("grp")
    return density.plane_map(v, neighbours.nearest(v, v, 5))


@query()
def m3_spectral_map(spark, d):
    v = vectors(spark, d).drop("grp")
    return density.spectral_map(v, neighbours.nearest(v, v, 5))


# Models of weeks and of the period, over all documents: vectors of their hashed words, week of a document its source, agenda its
# language. Words tell languages apart, so that these are what clusters and themes find


def landscape_rows(spark, d):
    docs = tables.spread(T(spark, d, "documents")).select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("none")).alias("week"), "text", F.col("lang").alias("agenda"))
    made = embedding.embed(docs, tables.shared_folder(spark, "cache"), "hashing@500", embedding.hashing_encoder(32))
    return tables.stored(made.withColumn("vec", F.col("vector").cast("array<double>")).drop("vector"))


def landscape_parts(spark, d):
    """Parts of a speech are known for all languages but one."""
    return T(spark, d, "documents").filter("lang <> 'de'").select(F.col("doc_id").alias("id"), F.array(F.col("doc_id"), -F.col("doc_id") - 1).alias("part_ids"))


@query()
def m7_week_model(spark, d):
    found, clusters = landscape.week_model(landscape_rows(spark, d), STOPWORDS)
    return found.join(clusters, ["week", "cluster"], "left").select("week", "id", "cluster", "n", "terms", "agenda")


@query()
def m6_period_model(spark, d):
    assigned, described = landscape.period_model(landscape_rows(spark, d), STOPWORDS, least=20)
    return assigned.join(described, "theme", "left").select("id", "week", "theme", "n", "terms", "agendas")


@query(f"""WITH {CTFIDF}, l AS (SELECT cluster, string_agg(CASE WHEN term IN ('ion', 'ing') THEN upper(term) ELSE upper(term[1]) || term[2:] END, ' · ' ORDER BY rank) AS label FROM k WHERE rank <= 3 GROUP BY 1),
parts AS (SELECT doc_id AS id, cluster, unnest(CASE WHEN lang <> 'de' THEN [doc_id, -doc_id - 1] ELSE [doc_id] END) AS part_id FROM t WHERE cluster >= 0)
SELECT part_id, cluster, label FROM parts JOIN l USING (cluster)""")
def x3_x4_labelled_parts(spark, d):
    docs = topic_docs(spark, d)
    listed = landscape.term_lists(terms.cluster_terms(docs, STOPWORDS), ["cluster"])
    return landscape.labelled_parts(docs.select(F.col("doc_id").alias("id"), "cluster"), listed, landscape_parts(spark, d), ["cluster"], ACRONYMS)


@query()
def x2_x3_x9_rebuild(spark, d):
    """A full rebuild; how many rows each table that it writes has, and their hash."""
    path, parts = tables.shared_folder(spark, "landscape"), landscape_parts(spark, d)
    rows = landscape_rows(spark, d).withColumns({"start": F.struct(F.lit(0).alias("date"), F.col("id").alias("position")), "end": F.struct(F.lit(0).alias("date"), F.col("id").alias("position"))})
    decisions = T(spark, d, "documents").groupBy(F.col("source").alias("agenda_item_id")).agg(F.count("*").alias("decided"))
    stems = spark.createDataFrame(STEMS, "area string, area_order int, stem string")
    landscape.rebuild(rows, parts, path, stopwords=STOPWORDS, acronyms=ACRONYMS, stems=stems, decisions=decisions, least=(8, 20), floor=0.3, encoder="given")
    made = ["week_points", "week_clusters", "week_decisions", "speech_themes", "speech_neighbours", "overview_cells", "overview_themes", "overview_weeks"]
    read = {name: snapshots.read_snapshot(spark, path, name) for name in made} | {"speech_clusters": landscape.speech_clusters(spark, path, parts, ACRONYMS)}
    told = [t.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*t.columns)).alias("hash")).select(F.lit(name).alias("name"), "n", "hash") for name, t in read.items()]
    return reduce(lambda a, b: a.union(b), told)


# The period's overview and index: clicks are noise; a row's theme and cluster come from its type and user

THEMES = {"view": 0, "purchase": 1, "signup": 2, "click": -1}
AREA_STEMS = [("shop", 0, "pur"), ("shop", 0, "sig"), ("web", 1, "vi"), ("web", 1, "si")]
THEMED = f"""q AS (SELECT event_id AS id, strftime(ts, '%G-W%V') AS week, strftime(ts, '%Y-%m-%d') AS date, event_type, CASE {' '.join(f"WHEN event_type = '{k}' THEN {v}" for k, v in THEMES.items())} ELSE 3 END AS theme, CAST(user_id % 5 - 1 AS INTEGER) AS cluster, value FROM events)"""


def themed(spark, d):
    theme = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in THEMES.items() for x in pair]), F.col("event_type")), F.lit(3))
    e = T(spark, d, "events").select(F.col("event_id").alias("id"), calendar.week_id(F.to_date("ts")).alias("week"), F.to_date("ts").cast("string").alias("date"), "event_type", theme.alias("theme"), (F.col("user_id") % 5 - 1).cast("int").alias("cluster"), "value")
    described = e.filter("theme >= 0").groupBy("theme").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("event_type")).alias("terms"))
    return e, described


@query(f"WITH {THEMED} SELECT id, week, CASE WHEN theme <> 3 AND value <= 50 THEN theme ELSE -1 END AS theme FROM q")
def j11_theme_of(spark, d):
    e = themed(spark, d)[0]
    return themes.theme_of(e.select("week", "id"), e.filter("theme <> 3 AND value <= 50")).select("id", "week", "theme")


@query(f"WITH {THEMED} SELECT week, CAST(row_number() OVER (ORDER BY week) - 1 AS INTEGER) AS week_idx FROM (SELECT week FROM q UNION SELECT {WEEK.format('o_orderdate')} FROM orders)")
def u2_union_weeks(spark, d):
    return themes.union_weeks(themed(spark, d)[0], order_weeks(spark, d)[0])


OVERVIEW = f"""WITH {THEMED}, n AS (SELECT theme, week, count(*) AS n FROM q WHERE theme >= 0 GROUP BY 1, 2), c AS (SELECT theme, week, cluster, count(*) AS n, min(id) AS f FROM q WHERE theme >= 0 AND cluster >= 0 AND value > 5 GROUP BY 1, 2, 3),
f AS (SELECT theme, week, cluster AS focus FROM c QUALIFY row_number() OVER (PARTITION BY theme, week ORDER BY n DESC, f) = 1),
t AS (SELECT DISTINCT theme, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS terms FROM q WHERE theme >= 0 GROUP BY 1),
w AS (SELECT week, count(*) FILTER (theme = -1) AS unassigned FROM q GROUP BY 1)
SELECT theme, week, coalesce(n, 0) AS n, focus, CASE WHEN terms = 'view' THEN 'web' WHEN terms IN ('purchase', 'signup') THEN 'shop' ELSE 'weitere' END AS area, unassigned FROM t CROSS JOIN w LEFT JOIN n USING (theme, week) LEFT JOIN f USING (theme, week)"""


@query(OVERVIEW)
def x7_j19_overview(spark, d):
    e, described = themed(spark, d)
    shown = themes.overview(e, e.filter("value > 5"), described, spark.createDataFrame(AREA_STEMS, "area string, area_order int, stem string"))
    return shown["cells"].join(shown["themes"].select("theme", "area"), "theme").join(shown["weeks"].select("week", "unassigned"), "week").select("theme", "week", "n", "focus", "area", "unassigned")


# The same overview, first counted as if one week's events were all of one theme, and then with that week counted anew


@query(OVERVIEW)
def x7_upkeep(spark, d):
    e, described = themed(spark, d)
    stems = spark.createDataFrame(AREA_STEMS, "area string, area_order int, stem string")
    week = e.agg(F.max("week")).head()[0]
    other = e.withColumns({"theme": F.when(F.col("week") == week, F.lit(0)).otherwise(F.col("theme")), "cluster": F.when(F.col("week") == week, F.lit(0)).otherwise(F.col("cluster"))})
    before = {n: tables.stored(t) for n, t in themes.overview(other, other.filter("value > 5"), described, stems).items()}
    shown = themes.refreshed_overview(before, e, e.filter("value > 5"), described, stems, [week])
    return shown["cells"].join(shown["themes"].select("theme", "area"), "theme").join(shown["weeks"].select("week", "unassigned"), "week").select("theme", "week", "n", "focus", "area", "unassigned")


TOPIC_LIST = "string_agg('t' || cluster || '+' || 'u' || '+' || 'v', ',' ORDER BY n DESC, cluster)"


@query(f"""WITH {THEMED}, c AS (SELECT week, cluster, count(*) AS n FROM q WHERE cluster >= 0 GROUP BY 1, 2), k AS (SELECT week, {TOPIC_LIST} AS topics FROM c GROUP BY 1)
SELECT 'week' AS kind, week AS name, count(*) AS n, any_value(topics) AS shown FROM q LEFT JOIN k USING (week) GROUP BY week
UNION ALL SELECT 'theme', CAST(theme AS VARCHAR), count(*), CASE WHEN min(event_type) = 'view' THEN 'web' WHEN min(event_type) IN ('purchase', 'signup') THEN 'shop' ELSE 'weitere' END FROM q WHERE theme >= 0 GROUP BY theme""")
def x8_index(spark, d):
    e, described = themed(spark, d)
    shown = themes.overview(e, e, described, spark.createDataFrame(AREA_STEMS, "area string, area_order int, stem string"))
    made = themes.index_tables(e, _week_terms(e), shown)
    weeks = made["summaries"].select(F.lit("week").alias("kind"), F.col("week").alias("name"), F.col("speeches").alias("n"), _topics().alias("shown"))
    return weeks.union(made["themes"].select(F.lit("theme"), F.col("theme").cast("string"), "n", "area"))


def _week_terms(e):
    return e.select("week", "cluster").distinct().withColumn("terms", F.array(F.concat(F.lit("t"), F.col("cluster")), F.lit("u"), F.lit("v"), F.lit("w")))


def _topics():
    return F.array_join(F.transform("topics", lambda t: F.array_join(t, "+")), ",")


# Exploration


@query("SELECT doc_id FROM documents WHERE lang IN ('de', 'fr') AND source IN ('src0', 'src1')")
def p18_facet_filter(spark, d):
    return explore.facet_filter(T(spark, d, "documents"), {"lang": ["de", "fr"], "source": ["src0", "src1"]}).select("doc_id")


# Every place of each term: the sum of what lies before it, texts being cut at the term


@query("""WITH t AS (SELECT doc_id, lower(text) AS low, unnest(['the', 'and', 'tion']) AS term FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and') AND contains(lower(text), 'tion')),
p AS (SELECT doc_id, term, unnest(string_split(low, term)) AS part, generate_subscripts(string_split(low, term), 1) AS i, len(string_split(low, term)) AS n FROM t)
SELECT doc_id, term, CAST(sum(length(part)) OVER (PARTITION BY doc_id, term ORDER BY i) + (i - 1) * length(term) + 1 AS INTEGER) AS place FROM p QUALIFY i < n""")
def p19_term_filter(spark, d):
    terms = ["The", "and", "TION", "the"]
    x = explore.term_filter(tables.spread(T(spark, d, "documents")), terms).select("doc_id", F.explode("places").alias("p"))
    return x.select("doc_id", F.get(F.array(*[F.lit(t) for t in explore.distinct_terms(terms)]), "p.term").alias("term"), "p.place")


@query("SELECT event_id FROM events WHERE event_type <> 'click'")
def p20_visibility(spark, d):
    return T(spark, d, "events").filter(explore.default_visibility({}, F.col("event_type") == "click", F.lit(False))).select("event_id")


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE source IN ('src0', 'src1') GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def a20_facet_counts(spark, d):
    return explore.facet_counts(T(spark, d, "documents"), ["lang", "source"], {"source": ["src0", "src1"]})


@query("""WITH n AS (SELECT source AS value, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rank, max(n) OVER () AS most FROM n)
SELECT 'source' AS facet, CAST(rank AS INTEGER) AS rank, value, n, round(n / most, 6) AS bar FROM k WHERE rank <= 12 UNION ALL SELECT 'source', 13, 'other', CAST(sum(n) AS BIGINT), round(sum(n) / max(most), 6) FROM k WHERE rank > 12 HAVING count(*) > 0""")
def a21_profile(spark, d):
    return explore.profile(T(spark, d, "documents"), F.col("lang") == "en", ["source"]).withColumn("bar", r6(F.col("bar")))


@query("SELECT lang, count(*) AS n, round(quantile_cont(length(text), 0.25), 6) AS q1, round(quantile_cont(length(text), 0.5), 6) AS median, round(quantile_cont(length(text), 0.75), 6) AS q3, round(avg(CASE WHEN length(text) < 500 THEN 1.0 ELSE 0.0 END), 6) AS short FROM documents GROUP BY 1")
def a26_corpus_profile(spark, d):
    x = explore.corpus_profile(T(spark, d, "documents"), "lang")
    return x.select("lang", "n", *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3", "short")])


# Sketches of each source, merged by language: counts are the exact ones, and so is, within the stated error, the rank of each quartile


@query("""SELECT lang, count(*) AS n, round(avg(CASE WHEN length(coalesce(text, '')) < 500 THEN 1.0 ELSE 0.0 END), 6) AS short, true AS q1, true AS median, true AS q3 FROM documents GROUP BY 1""")
def a26_sketched_profile(spark, d):
    docs = T(spark, d, "documents").withColumn("size", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    x = explore.merged_profile(explore.length_sketches(docs, "lang", "source"), "lang")
    told = docs.alias("d").join(x.alias("x"), F.expr("x.lang <=> d.lang"))
    # rows below a quartile, and rows up to it, lie about its share
    off = {a: (F.count_if(F.col("d.size") < F.col(f"x.{a}")) <= F.count("*") * (p + explore.RANK_ERROR) + 1) & (F.count_if(F.col("d.size") <= F.col(f"x.{a}")) >= F.count("*") * (p - explore.RANK_ERROR) - 1) for a, p in explore.QUARTILES.items()}
    return told.groupBy("x.lang").agg(F.first("x.n").alias("n"), r6(F.first("x.short")).alias("short"), *[c.alias(a) for a, c in off.items()])


@query("""WITH l AS (SELECT conv_id, role, turn, unnest(string_split(text, chr(10))) AS line FROM conversations), k AS (SELECT *, CASE WHEN ends_with(line, '.') THEN 'text' ELSE 'comment' END AS kind FROM l)
SELECT 'speeches' AS entity, count(*) AS n FROM conversations UNION ALL SELECT 'speakers', count(DISTINCT role) FROM conversations UNION ALL SELECT 'agenda items with speeches', count(DISTINCT conv_id) FROM conversations WHERE role <> 'system'
UNION ALL SELECT 'sittings', count(DISTINCT conv_id) FROM conversations UNION ALL SELECT 'agenda items', count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'paragraphs: ' || kind, count(*) FROM k GROUP BY kind""")
def a26_entities(spark, d):
    parts, sittings, lines, _ = week_parts(spark, d)
    return explore.entity_counts(parts, sittings, T(spark, d, "documents").withColumnRenamed("doc_id", "agenda_item_id"), lines)


@query("""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations), k AS (SELECT *, CASE WHEN ends_with(line, '.') THEN 'text' ELSE 'comment' END AS kind FROM l)
SELECT kind, count(*) AS n, round(count(*) / (SELECT count(*) FROM conversations WHERE text IS NOT NULL), 6) AS per_speech, round(avg(length(line)), 6) AS chars FROM k GROUP BY 1""")
def a26_kinds(spark, d):
    x = explore.paragraph_kinds(week_parts(spark, d)[2])
    return x.select("kind", "n", r6(F.col("per_speech")).alias("per_speech"), r6(F.col("chars")).alias("chars"))


@query(f"""WITH {THEMED}, c AS (SELECT week, cluster, count(*) AS n FROM q WHERE cluster >= 0 GROUP BY 1, 2), k AS (SELECT week, {TOPIC_LIST} AS topics FROM c GROUP BY 1)
SELECT week, string_agg(DISTINCT date, ',' ORDER BY date) AS dates, count(*) AS speeches, any_value(topics) AS topics FROM q LEFT JOIN k USING (week) GROUP BY 1""")
def a19_week_summary(spark, d):
    e = themed(spark, d)[0]
    return themes.week_summary(e, _week_terms(e)).select("week", F.array_join("dates", ",").alias("dates"), "speeches", _topics().alias("topics"))


@query("SELECT count(*) AS n, bit_xor(CAST('0x' || substr(md5(doc_id || ':' || sha1(coalesce(text, ''))), 1, 15) AS BIGINT)) AS rows_hash, sha1('{\"model\": \"hashing\"}') AS params_sha1 FROM documents")
def a18_fingerprint(spark, d):
    return tables.fingerprint(T(spark, d, "documents").withColumnRenamed("doc_id", "id"), {"model": "hashing"})


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, part, i, {COUNT.format('part')} AS words FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
r AS (SELECT doc_id, i, 0 AS pos, words AS n FROM p WHERE i = 1
UNION ALL SELECT p.doc_id, p.i, CASE WHEN n + words <= 100 THEN pos ELSE pos + 1 END, CASE WHEN n + words <= 100 THEN n + words ELSE words END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
c AS (SELECT doc_id, pos, 'passage: ' || string_agg(part, chr(10) ORDER BY i) AS chunk FROM r JOIN p USING (doc_id, i) GROUP BY 1, 2),
h AS (SELECT doc_id, pos, md5(w) AS h FROM (SELECT doc_id, pos, unnest({WORDS.format('lower(chunk)')}) AS w FROM c)),
v AS (SELECT doc_id, pos, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS dim, sum(CASE WHEN CAST('0x' || substr(h, 9, 1) AS INTEGER) < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS x FROM h GROUP BY 1, 2, 3),
u AS (SELECT doc_id, pos, dim, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id, pos)) AS x FROM v QUALIFY sum(x * x) OVER (PARTITION BY doc_id, pos) > 0),
m AS (SELECT doc_id, dim, sum(x) / any_value(k) AS x FROM u JOIN (SELECT doc_id, count(*) AS k FROM c GROUP BY 1) USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, dim, round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS FLOAT) AS DOUBLE), 5) AS value FROM m QUALIFY abs(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id))) > 0.00001""")
def m1_i1_embed(spark, d):
    rows = tables.spread(T(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    made = embedding.embed(rows, tables.shared_folder(spark, "cache"), "hashing@100", embedding.hashing_encoder(), most=100, separator="\n")
    each = made.select(F.col("id").alias("doc_id"), F.posexplode("vector").alias("dim", "x")).filter("abs(x) > 0.00001")
    return each.select("doc_id", F.col("dim").cast("long").alias("dim"), F.round(F.col("x").cast("double"), 5).alias("value"))


@query("SELECT sha1(coalesce(text, '')) AS text_sha, count(*) AS n FROM documents GROUP BY 1")
def j10_i1_cache(spark, d):
    """A second run over all texts after one over those of one language finds these in the cache: each text is there once."""
    rows, cache = T(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), tables.shared_folder(spark, "cache")
    for some in (rows.filter("lang = 'en'"), rows):
        made = embedding.embed(some, cache, "hashing@500", embedding.hashing_encoder(8))
    held = tables.read_table(spark, cache).groupBy("text_sha").agg(F.count("*").alias("once"))
    n = made.groupBy(F.sha1(F.coalesce("text", F.lit(""))).alias("text_sha")).agg(F.count("*").alias("n"))
    return n.join(held.filter("once = 1"), "text_sha").select("text_sha", "n")
