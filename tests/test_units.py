import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.functions import calendar, names, text
from topicspark.operators import corpus, density, neighbours, origins, terms, themes
from topicspark.sources import tables
from topicspark.streaming import embedding


def one(spark, column, *values, schema="a string, b string"):
    return spark.createDataFrame([values], schema).select(column.alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("title", "top", "short"),
    [
        (None, "Einzelplan 09", "Haushalt: Wirtschaft und Energie"),
        (None, "Einzelplan 99", "Haushalt: Einzelplan 99"),
        (None, "Einzelplan", "Haushalt"),
        (None, "ZP 1", "ZP 1"),
        (None, None, None),
        ("(Schluss der Sitzung)", "1", "1"),
        ("Erste Beratung | Mieten | b) Beratung des Antrags | Anderes", "1", "Mieten"),
        ("Erste Beratung des Entwurfs eines Zweiten Gesetzes zur Änderung", "1", "Zur Änderung"),
    ],
)
def test_short_title(spark, title, top, short):
    assert one(spark, names.short_title(F.col("a"), F.col("b")), title, top) == short


def test_names(spark):
    assert one(spark, names.fraction_name(F.col("a")), " Fraktion der AfD", "") == "AfD"
    assert one(spark, names.fraction_name(F.col("a")), "Fraktion DIE LINKE", "") == "Die Linke"
    assert one(spark, names.fraction_name(F.col("a")), "Land Berlin", "") == "Land Berlin"
    assert one(spark, names.requested_by(F.col("a")), "Aktuelle Stunde | auf Verlangen der Fraktionen der CDU/CSU und SPD", "") == ["CDU/CSU", "SPD"]
    assert one(spark, names.requested_by(F.col("a")), "Aktuelle Stunde", "") == []
    assert one(spark, names.requested_by(F.col("a")), "Anderes", "") is None
    assert one(spark, names.display_name(F.col("a")), "Max Muster, Minister (Ort)", "") == "Max Muster"
    assert one(spark, names.rede_id(F.col("a")), "ID21-3", "") == "ID21"
    assert one(spark, names.speaker_group(F.col("a"), F.col("b")), "Senator (Berlin)", "SPD") == "Bundesrat"
    assert one(spark, names.speaker_group(F.col("a"), F.col("b")), "Bundesminister für X", "SPD") == "Bundesregierung"
    assert one(spark, names.speaker_group(F.col("a"), F.col("b")), None, None) == "Sonstige"
    assert one(spark, names.agenda_kind(F.col("a")), "Fragestunde 1", "") == "fragestunde"
    assert one(spark, names.topic_label(F.array(F.lit("usa"), F.lit("öl"), F.lit("bau"), F.lit("x")), ["usa"]), "", "") == "USA · Öl · Bau"


def test_calendar(spark):
    assert one(spark, calendar.week_id(F.to_date("a")), "2027-01-01", "") == "2026-W53"
    assert one(spark, calendar.monday_of(F.col("a")), "2026-W01", "") == dt.date(2025, 12, 29)


def test_chunks(spark):
    made = lambda t: one(spark, text.chunks(F.col("a"), 5), t, "")
    assert made("a b\n\nc d\n\ne f g h i j\n\nk") == ["a b\n\nc d", "e f g h i j", "k"]
    assert made("") == [""] == made(None)


def test_episodes(spark):
    shares = [0, 0.1, 0, 0, 0.1, 0, 0, 0, 0, 0.1, 0.1, 0, 0, 0, 0]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(map(float, shares))], "theme int, week_idx int, share double")
    got = [tuple(r) for r in origins.episodes(df, 0.05, 4).select("start", "end", "period_start").orderBy("start").collect()]
    assert got == [(1, 4, True), (9, 10, False)]


def _parts(spark, rows):
    return spark.createDataFrame(rows, "rede_id string, position int, person_id string, part_id string, text string, chair array<string>")


def test_interruptions(spark):
    long = "wort " * 30
    rows = [("r", 1, "m", "1", long, ["", "Eine Zwischenfrage?"]), ("r", 2, "a", "2", "Frage", []), ("r", 3, "m", "3", "kurz", []), ("r", 4, "a", "4", "weiter", []),
            ("r", 5, "m", "5", long, ["Zu einer Kurzintervention"]), ("r", 6, "a", "6", "neu", []), ("r", 7, "b", "7", "auch", [])]
    got = {r["part_id"]: (r["interruption"], r["interruption_start"]) for r in corpus.interruptions(_parts(spark, rows)).collect()}
    assert got["1"] == (None, None)
    assert got["2"] == ("zwischenfrage", "2") == got["4"]
    assert got["6"] == ("kurzintervention", "6")
    assert got["7"] == ("zwischenfrage", "7")
    marks = {(r["in_person"], r["kind"], r["target"]) for r in corpus.markers(corpus.interruptions(_parts(spark, rows))).collect()}
    assert ("m", "zwischenfrage", "2") in marks and ("a", "antwort", "1") in marks and ("b", "antwort", "1") in marks


def test_knn_excludes_groups(spark):
    v = np.eye(3)[[0, 0, 1, 1, 2]] + 0.1
    rows = [(i, [float(y) for y in x], g) for i, (x, g) in enumerate(zip(v, ["a", "a", "b", None, None], strict=True))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, grp string")
    for block in (1, 2, 4096):
        got = neighbours.neighbour_lists(neighbours.nearest(df, df, 2, floor=0.5, block=block)).collect()
        assert {r["id"]: r["near_ids"] for r in got} == {2: [3], 3: [2]}


def test_ctfidf(spark):
    docs = [(i, f"miete wohnung {'bauen' if i < 3 else 'miete'}", 0) for i in range(5)] + [(i, "rente alter pflege", 1) for i in range(5, 10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, cluster int")
    best = {r["cluster"]: r["term"] for r in terms.cluster_terms(df, ["und"]).filter("rank = 1").collect()}
    assert best == {0: "miete", 1: "alter"}
    assert terms.majority(df, "cluster", "text", "doc_id").filter("cluster = 0").head()["n"] == 3


def test_areas_and_vote(spark):
    stems = spark.createDataFrame([("a", 0, "miet"), ("b", 1, "rent")], "area string, area_order int, stem string")
    t = spark.createDataFrame([(0, 0, "miete"), (0, 1, "rente"), (1, 0, "xyz")], "theme int, rank int, term string")
    assert {tuple(r) for r in themes.areas(t, stems).collect()} == {(0, "a"), (1, "weitere")}


def test_density_finds_three_themes(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([np.eye(16)[k] + rng.normal(0, 0.05, (30, 16)) for k in range(3)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    got = {r["id"]: r["cluster"] for r in density.density_clusters(df, 10).collect()}
    for k in range(3):
        assert len({got[i] for i in range(30 * k, 30 * k + 30)} - {-1}) == 1
    assert len(set(got.values()) - {-1}) == 3
    assert {r["cluster"] for r in density.density_clusters(df.filter("id < 15"), 10).collect()} == {-1}


def test_cache_and_model(spark, tmp_path):
    calls = []
    rows = spark.createDataFrame([(1, "ein Satz"), (2, "ein Satz"), (3, "noch einer")], "id long, text string")
    load = embedding.hashing_encoder(8)
    first = embedding.embed(rows, str(tmp_path / "c"), "k", load).collect()
    assert len(first) == 3 and spark.read.parquet(str(tmp_path / "c")).count() == 2

    def broken():
        raise RuntimeError("the cache was missed")

    assert len(embedding.embed(rows, str(tmp_path / "c"), "k", broken).collect()) == 3
    # another counter, here of characters, cuts other chunks
    load2 = embedding.hashing_encoder(8)
    by_words, by_chars = (embedding.pooled(rows.selectExpr("string(id) AS text_sha", "concat_ws('\\n\\n', text, text, text) AS text"), load2, most=5, **more).filter("text_sha = '3'").head()["vector"] for more in ({}, {"count": len}))
    assert len(by_words) == len(by_chars) == 8 and by_words != by_chars
    build = lambda r: calls.append(1) or {"rows": r}
    assert tables.build_if_changed(rows, {"a": 1}, str(tmp_path / "m"), build)[1]
    assert not tables.build_if_changed(rows, {"a": 1}, str(tmp_path / "m"), build)[1]
    assert tables.build_if_changed(rows, {"a": 2}, str(tmp_path / "m"), build)[1]


def test_a_stream_that_is_started_again_adds_each_text_once(spark, tmp_path, monkeypatch):
    """The second batch breaks off twice: after it has written, and before; two restarts finish it."""
    source, cache, done = str(tmp_path / "in"), str(tmp_path / "c"), str(tmp_path / "checkpoint")
    add = lambda *rows: spark.createDataFrame(list(rows), "id long, text string").coalesce(1).write.mode("append").json(source)
    run = lambda: embedding.embed_stream(spark.readStream.schema("id long, text string").json(source), cache, "k@1", embedding.hashing_encoder(8), done).awaitTermination()
    held = lambda: sorted(r["text_sha"] for r in spark.read.parquet(cache).collect())
    add((1, "eins"), (2, "zwei"), (3, "zwei"))
    run()
    assert len(held()) == 2
    real, fails = embedding.embed, ["after", "before"]

    def broken(*args, **options):
        how = fails.pop(0) if fails else ""
        out = None if how == "before" else real(*args, **options)
        if how:
            raise OSError("lost")
        return out

    monkeypatch.setattr(embedding, "embed", broken)
    add((4, "zwei"), (5, "drei"), (6, None))
    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    once = held()
    assert not fails and len(once) == len(set(once)) == 4
    run()
    assert held() == once
    embedding.compact(spark, cache, "k@1")
    assert held() == once and spark.read.parquet(cache).select("batch").distinct().count() == 1
    rows = spark.createDataFrame([(1, "eins"), (2, "drei")], "id long, text string")
    assert real(rows, cache, "k@1", lambda: pytest.fail("the cache was missed")).count() == 2


def test_the_cache_is_joined_as_it_lies(spark, tmp_path):
    """A second run shuffles its own rows alone, also with another number of shuffle partitions; other buckets keep all texts."""
    cache, load = str(tmp_path / "it's c"), embedding.hashing_encoder(8)
    rows = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        first = {r["id"]: r["vector"] for r in embedding.embed(rows.filter("id < 20"), cache, "a/b=1", load, buckets=8).collect()}
        embedding.embed(rows.filter("id < 30"), cache, "other", load).collect()
        assert embedding.Cache(spark, cache).layouts() == [8] and len(first) == 20
        got = {}
        for partitions in ("3", "20"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            made = embedding.embed(rows.withColumn("vector", F.lit("clash")), cache, "a/b=1", load)
            plan = made._jdf.queryExecution().executedPlan().toString()
            cut = plan[plan.index("FileScan parquet") :] if "FileScan parquet" in plan else ""
            assert "Bucketed: true" in cut and plan.count("Exchange") == 1, plan
            got = {r["id"]: r["vector"] for r in made.collect()}
            assert len(got) == 100 and all(got[i] == v for i, v in first.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])
    missed = lambda: pytest.fail("the cache was missed")
    held = lambda key: sorted(r["text_sha"] for r in spark.read.parquet(cache).filter(F.col("key") == key).collect())
    texts = held("a/b=1")
    assert len(texts) == len(set(texts)) == 40
    # texts of more than five copies reach their rows by a broadcast
    many = rows.union(spark.createDataFrame([(k, "text 7") for k in range(100, 110)], rows.schema))
    by_hash = many.withColumn("text_sha", F.sha1("text"))
    assert embedding._hot(by_hash, 5) == [hashlib.sha1(b"text 7").hexdigest()] and embedding._hot(by_hash, 20) == embedding._hot(by_hash.limit(0), 0) == []
    assert {r["id"]: r["vector"] for r in embedding.embed(many, cache, "a/b=1", missed, copies=5).collect()} == got | {k: got[7] for k in range(100, 110)}
    # keys move to other buckets one by one
    embedding.compact(spark, cache, "a/b=1", buckets=2)
    assert embedding.Cache(spark, cache).layouts() == [2, 8] and held("a/b=1") == texts
    assert {r["id"]: r["vector"] for r in embedding.embed(rows, cache, "a/b=1", missed).collect()} == got
    embedding.compact(spark, cache, "other", buckets=2)
    assert held("other") == sorted(held("other")) and len(held("other")) == 30
    embedding.compact(spark, cache, "nothing")
    assert {r["id"]: r["vector"] for r in embedding.embed(rows, cache, "a/b=1", missed).collect()} == got
    assert embedding.embed(rows.limit(0), cache, "a/b=1", missed).count() == 0


def test_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        tables.read_table(spark, str(tmp_path / "nowhere"))
    assert tables.read_optional(spark, str(tmp_path / "nowhere"), "a int").count() == 0
    df = spark.createDataFrame([("w1", 1), ("w2", 2)], "week string, n int")
    tables.write_weeks(df, str(tmp_path / "w"))
    tables.write_weeks(df.filter("week = 'w2'").withColumn("n", F.lit(5)), str(tmp_path / "w"))
    (tmp_path / "w" / "notes.json").write_text('{"n": 9}')
    assert {tuple(r) for r in tables.read_weeks(spark, str(tmp_path / "w")).select("week", "n").collect()} == {("w1", 1), ("w2", 5)}
    tables.write_weeks(df, str(tmp_path / "p"), "parquet")
    assert {tuple(r) for r in tables.read_weeks(spark, str(tmp_path / "p"), "n int, week string", "parquet").select("week", "n").collect()} == {("w1", 1), ("w2", 2)}
    more = tables.with_optional(df, n="int", kind="string")
    assert more.columns == ["week", "n", "kind"] and more.filter("kind IS NULL").count() == 2
    assert tables.not_kind(df).count() == 2 and tables.not_kind(more).count() == 0
    assert tables.write_mapping(df.withColumnRenamed("week", "id"), str(tmp_path / "m")) == 2
