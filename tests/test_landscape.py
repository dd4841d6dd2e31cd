"""Models of weeks and of the period on a synthetic period of three topics, and their rebuild."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicspark.operators import landscape
from topicspark.sources import snapshots, tables
from topicspark.sources.snapshots import read_snapshot

WORDS = ["rente alter vorsorge", "klima energie wind", "schule lehrer bildung"]


@pytest.fixture(scope="module")
def period(spark):
    """Three topics of 30 rows; the first 20 of each are in the first week, the rest in the second."""
    r = np.random.default_rng(0)
    rows = []
    for topic in range(3):
        for k in range(30):
            vec = np.eye(16)[topic] + r.normal(0, 0.05, 16)
            rows.append((topic * 30 + k, "2026-W01" if k < 20 else "2026-W02", f"{WORDS[topic]} heute {k}", [float(x) for x in vec / np.linalg.norm(vec)], f"top{topic}"))
    return spark.createDataFrame(rows, "id long, week string, text string, vec array<double>, agenda string")


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame([(0, [0, 1000])], "id long, part_ids array<long>")


def test_period_model(period):
    assigned, described = landscape.period_model(period, least=10)
    themes = {r["theme"]: r for r in described.collect()}
    assert {k: r["n"] for k, r in themes.items()} == {0: 30, 1: 30, 2: 30}
    for r in assigned.collect():
        assert themes[r["theme"]]["agendas"] == [f"top{r['id'] // 30}"]
        assert set(WORDS[r["id"] // 30].split()) <= set(themes[r["theme"]]["terms"])


def test_rebuild_keeps_other_weeks(spark, period, parts, tmp_path):
    path = str(tmp_path / "out")
    # rows get their vectors from a step of the user's
    vectors = period.select("id", "vec")
    decisions = spark.createDataFrame([("top0", "angenommen"), ("top9", "abgelehnt")], "agenda_item_id string, result string")
    stems = spark.createDataFrame([("klima", 0, "klim"), ("soziales", 1, "rent")], "area string, area_order int, stem string")
    spoken = period.drop("vec").withColumns({c: F.struct(F.lit("d").alias("date"), F.col("id").alias("position")) for c in ("start", "end")})
    landscape.rebuild(spoken, parts, path, embed=lambda df: df.join(vectors, "id"), encoder="test", decisions=decisions, stems=stems, least=(5, 10), floor=0.0)
    following = {r["id"]: r["next"] for r in read_snapshot(spark, path, "week_points").collect()}
    assert following[0] == 1 and following[19] == 30 and following[79] is None and following[20] == 21
    assert {(r["week"], r["result"]) for r in read_snapshot(spark, path, "week_decisions").collect()} == {("2026-W01", "angenommen"), ("2026-W02", "angenommen")}
    cells = {(r["theme"], r["week"]): r["n"] for r in read_snapshot(spark, path, "overview_cells").collect()}
    assert cells == {(t, w): n for t in range(3) for w, n in (("2026-W01", 20), ("2026-W02", 10))}
    assert sorted(r["area"] for r in read_snapshot(spark, path, "overview_themes").collect()) == ["klima", "soziales", "weitere"]
    every = read_snapshot(spark, path, "week_points")
    assert every.groupBy("week").count().orderBy("week").collect() == [("2026-W01", 60), ("2026-W02", 30)]
    assert every.filter(F.size("similar") != 5).count() == 0
    # within a week each point's similar ones are of its own topic; over the period its own agenda item is left out
    assert all(near // 30 == r["id"] // 30 for r in every.collect() for near in r["similar"])
    lists = {r["part_id"]: r["near_ids"] for r in read_snapshot(spark, path, "speech_neighbours").collect()}
    assert len(lists) == 91 and lists[1000] == lists[0] and all(near >= 30 for near in lists[0])
    themed = {r["part_id"]: r for r in read_snapshot(spark, path, "speech_themes").collect()}
    assert themed.keys() == {*range(90), 1000} and themed[1000]["label"] == themed[0]["label"]
    labels = landscape.speech_clusters(spark, path, parts)
    assert labels.count() == 1 + every.filter("cluster >= 0").count()

    # one week anew from changed rows: the other week and the neighbours stay
    fewer = period.filter("week = '2026-W01' OR id < 60")
    landscape.rebuild(fewer, parts, path, weeks=["2026-W02"], overview=False, least=(5, 10), floor=0.0)
    again = read_snapshot(spark, path, "week_points")
    assert again.groupBy("week").count().orderBy("week").collect() == [("2026-W01", 60), ("2026-W02", 20)]
    assert read_snapshot(spark, path, "speech_neighbours").count() == 91


def test_weeks_without_rows_give_no_cluster(spark, period):
    found, clusters = landscape.week_model(period.limit(0))
    assert found.count() == 0 and clusters.count() == 0


def test_a_broken_rebuild_leaves_the_last_version(spark, period, parts, tmp_path, monkeypatch):
    path, stems = str(tmp_path / "out"), spark.createDataFrame([("klima", 0, "klim")], "area string, area_order int, stem string")
    given = {"stems": stems, "least": (5, 10), "floor": 0.0}
    assert landscape.rebuild(period, parts, path, **given) == 1
    before = {r["name"]: r["n"] for r in snapshots.row_counts(spark, path).collect()}
    assert before.keys() == {"week_points", "week_clusters", "speech_themes", "speech_neighbours", "overview_cells", "overview_themes", "overview_weeks"}
    made, fewer = tables.made_folders(spark), period.filter("id < 60")
    # broken between two tables, and just before the manifest
    for step in ("write_weeks:week_clusters", "commit:"):
        method, name = step.split(":")
        real = getattr(snapshots.Version, method)

        def broken(self, *args, real=real, name=name):
            if not args or args[0] == name:
                raise OSError("lost")
            return real(self, *args)

        with monkeypatch.context() as m:
            m.setattr(snapshots.Version, method, broken)
            with pytest.raises(OSError):
                landscape.rebuild(fewer, parts, path, **given)
        assert {r["name"]: r["n"] for r in snapshots.row_counts(spark, path).collect()} == before
    tables.clear_stored(spark, [p for p in tables.made_folders(spark) if p not in made])
    assert landscape.rebuild(fewer, parts, path, **given) == 2
    after = {r["name"]: r["n"] for r in snapshots.row_counts(spark, path).collect()}
    assert after["week_points"] == 60 < before["week_points"] == 90
    assert read_snapshot(spark, path, "week_points", 1).count() == 90
    assert tables.made_folders(spark) == made
    # one week anew, with an unchanged model: its cells alone are counted again
    cells = lambda: sorted(tuple(r) for r in read_snapshot(spark, path, "overview_cells").select("theme", "week", "n").collect())
    full = cells()
    assert landscape.rebuild(fewer, parts, path, weeks=["2026-W02"], **given) == 3 and cells() == full


def test_versions_share_weeks_and_are_cleaned(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = lambda *x: spark.createDataFrame(list(x), "week string, n long")
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, path, "t")
    for weeks, table in ((None, rows(("a", 1), ("b", 1))), (["b"], rows(("b", 2))), (["a"], rows().limit(0)), (["c"], rows(("c", 4)))):
        version = snapshots.Version(spark, path)
        version.write_weeks("t", table, weeks)
        version.commit()
    held = lambda v=None: sorted(tuple(r) for r in read_snapshot(spark, path, "t", v).select("week", "n").collect())
    assert [held(v) for v in (1, 2, 3, 4)] == [[("a", 1), ("b", 1)], [("a", 1), ("b", 2)], [("b", 2)], [("b", 2), ("c", 4)]]
    snapshots.clean(spark, path, keep=1)
    assert held() == [("b", 2), ("c", 4)] and snapshots.versions(spark, path) == [4]
    assert sorted(p.name for p in (tmp_path / "v/data/t").glob("version=*")) == ["version=2", "version=4"]
    # a version whose number another run has taken changes nothing
    one, other = snapshots.Version(spark, path), snapshots.Version(spark, path)
    other.write("u", rows(("x", 1)))
    other.commit()
    with pytest.raises(Exception, match="exist"):
        one.commit()
    assert read_snapshot(spark, path, "u").count() == 1
