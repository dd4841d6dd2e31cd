"""Search for terms: every place, many terms in one pass, and marking."""

import numpy as np
from pyspark.sql import functions as F

from topicspark.operators import explore


def brute(text, terms):
    low = (text or "").lower()
    return sorted((k + 1, i) for i, t in enumerate(terms) for k in range(len(low) - len(t) + 1) if low.startswith(t, k))


def test_ten_thousand_terms_in_one_pass(spark):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcé"), n))
    terms = list(dict.fromkeys(word(rng.integers(1, 8)) for _ in range(14_000)))[:10_000]
    texts = [" ".join(word(rng.integers(1, 12)) for _ in range(30)) for _ in range(20)] + [None, "", "ABC É ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: [(p["place"], p["term"]) for p in r["places"]] for r in explore.term_places(df, terms).collect()}
    assert got == {i: brute(t, terms) for i, t in enumerate(texts)}


def test_all_terms_are_asked_for(spark):
    df = spark.createDataFrame([(1, "The band and the hand"), (2, "the"), (3, None)], "id long, text string")
    got = explore.term_filter(df, ["AND", "the", "The", ""]).collect()
    assert [(r["id"], [tuple(p) for p in r["places"]]) for r in got] == [(1, [(1, 1), (0, 6), (0, 10), (1, 14), (0, 19)])]
    assert explore.term_filter(df, []).count() == 3 and explore.term_filter(df.limit(0), ["a"]).count() == 0


def test_matches_are_marked(spark):
    df = spark.createDataFrame([(1, "Abcabd x AB"), (2, "none"), (3, "abab"), (4, None), (5, "")], "id long, text string")
    x = explore.term_places(df, ["ab", "bc", "bd"]).select("id", explore.marked(F.col("text"), F.col("places"), [2, 2, 2], "[", "]").alias("m"))
    assert {r["id"]: r["m"] for r in x.collect()} == {1: "[Abcabd] x [AB]", 2: "none", 3: "[abab]", 4: None, 5: ""}


def test_sketches_of_weeks_are_merged(spark):
    rng = np.random.default_rng(2)
    sizes = (rng.pareto(1.2, 20_000) * 300).astype(int).clip(0, 50_000)
    df = spark.createDataFrame([(f"w{k % 30}", int(n)) for k, n in enumerate(sizes)], "week string, n int").select("week", F.repeat(F.lit("x"), F.col("n")).alias("text"))
    (got,) = explore.merged_profile(explore.length_sketches(df, "week")).collect()
    assert got["n"] == 20_000 and got["short"] == (sizes < 500).mean()
    for name, p in explore.QUARTILES.items():
        assert (sizes < got[name]).mean() - explore.RANK_ERROR <= p <= (sizes <= got[name]).mean() + explore.RANK_ERROR
    values = rng.normal(0, 1, 20_000)
    near = spark.createDataFrame([(k % 7, float(v)) for k, v in enumerate(values)], "week int, value double")
    for r in explore.floors_of_sketches(explore.similarity_sketches(near, "week"), [-1.0, 0.0, 1.5]).collect():
        assert abs(r["below"] - (values < r["floor"]).mean()) <= explore.RANK_ERROR
    assert explore.merged_profile(explore.length_sketches(df.limit(0), "week"), "week").count() == 0


def test_matches_are_held_as_numbers():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["the and tion " * 200] * 1000)
    tracemalloc.start()
    got = explore.places_of(texts, ("the", "and", "tion"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1000 and len(got.flatten()) == 600_000 and peak < 16 << 20


def test_texts_are_embedded_a_few_at_a_time():
    import pyarrow as pa

    from topicspark.streaming import embedding

    class Taken:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return run

    run = embedding.pooled(Taken(), embedding.hashing_encoder(8), most=5)
    batch = pa.record_batch({"text_sha": [str(k) for k in range(1000)], "text": [f"word{k} a b" for k in range(1000)]})
    made = list(run(iter([batch])))
    assert max(m.num_rows for m in made) <= embedding.TEXTS and sum(m.num_rows for m in made) == 1000
