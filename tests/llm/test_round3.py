import hashlib
import math
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers as P
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.compare import oracle_rows, query_rows
from topicspark.llm import alignment, mixing, quality, simhash, toxicity, whitening, winnowing
from topicspark.llm import queries as registered
from topicspark.llm.common import crc_mod

SF = "/root/testdata/sf0.001"
FIRST, SECOND = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


# Winnowing


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(text, items):
    own, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        size = min(10, len(w))
        windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for k in range(len(own) - size + 1 if w else 0):
            if tuple(own[k : k + size]) in windows:
                hit |= set(range(k, k + size))
                found.add(name)
    ids = sorted(str(x) for x in found if x is not None)
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "a b c d e f g h i j"), (2, "Eta theta"), (2, "iota"), (3, "a a a a a a a a a a a a"), (4, None), (5, " -- "), (None, "k l m"), (6, "A-b_c d e f g h i j k"), (7, "ñandú é 日本 x y z 1 2 3 4 5 6 7"), (8, "a b c d e f g h i j")]
TEXTS = [None, "", " ", "A b c d e f g h i j k l m", "x A B C D E F G H I J y", "zeta eta, theta! iota", "a " * 40, "a a a a a a a a a", "w " + "ÑANDÚ é 日本 X y z 1 2 3 4 5 6 7 " * 3, "ñandú é 日本 x y z 1 2 3 4 5 6 7 8", "b " * 30000 + "a b c d e f g h i j " + "b " * 30000, "a b c d e f g h i j " * 2, "b c d e f g h i j k l"]


@pytest.fixture(scope="module")
def few(spark):
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 0), (3, TEXTS[5], 0), (None, TEXTS[4], 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_hit long")


def test_winnowing_finds_every_window(spark, few):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = winnowing.op11_decontaminated(few, items).collect()
    want = Counter((r["doc_id"], *contamination(r["text"], ITEMS)) for r in few.collect())
    assert Counter(map(tuple, got)) == want
    clean = winnowing.clean_documents(few, items)
    assert clean.columns == few.columns
    assert Counter(r["text"] for r in clean.collect()) == Counter(r["text"] for r in few.collect() if not contamination(r["text"], ITEMS)[1])


def test_winnowing_by_shuffle(spark, few, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(winnowing, "FEW", 3)
    got = winnowing.op11_decontaminated(few, items).collect()
    assert Counter(map(tuple, got)) == Counter((r["doc_id"], *contamination(r["text"], ITEMS)) for r in few.collect())


def test_winnowing_of_empty_tables(spark, few):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert winnowing.op11_decontaminated(few.limit(0), items).count() == 0
    got = winnowing.op11_decontaminated(few, items.limit(0)).collect()
    assert len(got) == few.count() and not any(r["contaminated"] for r in got)


def test_winnowing_equals_sql(spark):
    assert query_rows(registered.op11_winnowing(spark, SF)) == oracle_rows(winnowing.oracle_sql(), SF)


# Alignment

ODD = [None, "", " ", "  ", "\n\n\ta b  c ", "a b", "▁x", "<s> hi </s> <|endoftext|> <unk>", "é ﬁ ½ \U0001f600 ñandú", "\x00\x1c a\x1db \x85 c᠎d​e　f g", "x" * 5000, "123 4567,,..!!  'll don't I'M", "日本語 テキスト ไทย", " lead", "trail \n", "aaa" + " " * 50 + "b", "\r\n\r\n", "<0x41>"]


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=SECOND)


def merged_walk(libraries, text):
    """Groups of ids, by one walk over both lists; none where the bytes don't join."""
    first, second = libraries
    if not text:
        return None
    letters = alignment.byte_letters()
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    bytes_a = [bytes(letters[c] for c in first.id_to_token(k)) for k in a]
    bytes_b = [bytes([int(second.id_to_piece(k)[3:5], 16)]) if second.is_byte(k) else second.id_to_piece(k).replace("▁", " ").encode() for k in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    groups, own, i, j, at_a, at_b = [], ([], []), 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and at_a <= at_b:
            own[0].append(a[i])
            at_a += len(bytes_a[i])
            i += 1
        else:
            own[1].append(b[j])
            at_b += len(bytes_b[j])
            j += 1
        if at_a == at_b:
            groups.append(own)
            own = ([], [])
    return groups


def alignment_rows(libraries, texts):
    each = [merged_walk(libraries, t) or [] for t in texts]
    n = Counter((g[0][-1], g[1][-1]) for groups in each for g in groups)
    best = defaultdict(int)
    for (_, b), times in n.items():
        best[b] = max(best[b], times)
    for groups in each:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(n[x] == best[x[1]] for x in links), sum(n[x] for x in links), hashlib.sha256(told.encode()).hexdigest() if groups else "")


@pytest.mark.parametrize("few", [500_000, 3])
def test_alignment_equals_walk(spark, libraries, monkeypatch, few):
    monkeypatch.setattr(alignment, "FEW", few)
    given = [*enumerate(ODD), (3, "a b"), (3, "a b"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "clash") for r in given], "doc_id long, text string, row string")
    got = alignment.op12_aligned(docs, FIRST, SECOND, P.PATTERN).collect()
    want = Counter((i, *x) for (i, _), x in zip(given, alignment_rows(libraries, [t for _, t in given]), strict=True))
    assert Counter(map(tuple, got)) == want


def test_alignment_of_the_documents(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in registered.op12_alignment(spark, SF).collect()}
    assert got == dict(zip([r["doc_id"] for r in docs], alignment_rows(libraries, [r["text"] for r in docs]), strict=True))


def test_alignment_table_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "b")], "doc_id long, text string")
    table = alignment.alignment_table(docs, FIRST, SECOND, P.PATTERN).collect()
    assert sorted(r["count"] for r in table) == [2, 3]
    assert alignment.op12_aligned(docs.limit(0), FIRST, SECOND, P.PATTERN).count() == 0


def test_jumps_over_long_chains():
    # tokens that overlap the next one, all in one group, then two that end together
    a, b = np.array([2] * 1000 + [3, 4]), np.array([1] + [2] * 999 + [1, 3, 4])
    last_a, last_b = alignment.jumped(a, b)
    end_a, end_b = np.cumsum(a), np.cumsum(b)
    shared = np.intersect1d(end_a, end_b)
    assert (end_a[last_a] == shared[np.searchsorted(shared, end_a)]).all()
    assert (end_a[last_b] == shared[np.searchsorted(shared, end_b)]).all()


def test_other_byte_level_files_go_to_the_library(libraries):
    import json

    import pyarrow as pa

    with open(FIRST) as f:
        file = json.load(f)
    file["model"]["merges"] = file["model"]["merges"][1:] + file["model"]["merges"][:1]
    side = alignment.ByteLevelSide(json.dumps(file).encode(), P.PATTERN)
    assert side.own is None
    ids, cut = side.encode(pa.array([" the end", " a"]))
    assert b"".join(side.tokens[k] for k in ids) == b" the end a" and len(cut) == 3


# Whitening


def whitened(vectors, k=16):
    """(n, S, eigenvalues, places, trace) by numpy's eigenvectors."""
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    y = (fit * n - total) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, total, e, (x * n - total) / n @ q / np.sqrt(e), float((y * y).sum() / n), ((x * n - total) ** 2).sum(axis=1)


def against(spark, vectors, ids, k=16):
    frame = spark.createDataFrame([(int(i), [float(c) for c in v], "clash") for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, x string")
    got = whitening.op13_whitening(frame, k).toPandas()
    n, _, e, places, trace, deviation = whitened(np.array(vectors), k)
    own = got.pivot(index="vec_id", columns="component", values="whitened").loc[list(ids)].to_numpy()
    assert own.shape == places.shape
    sign = np.sign((own * places).sum(axis=0))
    assert np.abs(own * sign - places).max() < 1e-8
    one = got.drop_duplicates("vec_id").set_index("vec_id").loc[list(ids)]
    assert (one["deviation"].to_numpy() == deviation).all() and (got["n"] == n).all()
    assert np.abs(got[got.vec_id == ids[0]].sort_values("component")["explained"].to_numpy() - e / trace).max() < 1e-12
    assert got["identity_error"].max() < 1e-8 and got["residual"].max() < 1e-12


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    flat = rng.standard_normal((900, 48))
    against(spark, np.concatenate([flat, flat[:50]]), range(950))
    # a steep spectrum, an off-centre cloud, and fewer dimensions than a block
    against(spark, flat * 1.5 ** -np.arange(48)[None] * 1e4 + 30, range(900))
    against(spark, rng.standard_normal((300, 5)) + 7, range(300), 5)


def test_whitening_of_the_embeddings(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    got = registered.op13_whitening(spark, SF).toPandas()
    places = whitened(np.array(given["embedding"].tolist()))[3]
    own = got.pivot(index="vec_id", columns="component", values="whitened").loc[given["vec_id"]].to_numpy()
    assert np.abs(own * np.sign((own * places).sum(axis=0)) - places).max() < 1e-9


def test_whitening_of_odd_rows(spark):
    good = [(i, [float(math.sin(i * (k + 1))) for k in range(3)]) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1e300, 0.0, 0.0]), (106, [1.0, 2.0]), (None, good[0][1]), (3, good[5][1])]
    rows = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    got = whitening.op13_whitening(rows)
    assert Counter(r["vec_id"] for r in got.collect()) == Counter({i: 6 if i == 3 else 3 for i, _ in good}) + Counter({None: 3})
    same = {tuple(r["whitened"] for r in got.filter(c).orderBy("component").collect()) for c in ("vec_id IS NULL", "vec_id = 0")}
    assert len(same) == 1
    # nothing varies, along one axis or at all
    assert whitening.op13_whitening(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], rows.schema)).count() == 0
    assert {r["component"] for r in whitening.op13_whitening(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], rows.schema)).collect()} == {1}
    assert whitening.op13_whitening(rows.limit(0)).count() == 0


def test_deviation_beyond_a_long(spark):
    rows = spark.createDataFrame([(i, [c, 0.0]) for i, c in enumerate((1e12, -1e12, 0.0, 1.0))], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.op13_whitening(rows).collect()}
    assert got[0] is None and got[1] is None and len(got) == 4


def test_queries_of_the_round(spark):
    assert reduce(lambda a, b: a and b, [n in registered.queries() for n in ("op11_winnowing", "op12_alignment", "op13_whitening")])
    assert registered.op11_winnowing(spark, SF).filter("contaminated").count() > 0
    assert registered.op13_whitening(spark, SF).agg(F.max("component")).head()[0] == 16


# The vector index's lists


def test_boundary_vectors_are_posted_to_several_lists():
    from topicspark.llm import ann

    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit_index(x, 1.0 + 1e-9, len(x))
    assert np.allclose(np.linalg.norm(index.centroids, axis=1), 1, atol=1e-6)
    copies = (index.posted(x) >= 0).sum(1)
    assert copies.mean() > 1.5 and copies.max() <= ann.COPIES


def test_few_lists_hold_the_neighbours_of_grouped_vectors():
    from topicspark.llm import ann

    rng = np.random.default_rng(1)
    centres = rng.standard_normal((100, 64))
    x = centres[rng.integers(0, 100, 8000)] + 0.35 * rng.standard_normal((8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ann.fit_index(x, 1.0 + 1e-9, len(x))
    asked = np.arange(0, 8000, 20)
    lists, probes = index.posted(x), index.probed(x[asked])
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    top = np.argpartition(-score, 19, axis=1)[:, :20]
    found = (probes[np.arange(len(asked))[:, None, None], np.maximum(lists[top], 0)] & (lists[top] >= 0)).any(2)
    assert found.mean() >= 0.9 and probes.mean() < 0.1


# Fits where an id stands on many rows


def test_a_language_of_one_id_is_learned(spark):
    from topicspark.llm import langid

    rows = [(k, f"der Hund und die Katze {k}", "de") for k in range(300)] + [(7, f"the cat of the house {k}", "en") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = langid.train_langid(docs, fit_texts=10)
    assert sorted(network.langs) == ["de", "en"]


def test_a_repeated_id_is_one_row_of_the_regression(spark, monkeypatch):
    from topicspark.llm import toxicity

    seen = []
    real = toxicity._regression
    monkeypatch.setattr(toxicity, "_regression", lambda y, *args, **options: seen.append(len(y)) or real(y, *args, **options))
    rows = [(k, f"a clean text of {k}") for k in range(2, 20)] + [(1, f"you idiot {k}") for k in range(5000)] + [(20 + k, f"idiot again {k}") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0, 0) for k in range(2, 20)] + [(1, 0, 1)] + [(20 + k, 0, 1) for k in range(6)], "doc_id long, quality int, toxic int")
    toxicity.train_toxicity(docs, labels, fit_rows=5)
    assert seen == [10]


# Stages of the pipeline against the queries' rows


def test_stages_keep_what_their_operators_keep(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "labels"))
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    learned = crc_mod("doc_id", 5) != 0
    clean = toxicity.clean_documents(docs.filter(learned), labels.filter(learned))
    assert ids(clean) == ids(toxicity.op2_toxicity(docs, labels).filter("NOT held_out AND predicted = 0"))
    assert ids(quality.good_documents(docs, labels)) == ids(quality.op10_quality(docs, labels).filter("kept"))
    rows = mixing.mixed_rows(docs, mixing.source_domain(F.col("source")))
    chosen = mixing.op6_mixing(docs).groupBy("doc_id").agg(F.sum("copies").alias("n"))
    assert ids(rows) == Counter({r["doc_id"]: r["n"] for r in chosen.collect()})


def test_rows_without_an_id_have_components(spark):
    """A component of rows that have no id has none either; one that has any takes the smallest."""
    docs = spark.createDataFrame([(None, "lone words of a text"), (None, "shared words"), (7, "shared words"), (9, "shared words"), (None, None), (None, "")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.op7_simhash(docs).collect())
    assert got == Counter([(None, None), (None, 7), (7, 7), (9, 7), (None, None), (None, None)])
