import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations, pairwise, product

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tests.compare import oracle_rows, query_rows
from topicspark.llm import ann, bpe, langid, lm, mixing, quality, simhash, tokenfile, toxicity, urlrules
from topicspark.llm import queries as registered
from topicspark.llm.common import added_pieces

SF = "/root/testdata/sf0.001"
WORD = regex.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "a b", "ein Wort " * 40, "ein Wort " * 40, "x" * 30000, "é€\U0001F600 ñandú", "line one\nline one\n \nline one", "1234 !!", "idiot " * 3 + "the end of the day and the night"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "src0", "src12"][i % 3], "clash") for i, t in enumerate(ODD)] + [(5, "a b", "en", "src0", "clash"), (None, "no id at all", "en", "src1", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (6, 1, 0), (10, 0, 0), (12, 1, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def base_rules(text):
    found = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(found) - 4):
        windows[tuple(found[i : i + 5])].append(i)
    repeated = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_base_rules(spark, odd, labels):
    for docs, known in ((odd, labels), (docs_of(spark), spark.read.parquet(f"{SF}/labels.parquet"))):
        text = {r["doc_id"]: r["text"] for r in docs.collect()}
        for r in quality.op10_quality(docs, known).collect():
            want = base_rules(text[r["doc_id"]])
            assert tuple(r[1:6]) == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r["base_failed"] and r["kept"])


def test_quality_verdict(spark):
    known = spark.read.parquet(f"{SF}/labels.parquet")
    x = quality.op10_quality(docs_of(spark), known).join(known, "doc_id").filter("NOT base_failed")
    assert x.filter("quality = 1 AND NOT kept").count() == 0
    assert x.filter("quality = 0 AND kept").count() <= 0.2 * max(1, x.filter("quality = 0").count())
    assert quality.good_documents(docs_of(spark), known).columns == docs_of(spark).columns


def test_toxicity(spark, odd, labels):
    got = toxicity.op2_toxicity(odd, labels).collect()
    assert len(got) == len(ODD) + 2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    sf = "/root/testdata/sf0.01"
    known = spark.read.parquet(f"{sf}/labels.parquet")
    x = toxicity.op2_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), known).join(known, "doc_id").filter("held_out")
    assert x.filter("predicted = toxic").count() >= 0.95 * x.count()


def test_toxicity_without_labels(spark, odd, labels):
    got = toxicity.op2_toxicity(odd, labels.limit(0)).collect()
    assert {r["predicted"] for r in got} == {0}


def test_toxicity_equals_brute_force(spark):
    """Ratios and scores anew from the n-grams as strings; each is found in its bucket by itself."""
    texts = ["you idiot", "idiot idiot go", "Good Day to all", "a good day\tit is", "ein guter Tag", "du Idiot!", "x", ""]
    toxic = [1, 1, 0, 0, 0, 1, 0, 1]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int")
    model = toxicity.train_toxicity(docs, known, features=200)

    def buckets(text):
        low = "".join(" " if "\t" <= c <= "\r" else c for c in text.lower())
        grams = {low[k : k + n] for n in (3, 4, 5) for k in range(len(low) - n + 1)}
        return {int(b[0]) for g in grams for _, b in toxicity.ngram_buckets(pa.array([g]))[-1:]}

    found, n1, n0 = [buckets(t) for t in texts], sum(toxic), len(toxic) - sum(toxic)
    yes, no = (Counter(b for f, y in zip(found, toxic, strict=True) if y == want for b in f) for want in (1, 0))
    ratio = {b: np.log((yes[b] + 1) / (n1 + 2)) - np.log((no[b] + 1) / (n0 + 2)) for f in found for b in f}
    used = set(np.flatnonzero(model.weights).tolist())
    assert used and used <= set(ratio)
    # the weight's sign is the ratio's wherever the regression kept to the side that the counts are on
    assert np.mean([(model.weights[b] > 0) == (ratio[b] > 0) for b in used]) > 0.8
    want = [1 / (1 + np.exp(-(model.bias + sum(model.weights[b] for b in f)))) for f in found]
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity_score(docs, model).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-9)
    sums = toxicity._frequencies([pa.record_batch([pa.array(toxic, pa.int32()), pa.array(texts)], ["label", "text"])])
    size = 1 << toxicity.BITS
    assert {b: int(sums[size + b]) for b in ratio} == {b: yes[b] for b in ratio} and {b: int(sums[b]) for b in ratio} == {b: no[b] for b in ratio}
    assert sums[2 * size :].tolist() == [n0, n1]


def test_networks_forward_pass(spark):
    """The batched network against one filter, one place at a time."""
    net = langid.train_network(["le chat dort bien", "the cat is asleep", "la maison est là", "a house is there"] * 10, ["fr", "en"] * 20)
    text = "étrange chat"
    raw = text.encode()
    window = raw + b" " * (langid.WINDOW + 3 - len(raw))
    pooled = []
    for w in langid.WIDTHS:
        for f in range(langid.FILTERS):
            pooled.append(max(sum(float(net.taps[w][j][window[at + j]][f]) for j in range(w)) for at in range(langid.WINDOW)))
    h = [max(0.0, p + float(s)) for p, s in zip(pooled, net.shift, strict=True)]
    logits = [sum(h[k] * float(net.out[k][c]) for k in range(len(h))) + float(net.bias[c]) for c in range(2)]
    want = [np.exp(x) / sum(np.exp(logits)) for x in logits]
    got = langid.identified(spark.createDataFrame([(1, text)], "doc_id long, text string"), net).head()
    assert got["lang_pred"] == net.langs[int(np.argmax(want))] and got["score"] == pytest.approx(max(want), abs=1e-4)


def test_quality_ratio_and_threshold_equal_brute_force(spark):
    docs, known = docs_of(spark), spark.read.parquet(f"{SF}/labels.parquet")
    text, quality_of = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}, {r["doc_id"]: r["quality"] for r in known.collect()}
    bucket = lambda g: (g[0] << 16 | g[1] << 8 | g[2]) * 0x9E3779B1 % 2**32 >> 32 - quality.BITS
    grams = {i: [bucket(t[k : k + 3]) for k in range(len(t) - 2)] for i, t in text.items()}
    raw, trusted = Counter(b for g in grams.values() for b in g), Counter(b for i, g in grams.items() if quality_of.get(i) == 1 for b in g)
    size = 1 << quality.BITS
    ratio = {b: np.float32(np.log((trusted[b] + 0.5) / (trusted.total() + 0.5 * size)) - np.log((raw[b] + 0.5) / (raw.total() + 0.5 * size))) for b in raw}
    score = {i: float(np.mean([ratio[b] for b in g])) if g else 0.0 for i, g in grams.items()}
    got = {r["doc_id"]: r for r in quality.op10_quality(docs, known).collect()}
    assert all(got[i]["score"] == pytest.approx(score[i], abs=1e-5) for i in text)
    threshold = quality.train_quality(docs.select("doc_id", "text"), known).threshold
    cost = lambda t: sum(got[i]["score"] < t if q == 0 else -quality.GOOD_COST * (got[i]["score"] < t) for i, q in quality_of.items() if i in got)
    edges = [np.floor(got[i]["score"] / quality.BIN) * quality.BIN + quality.BIN for i in quality_of if i in got]
    assert cost(threshold) == max([0, *map(cost, edges)])
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= threshold) for r in got.values())


def test_sums_of_many_parts(spark):
    parts, piece = 100_000, 4
    made = spark.range(parts).selectExpr("cast(id % 2 as int) AS piece", "cast(id as int) AS part").mapInPandas(lambda it: (f.assign(sums=[np.full(piece, k, "<i8").tobytes() for k in f["part"]]) for f in it), "piece int, part int, sums binary")
    got = {r["piece"]: np.frombuffer(r["sums"], "<i8").tolist() for r in added_pieces(made, piece).collect()}
    assert got == {p: [sum(range(p, parts, 2))] * piece for p in (0, 1)}


def test_lm_counts_over_32_bits():
    """Words and pairs seen more than 2^31 times keep their counts."""
    big = 3_000_000_000
    key = np.array([5, 9], np.uint64)
    body = lm._packed(key, np.array([big, 1], np.int64), np.array([big - 1, 0], np.int64))
    answer = lm._count_pairs(pa.table({"chunk": [0, 1], "bucket": pa.array([0, 0], pa.int32()), "body": pa.array([body, body], pa.binary())}))
    n, t = lm._unpacked(answer["body"][0].as_py(), "i8", "i8")
    assert n.tolist() == [2 * big, 2] and t.tolist() == [2 * (big - 1), 0]


def test_empty_and_filtered_tables(spark, odd, labels):
    none, path = odd.limit(0), P.path("byte_bpe_50k.tiktoken")
    for made in (toxicity.op2_toxicity(none, labels), lm.op3_lm(none, labels), langid.op4_langid(none), quality.op10_quality(none, labels), bpe.op8_bpe(none, path, P.PATTERN)):
        assert made.count() == 0
    # stages keep the columns, and repeated rows and rows without an id stand or fall by their text
    for stage in (lambda d: toxicity.clean_documents(d, labels), lambda d: quality.good_documents(d, labels)):
        assert stage(none).count() == 0
        kept = stage(odd.union(odd))
        assert kept.columns == odd.columns
        counts = Counter((r["doc_id"], r["text"]) for r in kept.collect())
        assert all(n % 2 == 0 for n in counts.values())


def test_langid(spark, odd):
    got = {r["doc_id"]: r for r in langid.op4_langid(odd).collect()}
    for i, t in enumerate(ODD):
        assert (got[i]["lang_pred"] == "und") == (not regex.search(r"\p{L}", t or "")) and 0 <= got[i]["score"] <= 1
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    x = langid.op4_langid(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert x.filter("lang = lang_pred").count() >= 0.97 * x.count()
    assert {r["lang_pred"] for r in langid.op4_langid(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_lm(spark, odd, labels):
    got = {r["doc_id"]: r for r in lm.op3_lm(odd, labels).collect()}
    for i, t in enumerate(ODD):
        assert got[i]["n_tokens"] == len(WORD.findall(t or ""))
        assert got[i]["n_tokens"] or got[i]["score"] == 0
    known = spark.read.parquet(f"{SF}/labels.parquet")
    mean = {r["quality"]: r["m"] for r in lm.op3_lm(docs_of(spark), known).join(known, "doc_id").groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert mean[1] < mean[0]


def brute_lm(rows, target):
    texts = {r["doc_id"]: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")) for r in rows}
    seen = Counter(w for t in texts.values() for w in t)
    texts = {i: [w if seen[w] >= 3 else None for w in t] for i, t in texts.items()}
    size, models, out = sum(n >= 3 for n in seen.values()) + 1, [], {}
    for own in (target, set(texts)):
        models.append((Counter(w for i in own & set(texts) for w in texts[i]), Counter(p for i in own & set(texts) for p in pairwise(texts[i]))))
    for i, t in texts.items():
        bits = []
        for ones, twos in models:
            loss = 0
            for k, w in enumerate(t):
                p = (ones[w] + 1) / (ones.total() + size)
                if k and ones[t[k - 1]]:
                    p = 0.6 * twos[t[k - 1], w] / ones[t[k - 1]] + 0.4 * p
                loss -= np.log2(p)
            bits.append(loss / max(1, len(t)))
        out[i] = (len(t), *bits)
    return out


def test_lm_equals_brute_force(spark, odd, labels):
    cases = [(docs_of(spark).repartition(3), spark.read.parquet(f"{SF}/labels.parquet"), lm.CHUNK), (docs_of(spark), spark.read.parquet(f"{SF}/labels.parquet"), 700), (odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), labels, 5)]
    for docs, known, chunk in cases:
        target = {r["doc_id"] for r in known.groupBy("doc_id").agg(F.max(F.expr("CASE WHEN quality > 0 AND NOT coalesce(toxic > 0, false) THEN 1 ELSE 0 END")).alias("t")).filter("t > 0").collect()}
        want = brute_lm(docs.collect(), target)
        got = lm.op3_lm(docs, known, chunk=chunk, bucket_bytes=50_000).collect()
        assert len(got) == len(want)
        for r in got:
            assert tuple(r[1:4]) == pytest.approx(want[r["doc_id"]], abs=1e-9) and r["score"] == pytest.approx(want[r["doc_id"]][1] - want[r["doc_id"]][2], abs=1e-9)
    assert lm.op3_lm(odd.limit(0), labels).count() == 0


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(low)
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    ids, parent = list(prints), {}
    for i in ids:
        parent[i] = i

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in ids}


def test_simhash(spark, odd):
    for docs in (odd.filter("doc_id IS NOT NULL"), docs_of(spark)):
        prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in docs.collect()}
        want = brute_components(prints)
        got = simhash.op7_simhash(docs).collect()
        assert len(got) == docs.count()
        assert all(r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]] for r in got)
    assert simhash.op7_simhash(odd.limit(0)).count() == 0


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_wide_fingerprint(hashes):
    """Of a text's distinct shingle hashes, as wide_fingerprints defines it."""
    word = lambda k: simhash.mixed(np.array(hashes, np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).tolist()
    out = []
    for k in range(4):
        h = word(k)
        ones = [sum(x >> b & 1 for x in h) for b in range(64)]
        out.append(sum(1 << b for b in range(64) if h and (2 * ones[b] > len(h) or 2 * ones[b] == len(h) and b % 2)))
    return out


def test_wide_fingerprints():
    texts = ["", " ", "one", "one two three four", "a b c d e f", "A b c d e F", *(" ".join(f"w{k * i % 97}" for k in range(i)) for i in (7, 300, 1500)), "x y z v w " * 200]
    h, n = simhash.shingle_hashes(pa.array(texts), 5)
    assert n.tolist() == [len(s) for s in shingle_sets(enumerate(texts)).values()]
    got, cut = simhash.wide_fingerprints(pa.array(texts), 4, 5), np.cumsum([0, *n])
    for row, a, b in zip(got.tolist(), cut[:-1], cut[1:], strict=True):
        assert row == brute_wide_fingerprint(h[a:b])
    assert got[4].tolist() == got[5].tolist()


def test_near_duplicates_go(spark, odd):
    docs = docs_of(spark).unionByName(spark.createDataFrame([(10_000 + k, " ".join(f"{x}{y}" for x in "abcdefghij" for y in range(k, 20 + k)), "en", "s", 0) for k in range(3)], docs_of(spark).schema))
    sets = shingle_sets([(r["doc_id"], r["text"]) for r in docs.collect()])
    of = {r["doc_id"]: r["__component"] for r in simhash.with_components(docs).collect()}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a | b:
                alike = len(a & b) / len(a | b)
                assert alike < 0.85 or of[i] == of[j]
    members = defaultdict(set)
    for i, c in of.items():
        members[c].add(i)
    for m in members.values():
        # nobody is in a group without a text that is alike
        assert len(m) == 1 or all(any(len(sets[i] & sets[j]) >= 0.5 * (len(sets[i]) * len(sets[j])) ** 0.5 for j in m - {i}) for i in m)
    assert {r["doc_id"] for r in simhash.without_near_duplicates(docs).collect()} == {min(m) for m in members.values()}
    # repeated ids of different texts both count, rows without an id are compared too, and the row that stays is fixed
    extra = odd.union(spark.createDataFrame([(None, "no id at all", "de", "x", "y"), (5, "another text with the id of five", "de", "x", "y")], odd.schema))
    kept = simhash.without_near_duplicates(extra)
    assert kept.columns == extra.columns
    stay = sorted((r["doc_id"], (r["text"] or "").strip()) for r in kept.collect() if r["doc_id"] is not None)
    assert stay == sorted([(0, ""), (4, "a"), (5, "a b"), (5, "another text with the id of five"), *((i, ODD[i].strip()) for i in (6, 8, 9, 10, 11, 12))])
    assert kept.filter("doc_id IS NULL").count() == 1
    assert simhash.without_near_duplicates(odd.limit(0)).count() == 0


def test_wide_links_of_large_groups(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, (2, 4), dtype=np.uint64)
    fp = np.concatenate([b ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, (300, 4)).astype(np.uint64) for _ in range(3)]) for b in base] + [rng.integers(0, 2**63, (200, 4), dtype=np.uint64)])
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(fp.view(np.int64).tolist())], "id long, f0 long, f1 long, f2 long, f3 long")
    for run in (8192, 40):
        label = {r["node"]: r["label"] for r in simhash.components(simhash.fingerprint_links(df, simhash.SIMILAR, run=run)).collect()}
        assert label == {k: 0 for k in range(300)} | {k: 300 for k in range(300, 600)}


def test_simhash_large_groups_equal_small(spark):
    rng = np.random.default_rng(1)
    one = np.uint64(1)
    flip = lambda n: one << rng.integers(0, 64, n).astype(np.uint64)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ flip(400) ^ flip(400) for b in base] + [rng.integers(0, 2**63, 600, dtype=np.uint64) & np.uint64(0xFFFF)]))
    df = spark.createDataFrame([(int(x), int(x)) for x in fp.view(np.int64)], "id long, f0 long")
    found = [{(r["node"], r["label"]) for r in simhash.components(simhash.fingerprint_links(df, run=run)).collect()} for run in (8192, 150)]
    assert found[0] == found[1]
    want = brute_components({int(x): int(x.view(np.uint64)) for x in fp.view(np.int64)})
    sizes = defaultdict(set)
    for i, c in want.items():
        sizes[c].add(i)
    got = defaultdict(set)
    for node, label in found[0]:
        got[label].add(node)
    assert {frozenset(s) for s in sizes.values() if len(s) > 1} == {frozenset(s) for s in got.values()}


def test_bpe(spark, odd):
    import base64

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for docs in (odd, docs_of(spark)):
        text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        for r in bpe.op8_bpe(docs, path, P.PATTERN).collect():
            ids = enc.encode_ordinary(text[r["doc_id"]])
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
        for r in bpe.encoded_ids(docs, path, P.PATTERN).collect():
            assert list(r["ids"]) == enc.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.op8_bpe(odd.limit(0), path, P.PATTERN).count() == 0


def test_bpe_spaces():
    tok = bpe.Tokenizer.from_lines(open(P.path("byte_bpe_50k.tiktoken"), "rb").read(), P.PATTERN)
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={b: k for k, b in ((int(y), __import__("base64").b64decode(x)) for x, y in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb")))}, special_tokens={})
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list(" \n\t ab'sé12.,\u00a0\u2003日"), rng.integers(0, 60))) for _ in range(300)]
    ids, cut = tok.encode(pa.array(texts))
    for t, a, b in zip(texts, cut[:-1], cut[1:], strict=True):
        assert ids[a:b].tolist() == enc.encode_ordinary(t)


def test_bpe_of_long_pieces():
    import time

    import tiktoken

    lines = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    tok = bpe.Tokenizer.from_lines(lines, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={__import__("base64").b64decode(x): int(y) for x, y in map(bytes.split, lines.splitlines())}, special_tokens={})
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzAEIOU"), n)) for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 20_000)] + ["ab" * 3000, "a" * 5001, "é" * 4000, " " * 9000 + "x"]
    ids, cut = tok.encode(pa.array(texts))
    for t, a, b in zip(texts, cut[:-1], cut[1:], strict=True):
        assert ids[a:b].tolist() == enc.encode_ordinary(t)
    began = time.time()
    ids, _ = tok.encode(pa.array(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))]))
    assert time.time() - began < 60 and len(tok.decode(ids)) == 1_000_000


def test_token_file(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(spark.createDataFrame([(900, "Don't <|endoftext|> stop. It's", "en", "s", "x"), (901, "A.b,C:d (e) f#g 'll", "en", "s", "x")], odd.schema))
    at = 0
    got = {r["doc_id"]: r for r in tokenfile.op9_tokenfile(docs, P.path("word_bpe_49k.json")).collect()}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        g = got[r["doc_id"]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenfile.op9_tokenfile(odd.limit(0), P.path("word_bpe_49k.json")).count() == 0
    assert tokenfile.op9_tokenfile(odd, P.path("word_bpe_49k.json")).count() == odd.count()


def test_range_coder():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, n).astype(np.uint16) for n in (1, 2, 5, 700)] + [np.zeros(4096, np.uint16), np.full(77, 65535, np.uint16), np.tile(np.arange(200, dtype=np.uint16), 20)]
    coded = tokenfile.encode_blocks(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, tokenfile.decode_blocks(coded), strict=True))
    assert len(coded[4]) < 200 and len(coded[6]) < 2000
    spoiled = bytearray(coded[3])
    spoiled[200] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        tokenfile.decode_blocks([bytes(spoiled)])


def test_ann(spark):
    got = defaultdict(list)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    for r in ann.op1_ann(e).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    rows = sorted((r["vec_id"], r["embedding"]) for r in e.collect())
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    hit = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = v @ v[k]
        s[k] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        mine = got[int(ids[k])]
        assert len(mine) == 20 and all(a[1] > b[1] or a[1] == b[1] and a[0] < b[0] for a, b in pairwise(mine))
        hit += len(set(want.tolist()) & {m[0] for m in mine})
        total += 20
    assert hit >= 0.9 * total


def test_ann_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (21, [1.0, 0.0]), (1, [0.0, 3.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0]), (40, [0.5, 0.5]), (None, [1.0, 1.0]), (21, [1.0, 0.0]), (6, [None, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.op1_ann(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], round(r["score"], 6)))
    assert got == {0: [(20, 1.0), (21, 1.0), (40, 0.5), (1, 0.0)], 20: [(0, 1.0), (21, 1.0), (40, 0.5), (1, 0.0)], 40: [(1, 1.5), (0, 0.5), (20, 0.5), (21, 0.5)]}
    assert ann.op1_ann(df.limit(0)).count() == 0
    # distinct vectors of one score in one list: the smaller ids, as for equal vectors; huge ones, and columns that clash
    tied = spark.createDataFrame([(0, [1e150, 0.0], "x", 1)] + [(i, [1e150, i * 1e146], "x", 1) for i in range(1, 121)], "vec_id long, embedding array<double>, score string, rank int")
    assert [r["vec_id"] for r in ann.op1_ann(tied).filter("query_id = 0").orderBy("rank").collect()] == list(range(1, 21))
    ids, x = np.arange(1, 501), np.stack([np.ones(500), np.arange(500)], axis=1)
    held = (ids, x, (np.arange(501), ids), np.arange(501), np.zeros(500, np.int64))
    top = ann._top(held, np.array([1000]), np.array([[1.0, 0.0]]), pa.array([[0]]), 20)
    assert sorted(top.column("vec_id").to_pylist())[:20] == list(range(1, 21))
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.op1_ann(same).filter("query_id = 0").orderBy("rank").collect()] == list(range(1, 21))


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/a?x", "http://a.example.com/en/1#y", "http://example.com", "x://b.net/es/", "http://net/fr/q", "http://c.org/en/", "http://badexample.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.op5_urlrules(df, none).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[4] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert got[5] == ("example.com", "", None, "allow")
    assert got[6][2:] == ("net/es/", "block") and got[7][2:] == ("net/fr/", "block")
    assert got[8][2:] == (None, "allow") and got[9][2:] == ("com/", "allow")


def test_url_tokens(spark):
    urls = ["HTTP://WWW.Example.COM/en/Page-12/en?q=Wort&x#y", "no-scheme/page?x", None, "a://b", "a://b#c?d"]
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(urlrules.url_tokens(F.col("url")).alias("t"))
    assert [r["t"] for r in df.collect()] == [sorted(["h:www", "h:example", "h:com", "p:en", "p:page", "p:0", "q:q", "q:wort", "q:x", "q:y"]), [], [], ["h:b"], ["h:b", "q:c", "q:d"]]


def brute_rules(rows, least, lift):
    """Minimal token sets on `least` bad rows whose share of bad rows is `lift` times the overall one."""
    share = lift * sum(b for _, b in rows) / len(rows)
    tokens = sorted({t for own, _ in rows for t in own})
    sure = {}
    for n in range(1, len(tokens) + 1):
        for some in combinations(tokens, n):
            met = [b for own, b in rows if set(some) <= own]
            if sum(met) >= least and sum(met) / len(met) >= share - 1e-12:
                sure[some] = sum(met) / len(met)
    return {s: c for s, c in sure.items() if not any(sure.get(p, 0) >= c for p in combinations(s, len(s) - 1))}


def test_url_rules_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [({f"t{k}" for k in range(6) if rng.random() < 0.5} | ({"u", "v"} if k % 3 == 0 else set()), False) for k in range(80)]
    rows = [(own, bool(rng.random() < (0.9 if {"t1", "t2"} <= own or "u" in own and "t4" in own else 0.2))) for own, _ in rows]
    urls = spark.createDataFrame([(k, sorted(own)) for k, (own, _) in enumerate(rows)], "id long, tokens array<string>")
    mined, item_of = urlrules.mined_rules(urls, spark.createDataFrame([(k, b) for k, (_, b) in enumerate(rows)], "id long, bad boolean"), 8, 1.5)
    tokens = defaultdict(set)
    for r in item_of.collect():
        tokens[r["item"]].add(r["token"])
    got = {tuple(sorted(x)): r["confidence"] for r in mined.collect() for x in product(*(tokens[i] for i in r["items"]))}
    assert len(got) > 3 and got == pytest.approx(brute_rules(rows, 8, 1.5))
    assert tokens["u"] in (set(), {"u", "v"})


def verdicts_of(spark, urls):
    df = spark.createDataFrame([(i, u, "clash") for i, (u, _) in enumerate(urls)], "page_id long, url string, tokens string")
    known = spark.createDataFrame([(i, q, 0) for i, (_, q) in enumerate(urls)], "doc_id long, quality int, toxic int")
    found = defaultdict(set)
    for r in urlrules.op5_urlrules(df, known).collect():
        found[urls[r["page_id"]][0]].add((r["verdict"], r["confidence"]))
    return found


def test_url_rules_are_mined(spark):
    rows = [(i, f"http://{'casino.win' if i % 3 == 0 else 'news.site'}.org/page/{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    known = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in urlrules.op5_urlrules(df, known).collect()}
    assert all((got[i] == "block") == (i % 3 == 0) for i in range(300))
    # labels that say nothing are none
    assert {r["verdict"] for r in urlrules.op5_urlrules(df, spark.createDataFrame([(i, None, None) for i in range(200)], known.schema)).collect()} == {"allow"}
    assert urlrules.op5_urlrules(df.limit(0), known).count() == 0


def test_url_rules_of_any_length_and_share(spark):
    parts = [f"p{chr(97 + k)}" for k in range(5)]
    urls = [("http://h.org/" + "/".join(parts), 0)] * 40 + [("http://h.org/" + "/".join(p if p != left else "px" for p in parts), 1) for left in parts for _ in range(40)]
    urls += [("http://rare.net/x", 0)] * 20 + [("http://few.net/x", 0)] * 19 + [("http://news.net/x", 1)] * 15000
    found = verdicts_of(spark, urls)
    blocked = {u for u, v in found.items() if v == {("block", 1.0)}}
    # the whole combination and every part of it that is far worse than the rest are blocked, by the surest rule
    assert blocked == {"http://h.org/" + "/".join(parts), "http://rare.net/x"}
    assert found["http://few.net/x"] == {("allow", None)} == found["http://news.net/x"]


def test_long_repeated_urls_end_soon(spark):
    words = [a + b for a in "abcdef" for b in "vwxyz"]
    found = verdicts_of(spark, [("http://spam.org/" + "/".join(words) + "?" + "y" * 20000, 0)] * 60 + [("http://fine.org/x", 1)] * 140)
    assert sorted(x for v in found.values() for x in v) == [("allow", None), ("block", 1.0)]


def test_mixing(spark, odd):
    assert query_rows(registered.op6_mixing(spark, SF)) == oracle_rows(mixing.oracle_sql(), SF)
    rows = mixing.mixed_rows(odd, mixing.source_domain(F.col("source")), percent=200, epochs=2)
    assert rows.columns == odd.columns
    held = mixing.mixed_documents(odd, mixing.source_domain(F.col("source")), percent=200, epochs=2)
    assert rows.count() == held.agg(F.sum("copies")).head()[0] and held.filter("n_tokens > 0").agg(F.min("copies")).head()[0] == 2
    assert mixing.op6_mixing(odd.limit(0)).count() == 0


def test_mixing_shortage_goes_to_siblings_first(spark):
    rows = [("d0", "en", "a", 10), ("d0", "de", "b", 1000), ("d1", "en", "c", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["share"] for r in mixing.leaf_budgets(leaves, {}, 50, 1).collect()}
    assert got == {"a": 10, "b": 492, "c": 502}


def test_pipeline(spark):
    import corpus_pipeline

    docs, want = docs_of(spark), None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert out.columns == docs.columns
        rows = out.collect()
        if name == "simhash_near_dedup":
            sets, stay = shingle_sets([(r["doc_id"], r["text"]) for r in docs.collect()]), {r["doc_id"] for r in rows}
            cosine = lambda i, j: len(sets[i] & sets[j]) / (len(sets[i]) * len(sets[j])) ** 0.5
            assert all(i in stay or any(cosine(i, j) >= 0.7 for j in sets if j != i) for i in sets)
            assert not any(len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j]) for i, j in combinations(sorted(stay), 2))
        want = want or docs.count()
        docs = spark.createDataFrame(rows, out.schema)
    assert 0 < docs.select("doc_id").distinct().count() < want
