"""Benchmark decontamination by winnowing, in DataFrame functions throughout.

A text's words are hashed in k-grams of GRAM words, and of every window of SPAN - GRAM + 1 k-grams in a row the least hash is kept. The
k-grams of such a window cover SPAN words, so that every span of SPAN words that a document shares with a benchmark item has a
fingerprint in common with it, wherever it lies. Fingerprints of documents are joined with those of the items, and a hit is extended
to the windows of SPAN words around it, whose whole text is then joined with the items' windows: no hit rests on a hash. An item of
fewer words is one window, whose hash is its fingerprint, and documents are fingerprinted by that length too if there are such items.

Results are found once for each distinct text, and lists of items once for each distinct set of them, so that neither copies of a
document nor passages that many items share are multiplied with one another.

Edge cases: null and empty texts have no words; null, empty and very long texts, repeated ids and repeated rows of documents are
judged row by row; an item id on several texts is one item; an item without an id makes words hit, but can't be listed; other columns
are left alone; with an empty benchmark nothing is hit, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import looked_up, written

#: Words of a window, words of a k-gram, and fingerprints of items that are broadcast at most (16 MB; beyond that they are joined by
#: shuffle).
SPAN, GRAM, FEW = 10, 5, 1_000_000
#: k-grams of which one is kept.
KEPT = SPAN - GRAM + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(text: str) -> Column:
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def n_words(text: str) -> Column:
    return F.regexp_count(lowered(text), F.lit(WORD)).cast("long")


def text_key(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def with_fingerprints(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """`texts` (with an array `w` of words) with `at`, `size` and `f`: a row for each kept k-gram of the windows of SPAN words, at the
    first of the windows that keep it (every KEPT windows anew), and one for each window of each smaller size of `sizes`."""
    n, at, size = F.size("w"), F.col("at"), F.col("size")
    gram = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(GRAM)]))
    least = lambda first: F.least(*[F.get("g", at + (first + k)) for k in range(KEPT)])
    x = texts.filter(n >= min(sizes)).withColumn("g", F.when(n >= GRAM, gram) if SPAN in sizes else F.lit(None).cast("array<bigint>"))
    x = x.withColumn("at", F.explode(F.sequence(F.lit(0), n - min(sizes)))).withColumn("size", F.explode(F.array(*[F.lit(m) for m in sorted(sizes)])))
    x = x.filter(at + size <= n)
    new = (size < SPAN) | (at % KEPT == 0) | (least(0) != least(-1))
    whole = F.xxhash64("size", F.slice("w", at + 1, size))
    return x.filter(new).withColumn("f", F.when(size == SPAN, least(0)).otherwise(whole) if min(sizes) < SPAN else least(0))


def benchmark_windows(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """Of `items` (item_id, text): distinct fingerprints (f); distinct windows with the name of the set of items that hold them
    (window, held); members of these sets (held, item_id); the sizes of windows there are.

    A set's name is made of two 64-bit sums of hashes and its size, so that no window gathers its items."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("w")).filter(F.size("w") > 0)
    each = w.withColumn("size", F.least(F.size("w"), F.lit(SPAN)))
    at = F.explode(F.sequence(F.lit(0), F.size("w") - F.col("size")))
    window = F.array_join(F.slice("w", F.col("at") + 1, F.col("size")), " ").alias("window")
    windows = written(each.withColumn("at", at).select("size", "item_id", window).distinct())
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]
    names = F.concat_ws(":", F.count("item_id"), F.bit_xor(F.xxhash64("item_id")), F.bit_xor(F.xxhash64(F.lit(SPAN), "item_id")))
    sets = written(windows.groupBy("window").agg(names.alias("held")))
    one = sets.groupBy("held").agg(F.min("window").alias("window"))
    members = windows.filter("item_id IS NOT NULL").join(one, "window").select("held", "item_id").distinct()
    prints = [with_fingerprints(each.filter(F.col("size") == m).select("w"), [m]).select("f") for m in sizes]
    found = prints[0] if prints else windows.select(F.lit(0).cast("long").alias("f"))
    for more in prints[1:]:
        found = found.union(more)
    return written(found.distinct()), sets, members, sizes


def shared_windows(texts: DataFrame, prints: DataFrame, sets: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, start, size, held): the windows of `texts` (key, w) that items hold too, each once."""
    placed = with_fingerprints(texts, sizes)
    # the words from which the windows around a hit are made; only those of hits, where the items' fingerprints are broadcast
    near = F.slice("w", F.col("at") + 1, F.lit(SPAN + KEPT - 1)).alias("near")
    if prints.limit(FEW + 1).count() <= FEW:
        hits = placed.join(F.broadcast(prints), "f", "left_semi").select("key", "at", "size", near)
    else:
        hits = looked_up(placed.select("key", "at", "size", near, "f"), prints, ["f"], F.col("key"), "left_semi")
    step = F.explode(F.sequence(F.lit(0), F.when(F.col("size") == SPAN, F.size("near") - SPAN).otherwise(0)))
    around = hits.withColumn("step", step).select("key", "size", (F.col("at") + F.col("step")).alias("start"), F.array_join(F.slice("near", F.col("step") + 1, F.col("size")), " ").alias("window"))
    return looked_up(around, sets, ["window"], F.col("key")).select("key", "start", "size", "held").distinct()


def added_words(shared: DataFrame) -> DataFrame:
    """`shared` with `added`: the words of a window that none before it has."""
    before = F.max(F.col("start") + F.col("size")).over(Window.partitionBy("key").orderBy("start", "size", "held").rowsBetween(Window.unboundedPreceding, -1))
    return shared.withColumn("added", F.greatest(F.col("start") + F.col("size") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0)))


def op11_decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of `docs` (doc_id, text): words, words inside windows
    that `items` (item_id, text) hold too, and these items."""
    prints, sets, members, sizes = benchmark_windows(items)
    texts = docs.select(text_key("text").alias("key"), words_of("text").alias("w"))
    shared = shared_windows(texts, prints, sets, sizes or [SPAN])
    by_text = written(added_words(shared).groupBy("key").agg(F.sum("added").alias("n_hit"), F.sort_array(F.collect_set("held")).alias("sets")))
    # items of each distinct set of sets
    listed = by_text.select("sets").distinct().withColumn("held", F.explode("sets")).join(members, "held").select("sets", "item_id").distinct()
    listed = listed.groupBy("sets").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    found = written(by_text.join(listed, "sets", "left").select("key", "n_hit", "n_items", "items_sha256"))
    own = docs.select("doc_id", text_key("text").alias("key"), n_words("text").alias("n_words"))
    x = looked_up(own, found, ["key"], F.col("doc_id"), "left")
    hit, n_items = F.coalesce("n_hit", F.lit(0)), F.coalesce("n_items", F.lit(0))
    return x.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), n_items.alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, share: float = 0.0) -> DataFrame:
    """The rows of `docs` of which no more than `share` of the words is hit, with their own columns."""
    prints, sets, _, sizes = benchmark_windows(items)
    shared = shared_windows(docs.select(text_key("text").alias("key"), words_of("text").alias("w")), prints, sets, sizes or [SPAN])
    hit = written(added_words(shared).groupBy("key").agg(F.sum("added").alias("__hit")).withColumnRenamed("key", "__key"))
    rows = docs.select(*docs.columns, text_key("text").alias("__key"))
    x = looked_up(rows, hit, ["__key"], F.col("__key"), "left")
    return x.filter(F.coalesce("__hit", F.lit(0)) <= share * F.greatest(n_words("text"), F.lit(1))).select(*docs.columns)


def oracle_sql() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), i AS (SELECT item_id, {words} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {SPAN}) AS size, array_to_string(w[p:p + least(len(w), {SPAN}) - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - {SPAN} + 1, 1))) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, p, size, array_to_string(w[p:p + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
m AS (SELECT doc_id, p, size, item_id FROM dw JOIN iw USING (size, win)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + size - 1)) AS q FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
