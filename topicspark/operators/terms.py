"""Distinctive words of groups of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicspark.functions.text import LEAST_LETTERS, WORD_END
from topicspark.sources.tables import stored

MIN_DF, MAX_SHARE = 2, 0.5
#: Bytes of texts whose words are told apart at once (or one text).
BYTES = 24 << 20


def default_stopwords(language: str = "german") -> list[str]:
    """Spark's own list for a language; pass a list of your own for a domain."""
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords(language)


def _some_texts(batches):
    """Parts of `batches` of up to BYTES of text each."""
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            n = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right")) - at, 1)
            yield batch.slice(at, n)
            at += n


def _words_counted(names: list[str]):
    """Counts the letter words of a few texts at a time by the columns `names`: (names, term, n, df), a row for each batch, group and word."""

    def run(batches):
        for batch in _some_texts(batches):
            cut = pc.split_pattern_regex(pa.array([(t or "").lower() for t in batch.column("text").to_pylist()], pa.string()), WORD_END)
            told = cut.flatten().dictionary_encode()
            words = told.dictionary.to_pylist()
            good = np.array([len(w) >= LEAST_LETTERS and w.isalpha() for w in words], bool)
            code, row = told.indices.to_numpy().astype(np.int64), pc.list_parent_indices(cut).to_numpy()
            code, row = code[good[code]], row[good[code]]
            groups: dict[tuple, int] = {}
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(*[batch.column(c).to_pylist() for c in names], strict=True)], np.int64)
            # first the words of each text, then those of each group
            own, n = np.unique(row * len(words) + code, return_counts=True)
            both, at = np.unique(group[own // len(words)] * len(words) + own % len(words), return_inverse=True)
            first = np.unique(group, return_index=True)[1]
            taken = [batch.column(c).take(pa.array(first[both // len(words)])) for c in names]
            counts = [pa.array(np.bincount(at, w, len(both)).astype(np.int64)) for w in (n, None)]
            yield pa.RecordBatch.from_arrays([*taken, told.dictionary.take(pa.array(both % len(words))), *counts], [*names, "term", "n", "df"])

    return run


def term_counts(docs: DataFrame, stopwords: list[str] = (), keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cluster, term, n, df): occurrences of the letter words that aren't stop words, and the texts with them. `docs` has
    keys, cluster and text. Words are counted by groups of some texts before they leave a task, so one shuffle of these counts, by word, does it."""
    spark, names, types = docs.sparkSession, [*keys, "cluster"], dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in names], "term string, n long, df long"])
    # by words alone: what is told of a word later needs no other shuffle
    each = docs.select(*names, "text").mapInArrow(_words_counted(names), schema).repartition("term")
    counted = each.groupBy(*names, "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    if stopwords:
        counted = counted.join(F.broadcast(spark.createDataFrame([(w,) for w in sorted(set(stopwords))], "term string")), "term", "left_anti")
    return counted.select(*names, "term", "n", "df")


def _few(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A hint for what is one row without keys; with keys its size isn't known."""
    return df if keys else F.broadcast(df)


def _totals(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return docs.select(*keys, F.lit(1).alias("one")).groupBy(*keys, "one").agg(F.count("*").alias("total"))


def _kept_terms(counted: DataFrame, docs: DataFrame, min_df: int, max_share: float, keys: tuple[str, ...]) -> DataFrame:
    terms = counted.groupBy(*keys, "term").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).filter(F.col("df") >= min_df).select("*", F.lit(1).alias("one"))
    terms = terms.join(_few(_totals(docs, keys), keys), [*keys, "one"])
    return terms.filter(F.col("df") <= max_share * F.col("total")).select(*keys, "term", "df", "n")


def vocabulary(docs: DataFrame, stopwords: list[str] = (), min_df: int = MIN_DF, max_share: float = MAX_SHARE, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, term, df, n) of the terms kept: letter words that aren't stop words, in at least `min_df` texts and at most
    `max_share` of all (of a key's own, if keys are given). `docs` has keys and text."""
    counted = term_counts(docs.select(*keys, F.lit(0).alias("cluster"), "text"), stopwords, keys)
    return _kept_terms(counted, docs, min_df, max_share, keys)


def cluster_terms(docs: DataFrame, stopwords: list[str] = (), top: int = 4, min_df: int = MIN_DF, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, cluster, rank, term, score) of the `top` terms of each cluster by class-based TF-IDF, within each key if keys are
    given. `docs` has keys, text and cluster; cluster < 0 is noise, which counts in the global counts and the vocabulary only."""
    own, one = Window.partitionBy("term", *keys), F.lit(1).alias("one")
    counted = term_counts(docs, stopwords, keys).withColumns({"own": F.col("n"), "n": F.sum("n").over(own), "df": F.sum("df").over(own)})
    # most words are in too few texts: they go before anything is joined, and what stays is told apart once
    counted = counted.filter((F.col("df") >= min_df) & (F.col("cluster") >= 0)).select("*", one)
    tf = counted.join(_few(_totals(docs, keys), keys), [*keys, "one"]).filter(F.col("df") <= MAX_SHARE * F.col("total"))
    tf = stored(tf.select(*keys, "cluster", "term", "own", "n"))
    size = tf.groupBy(*keys, "cluster").agg(F.sum("own").alias("size"))
    # clusters without a term of the vocabulary count as well
    clusters = docs.filter("cluster >= 0").select(*keys, "cluster", one).groupBy(*keys, "one").agg(F.countDistinct("cluster").alias("clusters"))
    mean = size.select("*", one).groupBy(*keys, "one").agg(F.sum("size").alias("all")).join(_few(clusters, keys), [*keys, "one"]).select(*keys, "one", (F.col("all") / F.col("clusters")).alias("mean"))
    idf = F.log1p(F.col("mean") / F.greatest("n", F.lit(1)))
    scored = tf.select("*", one).join(size, [*keys, "cluster"]).join(_few(mean, keys), [*keys, "one"]).withColumn("score", F.round(F.col("own") / F.greatest("size", F.lit(1)) * idf, 9))
    rank = F.row_number().over(Window.partitionBy(*keys, "cluster").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select(*keys, "cluster", "rank", "term", "score")


def majority(rows: DataFrame, group: str | list[str], value: str, order: str, keep: Column | None = None) -> DataFrame:
    """(group, value, n): the commonest value of each group; of equal ones that seen first by `order`."""
    keys = [group] if isinstance(group, str) else group
    n = (rows if keep is None else rows.filter(keep)).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), "__first")
    return n.withColumn("__rn", F.row_number().over(best)).filter("__rn = 1").drop("__rn", "__first")
