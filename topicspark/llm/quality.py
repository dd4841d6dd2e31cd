"""Quality rules: word and line rules, then a hashed n-gram log-likelihood ratio against a fixed threshold.

Two multinomials over hashed byte n-grams are counted, one over the trusted documents (label 1) and one over the whole corpus;
a document's score is the mean log ratio of its n-grams. The threshold separates labelled bad from labelled good documents, a
wrongly dropped good document counting GOOD_COST times.

Edge cases: null and empty texts have no words and fail the base rules; a text of any length is read whole; labels may repeat
(the largest counts); with no trusted or no bad document there is no threshold, so the base rules decide alone; rows that repeat an
id are judged row by row; a score right at the threshold is kept; other columns are left alone or out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import SEPARATORS, mixed, slices, span_hashes, strings, sum_per_row, summed_arrays, with_labels, words

BITS = 17
ORDER = 3
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Cost of dropping a good document against keeping a bad one.
GOOD_COST = 25
BIN = 0.001

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_ROW = np.uint64(0xD6E8FEB86659FD93)


def _equal_to_earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts `keys`, and which of the sorted keys equal the one before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ranked[1:] == ranked[:-1]
    return order, same


def text_stats(array: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, starts, ends = strings(array)
    rows = len(starts)
    inside = ~SEPARATORS[data]
    out = {"word_chars": sum_per_row(inside & ((data & 0xC0) != 0x80), starts, ends), "n_symbols": sum_per_row(_SYMBOLS[data], starts, ends)}
    begin, end, row = words(data, starts, ends)
    out["n_words"] = np.bincount(row, minlength=rows)
    breaks = np.flatnonzero(data == 10)
    line_begin, line_end = np.sort(np.concatenate([starts, breaks + 1])), np.sort(np.concatenate([breaks, ends]))
    full = sum_per_row(inside, line_begin, line_end) > 0
    line_begin, line_end = line_begin[full], line_end[full]
    of = np.searchsorted(ends, line_begin, side="right")
    with np.errstate(over="ignore"):
        order, same = _equal_to_earlier(mixed(span_hashes(data, line_begin, line_end) + (of + 1).astype(np.uint64) * _ROW))
        out["n_dup_lines"] = np.bincount(of[order[same]], minlength=rows)
        out["n_repeat_words"] = np.zeros(rows, np.int64)
        last = len(begin) - WINDOW + 1
        if last > 0:
            h = span_hashes(data, begin, end)
            window = np.zeros(last, np.uint64)
            for k in range(WINDOW):
                window = window * np.uint64(0x100000001B3) + h[k : k + last]
            own = np.flatnonzero(row[:last] == row[WINDOW - 1 :])
            order, same = _equal_to_earlier(mixed(window[own] + (row[own] + 1).astype(np.uint64) * _ROW))
            both = same.copy()
            both[:-1] |= same[1:]
            found = own[order[both]]
            steps = np.zeros(len(begin) + 1, np.int32)
            steps[found] += 1
            np.subtract.at(steps, found + WINDOW, 1)
            out["n_repeat_words"] = np.bincount(row[np.cumsum(steps[:-1]) > 0], minlength=rows)
    return out


def ngrams(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every byte n-gram."""
    data, starts, ends = strings(array)
    row = np.repeat(np.arange(len(starts), dtype=np.int32), ends - starts)
    if len(data) < ORDER:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    wide, last = data.astype(np.uint32), len(data) - ORDER + 1
    packed = wide[:last] << 16 | wide[1 : last + 1] << 8 | wide[2 : last + 2]
    own = row[:last] == row[ORDER - 1 :]
    return (packed * np.uint32(0x9E3779B1))[own] >> np.uint32(32 - BITS), row[:last][own]


@dataclass(frozen=True)
class QualityModel:
    """`ratio` is the log ratio of each bucket (None without trusted documents); documents under `threshold` are dropped."""

    ratio: np.ndarray | None
    threshold: float

    def scores(self, array: pa.Array) -> np.ndarray:
        """Mean log ratio; 0 for a text without n-grams."""
        out = np.zeros(len(array))
        if self.ratio is not None:
            for a, b in slices(array):
                bucket, row = ngrams(array.slice(a, b - a))
                n = np.bincount(row, minlength=b - a)
                out[a:b] = np.bincount(row, weights=self.ratio[bucket], minlength=b - a) / np.maximum(n, 1)
        return out


def _counts(batches) -> np.ndarray:
    """N-gram counts over trusted documents, then over all."""
    size = 1 << BITS
    out = np.zeros(2 * size, np.int64)
    for batch in batches:
        text, trusted = batch.column("text"), batch.column("trusted").to_numpy(zero_copy_only=False)
        for a, b in slices(text):
            bucket, row = ngrams(text.slice(a, b - a))
            out[size:] += np.bincount(bucket, minlength=size)
            out[:size] += np.bincount(bucket[trusted[a:b][row]], minlength=size)
    return out


def _scored(docs: DataFrame, model: QualityModel, output: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(array: pa.Array) -> pa.Array:
        return pa.array(held.value.scores(array))

    return docs.withColumn(output, score(F.coalesce("text", F.lit(""))))


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Count both multinomials over all of `docs` (doc_id, text); set the threshold over all labelled documents."""
    known = labels.filter(F.col(label).isNotNull())
    data = with_labels(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), known, label)
    size = 1 << BITS
    sums = summed_arrays(data.select("text", F.coalesce(F.col(label) > 0, F.lit(False)).alias("trusted")), _counts, 2 * size)
    trusted, raw = sums[:size], sums[size:]
    if not trusted.sum():
        return QualityModel(None, -np.inf)
    p = lambda c: np.log((c + 0.5) / (c.sum() + 0.5 * size))
    model = QualityModel((p(trusted) - p(raw)).astype(np.float32), -np.inf)
    bins = F.floor(F.col("__score") / BIN).alias("bin")
    rows = _scored(data.filter(F.col(label).isNotNull()), model, "__score").groupBy(bins, (F.col(label) > 0).alias("good")).count().orderBy("bin").collect()
    # each bin's lower edge is a candidate: what lies under it is dropped
    edges = sorted({r["bin"] for r in rows})
    good = {r["bin"]: r["count"] for r in rows if r["good"]}
    bad = {r["bin"]: r["count"] for r in rows if not r["good"]}
    best, gain, threshold = 0.0, 0.0, -np.inf
    for edge in edges:
        gain += bad.get(edge, 0) - GOOD_COST * good.get(edge, 0)
        if gain > best:
            best, threshold = gain, (edge + 1) * BIN
    return QualityModel(model.ratio, float(threshold))


def judged(docs: DataFrame, model: QualityModel) -> DataFrame:
    """`docs` with a struct `__quality` of the five statistics, base_failed, score and kept."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    @F.arrow_udf(", ".join(f"{n} long" for n in names) + ", base_failed boolean, score double, kept boolean")
    def judge(array: pa.Array) -> pa.Array:
        parts = [text_stats(array.slice(a, b - a)) for a, b in slices(array)]
        stats = {n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in names}
        failed = (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEATED_PERCENT * stats["n_words"])
        score = held.value.scores(array)
        columns = [*stats.values(), failed, score, ~failed & (score >= held.value.threshold)]
        return pa.StructArray.from_arrays([pa.array(x) for x in columns], [*names, "base_failed", "score", "kept"])

    return docs.withColumn("__quality", judge(F.coalesce("text", F.lit(""))))


def op10_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five statistics, base_failed, kept and score."""
    docs = docs.select("doc_id", "text")
    q = judged(docs, train_quality(docs, labels))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return q.select("doc_id", *[F.col(f"__quality.{n}") for n in names])


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are kept, with their own columns."""
    return judged(docs, train_quality(docs, labels)).filter("__quality.kept").drop("__quality")
