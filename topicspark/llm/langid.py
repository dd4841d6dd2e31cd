"""Language identification by a byte convolutional network.

Filters two, three and four bytes wide run over fixed-length windows of a text's UTF-8 bytes; the maximum of each filter over a
window feeds a softmax over the languages. The network is trained in numpy on a bounded sample of labelled texts and applied to
every window of every text, the windows' log-probabilities being averaged by their length.

Edge cases: a null text, or one without letters, is `und` with score 0; a text of any length is read whole; a last short window
is padded with spaces; with one learned language every text with letters is that language; with none all are `und`; rows that
repeat an id are predicted row by row; other columns are left alone or out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import crc_mod, looked_up, slices, strings

WIDTHS = (2, 3, 4)
FILTERS = 8
WINDOW = 192
#: Texts that the network is fitted on, per language and in all, at most; of each, one window.
FIT_TEXTS, FIT_ALL = 1500, 60_000
BATCH, EPOCHS = 64, 6


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows (padded with spaces), each one's row and its length. Each is followed by three spaces, for filters
    that reach over the end."""
    size = ends - starts
    each = -(-size // WINDOW)
    row = np.repeat(np.arange(len(starts)), each)
    k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    begin = starts[row] + k * WINDOW
    length = np.minimum(WINDOW, ends[row] - begin)
    out = np.full((len(row), WINDOW + 3), 32, np.uint8)
    at = np.arange(WINDOW)
    inside = at < length[:, None]
    out[:, :WINDOW][inside] = data[(begin[:, None] + at)[inside]]
    return out, row, length


@dataclass(frozen=True)
class ByteNetwork:
    """taps[width]: (width, 256, filters), the filter weights of each byte value; `out` and `bias` of the softmax layer."""

    langs: list[str]
    taps: dict[int, np.ndarray]
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def paired(self) -> tuple[np.ndarray, np.ndarray]:
        """The same filters as tables over byte pairs: one for the first two bytes of all widths, one for what follows."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        first = np.concatenate([pair(self.taps[w][0], self.taps[w][1]) for w in WIDTHS], axis=1)
        second = np.concatenate([pair(self.taps[3][2], np.zeros_like(self.taps[3][2])), pair(self.taps[4][2], self.taps[4][3])], axis=1)
        return first.astype(np.float32), second.astype(np.float32)

    def log_probabilities(self, win: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        pooled = np.empty((len(win), len(WIDTHS) * FILTERS), np.float32)
        for a in range(0, len(win), 64):
            part = win[a : a + 64].astype(np.int32)
            code = part[:, :-1] << 8 | part[:, 1:]
            z = tables[0][code[:, :WINDOW]]
            z[:, :, FILTERS:] += tables[1][code[:, 2 : WINDOW + 2]]
            z.max(axis=1, out=pooled[a : a + 64])
        h = np.maximum(pooled + self.shift, 0)
        logits = h @ self.out + self.bias
        return logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)


def train_network(texts: list[str], labels: list[str], seed: int = 7) -> ByteNetwork:
    """Fit by Adam; gradients pass each pooled maximum back to the bytes that made it."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.searchsorted(langs, labels)
    array = pa.array(texts, pa.string())
    data, starts, ends = strings(array)
    # one window from a seeded place in each text
    size = ends - starts
    begin = starts + (rng.random(len(starts)) * np.maximum(1, size - WINDOW + 1)).astype(np.int64)
    win, _, _ = windows(data, begin, np.minimum(begin + WINDOW, ends))
    width_of = np.repeat(WIDTHS, FILTERS)
    params = [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS] + [np.zeros(len(width_of)), rng.normal(0, 0.3, (len(width_of), len(langs))), np.zeros(len(langs))]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x, n = win[rows], len(rows)
            best, pooled = [], []
            for w, tap in zip(WIDTHS, params, strict=False):
                z = sum(tap[j].astype(np.float32)[x[:, j : j + WINDOW]] for j in range(w))
                best.append(z.argmax(axis=1))
                pooled.append(np.take_along_axis(z, best[-1][:, None, :], 1)[:, 0])
            pre = np.concatenate(pooled, axis=1) + params[-3]
            h = np.maximum(pre, 0)
            logits = h @ params[-2] + params[-1]
            p = np.exp(logits - np.logaddexp.reduce(logits, axis=1, keepdims=True))
            p[np.arange(n), y[rows]] -= 1
            p /= n
            back = (p @ params[-2].T) * (pre > 0)
            grads = []
            for k, w in enumerate(WIDTHS):
                g, part = np.zeros_like(params[k]), back[:, k * FILTERS : (k + 1) * FILTERS]
                for j in range(w):
                    np.add.at(g[j], (np.take_along_axis(x, best[k] + j, 1), np.arange(FILTERS)), part)
                grads.append(g)
            grads += [back.sum(0), h.T @ p, p.sum(0)]
            t += 1
            rate = 0.02 * (1 - epoch / EPOCHS)
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return ByteNetwork(langs, dict(zip(WIDTHS, params, strict=False)), params[-3].astype(np.float32), params[-2].astype(np.float32), params[-1].astype(np.float32))


def train_langid(docs: DataFrame, fit_texts: int = FIT_TEXTS) -> ByteNetwork | None:
    """Fit on `docs` (doc_id, text, lang): of each language the `fit_texts` documents with letters that come first by a hash of
    the id (fewer each, if there are so many languages that they would be over FIT_ALL). Only distinct ids are ranked, and
    only about twice as many as are taken; the few texts chosen follow, of an id on several rows the one of the least text hash."""
    languages = docs.agg(F.countDistinct("lang")).head()[0]
    fit_texts = min(fit_texts, max(1, FIT_ALL // max(1, languages)))
    fit = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # ids whose hash is in the part of its range where twice as many as wanted lie; few are ranked, and languages of fewer in whole
    ids = fit.select("doc_id", "lang", F.xxhash64("doc_id").alias("place"))
    ids = looked_up(ids, ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")), ["lang"], F.col("place"))
    ids = ids.filter(F.col("place") / F.lit(2.0**64) + 0.5 <= 2 * fit_texts / F.col("n")).drop("n").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    ids = ids.withColumn("rank", rank).filter(F.col("rank") <= fit_texts)
    ids = ids.select("doc_id", "lang")
    # a cut of this length from a seeded place is all that training looks at
    cut = F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - WINDOW, F.lit(1))).cast("int") + 1, WINDOW + 8)
    # at most FIT_ALL ids, or one for each language
    small = languages <= FIT_ALL
    rows = fit.join(F.broadcast(ids) if small else ids, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), cut.alias("text"))).alias("one")).select("doc_id", "one.text", "lang").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    return train_network(rows["text"].to_pylist(), rows["lang"].to_pylist())


def identified(docs: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """`docs` with `lang_pred` and `score`."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if network is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("lang string, score double")
    def predict(array: pa.Array) -> pa.Array:
        net = held.value
        tables, names, scores = net.paired(), [], []
        for a, b in slices(array, 1 << 19):
            data, starts, ends = strings(array.slice(a, b - a))
            win, row, length = windows(data, starts, ends)
            logp = net.log_probabilities(win, tables) * length[:, None]
            total = np.stack([np.bincount(row, weights=logp[:, k], minlength=b - a) for k in range(len(net.langs))], axis=1)
            mean = total / np.maximum(ends - starts, 1)[:, None]
            p = np.exp(mean - np.logaddexp.reduce(mean, axis=1, keepdims=True))
            names.append(p.argmax(axis=1))
            scores.append(p.max(axis=1))
        index = np.concatenate(names) if names else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(net.langs, pa.string()).take(pa.array(index)), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["lang", "score"])

    found = predict(F.coalesce("text", F.lit("")))
    return docs.withColumn("__lang", found).withColumns({"lang_pred": F.when(letters, F.col("__lang.lang")).otherwise("und"), "score": F.when(letters, F.col("__lang.score")).otherwise(0.0)}).drop("__lang")


def op4_langid(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns only from rows whose crc32 of the id is not 1 mod 3."""
    part = crc_mod("doc_id", 3)
    network = train_langid(docs.filter(part != 1).select("doc_id", "text", "lang"))
    return identified(docs.select("doc_id", "text"), network).select("doc_id", (part == 1).alias("held_out"), "lang_pred", "score")
