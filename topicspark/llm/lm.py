"""Language-model scoring by cross-entropy difference.

Two bigram models, of the trusted target documents and of the whole corpus as background, are matched: same order, same
smoothing, one shared vocabulary (a word seen fewer than MIN_COUNT times in the whole corpus is the unknown word in both). Each
token's loss under the two models is differenced; a document's score is the mean difference, negative for text closer to the
target.

Counts are exact and grow with the corpus. Tasks cut their documents into chunks and count each chunk's distinct words, then its
distinct pairs; sorted keys are dealt by range to buckets, whose number grows with the bytes of text, and each bucket adds the
counts of its keys over all chunks and answers every chunk. The driver sees a few sums a bucket. Words are told apart by 64-bit
hashes (any two of a hundred million words are equal with odds of 3 in 10,000), pairs by the numbers of both words.

Words are `[^\\x20\\x09-\\x0D]+`, lower-cased in A-Z. Edge cases: null and empty texts have no tokens and score 0; without target
documents the target model is uniform over the vocabulary; a text of any length is read whole; labels may repeat (the largest
counts); rows that repeat an id are counted and scored row by row; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import mixed, slices, span_hashes, strings, with_labels, words, written

MIN_COUNT = 3
#: Share of the bigram estimate against the unigram one.
BIGRAM = 0.6
#: Tokens of a chunk (a longer text is a chunk of its own) and bytes of text for each bucket.
CHUNK, BUCKET_BYTES = 1 << 20, 1 << 23

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row of each word."""
    data, starts, ends = strings(array)
    data = _LOWER[data]
    begin, end, row = words(data, starts, ends)
    return span_hashes(data, begin, end), row


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes, planes of equal significance together."""
    return zlib.compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in arrays), 1)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    data = zlib.decompress(data)
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(-1, n).T if n else np.zeros(0, np.uint8)).reshape(-1).view(k))
        at += size
    return out


def _dealt(chunk: int, key: np.ndarray, n: np.ndarray, t: np.ndarray, buckets: int) -> dict[str, list]:
    """Sorted keys and their counts cut into one row for each bucket that gets any."""
    edge = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], np.uint64)
    cut = [0, *np.searchsorted(key, edge).tolist(), len(key)]
    own = [b for b in range(buckets) if cut[b] < cut[b + 1]]
    return {"chunk": [chunk] * len(own), "bucket": own, "body": [_packed(key[cut[b] : cut[b + 1]], n[cut[b] : cut[b + 1]], t[cut[b] : cut[b + 1]]) for b in own]}


def _added(frame: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's rows: cut points between rows, each key's place among the distinct keys, and the distinct keys' sums."""
    parts = [_unpacked(x, "u8", "i8", "i8") for x in frame["body"].to_pylist()]
    key, n, t = (np.concatenate(x) for x in zip(*parts, strict=True))
    distinct, place = np.unique(key, return_inverse=True)
    sums = []
    for x in (n, t):
        out = np.zeros(len(distinct), np.int64)
        np.add.at(out, place, x)
        sums.append(out)
    return np.cumsum([0, *[len(p[0]) for p in parts]]).tolist(), place, *sums


def _chunks(buckets: int, most: int):
    """Of batches (doc_id, text, target): a row for each chunk with its documents and tokens, and rows of its words by bucket."""

    def made(chunk: int, ids: list, target: list, length: list, found: list) -> dict[str, list]:
        length, found = np.concatenate(length), np.concatenate(found)
        target = np.concatenate(target)
        key, place, n = np.unique(found, return_inverse=True, return_counts=True)
        t = np.bincount(place[np.repeat(target, length)], minlength=len(key))
        # places by falling count compress well
        rank = np.empty(len(key), np.int32)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(key), dtype=np.int32)
        out = _dealt(chunk, key, n.astype(np.int64), t.astype(np.int64), buckets)
        texts = _packed(length.astype(np.int64), target.astype(np.uint8))
        rows = {"chunk": [chunk, *out["chunk"]], "bucket": [-1, *out["bucket"]], "body": [_packed(n.astype(np.int64)), *out["body"]]}
        more = len(out["chunk"])
        return rows | {"ids": [ids, *[None] * more], "texts": [texts, *[None] * more], "places": [_packed(rank[place]), *[None] * more]}

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        ids, target, length, found, size, kind = [], [], [], [], 0, None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            id_, text, own = batch.column("doc_id"), batch.column("text"), batch.column("target").to_numpy(zero_copy_only=False)
            for a, b in slices(text):
                h, row = tokens(text.slice(a, b - a))
                ids += id_.slice(a, b - a).to_pylist()
                target.append(own[a:b])
                length.append(np.bincount(row, minlength=b - a))
                found.append(h)
                size += len(h)
                if size >= most:
                    yield batch_of(made(chunk, ids, target, length, found), kind)
                    ids, target, length, found, size, chunk = [], [], [], [], 0, chunk + 1
        if ids:
            yield batch_of(made(chunk, ids, target, length, found), kind)

    def batch_of(rows: dict[str, list], kind: pa.DataType) -> pa.RecordBatch:
        types = {"chunk": pa.int64(), "bucket": pa.int32(), "body": pa.binary(), "ids": pa.list_(kind), "texts": pa.binary(), "places": pa.binary()}
        return pa.RecordBatch.from_pydict({k: pa.array(rows[k], t) for k, t in types.items()})

    return run


def _count_words(frame: pa.Table) -> pa.Table:
    """Answers to the chunks: each word's number within the bucket (0 if unknown) and its counts; and a row -1 of the bucket's sums."""
    cut, place, n, t = _added(frame)
    known = n >= MIN_COUNT
    number = np.where(known, np.cumsum(known), 0)
    chunk, bucket = frame["chunk"].to_pylist(), frame["bucket"][0].as_py()
    body = [_packed(number[p], n[p], t[p]) for p in (place[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))]
    sums = [[None] * len(chunk) + [int(x)] for x in (known.sum(), n.sum(), t.sum(), n[known].sum(), t[known].sum())]
    return pa.table([pa.array([*chunk, -1], pa.int64()), pa.array([bucket] * (len(chunk) + 1), pa.int32()), pa.array([*body, b""], pa.binary()), *[pa.array(x, pa.int64()) for x in sums]], ["chunk", "bucket", "body", *SUMS])


SUMS = ["known", "n", "t", "known_n", "known_t"]


def _count_pairs(frame: pa.Table) -> pa.Table:
    cut, place, n, t = _added(frame)
    body = [_packed(n[p], t[p]) for p in (place[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True))]
    return pa.table([frame["chunk"].combine_chunks(), frame["bucket"].combine_chunks(), pa.array(body, pa.binary())], ["chunk", "bucket", "body"])


@dataclass(frozen=True)
class Vocabulary:
    """Where each bucket's word numbers start, the known words' number and each model's (all tokens, unknown tokens)."""

    first: np.ndarray
    known: int
    background: tuple[int, int]
    target: tuple[int, int]


@dataclass(frozen=True)
class Chunk:
    """A chunk's texts (length, target), and per token: word (place in `number`; 0 is the unknown word) and left context (-1 at a
    text's start); the words' numbers and counts in (background, target)."""

    length: np.ndarray
    target: np.ndarray
    word: np.ndarray
    left: np.ndarray
    number: np.ndarray
    counts: tuple[np.ndarray, np.ndarray]

    @classmethod
    def read(cls, texts: bytes, body: bytes, places: bytes, answers: list[tuple[int, bytes]], vocabulary: Vocabulary) -> Chunk:
        length, target = _unpacked(texts, "i8", "u1")
        (own,) = _unpacked(body, "i8")
        (rank,) = _unpacked(places, "i4")
        parts = []
        for bucket, answer in sorted(answers):
            number, n, t = _unpacked(answer, "i8", "i8", "i8")
            parts.append((np.where(number > 0, number + vocabulary.first[bucket], 0), n, t))
        number, n, t = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
        known = number > 0
        local = np.where(known, np.cumsum(known), 0)
        word = local[np.argsort(-own, kind="stable")[rank]]
        left = np.full(len(word), -1, np.int64)
        left[1:] = word[:-1]
        start = (np.cumsum(length) - length)[length > 0]
        left[start] = -1
        counts = tuple(np.append(unknown, x[known]) for x, (_, unknown) in ((n, vocabulary.background), (t, vocabulary.target)))
        return cls(length, target > 0, word, left, np.append(0, number[known]), counts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs in the order of their global keys: key, left, word; and each token's pair, for the tokens `has`."""
        has = self.left >= 0
        width = len(self.number)
        code, place = np.unique(self.left[has] * width + self.word[has], return_inverse=True)
        left, word = np.divmod(code, width)
        with np.errstate(over="ignore"):
            key = mixed((self.number[left].astype(np.uint64) << np.uint64(32)) | self.number[word].astype(np.uint64))
        order = np.argsort(key)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return key[order], left[order], word[order], rank[place], has

    def losses(self, vocabulary: Vocabulary, answers: list[tuple[int, bytes]]) -> list[np.ndarray]:
        """Mean loss in bits of each text under (target, background)."""
        _, left, word, place, has = self.pairs()
        parts = [_unpacked(x, "i8", "i8") for _, x in sorted(answers)]
        twos = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2
        row = np.repeat(np.arange(len(self.length)), self.length)
        out = []
        for ones, two, (total, _) in ((self.counts[1], twos[1], vocabulary.target), (self.counts[0], twos[0], vocabulary.background)):
            single = (ones + 1.0) / (float(total) + vocabulary.known + 1)
            context = ones[left].astype(float)
            double = np.where(context > 0, BIGRAM * two / np.maximum(context, 1) + (1 - BIGRAM) * single[word], single[word])
            p = single[self.word]
            p[has] = double[place]
            out.append(np.bincount(row, weights=-np.log2(p), minlength=len(self.length)) / np.maximum(self.length, 1))
        return out


def op3_lm(docs: DataFrame, labels: DataFrame, chunk: int = CHUNK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_tokens, target and background loss per token in bits, and their difference `score`; target documents are labelled
    of good quality and not toxic."""
    spark = docs.sparkSession
    known_labels = labels.select("doc_id", F.when((F.col("quality") > 0) & ~F.coalesce(F.col("toxic") > 0, F.lit(False)), 1).otherwise(0).alias("target"))
    data = with_labels(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), known_labels, "target").select("doc_id", "text", (F.coalesce("target", F.lit(0)) > 0).alias("target"))
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // bucket_bytes)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chunks = written(data.mapInArrow(_chunks(buckets, chunk), f"chunk long, bucket int, body binary, ids array<{id_type}>, texts binary, places binary"))
    counted = chunks.filter("bucket >= 0").select("chunk", "bucket", "body").groupBy("bucket").applyInArrow(_count_words, f"chunk long, bucket int, body binary, {', '.join(f'{c} long' for c in SUMS)}")
    counted = written(counted)
    first, total = np.zeros(buckets, np.int64), np.zeros(5, np.int64)
    for r in counted.filter("chunk < 0").select("bucket", *SUMS).collect():
        first[r["bucket"]] = r["known"]
        total += np.array(r[1:])
    known, n, t, known_n, known_t = total.tolist()
    held = spark.sparkContext.broadcast(Vocabulary(np.cumsum(first) - first, known, (n, n - known_n), (t, t - known_t)))

    def read(frame: pa.Table) -> Chunk:
        own, rest = None, []
        for kind, bucket, body, texts, places in zip(*(frame[c].to_pylist() for c in ("kind", "bucket", "body", "texts", "places")), strict=True):
            if kind == 0:
                own = (texts, body, places)
            elif kind == 1:
                rest.append((bucket, body))
        return Chunk.read(*own, rest, held.value)

    def pair_rows(frame: pa.Table) -> pa.Table:
        c = read(frame)
        key, _, _, place, has = c.pairs()
        n = np.bincount(place, minlength=len(key))
        t = np.bincount(place[np.repeat(c.target, c.length)[has]], minlength=len(key))
        rows = _dealt(frame["chunk"][0].as_py(), key, n.astype(np.int64), t.astype(np.int64), buckets)
        return pa.table({"chunk": pa.array(rows["chunk"], pa.int64()), "bucket": pa.array(rows["bucket"], pa.int32()), "body": pa.array(rows["body"], pa.binary())})

    def scores(frame: pa.Table) -> pa.Table:
        c = read(frame)
        answers = [(b, x) for k, b, x in zip(*(frame[c].to_pylist() for c in ("kind", "bucket", "body")), strict=True) if k == 2]
        target, background = c.losses(held.value, answers)
        ids = frame["ids"].combine_chunks()
        return pa.table([ids.filter(ids.is_valid()).flatten(), pa.array(c.length), pa.array(target), pa.array(background)], ["doc_id", "n_tokens", "target_bits", "background_bits"])

    def rows(df: DataFrame, kind: int) -> DataFrame:
        more = [c if c in df.columns else F.lit(None).cast(k).alias(c) for c, k in (("ids", f"array<{id_type}>"), ("texts", "binary"), ("places", "binary"))]
        return df.select("chunk", F.lit(kind).alias("kind"), "bucket", "body", *more)

    # what a chunk needs: its own row and the answers about its words, then those about its pairs
    told = rows(chunks.filter("bucket < 0"), 0).union(rows(counted.filter("chunk >= 0"), 1))
    asked = told.groupBy("chunk").applyInArrow(pair_rows, "chunk long, bucket int, body binary")
    answered = asked.groupBy("bucket").applyInArrow(_count_pairs, "chunk long, bucket int, body binary")
    scored = told.union(rows(answered, 2)).groupBy("chunk").applyInArrow(scores, f"doc_id {id_type}, n_tokens long, target_bits double, background_bits double")
    return scored.withColumn("score", F.col("target_bits") - F.col("background_bits"))
