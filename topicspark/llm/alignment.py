"""Alignment of two tokenizers' ids by pointer jumping.

Tokens of both tokenizers are ranges of the same bytes, and ranges that overlap, directly or through others, are one group. In a batch
of texts every token points to the token of the other side that overlaps it and ends farthest to the right (a token of the first side
that no such one outlasts points to itself); successors are doubled, all at once, until none changes, which takes as many rounds as the
longest chain has binary digits. Each token then points to its group's last token of the first side, which labels the group. Where a
group ends, a token of either side ends: that pair is linked.

Texts are encoded once, and what was found is written to the shared folder. Links are added up per document, then per task, then over
the corpus; the counts of pairs are joined back to the documents' distinct pairs, broadcast up to FEW pairs and by salted shuffle beyond.

The first tokenizer's merges run in padded matrices (the module of op8) where its file is byte-level BPE with merges in order of ids
and the usual split; any other file goes to the tokenizers library.

Edge cases: texts that are null or empty, and those whose bytes the tokens of either side don't join to, have no tokens: zeros, and an
empty digest. Texts of any length are aligned whole, a batch of BATCH bytes or one longer text at a time; rows that repeat an id, or
have none, are aligned row by row and their links all count; ties for the highest count are all best; other columns are left alone; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.bpe import Tokenizer, ragged, rank_file
from topicspark.llm.common import looked_up, slices, strings, written

#: Bytes of text aligned at once, pairs of ids that are broadcast at most (some 30 MB), and rounds of doubling that any chain ends in.
BATCH, FEW, ROUNDS = 1 << 21, 500_000, 64
_held: dict = {}


def byte_letters() -> dict[str, int]:
    """The character that byte-level BPE writes for each byte: printable Latin-1 stands for itself, others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevelSide:
    """Ids and their bytes by a byte-level BPE file of the tokenizers library; `encode` prepends a space."""

    def __init__(self, content: bytes, pattern: str):
        from tokenizers import Tokenizer as Library

        file, letters = json.loads(content), byte_letters()
        vocab = file["model"]["vocab"]
        spelled = lambda t: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.tokens = [b""] * (max([*vocab.values(), *(t["id"] for t in file["added_tokens"])]) + 1)
        for token, k in vocab.items():
            self.tokens[k] = spelled(token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in file["model"]["merges"]]
        made = [vocab["".join(m)] for m in merges]
        pre = file["pre_tokenizer"] or {}
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not file["normalizer"] and file["model"]["type"] == "BPE"
        usual = usual and not any(file["model"].get(k) for k in ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "dropout"))
        usual = usual and made == sorted(set(made)) and all(c in vocab for c in letters)
        self.own = self.library = None
        if usual:
            self.own = Tokenizer({bytes([b]): vocab[c] for c, b in letters.items()} | {self.tokens[k]: k for k in made}, pattern)
            # only listed pairs merge, not every pair that spells a token
            listed = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.uint64)
            self.own.pairs.ranks[~np.isin(self.own.pairs.keys, listed)] = 2**31 - 1
        else:
            self.library = Library.from_str(content.decode())
            self.library.encode_special_tokens = True

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's begin (with the end of the last)."""
        if self.own:
            ids, cut = self.own.encode(array)
            return ids.astype(np.int64), cut
        return _flat([e.ids for e in self.library.encode_batch(array.to_pylist(), add_special_tokens=False)])


class PieceSide:
    """Ids and their bytes by a sentencepiece model, which adds the space itself."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_proto=content)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _flat(self.model.encode(array.to_pylist(), num_threads=1))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.fromiter((k for x in lists for k in x), np.int64, cut[-1]), cut


class Spelled:
    """Bytes, sizes and decimals of a side's ids."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start, self.data = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(tokens), np.uint8)
        names = [str(k).encode() for k in range(len(tokens))]
        wide = len(names[-1]) + 1
        self.digits, self.n_digits = np.frombuffer(b"".join(x.ljust(wide) for x in names), np.uint8).reshape(-1, wide), np.array([len(x) for x in names], np.int64)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ragged(self.start[ids], self.size[ids])]


def jumped(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of two sides that cover the same bytes: each token's group's last token of the first side (by its index)."""
    end_a, end_b, n = np.cumsum(size_a), np.cumsum(size_b), len(size_a)
    # the token of the other side that holds a token's last byte is the one that overlaps it farthest to the right
    over_a = np.repeat(np.arange(len(size_b)), size_b)[end_a - 1]
    over_b = np.repeat(np.arange(n), size_a)[end_b - 1]
    after = np.concatenate([np.where(end_b[over_a] > end_a, n + over_a, np.arange(n)), over_b])
    for _ in range(ROUNDS):
        twice = after[after]
        if np.array_equal(twice, after):
            break
        after = twice
    return after[:n], after[n:]


def _aligned(a: ByteLevelSide, b: PieceSide, sa: Spelled, sb: Spelled, array: pa.Array) -> list[tuple]:
    """(n_a, n_b, n_groups, digest, ids of A and B that are linked and how often) of each text, none of which is null or empty."""
    spaced = pc.binary_join_element_wise(pa.scalar("", array.type), array, pa.scalar(" ", array.type))
    data, starts, ends = strings(spaced)
    ids_a, cut_a = a.encode(spaced)
    ids_b, cut_b = b.encode(array)
    whole = np.ones(len(array), bool)
    for ids, cut, s in ((ids_a, cut_a, sa), (ids_b, cut_b, sb)):
        n = np.concatenate([[0], np.cumsum(s.size[ids])])[cut]
        fits = np.diff(n) == ends - starts
        # bytes of the texts whose sizes fit, side by side
        rows = np.flatnonzero(fits)
        joined = s.decoded(ids)[ragged(n[:-1][rows], np.diff(n)[rows])]
        size = (ends - starts)[rows]
        differs = joined != data[ragged(starts[rows], size)]
        bad = np.concatenate([[0], np.cumsum(differs)])[np.concatenate([[0], np.cumsum(size)])]
        fits[rows[np.diff(bad) > 0]] = False
        whole &= fits
    rows = np.flatnonzero(whole)
    n_a, n_b = np.diff(cut_a)[rows], np.diff(cut_b)[rows]
    ids_a, ids_b = ids_a[ragged(cut_a[:-1][rows], n_a)], ids_b[ragged(cut_b[:-1][rows], n_b)]
    out = [(0, 0, 0, "", [], [], [])] * len(array)
    if not len(rows):
        return out
    last_of_a, last_of_b = jumped(sa.size[ids_a], sb.size[ids_b])
    # groups in order, by their last token of the first side
    last_a, group_a = np.unique(last_of_a, return_inverse=True)
    group_b = np.searchsorted(last_a, last_of_b)
    in_a, in_b = np.bincount(group_a, minlength=len(last_a)), np.bincount(group_b, minlength=len(last_a))
    last_b = np.cumsum(in_b) - 1
    edge = np.searchsorted(last_a, np.concatenate([[0], np.cumsum(n_a)]))  # groups before each text
    # the digest's text: of each group A's ids, then B's
    at = np.cumsum(in_a + in_b) - in_a - in_b
    place_a = np.arange(len(ids_a)) + (at - (np.cumsum(in_a) - in_a))[group_a]
    place_b = np.arange(len(ids_b)) + (at + in_a - (np.cumsum(in_b) - in_b))[group_b]
    mark_a, mark_b = np.full(len(ids_a), ord(","), np.uint8), np.full(len(ids_b), ord(","), np.uint8)
    mark_a[last_a], mark_b[last_b] = ord("|"), ord(";")
    wide, total = max(sa.digits.shape[1], sb.digits.shape[1]), len(ids_a) + len(ids_b)
    line, used = np.zeros((total, wide), np.uint8), np.zeros(total, np.int64)
    for s, ids, place, mark in ((sa, ids_a, place_a, mark_a), (sb, ids_b, place_b, mark_b)):
        line[place, : s.digits.shape[1]] = s.digits[ids]
        line[place, s.n_digits[ids]] = mark
        used[place] = s.n_digits[ids] + 1
    text = line[np.arange(wide) < used[:, None]].tobytes()
    byte = np.concatenate([[0], np.cumsum(used)])[np.concatenate([[0], np.cumsum(n_a + n_b)])]
    # distinct linked pairs of each text
    of = np.repeat(np.arange(len(rows)), np.diff(edge))
    key = (of * len(sa.size) + ids_a[last_a]) * len(sb.size) + ids_b[last_b]
    pair, times = np.unique(key, return_counts=True)
    first = np.searchsorted(pair, np.arange(len(rows) + 1) * len(sa.size) * len(sb.size))
    pair %= len(sa.size) * len(sb.size)
    pair_a, pair_b = (pair // len(sb.size)).astype(np.int32), (pair % len(sb.size)).astype(np.int32)
    for k, row in enumerate(rows):
        own = slice(first[k], first[k + 1])
        out[row] = (int(n_a[k]), int(n_b[k]), int(edge[k + 1] - edge[k]), hashlib.sha256(text[byte[k] : byte[k + 1] - 1]).hexdigest(), pair_a[own], pair_b[own], times[own].astype(np.int32))
    return out


def _sides(content_a: bytes, content_b: bytes, pattern: str):
    """Both sides, made once per Python worker."""
    key = (hashlib.sha256(content_a).digest(), hashlib.sha256(content_b).digest(), pattern)
    if key not in _held:
        _held.clear()
        a, b = ByteLevelSide(content_a, pattern), PieceSide(content_b)
        _held[key] = (a, b, Spelled(a.tokens), Spelled(b.tokens))
    return _held[key]


FOUND = "n_a long, n_b long, n_groups long, groups_sha256 string, a array<int>, b array<int>, times array<int>"


def aligned_documents(docs: DataFrame, first: str, second: str, pattern: str) -> DataFrame:
    """(doc_id, row, n_a, n_b, n_groups, groups_sha256, a, b, times): of each row of `docs` (doc_id, text) the numbers of tokens and
    groups, the groups' digest, and the distinct pairs of linked ids with how often each is linked there. Written, so that `row` is
    the same whenever it is read."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((rank_file(spark, first), rank_file(spark, second)))

    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column("text"), BATCH):
                part = batch.slice(low, high - low)
                texts = part.column("text")
                some = np.flatnonzero(np.asarray(pc.greater(pc.binary_length(texts).fill_null(0), 0)))
                rows = [(0, 0, 0, "", [], [], [])] * len(part)
                for k, x in zip(some, _aligned(*_sides(*files.value, pattern), texts.take(pa.array(some))) if len(some) else [], strict=True):
                    rows[k] = x
                columns = list(zip(*rows, strict=True))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in c])]), pa.int32()), pa.array(np.concatenate([np.asarray(x, np.int32) for x in c]), pa.int32())) for c in columns[4:]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string()), *lists], ["doc_id", *[x.split()[0] for x in FOUND.split(", ")]])

    made = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {FOUND}")
    return written(made.withColumn("row", F.monotonically_increasing_id()))


def linked_pairs(aligned: DataFrame) -> DataFrame:
    """(row, a, b, n): a row for each distinct pair of a document."""
    x = aligned.select("row", F.explode(F.arrays_zip("a", "b", "times")).alias("x"))
    return x.select("row", F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.col("x.times").alias("n"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold each pair, and whether none of its B id's pairs has more."""
    n = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    return n.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def alignment_table(docs: DataFrame, first: str, second: str, pattern: str) -> DataFrame:
    """(a, b, count): each B id's A ids that it is linked with most, over the corpus."""
    return pair_counts(linked_pairs(aligned_documents(docs, first, second, pattern))).filter("best").drop("best")


def op12_aligned(docs: DataFrame, first: str, second: str, pattern: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of `docs`, by the tokenizer files `first`
    (byte-level BPE) and `second` (sentencepiece)."""
    aligned = aligned_documents(docs, first, second, pattern)
    pairs = linked_pairs(aligned)
    key = (F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair")
    counts = written(pair_counts(pairs)).select(key, "count", "best")
    met = looked_up(pairs.select("row", key, "n"), counts, ["pair"], F.col("row"), small=FEW)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    told = aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "groups_sha256").join(sums, "row", "left")
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
