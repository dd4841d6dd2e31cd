"""Byte-level BPE encoding and decoding in padded numpy matrices.

A batch of texts is cut before each space that begins a word, which no match of the tokenizer's pattern crosses. The distinct
chunks are split by the pattern, and their distinct pieces are bucketed by length into padded matrices of byte ids. Each round,
every row merges its leftmost pair of minimum rank: pairs are looked up in an open-addressing hash table, the merged column is
compacted away, and rows without a pair left leave the matrix. Equal chunks and pieces are found by 64-bit hashes; as every
batch is decoded again and compared with its bytes, a collision can't pass unseen. A piece of over LONG bytes, whose row each round
would move, takes the same merges in the same order from a heap.

Edge cases: null and empty texts have no ids; text and pieces of any length are encoded whole; rows that repeat an id are encoded
row by row; other columns are left alone or out; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import slices, span_hashes, strings

#: Numbers in a matrix, and bytes of text encoded at once, at most (a longer text is encoded alone).
CELLS, TEXT_BYTES = 1 << 20, 1 << 22
#: Bytes of a piece from which it isn't a row of a matrix.
LONG = 2048
NONE = np.int32(2**31 - 1)

#: Bytes that, after a space, surely begin no white space: printable ASCII, and lead bytes whose characters include none.
_BEGINS = np.zeros(256, bool)
_BEGINS[33:127] = True
_BEGINS[0xC3:0xF5] = True
_BEGINS[[0xE1, 0xE2, 0xE3]] = False


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of the ranges of the given starts and sizes, one after another."""
    before = np.cumsum(sizes) - sizes
    return np.repeat((starts - before).astype(np.int32), sizes) + np.arange(sizes.sum(), dtype=np.int32)


class PairTable:
    """Open-addressing hash from a pair of ids to the rank of their merge; NONE where they don't merge."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        key = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        self.bits = max(4, (4 * len(key)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        rank, slot, self.probes = np.array(rank, np.int32), self._slot(key), 1
        while len(key):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            put = first[free[first]]
            self.keys[slot[put]], self.ranks[slot[put]] = key[put], rank[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, rank, slot = key[rest], rank[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += len(key) > 0

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ids under 0 pair with nothing."""
        out = np.full(a.shape, NONE, np.int32)
        at = np.flatnonzero(((a >= 0) & (b >= 0)).ravel())
        key = a.ravel()[at].astype(np.uint64) << np.uint64(32) | b.ravel()[at].astype(np.uint64)
        slot, flat = self._slot(key), out.ravel()
        for _ in range(self.probes):
            held = self.keys[slot]
            same = held == key
            flat[at[same]] = self.ranks[slot[same]]
            open_ = ~same & (held != np.uint64(2**64 - 1))
            if not open_.any():
                break
            at, key, slot = at[open_], key[open_], (slot[open_] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(a.shape)


class Tokenizer:
    """Encoder and decoder of a rank file (base64 token and rank a line) and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.single = np.full(256, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
        self.pairs, self.joined = PairTable(ranks), {}
        token_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            token_of[rank] = token
        self.token_size = np.array([len(t) for t in token_of], np.int64)
        self.token_start, self.token_bytes = np.cumsum(self.token_size) - self.token_size, np.frombuffer(b"".join(token_of), np.uint8)

    @classmethod
    def from_lines(cls, lines: bytes, pattern: str) -> Tokenizer:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}, pattern)

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each non-empty piece of `data`: flat, and each piece's number of ids."""
        order = np.argsort(sizes, kind="stable")
        ranked, first = sizes[order], 0
        long = order[np.searchsorted(ranked, LONG, side="right") :]
        made = [(np.array([k]), self._merged_long(data[starts[k] : starts[k] + sizes[k]])[None]) for k in long]
        order = order[: len(order) - len(long)]
        # buckets: lengths up to the next power of two, in matrices of bounded size
        while first < len(order):
            width = max(4, 1 << int(ranked[first] - 1).bit_length())
            last = min(int(np.searchsorted(ranked, width, side="right")), first + max(1, CELLS // width))
            made += self._merged(data, starts, sizes, order[first:last])
            first = last
        n = np.zeros(len(sizes), np.int64)
        for rows, ids in made:
            n[rows] = (ids >= 0).sum(axis=1)
        start, flat = np.cumsum(n) - n, np.empty(n.sum(), np.int32)
        for rows, ids in made:
            flat[ragged(start[rows], n[rows])] = ids[ids >= 0]
        return flat, n

    def _merged(self, data, starts, sizes, rows) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids padded with -1) in the order in which rows end."""
        width, made = int(sizes[rows].max()), []
        ids = np.full((len(rows), width), -1, np.int32)
        ids[np.arange(width) < sizes[rows][:, None]] = self.single[data[ragged(starts[rows], sizes[rows])]]
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            line = np.arange(len(rows))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[line, at] if ranks.shape[1] else np.full(len(rows), NONE)
            ended = best == NONE
            if ended.any():
                made.append((rows[ended], ids[ended]))
                going = ~ended
                rows, ids, ranks, at, best = rows[going], ids[going], ranks[going], at[going], best[going]
                line = line[: len(rows)]
                if not len(rows):
                    break
            # compaction: each row lost one id, so each loses the column after its merge
            ids[line, at] = best
            keep = np.ones(ids.shape, bool)
            keep[line, at + 1] = False
            ids, ranks = ids[keep].reshape(len(rows), -1), ranks[keep[:, 1:]].reshape(len(rows), -1)
            n = ids.shape[1]
            if n > 1:
                for col in (at - 1, at):
                    ok = (col >= 0) & (col < n - 1)
                    ranks[line[ok], col[ok]] = self.pairs(ids[line[ok], col[ok]], ids[line[ok], col[ok] + 1])
            used = int((ids >= 0).sum(axis=1).max())
            if used < n:
                ids, ranks = ids[:, :used], ranks[:, : max(0, used - 1)]
        return made

    def _merged_long(self, piece: np.ndarray) -> np.ndarray:
        """Ids of one piece: the leftmost pair of minimum rank is next in a heap of (rank, place)."""
        if not self.joined:
            held = np.flatnonzero(self.pairs.ranks != NONE)
            self.joined = dict(zip(self.pairs.keys[held].tolist(), self.pairs.ranks[held].tolist(), strict=True))
        row = self.single[piece]
        first = self.pairs(row[:-1], row[1:])
        ids, n, none = row.tolist(), len(row), int(NONE)
        before, after, rank = list(range(-1, n - 1)), list(range(1, n + 1)), [*first.tolist(), none]
        heap = [(r, k) for k, r in enumerate(rank) if r != none]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if rank[k] != r:
                continue
            gone = after[k]
            ids[k], ids[gone], rank[gone] = r, -1, none
            after[k] = right = after[gone]
            if right < n:
                before[right] = k
            for at, other in ((before[k], k), (k, right)):
                if at >= 0:
                    rank[at] = new = self.joined.get(ids[at] << 32 | ids[other], none) if other < n else none
                    if new != none:
                        heapq.heappush(heap, (new, at))
        return np.array([x for x in ids if x >= 0], np.int32)

    def _pieces(self, text: str) -> list[int]:
        return list(map(len, self.pattern.findall(text)))

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow string array, one after another, and where each text's begin (with the end of the last)."""
        data, starts, ends = strings(array)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(starts) + 1, np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 32)[: len(data) - 1] & _BEGINS[data[1:]]
        cut[starts[starts < ends]] = True
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, len(data)))
        # distinct chunks: those that begin with a word's space may lie side by side, others are split alone
        _, first, chunk = np.unique(span_hashes(data, begin, begin + size), return_index=True, return_inverse=True)
        b, n = begin[first], size[first]
        word = (data[b] == 32) & (n > 1) & _BEGINS[data[np.minimum(b + 1, len(data) - 1)]]
        order = np.argsort(~word, kind="stable")
        b, n, side = b[order], n[order], int(word.sum())
        chunk = np.argsort(order, kind="stable")[chunk]
        text = data[ragged(b, n)]
        total = np.concatenate([[0], np.cumsum(n)])
        lengths = self._pieces(text[: total[side]].tobytes().decode("utf-8"))
        for k in range(side, len(n)):
            lengths += self._pieces(text[total[k] : total[k + 1]].tobytes().decode("utf-8"))
        chars = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))
        edge = chars[np.concatenate([[0], np.cumsum(lengths)])]
        # distinct pieces
        start, width = edge[:-1], np.diff(edge)
        _, one, piece = np.unique(span_hashes(text, start, edge[1:]), return_index=True, return_inverse=True)
        flat, m = self.encode_pieces(text, start[one], width[one])
        # from texts to chunks to pieces to ids
        at = np.searchsorted(start, np.append(total[:-1], len(text)))
        held = np.diff(at)
        of = piece[ragged(at[:-1][chunk], held[chunk])]
        ids = flat[ragged((np.cumsum(m) - m)[of], m[of])]
        per_chunk = np.concatenate([[0], np.cumsum(m[piece])])
        per_chunk = (per_chunk[at[1:]] - per_chunk[at[:-1]])[chunk]
        upto = np.concatenate([[0], np.cumsum(per_chunk)])
        bounds = upto[np.searchsorted(begin, np.append(starts, len(data)))]
        if not np.array_equal(self.decode(ids), data):
            raise ValueError("encoded texts don't decode to their bytes")
        return ids, bounds

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids, as an array."""
        return self.token_bytes[ragged(self.token_start[ids], self.token_size[ids])]


def _digests(tok: Tokenizer, array: pa.Array) -> tuple[list, list, list]:
    """n_tokens, ids_sha256 and decoded_sha256 of each text."""
    wide = len(str(len(tok.token_size))) + 1
    names = [f"{k} ".encode() for k in range(len(tok.token_size))]
    spelled, spelled_size = np.frombuffer(b"".join(x.ljust(wide) for x in names), np.uint8).reshape(-1, wide), np.array([len(x) for x in names])
    counts, of_ids, of_bytes = [], [], []
    for a, b in slices(array, TEXT_BYTES):
        ids, cut = tok.encode(array.slice(a, b - a))
        line = spelled[ids][np.arange(wide) < spelled_size[ids][:, None]].tobytes()
        raw = tok.decode(ids).tobytes()
        at, byte = np.concatenate([[0], np.cumsum(spelled_size[ids])])[cut].tolist(), np.concatenate([[0], np.cumsum(tok.token_size[ids])])[cut].tolist()
        counts += np.diff(cut).tolist()
        of_ids += [hashlib.sha256(line[x : max(x, y - 1)]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
        of_bytes += [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(byte[:-1], byte[1:], strict=True)]
    return counts, of_ids, of_bytes


def rank_file(spark, path: str) -> bytes:
    """The lines of a rank file, read once by the driver: by its own file system, else through Spark."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return bytes(spark.read.format("binaryFile").load(path).head()["content"])


def _udf(docs: DataFrame, path: str, pattern: str, schema: str, arrays):
    """Column function text -> struct of `schema`, of the arrays that `arrays` makes with a tokenizer built once per task."""
    held = docs.sparkSession.sparkContext.broadcast((rank_file(docs.sparkSession, path), pattern))
    made: dict = {}

    def run(array: pa.Array) -> pa.Array:
        if "tok" not in made:
            made["tok"] = Tokenizer.from_lines(*held.value)
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.StructArray.from_arrays(arrays(made["tok"], array), names)

    return F.arrow_udf(run, schema)(F.coalesce("text", F.lit("")))


def encoded_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`docs` with n_tokens, ids_sha256 and decoded_sha256 of the whole text."""

    def arrays(tok, array):
        n, ids, raw = _digests(tok, array)
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())]

    made = _udf(docs, path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", arrays)
    return docs.withColumn("__bpe", made).select(*docs.columns, "__bpe.*")


def encoded_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """`docs` with `ids`, the ids of the whole text, and `decoded`, the bytes they stand for."""

    def arrays(tok, array):
        parts = [tok.encode(array.slice(a, b - a)) for a, b in slices(array, TEXT_BYTES)]
        flat = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
        cut = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))]) if parts else np.zeros(1, np.int64)
        byte = np.concatenate([[0], np.cumsum(tok.token_size[flat])])[cut]
        raw = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(byte.astype(np.int32).tobytes()), pa.py_buffer(tok.decode(flat).tobytes())])
        return [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat)), raw]

    made = _udf(docs, path, pattern, "ids array<int>, decoded binary", arrays)
    return docs.withColumn("__bpe", made).select(*docs.columns, "__bpe.*")


def op8_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return encoded_documents(docs.select("doc_id", "text"), path, pattern).drop("text")
