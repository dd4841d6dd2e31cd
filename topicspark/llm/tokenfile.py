"""Token-ID files: an adaptive context-mixing range coder over blocks of ids.

A block of up to BLOCK ids is coded by itself: its models start empty and its header carries a checksum. The ids last seen after
the same two ids and after the same one id are predicted; counts under two contexts (how well either prediction has done, and
how the last two ids were coded) are added to give the probabilities of "order-2 right", "order-1 right" and "neither". Any other
id is coded by order-0 counts of buckets of neighbouring ids, taken up every REFRESH ids, and its place in the bucket evenly.
Range coding keeps 48 bits and writes 16 at a time. Many blocks are coded side by side as numpy lanes.

A file is a Parquet folder, a row to a block: part and block number, where the block starts in its part, the documents in it
(id, number in the part, ids they have there), and the coded bytes. Parts and blocks follow ascending document ids.

Edge cases: null and empty texts have the end id alone; ids of 65,536 and up are refused; null document ids come first, rows
that repeat an id follow one another; an empty table gives an empty file.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import SEPARATORS, shared_dir, slices, span_hashes, strings
from topicspark.llm.bpe import ragged

#: Ids of a block, and blocks coded side by side at most: what a numpy call costs is shared by all lanes, so many short blocks are
#: coded in half the time of few long ones, at 3 % more bytes.
BLOCK, LANES = 1024, 4096
#: Bytes of text of a part of the file.
PART_BYTES = 1 << 26
TABLE_BITS = 9
#: What a count grows by, and the sum over which counts are halved, looked at every so many ids.
STEP, LIMIT, HALVED_EVERY = 24, 2048, 16
#: Order-0 counts are kept for buckets of neighbouring ids and put to use every REFRESH ids, and after the first few.
LOW_BITS, REFRESH, EARLY = 8, 64, (8, 16, 32)
BUCKETS = 1 << 16 - LOW_BITS
MAGIC = b"TKB3"
_HEAD = struct.Struct("<4sIII")
U = np.uint64
# three counts in one number
_FIELD, _ONES, _HALVED = U((1 << 20) - 1), U(1 << 40 | 1 << 20 | 1), U(0x7FFFF << 40 | 0x7FFFF << 20 | 0x7FFFF)
# an id and how well it did (1 to 3), in one number
_ID, _TRUST = np.uint32(0xFFFF), np.uint32(16)
_ONE, _TWO, _MOST = np.uint32(1), np.uint32(2), np.uint32(3)
# how the last two ids were coded is 3 x the one before + the last: what is left of it after another
_TAIL = np.arange(9) % 3 * 3
_ADDED = np.array([STEP, STEP << 20, STEP << 40], U)
# contexts are hashed by the high bits of 32-bit products
_SPREAD1, _SPREAD2, _PLACE = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(32 - TABLE_BITS)
# a bucket is found by halving
_HALVES = [BUCKETS >> k for k in range(1, BUCKETS.bit_length())]


class _Range:
    """48-bit range coder, one lane a block: encodes to, or decodes from, 16-bit words. Lanes are given as a slice or by index.
    Words of the same place lie next to one another, a lane to a column."""

    def __init__(self, lanes: int, size: int, coded: np.ndarray | None = None):
        self.range = np.full(lanes, (1 << 48) - 1, U)
        self.low, self.lanes, self.at = np.zeros(lanes, U), lanes, np.arange(lanes)
        self.words = np.zeros(size * lanes, np.uint16) if coded is None else coded.reshape(-1)
        self.decoding = coded is not None
        if self.decoding:
            for k in range(3):
                self.low = self.low << U(16) | coded[k].astype(U)
            self.at += 3 * lanes

    def narrow(self, lanes, start: np.ndarray, small: np.ndarray, rounds: int) -> None:
        """Narrows each lane's range to `small` from `start` on; at most `rounds` words follow."""
        own = self.low[lanes]
        if self.decoding:
            self.low[lanes] = own - start
        else:
            own = own + start
            self.low[lanes] = own
            over = np.flatnonzero(own >= U(1 << 48))
            if len(over):
                self._carry(over if isinstance(lanes, slice) else lanes[over])
        self.range[lanes] = small
        due = np.flatnonzero(small < U(1 << 32))
        due = due if isinstance(lanes, slice) else lanes[due]
        for k in range(rounds):
            if not len(due):
                return
            left = self._shift(due)
            if k + 1 < rounds:
                due = due[left < U(1 << 32)]

    def _carry(self, lanes: np.ndarray) -> None:
        self.low[lanes] &= U((1 << 48) - 1)
        at = self.at[lanes] - self.lanes
        while len(at):
            more = self.words[at] + np.uint16(1)
            self.words[at] = more
            at = at[more == 0] - self.lanes

    def _shift(self, lanes: np.ndarray) -> np.ndarray:
        low, at = self.low[lanes], self.at[lanes]
        if self.decoding:
            # a spoilt block may ask for more words than there are; its checksum won't hold
            self.low[lanes] = low << U(16) | self.words.take(at, mode="clip").astype(U)
        else:
            self.words[at] = (low >> U(32)).astype(np.uint16)
            self.low[lanes] = (low & U(0xFFFFFFFF)) << U(16)
        left = self.range[lanes] << U(16)
        self.range[lanes] = left
        self.at[lanes] = at + self.lanes
        return left

    def finish(self) -> None:
        for _ in range(3):
            self._shift(np.arange(self.lanes))


def _coded(sizes: np.ndarray, ids: np.ndarray | None = None, coded: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Runs the models over lanes whose sizes don't increase: encodes `ids` to (words, number of words), or decodes `coded` to
    (ids, sizes). All four have a row to a place and a column to a lane."""
    n, longest = len(sizes), int(sizes.max())
    coder = _Range(n, 3 * longest + 4, coded)
    out = np.zeros((longest, n), np.uint16) if coder.decoding else ids
    slots, row = 1 << TABLE_BITS, BUCKETS + 1
    # what followed a context (16 bits) and how often running it did (2 bits above); 0: nothing yet
    seen2, seen1 = np.zeros(n * slots, np.uint32), np.zeros(n * slots, np.uint32)
    # counts of "order-2 right", "order-1 right", "neither" under two contexts, 20 bits each
    by_trust, by_past = np.full(n * 16, _ONES, U), np.full(n * 9, _ONES, U)
    counts, upto, whole = np.ones((n, BUCKETS), np.int32), np.zeros((n, row), np.int32), np.zeros(n, U)
    last, before, past = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.int64)
    # where the stretches of "order-2 right", "order-1 right" and "neither" begin, and the last ends
    bounds, whole_row = np.zeros((4, n), U), n
    lanes = np.arange(n)
    of_slots, of_trust, of_past = lanes * slots, lanes * 16, lanes * 9
    live = np.searchsorted(-sizes, -np.arange(longest), side="left")
    flat, flat_counts, flat_bounds = upto.reshape(-1), counts.reshape(-1), bounds.reshape(-1)
    for t in range(longest):
        k = int(live[t])
        first = slice(0, k)
        if not t % REFRESH or t in EARLY:
            np.cumsum(counts[:k], axis=1, out=upto[:k, 1:])
            whole[:k] = upto[:k, -1].astype(U) << U(LOW_BITS)
        hashed = last[:k] * _SPREAD1
        s1 = of_slots[:k] + (hashed >> _PLACE)
        s2 = of_slots[:k] + (hashed + before[:k] * _SPREAD2 >> _PLACE)
        v2, v1 = seen2.take(s2), seen1.take(s1)
        g2, g1, c2, c1 = v2 & _ID, v1 & _ID, v2 >> _TRUST, v1 >> _TRUST
        r2, r1 = of_trust[:k] + (c2 << _TWO | c1), of_past[:k] + past[:k]
        t2, t1 = by_trust.take(r2), by_past.take(r1)
        f = t2 + t1
        # sums of the counts so far, again 20 bits each
        sums = f * _ONES
        total = sums >> U(40) & _FIELD
        unit = coder.range[:k] // total
        for row_, part in enumerate((f & _FIELD, sums >> U(20) & _FIELD, total), 1):
            np.multiply(unit, part, out=bounds[row_, :k])
        if coder.decoding:
            low = coder.low[:k]
            wrong2, other = low >= bounds[1, :k], low >= bounds[2, :k]
        else:
            now = out[t, :k].astype(np.uint32)
            wrong2 = (now != g2) | (c2 == 0)
            other = wrong2 & ((now != g1) | (c1 == 0))
        symbol = wrong2.astype(np.int64) + other
        at = symbol * whole_row + lanes[:k]
        start = flat_bounds.take(at)
        coder.narrow(first, start, flat_bounds.take(at + whole_row) - start, 1)
        added = _ADDED.take(symbol)
        t2, t1 = t2 + added, t1 + added
        if not t % HALVED_EVERY:
            full = np.flatnonzero(total > U(LIMIT))
            t2[full] = (t2[full] + _ONES >> U(1)) & _HALVED
            t1[full] = (t1[full] + _ONES >> U(1)) & _HALVED
        by_trust[r2], by_past[r1] = t2, t1
        # other ids: a bucket by order-0 counts, the rest of the bits evenly
        if coder.decoding:
            now = np.where(wrong2, g1, g2)
        rest = np.flatnonzero(other)
        if len(rest):
            total, own = whole[rest], rest * row
            unit = coder.range[rest] // total
            if coder.decoding:
                value = np.minimum(coder.low[rest] // unit, total - U(1)).astype(np.int64)
                wanted, at = (value >> LOW_BITS).astype(np.int32), own.copy()
                for step in _HALVES:
                    at += (flat.take(at + step) <= wanted) * step
                bucket = at - own
            else:
                given = now[rest].astype(np.int64)
                bucket, low = given >> LOW_BITS, given & (1 << LOW_BITS) - 1
                at = own + bucket
            begin = flat.take(at).astype(np.int64)
            width = flat.take(at + 1) - begin
            begin <<= LOW_BITS
            if coder.decoding:
                low = (value - begin) // width
                now[rest] = bucket << LOW_BITS | low
            coder.narrow(rest, unit * (begin + low * width).astype(U), unit * width.astype(U), 2)
            at = rest * BUCKETS + bucket
            flat_counts[at] = flat_counts.take(at) + np.int32(STEP)
        if coder.decoding:
            out[t, :k] = now
        right2, right1 = ~wrong2, (now == g1) & (c1 > 0)
        seen2[s2] = np.minimum(c2 * right2 + _ONE, _MOST) << _TRUST | now
        seen1[s1] = np.minimum(c1 * right1 + _ONE, _MOST) << _TRUST | now
        past[:k] = _TAIL.take(past[:k]) + symbol
        before[:k], last[:k] = last[:k], now
    if coder.decoding:
        return out, sizes
    coder.finish()
    return coder.words.reshape(-1, n), coder.at // n


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded bytes of each non-empty block of ids under 65,536."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    for a in range(0, len(order), LANES):
        some = order[a : a + LANES]
        sizes = np.array([len(blocks[k]) for k in some])
        ids = np.zeros((len(some), sizes[0]), np.uint16)
        for row, k in enumerate(some):
            ids[row, : sizes[row]] = blocks[k]
        coded, n = _coded(sizes, ids=np.ascontiguousarray(ids.T))
        coded = np.ascontiguousarray(coded[: n.max()].T)
        for row, k in enumerate(some):
            out[k] = _HEAD.pack(MAGIC, sizes[row], n[row], zlib.crc32(blocks[k].astype("<u4").tobytes())) + coded[row, : n[row]].astype("<u2").tobytes()
    return out


def decode_blocks(blocks: list[bytes]) -> list[np.ndarray]:
    """Ids of each coded block; ValueError if one's checksum doesn't hold."""
    heads = [_HEAD.unpack_from(x) for x in blocks]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda k: -heads[k][1])
    for a in range(0, len(order), LANES):
        some = order[a : a + LANES]
        sizes = np.array([heads[k][1] for k in some])
        coded = np.zeros((len(some), max(heads[k][2] for k in some) + 4), np.uint16)
        for row, k in enumerate(some):
            coded[row, : heads[k][2]] = np.frombuffer(blocks[k], "<u2", heads[k][2], _HEAD.size)
        ids, _ = _coded(sizes, coded=np.ascontiguousarray(coded.T))
        ids = np.ascontiguousarray(ids.T)
        for row, k in enumerate(some):
            own = ids[row, : sizes[row]].astype("<u4")
            if heads[k][0] != MAGIC or zlib.crc32(own.tobytes()) != heads[k][3]:
                raise ValueError("a block's checksum doesn't hold")
            out[k] = own
    return out


#: Boundaries between an ASCII letter and these end a piece for the tokenizer too (white space is dropped before).
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,!?;:#$%&*()")] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Bytes that special tokens hold.
_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(b"<|>")] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
#: Distinct words that a Python worker remembers, at about 25 bytes each; after that many it starts anew.
REMEMBERED = 2_000_000
_worker: dict = {}


def _letters(tok) -> dict[int, str]:
    """Small Latin letters and what the tokenizer hands to its model for each; empty unless it leaves a run of them whole."""
    every = [chr(x) for x in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))]

    def handed(text: str) -> list[str]:
        text = tok.normalizer.normalize_str(text) if tok.normalizer else text
        return [piece for piece, _ in tok.pre_tokenizer.pre_tokenize_str(text)] if tok.pre_tokenizer else []

    alone = [handed(x) for x in every]
    whole = handed("".join(every))
    return {ord(x): y[0] for x, y in zip(every, alone, strict=True)} if whole == ["".join(chain.from_iterable(alone))] else {}


def _encoded_words(tok, letters: dict[int, str], texts: list[str]) -> list[list[int]]:
    """Ids of each text. A word of small Latin letters alone goes straight to the tokenizer's model, without its rules for
    normalizing and splitting, which would leave it as it is."""
    plain = re.compile(f"[{''.join(map(chr, letters)) or '^'}]+" if letters else "(?!)").fullmatch
    model, out, others = tok.model, [[]] * len(texts), []
    for k, text in enumerate(texts):
        if plain(text):
            out[k] = [x.id for x in model.tokenize(text if text.isascii() else text.translate(letters))]
        else:
            others.append(k)
    for k, x in zip(others, tok.encode_batch_fast([texts[k] for k in others], add_special_tokens=False), strict=True):
        out[k] = x.ids
    return out


def _word_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the pieces of words, cut where the cut is sure to be the tokenizer's; words that may hold a special token
    stay whole."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside, letter, mark = ~SEPARATORS[data], _LETTER[data], _PUNCTUATION[data]
    cut = np.zeros(n + 1, bool)
    cut[1:-1] = letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
    odd = np.flatnonzero(_SPECIAL[data])
    if len(odd):
        # from the last separator or text's start before each, to the first one after it
        edge = np.sort(np.concatenate([np.flatnonzero(~inside), starts, [n]]))
        k = np.searchsorted(edge, odd, side="right")
        cut[ragged(edge[k - 1] + 1, edge[k] - edge[k - 1] - 1)] = False
    cut[starts] = True
    cut[ends] = True
    first, last = inside & cut[:-1], inside & cut[1:]
    first[1:] |= inside[1:] & ~inside[:-1]
    last[:-1] |= inside[:-1] & ~inside[1:]
    first[0], last[-1] = inside[0], inside[-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _tokenized(content: str, array: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each with the end id appended, and each text's number of ids.

    The tokenizer lower-cases, drops white space and merges within words, so distinct words are encoded once (in A-Z lower
    case; words are told apart by 64-bit hashes)."""
    if _worker.get("content") != content:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(content)
        _worker.update(content=content, tok=tok, letters=_letters(tok), known=np.zeros(0, U), flat=np.zeros(0, np.uint16), cut=np.zeros(1, np.int64))
    tok = _worker["tok"]
    data, starts, ends = strings(array)
    begin, end = _word_pieces(data, starts, ends)
    data = _PLAIN[data]
    own = span_hashes(data, begin, end)
    # places in the low bits go along when the high bits of the hashes are sorted
    low = U((1 << max(1, len(own)).bit_length()) - 1)
    order = (np.sort(own & ~low | np.arange(len(own), dtype=U)) & low).astype(np.int64)
    ranked = own[order]
    new = np.ones(len(own), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    h, at, inverse = ranked[new], order[new], np.empty(len(own), np.int64)
    inverse[order] = np.cumsum(new) - 1
    known = _worker["known"]
    if len(known) + len(h) > REMEMBERED:
        known = np.zeros(0, U)
        _worker.update(known=known, flat=np.zeros(0, np.uint16), cut=np.zeros(1, np.int64))
    place = np.searchsorted(known, h)
    new = np.flatnonzero(known[np.minimum(place, len(known) - 1)] != h if len(known) else np.ones(len(h), bool))
    if len(new):
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8") for a, b in zip(begin[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
        found = _encoded_words(tok, _worker["letters"], texts)
        size = np.concatenate([np.diff(_worker["cut"]), [len(x) for x in found]]).astype(np.int64)
        made = np.fromiter(chain.from_iterable(found), np.int64)
        if len(made) and made.max() > 0xFFFF:
            raise ValueError("ids of 65,536 and up can't be written")
        flat = np.concatenate([_worker["flat"], made.astype(np.uint16)])
        every = np.concatenate([known, h[new]])
        order = np.argsort(every, kind="stable")
        start = np.cumsum(size) - size
        _worker.update(known=every[order], flat=flat[ragged(start[order], size[order])], cut=np.concatenate([[0], np.cumsum(size[order])]))
    start, size = _worker["cut"][:-1], np.diff(_worker["cut"])
    of = np.searchsorted(_worker["known"], h)[inverse]
    n = size[of]
    upto, cut = np.concatenate([[0], np.cumsum(n)]), np.searchsorted(begin, np.append(starts, len(data)))
    per_text = upto[cut[1:]] - upto[cut[:-1]]
    out = np.full(per_text.sum() + len(starts), end_id, np.uint16)
    upto = np.cumsum(per_text + 1)
    body = np.ones(len(out), bool)
    body[upto - 1] = False
    out[body] = _worker["flat"][ragged(start[of], n)]
    return out, per_text + 1


FILE = "part int, block int, start long, docs array<struct<doc_id: long, seq: long, n: int>>, data binary"


def write_token_file(docs: DataFrame, content: str, end_id: int, path: str, parts: int | None = None) -> None:
    """Write the ids of `docs` (doc_id, text), tokenized by the tokenizer of the JSON `content`, to the folder `path`, in parts of about
    PART_BYTES of text at most."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(content)

    def encode(batches):
        part, block, start, seq = TaskContext.get().partitionId(), 0, 0, 0
        ids, who = np.zeros(0, np.uint16), []  # not yet in a block: ids, and (doc_id, seq, n)

        def blocks(last: bool):
            nonlocal ids, who, block, start
            while len(ids) >= BLOCK * LANES or last and len(ids):
                made, whos = [], []
                for _ in range(LANES):
                    if len(ids) < BLOCK and not last or not len(ids):
                        break
                    own, ids, room, inside = ids[:BLOCK], ids[BLOCK:], len(ids[:BLOCK]), []
                    k = 0
                    while room:
                        doc, s, n = who[k]
                        take = min(n, room)
                        inside.append({"doc_id": doc, "seq": s, "n": take})
                        room -= take
                        if take < n:
                            who[k] = (doc, s, n - take)
                        else:
                            k += 1
                    who = who[k:]
                    made.append(own)
                    whos.append(inside)
                sizes = np.array([len(x) for x in made])
                at = start + np.cumsum(sizes) - sizes
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(made), part, np.int32)), pa.array(np.arange(block, block + len(made), dtype=np.int32)), pa.array(at), pa.array(whos, pa.list_(pa.struct([("doc_id", pa.int64()), ("seq", pa.int64()), ("n", pa.int32())]))), pa.array(encode_blocks(made), pa.binary())], ["part", "block", "start", "docs", "data"])
                block, start = block + len(made), start + int(sizes.sum())

        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 22):
                got, n = _tokenized(held.value, batch.column("text").slice(a, b - a), end_id)
                ids = np.concatenate([ids, got])
                who += [(d, seq + k, x) for k, (d, x) in enumerate(zip(batch.column("doc_id").slice(a, b - a).to_pylist(), n.tolist(), strict=True))]
                seq += b - a
                yield from blocks(False)
        yield from blocks(True)

    if parts is None:
        size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // PART_BYTES)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, FILE).write.parquet(path)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials mod the CRC-32 polynomial, bits reflected."""
    out = np.zeros_like(a)
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(0xEDB88320), b >> np.uint32(1))
    return out


def crc32_shifts(size: np.ndarray) -> np.ndarray:
    """What a crc32 is multiplied by when so many bytes follow."""
    distinct, place = np.unique(size, return_inverse=True)
    power, bits, shift = np.full(len(distinct), 1 << 23, np.uint32), distinct.astype(np.int64), np.full(len(distinct), 1 << 31, np.uint32)
    while (bits > 0).any():
        shift = np.where(bits & 1, _times(shift, power), shift)
        power, bits = _times(power, power), bits >> 1
    return shift[place]


def joined_crc32(crc: np.ndarray, size: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """crc32 of the byte strings cut[k]:cut[k + 1] put together, from each one's crc32 and size in bytes; none is empty of strings."""
    shift, n, out = crc32_shifts(size), np.diff(cut), crc[cut[:-1]]
    more = np.arange(len(n))
    for k in range(1, int(n.max(initial=1))):
        more = more[n[more] > k]
        at = cut[more] + k
        out[more] = _times(shift[at], out[more]) ^ crc[at]
    return out


def read_token_file(spark, path: str) -> DataFrame:
    """(part, seq, doc_id, start, n, crc) of the stretch that each document has in each block; start counts within the part."""

    def decode(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, LANES):
                batch = whole.slice(a, LANES)
                ids = decode_blocks(batch.column("data").to_pylist())
                out = {k: [] for k in ("part", "seq", "doc_id", "start", "n", "crc")}
                for part, start, docs, own in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), batch.column("docs").to_pylist(), ids, strict=True):
                    raw, at = own.tobytes(), 0
                    for d in docs:
                        for k, v in zip(out, (part, d["seq"], d["doc_id"], start + at, d["n"], zlib.crc32(raw[4 * at : 4 * (at + d["n"])])), strict=True):
                            out[k].append(v)
                        at += d["n"]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "part" else pa.int64()) for k, v in out.items()], list(out))

    return spark.read.schema(FILE).parquet(path).mapInArrow(decode, "part int, seq long, doc_id long, start long, n long, crc long")


def documents_in(spark, path: str) -> DataFrame:
    """doc_id, start (ids before it in the file), n_tokens and ids_crc32 of each document of a token file."""

    @F.arrow_udf("long")
    def whole_crc(array: pa.Array) -> pa.Array:
        flat, cut = array.flatten(), np.concatenate([[0], np.cumsum([len(x) for x in array])]).astype(np.int64)
        return pa.array(joined_crc32(flat.field("crc").to_numpy().astype(np.uint32), 4 * flat.field("n").to_numpy(), cut).astype(np.int64))

    pieces = F.array_sort(F.collect_list(F.struct("start", "n", "crc")))
    each = read_token_file(spark, path).groupBy("part", "seq").agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("own"), F.sum("n").alias("n_tokens"), pieces.alias("pieces"))
    # one row per part of the file
    sizes = spark.read.schema(FILE).parquet(path).groupBy("part").agg(F.sum(F.aggregate("docs", F.lit(0).cast("long"), lambda a, x: a + x["n"])).alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size"))
    return each.join(before, "part").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", whole_crc("pieces").alias("ids_crc32"))


def op9_tokenfile(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    path = shared_dir(docs.sparkSession)
    write_token_file(docs.select("doc_id", "text"), content, end_id, path)
    return documents_in(docs.sparkSession, path)
