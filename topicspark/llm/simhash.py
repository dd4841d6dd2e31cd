"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are one or more words of 64 bits. Every distinct fingerprint is dealt to one group per mask: the top node of the
index, whose members agree on all bits of the mask. Within a group the fingerprints are sorted by Gray rank and cut into leaves;
each node above keeps the bits that all below it share. Two nodes whose shared bits already differ in more places than a link
allows are dropped together, else their children are compared, down to fingerprints, word by word with the differences so far
added up. A group too large for a task is cut into runs of Gray order, whose upper nodes are compared in the same way by joins, a level
a round, and each pair of runs that is left goes to a task of its own. What tasks return are forests, not pairs; their components are joined by min-label rounds over written tables.

Two settings are in use. `EXACT`, that of the query: 64 bits of three-word shingles, three bits apart; fingerprints that close agree
on all but three of the blocks that the masks are made of, so every link is found. `SIMILAR`, that of `without_near_duplicates`:
256 bits of distinct five-word shingles, and links at an estimated similarity of 0.8 or more. The similarity is the cosine of the
shingle sets, which is what SimHash estimates (for sets of one size, a Jaccard index of 0.8 is a cosine of 0.89). Masks are seeded samples of bits, as many
and as long as it takes for a pair of that Jaccard index to agree on one with odds of RECALL.

Edge cases: null, empty and wordless texts have fingerprint zero and link like any other; texts of fewer words than a shingle
are one shingle; equal texts and repeated ids are fine; rows without an id link too, and have the smallest id of their component, or
null if none has one; other columns stay or are left out; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicspark.llm.common import SALTS, looked_up, mixed, slices, span_hashes, strings, words, written

BITS = 64
SHINGLE, SEED = 3, 42
LEAF, FANOUT = 16, 8
#: Fingerprints of a group that one task takes, and that a seeded mask is to leave in one.
RUN, AIM = 8192, 256
#: Odds that a pair of Jaccard index 0.8 agrees on a seeded mask.
RECALL = 0.95

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LOWER_ARRAY = np.frombuffer(_LOWER, np.uint8)
_HASH = xxhash.xxh64_intdigest
# a byte's bits as eight bytes
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass(frozen=True)
class Links:
    """Words of a fingerprint and the most bits in which linked ones differ."""

    words: int
    distance: int

    def masks(self, n: int) -> list[tuple[int, ...]]:
        """Masks of the groups for n fingerprints, a number for each word."""
        if self.words == 1:
            # choices of blocks: one of them is equal in fingerprints within the distance
            blocks = 4 if n < 20_000_000 else 5 if n < 2_000_000_000 else 6
            edge = [round(k * BITS / blocks) for k in range(blocks + 1)]
            return [(sum(((1 << edge[k + 1]) - (1 << edge[k])) for k in chosen),) for chosen in combinations(range(blocks), blocks - self.distance)]
        size = max(4, math.ceil(math.log2(max(2, n) / AIM)))
        agree = (1 - math.acos(2 * 0.8 / 1.8) / math.pi) ** size
        rng, out = np.random.default_rng(17), []
        for _ in range(math.ceil(math.log(1 - RECALL) / math.log(1 - agree))):
            bits = rng.choice(BITS * self.words, size, replace=False).tolist()
            out.append(tuple(sum(1 << b % BITS for b in bits if b // BITS == w) for w in range(self.words)))
        return out


EXACT = Links(1, 3)
#: A cosine of 0.8 is an angle of 36.9 degrees, so that 0.205 of the bits differ.
SIMILAR = Links(4, int(4 * BITS * math.acos(0.8) / math.pi))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a UTF-8 text, A-Z lower-cased."""
    found = _WORD.findall(text.translate(_LOWER))
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        hashes = np.array([_HASH(joined, SEED)], "<u8")
    else:
        end = np.cumsum([len(w) + 1 for w in found])
        start = (end - [len(w) + 1 for w in found])[: len(found) - shingle + 1].tolist()
        hashes = np.array([_HASH(joined[a:b], SEED) for a, b in zip(start, (end[shingle - 1 :] - 1).tolist(), strict=True)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def _fingerprints(array: pa.Array) -> pa.Array:
    out = []
    for a, b in slices(array):
        out += [fingerprint(x) for x in array.slice(a, b - a).cast(pa.binary()).to_pylist()]
    return pa.array(np.array(out, np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, output: str = "fp", text: str = "text") -> DataFrame:
    """`docs` with `output`, the 64-bit fingerprint as a long."""
    return docs.withColumn(output, F.arrow_udf(_fingerprints, "long")(F.coalesce(F.col(text), F.lit(""))))


def shingle_hashes(array: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each distinct word shingle of each text, A-Z lower-cased, and each text's number of them (0 without words)."""
    data, starts, ends = strings(array)
    data = _LOWER_ARRAY[data]
    begin, end, row = words(data, starts, ends)
    h, n = span_hashes(data, begin, end), np.bincount(row, minlength=len(starts))
    with np.errstate(over="ignore"):
        whole = np.zeros(len(h), np.uint64)
        for k in range(shingle):
            # places after a text's last word count as nothing, which only texts shorter than a shingle keep
            inside, m = np.zeros(len(h), np.uint64), max(0, len(h) - k)
            inside[:m] = np.where(row[len(h) - m :] == row[:m], h[len(h) - m :], np.uint64(0))
            whole = whole * np.uint64(0x100000001B3) + inside
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        own = place < np.repeat(np.maximum(n - shingle + 1, 1), n)
        whole, row = mixed(whole[own]), row[own]
        key = mixed(whole + (row + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    first = np.ones(len(key), bool)
    first[order[1:]] = key[order[1:]] != key[order[:-1]]
    return whole[first], np.bincount(row[first], minlength=len(starts))


def wide_fingerprints(array: pa.Array, n_words: int, shingle: int) -> np.ndarray:
    """SimHash of each text as a row of `n_words` words of 64 bits. Bits that half of a text's shingles have are set in every other
    place."""
    out = np.zeros((len(array), n_words), np.uint64)
    for a, b in slices(array, 1 << 19):
        h, n = shingle_hashes(array.slice(a, b - a), shingle)
        if not len(h):
            continue
        # bits are counted in bytes, over pieces of up to 255 shingles of a text
        pieces = -(-n // 255)
        of = np.repeat(np.arange(len(n)), pieces)
        first = np.repeat(np.cumsum(n) - n, pieces) + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        ends = np.append(first[1:], len(h))
        ones = np.zeros((len(n), n_words * BITS), np.int64)
        for p in range(0, len(of), 256):
            own, cut = h[first[p] : ends[min(p + 256, len(of)) - 1]], first[p : p + 256] - first[p]
            with np.errstate(over="ignore"):
                bits = [_SPREAD[mixed(own + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)] for k in range(n_words)]
            np.add.at(ones, of[p : p + 256], np.add.reduceat(np.concatenate(bits, axis=1), cut, axis=0).view(np.uint8))
        alternate = np.arange(ones.shape[1]) % 2 == 1
        some = n > 0
        bits = (2 * ones > n[:, None]) | (2 * ones == n[:, None]) & alternate & some[:, None]
        out[a:b] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    return out


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the reflected Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _levels(fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of the index over Gray-ordered fingerprints, leaves first: (shared-bit mask, pattern, cut points below)."""
    levels = []
    both, either, size = fp, fp, LEAF
    while True:
        cut = np.arange(0, len(both), size)
        both, either = np.bitwise_and.reduceat(both, cut, axis=0), np.bitwise_or.reduceat(either, cut, axis=0)
        levels.append((~(both ^ either), both, np.append(cut, len(fp) if not levels else len(levels[-1][0]))))
        if len(cut) == 1:
            return levels
        size = FANOUT


def _apart(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Bits in which the patterns that nodes i of a and j of b share differ."""
    return np.bitwise_count((a[1][i] ^ b[1][j]) & a[0][i] & b[0][j]).sum(axis=1, dtype=np.int64)


def _near(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs of rows are at most `distance` bits apart; a pair goes at the word at which its differences are over it."""
    left, apart = np.arange(len(i)), np.zeros(len(i), np.int64)
    for w in range(a.shape[1]):
        apart = apart + np.bitwise_count(a[i[left], w] ^ b[j[left], w])
        keep = np.flatnonzero(apart <= distance)
        left, apart = left[keep], apart[keep]
    return left


def _below(cut: np.ndarray, i: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node i's children, with `other` repeated beside them."""
    n = cut[i + 1] - cut[i]
    first = np.repeat(cut[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return first + np.arange(n.sum()), np.repeat(other, n)


def links(a: np.ndarray, b: np.ndarray | None = None, distance: int = EXACT.distance):
    """Index pairs (into a, and into b or else a itself, i < j) at most `distance` bits apart, a bounded lot at a time; inputs in
    Gray order, a row of words to a fingerprint."""
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    la, lb = _levels(a), _levels(b)
    # a stack of node pairs per level keeps what is open at once small
    stack = [(len(la) - 1, len(lb) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        p, q, i, j = stack.pop()
        near = _apart(la[p], i, lb[q], j) <= distance
        if own and p == q:
            near &= i <= j
        i, j = i[near], j[near]
        for at in range(0, len(i), 1 << 11):
            x, y = i[at : at + (1 << 11)], j[at : at + (1 << 11)]
            if p or q:
                np_, nq = p, q
                if p >= q and p:
                    x, y = _below(la[p][2], x, y)
                    np_ = p - 1
                if q >= p and q:
                    y, x = _below(lb[q][2], y, x)
                    nq = q - 1
                stack.append((np_, nq, x, y))
            else:
                x, y = _below(la[0][2], x, y)
                y, x = _below(lb[0][2], y, x)
                if own:
                    x, y = x[x < y], y[x < y]
                near = _near(a, x, b, y, distance)
                if len(near):
                    yield x[near], y[near]


def forest(n: int, pairs) -> np.ndarray:
    """Smallest index reachable from each of n by lots of pairs, by hooking and pointer jumping."""
    root = np.arange(n)
    for x, y in pairs:
        while len(x):
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            open_ = low < high
            if not open_.any():
                break
            x, y = x[open_], y[open_]
            np.minimum.at(root, high[open_], low[open_])
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def _small_groups(fp: np.ndarray, label: np.ndarray, distance: int):
    """Links between rows of equal label, rows sorted by it: each row against the rows just after it."""
    step, at = 1, np.arange(len(fp) - 1)
    while len(at):
        at = at[at + step < len(fp)]
        at = at[label[at] == label[at + step]]
        near = at[_near(fp, at, fp, at + step, distance)]
        if len(near):
            yield near, near + step
        step += 1


def _stars(ids: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    child = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[root[child]]), pa.array(ids[child])], ["a", "b"])


def _linked(kind: Links):
    """Rows (choice, key, id, f0, f1 ...) sorted by choice and key, groups whole: a forest of the links within each group."""

    def run(batches):
        for choice, key, ids, *fp in _whole_groups(batches, kind.words):
            fp = np.stack([x.view(np.uint64) for x in fp], axis=1)
            change = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (choice[1:] != choice[:-1])))
            size = np.diff(np.append(change, len(fp)))
            label = np.repeat(np.arange(len(change)), size)
            small = size[label] <= 64
            if small.any():
                yield _stars(ids[small], forest(int(small.sum()), _small_groups(fp[small], label[small], kind.distance)))
            for a, n in zip(change[size > 64], size[size > 64], strict=True):
                own, at = _ordered(fp[a : a + n])
                yield _stars(ids[a : a + n][at], forest(n, links(own, distance=kind.distance)))

    return run


def _ordered(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in Gray order, and their places before."""
    at = np.lexsort([gray_rank(fp[:, w]) for w in reversed(range(fp.shape[1]))])
    return fp[at], at


def _whole_groups(batches, n_words: int):
    """Arrays (choice, key, id, words) in which no group is cut."""
    names = ("choice", "key", "id", *[f"f{w}" for w in range(n_words)])
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in names)
        last = np.flatnonzero((now[1] != now[1][-1]) | (now[0] != now[0][-1]))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield tuple(np.concatenate(z) for z in zip(*held, tuple(x[:cut] for x in now), strict=True))
            held = [tuple(x[cut:] for x in now)]
        else:
            ended = held and (held[-1][1][-1] != now[1][-1] or held[-1][0][-1] != now[0][-1])
            if ended:
                yield tuple(np.concatenate(z) for z in zip(*held, strict=True))
                held = []
            held.append(now)
    if held:
        yield tuple(np.concatenate(z) for z in zip(*held, strict=True))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_links(prints: DataFrame, kind: Links = EXACT, run: int = RUN) -> DataFrame:
    """(a, b): a forest whose components are those of all links found between the rows of `prints` (id long, f0, f1 ...), one row
    for each distinct fingerprint."""
    names = [f"f{w}" for w in range(kind.words)]

    def key(mask: tuple[int, ...]) -> Column:
        parts = [F.col(n).bitwiseAND(F.lit(_signed(m)).cast("long")) for n, m in zip(names, mask, strict=True) if m]
        return parts[0] if len(names) == 1 else F.xxhash64(*parts)

    dealt = prints.select(F.posexplode(F.array(*[key(m) for m in kind.masks(prints.count())])).alias("choice", "key"), "id", *names)
    size = dealt.groupBy("choice", "key").count()
    large = written(size.filter(F.col("count") > run).drop("count"))
    has_large = bool(large.head(1))
    groups = dealt.join(large, ["choice", "key"], "left_anti") if has_large else dealt
    out = groups.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_linked(kind), "a long, b long")
    return out.union(_large_group_links(dealt.join(large, ["choice", "key"], "left_semi"), kind, run)) if has_large else out


def _kept_pairs(runs: DataFrame, kind: Links, names: list[str]) -> DataFrame:
    """(choice, key, ldepth, lspan, rdepth, rspan): the pairs of `runs` that shared bits don't part, each pair once, from the root of
    each group down: of a pair of nodes that may hold a link, the pairs of their children are looked at next."""
    above = runs.select("choice", "key", "depth", "span", *names).withColumn("at", F.explode(F.sequence(F.lit(0), "depth", F.lit(4))))
    place = F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(span, depth - at)"))
    bits = [f(n).alias(f"{tag}{n}") for n in names for tag, f in (("both", F.bit_and), ("either", F.bit_or))]
    nodes = written(above.withColumn("place", place).groupBy("choice", "key", F.col("at").alias("depth"), F.col("place").alias("span")).agg(F.bool_or(F.col("at") == F.col("depth")).alias("leaf"), *bits))
    # what a node gives way to: its children, or itself where it is a run
    up = F.when(F.col("depth") == 4, F.lit(0).cast("long")).otherwise(F.shiftrightunsigned("span", 4))
    child = nodes.filter("depth > 0").withColumns({"odepth": F.col("depth") - 4, "ospan": up})
    after = written(child.union(nodes.filter("leaf").withColumns({"odepth": F.col("depth"), "ospan": F.col("span")})))
    side = lambda s: after.select("choice", "key", F.col("odepth").alias(f"{s}depth"), F.col("ospan").alias(f"{s}span"), F.struct("depth", "span", "leaf", *[f"{t}{n}" for n in names for t in ("both", "either")]).alias(s))
    mask = lambda s, n: F.bitwise_not(F.col(f"{s}.both{n}").bitwiseXOR(F.col(f"{s}.either{n}")))
    apart = sum((F.bit_count(F.col(f"l.both{n}").bitwiseXOR(F.col(f"r.both{n}")).bitwiseAND(mask("l", n)).bitwiseAND(mask("r", n))) for n in names), F.lit(0))
    same = (F.col("ldepth") == F.col("rdepth")) & (F.col("lspan") == F.col("rspan"))
    ends = ["choice", "key", "ldepth", "lspan", "rdepth", "rspan"]
    root = [F.lit(0).alias("ldepth"), F.lit(0).cast("long").alias("lspan"), F.lit(0).alias("rdepth"), F.lit(0).cast("long").alias("rspan")]
    open_, kept = nodes.select("choice", "key").distinct().select("choice", "key", *root), None
    while True:
        met = open_.join(side("l"), ["choice", "key", "ldepth", "lspan"]).join(side("r"), ["choice", "key", "rdepth", "rspan"])
        met = met.filter((~same | (F.col("l.span") <= F.col("r.span"))) & (apart <= kind.distance))
        met = written(met.select("choice", "key", *[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "lr" for c in ("depth", "span", "leaf")]))
        done, open_ = met.filter("lleaf AND rleaf").select(*ends), met.filter("NOT (lleaf AND rleaf)").select(*ends)
        kept = done if kept is None else kept.union(done)
        if not open_.head(1):
            return kept


def _large_group_links(dealt: DataFrame, kind: Links, run: int) -> DataFrame:
    """Links within groups of over `run` fingerprints: runs of Gray order, and pairs of runs that shared bits don't part."""
    names = [f"f{w}" for w in range(kind.words)]
    rank = F.col("f0")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    ranked = written(dealt.withColumn("rank", rank.bitwiseXOR(F.lit(-(1 << 63)))))
    # leading rank bits cut each group into equal spans of rank; spans are halved until none holds over `run` fingerprints
    runs = None
    todo = ranked.withColumn("depth", F.lit(0)).withColumn("span", F.lit(0).cast("long"))
    depth = 0
    while True:
        count = todo.groupBy("choice", "key", "span").count()
        fits = count.filter((F.col("count") <= run) | F.lit(depth >= BITS)).drop("count")
        done = todo.join(fits, ["choice", "key", "span"], "left_semi")
        runs = done if runs is None else runs.union(done)
        depth += 4
        todo = written(todo.join(fits, ["choice", "key", "span"], "left_anti").withColumn("depth", F.lit(depth)).withColumn("span", F.shiftrightunsigned(F.col("rank").bitwiseXOR(F.lit(-(1 << 63))), BITS - depth)))
        if not todo.head(1):
            break
    runs = written(runs)
    kept = _kept_pairs(runs, kind, names)
    kept = written(kept.withColumn("pair", F.xxhash64("choice", "key", "ldepth", "lspan", "rdepth", "rspan")))
    sides = [kept.select("choice", "key", F.col(f"{s}depth").alias("depth"), F.col(f"{s}span").alias("span"), "pair", F.lit(s == "r").alias("right"), (F.struct("ldepth", "lspan") == F.struct("rdepth", "rspan")).alias("own")) for s in "lr"]
    dealt = runs.select("choice", "key", "depth", "span", "id", *names).join(sides[0].union(sides[1].filter(~F.col("own"))), ["choice", "key", "depth", "span"]).select("pair", "right", "id", *names)

    def pair_links(frame: pa.Table) -> pa.Table:
        fp, right, ids = np.stack([frame[n].to_numpy().view(np.uint64) for n in names], axis=1), frame["right"].to_numpy(zero_copy_only=False), frame["id"].to_numpy()
        (a, i), (b, j) = (_ordered(fp[side]) for side in (~right, right))
        found = ((x, y + (len(a) if len(b) else 0)) for x, y in links(a, b if len(b) else None, kind.distance))
        return pa.Table.from_batches([_stars(np.concatenate([ids[~right][i], ids[right][j]]), forest(len(fp), found))])

    return dealt.groupBy("pair").applyInArrow(pair_links, "a long, b long")


def components(edges: DataFrame, salts: int = SALTS) -> DataFrame:
    """(node, label) for every node of `edges` (a, b): the smallest node reachable.

    Alternates large-star and small-star rounds, each written and read again, until no edge changes; rows never exceed the
    number of edges. A node's smallest neighbour is an aggregate, and goes back to its edges in `salts` parts, so that no task
    gets all edges of a hot node."""

    def smallest(of: DataFrame) -> DataFrame:
        """The edges with `m`, the smallest `v` of their `u`."""
        low = of.groupBy("u").agg(F.min("v").alias("m")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return of.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(low, ["u", "salt"]).drop("salt")

    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    stamp = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head()
    while stamp[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = smallest(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        small = smallest(written(large))
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head()
        if now == stamp:
            break
        stamp = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of `docs` (doc_id, text) by the `EXACT` setting; component_id is the smallest doc_id
    reachable."""
    prints = written(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    each = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    label = components(fingerprint_links(each.select(F.col("fp").alias("id"), F.col("fp").alias("f0"))))
    named = written(each.join(label, each["fp"] == label["node"], "left").select("fp", "first", F.coalesce("label", "fp").alias("label")))
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = written(looked_up(named, lowest, ["label"], F.col("fp")).select("fp", "component_id"))
    return looked_up(prints, by_print, ["fp"], F.col("doc_id")).select("doc_id", "fp", "component_id")


def op7_simhash(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, kind: Links, shingle: int) -> tuple[DataFrame, DataFrame]:
    """`docs` written with `__row` (a number of its own) and `__fp`; and a row for each distinct fingerprint with `__component` (the
    same for all that are linked) and `least`, the first of its rows by doc_id (null last), then the text's hash."""
    names = [f"f{w}" for w in range(kind.words)]

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def prints(array: pa.Array) -> pa.Array:
        fp = wide_fingerprints(array, kind.words, shingle).view(np.int64)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(fp[:, w])) for w in range(kind.words)], names)

    rows = written(docs.withColumns({"__row": F.monotonically_increasing_id(), "__fp": prints(F.coalesce("text", F.lit("")))}))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text"), "__row")
    each = written(rows.groupBy("__fp").agg(F.min("__row").alias("id"), F.min(order).alias("least")))
    label = components(fingerprint_links(each.select("id", *[F.col(f"__fp.{n}").alias(n) for n in names]), kind))
    return rows, written(each.join(label, each["id"] == label["node"], "left").select("__fp", "least", F.coalesce("label", "id").alias("__component")))


def with_components(docs: DataFrame, kind: Links = SIMILAR, shingle: int = 5) -> DataFrame:
    """`docs` (text among its columns) with `__component`, the same for near-duplicate rows, whatever their ids."""
    rows, each = _grouped(docs, kind, shingle)
    return looked_up(rows, each.select("__fp", "__component"), ["__fp"], F.col("__row")).select(*docs.columns, "__component")


def without_near_duplicates(docs: DataFrame, kind: Links = SIMILAR, shingle: int = 5) -> DataFrame:
    """One row of each group of near-duplicate rows of `docs` (doc_id, text among its columns), with its own columns: that of the
    smallest doc_id (null last), of several of that id the one whose text's hash is least."""
    rows, each = _grouped(docs, kind, shingle)
    stays = each.groupBy("__component").agg(F.min("least").alias("least")).select(F.col("least.__row").alias("__row"))
    return rows.join(stays, "__row", "left_semi").select(*docs.columns)
