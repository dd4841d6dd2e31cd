"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a balanced k-means on a bounded sample. Every distinct vector is posted to its nearest centroid and, near a
boundary, to a few others that are not shadowed by those already chosen. A query walks a graph of the centroids best-first and
probes the lists whose distance is within a ratio of the nearest one's. The ratio is set on the sample so that the true
neighbours of sample queries lie in probed lists. Lists are packed into shards of bounded size, a longer list being cut over
several; each shard's vectors are held by one task while the queries that probe it stream past.

Nearness is the largest inner product. Vectors are lifted to a common norm by one more coordinate, so that the nearest lifted
vectors are those of largest inner product. The index works on vectors divided by their largest component, so that squares of
huge ones don't overflow; scores are those of the original vectors.

Equal vectors are indexed once with their k + 1 smallest ids, which is all that any top-k can hold. Edge cases: null, zero
or non-finite vectors, and those of another length than the commonest one, take no part; a repeated id counts with its
smallest vector; of equal scores the smaller id is nearer, whether the vectors are equal or not; fewer candidates than k give
fewer rows; an inner product over the largest double is infinite; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.llm.common import written

K = 20
#: Numbers (vectors times length) that the sample holds at most, list length aimed at, most lists, most copies of a vector.
SAMPLE_NUMBERS, LIST_LENGTH, MOST_LISTS, COPIES = 1_500_000, 128, 1024, 3
#: Distance to another list against that to the nearest within which a vector is posted there too.
BOUNDARY = 1.1
#: Share of sample neighbours that the probed lists must hold.
COVER = 0.97
#: Centroids beside one in the graph, steps that a walk takes at least (so that it isn't held up where all beside are farther), and
#: vectors of a shard.
DEGREE, WALK, SHARD = 16, 24, 8192
#: Pairs scored at once.
PAIRS = 1 << 15


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0))


def balanced_centroids(x: np.ndarray, n: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means in which full lists cost more, so that lists come out of like length."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), n, replace=False)].copy()
    price = np.zeros(n)
    for _ in range(rounds):
        near = np.concatenate([(distances(x[a : a + 2048], c) + price).argmin(1) for a in range(0, len(x), 2048)])
        size = np.bincount(near, minlength=n)
        price += 0.02 * np.sqrt((x * x).sum(1).mean()) * (size * n / len(x) - 1).clip(-1, 1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), n)])
        # means of points of a sphere lie inside it, nearer to one another than to any point: back onto it, or every second list of a
        # vector would count as shadowed by its first
        c *= np.sqrt((x * x).sum(1).mean()) / np.maximum(np.sqrt((c * c).sum(1)), 1e-12)[:, None]
    return c


@dataclass
class ListIndex:
    """Centroids, their neighbour graph, the lifting norm and the ratio that prunes lists."""

    centroids: np.ndarray
    graph: np.ndarray
    norm: float
    ratio: float = 1.0

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Stored vectors on the sphere of the largest norm."""
        return np.hstack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))[:, None]])

    def aimed(self, q: np.ndarray) -> np.ndarray:
        """Queries on the same sphere."""
        return np.hstack([q * (self.norm / np.sqrt((q * q).sum(1)))[:, None], np.zeros((len(q), 1))])

    def posted(self, x: np.ndarray) -> np.ndarray:
        """Lists of each stored vector, nearest first, padded with -1."""
        c, most = self.centroids, min(COPIES, len(self.centroids))
        out = np.full((len(x), most), -1, np.int64)
        for a in range(0, len(x), 2048):
            d = distances(self.lifted(x[a : a + 2048]), c)
            near = np.argpartition(d, most - 1, axis=1)[:, :most]
            near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
            dist = np.take_along_axis(d, near, 1)
            kept = dist <= BOUNDARY * dist[:, :1]
            for j in range(1, most):
                for i in range(j):
                    between = np.sqrt(((c[near[:, i]] - c[near[:, j]]) ** 2).sum(1))
                    kept[:, j] &= ~kept[:, i] | (between > dist[:, j])
            out[a : a + 2048] = np.where(kept, near, -1)
        return out

    def probed(self, q: np.ndarray) -> np.ndarray:
        """Which lists each query probes: a best-first walk of the centroid graph, all queries in step, that goes on for WALK steps,
        and then while the nearest open centroid is within the ratio of the nearest seen."""
        x, c = self.aimed(q), self.centroids
        n = len(c)
        dist = np.full((len(x), n), np.inf)
        # entry points spread over the centroids
        entry = np.arange(0, n, max(1, n // 32))
        dist[:, entry] = distances(x, c[entry])
        open_ = np.isfinite(dist)
        going, steps = np.arange(len(x)), 0
        while len(going):
            d = np.where(open_[going], dist[going], np.inf)
            best = d.argmin(1)
            near = d[np.arange(len(going)), best]
            on = near <= (np.inf if steps < WALK else self.ratio * dist[going].min(1))
            on &= np.isfinite(near)
            going, best, steps = going[on], best[on], steps + 1
            if not len(going):
                break
            open_[going, best] = False
            beside = self.graph[best]
            new = np.isinf(dist[going[:, None], beside])
            r, k = np.nonzero(new)
            at = (going[r], beside[r, k])
            dist[at] = np.sqrt(((x[at[0]] - c[at[1]]) ** 2).sum(1))
            open_[at] = True
        return dist <= self.ratio * dist.min(1, keepdims=True)


def fit_index(sample: np.ndarray, norm: float, count: int) -> ListIndex:
    """Index for `count` vectors from a sample; the ratio covers COVER of the sample's own neighbours."""
    lists = int(np.clip(count // LIST_LENGTH, 1, min(MOST_LISTS, max(1, len(sample) // 8))))
    index = ListIndex(np.zeros((1, 1)), np.zeros((1, 1), np.int64), norm)
    index.centroids = balanced_centroids(index.lifted(sample), lists)
    d = distances(index.centroids, index.centroids)
    ring = (np.arange(lists)[:, None] + np.array([1, -1])) % lists
    index.graph = np.hstack([np.argsort(d, axis=1, kind="stable")[:, 1 : DEGREE + 1], ring])
    rng = np.random.default_rng(5)
    asked = rng.choice(len(sample), min(400, len(sample)), replace=False)
    lists_of = index.posted(sample)
    need = []
    for a in range(0, len(asked), 64):
        q = sample[asked[a : a + 64]]
        score = q @ sample.T
        score[np.arange(len(q)), asked[a : a + 64]] = -np.inf
        k = min(K, len(sample) - 1)
        if k < 1:
            break
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        d = distances(index.aimed(q), index.centroids)
        own = np.where(lists_of[top] >= 0, np.take_along_axis(d, np.maximum(lists_of[top], 0).reshape(len(q), -1), 1).reshape(len(q), k, -1), np.inf).min(2)
        need.append((own / np.maximum(d.min(1), 1e-12)[:, None]).ravel())
    index.ratio = max(1.0, float(np.quantile(np.concatenate(need), COVER)) * (1 + 1e-9)) if need else 1.0
    return index


def _shards(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each list: short lists share one, a long one has several."""
    first, pieces, shard, room = np.zeros(len(lengths), np.int64), np.ones(len(lengths), np.int64), 0, SHARD
    for k, n in enumerate(lengths):
        if n > SHARD:
            pieces[k] = -(-n // SHARD)
            first[k] = shard + (room < SHARD)
            shard, room = first[k] + pieces[k], SHARD
        else:
            if n > room:
                shard, room = shard + 1, SHARD
            first[k], room = shard, room - n
    return first, pieces


def _top(postings: list[tuple], ids: np.ndarray, q: np.ndarray, lists: pa.Array, k: int):
    """(query, vec_id, score) of each query's best stored vectors in one shard."""
    rid, x, members, list_at, list_id = postings
    cut, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    known = np.unique(list_id)
    probes = np.zeros((len(ids), len(known)), bool)
    row = np.repeat(np.arange(len(ids)), np.diff(cut))
    at = np.searchsorted(known, flat[cut[0] : cut[-1]])
    ok = at < len(known)
    ok[ok] = known[at[ok]] == flat[cut[0] : cut[-1]][ok]
    probes[row[ok], at[ok]] = True
    posted = np.logical_or.reduceat(probes[:, np.searchsorted(known, list_id)], list_at[:-1], axis=1)
    with np.errstate(over="ignore", invalid="ignore"):
        score = q @ x.T
        score = np.where(posted & ~np.isnan(score), score, -np.inf)
        # everything that rounding can't tell from the last one wanted, so that ties are settled below
        most = min(k + 1, score.shape[1])
        last = -np.partition(-score, most - 1, axis=1)[:, most - 1 : most]
        room = 8 * x.shape[1] * np.finfo(float).eps * np.sqrt((q * q).sum(1) * (x * x).sum(1).max())[:, None]
        row, col = np.nonzero((score > -np.inf) & (score >= np.where(np.isfinite(last - room), last - room, last)))
        exact = np.concatenate([np.einsum("ij,ij->i", q[row[a : a + PAIRS]], x[col[a : a + PAIRS]]) for a in range(0, max(1, len(row)), PAIRS)])
    order = np.lexsort((rid[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col, exact = row[place <= k], col[place <= k], exact[place <= k]
    m_cut, m_flat = members
    n = m_cut[col + 1] - m_cut[col]
    at = np.repeat(m_cut[col] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    query, vec, value = np.repeat(ids[row], n), m_flat[at], np.repeat(exact, n)
    other = query != vec
    return pa.RecordBatch.from_arrays([pa.array(query[other]), pa.array(vec[other]), pa.array(value[other])], ["query_id", "vec_id", "score"])


def _searched(k: int):
    """Rows sorted by (shard, kind): each shard's postings (kind 0) are held while its queries (kind 1) pass."""

    def run(batches):
        shard, parts, held = None, [], None
        for batch in batches:
            s, kind = (batch.column(n).to_numpy() for n in ("shard", "kind"))
            cut = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (kind[1:] != kind[:-1]))) if len(s) else []
            for a, b in zip(cut, [*cut[1:], len(s)], strict=True):
                part = batch.slice(a, b - a)
                if s[a] != shard:
                    shard, parts, held = s[a], [], None
                if kind[a] == 0:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if held is None:
                    whole = pa.Table.from_batches(parts).combine_chunks()
                    members, lists = (whole[n].combine_chunks() if whole[n].num_chunks != 1 else whole[n].chunk(0) for n in ("members", "lists"))
                    held = (whole["id"].to_numpy(), _matrix(whole["vec"]), (members.offsets.to_numpy(), members.values.to_numpy()), lists.offsets.to_numpy(), lists.values.to_numpy())
                for at in range(0, part.num_rows, 256):
                    some = part.slice(at, 256)
                    yield _top(held, some["id"].to_numpy(), _matrix(some["vec"]), some["lists"], k)

    return run


def nearest(vectors: DataFrame, queries, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest other rows of `vectors` (vec_id, embedding) found for each row that
    satisfies the column `queries`."""
    spark = vectors.sparkSession
    vec = F.col("embedding").cast("array<double>")
    good = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(vec, lambda x: x != 0)
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(good).select("vec_id", vec.alias("vec"))
    length = usable.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").head()
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return spark.createDataFrame([], schema)
    usable = written(usable.filter(F.size("vec") == length["n"]).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    # of equal vectors the k + 1 smallest ids can be among a query's k nearest; the rest never
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    stored = usable.withColumn("place", rank).filter(F.col("place") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    stored = written(stored.select(F.col("members")[0].alias("id"), "vec", "members"))
    scale = stored.agg(F.max(F.greatest(F.array_max("vec"), -F.array_min("vec")))).head()[0] or 1.0
    squared = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale))
    count, norm = stored.agg(F.count("*"), F.sqrt(F.max(squared))).head()
    sample = stored.orderBy(F.xxhash64("id"), "id").limit(max(256, SAMPLE_NUMBERS // length["n"])).select("vec").toArrow()
    index = spark.sparkContext.broadcast(fit_index(_matrix(sample["vec"]) / scale, norm * (1 + 1e-9), count))

    def post(batches):
        for batch in batches:
            at = index.value.posted(_matrix(batch.column("vec")) / scale)
            n = (at >= 0).sum(1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(at[at >= 0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "lists"])

    posted = written(stored.mapInArrow(post, "id long, vec array<double>, members array<long>, lists array<long>"))
    lengths = np.zeros(len(index.value.centroids), np.int64)
    for row in posted.select(F.explode("lists").alias("l")).groupBy("l").count().collect():
        lengths[row["l"]] = row["count"]
    first, pieces = _shards(lengths)
    held = spark.sparkContext.broadcast((first, pieces))
    schema_in = "shard long, kind int, id long, vec array<double>, members array<long>, lists array<long>"

    def spread(batch, row, at, shard, kind):
        """One row for each (row, shard), with the lists of that row there."""
        order = np.lexsort((at, shard, row))
        row, at, shard = row[order], at[order], shard[order]
        cut = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1]))) if len(row) else np.zeros(0, np.int64)
        own = batch.take(pa.array(row[cut]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(row)), pa.int32()), pa.array(at))
        members = own.column("members") if kind == 0 else pa.array([[]] * len(cut), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(shard[cut]), pa.array(np.full(len(cut), kind, np.int32)), own.column("id"), own.column("vec"), members, lists], ["shard", "kind", "id", "vec", "members", "lists"])

    def stored_rows(batches):
        first, pieces = held.value
        for batch in batches:
            lists = batch.column("lists")
            row, at = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            own = batch.column("id").to_numpy().astype(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            yield spread(batch, row, at, first[at] + own.astype(np.int64) % pieces[at], 0)

    def query_rows(batches):
        first, pieces = held.value
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                row, at = np.nonzero(index.value.probed(_matrix(batch.column("vec")) / scale))
                n = pieces[at]
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield spread(batch, np.repeat(row, n), np.repeat(at, n), np.repeat(first[at], n) + k, 1)

    asked = usable.filter(queries).select(F.col("vec_id").alias("id"), "vec").repartition(spark.sparkContext.defaultParallelism)
    both = posted.mapInArrow(stored_rows, schema_in).union(asked.mapInArrow(query_rows, schema_in))
    tasks = max(1, int((first + pieces).max()))
    found = both.repartition(tasks, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_searched(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings.select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
