"""Density clusters with noise, and plane layouts.

The clusters are the leaves of the condensed tree of a minimum spanning tree over mutual reachability, the larger of two points'
distance and their core distances. The tree is exact. A larger key has first a tree of near rows alone; its rows are put in the order of
its merges, in which the last edge of the path between two rows is the last of the links between their places; and all pairs of blocks of
rows are looked through for edges that come before that, which are few. What Boruvka rounds choose of both is the whole tree. (A key of
still more rows is put together from the trees of all pairs of its blocks.) The tree's edges are
then taken in order of weight, in slices of SLICE edges, so that no task holds more of a key; what is carried from slice to slice is each
point's component, with its size and the cluster it grew from.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicspark.operators.neighbours import CELL, FLAT, TILE, WIDE, Scores, boxed_nearest, boxes, distances, gaps, matrix, nearest
from topicspark.sources.tables import stored

#: Rows of a key whose tree one task makes, rows of a block of a larger key, and edges of a key that one task takes at once.
ALONE, BLOCK, SLICE = 16384, 4096, 1 << 20
#: Edges of a key that one task chooses among.
FEW = 1 << 20
#: Rows of a key that one task puts in the order of its merges (five numbers each), of a block of such a key as long as there are few,
#: blocks at most, and rows of a strip of a block; rows of a part of the first tree that look for another part, and edges that a task holds
#: before it keeps those of their own forest.
ORDERED, RUN, RUNS, STRIP, ASKED, HELD = 1 << 22, 16384, 16, 1024, 256, 1 << 20
#: Columns of a spectral map's block, of which two are shown, passes over the graph between two orthonormal blocks, and blocks at most.
COLUMNS, PASSES, BLOCKS = 4, 8, 40


def reduced(rows: DataFrame, k: int = 5) -> DataFrame:
    """`rows` (id, vec) with vec reduced to k principal components of the unit vectors."""
    v = Normalizer(inputCol="v", outputCol="u").transform(rows.withColumn("v", array_to_vector(F.transform("vec", lambda x: x.cast("double")))))
    model = PCA(k=k, inputCol="u", outputCol="w").fit(v)
    return model.transform(v).withColumn("vec", vector_to_array("w")).drop("v", "u", "w")


def layout(rows: DataFrame) -> DataFrame:
    """(id, x, y): centred principal coordinates scaled to unit length each (left singular vectors); each axis points so that its
    entry of largest size is positive."""
    flat = reduced(rows, 2).select("id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    m = flat.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c = flat.crossJoin(F.broadcast(m)).select("id", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    s = c.agg(*[F.sqrt(F.sum(F.col(a) * F.col(a))).alias(f"n{a}") for a in "xy"], *[F.signum(F.max_by(a, F.struct(F.abs(F.col(a)), F.col("id")))).alias(f"s{a}") for a in "xy"])
    return c.crossJoin(F.broadcast(s)).select("id", *[F.coalesce(F.col(a) * F.col(f"s{a}") / F.nullif(F.col(f"n{a}"), F.lit(0.0)), F.lit(0.0)).alias(a) for a in "xy"])


def plane_map(rows: DataFrame, near: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, x, y) for display: principal coordinates, each point then moved half way to the mean of its nearest neighbours, so often.
    `near` has id and near_id, over the rows of a map. Distances between clusters mean nothing."""
    at = stored(layout(rows))
    for _ in range(rounds):
        mean = near.select("id", "near_id").join(at.select(F.col("id").alias("near_id"), "x", "y"), "near_id").groupBy("id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
        at = stored(at.join(mean, "id", "left").select("id", *[(F.col(a) + F.coalesce(f"m{a}", a)) / 2 for a in "xy"]).toDF("id", "x", "y"))
    return at


def spectral_map(rows: DataFrame, near: DataFrame, tolerance: float = 1e-4, blocks: int = BLOCKS) -> DataFrame:
    """(id, x, y) of `rows` (id): the two smoothest coordinates on the neighbour graph of `near` (id, near_id), taken both ways.

    They are the eigenvectors v of `mean over neighbours of v = c v` with the largest c besides the constant one, of unit length where
    each point weighs as much as it has neighbours, each signed so that its entry of largest size (of ties that of the largest id) is
    positive. Parts of the graph that aren't connected come out as a spot each. Points without a neighbour lie at the origin, and so do all
    where fewer coordinates exist. A block of COLUMNS vectors is filtered by a Chebyshev polynomial of the averaging, each degree a join and
    an aggregate, until both residuals are `tolerance` at most, or `blocks` blocks have been made."""
    ends = near.select("id", "near_id").filter("id <> near_id")
    ends = stored(ends.union(ends.select("near_id", "id")).distinct())
    size = ends.groupBy("id").agg(F.count("*").cast("double").alias("w"))
    # each point is met by itself too, so that a pass reads the block once
    ends = stored(ends.union(size.select("id", F.col("id").alias("near_id"))))
    y, b = [f"y{k}" for k in range(COLUMNS)], [f"b{k}" for k in range(COLUMNS)]
    own = F.col("id") == F.col("near_id")

    def averaged(at: DataFrame, keep: list[str]) -> DataFrame:
        """`at` (id, w, y..., and `keep`) with m..., the means of y over neighbours."""
        # not by broadcast: hundreds of passes would each send the block through the driver
        met = ends.join(at.withColumnRenamed("id", "near_id").hint("shuffle_hash"), "near_id").groupBy("id")
        return met.agg(*[F.max(F.when(own, F.col(n))).alias(n) for n in ["w", *keep]], *[F.avg(F.when(~own, F.col(n))).alias(f"m{n[1:]}") for n in y])

    def combined(names: list[str], matrix_: np.ndarray, shift: np.ndarray, out: list[str]) -> list:
        return [(sum((F.col(n) * float(matrix_[i, j]) for i, n in enumerate(names)), F.lit(0.0)) - float(shift[j])).alias(out[j]) for j in range(matrix_.shape[1])]

    at = size.select("id", "w", *[(F.xxhash64("id", F.lit(k)) / F.lit(2.0**63)).alias(n) for k, n in enumerate(y)])
    m = [f"m{k}" for k in range(COLUMNS)]
    for _ in range(blocks):
        at = stored(averaged(at, y))
        pairs = [(u, v) for u in [*y, *m] for v in [*y, *m]]
        sums = at.agg(F.sum("w"), *[F.sum(F.col("w") * F.col(n)) for n in [*y, *m]], *[F.sum(F.col("w") * F.col(u) * F.col(v)) for u, v in pairs]).head()
        if sums[0] is None:
            break
        mean = np.array(sums[1 : 1 + 2 * COLUMNS]) / sums[0]
        gram = np.array(sums[1 + 2 * COLUMNS :]).reshape(2 * COLUMNS, -1) - sums[0] * np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(gram)[:COLUMNS], 0))
        scale = np.divide(1, scale, out=np.zeros(COLUMNS), where=scale > 0)
        g, e = np.linalg.eigh(scale[:, None] * gram[:COLUMNS, :COLUMNS] * scale)
        t = scale[:, None] * e[:, g > 1e-12 * max(g[-1], 1e-300)] / np.sqrt(g[g > 1e-12 * max(g[-1], 1e-300)])
        h = t.T @ gram[:COLUMNS, COLUMNS:] @ t
        value, r = np.linalg.eigh((h + h.T) / 2)
        value, t = value[::-1], t @ r[:, ::-1]
        off = np.diag(t.T @ gram[COLUMNS:, COLUMNS:] @ t) - 2 * value * np.diag(t.T @ gram[:COLUMNS, COLUMNS:] @ t) + value**2
        # directions that a small graph lacks stay zero
        t, value = np.pad(t, ((0, 0), (0, COLUMNS - t.shape[1]))), np.pad(value, (0, COLUMNS - len(value)), constant_values=-1.0)
        at = at.select("id", "w", *combined(y, t, mean[:COLUMNS] @ t, y), *combined(m, t, mean[COLUMNS:] @ t, m))
        if np.sqrt(np.maximum(off[:2], 0)).max(initial=0.0) <= tolerance:
            break
        # [-1, least value of the block] is damped
        mid, half = (value[-1] - 1) / 2, max((value[-1] + 1) / 2, 0.05)
        at = at.select("id", "w", *[F.col(n).alias(o) for n, o in zip(y, b, strict=True)], *[((F.col(o) - mid * F.col(n)) / half).alias(n) for n, o in zip(y, m, strict=True)])
        for _ in range(PASSES - 1):
            at = averaged(at, [*y, *b]).select("id", "w", *[F.col(n).alias(o) for n, o in zip(y, b, strict=True)], *[(2 * (F.col(k) - mid * F.col(n)) / half - F.col(o)).alias(n) for n, o, k in zip(y, b, m, strict=True)])
        at = at.select("id", "w", *y)
    flat = at.select("id", F.col(y[0]).alias("x"), F.col(y[1]).alias("y"))
    signs = flat.agg(*[F.signum(F.max_by(a, F.struct(F.abs(F.col(a)), F.col("id")))).alias(f"s{a}") for a in "xy"])
    flat = flat.crossJoin(F.broadcast(signs)).select("id", *[(F.col(a) * F.col(f"s{a}")).alias(a) for a in "xy"])
    return rows.select("id").join(flat, "id", "left").select("id", *[F.coalesce(a, F.lit(0.0)).alias(a) for a in "xy"])


def _spanning_tree(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends (the lower first) and weights of the minimum spanning tree of all rows; of equal weights the edge of lower ends."""
    n = len(x)
    low, high, weight = np.zeros(n - 1, np.int64), np.zeros(n - 1, np.int64), np.zeros(n - 1)
    # rows that aren't in the tree yet lie in the first m places; one that joins it gives its place to the last of them
    rest, at, core_of, place = np.arange(1, n), 0, core[1:].copy(), x[1:].copy()
    best, edge = np.full(n - 1, np.inf), np.full(n - 1, n * n, np.int64)
    for k in range(n - 1):
        m = n - 1 - k
        left, known, code_of = rest[:m], best[:m], edge[:m]
        reach = np.maximum(np.maximum(distances(place[:m], x[at]), core_of[:m]), core[at])
        code = np.minimum(left, at) * n + np.maximum(left, at)
        nearer = np.flatnonzero((reach < known) | (reach == known) & (code < code_of))
        known[nearer], code_of[nearer] = reach[nearer], code[nearer]
        least = np.flatnonzero(known == known.min())
        pick = least[code_of[least].argmin()]
        low[k], high[k], weight[k], at = edge[pick] // n, edge[pick] % n, best[pick], rest[pick]
        for column in (rest, core_of, place, best, edge):
            column[pick] = column[m - 1]
    return low, high, weight


def block_trees(rows: DataFrame, keys: list[str], alone: int = ALONE, block: int = BLOCK) -> DataFrame:
    """(keys, lo, hi, w): the edges of the spanning trees of all pairs of blocks of `rows` (keys, id, vec, core), among which are all
    edges of each key's whole tree. A key of up to `alone` rows has that tree alone."""
    parts = rows.groupBy(*keys).agg(F.when(F.count("*") <= alone, F.lit(1).cast("long")).otherwise(F.ceil(F.count("*") / block)).alias("__n"))
    x = rows.join(parts, keys).withColumn("__own", F.pmod(F.xxhash64("id"), F.col("__n")))
    other = F.when(F.col("__n") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), F.col("__own")))
    x = x.withColumn("__other", F.explode(other)).select(*keys, "id", "vec", "core", F.least("__own", "__other").alias("__q"), F.greatest("__own", "__other").alias("__s"))
    types = dict(rows.dtypes)

    def tree(table: pa.Table) -> pa.Table:
        table = table.take(pa.compute.sort_indices(table["id"]))
        lo, hi, w = _spanning_tree(matrix(table["vec"]), table["core"].to_numpy())
        ids = table["id"].combine_chunks()
        first = {k: table[k].combine_chunks().take(pa.array(np.zeros(len(lo), np.int64))) for k in keys}
        return pa.table({**first, "lo": ids.take(pa.array(lo)), "hi": ids.take(pa.array(hi)), "w": pa.array(w)})

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"lo {types['id']}", f"hi {types['id']}", "w double"])
    return x.groupBy(*keys, "__q", "__s").applyInArrow(tree, schema)


def _forest(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, ca: np.ndarray | None = None, cb: np.ndarray | None = None) -> np.ndarray:
    """Places of the edges of a minimum spanning forest, between the components ca and cb if these are given."""
    _, code = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    a, b = code[: len(lo)], code[len(lo) :]
    order = np.lexsort((b, a, w))
    if ca is not None:
        _, code = np.unique(np.concatenate([ca, cb]), return_inverse=True)
        a, b = code[: len(lo)], code[len(lo) :]
    up, keep = array("i", range(int(code.max(initial=-1)) + 1)), []
    for first in range(0, len(order), 1 << 16):
        some = order[first : first + (1 << 16)]
        for at, x, y in zip(some.tolist(), a[some].tolist(), b[some].tolist(), strict=True):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[y] = x
                keep.append(at)
    return np.array(keep, np.int64)


def spanning_forest(edges: DataFrame, keys: list[str], few: int = FEW) -> DataFrame:
    """The minimum spanning forest of `edges` (keys, lo, hi, w; lo below hi; between the components ca and cb, if these are given) by
    Boruvka rounds: every component takes its lightest edge to another, of equal ones that of the lowest ends, until none has one. Each
    round, which at least halves the components, is written and read again. Once no key has more than `few` edges left, a task for each
    key takes those that are still to come in order."""
    live = stored(edges.distinct().withColumns({} if "ca" in edges.columns else {"ca": F.col("lo"), "cb": F.col("hi")}))
    chosen = live.select(*keys, "lo", "hi", "w").limit(0)
    edge = F.struct("w", "lo", "hi").alias("e")

    def rest(table: pa.Table) -> pa.Table:
        keep = _forest(*(table[c].to_numpy() for c in ("lo", "hi", "w", "ca", "cb")))
        return table.select([*keys, "lo", "hi", "w"]).take(pa.array(keep))

    while True:
        most = live.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0
        if most <= few:
            schema = chosen.schema
            return stored(chosen.union(live.groupBy(*keys).applyInArrow(rest, schema)).distinct() if most else chosen.distinct())
        ends = live.select(*keys, F.col("ca").alias("c"), F.col("cb").alias("to"), edge).union(live.select(*keys, F.col("cb"), F.col("ca"), edge))
        best = stored(ends.groupBy(*keys, "c").agg(F.min(F.struct("e", "to")).alias("b")).select(*keys, "c", "b.to", "b.e"))
        chosen = chosen.union(best.select(*keys, "e.lo", "e.hi", "e.w"))
        # two components that chose one another: the lower is the root
        back = best.select(*keys, F.col("c").alias("to"), F.col("to").alias("then"))
        up = stored(best.join(back, [*keys, "to"]).select(*keys, "c", F.when((F.col("then") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root")))
        while True:
            above = up.select(*keys, F.col("c").alias("root"), F.col("root").alias("top"))
            hop = stored(up.join(above, [*keys, "root"]).select(*keys, "c", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")))
            up = hop.drop("moved")
            if not hop.filter("moved").head(1):
                break
        a, b = (up.select(*keys, F.col("c").alias(n), F.col("root").alias(f"r{n}")) for n in ("ca", "cb"))
        live = stored(live.join(a, [*keys, "ca"]).join(b, [*keys, "cb"]).filter("rca <> rcb").select(*keys, "lo", "hi", "w", F.col("rca").alias("ca"), F.col("rcb").alias("cb")))


def merge_order(forest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, pos, part, rank, w, lo, hi) of the ends of `forest` (keys, lo, hi, w): rows in an order in which the components of the
    edges up to any weight are runs. The last edge of the path between two rows of a part is that of the largest rank among the links
    from each row between them to the next; the link from a part's last row has no edge."""
    types = dict(forest.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("w", "ascending"), ("lo", "ascending"), ("hi", "ascending")])
        ids = pa.compute.unique(pa.chunked_array([*table["lo"].chunks, *table["hi"].chunks]))
        low, high = (pa.compute.index_in(table[c], ids).to_numpy() for c in ("lo", "hi"))
        n, edges = len(ids), table.num_rows
        up, last = array("i", range(n)), array("i", range(n))
        then, link = array("i", [-1]) * n, array("i", [edges]) * n

        def top(k):
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        for at in range(0, edges, 1 << 16):
            for rank, (a, b) in enumerate(zip(low[at : at + (1 << 16)].tolist(), high[at : at + (1 << 16)].tolist(), strict=True), at):
                a, b = top(a), top(b)
                if a != b:
                    # a component's top is its first row
                    up[b] = a
                    then[last[a]], link[last[a]] = b, rank
                    last[a] = last[b]
        order, part, parts = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        at = 0
        for first in range(n):
            if up[first] == first:
                k = first
                while k >= 0:
                    order[at], part[at] = k, parts
                    at, k = at + 1, then[k]
                parts += 1
        rank = np.frombuffer(link, np.int32).astype(np.int64)[order]
        edge = pa.array(rank, mask=rank == edges)
        first = {k: table[k].combine_chunks().take(pa.array(np.zeros(n, np.int64))) for k in keys}
        return pa.table({**first, "id": ids.take(pa.array(order)), "pos": np.arange(n), "part": part, "rank": rank, **{c: table[c].combine_chunks().take(edge) for c in ("w", "lo", "hi")}})

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"id {types['lo']}, pos long, part long, rank long, w double, lo {types['lo']}, hi {types['lo']}"])
    return forest.groupBy(*keys).applyInArrow(run, schema)


def _near(queries: DataFrame, rows: DataFrame, k: int, keys: list[str], cell: int = CELL) -> DataFrame:
    """The k nearest of `rows` to each of `queries` by distance, within keys; those of one set by boxes in space."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return nearest(queries, rows, k, by="l2", keys=tuple(keys), tasks=tasks) if keys else boxed_nearest(queries, rows, k, cell).withColumn("__all", F.lit(0))


def first_tree(near: DataFrame, rows: DataFrame, keys: list[str], asked: int = ASKED, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """A spanning tree of each key of `rows` (keys, id, vec, core), and its order of merges: the forest of `near` (keys, lo, hi, w), whose
    parts are joined by edges to near rows of others, which up to `asked` rows of a part look for."""
    forest, plain, turn = spanning_forest(near, keys), [k for k in keys if k != "__all"], 0
    while True:
        order = stored(merge_order(forest, keys))
        several = order.filter("part > 0").select(*keys).distinct()
        if not several.head(1):
            return forest, order
        apart = stored(rows.join(several, keys, "left_semi").join(order.select(*keys, "id", F.col("part").alias("grp")), [*keys, "id"]))
        size = apart.groupBy(*keys, "grp").agg(F.ceil(F.count("*") / asked).alias("__share"))
        some = apart.join(size, [*keys, "grp"]).filter(F.pmod(F.xxhash64("id", F.lit(turn)), F.col("__share")) == 0)
        met = _near(some.select(*plain, "id", "vec", "grp"), apart.select(*plain, "id", "vec", "grp"), 1, plain, cell)
        ends = [apart.select(*keys, F.col("id").alias(n), F.col("grp").alias(f"c{n}"), F.col("core").alias(f"core_{n}")) for n in ("id", "near_id")]
        links = met.join(ends[0], [*keys, "id"]).join(ends[1], [*keys, "near_id"])
        links = links.select(*keys, F.least("id", "near_id").alias("lo"), F.greatest("id", "near_id").alias("hi"), F.greatest("value", "core_id", "core_near_id").alias("w"), F.col("cid").alias("ca"), F.col("cnear_id").alias("cb"))
        forest, turn = stored(forest.unionByName(spanning_forest(links, keys))), turn + 1


def earlier_edges(rows: DataFrame, order: DataFrame, keys: list[str], run_rows: int = RUN, runs: int = RUNS, strip: int = STRIP, held: int = HELD) -> DataFrame:
    """(keys, lo, hi, w): the edges between `rows` (keys, id, vec, core) that come before the last edge of the path between their ends in
    the tree of `order` (`merge_order` of one part), by weight and then ends; of those of a pair of blocks only their own forest. A row is
    sent to all pairs of its block, so that blocks grow with the rows once there are `runs`."""
    types = dict(rows.dtypes)
    run_rows = max(run_rows, -(-((order.agg(F.max("pos")).head()[0] or 0) + 1) // runs))
    # a block's largest link, that to the next block included; a row for each block
    tops = order.withColumn("__q", F.floor(F.col("pos") / run_rows)).groupBy(*keys, "__q").agg(F.max(F.struct("rank", "w", "lo", "hi")).alias("m"), F.max("pos").alias("__end")).collect()
    largest, blocks = {(*[r[k] for k in keys], r["__q"]): tuple(r["m"]) for r in tops}, order.groupBy(*keys).agg((F.floor(F.max("pos") / run_rows) + 1).alias("__n"))
    x = rows.join(order, [*keys, "id"]).join(blocks, keys).withColumn("__own", F.floor(F.col("pos") / run_rows))
    x = x.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).select(*keys, "id", "vec", "core", "pos", "rank", "w", "lo", "hi", F.least("__own", "__other").alias("__q"), F.greatest("__own", "__other").alias("__s"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        q, s = table["__q"][0].as_py(), table["__s"][0].as_py()
        key = [table[k][0].as_py() for k in keys]
        place, core, link = matrix(table["vec"]), table["core"].to_numpy(), table["rank"].to_numpy()
        ids = table["id"].to_numpy()
        between = [m for m in (largest[(*key, m)] for m in range(q + 1, s))]
        known = pa.concat_tables([table.select(["rank", "w", "lo", "hi"]), pa.table({c: pa.array([m[k] for m in between], table[c].type) for k, c in enumerate(("rank", "w", "lo", "hi"))})]).filter(pa.compute.is_valid(pa.chunked_array([*table["w"].chunks, pa.array([m[1] for m in between], pa.float64())])))
        known = known.sort_by("rank")
        ranks, weights, lows, highs = (known[c].to_numpy() for c in ("rank", "w", "lo", "hi"))
        found, count = [], 0
        flat = place.shape[1] <= FLAT

        def put(a, b, rank):
            """Edges between the rows a and b that come before those of `rank`."""
            nonlocal found, count
            w = np.maximum(np.maximum(distances(place[a], place[b]), core[a]), core[b])
            at = np.searchsorted(ranks, rank)
            near = np.flatnonzero(w <= weights[at])
            a, b, w, at = a[near], b[near], w[near], at[near]
            one, two = ids[a], ids[b]
            swap = one > two
            lo, hi = np.where(swap, two, one), np.where(swap, one, two)
            before = np.flatnonzero((w < weights[at]) | (lo < lows[at]) | (lo == lows[at]) & (hi < highs[at]))
            if len(before):
                found.append((lo[before], hi[before], w[before]))
                count += len(before)
            if count > held:
                lo, hi, w = (np.concatenate(c) for c in zip(*found, strict=True))
                keep = _forest(lo, hi, w)
                found, count = [(lo[keep], hi[keep], w[keep])], 0

        def across(a, b, u, v):
            """Pairs of the rows a and b, the largest links between which are the larger of u and v."""
            scores = Scores(place[a], place[b], "l2")
            kind = scores.left.dtype
            far_u, far_v = (np.where(r >= 0, weights[np.searchsorted(ranks, np.maximum(r, ranks[0]))], 0.0) ** 2 * (1 + 1e-9) for r in (u, v))
            parts = boxes(place[a], TILE) if flat else [np.arange(at, min(at + TILE, len(a))) for at in range(0, len(a), TILE)]
            others = boxes(place[b]) if flat else [np.arange(at, min(at + WIDE, len(b))) for at in range(0, len(b), WIDE)]
            apart = gaps(place[a], parts, place[b], others) if flat else np.zeros((len(parts), len(others)))
            most_v = np.array([far_v[t].max() for t in others])
            off = 8 * float(np.finfo(kind).eps)
            for part, gap in zip(parts, apart, strict=True):
                most_u = far_u[part].max()
                for t in np.flatnonzero(gap * (1 - 1e-9) <= np.maximum(most_u, most_v) + 1e-11):
                    other = others[t]
                    own = scores.square[part] - scores.slack[part]
                    own = (own - off * (np.abs(own) + max(most_u, most_v[t]))).astype(kind)
                    least = np.minimum((own - far_u[part].astype(kind))[:, None], own[:, None] - far_v[other].astype(kind))
                    hit = np.flatnonzero(scores.tile(part, other) >= least)
                    for at in range(0, len(hit), 1 << 18):
                        i, j = part[hit[at : at + (1 << 18)] // len(other)], other[hit[at : at + (1 << 18)] % len(other)]
                        put(a[i], b[j], np.maximum(u[i], v[j]))

        def back(rows_):
            return np.maximum.accumulate(link[rows_][::-1])[::-1]

        def ahead(rows_):
            return np.concatenate([[-1], np.maximum.accumulate(link[rows_])[:-1]])

        def within(rows_):
            if len(rows_) <= strip:
                between_ = np.where(np.arange(len(rows_))[:, None] < np.arange(len(rows_)), ahead(rows_)[None] * 0 + np.concatenate([[-1], link[rows_][:-1]]), -1)
                i, j = np.triu_indices(len(rows_), 1)
                rank = np.maximum.accumulate(between_, axis=1)[i, j]
                for at in range(0, len(i), 1 << 18):
                    cut = slice(at, at + (1 << 18))
                    put(rows_[i[cut]], rows_[j[cut]], rank[cut])
                return
            a, b = rows_[: len(rows_) // 2], rows_[len(rows_) // 2 :]
            across(a, b, back(a), ahead(b))
            within(a)
            within(b)

        block = table["pos"].to_numpy() // run_rows
        a, b = np.flatnonzero(block == q), np.flatnonzero(block == s)
        if q == s:
            within(a)
        else:
            across(a, b, np.maximum(back(a), max([m[0] for m in between], default=-1)), ahead(b))
        lo, hi, w = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (ids[:0], ids[:0], np.zeros(0))
        keep = _forest(lo, hi, w)
        first = {k: table[k].combine_chunks().take(pa.array(np.zeros(len(keep), np.int64))) for k in keys}
        return pa.table({**first, "lo": pa.array(lo[keep], table["id"].type), "hi": pa.array(hi[keep], table["id"].type), "w": pa.array(w[keep], pa.float64())})

    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"lo {types['id']}", f"hi {types['id']}", "w double"])
    # the pairs are few bytes and much work
    x = x.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys, "__q", "__s")
    return x.groupBy(*keys, "__q", "__s").applyInArrow(run, schema)


def _merged(least: int, keys: list[str]):
    """Takes edges between components in order of weight; what becomes of each component. A component of fewer than `least` points that
    joins a larger one is part of the cluster that this grew from, unless two such have met in it (`mixed`); one that reaches `least` is
    a new cluster, named by its lowest root."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["w", "lo", "hi"])
        ends = pd.concat([frame[["ra", "size_a", "seed_a", "mixed_a"]].set_axis(["r", "size", "seed", "mixed"], axis=1), frame[["rb", "size_b", "seed_b", "mixed_b"]].set_axis(["r", "size", "seed", "mixed"], axis=1)])
        known = ends.drop_duplicates("r").sort_values("r")
        roots = known["r"].tolist()
        place = {r: k for k, r in enumerate(roots)}
        size, mixed = known["size"].tolist(), known["mixed"].tolist()
        seed = [None if pd.isna(s) else s for s in known["seed"]]
        parent, open_ = list(range(len(roots))), [[k] for k in range(len(roots))]
        told, label = [False] * len(roots), [None] * len(roots)

        def top(k):
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        def settle(group, name):
            for k in group:
                told[k], label[k] = True, name

        for a, b in zip(frame["ra"], frame["rb"], strict=True):
            a, b = sorted((top(place[a]), top(place[b])))
            if a == b:
                continue
            big = [k for k in (a, b) if size[k] >= least]
            if len(big) == 2:
                seed[a], mixed[a] = None, True
            elif big:
                small = b if big[0] == a else a
                settle(open_[small], seed[big[0]])
                seed[a], mixed[a] = seed[big[0]], mixed[big[0]]
            elif size[a] + size[b] >= least:
                seed[a] = roots[min(open_[a] + open_[b])]
                settle(open_[a] + open_[b], seed[a])
            else:
                open_[a] += open_[b]
            size[a] += size[b]
            parent[b] = a
        tops = [top(k) for k in range(len(roots))]
        out = pd.DataFrame({"root": roots, "new": [roots[k] for k in tops], "new_size": [size[k] for k in tops], "new_seed": [seed[k] for k in tops], "new_mixed": [mixed[k] for k in tops], "told": told, "name": label})
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out

    return run


def tree_clusters(tree: DataFrame, keys: list[str], least: int, most: int = SLICE) -> DataFrame:
    """(keys, id, name): the points of the leaves of the condensed tree of `tree` (keys, lo, hi, w). Noise has no row, and neither has
    a key whose tree doesn't split into two components of `least` points."""
    kind = dict(tree.dtypes)["lo"]
    types = dict(tree.dtypes)
    n = tree.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("__slices"))
    rounds = n.agg(F.max("__slices")).head()[0] or 0
    cut = tree.withColumn("slice", F.lit(0))
    if rounds > 1:
        at = tree.groupBy(*keys).agg(F.percentile_approx("w", F.array(*[F.lit(k / rounds) for k in range(1, rounds)]), F.lit(10_000)).alias("__at"))
        cut = stored(tree.join(at, keys).withColumn("slice", F.size(F.filter("__at", lambda q: q < F.col("w")))).drop("__at"))
    fresh = {"size": F.lit(1).cast("long"), "seed": F.lit(None).cast(kind), "mixed": F.lit(False)}
    points = tree.select(*keys, F.explode(F.array("lo", "hi")).alias("id")).distinct().withColumns({"root": F.col("id"), **fresh, "told": F.lit(False), "name": F.lit(None).cast(kind)})
    schema = ", ".join([f"root {kind}, new {kind}, new_size long, new_seed {kind}, new_mixed boolean, told boolean, name {kind}", *[f"{k} {types[k]}" for k in keys]])
    for k in range(rounds):
        e = cut.filter(F.col("slice") == k)
        for end, of in (("lo", "a"), ("hi", "b")):
            state = {f"r{of}": "root", f"size_{of}": "size", f"seed_{of}": "seed", f"mixed_{of}": "mixed"}
            # before the first slice every point is a component of its own
            e = e.withColumns({f"r{of}": F.col(end), **{f"{c}_{of}": v for c, v in fresh.items()}}) if k == 0 else e.join(points.select(*keys, F.col("id").alias(end), *[F.col(v).alias(c) for c, v in state.items()]), [*keys, end])
        moved = e.groupBy(*keys).applyInPandas(_merged(least, keys), schema)
        met = points.join(moved.select(*keys, "root", "new", "new_size", "new_seed", "new_mixed", F.col("told").alias("now"), F.col("name").alias("as")), [*keys, "root"], "left")
        taken = lambda new, old: F.when(F.col("new").isNotNull(), F.col(new)).otherwise(F.col(old)).alias(old)
        points = stored(met.select(*keys, "id", taken("new", "root"), taken("new_size", "size"), taken("new_seed", "seed"), taken("new_mixed", "mixed"), (F.col("told") | F.coalesce("now", F.lit(False))).alias("told"), F.coalesce("name", "as").alias("name")))
    return points.filter("name IS NOT NULL").select(*keys, "id", "name")


def density_clusters(rows: DataFrame, least: int, keys: tuple[str, ...] = (), alone: int = ALONE, block: int = BLOCK, most: int = SLICE, ordered: int = ORDERED, run: int = RUN, cell: int = CELL) -> DataFrame:
    """(keys, id, cluster) of `rows` (keys, id, vec; ids unique within a key): clusters numbered by their lowest id, noise -1.

    A point's core distance is that to the `least`-th row, itself counted. Of the condensed tree, whose components have `least` points
    or more, the leaves are clusters, and never the whole: a key that doesn't split, or has fewer than twice `least` rows, is all noise,
    and so are rows without a vector. All keys are clustered in one job."""
    keys = list(keys) or ["__all"]
    plain = [k for k in keys if k != "__all"]
    rows = rows.withColumns({} if plain else {"__all": F.lit(0)})
    own = rows.filter("vec IS NOT NULL").select(*keys, "id", "vec")
    own = own.join(own.groupBy(*keys).count().filter(F.col("count") >= 2 * least).drop("count"), keys, "left_semi")
    near = stored(_near(own, own, max(least - 1, 1), plain, cell))
    core = near.groupBy(*keys, "id").agg(F.max("value").alias("core"))
    cored = stored(own.join(core, [*keys, "id"]).withColumn("core", F.col("core") if least > 1 else F.lit(0.0)))
    size = cored.groupBy(*keys).agg(F.count("*").alias("__size"))
    of = lambda df, c: df.join(size.filter(c).select(*keys), keys, "left_semi")
    large = (F.col("__size") > alone) & (F.col("__size") <= ordered)
    edges = stored(block_trees(of(cored, ~large), keys, alone, block))
    # a key of one block has its tree already
    if size.filter((F.col("__size") > alone) & ~large).head(1):
        edges = of(edges, F.col("__size") <= alone).unionByName(spanning_forest(of(edges, F.col("__size") > alone), keys))
    if size.filter(large).head(1):
        some = of(cored, large)
        cores = [some.select(*keys, F.col("id").alias(n), F.col("core").alias(f"core_{n}")) for n in ("id", "near_id")]
        met = near.join(cores[0], [*keys, "id"]).join(cores[1], [*keys, "near_id"])
        met = met.select(*keys, F.least("id", "near_id").alias("lo"), F.greatest("id", "near_id").alias("hi"), F.greatest("value", "core_id", "core_near_id").alias("w"))
        tree, order = first_tree(met, some, keys, cell=cell)
        edges = edges.unionByName(spanning_forest(tree.unionByName(earlier_edges(some, order, keys, run)), keys))
    found = tree_clusters(edges, keys, least, most)
    # a row for each cluster; a tree that doesn't split has one
    low = found.groupBy(*keys, "name").agg(F.min("id").alias("low")).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    numbers = low.filter("n > 1").withColumn("cluster", F.row_number().over(Window.partitionBy(*keys).orderBy("low")) - 1)
    named = found.join(numbers.select(*keys, "name", "cluster"), [*keys, "name"]).select(*keys, "id", "cluster")
    out = rows.select(*keys, "id").join(named, [*keys, "id"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)))
    return out.drop("__all")
