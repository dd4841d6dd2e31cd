"""Helpers shared by the training-data operators: tables, shared folder, byte-level text, summed arrays.

Text reaches Python as Arrow string arrays whose UTF-8 buffer is read in place, so that word, line and n-gram work runs over
whole batches in numpy.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, and tab to carriage return.
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[9, 10, 11, 12, 13, 32]] = True
#: Words as the SQL and JVM side write them.
WORD = r"[^\x20\x09-\x0D]+"

_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
_made: dict[str, list[str]] = {}

#: Rows of a table of names that is broadcast at most (some 20 MB); beyond that it is joined by shuffle, its rows repeated for
#: SALTS parts of the other side.
SMALL, SALTS = 100_000, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local session takes
    a temporary folder of its own; a cluster has no folder that would do."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def made_folders(spark: SparkSession) -> list[str]:
    """The paths that this session has got from `shared_dir` so far."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def clear_shared(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Removes what this session's operators have written to the shared folder (or the given paths of it), for when what was made
    of it has been stored."""
    paths = made_folders(spark) if paths is None else paths
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made[spark.sparkContext.applicationId] = [p for p in made_folders(spark) if p not in set(paths)]


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: cuts the lineage, and outlives a lost executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(0))


def with_labels(docs: DataFrame, labels: DataFrame, *names: str, how: str = "left", most: int = 1_000_000) -> DataFrame:
    """`docs` with the largest label of each id. Up to `most` labelled ids are broadcast (under 50 MB); beyond that the join
    shuffles both sides."""
    one = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    small = labels.select("doc_id").limit(most + 1).count() <= most
    return docs.join(F.broadcast(one) if small else one, "doc_id", how)


def looked_up(rows: DataFrame, table_: DataFrame, keys: list[str], spread: Column, how: str = "inner", small: int = SMALL) -> DataFrame:
    """`rows` joined with `table_` (one row per `keys`). A small table is broadcast; else rows of one key go to SALTS tasks by
    `spread`, so that a hot key isn't one task's."""
    if table_.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(table_), keys, how)
    dealt = table_.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(dealt, [*keys, "__salt"], how).drop("__salt")


def strings(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array, and each row's start and end in them; null rows are empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0]


def slices(array: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `most_bytes` at most; a longer text is a range of its own."""
    if not len(array):
        return
    _, starts, ends = strings(array)
    first = 0
    while first < len(array):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + most_bytes, side="right")))
        yield first, last
        first = last


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SEPARATORS[data]
    cut = np.zeros(n + 1, bool)
    cut[starts] = True
    cut[ends] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last[:-1] &= ~inside[1:] | cut[1:n]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(ends, begin, side="right")


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from one running sum: spans of equal bytes have equal hashes wherever they lie."""
    n = len(data)
    if len(_powers.get("up", ())) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for name, base in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 2**64))):
            power = np.full(size, base, np.uint64)
            power[0] = 1
            _powers[name] = np.cumprod(power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers["up"][:n], out=total[1:])
    return mixed((total[end] - total[begin]) * _powers["down"][begin] + (end - begin).astype(np.uint64))


def sum_per_row(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of `values` over each row's range."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


#: Pieces that one group adds, and rounds of that: enough for the pieces of ADDED ** ROUNDS tasks (16 million).
ADDED, ROUNDS = 256, 3


def summed_arrays(df: DataFrame, counts: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int, piece: int = 1 << 14) -> np.ndarray:
    """Sum over all partitions of the count array of `size` that `counts` makes of a partition's batches.

    Each task sends its array in pieces, which are added in rounds of ADDED at a time, so no task holds more than so many of one
    piece. Only the sum, of fixed size, reaches the driver."""

    def partial(batches):
        found = counts(batches)
        part = TaskContext.get().partitionId()
        for k in range(0, size, piece):
            if found[k : k + piece].any():
                yield pa.RecordBatch.from_pydict({"piece": pa.array([k // piece], pa.int32()), "part": pa.array([part], pa.int32()), "sums": pa.array([found[k : k + piece].astype("<i8").tobytes()], pa.binary())})

    out = np.zeros(size + piece, np.int64)
    for row in added_pieces(df.mapInArrow(partial, "piece int, part int, sums binary"), piece).collect():
        out[row["piece"] * piece : (row["piece"] + 1) * piece] = np.frombuffer(row["sums"], "<i8")
    return out[:size]


def added_pieces(pieces: DataFrame, piece: int) -> DataFrame:
    """(piece, part, sums) with one row for each piece: `part` is divided by ADDED in every round."""

    def add(frame):
        total = np.zeros(piece, np.int64)
        for x in frame["sums"]:
            own = np.frombuffer(x, "<i8")
            total[: len(own)] += own
        return frame[["piece", "part"]].head(1).assign(sums=[total.tobytes()])

    for _ in range(ROUNDS):
        pieces = pieces.withColumn("part", F.floor(F.col("part") / ADDED).cast("int")).groupBy("piece", "part").applyInPandas(add, "piece int, part int, sums binary")
    return pieces
