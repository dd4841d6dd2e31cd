"""Embedding behind a content-addressed cache, in batches or over a stream of new files.

An encoder loader gives `encode`, which takes a list of texts and returns a matrix of as many rows. It runs once per task, and only
where a text misses the cache.
"""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.functions.text import text_chunks

#: Chunks encoded at once, texts cut at once, and words whose places the hashing encoder keeps (twice).
BATCH, TEXTS, WORDS = 256, 128, 1 << 17
#: A text is hot that has more copies than COPIES and than a SHARE of all rows, so that there are fewer than 1 / SHARE of them.
COPIES, SHARE = 10_000, 0.001


class _Places(dict):
    """Place and sign of words by their MD5, as one number: 2 * place, and one more where the sign is plus. Those of up to WORDS words are
    kept, and of as many before them, so that frequent words stay."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.before = size, {}

    def __missing__(self, word: str) -> int:
        code = self.before.get(word)
        if code is None:
            h = hashlib.md5(word.encode(), usedforsecurity=False).digest()
            code = int.from_bytes(h[:4], "big") % self.size * 2 + (h[4] < 128)
        if len(self) >= WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = code
        return code


def hashing_encoder(size: int = 64):
    """A loader that needs no model file: signed hashing of words by their MD5."""

    def load():
        places = _Places(size)

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), size), np.float32)
            for row, text in enumerate(texts):
                found = text.lower().split()
                n = np.bincount(np.fromiter(map(places.__getitem__, found), np.int64, len(found)), minlength=2 * size)
                out[row] = n[1::2] - n[::2]
            return out

        return encode

    return load


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=x.copy(), where=norm > 0)


def pooled(texts: DataFrame, load, most: int = 500, separator: str = "\n\n", prefix: str = "passage: ", count=None) -> DataFrame:
    """(text_sha, vector): unit means of the chunks' unit vectors, cut, encoded and pooled in one pass. `texts` has text_sha and
    text; `count` is a text's tokens (words by default)."""
    count = count or (lambda t: len(t.split()))

    def run(batches):
        encode = None
        # a few texts at a time, as each has many chunks
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, max(whole.num_rows, 1), TEXTS)):
            encode = encode or load()
            shas, cut, parts = batch.column("text_sha").to_pylist(), [0], []
            for t in batch.column("text").to_pylist():
                parts += text_chunks(t or "", most, separator, count)
                cut.append(len(parts))
            made = np.concatenate([_unit(np.asarray(encode([prefix + x for x in parts[a : a + BATCH]]), float)) for a in range(0, len(parts), BATCH)]) if parts else np.zeros((0, 1))
            mean = np.add.reduceat(made, cut[:-1], axis=0) / np.diff(cut)[:, None] if shas else made
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(mean) + 1) * made.shape[1], pa.int32()), pa.array(_unit(mean).astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(shas, pa.string()), vectors], ["text_sha", "vector"])

    return texts.select("text_sha", "text").mapInArrow(run, "text_sha string, vector array<float>")


class Cache:
    """The cache below `path`, as tables bucketed by the texts' hashes: `<path>/buckets=<n>/key=<key>/batch=<batch>`, a file to a bucket
    and batch. A join with one on text_sha shuffles the other side only. There is one such table as a rule; a second one while `compact`
    moves keys to another number of buckets, when all are read.

    Tables are known to the session's catalog by names made of their paths; what batches there are is taken from the folders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self.fs.makeQualified(at).toString()

    def _listed(self, pattern: str):
        return [s.getPath() for s in self.fs.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")) or []]

    def layouts(self) -> list[int]:
        """Numbers of buckets that there are tables of, in order."""
        return sorted(int(p.getName().removeprefix("buckets=")) for p in self._listed("buckets=*"))

    def table(self, buckets: int) -> str:
        """Name of the table of so many buckets, with all batches that it has now."""
        at = f"{self.path}/buckets={buckets}"
        name = f"cache_{hashlib.sha1(at.encode(), usedforsecurity=False).hexdigest()}"
        self.fs.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(at))
        quoted = at.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (text_sha string, vector array<float>, key string, batch string) USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "
            f"PARTITIONED BY (key, batch) CLUSTERED BY (text_sha) INTO {buckets} BUCKETS LOCATION '{quoted}'"
        )
        self.spark.sql(f"MSCK REPAIR TABLE {name} SYNC PARTITIONS")
        self.spark.catalog.refreshTable(name)
        return name

    def held(self, key: str, buckets: int) -> DataFrame:
        """(batch, text_sha, vector) under `key` in the table of so many buckets."""
        return self.spark.table(self.table(buckets)).filter(F.col("key") == key).select("batch", "text_sha", "vector")

    def write(self, made: DataFrame, key: str, batch: str, buckets: int) -> None:
        """Puts (text_sha, vector) in place of what the batch has there."""
        made.select("text_sha", "vector", F.lit(key).alias("key"), F.lit(batch).alias("batch")).write.insertInto(self.table(buckets), overwrite=True)

    def remove(self, key: str, batches: set[tuple[int, str]]) -> None:
        """Removes (buckets, batch) of `key`."""
        for at in self._listed("buckets=*/key=*/batch=*"):
            buckets, own, batch = (unquote(p.partition("=")[2]) for p in at.toString().rsplit("/", 3)[1:])
            if own == key and (int(buckets), batch) in batches:
                self.fs.delete(at, True)
        for at in self._listed("buckets=*"):
            if not self._listed(f"{at.getName()}/key=*/batch=*") and at.getName() != f"buckets={self.layouts()[-1]}":
                self.fs.delete(at, True)


def _hot(hashed: DataFrame, copies: int) -> list[str]:
    """Hashes of the texts that would make one task of a join much longer than others."""
    each = hashed.groupBy("text_sha").agg(F.count("*").alias("n"))
    rows, most = each.agg(F.sum("n"), F.max("n")).head()
    least = max(copies, SHARE * (rows or 0))
    return [r["text_sha"] for r in each.filter(F.col("n") > least).collect()] if (most or 0) > least else []


def embed(rows: DataFrame, cache: str, key: str, load, batch: str | None = None, buckets: int | None = None, copies: int = COPIES, **options) -> DataFrame:
    """`rows` (id, text) with one unit `vector` each. Texts not in the cache under `key` are encoded once and added to it. `buckets` are
    those of a new cache (by default the session's shuffle partitions); one that is there keeps its own.

    They are written as one `batch` of the cache, by default under a name of its own. A run with the name of an earlier one replaces
    what that has written, so that a batch which is run again after it broke off, or was complete, adds each text once. A text that two
    runs add at the same time is in the cache twice, and is read once. A column `vector` of `rows` is replaced. Rows of a text with very
    many copies (above `copies`) aren't shuffled: the vectors of these few texts are broadcast."""
    spark = rows.sparkSession
    batch, held = batch or uuid.uuid4().hex, Cache(spark, cache)
    layouts = held.layouts() or [buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))]
    hashed = rows.drop("vector").withColumn("text_sha", F.sha1(F.coalesce("text", F.lit(""))))
    # copies go ahead of the shuffle
    missing = hashed.select("text_sha", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["text_sha"])
    for n in layouts:
        missing = missing.join(held.held(key, n).filter(F.col("batch") != batch).select("text_sha"), "text_sha", "left_anti")
    held.write(pooled(missing, load, **options), key, batch, layouts[-1])
    known = [held.held(key, n).select("text_sha", F.col("vector").alias(f"vector_{n}")).dropDuplicates(["text_sha"]) for n in layouts]

    def joined(some: DataFrame, tables: list[DataFrame]) -> DataFrame:
        for table in tables:
            some = some.join(table, "text_sha", "inner" if len(tables) == 1 else "left")
        return some

    hot = _hot(hashed, copies)
    if hot:
        own = F.col("text_sha").isin(hot)
        out = joined(hashed.filter(~own), known).union(joined(hashed.filter(own), [F.broadcast(k.filter(own)) for k in known]))
    else:
        out = joined(hashed, known)
    found = [f"vector_{n}" for n in layouts]
    return out.withColumn("vector", F.coalesce(*found)).drop("text_sha", *found)


def compact(spark: SparkSession, cache: str, key: str, buckets: int | None = None) -> None:
    """Gathers the batches of `key` in one, each text once, a file to a bucket, of so many buckets as given (as many as now by default);
    the batches that it holds are then removed. Not while others write to the cache."""
    held = Cache(spark, cache)
    layouts = held.layouts()
    if not layouts:
        return
    to = buckets or layouts[-1]
    old = {(n, r["batch"]) for n in layouts for r in held.held(key, n).select("batch").distinct().collect()}
    if len(old) < 2 and all(n == to for n, _ in old):
        return
    whole = None
    for n in layouts:
        each = held.held(key, n).select("text_sha", "vector")
        whole = each if whole is None else whole.union(each)
    # until the old ones are gone, both are read, each text once
    held.write(whole.repartition(to, "text_sha").dropDuplicates(["text_sha"]), key, f"compact-{uuid.uuid4().hex}", to)
    held.remove(key, old)


def embed_stream(stream: DataFrame, cache: str, key: str, load, checkpoint: str, name: str = "stream", **options):
    """Keep the cache filled from a stream of (id, text). No state is held, as the cache is addressed by content; a batch is named by
    the stream's `name` and the batch's number, so that one which is run again after a failure replaces what it had written."""

    def batch(df: DataFrame, number: int) -> None:
        embed(df, cache, key, load, f"{name}-{number}", **options)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
