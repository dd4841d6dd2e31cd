"""Reading and writing tables, payloads and models."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession, name: str = "topics") -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local session takes
    a temporary folder of its own; a cluster has no folder that would do."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again, so that it is made once and outlives a lost executor."""
    path = shared_folder(df.sparkSession)
    _made.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def made_folders(spark: SparkSession) -> list[str]:
    """What `stored` has written in this session so far."""
    return list(_made.get(spark.sparkContext.applicationId, []))


def clear_stored(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Removes what `stored` has written in this session (or the given paths of it), for when what was made of it has been written."""
    paths = made_folders(spark) if paths is None else paths
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made[spark.sparkContext.applicationId] = [p for p in made_folders(spark) if p not in set(paths)]


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` returns, `stored`; what it has stored on the way is removed."""
    before = set(made_folders(spark))
    out = stored(make())
    clear_stored(spark, [p for p in made_folders(spark)[:-1] if p not in before])
    return out


def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A Parquet table; FileNotFoundError that names the path if there is none."""
    try:
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"table not found: {path}") from e
        raise


def spread(df: DataFrame, most_bytes: int = 1 << 26) -> DataFrame:
    """A table of up to `most_bytes` a core, which may lie in fewer files than there are cores, dealt to all of them; a larger one as
    it is. For scans ahead of work on whole texts."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= most_bytes * cores else df


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table, or an empty one of that schema."""
    try:
        return read_table(spark, path, schema)
    except FileNotFoundError:
        return spark.createDataFrame([], schema)


def with_optional(df: DataFrame, **columns: str) -> DataFrame:
    """`df` with the named columns of the given types, null where it lacks them."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns})


def not_kind(df: DataFrame, kind: str = "fragestunde", column: str = "kind") -> DataFrame:
    """Rows of another kind (null kinds go); everything if there is no such column."""
    return df.filter(F.col(column) != kind) if column in df.columns else df


def write_weeks(payloads: DataFrame, path: str, form: str = "json") -> None:
    """One partition per week; weeks that aren't in `payloads` stay as they are."""
    payloads.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").format(form).save(path)


def read_weeks(spark: SparkSession, path: str, schema: str | None = None, form: str = "json") -> DataFrame:
    """All weeks below `path`; other folders and files there are ignored."""
    reader = (spark.read if schema is None else spark.read.schema(schema)).format(form).option("basePath", path)
    return reader.load(f"{path}/week=*")


def write_mapping(df: DataFrame, path: str, key: str = "id") -> int:
    """JSON rows sorted by key; the number of rows."""
    from pyspark.sql import Observation

    seen = Observation()
    df.orderBy(key).observe(seen, F.count("*").alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def fingerprint(rows: DataFrame, params: dict, key: str = "id", text: str = "text") -> DataFrame:
    """(n, rows_hash, params_sha1): order-free over unique ids; a row's hash is the first 60 bits of the MD5 of its id and its
    text's SHA-1."""
    row = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.sha1(F.coalesce(F.col(text), F.lit("")))))
    number = F.conv(F.substring(row, 1, 15), 16, 10).cast("long")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(number), F.lit(0)).alias("rows_hash")).withColumn("params_sha1", F.sha1(F.lit(json.dumps(params, sort_keys=True))))


FINGERPRINT = "n long, rows_hash long, params_sha1 string, model string"


def build_if_changed(rows: DataFrame, params: dict, path: str, build: Callable[[DataFrame], dict[str, DataFrame]]) -> tuple[dict[str, DataFrame], bool]:
    """The tables of the model at `path`, made anew by `build(rows)` unless rows and parameters are as before; and whether they
    were. `params` should name all that the model depends on, the encoder's key included.

    Tables go to a new folder each time; the fingerprint that names it is written when all of them are complete, so a run that
    breaks off leaves the model before it in place."""
    spark = rows.sparkSession
    now = fingerprint(rows, params).head()
    before = read_optional(spark, f"{path}/fingerprint", FINGERPRINT).head()
    if before and tuple(before)[:3] == tuple(now):
        names = read_table(spark, f"{path}/{before['model']}/_names", "name string")
        return {r["name"]: read_table(spark, f"{path}/{before['model']}/{r['name']}") for r in names.collect()}, False
    folder = f"model-{uuid.uuid4().hex}"
    made = build(rows)
    for name, table in made.items():
        table.write.parquet(f"{path}/{folder}/{name}")
    spark.createDataFrame([(name,) for name in made], "name string").coalesce(1).write.parquet(f"{path}/{folder}/_names")
    spark.createDataFrame([(*now, folder)], FINGERPRINT).coalesce(1).write.mode("overwrite").parquet(f"{path}/fingerprint")
    return {name: read_table(spark, f"{path}/{folder}/{name}") for name in made}, True
