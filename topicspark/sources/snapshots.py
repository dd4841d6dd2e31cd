"""Versioned tables that change together.

A version's tables are written below `data/<table>/version=<n>`, tables of weeks by week below that. Its manifest, a small table that
names for every table (and week) the folder that holds it, is written last: readers take the newest complete manifest, so that a
run which breaks off at any step leaves what was there before. Tables and weeks that a version doesn't write stay those of the version
before, and `clean` removes what no manifest of the last versions names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicspark.sources.tables import read_table

MANIFEST = "name string, week string, folder string"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order."""
    fs, at = _files(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions below `path`."""
    return sorted(int(p.split("/")[-2].removeprefix("version=")) for p in _listed(spark, f"{path}/manifests/version=*/_SUCCESS"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[tuple[str, str], str]:
    """Folder of each (table, week) of a version, the newest one by default; a table without weeks has the week ''. Empty if there is
    no version."""
    known = versions(spark, path)
    if not known:
        return {}
    at = f"{path}/manifests/version={known[-1] if version is None else version}"
    return {(r["name"], r["week"]): r["folder"] for r in read_table(spark, at, MANIFEST).collect()}


def read_snapshot(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame:
    """A table as a version has it; FileNotFoundError that names it if it has none."""
    held = sorted(folder for (n, _), folder in manifest(spark, path, version).items() if n == name)
    if not held:
        raise FileNotFoundError(f"table not found: {name} in {path}")
    made = spark.read.option("basePath", f"{path}/data/{name}").option("mergeSchema", True).parquet(*[f"{path}/data/{name}/{folder}" for folder in held])
    return made.drop("version")


class Version:
    """A new version of the tables below `path`, which no reader sees before `commit`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.number = max([0, *versions(spark, path)]) + 1
        # what a run that broke off has left under the same number
        for rest in _listed(spark, f"{path}/data/*/version={self.number}") + _listed(spark, f"{path}/manifests/version={self.number}"):
            fs, at = _files(spark, rest)
            fs.delete(at, True)
        self.held = manifest(spark, path)

    def write(self, name: str, table: DataFrame) -> None:
        table.write.parquet(f"{self.path}/data/{name}/version={self.number}")
        self.held = {k: v for k, v in self.held.items() if k[0] != name} | {(name, ""): f"version={self.number}"}

    def write_weeks(self, name: str, table: DataFrame, weeks: list[str] | None = None) -> None:
        """Replaces the given weeks, or all; a week that has no rows now is in the table no longer."""
        to = f"{self.path}/data/{name}/version={self.number}"
        table.write.partitionBy("week").parquet(to)
        made = {p.rpartition("/")[2] for p in _listed(self.spark, f"{to}/week=*")}
        escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        anew = {f"week={escaped(w)}" for w in weeks or []}
        gone = lambda week: weeks is None or week in anew or not week
        self.held = {k: v for k, v in self.held.items() if k[0] != name or not gone(k[1])} | {(name, week): f"version={self.number}/{week}" for week in made}
        if not any(k[0] == name for k in self.held):
            # no week at all: a file that tells the columns
            table.limit(0).write.mode("overwrite").parquet(to)
            self.held[(name, "")] = f"version={self.number}"

    def read(self, name: str) -> DataFrame:
        """A table as it will be, for tables that are made of others."""
        held = sorted(folder for (n, _), folder in self.held.items() if n == name)
        return self.spark.read.option("basePath", f"{self.path}/data/{name}").parquet(*[f"{self.path}/data/{name}/{folder}" for folder in held]).drop("version")

    def commit(self) -> int:
        """Makes the version the one that readers see. Fails, and changes nothing, if another run has taken its number meanwhile."""
        rows = [(*k, v) for k, v in sorted(self.held.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.path}/manifests/version={self.number}")
        return self.number


def clean(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Removes all versions but the last `keep`, and the folders that these don't name."""
    known = versions(spark, path)
    stay = known[-keep:]
    named = {f"{n}/{folder}" for v in stay for (n, _), folder in manifest(spark, path, v).items()}
    drop = [f"{path}/manifests/version={v}" for v in known[:-keep]]
    for table in _listed(spark, f"{path}/data/*/version=*"):
        name, number = table.split("/")[-2], int(table.rpartition("=")[2])
        if number > max(stay, default=0) or f"{name}/version={number}" in named:
            continue
        weeks = _listed(spark, f"{table}/week=*")
        kept = [w for w in weeks if f"{name}/version={number}/{w.rpartition('/')[2]}" in named]
        drop += [w for w in weeks if w not in kept] if kept else [table]
    for gone in drop:
        fs, at = _files(spark, gone)
        fs.delete(at, True)


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    """(name, n) of every table of the newest version."""
    names = sorted({name for name, _ in manifest(spark, path)})
    each = [read_snapshot(spark, path, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in names]
    out = spark.createDataFrame([], "name string, n long")
    for more in each:
        out = out.union(more)
    return out
