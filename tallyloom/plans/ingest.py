"""Ingestion job: every reader over a lake, normalised tables out, published as whole versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.schemas import SCHEMAS, Tables, conform, union_all
from tallyloom.session import configure
from tallyloom.sources.lake import Lake, Stage
from tallyloom.sources.registry import READERS

#: Versions whose files stay, so that readers of an older one can finish.
KEPT_VERSIONS = 3
#: Runs that may publish at the same moment.
ATTEMPTS = 20


def read_all(spark: SparkSession, lake: Lake, harnesses: Sequence[str] | None = None,
             stage: Stage | None = None) -> Tables:
    """Union of the readers in registry order.

    What is wrong with a file or a database is a warning of its store; any other error fails the job, so that a lost
    machine is never taken for an empty history.
    """
    configure(spark)
    stage = stage or Stage.shared(spark)
    return union_all([READERS[harness](spark, lake, stage) for harness in harnesses or READERS])


class Versions:
    """Table sets below a folder.

    A run writes all its tables to ``runs/<id>``, which nobody reads yet. A version is one small file: for each harness
    the run that holds it. It gets its number by a rename that fails if the number is taken, so all tables of a run are
    visible at once or not at all, and what a killed run has left behind is never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [status.getPath().getName() for status in self.files.listStatus(at)] if self.files.exists(at) else []

    def numbers(self) -> list[int]:
        return sorted(int(name.removesuffix(".json")) for name in self._list("versions") if name[0].isdigit())

    def runs(self, number: int) -> dict[str, str]:
        """The run of each harness."""
        text = self.spark.read.option("wholetext", "true").text(f"{self.path}/versions/{number:012d}.json").first()
        return json.loads(text[0])

    def publish(self, run: str, harnesses: Sequence[str]) -> int:
        """A new version: that of before with ``harnesses`` from this run."""
        draft = self._path(f"{self.path}/versions/_{uuid.uuid4().hex}")
        for _ in range(ATTEMPTS):
            last = max(self.numbers(), default=0)
            chosen = {**(self.runs(last) if last else {}), **dict.fromkeys(harnesses, run)}
            out = self.files.create(draft, True)
            out.write(bytearray(json.dumps(chosen, sort_keys=True).encode()))
            out.close()
            target = self._path(f"{self.path}/versions/{last + 1:012d}.json")
            if not self.files.exists(target) and self.files.rename(draft, target):
                return last + 1
        raise OSError(f"{ATTEMPTS} other runs have published below {self.path}")

    def expire(self, keep: int = KEPT_VERSIONS) -> None:
        """Drop all but the last ``keep`` versions, and published runs that none of these names."""
        numbers = self.numbers()
        old, new = numbers[:-keep], numbers[-keep:]
        used = {run for number in new for run in self.runs(number).values()}
        for run in {run for number in old for run in self.runs(number).values()} - used:
            self.files.delete(self._path(f"{self.path}/runs/{run}"), True)
        for number in old:
            self.files.delete(self._path(f"{self.path}/versions/{number:012d}.json"), False)


def write_tables(parts: Tables, path: str, harnesses: Sequence[str] | None = None) -> None:
    """Parquet per table, partitioned by harness, published as a new version of all ``harnesses``, of which a run may
    have no rows for some, and of no other."""
    run = uuid.uuid4().hex
    for name, df in parts.named().items():
        conform(df, name).write.partitionBy("harness").parquet(f"{path}/runs/{run}/{name}")
    versions = Versions(parts.sessions.sparkSession, path)
    versions.publish(run, list(harnesses or READERS))
    versions.expire()


def load_tables(spark: SparkSession, path: str, number: int | None = None) -> Tables:
    """The tables of a version, by default of the last one; later versions don't change what is read."""
    versions = Versions(spark, path)
    numbers = versions.numbers()
    if not numbers:
        raise FileNotFoundError(f"no version below {path}")
    owners: dict[str, list[str]] = {}
    for harness, run in versions.runs(number or numbers[-1]).items():
        owners.setdefault(run, []).append(harness)

    def load(name: str) -> DataFrame:
        schema = spark.createDataFrame([], SCHEMAS[name]).schema
        parts = [spark.read.schema(schema).parquet(f"{path}/runs/{run}/{name}").where(F.col("harness").isin(names))
                 for run, names in sorted(owners.items())]  # a run for each harness at most
        return conform(reduce(DataFrame.unionByName, parts), name)

    return Tables(**{name: load(name) for name in SCHEMAS})


def run(spark: SparkSession, lake: Lake, out: str, harnesses: Sequence[str] | None = None) -> Tables:
    """Read, write and load back, so that reports never re-read the histories."""
    stage = Stage.shared(spark)
    write_tables(read_all(spark, lake, harnesses, stage), out, harnesses)
    stage.drop(spark)
    return load_tables(spark, out)
