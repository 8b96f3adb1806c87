"""Tables in a shared folder, in generations: data first, the marker last."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path under the session's checkpoint folder; only a local session that names none gets one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='kelpie-')}"
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Table:
    """A keyed Parquet table whose changes make a new generation.

    A reader sees a generation only once its marker is written, so a change that breaks off
    leaves the old state. Old generations stay until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def generation(self) -> int:
        fs, path = self._fs()
        root = path(f"{self.path}/_current")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return max(map(int, names), default=0)

    def exists(self) -> bool:
        return self.generation() > 0

    def read(self) -> DataFrame:
        g = self.generation()
        if not g:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/g{g}") if isinstance(self.schema, StructType) else self.spark.read.parquet(f"{self.path}/g{g}")

    def write(self, rows: DataFrame) -> None:
        g = self.generation() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/g{g}")
        fs, path = self._fs()
        fs.create(path(f"{self.path}/_current/{g}"), True).close()

    def replace(self, keys: Sequence[str], rows: DataFrame) -> None:
        """Rows whose keys occur in the new ones go, then the new ones come in."""
        old = self.read().join(rows.select(*keys).distinct(), list(keys), "left_anti")
        self.write(old.unionByName(rows))

    def delete(self, condition) -> None:
        self.write(self.read().filter(~F.coalesce(condition, F.lit(False))))

    def delete_prefix(self, column: str, prefix: str) -> None:
        self.delete(F.col(column).startswith(prefix))

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)

    def vacuum(self) -> None:
        """Keep the current generation alone."""
        g = self.generation()
        fs, path = self._fs()
        for s in fs.listStatus(path(self.path)):
            name = s.getPath().getName()
            if name.startswith("g") and name != f"g{g}":
                fs.delete(s.getPath(), True)


class ChangeLog:
    """Several tables that change together, in changes beside one another, and a marker that counts them.

    A change holds new rows and the keys whose older rows are gone; it is written in proportion to
    what changes, under a name of its own, and counts once the marker names it, so that one that
    breaks off leaves no trace in what is read. Readers merge: a row lives while no later change
    has its key among the gone. Small changes are merged from time to time, and with the oldest
    one when they have grown to its size.
    """

    #: Changes after the oldest that are merged into one.
    MOST = 8

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str], keys: Sequence[str]):
        self.spark, self.path, self.schemas, self.keys = spark, path, dict(schemas), list(keys)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def state(self) -> dict:
        """Of the latest marker: its number, the changes' numbers by name, oldest first, and what was said with them."""
        fs, path = self._fs()
        root = path(f"{self.path}/_log")
        names = sorted(x for x in (s.getPath().getName() for s in fs.listStatus(root)) if x.endswith(".json")) if fs.exists(root) else []
        if not names:
            return {"number": 0, "changes": {}, "about": {}}
        stream = fs.open(path(f"{self.path}/_log/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _mark(self, state: dict) -> None:
        fs, path = self._fs()
        name = f"{self.path}/_log/{state['number']:08d}"
        out = fs.create(path(f"{name}.{uuid.uuid4().hex}"), True)
        out.write(json.dumps(state).encode())
        out.close()
        written = next(s.getPath() for s in fs.listStatus(path(f"{self.path}/_log")) if s.getPath().getName().startswith(f"{state['number']:08d}.") and not s.getPath().getName().endswith(".json"))
        if not fs.rename(written, path(f"{name}.json")):
            raise FileExistsError(f"{name}.json: another writer was first")

    def _rows(self, table: str, changes: Mapping[str, int]) -> DataFrame:
        """Rows of some changes with their number, without those that a later one of them has gone."""
        schema = f"{self.schemas[table]}, _number int"
        if not changes:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{c}/{table}" for c in changes))
        gone = self._gone(changes)
        if gone is None:
            return rows
        return rows.join(gone, self.keys, "left").filter("_until IS NULL OR _number >= _until").drop("_until").select(*rows.columns)

    def _gone(self, changes: Mapping[str, int]) -> DataFrame | None:
        """Keys, and the latest change in which they are gone; the oldest change has nothing before it."""
        if len(changes) < 2:
            return None
        kinds = {x.split()[0]: x.split()[1] for v in self.schemas.values() for x in v.split(", ")}
        schema = ", ".join(f"{k} {kinds[k]}" for k in self.keys) + ", _number int"
        gone = self.spark.read.schema(schema).parquet(*(f"{self.path}/{c}/_gone" for c in list(changes)[1:]))
        return gone.groupBy(*self.keys).agg(F.max("_number").alias("_until"))

    def read(self, table: str) -> DataFrame:
        return self._rows(table, self.state()["changes"]).drop("_number")

    def _write(self, name: str, number: int, gone: DataFrame | None, tables: Mapping[str, DataFrame]) -> dict[str, int]:
        """Rows written of each table, and keys as "gone", counted as they are written."""
        counts = {t: 0 for t in (*self.schemas, "gone")}
        for t, schema in self.schemas.items():
            names = [x.split()[0] for x in schema.split(", ")]
            own = tables[t] if t in tables else self.spark.createDataFrame([], schema)
            own = own.select(*names, F.lit(number).alias("_number") if "_number" not in own.columns else F.col("_number"))
            counts[t] = self._counted(own.sortWithinPartitions(*(k for k in self.keys if k in names)), f"{self.path}/{name}/{t}", t in tables)
        none = self.spark.createDataFrame([], ", ".join(f"{k} string" for k in self.keys))
        keys = (none if gone is None else gone).select(*self.keys).distinct().withColumn("_number", F.lit(number))
        counts["gone"] = self._counted(keys, f"{self.path}/{name}/_gone", gone is not None)
        return counts

    @staticmethod
    def _counted(rows: DataFrame, path: str, count: bool) -> int:
        """Write the rows; how many there were is observed on the way."""
        if not count:
            rows.write.parquet(path)
            return 0
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return int(seen.get.get("n", 0))

    def commit(self, gone: DataFrame | None, tables: Mapping[str, DataFrame], about: Mapping[str, object] | None = None) -> dict[str, int]:
        """One change; the rows must not be read from this log lazily after it. How many rows came in, and keys went."""
        state, name = self.state(), f"c-{uuid.uuid4().hex}"
        number = state["number"] + 1
        counts = self._write(name, number, gone, tables)
        state = {"number": number, "changes": state["changes"] | {name: number}, "about": dict(about or state["about"])}
        self._mark(state)
        if len(state["changes"]) > self.MOST + 1:
            self.merge()
        return counts

    def _size(self, names: Sequence[str]) -> int:
        fs, path = self._fs()
        return sum(fs.getContentSummary(path(f"{self.path}/{c}")).getLength() for c in names)

    def merge(self) -> None:
        """The changes after the oldest in one, or all where the later ones are as large as the oldest."""
        state = self.state()
        names = list(state["changes"])
        whole = self._size(names[1:]) >= self._size(names[:1])
        some = state["changes"] if whole else {c: state["changes"][c] for c in names[1:]}
        number, name = max(some.values()), f"c-{uuid.uuid4().hex}"
        # the rows keep to the last number, as all that is gone among them has gone
        tables = {t: self._rows(t, some).drop("_number") for t in self.schemas}
        if whole:
            gone, kept = None, {}
        else:
            gone, kept = self.spark.read.parquet(*(f"{self.path}/{c}/_gone" for c in some)), {names[0]: state["changes"][names[0]]}
        self._write(name, number, gone, tables)
        self._mark(state | {"number": state["number"] + 1, "changes": kept | {name: number}})

    def vacuum(self) -> None:
        """Remove changes and markers that the latest marker doesn't need, those of broken-off writers too."""
        state = self.state()
        fs, path = self._fs()
        for s in fs.listStatus(path(self.path)):
            if s.getPath().getName().startswith("c-") and s.getPath().getName() not in state["changes"]:
                fs.delete(s.getPath(), True)
        for s in fs.listStatus(path(f"{self.path}/_log")):
            if s.getPath().getName() != f"{state['number']:08d}.json":
                fs.delete(s.getPath(), True)

    def drop(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path), True)
