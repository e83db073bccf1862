"""A keyed store on files: rows by key in hash buckets, point reads of one bucket, groups of rows put whole or not at all.

A store is a folder of Parquet files by version and bucket. The files of a change are written into a version folder of their own,
which nobody reads until the list of buckets that names it is renamed into place; of two changes at the same time, the second one fails and leaves
no trace. A change rewrites the buckets of its keys, the others stay as they are. What passes through the driver is this
list: a row for each bucket, whose number is fixed when the store is made.

Defined results: a group with a null key or the same key twice is refused as a whole; an absent key is no error in get() and delete(); an empty group changes
nothing; the columns are those of the first rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LISTS = "_lists"
BUCKET = "__bucket"


class Refused(ValueError):
    """A change that can't be made; the store is as it was."""


@dataclass
class Keyed:
    spark: SparkSession
    path: str
    key: str

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = 64) -> Keyed:
        """A new store of these rows. A bucket should be some hundred MB: choose `buckets` by the size that the table will have."""
        store = cls(rows.sparkSession, path.rstrip("/"), key)
        empty = {"number": 0, "buckets": buckets, "schema": rows.schema.json(), "places": {}}
        store._change(empty, rows, store._keys(rows, buckets))
        return store

    # -- reading ----------------------------------------------------------------------------------
    def read(self) -> DataFrame:
        """All rows."""
        state = self._state()
        return self._rows(state, state["places"])

    def get(self, *keys) -> DataFrame:
        """The rows of a few keys given by value: only files of their buckets are opened, and of these only what holds the keys by their statistics."""
        state = self._state()
        kind = StructType.fromJson(json.loads(state["schema"]))[self.key].dataType
        asked = [F.lit(k).cast(kind) for k in keys]
        at = self.spark.range(1).select(F.array(*(self._bucket(k, state["buckets"]) for k in asked))).first()[0] if asked else []
        return self._rows(state, {str(b) for b in at}).where(F.col(self.key).isin(*asked) if asked else F.lit(False))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of any number of keys (column of the key's name)."""
        return self.read().join(keys.select(self.key).distinct(), self.key, "left_semi")

    # -- changes ----------------------------------------------------------------------------------
    def put(self, rows: DataFrame) -> None:
        """Replace or add all rows of a group at once."""
        state = self._state()
        self._change(state, rows.select(*StructType.fromJson(json.loads(state["schema"])).names), self._keys(rows, state["buckets"]))

    def delete(self, keys: DataFrame) -> None:
        """Remove rows by key; keys may repeat."""
        state = self._state()
        self._change(state, None, self._keys(keys.where(F.col(self.key).isNotNull()).distinct(), state["buckets"]))

    def tidy(self) -> None:
        """Remove files that the newest list does not name: of earlier versions and of changes that were not made. Not while others read or change."""
        state, fs = self._state(), self._fs()
        used = set(state["places"].values())
        for there in fs.listStatus(self._at("")):
            name = there.getPath().getName()
            if name.startswith("v") and name not in used:
                fs.delete(there.getPath(), True)

    # -- files ------------------------------------------------------------------------------------
    def _bucket(self, key, buckets: int):
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _keys(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.select(self.key, self._bucket(F.col(self.key), buckets).alias(BUCKET))

    def _rows(self, state: dict, buckets) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        paths = [f"{self.path}/{state['places'][b]}/{BUCKET}={b}" for b in sorted(buckets) if b in state["places"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _change(self, state: dict, rows: DataFrame | None, keys: DataFrame) -> None:
        n = keys.groupBy(BUCKET).agg(F.count("*").alias("n"), F.count(self.key).alias("known"), F.count_distinct(self.key).alias("different")).collect()  # a row for each bucket at most
        if any(r["known"] < r["n"] for r in n):
            raise Refused(f"a row without {self.key}")
        if any(r["different"] < r["n"] for r in n):
            raise Refused(f"the same {self.key} twice")
        if not n and state["number"]:
            return
        touched = {str(r[BUCKET]) for r in n}
        version, fs = f"v{uuid.uuid4().hex}", self._fs()
        new = self._rows(state, touched).join(keys.select(self.key), self.key, "left_anti")
        new = new if rows is None else new.unionByName(rows)
        new = new.withColumn(BUCKET, self._bucket(F.col(self.key), state["buckets"])).hint("rebalance", BUCKET)
        new.sortWithinPartitions(BUCKET, self.key).write.partitionBy(BUCKET).parquet(f"{self.path}/{version}")
        made = {p.getPath().getName().partition("=")[2] for p in fs.listStatus(self._at(version))} - {""}
        places = {b: v for b, v in state["places"].items() if b not in touched} | {b: version for b in made & touched}
        self._name({**state, "number": state["number"] + 1, "places": places})

    def _name(self, state: dict) -> None:
        """Rename the new list into place, which fails if there is one of its number."""
        sc, jvm = self.spark.sparkContext, self.spark.sparkContext._jvm
        draft, last = self._at(f"{LISTS}/.{uuid.uuid4().hex}"), self._at(f"{LISTS}/{state['number']:012d}")
        out = self._fs().create(draft, False)
        out.write(json.dumps(state).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(draft, last, sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._fs().delete(draft, False)
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise Refused("another change was made meanwhile") from e
            raise

    def _state(self) -> dict:
        names = [p.getPath().getName() for p in self._fs().listStatus(self._at(LISTS))]
        last = max(n for n in names if n.isdigit())
        return json.loads(self.spark.read.text(f"{self.path}/{LISTS}/{last}", wholetext=True).first()[0])

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
