"""Paged feature extracts as a data source, read a page a task, with filters applied while reading; and a writer of one FeatureCollection.

    paged.register(spark)
    spark.read.format("paged_features").schema("page int, pos int, type string, coordinates string").load(folder)

The schema chosen is what leaves the source: columns of the feature (type, coordinates, any property), its place (page, pos), its box (min_lat, max_lat, min_lng, max_lng), or,
where no column is of a feature, one row a page: page, features (how many), more (whether the server says that more follows). Filters on these
columns that compare with values are applied before a row leaves the source.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

PLACE, BOX, SUMMARY = ("page", "pos"), ("min_lat", "max_lat", "min_lng", "max_lng"), ("page", "features", "more")
NUMBER = re.compile(r"(\d+)(?:\.json)?/?$")
DEFAULT = "page int, pos int, type string, coordinates string, ConnectionType string, StreetName string, highway string, name string, min_lat double, max_lat double, min_lng double, max_lng double"


def files_of(path: str):
    """File system and path of a folder, local or remote, as executors and the driver reach it."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
    return system, inner


class Page(InputPartition):
    def __init__(self, number: int, files: list[str]):
        super().__init__(number)
        self.number, self.files = number, files


def box(coordinates) -> list[float | None]:
    """min_lat, max_lat, min_lng, max_lng of nested coordinates."""
    points, todo = [], [coordinates or []]
    while todo:
        x = todo.pop()
        if x and not isinstance(x[0], list):
            points.append(x)
        else:
            todo += x
    if not points:
        return [None] * 4
    return [f(p[k] for p in points) for k in (1, 0) for f in (min, max)]


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.fieldNames()
        self.numbers = {f.name for f in schema.fields if not isinstance(f.dataType, (StringType, BooleanType, IntegerType, LongType))}
        self.path, self.last = options["path"], int(options.get("last_page", -1))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what compares a column with values; gives the rest back."""
        kinds = {EqualTo: "eq", In: "in", LessThan: "lt", LessThanOrEqual: "le", GreaterThan: "gt", GreaterThanOrEqual: "ge", IsNotNull: "some"}
        for f in filters:
            kind = kinds.get(type(f))
            if kind and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """One for each page: a folder page=N or a file N.json."""
        from pyarrow import fs

        system, inner = files_of(self.path)
        pages: dict[int, list[str]] = {}
        for info in system.get_file_info(fs.FileSelector(inner, recursive=True)):
            at = info.path[len(inner) :].strip("/")
            m = NUMBER.search(at.split("/")[0])
            if info.type == fs.FileType.File and m and not at.split("/")[-1].startswith((".", "_")):
                pages.setdefault(int(m[1]), []).append(info.path)
        wanted = [n for n in sorted(pages) if (self.last < 0 or n <= self.last) and self.passes({"page": n}, only="page")]
        return [Page(n, pages[n]) for n in wanted] or [Page(-1, [])]

    def passes(self, row: dict, only: str | None = None) -> bool:
        for name, kind, value in self.tests:
            if only and name != only:
                continue
            x = row.get(name)
            if x is None or (kind == "eq" and x != value) or (kind == "in" and x not in value) or (kind == "lt" and not x < value) or (kind == "le" and not x <= value) or (kind == "gt" and not x > value) or (kind == "ge" and not x >= value):
                return False
        return True

    def read(self, partition: Page) -> Iterator[tuple]:
        system, _ = files_of(self.path)
        features, more = [], False
        for file in partition.files:
            with system.open_input_stream(file) as f:
                document = json.loads(f.read() or b"{}")
            features += document.get("features") or []
            more = more or document.get("exceededTransferLimit") is True
        if set(self.columns) <= set(SUMMARY):
            row = {"page": partition.number, "features": len(features), "more": more}
            if partition.files and self.passes(row):
                yield tuple(row[c] for c in self.columns)
            return
        for pos, feature in enumerate(features):
            geometry = feature.get("geometry") or {}
            row = dict(feature.get("properties") or {})
            row |= {"page": partition.number, "pos": pos, "type": geometry.get("type")}
            given = geometry.get("coordinates")
            row["coordinates"] = json.dumps(given, separators=(",", ":")) if given is not None else None
            if any(c in BOX for c in self.columns) or any(t[0] in BOX for t in self.tests):
                row |= zip(BOX, box(given), strict=True)
            if self.passes(row):
                yield tuple(float(v) if c in self.numbers and isinstance(v, int) else v for c in self.columns for v in (row.get(c),))


class PagedFeatures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return DEFAULT

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


# -- one document ---------------------------------------------------------------------------------
class Part(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


class CollectionWriter(DataSourceWriter):
    """Tasks write their features (column value: JSON texts) to parts beside the document; the commit joins the parts' bytes, and none of the features pass through as rows."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> Part:
        import uuid

        system, inner = files_of(self.path)
        system.create_dir(inner + ".parts", recursive=True)
        file, n = f"{inner}.parts/{uuid.uuid4().hex}", 0
        with system.open_output_stream(file) as out:
            for row in rows:
                out.write((",\n" if n else "").encode() + row["value"].encode())
                n += 1
        return Part(file if n else None)

    def commit(self, messages: list[Part | None]) -> None:
        system, inner = files_of(self.path)
        with system.open_output_stream(inner) as out:
            out.write(b'{"type":"FeatureCollection","features":[\n')
            for k, file in enumerate(m.file for m in messages if m is not None and m.file):
                out.write(b",\n" if k else b"")
                with system.open_input_stream(file) as part:
                    while piece := part.read(1 << 20):
                        out.write(piece)
            out.write(b"\n]}\n")
        self.clear()

    def abort(self, messages: list[Part | None]) -> None:
        self.clear()

    def clear(self) -> None:
        system, inner = files_of(self.path)
        try:
            system.delete_dir(inner + ".parts")
        except FileNotFoundError:
            pass


class FeatureCollection(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feature_collection"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return CollectionWriter(self.options["path"])


# -- use ------------------------------------------------------------------------------------------
def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(PagedFeatures)
    spark.dataSource.register(FeatureCollection)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read(spark: SparkSession, path: str, schema: str = DEFAULT, page_size: int = 1000) -> DataFrame:
    """Features of the pages up to the first that is empty or ends the transfer: it says that no more follows, and is not full.

    The end is one number, the least of the pages that stop, from a first look at the pages without their features.
    """
    pages = register(spark).read.format("paged_features").schema("page int, features int, more boolean").load(path)
    last = pages.where((F.col("features") == 0) | ~(F.col("more") | (F.col("features") >= page_size))).agg(F.min("page")).first()[0]
    source = spark.read.format("paged_features").schema(schema)
    return (source if last is None else source.option("last_page", last)).load(path)


def write_document(features: DataFrame, path: str) -> None:
    """Features (geometry, properties structs) as one FeatureCollection document."""
    rows = features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), "geometry", "properties")).alias("value"))
    register(features.sparkSession)
    rows.write.format("feature_collection").mode("append").save(path)
