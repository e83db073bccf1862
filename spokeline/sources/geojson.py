"""GeoJSON line networks and paged extracts as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, geo

SCHEMA = (
    "features array<struct<geometry:struct<type:string,coordinates:string>,"
    "properties:struct<ConnectionType:string,StreetName:string,FromStreet:string,ToStreet:string,highway:string,name:string>>>, exceededTransferLimit boolean"
)


def features(spark: SparkSession, *paths: str) -> DataFrame:
    """One row for each feature of FeatureCollection files: sid (file order, then place), geometry type, raw coordinates, properties."""
    docs = spark.read.schema(SCHEMA).json(list(paths), multiLine=True).select(F.input_file_name().alias("file"), F.posexplode("features").alias("pos", "f"))
    return docs.select("file", "pos", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), "f.properties.*")


def document(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature of a document as paged.write_document writes it, a feature a line: many tasks read it, each a part of its lines.

    Any other FeatureCollection is for features(), which reads a file as a whole.
    """
    feature = SCHEMA[len("features array<") : SCHEMA.index(">, exceededTransferLimit")]
    text = F.rtrim(F.regexp_replace("value", r",\s*\z", ""))
    lines = spark.read.text(path).select(text.alias("text")).where(F.col("text").startswith("{") & F.col("text").endswith("}"))
    return lines.select(F.from_json("text", feature).alias("f")).select(F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"), "f.properties.*")


def load(spark: SparkSession, network: str, roads: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Features of the network, which must be there, and of the roads, which may be missing: no rows then, of the same columns.

    A network that is missing is an error here, not a first job's; a file that is there but is no collection gives no features.
    """

    def there(path: str) -> bool:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
        return found is not None and len(found) > 0

    if not there(network):
        raise FileNotFoundError(network)
    net = features(spark, network)
    return net, features(spark, roads) if roads is not None and there(roads) else spark.createDataFrame([], net.schema)


def vertices(rows: DataFrame, key: str = "sid") -> DataFrame:
    """Vertices of line geometries, (lng, lat) swapped: key, part, seq, lat, lng, ele. Other geometries give none."""
    one = F.from_json("coordinates", "array<array<double>>")
    many = F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("type") == "LineString", F.array(one)).when(F.col("type") == "MultiLineString", many)
    p = rows.select(key, F.posexplode(parts).alias("part", "line")).select(key, "part", F.posexplode("line").alias("seq", "c"))
    return p.select(key, "part", "seq", F.get("c", F.lit(1)).alias("lat"), F.get("c", F.lit(0)).alias("lng"), F.coalesce(F.get("c", F.lit(2)), F.lit(0.0)).alias("ele"))


def rejected(rows: DataFrame) -> DataFrame:
    """Features without a geometry."""
    return rows.where("type is null")


def quantised(v: DataFrame) -> DataFrame:
    return v.withColumns({"lat": geo.quantise(F.col("lat")), "lng": geo.quantise(F.col("lng"))})


def roads_in(v: DataFrame, box: tuple[float, float, float, float], key: str = "road") -> DataFrame:
    """All vertices of the roads of the extracted classes that have one within (min_lat, min_lng, max_lat, max_lng): a road that leaves the box stays whole."""
    classed = v.where(F.col("highway").isin(*dims.ROAD_CLASSES))
    inside = classed.where(F.col("lat").between(box[0], box[2]) & F.col("lng").between(box[1], box[3]))
    return classed.join(inside.select(key).distinct(), key, "left_semi")


def pages(spark: SparkSession, path: str, page_size: int = 1000) -> DataFrame:
    """Landed pages (page number in the file name) up to the first that is empty or ends the transfer."""
    docs = spark.read.schema(SCHEMA).json(path, multiLine=True)
    docs = docs.select(F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("int").alias("page"), "features", F.coalesce("exceededTransferLimit", F.lit(False)).alias("more"))
    n = F.coalesce(F.size("features"), F.lit(0))
    stops = docs.where((n == 0) | ~(F.col("more") | (n >= page_size))).agg(F.min("page").alias("stop"))
    stop = stops.first()["stop"]  # one number
    return docs.where(F.lit(True) if stop is None else F.col("page") <= stop).select("page", F.posexplode("features").alias("pos", "f"))


def write_collection(rows: DataFrame, path: str) -> None:
    """Features (geometry, properties structs) as lines of JSON, one feature each, written in parallel."""
    rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), "geometry", "properties")).alias("value")).write.text(path)
