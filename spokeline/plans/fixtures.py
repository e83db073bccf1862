"""Network, trips and places derived from the driver's tables by integer arithmetic: one statement for both engines.

Fixes are made by steps in Spark (FRAMES), as it would meet every event with every route for the statement's join. Coordinates are integers in 1e-5 degrees, so that Spark and DuckDB make identical doubles of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CTS = ["MUP_P", "MUP_U", "BL-MUP", "NG", "BBL", "BL", "SR_LT", "SC", "BL-SR_LT", "SR_MT", "BL-SR_MT", "BL_VHT", "DC", "SR_DC", "BL-DC", "SR_MT-DC"]
HIGHWAYS = ["trunk", "primary", "secondary", "motorway", "trunk_link", "primary_link", "secondary_link", "motorway_link", "unknown"]

deg = lambda x: f"(CAST({x} AS DOUBLE) / CAST(100000 AS DOUBLE))"
div = lambda a, b: f"CAST(floor(({a}) / {b}.0) AS BIGINT)"
case = lambda x, values, other: f"CASE {x} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + f" ELSE '{other}' END"
numbers = lambda n: "(VALUES " + ", ".join(f"({i})" for i in range(n)) + ")"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

FIXTURES = {
    "fx_lines": f"""
        SELECT sid, a, a + step AS b, step, name,
               CASE WHEN sid % 2 = 1 THEN lower(ct) ELSE ct END AS ct_raw,
               4545000 + {div("a", 50)} * 90 + (sid % 7 - 3) AS lat0, -12270000 + (a % 50) * 115 + (sid % 7 - 3) AS lng0,
               4545000 + {div("a + step", 50)} * 90 + ((sid * 3) % 7 - 3) AS lat2, -12270000 + ((a + step) % 50) * 115 + ((sid * 3) % 7 - 3) AS lng2
        FROM (
          SELECT o_orderkey AS sid, o_custkey AS a, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 50 ELSE 51 END AS step,
                 {case("o_orderkey % 17", CTS, "")} AS ct,
                 CASE o_orderkey % 3 WHEN 0 THEN 'St ' || CAST({div("o_custkey", 50)} AS STRING) WHEN 1 THEN 'Ave ' || CAST(o_custkey % 50 AS STRING) ELSE '' END AS name
          FROM {{orders}} WHERE o_orderkey % 5 = 0
        ) o CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) c
        WHERE a + step < n AND NOT (a % 50 = 49 AND step <> 50)""",
    "fx_vertices": f"""
        SELECT sid, 0 AS part, 0 AS seq, {deg("lat0")} AS lat, {deg("lng0")} AS lng FROM {{fx_lines}}
        UNION ALL SELECT sid, 0, 1, {deg(div("lat0 + lat2", 2) + " + sid % 11 - 5")}, {deg(div("lng0 + lng2", 2) + " + sid % 13 - 6")} FROM {{fx_lines}}
        UNION ALL SELECT sid, CASE WHEN sid % 35 = 0 THEN 1 ELSE 0 END, CASE WHEN sid % 35 = 0 THEN 1 ELSE 2 END, {deg("lat2")}, {deg("lng2")} FROM {{fx_lines}}
        UNION ALL SELECT sid, 1, 0, {deg(div("lat0 + lat2", 2) + " + sid % 11 - 5")}, {deg(div("lng0 + lng2", 2) + " + sid % 13 - 6")} FROM {{fx_lines}} WHERE sid % 35 = 0""",
    "fx_road_vertices": f"""
        SELECT s_suppkey AS road, k AS seq, {case("s_nationkey % 9", HIGHWAYS, "unknown")} AS highway,
               CASE WHEN s_suppkey % 20 = 0 THEN {deg("4545045 + ((s_suppkey * 7) % 17) * 180")} ELSE {deg("4545000 + k * 700")} END AS lat,
               CASE WHEN s_suppkey % 20 = 0 THEN {deg("-12270000 + k * 1150")} ELSE {deg("-12269943 + ((s_suppkey * 3) % 49) * 115")} END AS lng
        FROM {{supplier}} CROSS JOIN {numbers(6)} t(k) WHERE s_suppkey % 10 = 0""",
    "fx_points": f"""
        SELECT c_custkey AS pid, {deg(f"4545000 + {div('c_custkey', 50)} * 90 + c_custkey % 60 - 30")} AS lat, {deg("-12270000 + (c_custkey % 50) * 115 + c_custkey % 90 - 45")} AS lng
        FROM {{customer}}""",
    "fx_od": f"""
        SELECT c_custkey AS od_id, 'safest' AS profile,
               {deg(f"4545000 + {div('c_custkey', 50)} * 90 + 20")} AS start_lat, {deg("-12270000 + (c_custkey % 50) * 115 + 20")} AS start_lng,
               {deg(f"4545000 + {div('(c_custkey * 31 + 17) % n', 50)} * 90 + 20")} AS end_lat, {deg("-12270000 + (((c_custkey * 31 + 17) % n) % 50) * 115 + 20")} AS end_lng
        FROM {{customer}} CROSS JOIN (SELECT count(*) AS n FROM {{customer}}) c WHERE c_custkey % 100 = 7""",
    "fx_route_vertices": f"""
        SELECT c_custkey AS route_id, k AS idx,
               {deg(f"4545000 + {div('c_custkey', 50)} * 90 + k * 37 + (k % 4) * 61 - (k % 7) * 90")} AS lat, {deg("-12270000 + (c_custkey % 50) * 115 + k * 61 - (k % 5) * 140")} AS lng,
               CAST((c_custkey * 7 + k * k) % 97 AS DOUBLE) AS ele
        FROM {{customer}} CROSS JOIN {numbers(24)} t(k) WHERE c_custkey % 100 = 7""",
    "fx_fixes": f"""
        SELECT event_id, user_id AS rider_id, ts, r.route_id, value,
               v.lat + {deg("CAST(floor(value) AS BIGINT) % 80 * 2 - 80")} AS lat, v.lng + {deg("event_id % 31 - 15")} AS lng,
               CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 360 AS DOUBLE) END AS heading
        FROM (SELECT event_id, user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM {{events}}) e
        JOIN (SELECT route_id, row_number() OVER (ORDER BY route_id) - 1 AS ordinal, count(*) OVER () AS routes FROM (SELECT DISTINCT route_id FROM {{fx_route_vertices}}) x) r ON user_id % routes = ordinal
        JOIN {{fx_route_vertices}} v ON v.route_id = r.route_id AND v.idx = CAST(floor((n - 1) * 23.0 / total) AS BIGINT)""",
    "fx_prefs": """
        SELECT sid AS insert_seq, sid, CASE WHEN sid % 97 = 0 THEN 'nogo' ELSE 'preferred' END AS type,
               CASE WHEN sid % 2 = 0 THEN 'g' || CAST(sid % 10 AS STRING) ELSE NULL END AS group_id
        FROM {fx_lines} WHERE sid % 97 = 0 OR sid % 89 = 0""",
    "fx_places": f"""
        SELECT s_suppkey AS place_id, CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 5 = 0 THEN 'Street ' || CAST(s_suppkey % 40 AS STRING) ELSE s_name END AS name,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Street ' || CAST(s_suppkey % 40 AS STRING) END AS street,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(100 + s_suppkey AS STRING) END AS housenumber,
               CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'Suburb ' || CAST(s_suppkey % 9 AS STRING) END AS suburb, 'District ' || CAST(s_suppkey % 3 AS STRING) AS district,
               n_name AS city, r_name AS state,
               {deg("4545000 + (s_suppkey * 131) % 3600")} AS lat, {deg("-12270000 + (s_suppkey * 173) % 5700")} AS lng
        FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey""",
    "fx_messages": """
        SELECT l_orderkey AS reply, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
               CAST(-122000000 - l_partkey * 100 AS STRING) AS lon, CAST(45000000 + l_suppkey * 100 AS STRING) AS lat,
               CASE l_linenumber % 5 WHEN 0 THEN 'TL' WHEN 1 THEN 'turn right' WHEN 2 THEN 'C' WHEN 3 THEN 'TU' ELSE 'slight' END AS direction,
               CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'Step ' || l_returnflag END AS message, CAST(CAST(l_quantity AS BIGINT) AS STRING) || 'm' AS distance
        FROM {lineitem}""",
    "fx_saved": """
        SELECT CAST(o_orderkey AS STRING) AS id, 'Route ' || CAST(o_custkey AS STRING) AS name, o_totalprice AS distance,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST((o_orderkey * 7919) % 1000 AS BIGINT) END AS created_at, o_orderkey % 4 AS fresh_code, o_orderkey % 3 AS cached_code
        FROM {orders}""",
}


def fixes(events: DataFrame, fx_route_vertices: DataFrame) -> DataFrame:
    """The rows of fx_fixes, with the number of routes known before the join: a rider's route is then found by equality."""
    own = Window.partitionBy("user_id")
    e = events.select("event_id", "user_id", "ts", "value", F.row_number().over(own.orderBy("ts", "event_id")).alias("n"), F.count("*").over(own).alias("total"))
    routes = fx_route_vertices.select("route_id").distinct()
    numbered = routes.select("route_id", (F.row_number().over(Window.orderBy("route_id")) - 1).cast("long").alias("ordinal"))
    e = e.crossJoin(F.broadcast(routes.agg(F.count("*").alias("routes")))).withColumn("ordinal", F.expr("user_id % nullif(routes, 0)")).join(numbered, "ordinal")
    v = fx_route_vertices.select("route_id", F.col("idx").cast("long").alias("at"), F.col("lat").alias("v_lat"), F.col("lng").alias("v_lng"))
    e = e.withColumn("at", F.expr("CAST(floor((n - 1) * 23.0 / total) AS BIGINT)")).join(v, ["route_id", "at"])
    lat, lng = (F.expr(deg(x)) for x in ("CAST(floor(value) AS BIGINT) % 80 * 2 - 80", "event_id % 31 - 15"))
    heading = F.when(F.expr("event_id % 7 = 0"), F.lit(float("nan"))).when(F.expr("event_id % 5 = 0"), None).otherwise(F.expr("event_id % 360").cast("double"))
    return e.select("event_id", F.col("user_id").alias("rider_id"), "ts", "route_id", "value", (F.col("v_lat") + lat).alias("lat"), (F.col("v_lng") + lng).alias("lng"), heading.alias("heading"))


FRAMES: dict[str, Callable[..., DataFrame]] = {"fx_fixes": fixes}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables = {n: fixture(spark, sf_dir, n) for n in needs(name)}
    return FRAMES[name](**tables) if name in FRAMES else spark.sql(FIXTURES[name], **tables)


@lru_cache(maxsize=None)
def needs(name: str) -> tuple[str, ...]:
    return tuple(n for n in [*TABLES, *FIXTURES] if "{" + n + "}" in FIXTURES[name])


def ctes(*names: str) -> str:
    """The same derived inputs as common table expressions for DuckDB."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in out:
            return
        for n in needs(name):
            add(n)
        out[name] = FIXTURES[name].format(**{n: n for n in needs(name)})

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({sql})" for n, sql in out.items())
