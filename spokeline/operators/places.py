"""Places: labels, provider cascade, bias box, nearest place, typed queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..storage import written

LIMIT, MIN_SPAN, MIN_QUERY = 5, 0.25, 3
#: Cells around a point that are looked at before all within reach, smallest first.
RINGS_DEG = (0.001, 0.004)


def _text(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def is_named() -> Column:
    """A place with a name of its own, not just an address."""
    name = _text("name")
    return name.isNotNull() & ~name.eqNullSafe(F.col("street")) & ~name.eqNullSafe(F.col("housenumber"))


def labels(places: DataFrame) -> DataFrame:
    """place_id, label and detail of places (name, street, housenumber, suburb, district, city, state)."""
    number, street = _text("housenumber"), _text("street")
    address = F.when(number.isNotNull() & street.isNotNull(), F.concat(number, F.lit(" "), street)).otherwise(street)
    label = F.when(is_named(), F.col("name")).otherwise(F.coalesce(address, _text("name"), F.lit("Unknown location")))
    detail = F.concat_ws(", ", F.when(is_named(), address), F.coalesce(_text("suburb"), _text("district")), _text("city"), _text("state"))
    return places.select("place_id", label.alias("label"), detail.alias("detail"))


def split_label(places: DataFrame) -> DataFrame:
    """label and detail of the second provider's comma-separated display name; lat and lon are texts."""
    parts = F.split("display_name", ",")
    label = F.coalesce(_text("name"), F.get(parts, F.lit(0)))
    return places.select("place_id", label.alias("label"), F.trim(F.array_join(F.slice(parts, 2, 3), ",")).alias("detail"), F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lng"))


def address_label(rows: DataFrame) -> DataFrame:
    """place_id and label of the second provider's reverse replies (house_number, road, name, display_name): the address if it has a road, else the
    name, else the display name up to its first comma; null where nothing of it is there. Empty texts count as missing."""
    number, road = _text("house_number"), _text("road")
    first = F.nullif(F.get(F.split("display_name", ","), F.lit(0)), F.lit(""))
    return rows.select("place_id", F.coalesce(F.concat(number, F.lit(" "), road), road, _text("name"), first).alias("label"))


def search(queries: DataFrame, places: DataFrame, others: DataFrame, limit: int = LIMIT) -> DataFrame:
    """query_id, tier, place_id, rank: hits in the box, else anywhere, else of the other provider; `limit` rows each.

    queries: query_id, text, the box min_lat..max_lng, and maybe a bias point (bias_lat, bias_lng): hits near it come first, to the metre, hits of the other
    provider and queries without a point go by place_id alone. Hits are names that begin with the text, compared in lower case;
    the join is on the text's first letters, so each query meets its own names only.

    Of a text that many queries ask for without a point, the first `limit` hits anywhere are found once, whoever asks. Boxes meet the places in their grid cells. Only queries with a point whose
    box holds no hit meet all hits of their text.
    """
    c = F.col
    said, head = F.lower("text").alias("said"), F.lower(F.substring("text", 1, MIN_QUERY)).alias("head")
    q = queries.where(F.length("text") >= MIN_QUERY).select("*", said, head)
    heads = lambda df: df.withColumn("head", F.lower(F.substring("name", 1, MIN_QUERY)))
    p = heads(places).select("head", "place_id", F.lower("name").alias("name"), "lat", "lng")
    biased = {"bias_lat", "bias_lng"} <= set(queries.columns)
    away = F.round(geo.haversine(c("lat"), c("lng"), c("bias_lat"), c("bias_lng"))) if biased else F.lit(None).cast("double")
    hit = F.struct(away.isNull().alias("nowhere"), away.alias("away"), "place_id").alias("hit")
    begins = c("name").startswith(c("said"))

    side = box_side(q)
    boxes = boxed = q.where("min_lat <= max_lat and min_lng <= max_lng")
    for axis, x in (("lat", "x"), ("lng", "y")):
        boxes = boxes.withColumn(x, F.explode(F.sequence(F.floor(c(f"min_{axis}") / side), F.floor(c(f"max_{axis}") / side))))
    inside = c("lat").between(c("min_lat"), c("max_lat")) & c("lng").between(c("min_lng"), c("max_lng"))
    at = p.withColumns({"x": F.floor(c("lat") / side), "y": F.floor(c("lng") / side)})
    found = []
    if biased:  # around the point first: done where `limit` hits are nearer than anything beyond the nine cells
        left = boxed.where(c("bias_lat").isNotNull() & c("bias_lng").isNotNull())
        for ring in RINGS_DEG:
            cell = lambda x: F.floor(c(x) / F.lit(ring))  # noqa: E731, B023
            asked = left.withColumns({"x": F.explode(F.sequence(cell("bias_lat") - 1, cell("bias_lat") + 1))}).withColumn("y", F.explode(F.sequence(cell("bias_lng") - 1, cell("bias_lng") + 1)))
            sure = geo.clear_metres(c("bias_lat"), ring) - 1  # a metre, as distances are rounded
            hits = asked.join(p.withColumns({"x": cell("lat"), "y": cell("lng")}), ["head", "x", "y"]).where(begins & inside & (away < sure)).select("query_id", hit)
            got = _firsts(hits, "query_id", limit)
            full = got.where(F.col("rank") == limit).select("query_id")
            found.append(written(got.join(full, "query_id", "left_semi")))
            left = written(left.join(found[-1].select("query_id").distinct(), "query_id", "left_anti"))
        boxes = boxes.join(left.select("query_id"), "query_id", "left_semi").unionByName(boxes.where(c("bias_lat").isNull() | c("bias_lng").isNull()))
    near = _firsts(boxes.join(at, ["head", "x", "y"]).where(begins & inside).select("query_id", hit), "query_id", limit)
    for f in found:
        near = near.unionByName(f)
    near = written(near)
    rest = written(q.join(near.select("query_id").distinct(), "query_id", "left_anti"))

    def shared(asked: DataFrame, there: DataFrame) -> DataFrame:
        """Queries with the first hits of their text by place_id."""
        hits = asked.select("said", "head").distinct().join(there, "head").where(begins)
        firsts = _firsts(hits.select("said", F.struct(F.lit(True).alias("nowhere"), F.lit(None).cast("double").alias("away"), "place_id").alias("hit")), "said", limit)
        return asked.select("query_id", "said").join(firsts, "said").select("query_id", "hit", "rank")

    has_point = (c("bias_lat").isNotNull() & c("bias_lng").isNotNull()) if biased else F.lit(False)
    wide = shared(rest.where(~has_point), p)
    if biased:
        wide = wide.unionByName(_firsts(rest.where(has_point).join(p, "head").where(begins).select("query_id", hit), "query_id", limit))
    wide = written(wide)
    unanswered = rest.join(wide.select("query_id").distinct(), "query_id", "left_anti")
    third = shared(unanswered, heads(others).select("head", "place_id", F.lower("name").alias("name")))
    tiers = [df.select("query_id", F.lit(k).alias("tier"), c("hit.place_id").alias("place_id"), "rank") for k, df in ((1, near), (2, wide), (3, third))]
    return tiers[0].unionByName(tiers[1]).unionByName(tiers[2])


def box_side(queries: DataFrame) -> float:
    """The side in degrees of the grid that boxes are met on: a third of the mean side of at most 2 degrees of the boxes, and at least a thirtieth of the largest, so that no box is in more than a thousand cells or so."""
    sides = F.greatest(F.col("max_lat") - F.col("min_lat"), F.col("max_lng") - F.col("min_lng"))
    mean, most = queries.agg(F.avg(F.least(sides, F.lit(2.0))), F.max(sides)).first()
    return max(0.001, (mean or 0.0) / 3, (most or 0.0) / 30)


def _firsts(hits: DataFrame, key: str, limit: int) -> DataFrame:
    """key, hit and rank of the least `limit` hits of each key; each task keeps no more of its own before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("hit"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= limit).select(key, "hit", "rank")


def bias_box(views: DataFrame) -> DataFrame:
    """Boxes padded evenly to MIN_SPAN degrees on each axis."""
    pad = lambda lo, hi: F.greatest((F.lit(MIN_SPAN) - (F.col(hi) - F.col(lo))) / 2, F.lit(0.0))
    x, y = pad("min_lng", "max_lng"), pad("min_lat", "max_lat")
    return views.select("view_id", (F.col("min_lng") - x).alias("min_lng"), (F.col("min_lat") - y).alias("min_lat"), (F.col("max_lng") + x).alias("max_lng"), (F.col("max_lat") + y).alias("max_lat"))


def nearest(points: DataFrame, places: DataFrame, reach: int = 30) -> DataFrame:
    """pid, place_id and metres of the nearest place within `reach` grid cells (reverse lookup).

    Points meet the places of the nine smallest cells around them first; those that find none nearer than anything beyond meet those of larger cells. Places at the same spot are one, the
    first of them.
    """
    from .spatial import around, within

    c = F.col
    spots = places.groupBy("lat", "lng").agg(F.min("place_id").alias("place_id"))
    d = geo.haversine(c("p_lat"), c("p_lng"), c("lat"), c("lng"))
    left, found = points.select("pid", "lat", "lng"), []
    cells = {"cell_lat": geo.cell(c("lat")), "cell_lng": geo.cell(c("lng"))}
    spots = written(spots.withColumns(cells))
    for r in sorted({min(r, reach) for r in (1, 4, reach)}):
        p = around(left.withColumns(cells), r).select("pid", c("lat").alias("p_lat"), c("lng").alias("p_lng"), "x", "y")
        hits = p.join(within(spots, r), ["x", "y"]).withColumn("d", d)
        if r < reach:
            hits = hits.where(c("d") < geo.clear_metres(c("p_lat"), r / geo.CELLS_PER_DEGREE))
        best = hits.groupBy("pid").agg(F.min(F.struct("d", "place_id")).alias("b")).select("pid", "b.place_id", c("b.d").alias("metres"))
        found.append(written(best) if r < reach else best)
        if r < reach:
            left = left.join(found[-1].select("pid"), "pid", "left_anti")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def debounced(events: DataFrame, gap_ms: int = 300) -> DataFrame:
    """The last event of each burst of a session: events closer than the gap belong to one burst. events: session, seq, ts, query."""
    after = F.lead("ts").over(Window.partitionBy("session").orderBy("ts", "seq"))
    quiet = after.isNull() | ((F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) >= gap_ms * 1000)
    return events.withColumn("quiet", quiet).where("quiet").drop("quiet")


def latest_reply(replies: DataFrame) -> DataFrame:
    """The reply of the newest request of each session. replies: session, request_id, reply."""
    return replies.groupBy("session").agg(F.max_by(F.struct("request_id", "reply"), "request_id").alias("r")).select("session", "r.*")


MOVED_DEG = 0.0001


def still_wanted(replies: DataFrame) -> DataFrame:
    """Replies whose point has not moved since it was asked for: lat and lng asked, now_lat and now_lng."""
    return replies.where((F.abs(F.col("now_lat") - F.col("lat")) < MOVED_DEG) & (F.abs(F.col("now_lng") - F.col("lng")) < MOVED_DEG))


def home_suggested(typed: DataFrame) -> DataFrame:
    """Typed texts (box, query) too short to search that begin the word home, in the start box only."""
    q = F.trim("query")
    return typed.where((F.col("box") == "start") & (F.length(q) > 0) & (F.length(q) < MIN_QUERY) & F.lit("home").startswith(F.lower(q)))
