"""Request texts to tables of parameters, way-points and no-go areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import fixed


def parameters(url) -> Column:
    """The parameters after ``?``; values are URL-decoded."""
    query = F.regexp_extract(url, r"\?(.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: F.contains(p, F.lit("=")))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.url_decode(F.regexp_replace(p, "^[^=]*=", "")).alias("v"))))


def waypoints(requests: DataFrame, req: str = "req_id", lonlats: str = "lonlats") -> DataFrame:
    """Points ``lon,lat[,name|d|m]`` separated by ``|`` or ``;``: seq from 0, position, name and kind (0 way, 1 shaping, 2 meeting, 3 direct)."""
    rows = requests.select(req, F.posexplode(F.split(lonlats, "[|;]")).alias("seq", "t"))
    p = F.split("t", ",")
    third = F.when(F.size(p) > 2, p[2])
    kind = F.when(third == "d", 3).when(third == "m", 2).when(third.isNull(), 1).otherwise(0)
    name = F.when(third.isin("d", "m") | third.isNull(), F.concat(F.lit("via"), F.col("seq").cast("string"))).otherwise(third)
    return rows.select(req, "seq", fixed(p[0].try_cast("double"), 180).alias("ilon"), fixed(p[1].try_cast("double"), 90).alias("ilat"), name.alias("name"), kind.cast("tinyint").alias("wpttype"))


def nogos(requests: DataFrame, req: str = "req_id", text: str = "nogos") -> DataFrame:
    """Circles ``lon,lat,radius[,weight]``; without a weight (null) the area is forbidden."""
    rows = requests.select(req, F.posexplode(F.split(text, "[|]")).alias("seq", "t"))
    p = F.split("t", ",")
    weight = F.when(F.size(p) > 3, p[3].try_cast("double"))
    return rows.select(req, "seq", F.lit("circle").alias("kind"), fixed(p[0].try_cast("double"), 180).alias("ilon"), fixed(p[1].try_cast("double"), 90).alias("ilat"), F.coalesce(p[2].try_cast("double"), F.lit(20.0)).alias("radius"), F.when(~F.isnan(weight), weight).alias("weight"))
