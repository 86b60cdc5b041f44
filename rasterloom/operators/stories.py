"""Stored stories and the migration of older documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PT = "struct<x:double,y:double>"

#: What a waypoint may hold, in this and in older spellings.
WAYPOINT = "struct<id:string,shapeIds:array<string>,shapes:array<string>,groupId:string,group:string,thumbnail:string,title:string,name:string,content:string>"

#: What a shape may hold, in this and in older spellings.
SHAPE = f"struct<id:string,uuid:string,type:string,point:{PT},`from`:{PT},`to`:{PT},angle:double,label:string,text:string,points:array<{PT}>>"

DOCUMENT = f"struct<version:string,waypoints:array<{WAYPOINT}>,shapes:array<{SHAPE}>,channelGroups:array<struct<id:string,name:string>>,groups:array<struct<id:string,name:string>>,metadata:struct<title:string,created:string,createdAt:string,modified:string,modifiedAt:string,keywords:array<string>>>"


def parsed(rows: DataFrame, json: str) -> DataFrame:
    """rows with the document as a struct doc; text that isn't JSON gives null."""
    return rows.withColumn("doc", F.from_json(json, DOCUMENT, {"mode": "PERMISSIVE"}))


def variant(doc: Column) -> Column:
    """Which root a document has: 'export', 'groups' (an older one) or 'modern'."""
    return F.when(doc["version"].isNotNull() & doc["channelGroups"].isNull() & doc["groups"].isNull(), "export").when(doc["channelGroups"].isNull() & doc["groups"].isNotNull(), "groups").otherwise("modern")


def groups_of(doc: Column) -> Column:
    return F.coalesce(doc["channelGroups"], doc["groups"], F.expr("cast(array() as array<struct<id:string,name:string>>)"))


def waypoint(w: Column) -> Column:
    """A waypoint in today's spelling."""
    none = F.expr("cast(array() as array<string>)")
    return F.struct(
        w["id"].alias("id"), F.coalesce(w["groupId"], w["group"]).alias("group_id"), F.coalesce(w["thumbnail"], F.lit("")).alias("thumbnail"),
        F.coalesce(w["title"], w["name"], F.lit("")).alias("title"), F.coalesce(w["content"], F.lit("")).alias("content"), F.coalesce(w["shapeIds"], w["shapes"], none).alias("shape_ids"),
    )


def shape(s: Column) -> Column:
    """A shape in today's spelling: an arrow between two points keeps its tip and gets the angle back to its tail."""
    back = F.atan2(s["from"]["y"] - s["to"]["y"], s["from"]["x"] - s["to"]["x"])
    return F.struct(F.coalesce(s["id"], s["uuid"]).alias("id"), s["type"].alias("type"), F.coalesce(s["point"], s["to"]).alias("point"), F.coalesce(s["angle"], F.when(s["to"].isNotNull(), back)).alias("angle"), F.coalesce(s["label"], s["text"], F.lit("")).alias("label"))


def metadata_dates(doc: Column) -> tuple[Column, Column]:
    m = doc["metadata"]
    return F.coalesce(m["createdAt"], m["created"]), F.coalesce(m["modifiedAt"], m["modified"])


def clean_list(c: Column) -> Column:
    """Trimmed texts without blanks; null if none is left."""
    kept = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept)


def shape_violations(s: Column) -> Column:
    """What is wrong with a shape, or null: polygons need three points, polylines two, others a point."""
    n = F.coalesce(F.size(s["points"]), F.lit(0))
    return F.when(s["type"] == "polygon", F.when(n < 3, "polygon needs 3 points")).when(s["type"] == "polyline", F.when(n < 2, "polyline needs 2 points")).when(s["type"].isin("point", "arrow", "text"), F.when(s["point"].isNull(), "no point")).otherwise("unknown type")


def upserted(stories: DataFrame, fresh: DataFrame) -> DataFrame:
    """stories (id, created, modified, title) after saving fresh ones (id, created or null, now, title)."""
    old = stories.select("id", F.col("created").alias("__created"))
    new = fresh.join(old, "id", "left").select("id", F.coalesce("created", "__created", "now").alias("created"), F.col("now").alias("modified"), "title")
    return stories.join(fresh.select("id"), "id", "left_anti").select("id", "created", "modified", "title").unionByName(new)


def summary_title(title: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("Untitled"))


def active_story(stories: DataFrame, stored: str) -> DataFrame:
    """The stored story if it is there, else the newest."""
    return stories.orderBy((F.col("id") == stored).desc(), F.col("modified").desc(), "id").limit(1)


def with_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key begins with the prefix: a range, which Parquet statistics can skip by."""
    return rows.where(F.col(key).startswith(prefix))
