"""Objects, prompt assets and their records: lookups, classes and conversions of one row's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodium.operators.datasets import diagonal_concat


def object_metadata(objects: Column) -> Column:
    """A map from object id to (obj_name, brand, texture) as an array of structs."""
    return F.transform(
        F.map_entries(objects),
        lambda e: F.struct(
            e["key"].alias("obj_id"),
            e["value"]["obj_name"].alias("obj_name"),
            e["value"]["brand"].alias("obj_asset_name"),
            e["value"]["texture"].alias("texture_name"),
        ),
    )


def placeholder_class(members: DataFrame, by: str, member: str, description: str) -> DataFrame:
    """Per asset how many descriptions it has, whether that makes it an object or a scene, and an object's words."""
    assets = members.groupBy(by).agg(F.countDistinct(member).alias("descriptions"), F.min(description).alias("__d"))
    single = F.col("descriptions") == 1
    return assets.select(
        by,
        "descriptions",
        F.when(single, "object").otherwise("scene").alias("kind"),
        F.when(single, F.col("__d")).alias("description"),
    )


def asset_named(assets: Column, name: Column) -> Column:
    """The asset of a name, or of a ``{placeholder}``; NULL if there is none."""
    return F.try_element_at(assets, F.regexp_replace(name, r"[{}]", ""))


def typed_asset(descriptions: Column) -> Column:
    """Descriptions of a raw prompt asset as (is_object, descriptions, names): one is an object, more a scene."""
    return F.struct(
        (F.size(descriptions) == 1).alias("is_object"),
        F.size(descriptions).alias("descriptions"),
        F.array_join(F.transform(descriptions, lambda x: x["name"]), ",").alias("names"),
    )


def corners(x0: Column, y0: Column, w: Column, h: Column) -> tuple[Column, Column]:
    """(x1, y1) of a box given by its first corner and its size."""
    return x0 + w, y0 + h


def centre(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """(x centre, y centre) of a box, rounded down to whole pixels."""
    return F.floor((x0 + x1) / 2), F.floor((y0 + y1) / 2)


def scaled(sizes: Column, by: float | list[float]) -> Column:
    """Sizes times a number, or axis by axis times a list of them."""
    if isinstance(by, list):
        return F.zip_with(F.array(*[F.lit(b) for b in by]), sizes, lambda b, s: b * s)
    return F.transform(sizes, lambda s: s * by)


def without_sampling(meta: Column) -> Column:
    """Task properties without what only decides how often a task is drawn."""
    return F.map_filter(meta, lambda k, _: k != "sample_prob")


def placeholder_records(rows: DataFrame, is_object: Column, key: str) -> DataFrame:
    """One record per placeholder: an object with its id, colour and size, or a texture with its value.

    ``rows`` have noun, texture, size, value, meta (a map) and ``key``, the object's id.
    """
    named = rows.withColumn("meta_keys", F.array_join(F.array_sort(F.map_keys(without_sampling(F.col("meta")))), ","))
    objects = named.where(is_object).select(
        key,
        F.lit("object").alias("record"),
        F.col("noun").alias("name"),
        F.col(key).alias("obj_id"),
        F.col("texture").alias("color"),
        (F.col("size").cast("double") / 10).alias("scaling"),
        "meta_keys",
    )
    textures = named.where(~is_object).select(
        key,
        F.lit("texture").alias("record"),
        F.col("texture").alias("name"),
        F.col("value").alias("color_value"),
        "meta_keys",
    )
    return diagonal_concat([objects, textures])


def objects_by_view(items: DataFrame, by: list[str], views: list[str]) -> DataFrame:
    """How many objects each view of an observation shows, and how many all of them do."""
    return items.groupBy(*by).agg(
        *[F.count_if(F.col("view") == view).alias(f"{view}_objects") for view in views],
        F.count(F.lit(1)).alias("objects"),
    )
