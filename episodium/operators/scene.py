"""Objects, poses and pixels: matching joins, detections, height maps."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodium import dims
from episodium.functions import pose as P
from episodium.functions.joins import large


def object_ids(*views: Column) -> Column:
    """Ids seen in any of the views, without the background."""
    seen = F.array_distinct(F.concat(*views))
    return F.array_except(seen, F.array(*[F.lit(i).cast("bigint") for i in dims.BACKGROUND_IDS]))


def missing_names(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows with ``found``: whether the name is in the catalogue."""
    known = names.select(F.col(key)).distinct().withColumn("__known", F.lit(True))
    return rows.join(known, key, "left").withColumn(
        "found", F.col("__known").isNotNull()
    ).drop("__known")


def dark_pairs(names: DataFrame) -> DataFrame:
    """Each light name with its ``dark`` variant, NULL where there is none."""
    distinct = names.select("name").distinct()
    light = distinct.where(~F.startswith("name", F.lit("dark "))).select(F.col("name").alias("light"))
    dark = distinct.where(F.startswith("name", F.lit("dark "))).select(
        F.substring("name", 6, 1000).alias("light"), F.col("name").alias("dark")
    )
    return light.join(dark, "light", "left")


def palette_extreme(channels: list[Column], palette: list[tuple[float, ...]], farthest: bool = False) -> Column:
    """Position of the nearest (or farthest) colour of a literal palette, evaluated in place."""
    entries = F.array(
        *[
            F.struct(
                P.distance(*[(c, F.lit(float(v))) for c, v in zip(channels, colour, strict=True)]).alias("d"),
                F.lit(-i if farthest else i).alias("i"),
            )
            for i, colour in enumerate(palette)
        ]
    )
    return F.abs((F.array_max(entries) if farthest else F.array_min(entries))["i"])


# --- joins by distance ----------------------------------------------------------------------------


def _cells(x: Column, y: Column, reach: float) -> list[Column]:
    return [F.floor(x / F.lit(reach)), F.floor(y / F.lit(reach))]


def near_candidates(left: DataFrame, right: DataFrame, reach: float, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a grid cell, the right side copied to the nine cells around it.

    Points closer than ``reach`` then share a cell, so the distance join is an equi join that
    spreads even one crowded group over all its cells.
    """
    cell = ["__cx", "__cy"]
    cx, cy = _cells(F.col("x"), F.col("y"), reach)
    around = F.array(
        *[F.struct((cx + i).alias("__cx"), (cy + j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    )
    a = left.withColumns(dict(zip(cell, [cx, cy], strict=True)))
    b = right.select("*", F.explode(around).alias("__c")).select(*right.columns, "__c.*")
    return a, b, [*keys, *cell]


def _renamed(frame: DataFrame, columns: list[str], prefix: str) -> DataFrame:
    return frame.withColumnsRenamed({c: prefix + c for c in columns})


def pose_matches(
    objects: DataFrame,
    targets: DataFrame,
    keys: list[str],
    how: str = "inner",
    position_only: bool = False,
    crowded: bool = False,
) -> DataFrame:
    """Objects joined to targets of the same group whose poses match.

    Objects carry x, y, angle, symmetry; targets x, y, angle.  ``how`` may be ``left_semi``.  A
    group normally has a handful of targets, and the group key is enough.  ``crowded`` is for groups
    with many targets and joins by grid cell as well.
    """
    if crowded:
        a, b, equal = near_candidates(objects, targets, 2 * dims.POSITION_TOLERANCE, keys)
    else:
        a, b, equal = objects, targets, keys
    b = _renamed(b, [c for c in b.columns if c not in equal], "target_")
    condition = P.poses_match(
        F.col("x"), F.col("y"), F.col("angle"),
        F.col("target_x"), F.col("target_y"), F.col("target_angle"),
        F.col("symmetry"), position_only,
    )
    b = _renamed(b, equal, "r_")
    for k in equal:
        condition = condition & (F.col(k) == F.col("r_" + k))
    joined = a.join(large(b), condition, how)
    return joined.drop("__cx", "__cy", *["r_" + k for k in equal])


def allowed_matches(objects: DataFrame, targets: DataFrame, allowed: DataFrame, position_only: bool = False) -> DataFrame:
    """(idx, t, k) of the allowed pairs of an object and a target whose poses match.

    Objects carry idx, t, a pose and symmetry; targets idx, k and a pose; ``allowed`` the pairs
    (idx, t, k) that may match.  Both joins are on an object or a target, so an episode with many of
    both builds no pairs beyond the allowed ones.
    """
    place = ["x", "y", "angle"]
    pairs = (
        allowed.select("idx", "t", "k")
        .distinct()
        .join(large(objects.select("idx", "t", *place, "symmetry")), ["idx", "t"])
        .join(large(_renamed(targets.select("idx", "k", *place), place, "target_")), ["idx", "k"])
    )
    matching = P.poses_match(
        F.col("x"), F.col("y"), F.col("angle"),
        F.col("target_x"), F.col("target_y"), F.col("target_angle"),
        F.col("symmetry"), position_only,
    )
    return pairs.where(matching).select("idx", "t", "k")


def any_overlap(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Groups in which some object of one set overlaps one of the other set.

    Both sets carry x, y, w, h.  How far apart two objects can overlap follows from the largest
    sizes of both sets, one aggregate.
    """
    sizes = [c for c in ("w", "h")]
    largest = first.select(*sizes).unionByName(second.select(*sizes)).agg(F.max("w"), F.max("h")).first()
    reach = max(0.0, *[float(v or 0.0) for v in largest]) + 2 * dims.OVERLAP_MARGIN
    a, b, equal = near_candidates(first, second, reach, keys)
    b = _renamed(b, b.columns, "o_")
    limit = F.greatest(
        (F.col("w") + F.col("o_w")) / 2 + dims.OVERLAP_MARGIN,
        (F.col("h") + F.col("o_h")) / 2 + dims.OVERLAP_MARGIN,
    )
    condition = P.distance((F.col("x"), F.col("o_x")), (F.col("y"), F.col("o_y"))) <= limit
    for k in equal:
        condition = condition & (F.col(k) == F.col("o_" + k))
    return a.join(large(b), condition, "left_semi").select(*keys).distinct()


# --- pixels ------------------------------------------------------------------------------------


def detections(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Bounding box per (frame, object) with at least two pixels: centre, height, width."""
    return (
        pixels.groupBy(*by, "id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("x").alias("x0"),
            F.max("x").alias("x1"),
            F.min("y").alias("y0"),
            F.max("y").alias("y1"),
        )
        .where("n >= 2")
        .select(
            *by,
            "id",
            F.floor((F.col("x0") + F.col("x1")) / 2).alias("xc"),
            F.floor((F.col("y0") + F.col("y1")) / 2).alias("yc"),
            (F.col("y1") - F.col("y0")).alias("h"),
            (F.col("x1") - F.col("x0")).alias("w"),
        )
    )


def detections_packed(frames: DataFrame, width: int) -> DataFrame:
    """:func:`detections` for frames stored as one array per row, without exploding pixels."""

    def detect(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["frame", "id", "xc", "yc", "h", "w"]
        for batch in batches:
            found = {n: [] for n in names}
            frame_ids = batch.column("frame").to_pylist()
            column = batch.column("ids")
            offsets = column.offsets.to_numpy()
            values = column.values.to_numpy()
            for row, frame in enumerate(frame_ids):
                flat = values[offsets[row] : offsets[row + 1]]
                ids, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
                ys, xs = np.divmod(np.arange(flat.size), width)
                low = np.full((2, ids.size), flat.size)
                high = np.full((2, ids.size), -1)
                np.minimum.at(low[0], inverse, ys)
                np.minimum.at(low[1], inverse, xs)
                np.maximum.at(high[0], inverse, ys)
                np.maximum.at(high[1], inverse, xs)
                for i in np.flatnonzero(counts >= 2):
                    found["frame"].append(frame)
                    found["id"].append(int(ids[i]))
                    found["xc"].append(int((low[1][i] + high[1][i]) // 2))
                    found["yc"].append(int((low[0][i] + high[0][i]) // 2))
                    found["h"].append(int(high[0][i] - low[0][i]))
                    found["w"].append(int(high[1][i] - low[1][i]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found["frame"], pa.int64()),
                    pa.array(found["id"], pa.int32()),
                    *[pa.array(found[n], pa.int64()) for n in names[2:]],
                ],
                names=names,
            )

    schema = "frame bigint, id int, xc bigint, yc bigint, h bigint, w bigint"
    return frames.select("frame", "ids").mapInArrow(detect, schema)


def fill_slots(frames: DataFrame, objects: list[int], found: DataFrame, by: list[str]) -> DataFrame:
    """Every listed object of every frame, with a zero box and a false mask where it was not found."""
    listed = frames.select(*by, F.posexplode(F.array(*[F.lit(i) for i in objects])).alias("place", "id"))
    return listed.join(found, [*by, "id"], "left").select(
        *by,
        "place",
        "id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("xc", "yc", "h", "w")],
        F.col("xc").isNotNull().alias("mask"),
    )


def pad_slots(slots: DataFrame, by: list[str]) -> DataFrame:
    """Visible objects first, zero boxes after; ``status`` tells frames without a visible object.

    A frame has as many rows as the object list has entries, so the window is small.
    """
    from pyspark.sql import Window as W

    frame = W.partitionBy(*by)
    order = frame.orderBy(~F.col("mask"), "place")
    return (
        slots.withColumn("status", F.when(F.max("mask").over(frame), F.lit("ok")).otherwise(F.lit("nothing visible")))
        .withColumn("slot", (F.row_number().over(order) - 1).cast("bigint"))
        .drop("place")
    )


def halve(pixels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Area mean of 2 x 2 pixels."""
    return pixels.groupBy(
        *by, F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")
    ).agg(F.avg(value).alias(value))


def area_crops(pixels: DataFrame, boxes: DataFrame, by: list[str], value: str, size: int) -> DataFrame:
    """Each detected box, padded to a square and shrunk or stretched to ``size`` x ``size``.

    A target pixel is the overlap-weighted mean of the source pixels under it; the padding is 0.
    Boxes carry x0, x1, y0, y1 (inclusive) and ``id``.
    """
    height = F.col("y1") - F.col("y0") + 1
    width = F.col("x1") - F.col("x0") + 1
    side = F.greatest(height, width)
    inside = (
        pixels.drop("id")
        .join(boxes, by)
        .where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
        .withColumn("side", side.cast("double"))
        .withColumn("sy", (F.col("y") - F.col("y0") + F.floor((side - height) / 2)).cast("double"))
        .withColumn("sx", (F.col("x") - F.col("x0") + F.floor((side - width) / 2)).cast("double"))
    )
    scale = F.col("side") / F.lit(float(size))

    def covered(start: str) -> Column:
        """Target positions a source pixel touches, with the touched length."""
        low, high = F.col(start), F.col(start) + 1
        return F.filter(
            F.transform(
                F.sequence(F.lit(0), F.lit(size - 1)),
                lambda k: F.struct(
                    k.alias("at"),
                    (F.least(high, (k + 1) * scale) - F.greatest(low, k * scale)).alias("part"),
                ),
            ),
            lambda p: p["part"] > 1e-12,
        )

    spread = (
        inside.select(*by, "id", "side", value, F.explode(covered("sy")).alias("v"), "sx")
        .select(*by, "id", "side", value, "v", F.explode(covered("sx")).alias("h"))
    )
    return spread.groupBy(*by, "id", F.col("v.at").alias("y"), F.col("h.at").alias("x")).agg(
        F.sum(F.col(value) * F.col("v.part") * F.col("h.part") / (scale * scale)).alias(value)
    )


def boxes(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Inclusive pixel bounds per (frame, object) with at least two pixels."""
    return (
        pixels.groupBy(*by, "id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("x").alias("x0"),
            F.max("x").alias("x1"),
            F.min("y").alias("y0"),
            F.max("y").alias("y1"),
        )
        .where("n >= 2")
        .drop("n")
    )


def height_map(
    points: DataFrame, by: list[str], bounds: dict[str, tuple[float, float]], pixel: float, colours: list[str]
) -> DataFrame:
    """Highest point per map pixel above the floor, with its colour; equal heights take the lowest id."""
    (x0, x1), (y0, y1), (z0, z1) = bounds["x"], bounds["y"], bounds["z"]
    columns = round((x1 - x0) / pixel)
    rows = round((y1 - y0) / pixel)
    inside = points.where(
        (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
        & (F.col("z") >= z0) & (F.col("z") < z1)
    )
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v))
    px = clip(F.floor((F.col("x") - F.lit(x0)) / F.lit(pixel)), columns).cast("bigint")
    py = clip(F.floor((F.col("y") - F.lit(y0)) / F.lit(pixel)), rows).cast("bigint")
    top = F.max(F.struct(F.col("z").alias("z"), (-F.col("id")).alias("id"), *colours))
    return (
        inside.groupBy(*by, py.alias("py"), px.alias("px"))
        .agg(top.alias("top"))
        .select(*by, "py", "px", (F.col("top.z") - F.lit(z0)).alias("height"), *[F.col(f"top.{c}").alias(c) for c in colours])
    )


def fuse_views(maps: DataFrame, by: list[str], colours: list[str]) -> DataFrame:
    """Greatest height and mean colour over the views that saw something other than black."""
    lit = sum((F.col(c) for c in colours[1:]), F.col(colours[0])) > 0
    seen = F.greatest(F.count_if(lit), F.lit(1))
    return maps.groupBy(*by).agg(
        F.max("height").alias("height"),
        *[F.rint(F.sum(c) / seen).cast("bigint").alias(c) for c in colours],
    )


def palette_colours(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Pixel ids as colours of the fixed palette, with the frame's ``status``.

    A frame with an id beyond the palette is rejected as a whole: its pixels stay, without colours.
    """
    known = F.col("id").between(0, len(dims.SEGMENT_PALETTE) - 1)
    colour = F.try_element_at(
        F.array(*[F.array(*[F.lit(v) for v in rgb]) for rgb in dims.SEGMENT_PALETTE]), F.col("id").cast("int") + 1
    )
    rejected = pixels.where(~known).select(*by).distinct().withColumn("__rejected", F.lit(True))
    return (
        pixels.join(rejected, by, "left")
        .withColumn("status", F.when(F.col("__rejected"), F.lit("reject")).otherwise(F.lit("ok")))
        .withColumn("__c", F.when(F.col("__rejected").isNull(), colour))
        .drop("__rejected")
        .select("*", *[F.col("__c")[i].alias(n) for i, n in enumerate("rgb")])
        .drop("__c")
    )


def stack_frames(pixels: DataFrame, by: list[str], colours: list[str]) -> DataFrame:
    """Pixels of a frame as one array in row order; a frame's size is fixed, so is the array's."""
    pixel = F.struct("y", "x", *colours)
    return pixels.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(pixel)), lambda p: F.array(*[p[c] for c in colours])).alias("pixels")
    )
