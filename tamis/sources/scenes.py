"""Scene lists as detectors write them: JSON whose elements have one of three forms, read as VARIANT.

An object names its frames or seconds; a pair of whole numbers is a pair of frames; any other pair is one of seconds.
All become shot_id, start_frame, end_frame, start_time and end_time. Elements of another form (a string, a null, a list of
one) are left out. A form that holds something that is no number spoils the list, and a list that isn't one, is spoiled or
has no scene left stands for one scene from the first frame to the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCENE = "struct<shot_id:bigint,start_frame:bigint,end_frame:bigint,start_time:double,end_time:double>"


def _kind(v: Column, path: str) -> Column:
    """The type of what stands at a path; null if nothing does."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _seconds(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "double")


def _whole(v: Column, path: str) -> Column:
    """A number without its fraction; of strings only whole numbers count."""
    number = F.try_variant_get(v, path, "double")
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string").try_cast("long")).otherwise(number.cast("long"))


def _nearest(seconds: Column, fps: Column) -> Column:
    """The frame at a time, halves to the even one."""
    return F.bround(seconds * fps, 0).cast("long")


def _given(v: Column, path: str, value: Column, otherwise: Column) -> Column:
    return F.when(F.try_variant_get(v, path, "variant").isNull(), otherwise).otherwise(value)


def _object(v: Column, fps: Column, place: Column) -> Column:
    start = _given(v, "$.start_time", _seconds(v, "$.start_time"), F.lit(0.0))
    end = _given(v, "$.end_time", _seconds(v, "$.end_time"), start)
    first = _given(v, "$.start_frame", _whole(v, "$.start_frame"), _nearest(start, fps))
    last = _given(v, "$.end_frame", _whole(v, "$.end_frame"), _nearest(end, fps))
    shot = _given(v, "$.shot_id", _whole(v, "$.shot_id"), place)
    return F.struct(shot.alias("shot_id"), first.alias("start_frame"), last.alias("end_frame"), start.alias("start_time"), end.alias("end_time"))


def _pair(v: Column, fps: Column, place: Column, frames: bool) -> Column:
    timed = F.coalesce(fps, F.lit(0.0)) > 0
    a, b = (_whole(v, p) if frames else _seconds(v, p) for p in ("$[0]", "$[1]"))
    if frames:
        first, last = a, b
        start, end = (F.when(timed, x / F.nullif(fps, F.lit(0.0))).when(x.isNotNull(), 0.0) for x in (a, b))
    else:
        first, last = (F.when(timed, _nearest(x, fps)).when(x.isNotNull(), F.lit(0).cast("long")) for x in (a, b))
        start, end = a, b
    return F.struct(place.alias("shot_id"), first.alias("start_frame"), last.alias("end_frame"), start.alias("start_time"), end.alias("end_time"))


def scene(v: Column, fps: Column, place: Column) -> Column:
    """A scene from one element of a list; null for an element that is left out. A field is null where it should be a
    number and isn't. Scenes given as frames or objects end no earlier than they start."""
    kind, first, second = F.schema_of_variant(v), _kind(v, "$[0]"), _kind(v, "$[1]")
    is_object, is_pair = F.startswith(kind, F.lit("OBJECT")), F.startswith(kind, F.lit("ARRAY")) & first.isNotNull() & second.isNotNull()
    whole = first.isin("BIGINT", "BOOLEAN") & second.isin("BIGINT", "BOOLEAN")
    ordered = lambda s: s.withField("end_frame", F.when(s["end_frame"].isNotNull(), F.greatest(s["start_frame"], s["end_frame"])))
    return (
        F.when(is_object, ordered(_object(v, fps, place)))
        .when(is_pair & whole, ordered(_pair(v, fps, place, True)))
        .when(is_pair, _pair(v, fps, place, False))
        .cast(SCENE)
    )


def single_scene(fps: Column, frames: Column) -> Column:
    """The scene that a whole video is."""
    end = F.when(F.coalesce(fps, F.lit(0.0)) > 0, frames / F.nullif(fps, F.lit(0.0))).otherwise(0.0)
    zero = F.lit(0).cast("long")
    return F.struct(zero.alias("shot_id"), zero.alias("start_frame"), F.greatest(frames - 1, zero).alias("end_frame"), F.lit(0.0).alias("start_time"), end.alias("end_time")).cast(SCENE)


def scenes(rows: DataFrame, text: str, fps: str, frames: str) -> DataFrame:
    """One row per scene with the other columns of `rows`; `detected` says whether it comes from the list."""
    rate, n = F.coalesce(F.col(fps).cast("double"), F.lit(0.0)), F.coalesce(F.col(frames).cast("long"), F.lit(0).cast("long"))
    parsed = F.try_parse_json(F.col(text))
    elements = F.when(F.startswith(F.schema_of_variant(parsed), F.lit("ARRAY")), F.try_variant_get(parsed, "$", "array<variant>"))
    read = rows.withColumn("_elements", elements)
    found = F.filter(F.transform("_elements", lambda v, i: scene(v, rate, i.cast("long"))), lambda s: s.isNotNull())
    read = read.withColumn("_found", found).drop("_elements")
    spoiled = F.exists("_found", lambda s: F.exists(F.array(s["shot_id"], s["start_frame"], s["end_frame"]), lambda x: x.isNull()) | s["start_time"].isNull() | s["end_time"].isNull())
    detected = F.coalesce((F.size("_found") > 0) & ~spoiled, F.lit(False))
    listed = read.withColumn("detected", detected).withColumn("_scene", F.explode(F.when(F.col("detected"), F.col("_found")).otherwise(F.array(single_scene(rate, n)))))
    kept = [c for c in rows.columns if c != text]
    return listed.select(*kept, "_scene.*", "detected")
