"""Compact source maps: delta-coded lists as rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FIELD = r"^-?\d*$"
MAX_U32 = (1 << 32) - 1


def _number(part: Column, low_to: int) -> Column:
    """A field's number: null if empty, -1 as `low_to`, an error for others that don't fit."""
    value = part.try_cast("bigint")
    return (
        F.when(part.isNull() | (part == ""), F.lit(None).cast("bigint"))
        .when(~F.regexp_like(part, F.lit(_FIELD)) | value.isNull(), F.raise_error(F.concat(F.lit("source map: no number: "), part)).cast("bigint"))
        .when(value == -1, F.lit(low_to).cast("bigint"))
        .when((value < -1) | (value > MAX_U32), F.raise_error(F.concat(F.lit("source map: out of range: "), part)).cast("bigint"))
        .otherwise(value)
    )


def decode(maps: DataFrame, key: str = "id", text: str = "source_map") -> DataFrame:
    """(key, pos, offset, length, index, jump, modifier_depth) of "s:l:f:j:m;..." lists.

    An empty field takes the element before's value; before the first, 0, 0, none, i and 0. An offset, length or depth
    of -1 is 0, an index of -1 is null. A null or empty map has no elements.
    """
    rows = maps.where(F.col(text) != "").select(key, F.posexplode(F.split(text, ";")).alias("pos", "e"))
    part = lambda i: F.get(F.split("e", ":"), i)
    jump = F.when(part(3) == "", F.lit(None)).when(part(3).isin("i", "o", "-") | part(3).isNull(), part(3)).otherwise(F.raise_error(F.concat(F.lit("source map: no jump: "), part(3))).cast("string"))
    rows = rows.select(key, "pos", _number(part(0), 0).alias("offset"), _number(part(1), 0).alias("length"), _number(part(2), -1).alias("index"), jump.alias("jump"), _number(part(4), 0).alias("modifier_depth"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lambda c, start: F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(start))
    index = held("index", -1)
    return rows.select(key, "pos", held("offset", 0).alias("offset"), held("length", 0).alias("length"), F.when(index >= 0, index).alias("index"), held("jump", "i").alias("jump"), held("modifier_depth", 0).alias("modifier_depth"))


def encode(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, source_map) in which every field is written out."""
    text = F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), F.coalesce("index", F.lit(-1)).cast("string"), "jump", F.col("modifier_depth").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("pos", text.alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ";").alias("source_map"))


def packed(jump: Column, depth: Column) -> Column:
    """Jump and modifier depth in one number: two bits and thirty."""
    code = F.when(jump == "i", 0).when(jump == "o", 1).otherwise(2).cast("bigint")
    return F.shiftleft(code, 30).bitwiseOR(depth)


def unpacked_jump(x: Column) -> Column:
    return F.element_at(F.array(F.lit("i"), F.lit("o"), F.lit("-")), (F.shiftrightunsigned(x, 30).bitwiseAND(F.lit(3)) + 1).cast("int"))


def unpacked_depth(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0x3FFFFFFF))


def vyper_source_map(value: Column) -> Column:
    """The list in a JSON string, or in an object's pc_pos_map_compressed; null in neither."""
    return F.coalesce(F.get_json_object(value, "$.pc_pos_map_compressed"), F.when(~F.startswith(F.ltrim(value), F.lit("{")), F.regexp_replace(value, '^"|"$', "")))
