"""Bloom filters of bounded size, as broadcast tables of 64-bit words (DataFrame functions only).

A filter has at most MAX_BITS bits, so its table has at most MAX_BITS / 64 rows, whatever the data. More keys than one
filter holds are dealt by hash into ranges, each with a filter of its own: rows are written once by range, without a
shuffle, and the ranges are probed in turn, so there is one broadcast filter at a time and as few rows pass as before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import Staged

BITS_PER_ROW, MIN_BITS, MAX_BITS = 16, 1 << 12, 1 << 26


def filter_bits(rows: int) -> int:
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS_PER_ROW * rows):
        bits *= 2
    return bits


def ranges_for(rows: int) -> int:
    """How many filters `rows` keys need."""
    n = 1
    while MAX_BITS * n < BITS_PER_ROW * rows:
        n *= 2
    return n


def _positions(key, bits: int) -> tuple[F.Column, F.Column]:
    return key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1))


def filter_words(keys: DataFrame, bits: int, least: int = 1) -> DataFrame:
    """(word, mask): the positions that at least `least` rows of `keys` (one long column, key) hit."""
    p1, p2 = _positions(F.col("key"), bits)
    hit = keys.select(F.explode(F.array(p1, p2)).alias("pos")).groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return hit.groupBy(F.expr("pos div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pos % 64 as int)))").alias("mask"))


def mark_possible(rows: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """Adds `possible`: both positions of the row's `key` are in the filter."""
    out, found = rows, F.lit(True)
    for i, p in enumerate(_positions(F.col("key"), bits)):
        side = F.broadcast(words.select(F.col("word").alias(f"_w{i}"), F.col("mask").alias(f"_m{i}")))
        out = out.withColumn(f"_p{i}", p).join(side, F.expr(f"_p{i} div 64 = _w{i}"), "left")
        found = found & F.expr(f"coalesce(getbit(_m{i}, cast(_p{i} % 64 as int)) = 1, false)")
    return out.withColumn("possible", found).drop(*[f"_{c}{i}" for c in "wmp" for i in range(2)])


class Bloom:
    """The filter of `rows` keys (one long column, key): of those that at least `least` rows have, none is missed."""

    def __init__(self, keys: DataFrame, rows: int, least: int = 1):
        self.ranges, self.least = ranges_for(rows), least
        self.bits = filter_bits(-(-rows // self.ranges))
        if self.ranges == 1:
            self.words = Staged(filter_words(keys, self.bits, least), "bloom").df
        else:
            self.keys = Staged(keys.select("key", self._range()), "keys", by="_range").df

    def _range(self):
        return F.pmod(F.xxhash64(F.col("key"), F.lit(7)), F.lit(self.ranges)).cast("int").alias("_range")

    def mark(self, rows: DataFrame) -> DataFrame:
        """rows (with key) and `possible`. With several ranges they are written twice, range by range, and never shuffled."""
        if self.ranges == 1:
            return mark_possible(rows, self.words, self.bits)
        held, parts = Staged(rows.select("*", self._range()), "ranges", by="_range"), []
        for i in range(self.ranges):
            words = Staged(filter_words(self.keys.where(F.col("_range") == i).select("key"), self.bits, self.least), "bloom")
            parts.append(Staged(mark_possible(held.df.where(F.col("_range") == i).select(*rows.columns), words.df, self.bits), "marked"))
            words.drop()
        held.drop()
        return rows.sparkSession.read.schema(parts[0].df.schema).parquet(*[p.path for p in parts])


def probe_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """(row, id, possible) for each row of docs: whether its id may be among `ids` (one column, id; no row is missed)."""
    bloom = Bloom(ids.select(F.xxhash64("id").alias("key")), ids.count())
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.xxhash64(docs[id_col]).alias("key"))
    return bloom.mark(held).drop("key")


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is among `ids`. Rows that can't be don't shuffle; null ids stay."""
    held = probe_ids(docs, ids, id_col)
    rest = held.where("possible").join(ids.select("id").distinct(), "id", "left_anti")
    return held.where(~F.col("possible")).select("row").unionByName(rest.select("row")).select("row.*")
