"""Exact deduplication by two-pass Bloom filtering (DataFrame functions only).

Pass one counts, for each of two hash positions of every text, how many rows fall on it; the positions hit twice or
more form a Bloom filter of the hashes that may repeat. Pass two probes it: rows whose two positions are both in the
filter are compared exactly by SHA-256 and are the only ones that shuffle; all others pass straight through.

Filters are bounded (see bloom): more keys have several, each for a range of hashes, probed in turn. So at any size
the same share of rows, some 98 % of the unrepeated ones, passes straight through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.bloom import Bloom
from buildlens.llm.common import SPACE, Staged


def normalised(text) -> F.Column:
    """White-space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as the empty text. Of equal texts the smallest id stays; null ids come last, and of rows that
    repeat an id and its text exactly one stays. Texts of any length are compared whole. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    sha = F.sha2(normalised(F.col(text_col)), 256)
    rows = Staged(docs.select(F.col(id_col).alias("doc_id"), F.unhex(sha).alias("sha"), F.monotonically_increasing_id().alias("rid")), "sha").df
    rows = rows.withColumn("key", F.xxhash64("sha"))
    marked = Bloom(rows.select("key"), rows.count(), least=2).mark(rows)
    through = marked.where(~F.col("possible")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    again = marked.where("possible").select("doc_id", "sha", "rid")
    first = again.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    first = Staged(first, "first").df  # both sides of the join then have exchanges of their own, which Spark can split
    judged = again.join(first, "sha").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "sha")
    return through.unionByName(judged).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text repeats that of a row with a smaller id; all columns stay, whatever their names.

    Whole rows of texts that can't repeat never shuffle. Rules for nulls and long texts as in exact_groups. Of rows that
    repeat an id and its text one stays; where they differ in other columns, the one with the smallest hash of them all.
    """
    sha = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), sha.alias("sha"), F.col(id_col).alias("_id")).withColumn("key", F.xxhash64("sha"))
    keys = Staged(held.select("key", "_id", "sha"), "keys").df
    bloom = Bloom(keys.select("key"), keys.count(), least=2)
    marked = bloom.mark(held)
    first = bloom.mark(keys).where("possible").groupBy("sha").agg(F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"))).alias("first"))
    first = Staged(first, "first").df
    again = marked.where("possible").join(first, "sha").where(F.col("_id").eqNullSafe(F.col("first.id")))
    again = again.groupBy("sha").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return marked.where(~F.col("possible")).select("row").unionByName(again.select("row")).select("row.*")
