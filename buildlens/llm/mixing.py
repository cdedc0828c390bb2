"""Mixing sources to target weights, as a time-varying curriculum (DataFrame functions only).

Every source has a target, in words, and a weight schedule over training time t in [0, 1] whose mean is that target:
w(t) = target * (1 + tilt * (2t - 1)). Its integral D(t) = target * (t + tilt * (t^2 - t)) is the cumulative token
demand. A document's words take up an interval of its source's demand; inverting D at the interval's middle gives the
training position, and documents are range-sorted by position.

Cumulative sums run in buckets of a source, as many as its rows need, and add the buckets before: no source, however
large, meets in one task. The window over sources has one row for each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildlens.llm.common import SPACE, Staged, word_count

ROWS_PER_BUCKET, MOST_REPEATS = 2_000, 3
#: Weights 1, 2, 3 and so on in source order; each has a tilt of its schedule (-1: all early, 1: all late).
WEIGHTS, TILTS = (1, 2, 3), (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, weights=WEIGHTS, tilts=TILTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, source_rows, weight, tilt, target) for each source of `sizes` (source, size).

    Sources in code-point order, null last, weigh weights[0], weights[1] ... again and again, and share all words by
    weight. A target stops at `most` times its source's size; the excess is shared again by weight. That is the level
    L with sum(min(most * size, L * weight)) = all words; over sources by most * size / weight, L is the largest of
    (words - limits before) / (weights from here on).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    k = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    per = per.withColumn("k", k.cast("int"))
    per = per.withColumns({"weight": F.element_at(F.array(*map(F.lit, weights)), F.col("k") + 1), "tilt": F.element_at(F.array(*map(F.lit, tilts)), F.col("k") + 1), "limit": F.col("source_size") * most})
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - before) / onward
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return per.select("source", "source_size", "source_rows", "weight", "tilt", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, weights=WEIGHTS, tilts=TILTS, most: int = MOST_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs, range-sorted by first position:
    doc_id, size, source, source_size, target, taken, first_position, start, wanted, tilt.

    A source takes all its documents as often as its target allows and, in the order of md5(doc_id), the part that is
    left; where it ends inside a document, only that many words of it. The words taken are the target, rounded.
    first_position is null where nothing is taken. Null text has size 0, a null source is a source of its own, null
    ids come first, repeated rows each count, and texts of any length are counted whole. Reruns agree: nothing depends
    on partitions. Empty tables stay empty. Other columns are ignored, whatever their names.
    """
    sized = Staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes").df
    per = source_targets(sized, weights, tilts, most)
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sized.join(per, sized["source"].eqNullSafe(per["source"])).drop(per["source"]).withColumn("order_key", md5)
    rows = rows.withColumn("bucket", F.expr(f"cast(conv(substring(order_key, 1, 8), 16, 10) as bigint) * cast(ceil(source_rows / {ROWS_PER_BUCKET}) as bigint) div 4294967296"))
    by = [F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("bucket")]
    # staged, or else the windows below would take over the join's partitioning, by source alone
    rows = Staged(rows.withColumns({"no_source": by[0], "source_key": by[1]}), "bucketed").df
    sums = rows.groupBy("no_source", "source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    upto = Window.partitionBy("no_source", "source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0).cast("long"))).drop("bucket_size")
    within = Window.partitionBy("no_source", "source_key", "bucket").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0).cast("long"))).join(sums, ["no_source", "source_key", "bucket"])
    rows = rows.withColumns({"start": F.col("before") + F.col("inside"), "wanted": F.floor(F.col("target") + 0.5)})
    whole = F.expr("case when source_size > 0 then wanted div source_size else 0L end")
    rest = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("wanted") - whole * F.col("source_size") - F.col("start")))
    rows = rows.withColumn("taken", whole * F.col("size") + rest)
    rows = rows.withColumn("first_position", F.when(F.col("taken") > 0, position(F.col("start") + F.least("taken", "size") / 2, F.col("wanted"), F.col("tilt"))))
    out = rows.select("doc_id", "size", "source", "source_size", "target", "taken", "first_position", "start", "wanted", "tilt", "order_key")
    placed = Staged(out, "mixed").df
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.repartitionByRange(n, "first_position", "order_key", "doc_id").sortWithinPartitions("first_position", "order_key", "doc_id").drop("order_key")


def position(at, wanted, tilt) -> F.Column:
    """The training time at which a source's cumulative demand reaches `at` of `wanted` words."""
    u = at / wanted
    return 2 * u / ((1 - tilt) + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * u))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", **how) -> DataFrame:
    """The mix itself: docs' rows, once for each time they are taken, range-sorted by training position.

    A last, partial copy holds the text's first words, joined by one space; chars_col, if there is such a column, counts
    its characters then. Rows that share an id share the decision of the one that starts first in its source's demand
    (of equal ones, with the smallest size). Null and empty texts and empty sources are not taken. All other columns
    stay as they are, whatever their names; an empty table stays empty.
    """
    plan = mixed(docs, id_col=id_col, text_col=text_col, **how).where("taken > 0")
    plan = plan.select(F.col("doc_id").alias("_id"), "size", "source_size", "taken", "start", "wanted", "tilt")
    plan = plan.groupBy("_id").agg(F.min(F.struct("start", "size", "source_size", "taken", "wanted", "tilt")).alias("p")).select("_id", "p.*")
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"))
    rows = held.join(plan, held["_id"].eqNullSafe(plan["_id"])).select("row", "size", "source_size", "taken", "start", "wanted", "tilt", plan["_id"])
    rows = rows.withColumn("copy", F.explode(F.expr("sequence(0L, (taken + size - 1) div size - 1)")))
    rows = rows.withColumn("words", F.least("size", F.col("taken") - F.col("copy") * F.col("size")))
    rows = rows.withColumn("position", position(F.col("copy") * F.col("source_size") + F.col("start") + F.col("words") / 2, F.col("wanted"), F.col("tilt")))
    cut = F.array_join(F.slice(F.filter(F.split(F.col(f"row.{text_col}"), SPACE), lambda w: w != ""), 1, F.col("words").cast("int")), " ")
    rows = rows.withColumn("_text", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col(f"row.{text_col}")))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(n, "position", "_id", "copy").sortWithinPartitions("position", "_id", "copy")
    new = {text_col: F.col("_text")}
    if chars_col in docs.columns:
        new[chars_col] = F.length("_text").cast(dict(docs.dtypes)[chars_col])
    return rows.select(*[(F.when(F.col("words") < F.col("size"), new[c]).otherwise(F.col("row")[c]) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
