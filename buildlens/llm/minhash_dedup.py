"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

A document's signature is m chunks of six b-bit minhash values (b = 16); the distance of two signatures is the number
of values that differ. By pigeonhole, two signatures at distance 2m - 1 or less have a chunk with at most one differing
value. That error is enumerated: each chunk gives one key for each of its values, made of the other values, so chunks
with at most one error share a key. Hence every pair within the distance shares a key, for certain; farther ones mostly
do as well: m is such that a pair at the threshold of similarity shares none once in a million times.

Documents with equal shingle sets form one class, and only the classes' first documents get keys. Every key links its
documents to the smallest one, its pivot; pairs that pass proven bounds, on lengths and on shingles that no other
candidate has, are confirmed on full sets. Only documents of one key that are still in different components are then
held against each other, without the key's largest component on one side. So copies are never expanded into pairs, and
no candidate is dropped that could be a link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.bloom import probe_ids, without_ids
from buildlens.llm.common import Staged, WordHash, batches_of, gram_hashes, lists, mix, odd_constants, raw, staging, tidied
from buildlens.llm.components import connected_components

SHINGLE, CHUNK_VALUES, MOST_VALUES, MISSED = 5, 6, 192, 1e-6


def chunks_for(percent: int) -> int:
    """So many chunks that a pair at the threshold shares no key once in 1 / MISSED times (10 for 85, 13 for 80).

    A ValueError for thresholds that need more chunks than a signature may have values for (below about 70).
    """
    p = percent / 100
    miss = 1 - p**CHUNK_VALUES - CHUNK_VALUES * (1 - p) * p ** (CHUNK_VALUES - 1)
    if miss <= 0:
        return 1
    need = max(1, math.ceil(math.log(MISSED) / math.log(miss))) if miss < 1 else math.inf
    if need > MOST_VALUES // CHUNK_VALUES:
        raise ValueError(f"a threshold of {percent} % needs {need} chunks; {MOST_VALUES} values make {MOST_VALUES // CHUNK_VALUES}")
    return need


def shingle_set(text: bytes | None, words: WordHash, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, of the whole sequence; empty without words."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(words.of(tokens), min(n, len(tokens))) if len(tokens) >= n else gram_hashes(words.of(tokens), len(tokens)) ^ np.uint64(len(tokens)))


def minima(shingles: np.ndarray, multipliers: np.ndarray, block: int = 2048) -> np.ndarray:
    out = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), block):
        np.minimum(out, (multipliers[:, None] * shingles[i : i + block]).min(axis=1), out=out)
    return out


class Signer:
    def __init__(self, chunks: int):
        self.chunks, self.values = chunks, chunks * CHUNK_VALUES
        self.multipliers = odd_constants(self.values, 11)
        self.salts = odd_constants(self.values, 23)
        self.weights = odd_constants(self.values, 31).reshape(chunks, -1)

    def __call__(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys (one for each value of each chunk), and the values, three in a word."""
        least = mix(minima(shingles, self.multipliers) ^ self.salts)
        values = (least >> np.uint64(48)).reshape(self.chunks, -1)
        packed = (values.reshape(-1, 3) << np.array([0, 16, 32], np.uint64)).sum(axis=1).view(np.int64)
        parts = (values + np.uint64(1)) * self.weights
        keys = mix(parts.sum(axis=1, keepdims=True) - parts + self.salts.reshape(self.chunks, -1))
        return keys.ravel().view(np.int64), packed


def _signatures(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sign = WordHash(), Signer(chunks)
        for b in batches_of(batches):
            n, hashes, keys, values = [], [], [], []
            none = np.empty(0, np.int64)
            for text in raw(b.column(1)):
                shingles = shingle_set(text, words)
                n.append(len(shingles))
                k, v = sign(shingles) if len(shingles) else (none, none)
                values.append(v)
                hashes.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                keys.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), lists(keys, pa.int64()), lists(values, pa.int64())], ["doc_id", "n", "set_hash", "keys", "values"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for b in batches_of(batches):
        yield pa.RecordBatch.from_arrays([b.column(0), lists([shingle_set(t, words).view(np.int64) for t in raw(b.column(1))], pa.int64())], ["id", "shingles"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> Staged:
    """The pairs (a, b) whose full shingle sets reach `percent` of similarity."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).cast("long").alias("total"), F.size(F.array_intersect("x", "y")).cast("long").alias("common"))
    return Staged(both.where(F.col("common") * 100 >= percent * (F.col("total") - F.col("common"))).select("a", "b"), "links")


def _shared_counts(sets: DataFrame) -> DataFrame:
    """(id, shared) for each of `sets`: how many of its shingles another one has."""
    each = sets.select("id", F.explode("shingles").alias("shingle"))
    own = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    return sets.select("id", F.size("shingles").cast("long").alias("n")).join(own, "id", "left").select("id", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))


def _cross_counts(sets: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, cross) for each row of placed (id, component): how many of its shingles a document of another component has."""
    each = sets.join(placed, "id").select("id", "component", F.explode("shingles").alias("shingle"))
    between = each.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle")
    return each.join(Staged(between, "between").df, "shingle").groupBy("id").agg(F.count(F.lit(1)).alias("cross"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are runs between ASCII white space, A-Z lower-cased. Documents are linked when 100 * common shingles >=
    percent * shingles of both. Null texts and texts without words have no shingles and are linked with nothing.
    component_id is the smallest id reachable; kept marks the row whose own id that is. Rows with a null id are linked
    with nothing and kept, with a null component_id. Rows that repeat an id share its component. Texts of any length are
    taken whole. An empty table gives an empty result. Other columns are ignored, whatever their names.

    n_shingles counts distinct 64-bit hashes of shingles (two of a document's n collide once in 2^65 / n^2 documents).
    """
    with staging() as tables:
        sigs, classes, final = _components(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), percent)
        for table in (sigs, classes, final):
            tables.keep(table)
    sigs, classes, final = sigs.df, classes.df, final.df
    by_class = classes.join(final, "rep", "left").select("set_hash", F.coalesce("component_id", "rep").alias("component_id"))
    found = sigs.where("n > 0 and doc_id is not null").select("doc_id", "n", "set_hash").join(by_class, "set_hash").select("doc_id", "n", "component_id")
    alone = sigs.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _components(docs: DataFrame, percent: int) -> tuple[Staged, Staged, Staged]:
    """Of docs (doc_id, text): signatures, the classes of equal sets with their first documents (set_hash, rep), and the
    components of those that have a link (rep, component_id)."""
    signed = Staged(docs.mapInArrow(tidied(_signatures(chunks_for(percent))), "doc_id long, n long, set_hash binary, keys array<long>, values array<long>"), "signatures")
    sigs = signed.df
    some = sigs.where("n > 0 and doc_id is not null")
    classes = Staged(some.groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(classes.df.select("set_hash", F.col("rep").alias("doc_id")), ["set_hash", "doc_id"], "left_semi")
    keys = reps.select(F.posexplode("keys").alias("place", "key"), "doc_id")
    pivots = keys.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).where("pivot <> last").drop("last")
    pivots = Staged(pivots, "pivots").df  # here and below: so that Spark can split hot keys, each side has an exchange
    members = Staged(keys.join(pivots, "key"), "members").df

    sets = probe_ids(docs, members.select(F.col("doc_id").alias("id")).distinct(), "doc_id").where("possible").select("row.doc_id", "row.text")
    sets = sets.mapInArrow(tidied(_sets), "id long, shingles array<long>").join(members.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    sets = Staged(sets, "sets")
    ids = members.select(F.col("doc_id").alias("id")).distinct()
    facts = sigs.select(F.col("doc_id").alias("id"), "n", "values").join(ids, "id", "left_semi").dropDuplicates(["id"]).join(_shared_counts(sets.df), "id")
    facts = Staged(facts, "facts").df

    def alike(a: str, b: str, shared: str) -> Column:
        """Bounds that every linked pair meets: common shingles are at most the fewer shared ones of the two, and the
        union at least the rest."""
        c = lambda side, name: F.col(f"{side}.{name}")
        most = F.least(c(a, shared), c(b, shared))
        return (F.least(c(a, "n"), c(b, "n")) * 100 >= F.greatest(c(a, "n"), c(b, "n")) * percent) & (most * 100 >= (c(a, "n") + c(b, "n") - most) * percent)

    star = members.where("doc_id <> pivot").select("pivot", "doc_id").distinct()
    star = star.join(facts.alias("x"), F.col("pivot") == F.col("x.id")).join(facts.alias("y"), F.col("doc_id") == F.col("y.id")).where(alike("x", "y", "shared"))
    star = Staged(star.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")), "star")
    first = _confirmed(star.df, sets.df, percent)
    comps = Staged(connected_components(first.df), "components")

    sized = comps.df.join(comps.df.groupBy("component").agg(F.count(F.lit(1)).alias("members")), "component")

    def errors(chunk: Column) -> Column:
        """How many values of a chunk differ between x and y."""
        out = F.lit(0)
        for half in (0, 1):
            differ = F.get("x.values", chunk * 2 + half).bitwiseXOR(F.get("y.values", chunk * 2 + half))
            for lane in (0, 16, 32):
                out = out + (F.shiftright(differ, lane).bitwiseAND(F.lit(0xFFFF)) != 0).cast("int")
        return out

    chunk = F.floor(F.col("x.place") / CHUNK_VALUES).cast("int")
    # a pair comes from the first chunk with one error at most alone, and if without error, from its first key alone
    once = (F.col("x.place") % CHUNK_VALUES == 0) | (errors(chunk) == 1)
    for j in range(chunks_for(percent) - 1):
        once = once & ((chunk <= j) | (errors(F.lit(j)) > 1))

    # only documents that share enough with other components can link any further
    able = facts.where(F.col("shared") * 100 >= F.col("n") * percent).join(sized, "id", "left").withColumns({"component": F.coalesce("component", "id"), "members": F.coalesce("members", F.lit(1))})
    able = Staged(able, "able").df
    able = able.join(_cross_counts(sets.df, able.select("id", "component")), "id").where(F.col("cross") * 100 >= F.col("n") * percent)
    placed = members.drop("pivot").join(able.withColumnRenamed("id", "doc_id"), "doc_id")
    placed = Staged(placed, "placed")
    mixed = placed.df.groupBy("key").agg(F.max(F.struct("members", "component")).alias("top"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    mixed = Staged(mixed.select("key", F.col("top.component").alias("top")), "mixed").df
    left = Staged(placed.df.join(mixed, "key").where("component <> top"), "left").df.alias("x")
    both_ways = (F.col("y.component") == F.col("x.top")) | (F.col("x.doc_id") < F.col("y.doc_id"))  # else each comes twice
    rest = left.join(placed.df.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & both_ways & alike("x", "y", "cross") & once)
    rest = rest.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).join(star.df, ["a", "b"], "left_anti")
    rest = Staged(rest, "rest")
    placed.drop()
    second = _confirmed(rest.df, sets.df, percent)
    sets.drop()
    lead = comps.df.select(F.col("id"), F.col("component"))
    joined = second.df.join(lead.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(lead.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    merged = connected_components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = Staged(merged, "merged").df
    final = lead.unionByName(merged.join(lead, "id", "left_anti").select("id", F.col("id").alias("component"))).alias("l").join(merged.select(F.col("id").alias("component"), F.col("component").alias("into")), "component", "left")
    return signed, classes, Staged(final.select(F.col("id").alias("rep"), F.coalesce("into", "component").alias("component_id")), "final")


def drop_near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that with the smallest id. Rules as in near_duplicates."""
    with staging() as tables:
        judged = tables.keep(Staged(near_duplicates(docs, percent, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("id")), "dropped"))
    return without_ids(docs, judged.df, id_col)
