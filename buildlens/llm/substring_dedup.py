"""Substring deduplication by prefix-partitioned suffix trees over words.

The suffix tree is a sparse one. Every window of `window` words has an anchor: its PREFIX-word run with the smallest
hash (the leftmost of equals). Equal windows have equal anchors at equal places, so it suffices to take the suffixes
that begin at anchors, and to keep, for each, the words before it that its windows reach back to. Suffixes whose prefix
only one document has are dropped first. Suffixes whose windows are all equal make one: that of the smallest document
stands for them, and the other documents lose all its windows.

* Suffixes are split by prefixes of variable length. A group begins with the anchor itself, PREFIX words. One of more
  than `group_rows` suffixes is split in two: of its windows, those that reach back less share a longer prefix from the
  anchor on, the others one that begins some words before it. So prefixes grow (10, 30, 40, 45 ... words) until a group
  fits; a prefix as long as the window is a single deep node, of which only the smallest document is needed.
* The suffixes of a group make a suffix tree, and the words before their anchors, read backwards, a second one. A window
  with l words before its anchor belongs to a pair of nodes, at depth l of the second tree and window - l of the first.
  Each such pair of deep nodes is a maximal repeat: the suffixes below both, for all l that lie on the nodes' edges. The
  smallest document is found once for each, and the others lose its windows.

Copies of a whole document are settled first, by their digest, and stay out of the trees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.bloom import probe_ids
from buildlens.llm.common import Staged, WordHash, batches_of, gram_hashes, lists, mix, odd_constants, raw, staging, tidied

#: A group or block of 100,000 or 20,000 suffixes takes some 100 or 20 MB with its trees.
PREFIX, WINDOW, GROUP_ROWS, BLOCK_ROWS = 10, 50, 100_000, 20_000


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor, by place: its hash, its place, the first window it is the anchor of, and how many."""
    k = min(PREFIX, window)
    if len(words) < window:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    grams = gram_hashes(words, k)
    at = np.lib.stride_tricks.sliding_window_view(grams, window - k + 1).argmin(axis=1) + np.arange(len(words) - window + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return grams[at[first]], at[first], first, np.diff(np.r_[first, len(at)])


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^n modulo 2^64, remembered."""
    held = _POWERS.get(base)
    if held is None or len(held) <= n:
        held = np.full(max(4096, 2 * n) + 1, base, np.uint64)
        held[0] = 1
        _POWERS[base] = held = np.multiply.accumulate(held)
    return held[: n + 1]


def surroundings(words: np.ndarray, at: np.ndarray, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """For each anchor a hash of all words of its windows, and of where in them it stands."""
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words))[:-1])]
    run = (sums[first + count + window - 1] - sums[first]) * _powers(pow(_BASE, -1, 1 << 64), len(words))[first]
    c = odd_constants(2, 13)
    return mix(run + (at - first).astype(np.uint64) * c[0] + count.astype(np.uint64) * c[1])


def run_hashes(words: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a run of words."""
    return tuple(int(mix((words * odd_constants(len(words), seed)).sum(keepdims=True)).view(np.int64)[0]) for seed in (5, 6))


_PLACES = [("g", pa.int64()), ("c", pa.int64()), ("first", pa.int32()), ("cnt", pa.int32())]


def _scan(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches_of(batches):
            n, sha, found = [], [], []
            for text in raw(b.column(2)):
                words = text.split() if text else []
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
                codes = hashes.of(words)
                g, at, first, count = anchors(codes, window)
                found.append((g.view(np.int64), surroundings(codes, at, first, count, window).view(np.int64) if len(g) else at, first, count))
            arrays = [lists([f[i].astype(t.to_pandas_dtype()) for f in found], t) for i, (_, t) in enumerate(_PLACES)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), *arrays], ["doc_id", "tag", "n", "sha", *(x for x, _ in _PLACES)])

    return run


_SUFFIX = "g long, h long, a int, b int, doc_id long, tag long, k int, g0 long, c long, start int"
_CONTEXT = "g long, doc_id long, g0 long, c long, start int, rel int, cnt int, words binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _over_chosen(window: int, schema: str, rows_of):
    """For (doc_id, tag, text, chosen): the rows that rows_of gives for each chosen suffix and its anchor's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches_of(batches, 256):
            out: list[tuple] = []
            for doc, tag, text, chosen in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), raw(b.column(2)), b.column(3).to_pylist(), strict=True):
                words = text.split()
                codes = hashes.of(words)
                _, at, first, count = anchors(codes, window)
                for c in chosen:
                    place, begin = int(at[c["k"]]), int(first[c["k"]])
                    # words that the windows have before the anchor: from the fewest to the most
                    out += rows_of(c, doc, tag, words, codes, place, place - begin - int(count[c["k"]]) + 1, place - begin)
                if len(out) >= 4096:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)

    return run


def _longer_prefixes(window: int):
    """Both halves of each chosen suffix's windows, a to b words before the anchor, by their common prefix."""

    def rows_of(c, doc, tag, words, codes, place, fewest, most):
        middle = (c["a"] + c["b"]) // 2
        for a, b in ((c["a"], middle), (middle + 1, c["b"])):
            if a <= most and fewest <= b:
                yield (*run_hashes(codes[place - a : place - b + window]), a, b, doc, tag, c["k"], c["g0"], c["c"], most - a)

    return _over_chosen(window, _SUFFIX, rows_of)


def _contexts(window: int):
    """Of each chosen suffix the words of its windows."""

    def rows_of(c, doc, tag, words, codes, place, fewest, most):
        low, high = max(fewest, c["a"]), min(most, c["b"])
        yield (c["g"], doc, c["g0"], c["c"], most - high, high, high - low + 1, b" ".join(words[place - high : place - low + window]))

    return _over_chosen(window, _CONTEXT, rows_of)


class SuffixTree:
    """The tree of rows of word codes, all cut to one depth: nodes with their depths and parents (node 0 is the root),
    and the node at which each row ends, which equal rows share."""

    def __init__(self, rows: np.ndarray):
        width = rows.shape[1]
        held = np.ascontiguousarray(rows.astype(">u4"))
        order = held.view(f"S{4 * width}").ravel().argsort(kind="stable")
        ordered = rows[order]
        differ = ordered[1:] != ordered[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        depth, parent, path = [0, width], [0, 0], [0, 1]  # path: the nodes above the row at hand
        ends = [1]
        for shared in common.tolist():
            if shared < width:
                last = path[-1]
                while depth[path[-1]] > shared:
                    last = path.pop()
                if depth[path[-1]] < shared:  # an inner node on the edge to the last one
                    depth.append(shared)
                    parent.append(path[-1])
                    parent[last] = len(depth) - 1
                    path.append(parent[last])
                depth.append(width)
                parent.append(path[-1])
                path.append(len(depth) - 1)
            ends.append(path[-1])
        self.depth, self.parent = np.array(depth), np.array(parent)
        self.ends = np.empty(len(rows), np.int64)
        self.ends[order] = ends

    def up(self, nodes: np.ndarray, depth: int) -> np.ndarray:
        """For each node the highest one above it that is at least so deep: the one on whose edge that depth lies."""
        while True:
            above = (nodes != 0) & (self.depth[self.parent[nodes]] >= depth)
            if not above.any():
                return nodes
            nodes = np.where(above, self.parent[nodes], nodes)


def repeated_windows(texts: list[bytes], doc: np.ndarray, rel: np.ndarray, cnt: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix trees of one block of whole groups. (row, offset in its words) of each window that a smaller document has.

    Row i holds cnt[i] windows, in words that have the anchor at rel[i].
    """
    words = [t.split(b" ") for t in texts]
    size = np.array([len(w) for w in words])
    code: dict[bytes, int] = {}
    flat = np.fromiter((code.setdefault(x, len(code) + 1) for w in words for x in w), np.uint32, size.sum())
    begin = np.r_[0, np.cumsum(size)[:-1]]
    most = int(rel.max())
    place = rel[:, None] + np.arange(window)
    after = SuffixTree(np.where(place < size[:, None], flat[np.minimum(begin[:, None] + place, len(flat) - 1)], 0).astype(np.uint32))
    place = rel[:, None] - 1 - np.arange(max(1, most))
    before = SuffixTree(np.where(place >= 0, flat[np.maximum(begin[:, None] + place, 0)], 0).astype(np.uint32))
    lefts, node = np.empty((most + 1, len(doc)), np.int32), before.ends
    for n in range(most, -1, -1):
        node = before.up(node, n)
        lefts[n] = node
    at, offsets = [], []
    least, right, was = np.full(len(doc), np.iinfo(np.int64).max), after.ends, np.full(len(doc), -1)
    for n in range(most + 1):  # words of the window that stand before the anchor
        right = after.up(right, window - n)
        pair = np.where((rel >= n) & (rel - n < cnt), right * (len(before.depth) + 1) + lefts[n], -1)
        fresh = np.flatnonzero((pair != was) & (pair >= 0))  # whole repeats, as their suffixes share all their windows
        if len(fresh):
            order = fresh[np.lexsort((doc[fresh], pair[fresh]))]
            head = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1]])
            least[order] = np.repeat(doc[order][head], np.diff(np.r_[head, len(order)]))
        hit = np.flatnonzero((pair >= 0) & (doc > least))
        at.append(hit)
        offsets.append(rel[hit] - n)
        was = pair
    return np.concatenate(at), np.concatenate(offsets)


def _trees(window: int, block_rows: int):
    """From contexts sorted by group: (g0, c, start, stop) of their words that repeated windows cover."""

    def spans(table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, g0, c, start, rel, cnt = (table.column(x).to_numpy() for x in ("doc_id", "g0", "c", "start", "rel", "cnt"))
        row, offset = repeated_windows(table.column("words").to_pylist(), doc, rel.astype(np.int64), cnt.astype(np.int64), window)
        if not len(row):
            return
        order = np.lexsort((offset, row))
        row, offset = row[order], offset[order]
        head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)])
        last = np.r_[head[1:], len(row)] - 1
        r = row[head]
        yield pa.RecordBatch.from_arrays([pa.array(g0[r]), pa.array(c[r]), pa.array((start[r] + offset[head]).astype(np.int32)), pa.array((start[r] + offset[last] + window).astype(np.int32))], ["g0", "c", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches_of(batches, 8192):
            held.append(b)
            rows += b.num_rows
            if rows >= block_rows:
                table = pa.Table.from_batches(held)
                g = table.column("g").to_numpy()
                whole = int(np.searchsorted(g, g[-1], "left"))  # the last group may go on in the next batch
                if whole:
                    yield from spans(table.slice(0, whole))
                held = table.slice(whole).to_batches()
                rows = sum(x.num_rows for x in held)
        if rows:
            yield from spans(pa.Table.from_batches(held))

    return run


def _cut(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            gone, sha, left = [], [], []
            for text, spans in zip(raw(b.column(2)), b.column(3).to_pylist(), strict=True):
                words = text.split()
                drop = np.zeros(len(words) + 1, np.int32)
                for s in spans:
                    drop[s["start"]] += 1
                    drop[s["stop"]] -= 1
                kept = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
                gone.append(len(words) - len(kept))
                joined = b" ".join(kept)
                sha.append(hashlib.sha256(joined).hexdigest())
                left.append(joined.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.int64()), pa.array(sha), pa.array(left, pa.string())], ["doc_id", "tag", "n_removed", "kept_sha256", "kept_text"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> tuple[Staged, Staged]:
    """For docs (doc_id, tag, text): the scanned rows with `copy` (a whole copy of a smaller document), and
    (doc_id, tag, spans array<struct<start, stop>>) of the word spans to remove from the others."""
    listed = ", ".join(f"{x} array<{'long' if t == pa.int64() else 'int'}>" for x, t in _PLACES)
    scanned = Staged(docs.mapInArrow(tidied(_scan(window)), f"doc_id long, tag long, n long, sha binary, {listed}"), "scan").df
    long = scanned.where(F.col("doc_id").isNotNull() & (F.col("n") >= window))
    classes = Staged(long.groupBy("sha").agg(F.min("doc_id").alias("least")), "classes").df
    marked = scanned.drop(*[x for x, _ in _PLACES]).join(classes, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("least")
    marked = Staged(marked, "marked")
    firsts = long.join(classes, "sha").where("doc_id = least")
    places = firsts.select("doc_id", "tag", F.posexplode(F.arrays_zip(*[x for x, _ in _PLACES])).alias("k", "p")).select("doc_id", "tag", "k", "p.*")
    several = Staged(places.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("g"), "several").df
    members = Staged(places.join(several, "g"), "members").df
    # equal surroundings make one suffix, at its first place in the smallest document
    distinct = Staged(members.groupBy("g", "c").agg(F.min(F.struct("doc_id", "tag", "k")).alias("p")).select("g", "c", "p.*"), "distinct").df
    group = ["g", "h", "a", "b"]

    def shared(suffixes: DataFrame) -> DataFrame:
        """(group, rows) of groups in which there are several documents."""
        found = suffixes.groupBy(*group).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("rows"))
        return Staged(found.where("lo <> hi").select(*group, "rows"), "groups").df

    def texts_of(chosen: DataFrame) -> DataFrame:
        """docs that have a chosen suffix, with all of theirs."""
        listed = Staged(chosen.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("k", "a", "b", "g", "g0", "c")).alias("chosen")), "chosen").df
        possible = probe_ids(docs, listed.select(F.col("doc_id").alias("id")).distinct(), "doc_id").where("possible").select("row.*")
        return possible.join(listed, ["doc_id", "tag"]).select("doc_id", "tag", "text", "chosen")

    suffixes = distinct.select("g", F.lit(0).cast("long").alias("h"), F.lit(0).alias("a"), F.lit(window - min(PREFIX, window)).alias("b"), "doc_id", "tag", "k", F.col("g").alias("g0"), "c")
    small, nodes = None, None
    while True:
        sizes = shared(suffixes)
        fits = suffixes.join(sizes.where(F.col("rows") <= group_rows), group).select(*suffixes.columns)
        small = fits if small is None else small.unionByName(fits)
        large = sizes.where(F.col("rows") > group_rows)
        if not large.head(1):
            break
        split = Staged(texts_of(suffixes.join(large, group)).mapInArrow(tidied(_longer_prefixes(window)), _SUFFIX), "suffixes").df
        whole = split.where("a = b")  # a prefix as long as the window
        nodes = whole if nodes is None else nodes.unionByName(whole)
        suffixes = split.where("a < b").drop("start")
    small = small.select("doc_id", "tag", "k", "a", "b", "g0", "c", F.xxhash64(*group).alias("g"))
    contexts = Staged(texts_of(small).mapInArrow(tidied(_contexts(window)), _CONTEXT), "contexts")
    cut = contexts.df.repartition("g").sortWithinPartitions("g").mapInArrow(tidied(_trees(window, block_rows)), "g0 long, c long, start int, stop int")
    if nodes is not None:
        least = Staged(nodes.groupBy(*group).agg(F.min("doc_id").alias("least")), "least").df
        cut = cut.unionByName(nodes.join(least, group).where("doc_id > least").select("g0", "c", "start", (F.col("start") + window).alias("stop")))
    cut = Staged(cut.select(F.col("g0").alias("g"), "c", F.struct("start", "stop").alias("cut")).groupBy("g", "c").agg(F.collect_list("cut").alias("cut")), "cut").df
    all_of = F.array(F.struct(F.lit(0).alias("start"), (F.col("cnt") - 1 + window).alias("stop")))
    facts = distinct.select("g", "c", F.col("doc_id").alias("least")).join(cut, ["g", "c"], "left")
    held = members.join(Staged(facts, "facts").df, ["g", "c"]).withColumn("cut", F.when(F.col("doc_id") > F.col("least"), all_of).otherwise(F.col("cut"))).where("cut is not null")
    held = held.select("doc_id", "tag", F.transform("cut", lambda x: F.struct((x["start"] + F.col("first")).alias("start"), (x["stop"] + F.col("first")).alias("stop"))).alias("cut"))
    return marked, Staged(held.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("cut")).alias("spans")), "spans")


def drop_repeated_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS, texts: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Every word covered by a window of `window` consecutive words that also starts in a document with a smaller id is
    removed; windows are judged on the input. kept_text has the kept words joined by one space; it is null where nothing
    is removed (the text stays as it is) and empty where nothing is left; without `texts` it is null or empty. Words are
    runs between ASCII white space. A null text has no words; texts of any length are read whole. Rows with a null id
    keep everything and are no other row's smaller document; rows that repeat an id count as one document. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    with staging() as tables:
        marked, spans = repeated_spans(held, window, group_rows)
        possible = probe_ids(held, spans.df.select(F.col("doc_id").alias("id")).distinct(), "doc_id").where("possible").select("row.*")
        cut = possible.join(spans.df, ["doc_id", "tag"]).select("doc_id", "tag", "text", "spans")
        cut = Staged(cut.mapInArrow(tidied(_cut(texts)), "doc_id long, tag long, n_removed long, kept_sha256 string, kept_text string"), "cut")
        tables.keep(marked), tables.keep(cut)
    cut = cut.df.dropDuplicates(["doc_id", "tag"])  # rows that repeat an id and a text are cut alike
    nothing = hashlib.sha256(b"").hexdigest()
    out = marked.df.join(cut, ["doc_id", "tag"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
