"""Near and substring dedup, components: against brute force, and their edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from buildlens.llm import minhash_dedup, substring_dedup
from buildlens.llm.common import WordHash
from buildlens.llm.components import connected_components

WORD = re.compile("[^\x20\x09-\x0d]+")


def docs_of(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string").repartition(3)


def union_find(ids, pairs):
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    some = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == union_find(some, [p for p in pairs if p[0] != p[1]])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_near(data, percent):
    sets = {}
    for i, t in data:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c, i == c) for i, c in union_find(ids, links).items()}


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"z{rng.random()}"
    return " ".join(words)


def near_fixture(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 120, 400]))] for _ in range(12)]
    data, i = [], 0
    for words in base:
        for k in range(12):
            data.append((i, edited(rng, words, rng.choice([0, 1, 1, 2, 3]) if k else 0)))
            i += 1
    chain = [f"c{k}" for k in range(200)]  # each link of a chain is near the next, its ends are not
    for k in range(10):
        data.append((i, " ".join(chain[4 * k : 4 * k + 120])))
        i += 1
    shared = [f"p{k}" for k in range(60)]  # a passage that many documents share
    for _ in range(40):
        data.append((i, " ".join([f"q{rng.random()}" for _ in range(90)] + shared)))
        i += 1
    data += [(900, None), (901, ""), (902, " \t"), (903, "One two"), (904, "one  TWO"), (905, "one two three"), (906, "É a b c d"), (907, "é a b c d"), (908, "word " * 3000)]
    rng.shuffle(data)
    return data


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    data = near_fixture(percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs_of(spark, data), percent).collect()}
    assert got == brute_near(data, percent)


def test_near_edge_cases(spark):
    d = docs_of(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")]).withColumns({c: F.lit(0) for c in ("n", "key", "row", "id", "component")})
    got = sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(d).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    kept = minhash_dedup.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 1]
    assert minhash_dedup.near_duplicates(d.limit(0)).count() == 0


def test_plan_follows_the_threshold():
    assert (minhash_dedup.chunks_for(85), minhash_dedup.chunks_for(80), minhash_dedup.chunks_for(100)) == (10, 13, 1)


def test_every_pair_within_the_distance_shares_a_key():
    """Signatures of m chunks at distance 2m - 1 at most: by pigeonhole a chunk has one error at most, so a key is shared."""
    rng = random.Random(3)
    sign = minhash_dedup.Signer(4)
    sets = [minhash_dedup.shingle_set(edited(rng, [f"w{k}" for k in range(200)], rng.randrange(12)).encode(), WordHash()) for _ in range(60)]
    signed = [sign(s) for s in sets]
    lanes = lambda packed: [(int(v) >> lane) & 0xFFFF for v in packed for lane in (0, 16, 32)]
    near = 0
    for i in range(60):
        for j in range(i):
            distance = sum(a != b for a, b in zip(lanes(signed[i][1]), lanes(signed[j][1]), strict=True))
            if distance <= 7:
                near += 1
                assert set(signed[i][0].tolist()) & set(signed[j][0].tolist())
    assert near > 100


def test_no_bound_drops_a_pair_that_is_a_link(spark):
    """Many pairs at exactly the threshold: 85 shingles of 100 in common."""
    data = []
    for i in range(60):
        shared = [f"s{i}_{k}" for k in range(89)]
        data += [(2 * i, " ".join([*shared, *[f"a{i}_{k}" for k in range(7)]])), (2 * i + 1, " ".join([*shared, *[f"b{i}_{k}" for k in range(8)]]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_dedup.near_duplicates(docs_of(spark, data), 85).collect()}
    assert got == brute_near(data, 85)
    assert sum(kept for _, _, kept in got.values()) == 60


def brute_cut(data, window):
    docs = {i: WORD.findall(t or "") for i, t in data}
    least = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - window + 1):
            least.setdefault(tuple(docs[i][k : k + window]), i)
    out = {}
    for i, w in docs.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def substring_fixture():
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(90)]
    data = []
    for i in range(60):
        words = [f"u{rng.randrange(40 if i % 5 == 0 else 9000)}" for _ in range(rng.choice([0, 3, 49, 50, 51, 200]))]
        if i % 3 == 0:
            a = rng.randrange(30)
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[a : a + rng.choice([49, 50, 55, 60])]
        data.append((i, " \n".join(words)))
    data += [(100, data[3][1]), (101, data[8][1]), (102, None), (103, "same " * 400), (104, "same " * 130), (105, "same " * 49), (106, "É " + data[3][1]), (50_000, " ".join(passage * 40))]
    rng.shuffle(data)
    return data


@pytest.mark.parametrize(("window", "group_rows"), [(50, 100_000), (50, 2), (12, 100_000), (5, 3)])
def test_substrings(spark, window, group_rows):
    data = substring_fixture()
    got = substring_dedup.drop_repeated_substrings(docs_of(spark, data), window=window, group_rows=group_rows).collect()
    want = brute_cut(data, window)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {i: v[:3] for i, v in want.items()}
    assert all(r["kept_text"] == want[r["doc_id"]][3] for r in got if r["n_removed"])


def test_blocks_of_whole_groups(spark):
    data = substring_fixture()
    held = docs_of(spark, data).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    spans = lambda rows: sorted((r["doc_id"], sorted({x for s in r["spans"] for x in range(s["start"], s["stop"])})) for r in substring_dedup.repeated_spans(held, 50, 100_000, rows)[1].df.collect())
    assert spans(1) == spans(20_000)


def test_substring_edge_cases(spark):
    text = " ".join(f"w{k}" for k in range(60))
    d = docs_of(spark, [(2, text), (2, text), (None, text), (3, text + " end")]).withColumns({c: F.lit(0) for c in ("tag", "n", "g", "spans", "sha")})
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.drop_repeated_substrings(d).collect())
    assert got == [(0, 60, 0), (2, 60, 0), (2, 60, 0), (3, 61, 60)]
    assert substring_dedup.drop_repeated_substrings(d.limit(0)).count() == 0


def test_suffix_trees_have_the_nodes_of_all_common_prefixes():
    import numpy as np

    rng = np.random.default_rng(5)
    rows = rng.integers(1, 3, size=(80, 7)).astype(np.uint32)
    tree = substring_dedup.SuffixTree(rows)
    held = [tuple(r) for r in rows.tolist()]
    prefixes = {a[:n] for a in held for b in held for n in [next((k for k in range(7) if a[k] != b[k]), 7)]} - {()}
    assert len(tree.depth) == 1 + len(prefixes)  # the root, inner nodes and ends
    for depth in range(1, 8):
        node = tree.up(tree.ends, depth)
        assert len({(n, h[:depth]) for n, h in zip(node.tolist(), held, strict=True)}) == len({h[:depth] for h in held}) == len(set(node.tolist()))
        assert (tree.depth[node] >= depth).all()
        assert (tree.depth[tree.parent[node]] < depth).all()


def test_prefixes_grow_until_groups_fit(spark):
    """A passage that many documents share, in other surroundings each: its group is split by longer prefixes."""
    rng = random.Random(12)
    passage = [f"p{k}" for k in range(70)]
    data = [(i, " ".join([*[f"u{rng.random()}" for _ in range(60)], *passage, *[f"v{rng.random()}" for _ in range(60)]])) for i in range(40)]
    docs = docs_of(spark, data).select("doc_id", F.xxhash64("text").alias("tag"), "text")
    chosen = docs.select("doc_id", "tag", "text", F.expr("array(named_struct('k', 3, 'a', 0, 'b', 40, 'g', 1L, 'g0', 1L, 'c', 1L))").alias("chosen"))
    split = chosen.mapInArrow(substring_dedup._longer_prefixes(50), substring_dedup._SUFFIX).collect()
    assert {(r["a"], r["b"]) for r in split} <= {(0, 20), (21, 40)}
    got = substring_dedup.drop_repeated_substrings(docs_of(spark, data), group_rows=3).collect()
    want = brute_cut(data, 50)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == {i: v[:3] for i, v in want.items()}
    assert sum(v[1] for v in want.values()) == 39 * 70
