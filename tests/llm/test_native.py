"""URL filters, source mixing, exact dedup: against brute force, and their edge cases."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from buildlens.llm import bloom, exact_dedup, mixing, url_filters
from buildlens.llm.queries import URL_RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, data):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in data], SCHEMA)


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


TEXTS = [(5, "a  b", "s"), (3, "a\tb", "s"), (9, "a b", None), (1, None, "s"), (2, "", "s"), (4, " ", "s"), (6, " ", "s"), (7, "x" * 50_000, "s"), (8, "x" * 50_000, "t"), (3, "a\tb", "s"), (None, "a b", "s"), (10, "only", None)]


def test_exact_groups(spark):
    got = exact_dedup.exact_groups(docs_of(spark, TEXTS)).collect()
    assert len(got) == len(TEXTS)
    groups = defaultdict(list)
    for i, t, _ in TEXTS:
        groups[norm(t)].append(i)
    for r in got:
        sha_of = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        ids = sha_of[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min(x for x in ids if x is not None)
    for t, ids in groups.items():
        kept = [r["doc_id"] for r in got if r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest() and r["kept"]]
        assert kept == [min(x for x in ids if x is not None)]  # one row, although 3 is there twice


def test_exact_copies_go_and_columns_stay(spark):
    d = docs_of(spark, TEXTS).withColumns({c: F.lit(1) for c in ("key", "row", "sha", "possible", "_id", "first", "keep_id")})
    out = exact_dedup.drop_exact_copies(d)
    assert out.columns == d.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 6, 7, 10]
    assert exact_dedup.drop_exact_copies(d.limit(0)).count() == 0
    assert exact_dedup.exact_groups(d.limit(0)).count() == 0


def test_all_rows_equal(spark):
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = exact_dedup.exact_groups(d)
    assert got.where("kept").count() == 1
    assert got.agg(F.min("group_size")).first()[0] == 500


def test_bloom_never_misses_and_mostly_passes(spark):
    rows = spark.range(4000).select(F.xxhash64(F.when(F.col("id") < 200, F.col("id") % 100).otherwise(F.col("id"))).alias("key"), "id")
    bits = bloom.filter_bits(4000)
    marked = bloom.mark_possible(rows, bloom.filter_words(rows.select("key"), bits, least=2), bits)
    assert marked.where("id < 200 and not possible").count() == 0
    assert marked.where("id >= 200 and possible").count() < 400
    assert bloom.without_ids(spark.range(10).withColumnRenamed("id", "doc_id"), spark.range(3)).count() == 7


def test_more_keys_than_a_filter_holds(spark, monkeypatch):
    """With filters of 4,096 bits, 2,000 texts have 8 filters: results are whole, and most unique rows still pass through."""
    monkeypatch.setattr(bloom, "MAX_BITS", 4096)
    assert (bloom.ranges_for(256), bloom.ranges_for(2000)) == (1, 8)
    d = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") < 100, F.col("id") % 50).otherwise(F.col("id"))).alias("text"), F.lit("x").alias("_range"))
    rows = d.select("doc_id", F.xxhash64("text").alias("key"))
    marked = bloom.Bloom(rows.select("key"), 2000, least=2).mark(rows)
    assert marked.columns == ["doc_id", "key", "possible"]
    assert marked.count() == 2000
    assert marked.where("doc_id < 100 and not possible").count() == 0
    assert marked.where("doc_id >= 100 and possible").count() < 0.1 * 1900
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(d).collect()}
    assert got == {i: (i % 50, 2) if i < 100 else (i, 1) for i in range(2000)}
    kept = exact_dedup.drop_exact_copies(d)
    assert kept.columns == d.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(2000) if not 50 <= i < 100]
    gone = bloom.without_ids(d, spark.range(0, 2000, 2))
    assert sorted(r["doc_id"] for r in gone.collect()) == list(range(1, 2000, 2))


def test_copies_with_one_id_leave_the_same_row_each_time(spark):
    rows = [(1, "a b", c) for c in "zyxw"] + [(2, "a  b", "v")]
    kept = {tuple(exact_dedup.drop_exact_copies(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, other string")).first()) for k in range(4)}
    assert len(kept) == 1
    assert next(iter(kept))[0] == 1


def brute_url(url, rules=URL_RULES):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = max(((len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    "http://x.example.com/en/7817?u=1", "https://EXAMPLE.com/en/8", "http://com/en/", "http://a.net/de/8", "https://b.example.net/de/8#x", "http://b.example.net/de/9", "http://notexample.com/en/7", "http://x.org/es/", "http://x.org/es", None, "", "no scheme/en/", "http://",
    "://com/en/", "http://com?/en/", "http://.com/en/7", "http://example.com./en/7", "http://É.com/en/", "http://x.com/en/" + "y" * 9000, "ftp://u@h.net:8/de/8",
]


@pytest.mark.parametrize(("bits", "hashes"), [(24, 4), (1, 1)])
def test_urls(spark, bits, hashes):
    data = [(i, u) for i, u in enumerate(URLS + [f"http://h{k}.example.{t}/{p}/{k}" for k in range(60) for t in ("com", "net", "org") for p in ("en", "de", "es")])]
    pages = spark.createDataFrame(data, "page_id int, url string").withColumns({"host": F.lit("old"), "key": F.lit(1), "rule": F.lit("old")})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages, URL_RULES, bits_per_key=bits, hashes=hashes).collect()}
    assert got == {i: brute_url(u) for i, u in data}
    assert url_filters.judge_urls(pages.limit(0), URL_RULES).count() == 0
    assert url_filters.judge_urls(pages, []).where("verdict = 'allow' and rule is null").count() == len(data)


def test_cascade_is_exact_with_tiny_filters(spark):
    listed = spark.range(0, 60).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(0, 600).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filters.Cascade(listed, universe, bits_per_key=2, hashes=1)
    assert len(cascade.levels) > 2
    got = universe.where(cascade.has(F.col("key"))).collect()
    assert sorted(r["key"] for r in got) == sorted(f"k{i}" for i in range(60))


@pytest.mark.parametrize("bits", [64, 256])
def test_cascade_ends_where_one_filter_would_be_full(spark, monkeypatch, bits):
    monkeypatch.setattr(url_filters, "MAX_BITS", bits)
    listed = spark.range(0, 300).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(0, 900).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = url_filters.Cascade(listed, universe, bits_per_key=4, hashes=2)
    assert cascade.levels[0].segments > 1
    assert len(cascade.levels) < 20
    assert sorted(r["key"] for r in universe.where(cascade.has(F.col("key"))).collect()) == sorted(f"k{i}" for i in range(300))


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


MIX = [(i, " ".join(["w"] * (i % 9)), s) for i, s in enumerate(["a"] * 30 + ["b"] * 3 + ["é"] * 12 + [None] * 5 + ["B"] * 9)] + [(1000, "w " * 4000, "a"), (2000, None, "a"), (2001, "", "b"), (2000, None, "a"), (None, "x y z", "a")]


def test_mixing(spark):
    d = docs_of(spark, MIX)
    got = mixing.mixed(d).collect()
    assert len(got) == len(MIX)
    sizes = defaultdict(int)
    for _, t, s in MIX:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1
    again = mixing.mixed(d.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    positions = [r["first_position"] for r in got if r["first_position"] is not None]
    assert positions == sorted(positions)
    assert all(0 <= p <= 1 for p in positions)
    assert mixing.mixed(d.limit(0)).count() == 0


def test_mixing_without_words(spark):
    got = mixing.mixed(docs_of(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r["size"], r["target"], r["taken"], r["first_position"]) for r in got] == [(0, 0.0, 0, None)] * 2


def test_buckets_of_a_hot_source(spark, monkeypatch):
    d = spark.range(700).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 600, "hot").otherwise("b").alias("source"))
    whole = sorted(map(str, mixing.mixed(d).collect()))
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 50)
    assert sorted(map(str, mixing.mixed(d).collect())) == whole


@pytest.mark.parametrize("tilt", [-1.0, -0.5, 0.0, 0.5, 1.0])
def test_positions_invert_the_integral(spark, tilt):
    for u in (0.01, 0.3, 0.99):
        t = spark.range(1).select(mixing.position(F.lit(100 * u), F.lit(100), F.lit(tilt))).first()[0]
        assert t + tilt * (t * t - t) == pytest.approx(u)


def test_mixed_documents(spark):
    data = [(i, f"t{i} " * (5 + i % 4), "abc"[i % 3]) for i in range(40)]
    d = docs_of(spark, data).withColumns({"size": F.lit(1), "row": F.lit(2), "position": F.lit(3)})
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
    sizes = {s: sum(len(t.split()) for _, t, x in data if x == s) for s in "abc"}
    for s, target in brute_targets(sizes).items():
        assert abs(words[s] - target) <= 1
    assert mixing.mixed_documents(d.limit(0)).count() == 0


def test_mixing_repeated_ids_nulls_and_long_texts(spark):
    data = [(1, "a b c", "s"), (1, "d e", "s"), (None, "f g", "s"), (2, None, "t"), (3, "", None), (4, "w " * 60_000, None)]
    d = docs_of(spark, data).withColumns({"start": F.lit(1), "p": F.lit(2)})
    first = sorted(map(str, mixing.mixed_documents(d).collect()))
    assert first == sorted(map(str, mixing.mixed_documents(d.repartition(5)).collect()))
    got = mixing.mixed_documents(d.drop("n_chars").withColumn("n_chars", F.lit("kept")), chars_col=None).collect()
    assert {r["n_chars"] for r in got} == {"kept"}
    assert {r["doc_id"] for r in got} <= {1, None, 4}
    assert sum(len(r["text"].split()) for r in got if r["source"] is None) > 59_000
