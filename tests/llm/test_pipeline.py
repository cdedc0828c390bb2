"""The pipeline: every stage's decisions take effect, and its rows are those of brute force."""

import sys
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")

from test_dedup import brute_near, near_fixture  # noqa: E402
from test_native import brute_targets, norm  # noqa: E402

from buildlens.llm.packing import load_tokenizer  # noqa: E402


def test_pipeline_against_brute_force(spark, tmp_path):
    import public_tokenizers

    base = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}") for i, t in near_fixture(1)]
    base += [(2000 + i, t, "en", None) for i, (_, t, _, _) in enumerate(base[:30])] + [(3000, "12 34", "en", "s0"), (3001, "漢字 漢字 漢字", None, "s0"), (3002, None, "en", None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in base], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = {i: (t, s) for i, t, _, s in base if t and any(c.isalpha() for c in t) and i != 3001}  # 3001: no learned script
    first: dict[str, int] = {}
    for i in sorted(docs):
        first.setdefault(norm(docs[i][0]), i)
    docs = {i: docs[i] for i in first.values()}
    near = brute_near([(i, t) for i, (t, _) in docs.items()], corpus_pipeline.SIMILARITY)
    docs = {i: d for i, d in docs.items() if near[i][2]}
    sizes: dict = defaultdict(int)
    for t, s in docs.values():
        sizes[s] += len(t.split())
    assert {r["doc_id"] for r in rows} <= set(docs)

    mixed = corpus_pipeline.mixing(spark, spark.createDataFrame([(i, t, "en", s, len(t)) for i, (t, s) in docs.items()], "doc_id long, text string, lang string, source string, n_chars long"), "").collect()
    words: dict = defaultdict(int)
    for r in mixed:
        words[r["source"]] += len(r["text"].split())
        assert r["n_chars"] == len(r["text"])
    for s, target in brute_targets(sizes).items():
        assert abs(words[s] - target) <= 1

    tokens = load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want, got = defaultdict(int), defaultdict(int)
    for r in mixed:
        want[r["doc_id"]] += len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    extra = empty.withColumns({c: F.lit(1) for c in ("row", "id", "key", "sha", "possible", "score", "size", "position", "start", "_id", "words", "copy")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, extra, "")
        assert out.count() == 0
        if name != "packing":
            assert out.columns == extra.columns


def test_language_id_drops_texts_with_letters(spark):
    """The stage decides by the model: a text in a script that no document's language uses goes, whatever its label."""
    good = [(i, "the house and the tree are here", "en", "s", 31) for i in range(30)]
    docs = spark.createDataFrame([*good, (100, "漢字漢字 漢字", "en", "s", 7), (101, "привет мир", None, "s", 10)], "doc_id long, text string, lang string, source string, n_chars long").where("doc_id <> 100 or crc32('100') % 3 = 1")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {i for i, *_ in good}


def test_stages_take_nulls_repeats_and_long_texts(spark):
    rows = [(1, "the house " * 30_000, "en", "s", 1), (2, None, None, None, None), (None, "the tree and the house are here now", "en", None, None), (3, "the house and a tree", "en", "s", 20), (3, "the house and a tree", "en", "s", 20), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {name: sorted((r["doc_id"] or 0) for r in stage(spark, docs, "").collect()) for name, stage in corpus_pipeline.STAGES}
    assert kept["language_id"] == [0, 1, 3, 3]
    assert kept["exact_dedup"] == [0, 1, 2, 3]  # null text counts as empty: 4 repeats 2
    assert kept["near_dedup"] == [0, 1, 2, 3, 3, 4]
    assert set(kept["mixing"]) <= {0, 1, 3}
    assert set(kept["packing"]) == {0, 1, 2, 3, 4}
