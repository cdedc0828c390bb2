"""Shared helpers: staged tables, words, what workers keep."""

import numpy as np
import pyarrow as pa
import pytest

from buildlens.llm import common


def test_word_hashes_are_those_of_the_words():
    a, b = common.WordHash(most=2), common.WordHash()
    words = [b"x", b"y", b"z", b"x", "é".encode()]
    assert list(a.of(words)) == list(b.of(words))
    assert len(a) == 2


def test_gram_hashes_tell_runs_apart():
    words = common.WordHash().of(b"a b c a b d".split())
    grams = common.gram_hashes(words, 2)
    assert len(grams) == 5
    assert grams[0] == grams[3]
    assert len(np.unique(grams)) == 4
    assert len(common.gram_hashes(words, 7)) == 0


def test_workers_drop_what_other_operators_kept(spark):
    def keep(batches):
        from buildlens.llm.common import KEPT

        for b in batches:
            KEPT.setdefault("mine", {})["x"] = 1
            yield b

    def look(batches):
        from buildlens.llm.common import KEPT

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([",".join(sorted(KEPT))] * b.num_rows)], ["s"])

    one = spark.range(1).coalesce(1)
    one.mapInArrow(common.tidied(keep, keeps="mine"), "id long").collect()
    assert one.mapInArrow(common.tidied(look, keeps="mine"), "s string").first()["s"] in ("mine", "")  # another worker may answer
    assert one.mapInArrow(common.tidied(look), "s string").first()["s"] == ""


def test_staged_tables(spark):
    held = common.Staged(spark.range(5), "numbers")
    assert held.df.count() == 5
    assert held.path.startswith(common.shared_dir(spark))
    held.drop()
    held.drop()


def test_staging_drops_what_was_staged_within(spark):
    with common.staging() as outer:
        with common.staging() as tables:
            a, b = common.Staged(spark.range(3), "a"), common.Staged(spark.range(4), "b")
            tables.keep(b)
        assert not there(spark, a.path)
        assert b.df.count() == 4
        assert outer.held == [b]
    assert not there(spark, b.path)
    assert not common.staging.open


def there(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, _, default):
            return default

    class Gateway:
        sc = lambda self: self
        getCheckpointDir = lambda self: self
        isDefined = lambda self: False

    class Context:
        _jsc, master = Gateway(), "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match=r"spark.checkpoint.dir"):
        common.shared_dir(Session)
    Context.master = "local[4]"
    assert common.shared_dir(Session).startswith("file:")
    Context.master = "local-cluster[3,2,3000]"
    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


def test_batches_are_cut_by_rows_and_bytes():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 50 + ["y" * 100_000])], ["t"])
    parts = list(common.batches_of([b], rows=20, size=10_000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b]))
    assert max(p.num_rows for p in parts) <= 20
    assert len(list(common.batches_of([b.slice(0, 0)]))) == 0
    assert len(list(common.batches_of([b], rows=51, size=1 << 30))) == 1


def test_operators_leave_the_session_as_it_is(spark):
    from buildlens.llm import language_id, minhash_dedup

    before = dict(spark.conf.getAll)
    docs = spark.createDataFrame([(1, "a b", "en"), (2, "a b", "en")], "doc_id long, text string, lang string")
    minhash_dedup.near_duplicates(docs).collect()
    language_id.languages(docs).collect()
    assert dict(spark.conf.getAll) == before
