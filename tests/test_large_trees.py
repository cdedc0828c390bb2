import os

from pyspark.sql import functions as F

from buildlens.sources import scan


def by_spark(spark, root, extensions):
    """Spark's own reader, whose driver holds the listing."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    return sorted((r["path"].removeprefix(f"file:{root}/"), r["length"], r["modificationTime"]) for r in df.drop("content").collect())


def put(root, names):
    for n in names:
        os.makedirs(os.path.dirname(f"{root}/{n}"), exist_ok=True)
        with open(f"{root}/{n}", "w") as f:
            f.write(n + "\r\n")


def test_trees_are_listed_by_executors(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "a b%20[x]")
    names = [f"d{i}/e{i % 3}/F{i}.sol" for i in range(40)] + ["top.sol", "deep/1/2/3/4/5/6.yul", "é/x y%.sol"]
    put(root, [*names, "no.txt", ".git/a.sol", "_x/b.sol", "_k=v/c.sol", "d1/_d.sol", "d1/.e.sol", "d1/F.SOL"])
    os.symlink(f"{root}/deep", f"{root}/link")
    os.symlink(f"{root}/gone", f"{root}/gone.sol")
    plain = str(tmp_path / "plain")
    os.symlink(root, plain)
    want = by_spark(spark, plain, ("sol", "yul"))
    assert [p for p, *_ in want] == sorted([*names, "_k=v/c.sol", "link/1/2/3/4/5/6.yul"])
    # the driver asks Spark's reader for no listing
    monkeypatch.setattr(type(spark), "read", property(lambda s: (_ for _ in ()).throw(AssertionError("listed by the driver"))))
    for wanted in (1, 3, 1000):
        monkeypatch.setattr(scan, "_branches", lambda r, _, f=scan._branches, w=wanted: f(r, w), raising=False)
        for given in (root, f"file://{plain}", plain + "/"):
            assert sorted(tuple(r) for r in scan.source_listing(spark, given).collect()) == want
            assert sorted(tuple(r) for r in scan.source_files(spark, given).collect()) == [(p, {"link/1/2/3/4/5/6.yul": "deep/1/2/3/4/5/6.yul"}.get(p, p) + "\n") for p, *_ in want]
        monkeypatch.undo()
        monkeypatch.setattr(type(spark), "read", property(lambda s: (_ for _ in ()).throw(AssertionError("listed by the driver"))))


def test_branches_stay_few(tmp_path):
    put(str(tmp_path), [f"many/{i}/f.sol" for i in range(30)] + ["few/1/f.sol", "few/2/f.sol"])
    found = scan._branches(str(tmp_path), 100, most=10)
    assert sorted(found) == [("", False), ("few/", False), ("few/1/", False), ("few/2/", False), ("many/", True)]
    assert sorted(scan._branches(str(tmp_path), 2)) == [("", False), ("few/", True), ("many/", True)]


def test_large_and_broken_files(spark, tmp_path):
    (tmp_path / "a.sol").write_bytes(b"x" * (5 << 20))
    (tmp_path / "b.sol").write_bytes(b"\xff\r")
    (tmp_path / "c.sol").write_bytes(b"")
    got = scan.source_files(spark, str(tmp_path)).select("path", F.length("content").alias("n")).collect()
    assert sorted(map(tuple, got)) == [("a.sol", 5 << 20), ("b.sol", 2), ("c.sol", 0)]
    assert sorted(r["length"] for r in scan.source_listing(spark, str(tmp_path)).collect()) == [0, 2, 5 << 20]
