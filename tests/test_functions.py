import posixpath

import pytest
from pyspark.sql import functions as F

from buildlens.functions import bytecode, paths, solidity, versions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path", ["a/./b/../c", "../a/b", "a/../../b", "/a/../../b", "a//b/", ".", "/", "a/b/../..", "../../x"])
def test_clean_path_is_lexical(spark, path):
    expected = posixpath.normpath(path)
    assert one(spark, paths.clean_path(F.lit(path))) == ("" if expected == "." else expected)


@pytest.mark.parametrize(("base", "path"), [("a/b", "a/c/d"), ("a", "a"), ("x/y/z", "x/q"), ("/r/a", "/r/b/c"), ("a", "a/b")])
def test_rebase(spark, base, path):
    expected = posixpath.relpath("/" + path.lstrip("/"), "/" + base.lstrip("/"))
    assert one(spark, paths.rebase_path(F.lit(base), F.lit(path))) == ("" if expected == "." else expected)


def test_prefixes_compare_by_component(spark):
    assert one(spark, paths.is_under(F.lit("lib/a"), F.lit("lib/")))
    assert not one(spark, paths.is_under(F.lit("library/a"), F.lit("lib")))
    assert one(spark, paths.strip_prefix(F.lit("lib/a/b"), F.lit("lib"))) == "a/b"
    assert one(spark, paths.strip_prefix(F.lit("library/a"), F.lit("lib"))) == "library/a"
    assert one(spark, paths.common_ancestor(F.lit("/a/b/c"), F.lit("/a/bc"))) == "/a"
    assert one(spark, paths.common_ancestor(F.lit("a/b"), F.lit("c/b"))) is None
    assert one(spark, paths.ancestors(F.lit("/a/b/c"))) == ["/a/b", "/a", "/"]
    assert one(spark, paths.ancestors(F.lit("c"))) == []


def test_names(spark):
    p, n = F.lit("src/My.t.sol"), F.lit("C")
    assert one(spark, paths.file_stem(p)) == "My.t"
    assert one(spark, paths.extension(p)) == "sol"
    assert one(spark, paths.slug(p, n)) == "My.t.json:C"
    assert one(spark, paths.slug_versioned(p, n, versions.version(0, 8, 1))) == "My.t.0.8.1.json:C"
    assert one(spark, paths.identifier(p, n)) == "src/My.t.sol:C"
    assert one(spark, paths.output_file(p, n, F.lit("0.8.1"), F.lit("via-ir"))) == "My.t.sol/C.0.8.1.via-ir.json"
    assert one(spark, paths.output_file_name(n)) == "C.json"
    assert one(spark, paths.slash_path(F.lit("a\\b"))) == "a/b"
    assert one(spark, paths.guess_language(F.lit("a.vyi"))) == "Vyper"
    assert one(spark, paths.guess_language(F.lit("a.txt"))) is None


@pytest.mark.parametrize(("text", "expected"), [("a/=lib/a/", (None, "a/", "lib/a/")), ("ctx:a/=x", ("ctx", "a/", "x")), (":a/=x", (None, "a/", "x")), (" =x", None), ("a=", None), ("a", None)])
def test_parse_remapping(spark, text, expected):
    found = one(spark, paths.parse_remapping(F.lit(text)))
    assert (None if found is None else tuple(found)) == expected


def test_parse_contract_info(spark):
    assert tuple(one(spark, paths.parse_contract_info(F.lit("src/A.sol:B")))) == ("src/A.sol", "B")
    assert tuple(one(spark, paths.parse_contract_info(F.lit("B")))) == (None, "B")
    assert tuple(one(spark, paths.parse_contract_info(F.lit("x:y:B")))) == ("y", "B")


REQUIREMENTS = [
    ("^0.8.4", [(0, 8, 4), (0, 8, 99)], [(0, 8, 3), (0, 9, 0)]),
    ("^1.2", [(1, 2, 0), (1, 9, 0)], [(2, 0, 0), (1, 1, 9)]),
    ("^0.0.3", [(0, 0, 3)], [(0, 0, 4)]),
    ("~0.8.4", [(0, 8, 4), (0, 8, 9)], [(0, 9, 0)]),
    ("0.8.19", [(0, 8, 19)], [(0, 8, 20)]),  # a bare version is exactly that one
    ("0.8", [(0, 8, 0), (0, 8, 30)], [(0, 9, 0)]),
    (">=0.7.0 <0.9.0", [(0, 7, 0), (0, 8, 30)], [(0, 9, 0), (0, 6, 9)]),
    (">0.7", [(0, 8, 0)], [(0, 7, 6)]),
    ("<=0.8.3", [(0, 8, 3), (0, 1, 0)], [(0, 8, 4)]),
    ("=0.8.3", [(0, 8, 3)], [(0, 8, 2)]),
    ("*", [(0, 0, 0), (9, 0, 0)], []),
    ("0.8.*", [(0, 8, 5)], [(0, 7, 5)]),
]


@pytest.mark.parametrize(("text", "yes", "no"), REQUIREMENTS)
def test_requirements(spark, text, yes, no):
    r = versions.parse_requirement(F.lit(text))
    for v in yes:
        assert one(spark, versions.matches(r, versions.version(*v))), v
    for v in no:
        assert not one(spark, versions.matches(r, versions.version(*v))), v


@pytest.mark.parametrize("text", [">= 0.8.0", "abc", "^0.8.0 ||", ""])
def test_requirements_that_are_none(spark, text):
    assert one(spark, versions.parse_requirement(F.lit(text))) is None


def test_evm_versions(spark):
    at = lambda name, v: one(spark, versions.normalise_evm(F.lit(name), versions.version(*v)))
    assert at("osaka", (0, 8, 30)) == "osaka"
    assert at("osaka", (0, 8, 20)) == "shanghai"
    assert at("cancun", (0, 8, 18)) == "paris"
    assert at("homestead", (0, 8, 30)) == "homestead"
    assert at("london", (0, 4, 20)) is None
    default = lambda v: one(spark, versions.default_evm(versions.version(*v)))
    assert [default(v) for v in [(0, 4, 21), (0, 4, 25), (0, 8, 24), (0, 8, 25), (0, 8, 27), (0, 8, 28)]] == ["byzantium", "byzantium", "shanghai", "cancun", "cancun", "prague"]


def test_restrictions(spark):
    i = lambda x: F.lit(x).cast("int")
    assert tuple(one(spark, versions.merge_restrictions(i(1), i(None), i(3), i(9)))) == (3, 9)
    assert one(spark, versions.merge_restrictions(i(5), i(None), i(None), i(4))) is None
    assert one(spark, versions.apply_restriction(i(None), i(7), i(None))) == 7
    assert one(spark, versions.apply_restriction(i(2), i(7), i(9))) == 7
    assert one(spark, versions.apply_restriction(i(None), i(None), i(None))) is None
    assert not one(spark, versions.satisfies(i(1), i(None), i(None)))
    assert one(spark, versions.satisfies(i(None), i(None), i(None)))
    assert one(spark, versions.sanitised("via_ir", F.lit(True), versions.version(0, 7, 4))) is None
    assert one(spark, versions.sanitised_output_selection(F.array().cast("array<string>"), ["ir"])) == ["abi"]


SOURCE = """// SPDX-License-Identifier: MIT
pragma solidity ^0.8.0;
pragma experimental ABIEncoderV2;
import "./A.sol";
import './B.sol' as B;
import {C as D, E} from "c/C.sol";
import * as G from 'g.sol';
abstract contract X is E {}
interface Y$ {}
library L { function f() internal {} }
library M { function f() public {} }
"""


def test_extraction(spark):
    c = F.lit(SOURCE)
    assert one(spark, solidity.version_text(c)) == "^0.8.0"
    assert one(spark, solidity.license_of(c)) == "MIT"
    assert one(spark, solidity.license_of(F.concat(F.lit("\n"), c))) is None  # the first line only
    assert one(spark, solidity.import_paths(c)) == ["./A.sol", "./B.sol", "c/C.sol", "g.sol"]
    found = [[tuple(a) for a in i["aliases"]] for i in one(spark, solidity.imports(c))]
    assert found == [[], [(None, "B")], [("C", "D")], [(None, "G")]]
    assert one(spark, solidity.contract_names(c)) == ["X", "Y$", "L", "M"]
    assert [tuple(x) for x in one(spark, solidity.libraries(c))] == [("L", True), ("M", False)]
    assert one(spark, solidity.references_name(c, F.lit("E")))
    assert not one(spark, solidity.references_name(c, F.lit("Zz")))
    assert one(spark, solidity.normal_newlines(F.lit("a\r\nb\rc"))) == "a\nb\rc"
    assert one(spark, solidity.version_text(F.lit(""))) is None
    assert one(spark, solidity.import_paths(F.lit(""))) == []


def test_vyper(spark):
    text = F.lit("# @version ^0.3\n#@version ^0.4.0\nfrom . import a\nfrom ..x.y import b as c\nimport d.e\nx: int = 1\n")
    assert one(spark, solidity.vyper_version(text)) == "^0.4.0"
    assert [tuple(x) for x in one(spark, solidity.vyper_imports(text))] == [(1, "a"), (2, "x.y.b"), (0, "d.e")]
    assert one(spark, solidity.compiler_version(F.lit("solc\nVersion: 0.8.1+commit.df193b15.Linux.g++\n\n"))) == "0.8.1+commit.df193b15.Linux.gcc"
    assert one(spark, solidity.interface_text(F.lit("a\n   b"))) == "a b"


def test_bytecode(spark):
    assert bytecode.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert bytecode.keccak256(b"x" * 136) != bytecode.keccak256(b"x" * 135)
    name = "src/Lib.sol:Lib"
    digest = one(spark, bytecode.library_hash(F.lit(name)))
    assert digest == bytecode.keccak256(name.encode())[:17].hex()
    new, old = f"60__${digest}$__61", "60__" + name.ljust(36, "_") + "__61"
    for code in (new, old):
        c = F.lit(code)
        assert one(spark, bytecode.contains_placeholder(c, F.lit(name), F.lit(digest)))
        assert one(spark, bytecode.link(c, F.lit(name), F.lit(digest), F.lit("0x" + "AA" * 20))) == "60" + "aa" * 20 + "61"
        assert one(spark, bytecode.decode(c)) is None
    assert bytes(one(spark, bytecode.without_placeholders(F.lit(new)))) == b"\x60" + b"\0" * 20 + b"\x61"
    assert bytes(one(spark, bytecode.decode(F.lit("0x6001")))) == b"\x60\x01"
    assert one(spark, bytecode.library_hash(F.lit(None).cast("string"))) is None


def test_locations_and_kinds(spark):
    assert tuple(one(spark, bytecode.source_location(F.lit("5:7:-1")))) == (5, 7, None)
    t, n = F.lit(True), F.lit(None).cast("string")
    assert one(spark, bytecode.state_mutability(n, t, F.lit(False))) == "view"
    assert one(spark, bytecode.function_kind(n, F.lit(False), F.lit(""))) == "fallback"
    assert one(spark, bytecode.variable_mutability(n, F.lit(False))) == "mutable"
