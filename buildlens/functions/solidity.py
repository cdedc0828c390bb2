"""Extraction from source text by regular expressions, as columns (the patterns are fixed values).

This is the whole extraction of texts that no parser takes; with compiler output at hand, operators.ast reads the same
from syntax trees.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from buildlens.functions.versions import parse_requirement

# What all tools of this language agree on.
PRAGMA = r"pragma\s+solidity\s+(.+?);"
LICENSE = r"///?\s*SPDX-License-Identifier:\s*(.+)"
CONTRACT = r"\b(?:contract|library|abstract\s+contract|interface)\s+([\w$]+)"
LIBRARY = r"\blibrary\s+([\w$]+)"
VYPER_VERSION = r"#(?:pragma version|@version)\s+(.+)"
IMPORT = r"import\s+(?:(?:\"(.*)\"|'(.*)')(?:\s+as\s+\w+)?|(?:(?:\w+(?:\s+as\s+\w+)?|\*\s+as\s+\w+|\{\s*(?:\w+(?:\s+as\s+\w+)?(?:\s*,\s*)?)+\s*\})\s+from\s+(?:\"(.*)\"|'(.*)')))\s*;"
ALIAS = r"(?:(\w+)|\*|'|\")\s+as\s+(\w+)"
VYPER_IMPORT = r"^\s*(?:from\s+(\.*)([\w.]*)\s+)?import\s+(\.*)([\w.]+)(?:\s+as\s+\w+)?\s*(?:#.*)?$"
PUBLIC_FUNCTION = r"\bfunction\b[^;{]*\b(?:public|external)\b"


def _or_null(found: Column) -> Column:
    return F.when(found != "", found)


def captures(content: Column, pattern: str, group: int = 1) -> Column:
    """array<struct<whole, inner, start, end>> of all matches: the match, one group of it, and its place in characters."""
    both = F.arrays_zip(F.regexp_extract_all(content, F.lit(pattern), F.lit(0)).alias("whole"), F.regexp_extract_all(content, F.lit(pattern), F.lit(group)).alias("inner"))
    kind = "struct<at: int, found: array<struct<whole: string, inner: string, start: int, end: int>>>"
    start = F.struct(F.lit(1).alias("at"), F.array().alias("found")).cast(kind)

    def step(state: Column, m: Column) -> Column:
        at = F.position(m["whole"], content, state["at"])
        one = F.struct(m["whole"].alias("whole"), m["inner"].alias("inner"), (at - 1).alias("start"), (at - 1 + F.length(m["whole"])).alias("end"))
        return F.struct((at + F.length(m["whole"])).alias("at"), F.concat(state["found"], F.array(one)).alias("found")).cast(kind)

    return F.aggregate(both, start, step)["found"]


#: Text in tokens: strings, comments, and code between them.
_TOKENS = r""" "(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|//[^\n]*+|/\*[\s\S]*?\*/|[^"'/]++|["'/] """.strip()


def renamed(content: Column, names: Column) -> Column:
    """content in which names, array<struct<alias, target>>, are written as their targets: whole names outside strings and
    comments, but where they are declared or follow a point."""
    declared = r"(?<!\b(?:function|error|as|contract|library|interface|struct|enum|event|modifier)\s{1,9})(?<![\w$.])"

    def token(text: Column) -> Column:
        put = lambda t, n: F.regexp_replace(t, F.concat(F.lit(declared + r"\Q"), n["alias"], F.lit(r"\E(?![\w$])")), F.replace(n["target"], F.lit("$"), F.lit(r"\$")))
        plain = F.regexp_like(text, F.lit(r"""^["']|^//|^/\*"""))
        return F.when(plain, text).otherwise(F.aggregate(names, text, put))

    tokens = F.regexp_extract_all(content, F.lit(_TOKENS), F.lit(0))
    return F.when(F.size(names) > 0, F.array_join(F.transform(tokens, token), "")).otherwise(content)


def normal_newlines(content: Column) -> Column:
    """CRLF becomes LF; lone CRs stay."""
    return F.replace(content, F.lit("\r\n"), F.lit("\n"))


def version_text(content: Column) -> Column:
    """The first pragma's requirement as written; null without one."""
    return _or_null(F.regexp_extract(content, PRAGMA, 1))


def version_requirement(content: Column) -> Column:
    return parse_requirement(version_text(content))


def license_of(content: Column) -> Column:
    """The SPDX identifier of the first line."""
    return _or_null(F.regexp_extract(F.split_part(content, F.lit("\n"), F.lit(1)), LICENSE, 1))


def contract_names(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(CONTRACT), F.lit(1))


def import_statements(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(IMPORT), F.lit(0))


def import_paths(content: Column) -> Column:
    """Paths of all import statements, in order."""
    groups = [F.regexp_extract_all(content, F.lit(IMPORT), F.lit(i)) for i in (1, 2, 3, 4)]
    return F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]), lambda g: F.coalesce(*[_or_null(g[f"g{i}"]) for i in range(4)]))


def imports(content: Column) -> Column:
    """array<struct<path, aliases array<struct<target, alias>>>>; a null target aliases the whole file."""
    both = F.arrays_zip(import_paths(content).alias("path"), import_statements(content).alias("text"))

    def aliases(text: Column) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(ALIAS), F.lit(1)).alias("target"), F.regexp_extract_all(text, F.lit(ALIAS), F.lit(2)).alias("alias"))
        return F.transform(pairs, lambda p: F.struct(_or_null(p["target"]).alias("target"), p["alias"].alias("alias")))

    return F.transform(both, lambda b: F.struct(b["path"].alias("path"), aliases(b["text"]).alias("aliases")))


def libraries(content: Column) -> Column:
    """array<struct<name, is_inlined>>: a library is inlined unless a function of it is public or external.

    Bodies end where the next contract begins.
    """
    bodies = F.slice(F.split(content, r"(?=\b(?:abstract\s+contract|contract|library|interface)\s+[\w$]+)"), 1, 1_000_000)
    own = F.filter(bodies, lambda b: F.regexp_like(b, F.lit("^" + LIBRARY)))
    return F.transform(own, lambda b: F.struct(F.regexp_extract(b, LIBRARY, 1).alias("name"), (~F.regexp_like(b, F.lit(PUBLIC_FUNCTION))).alias("is_inlined")))


def references_name(content: Column, name: Column) -> Column:
    """Whether the text uses a contract or library of that name (using, inheritance, call or member)."""
    q = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    return F.regexp_like(content, F.concat(F.lit(r"(?:using\s+"), q, F.lit(r"\s+|\bis\s+(?:\w+\s*,\s*)*"), q, F.lit(r"\b|\W"), q, F.lit(r"(?:\.|\(| ))")))


def vyper_version(content: Column) -> Column:
    """The version requirement as written (the inner group, so that it can be parsed)."""
    return _or_null(F.regexp_extract(content, VYPER_VERSION, 1))


def vyper_imports(content: Column) -> Column:
    """array<struct<level, path>> of lines that are imports: leading dots, and names joined by dots."""
    lines = F.filter(F.split(content, "\n"), lambda x: F.regexp_like(x, F.lit(VYPER_IMPORT)))

    def one(line: Column) -> Column:
        g = lambda i: F.regexp_extract(line, VYPER_IMPORT, i)
        return F.struct(F.length(F.concat(g(1), g(3))).alias("level"), F.concat_ws(".", _or_null(g(2)), g(4)).alias("path"))

    return F.transform(lines, one)


def compiler_version(output: Column) -> Column:
    """The version in the last line that isn't blank, with .g++ written as .gcc."""
    lines = F.filter(F.split(output, "\n"), lambda x: F.trim(x) != "")
    last = F.trim(F.try_element_at(lines, F.lit(-1)))
    return F.replace(F.regexp_replace(last, r"^Version:\s*", ""), F.lit(".g++"), F.lit(".gcc"))


def interface_text(content: Column) -> Column:
    """White space as the interface representation has it: no newlines, no runs of spaces."""
    return F.regexp_replace(F.replace(content, F.lit("\n"), F.lit("")), " {2,}", " ")


def is_yul(path: Column) -> Column:
    return F.endswith(path, F.lit(".yul"))
