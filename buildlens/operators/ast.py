"""Syntax trees as node tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "path string, place long, id long, parent_id long, depth int, node_type string, name string, start long, length long, source long, referenced long, contract_id long, attributes string"
#: Node types that are definitions at the top level and within contracts (fixed values).
TOP_LEVEL = ("ContractDefinition", "StructDefinition", "EnumDefinition", "FunctionDefinition", "VariableDeclaration", "ErrorDefinition", "EventDefinition", "UserDefinedValueTypeDefinition")
CONTRACT_LEVEL = ("EnumDefinition", "ErrorDefinition", "EventDefinition", "StructDefinition", "FunctionDefinition", "VariableDeclaration", "UserDefinedValueTypeDefinition")

#: Attributes that aren't plain values and yet are kept: exports, words of pragmas, aliases of imports (fixed values).
KEPT_LISTS = ("exportedSymbols", "literals", "symbolAliases")


def _location(src: str | None) -> tuple[int | None, int | None, int | None]:
    parts = [int(x) if x.lstrip("-").isdigit() and int(x) >= 0 else None for x in (src or "").split(":")]
    return tuple((parts + [None] * 3)[:3])


def _nodes(tree: dict) -> Iterator[tuple]:
    """Nodes before their children, in the order in which they are written; without recursion."""
    stack, place = [(tree, None, 0, None)], 0
    while stack:
        value, parent, depth, contract = stack.pop()
        if isinstance(value, dict):
            inner, below = parent, depth
            if "nodeType" in value:
                plain = {k: v for k, v in value.items() if k in KEPT_LISTS or not isinstance(v, (dict, list))}
                yield (place, value.get("id"), parent, depth, value["nodeType"], value.get("name"), *_location(value.get("src")), value.get("referencedDeclaration"), contract, json.dumps(plain))
                place += 1
                inner, below = value.get("id"), depth + 1
                contract = value.get("id") if value["nodeType"] == "ContractDefinition" else contract
            stack += [(v, inner, below, contract) for v in reversed(list(value.values())) if isinstance(v, (dict, list))]
        else:
            stack += [(v, parent, depth, contract) for v in reversed(value) if isinstance(v, (dict, list))]


def walk(trees: DataFrame, path_col: str = "path", ast_col: str = "ast") -> DataFrame:
    """One row per node of JSON trees: NODE_SCHEMA, with `place` the node's place in a walk from the top.

    attributes has the plain attributes and KEPT_LISTS as JSON, for `attribute`. Null and unreadable trees have no nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
        types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
        kinds = [types[f.split()[1]] for f in NODE_SCHEMA.split(", ")]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    tree = json.loads(text) if text else None
                except ValueError:
                    tree = None
                if isinstance(tree, dict):
                    rows += [(path, *n) for n in _nodes(tree)]
                if len(rows) >= 8192:
                    yield batch()
        if rows:
            yield batch()

    return trees.select(F.col(path_col).alias("path"), F.col(ast_col).cast("string").alias("ast")).mapInArrow(run, NODE_SCHEMA)


def attribute(attributes: Column, name: str, kind: str) -> Column:
    """An attribute of any node, of a type; null if it isn't there or is of another."""
    return F.try_variant_get(F.try_parse_json(attributes), f"$.{name}", kind)


def top_level_definitions(nodes: DataFrame) -> DataFrame:
    """(name, definitions array<struct<path, start, id>>)."""
    rows = nodes.where((F.col("depth") == 1) & F.col("node_type").isin(*TOP_LEVEL) & (F.col("name") != ""))
    return rows.groupBy("name").agg(F.array_sort(F.collect_set(F.struct("path", "start", "id"))).alias("definitions"))


def contract_level_definitions(nodes: DataFrame) -> DataFrame:
    """(id, name, contract_id) of definitions within contracts."""
    return nodes.where(F.col("contract_id").isNotNull() & (F.col("parent_id") == F.col("contract_id")) & F.col("node_type").isin(*CONTRACT_LEVEL)).select("id", "name", "contract_id")


def references(nodes: DataFrame) -> DataFrame:
    """(declaration, places array<struct<path, start, length>>) of all nodes that refer to a declaration."""
    rows = nodes.where("referenced is not null")
    return rows.groupBy(F.col("referenced").alias("declaration")).agg(F.array_sort(F.collect_set(F.struct("path", "start", "length"))).alias("places"))


def _pragmas(nodes: DataFrame) -> DataFrame:
    """(path, version_text, experimental): of several pragmas of a kind the last one counts."""
    words = F.coalesce(attribute(F.col("attributes"), "literals", "array<string>"), F.array().cast("array<string>"))
    rows = nodes.where("node_type = 'PragmaDirective'").select("path", "place", F.get(words, F.lit(0)).alias("kind"), F.array_join(F.slice(words, 2, 1_000_000), "").alias("rest"))
    spaced = F.regexp_replace("rest", r"(?<=[\dxX*])(?=[\^~<>=])", " ")  # the words of a pragma have no space between them
    last = lambda kind, value: F.max_by(F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, F.col("place")))
    return rows.groupBy("path").agg(last("solidity", spaced).alias("version_text"), last("experimental", F.col("rest")).alias("experimental"))


def parsed_from_ast(nodes: DataFrame) -> DataFrame:
    """(path, imports, contract_names, libraries, version_text, experimental, aliases) as extraction from text gives them,
    from syntax trees. aliases has an array<struct<target, alias>> for each import; a null target aliases the whole file.

    A library is inlined unless one of its functions is public or external.
    """
    of = lambda name, kind: attribute(F.col("attributes"), name, kind)
    named = F.transform(of("symbolAliases", "array<struct<foreign: struct<name: string>, local: string>>"), lambda a: F.when(a["local"].isNull(), F.struct(F.lit(None).cast("string").alias("target"), a["foreign"]["name"].alias("alias"))).otherwise(F.struct(a["foreign"]["name"].alias("target"), a["local"].alias("alias"))))
    whole = F.when(of("unitAlias", "string") != "", F.array(F.struct(F.lit(None).cast("string").alias("target"), of("unitAlias", "string").alias("alias"))))
    aliases = F.coalesce(whole, named, F.array().cast("array<struct<target: string, alias: string>>"))
    imports = nodes.where("node_type = 'ImportDirective'").select("path", F.struct("place", of("file", "string").alias("file"), aliases.alias("aliases")).alias("i"))
    imports = imports.groupBy("path").agg(F.array_sort(F.collect_list("i")).alias("i"))
    contracts = nodes.where("node_type = 'ContractDefinition'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("c"))
    open_ = nodes.where("node_type = 'FunctionDefinition'").where(attribute(F.col("attributes"), "visibility", "string").isin("public", "external")).select("path", F.col("contract_id").alias("id"), F.lit(True).alias("open")).distinct()
    libs = nodes.where("node_type = 'ContractDefinition'").where(attribute(F.col("attributes"), "contractKind", "string") == "library").select("path", "place", "id", "name").join(open_, ["path", "id"], "left")
    libs = libs.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "name", F.col("open").isNull().alias("is_inlined")))).alias("l"))
    out = nodes.select("path").distinct().join(_pragmas(nodes), "path", "left").join(imports, "path", "left").join(contracts, "path", "left").join(libs, "path", "left")
    return out.select("path", F.transform("i", lambda x: x["file"]).alias("imports"), F.transform("c", lambda x: x["name"]).alias("contract_names"), F.transform("l", lambda x: F.struct(x["name"].alias("name"), x["is_inlined"].alias("is_inlined"))).alias("libraries"), "version_text", "experimental", F.transform("i", lambda x: x["aliases"]).alias("aliases"))
