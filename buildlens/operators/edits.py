"""Edits of sources by byte ranges, and flattening of a file with all its imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from buildlens.functions import solidity
from buildlens.operators.graph import ordered_dependencies
from buildlens.operators.resolve import first_in_order
from buildlens.storage import Written


def apply_edits(sources: DataFrame, edits: DataFrame) -> DataFrame:
    """sources (path, content) with their edits (path, start, end, text) applied.

    Ranges are bytes of the content as it is, and don't overlap; edits at one place apply in the order of their text.
    Sources without edits stay.
    """
    sorted_edits = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("edits"))
    data = F.encode("content", "UTF-8")
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(b"").alias("out"))

    def step(state, e):
        between = F.substring(F.col("data"), state["pos"].cast("int") + 1, F.greatest(e["start"] - state["pos"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(state["pos"], e["end"]).cast("long").alias("pos"), F.concat(state["out"], between, F.encode(e["text"], "UTF-8")).alias("out"))

    done = F.aggregate("edits", start, step)
    rows = sources.join(sorted_edits, "path", "left").withColumn("data", data).withColumn("done", F.when(F.col("edits").isNotNull(), done))
    tail = F.substring(F.col("data"), F.col("done.pos").cast("int") + 1, F.octet_length("data"))
    return rows.withColumn("content", F.when(F.col("edits").isNotNull(), F.decode(F.concat("done.out", tail), "UTF-8")).otherwise(F.col("content"))).drop("edits", "data", "done")


def removals(nodes: DataFrame, node_type: str) -> DataFrame:
    """Edits that take out all nodes of a type."""
    return nodes.where(F.col("node_type") == node_type).select("path", "start", (F.col("start") + F.col("length")).alias("end"), F.lit("").alias("text"))


def file_headers(sources: DataFrame) -> DataFrame:
    """Edits that put each file's path in front of it."""
    zero = F.lit(0).cast("long")
    return sources.select("path", zero.alias("start"), zero.alias("end"), F.concat(F.lit("// "), "path", F.lit("\n")).alias("text"))


def renamed_definitions(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """(id, name, new_name) of top-level definitions: of several with one name each gets _0, _1, ... in the order of
    its file (places: path, place) and its place there; others keep theirs."""
    from buildlens.operators.ast import TOP_LEVEL

    rows = nodes.where((F.col("depth") == 1) & F.col("node_type").isin(*TOP_LEVEL) & (F.col("name") != "")).join(places.select("path", F.col("place").alias("file_place")), "path")
    by = Window.partitionBy("name")
    n, i = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy("file_place", "start")) - 1
    return rows.select("id", "name", F.when(n > 1, F.concat("name", F.lit("_"), i.cast("string"))).otherwise(F.col("name")).alias("new_name"), "path", "start")


def reference_places(nodes: DataFrame) -> DataFrame:
    """(path, referenced, start, end) of references by name; of a member access, its last name alone."""
    from buildlens.operators.ast import attribute

    rows = nodes.where(F.col("referenced").isNotNull() & F.col("node_type").isin("Identifier", "IdentifierPath", "UserDefinedTypeName", "MemberAccess"))
    end = F.col("start") + F.col("length")
    member = F.octet_length(attribute(F.col("attributes"), "memberName", "string"))
    return rows.select("path", "referenced", F.when(F.col("node_type") == "MemberAccess", end - member).otherwise(F.col("start")).alias("start"), end.alias("end")).where("start is not null")


def member_edits(nodes: DataFrame, renamed: DataFrame) -> DataFrame:
    """Edits of references to what contracts define, as Parent.Child by the parent's new name.

    References by the bare name are within the contract or its heirs, and stay.
    """
    from buildlens.operators.ast import contract_level_definitions

    children = contract_level_definitions(nodes).join(renamed.select(F.col("id").alias("contract_id"), "new_name"), "contract_id")
    children = children.select(F.col("id").alias("referenced"), "name", F.concat_ws(".", "new_name", "name").alias("text"))
    rows = reference_places(nodes).join(children, "referenced").where(F.col("end") - F.col("start") != F.octet_length("name"))
    return rows.select("path", "start", "end", "text").distinct()


def qualifier_removals(nodes: DataFrame) -> DataFrame:
    """Edits that take out names of imported files, with the point that follows."""
    imports = nodes.where("node_type = 'ImportDirective'").select(F.col("id").alias("referenced")).distinct()
    return reference_places(nodes).join(imports, "referenced", "left_semi").select("path", "start", (F.col("end") + 1).alias("end"), F.lit("").alias("text")).distinct()


def inheritdoc_edits(nodes: DataFrame, renamed: DataFrame, sources: DataFrame) -> DataFrame:
    """Edits of the first @inheritdoc of each comment on a contract's members: the new name of what the file exports
    by that name, or no tag where that is no known definition."""
    owners = nodes.where((F.col("parent_id") == F.col("contract_id")) & F.col("node_type").isin("EventDefinition", "ErrorDefinition", "FunctionDefinition", "VariableDeclaration"))
    docs = nodes.where("node_type = 'StructuredDocumentation'").select("path", F.col("parent_id").alias("id"), "start", "length").join(owners.select("path", "id"), ["path", "id"])
    docs = docs.join(sources.select("path", "content"), "path")
    doc = F.decode(F.substring(F.encode("content", "UTF-8"), F.col("start").cast("int") + 1, F.col("length").cast("int")), "UTF-8")
    tag = r"(?s)^(.*?)(@inheritdoc *)(?=[^ ])([^ \n*/]*)"
    parts = [F.regexp_extract(doc, tag, i) for i in (1, 2, 3)]
    found = docs.where(F.regexp_like(doc, F.lit(tag))).select("path", (F.col("start") + F.octet_length(parts[0])).alias("tag_start"), F.octet_length(parts[1]).alias("size"), parts[2].alias("name"))
    exported = nodes.where("node_type = 'SourceUnit'").select("path", F.explode(F.from_json(F.get_json_object("attributes", "$.exportedSymbols"), "map<string, array<long>>")).alias("name", "ids"))
    names = exported.select("path", "name", F.get("ids", 0).alias("id")).join(renamed.select("id", "new_name"), "id").select("path", "name", "new_name")
    rows = found.join(names, ["path", "name"], "left").withColumn("at", F.col("tag_start") + F.col("size"))
    start = F.when(F.col("new_name").isNotNull(), F.col("at")).otherwise(F.col("tag_start"))
    return rows.select("path", start.alias("start"), (F.col("at") + F.octet_length("name")).alias("end"), F.coalesce("new_name", F.lit("")).alias("text")).distinct()


def rename_edits(nodes: DataFrame, renamed: DataFrame, sources: DataFrame) -> DataFrame:
    """Edits of all references to renamed definitions, and of the names where they are defined.

    A reference is given its definition's name even if that wasn't renamed: so aliases of imports resolve.
    """
    refs = reference_places(nodes).join(renamed.select(F.col("id").alias("referenced"), "new_name"), "referenced").select("path", "start", "end", F.col("new_name").alias("text")).distinct()
    own = renamed.where("name <> new_name").join(sources.select("path", "content"), "path")
    after = F.substring(F.encode("content", "UTF-8"), F.col("start").cast("int") + 1, F.octet_length(F.encode("content", "UTF-8")))
    at = F.col("start") + F.octet_length(F.regexp_extract(F.decode(after, "UTF-8"), r"^((?:\w+\s+)+?)(?=[\w$]+\s*[\s{(;=])", 1))
    own = own.select("path", at.alias("start"), (at + F.octet_length("name")).alias("end"), F.col("new_name").alias("text"))
    return refs.unionByName(own)


def flattened_text(rows: DataFrame) -> DataFrame:
    """(target, content) of rows (target, place, license, pragma, body, perhaps abicoder): the target's licence, the
    combined pragma, that of abicoder and the bodies in order, with three or more newlines as two."""
    abicoder = F.first("abicoder") if "abicoder" in rows.columns else F.lit(None).cast("string")
    listed = F.array_sort(F.collect_list(F.struct("place", "body")))
    out = rows.groupBy("target").agg(F.max_by("license", "place").alias("license"), F.first("pragma").alias("pragma"), abicoder.alias("abicoder"), F.array_join(F.transform(listed, lambda x: x["body"]), "\n").alias("bodies"))
    head = F.concat_ws("\n", F.concat(F.lit("// SPDX-License-Identifier: "), "license"), F.concat(F.lit("pragma solidity "), "pragma", F.lit(";")), "abicoder")
    text = F.regexp_replace(F.concat_ws("\n", F.nullif(head, F.lit("")), "bodies"), "\n{3,}", "\n\n")
    return out.select("target", F.concat(F.regexp_replace(text, "^\n+|\n+$", ""), F.lit("\n")).alias("content"))


def flatten(sources: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, content): each target (path) with everything it imports in one text, by patterns alone.

    Files come in dependency order, the target last, each below its path. Licences of first lines, first version
    pragmas, the first experimental or abicoder pragma of each file and import statements go; in front are the target's
    licence, the combined version pragma and the first experimental or abicoder pragma in order. Aliases of imported
    names are written as the names, outside strings, comments and declarations.
    """
    order = ordered_dependencies(edges, targets)
    c = F.col("content")
    version, special = r"pragma\s+solidity\s+.+?;", r"pragma\s+(?:experimental|abicoder)\s+.+?;"
    first_line = F.regexp_extract(c, r"^([^\n]*)", 1)
    bare = F.concat(F.regexp_replace(first_line, solidity.LICENSE, ""), F.substr(c, F.length(first_line) + 1))
    for pattern in (version, special):
        bare = F.regexp_replace(bare, r"(?s)^(.*?)" + pattern.replace(".+?", "[^\\n]+?"), "$1")
    aliases = F.filter(F.flatten(F.transform(solidity.imports(c), lambda i: i["aliases"])), lambda a: a["target"].isNotNull())
    body = solidity.renamed(F.regexp_replace(bare, solidity.IMPORT, ""), aliases)
    # once for each file, however many targets have it
    facts = sources.select("path", F.concat(F.lit("// "), "path", F.lit("\n"), body).alias("body"), solidity.license_of(c).alias("license"), F.nullif(F.regexp_extract(c, special, 0), F.lit("")).alias("special"), F.split(solidity.version_text(c), r"[ ,]+").alias("parts"))
    rows = order.join(Written(facts, "flat").df, "path")
    parts = rows.select("target", F.explode("parts").alias("p")).where("p <> ''").groupBy("target").agg(F.concat_ws(" ", F.array_sort(F.collect_set("p"))).alias("pragma"))
    first = rows.where("special is not null").groupBy("target").agg(F.min_by("special", "place").alias("abicoder"))
    return flattened_text(rows.select("target", "place", "license", "body").join(parts, "target", "left").join(first, "target", "left"))


def flatten_with_trees(sources: DataFrame, nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """(target, content) like flatten, by syntax trees: definitions of one name are told apart, references follow.

    Names of imported files go, members are named by their contract, and the first abicoder pragma is kept."""
    spark = sources.sparkSession
    order = ordered_dependencies(edges, spark.createDataFrame([(target,)], "path string"))
    own = nodes.join(order.select("path"), "path", "left_semi")
    renamed = renamed_definitions(own, order)
    edits = removals(own, "ImportDirective").unionByName(removals(own, "PragmaDirective")).unionByName(rename_edits(own, renamed, sources))
    edits = edits.unionByName(member_edits(own, renamed)).unionByName(qualifier_removals(own)).unionByName(inheritdoc_edits(own, renamed, sources))
    edited = apply_edits(sources.join(order.select("path"), "path", "left_semi"), edits)
    license_line = r"(?m)^[^\n]*///?\s*SPDX-License-Identifier:[^\n]*\n?"
    rows = order.join(edited.select("path", F.concat(F.lit("// "), "path", F.lit("\n"), F.regexp_replace("content", license_line, "")).alias("body")), "path")
    facts = sources.select("path", F.nullif(F.regexp_extract("content", solidity.LICENSE, 1), F.lit("")).alias("license"), solidity.version_text(F.col("content")).alias("version"))
    rows = rows.join(facts, "path")
    pragma = rows.select(F.explode(F.split("version", r"[ ,]+")).alias("p")).where("p <> ''").agg(F.nullif(F.concat_ws(" ", F.array_sort(F.collect_set("p"))), F.lit("")).alias("pragma"))
    rows = rows.join(process_pragmas(own.withColumn("target", F.lit(target)), sources, ["target"]), "target", "left")
    return flattened_text(rows.select("target", "place", "license", "body", "abicoder").withColumn("pragma", pragma.scalar()))


def process_pragmas(nodes: DataFrame, sources: DataFrame, by: list[str]) -> DataFrame:
    """(by, abicoder) the first abicoder or experimental pragma as written (by path and place: a fixed choice)."""
    text = F.decode(F.substring(F.encode("content", "UTF-8"), F.col("start").cast("int") + 1, F.col("length").cast("int")), "UTF-8")
    rows = nodes.where("node_type = 'PragmaDirective'").join(sources.select("path", "content"), "path").select(*by, "path", "place", text.alias("abicoder"))
    return first_in_order(rows.where(F.col("abicoder").rlike("experimental|abicoder")), by, ["path", "place"]).select(*by, "abicoder")


def interface_edits(nodes: DataFrame) -> DataFrame:
    """Edits that leave what other files can see: internal and private functions go, public and external ones lose
    their bodies. Libraries and interfaces stay whole."""
    from buildlens.operators.ast import attribute

    kind = nodes.where("node_type = 'ContractDefinition'").select("path", F.col("id").alias("contract_id"), attribute(F.col("attributes"), "contractKind", "string").alias("kind"))
    functions = nodes.where("node_type = 'FunctionDefinition'").join(kind, ["path", "contract_id"]).where(F.coalesce(F.col("kind") == "contract", F.lit(True)))
    functions = functions.withColumn("exposed", F.coalesce(attribute(F.col("attributes"), "visibility", "string").isin("public", "external"), F.lit(False)))
    gone = functions.where(~F.col("exposed")).select("path", "start", (F.col("start") + F.col("length")).alias("end"), F.lit("").alias("text"))
    bodies = nodes.where("node_type = 'Block'").select("path", F.col("parent_id").alias("id"), F.col("start").alias("from"), F.col("length").alias("size"))
    cut = functions.where("exposed").select("path", "id").join(bodies, ["path", "id"]).select("path", F.col("from").alias("start"), (F.col("from") + F.col("size")).alias("end"), F.lit(";").alias("text"))
    return gone.unionByName(cut)


def interface_hashes(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, interface_hash): of the interface representation, or of the content where there is no syntax tree."""
    seen = apply_edits(sources.select("path", "content"), interface_edits(nodes)).select("path", F.md5(solidity.interface_text(F.col("content"))).alias("interface"))
    parsed = nodes.select("path").distinct().withColumn("parsed", F.lit(True))
    rows = sources.select("path", F.md5("content").alias("whole")).join(seen, "path").join(parsed, "path", "left")
    return rows.select("path", F.when(F.col("parsed"), F.col("interface")).otherwise(F.col("whole")).alias("interface_hash"))
