"""Import graphs as edge tables (src, dst): closures, dirtiness, ordering.

Closures are semi-naive: each round joins only the new pairs with the edges, drops known ones and writes the rest to
the shared folder, once. Import cycles are legal and end by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.functions.paths import file_name
from buildlens.storage import Growing, Written


def closure(edges: DataFrame, roots: DataFrame, include_self: bool = True) -> DataFrame:
    """(root, node, depth): everything reachable from each root (one column, root), with its smallest distance.

    Without include_self a root is in its own closure only on a cycle, at the cycle's length.
    """
    edges = Written(edges.select("src", "dst").distinct(), "edges").df
    start = roots.select("root").distinct()
    if include_self:
        return closure_from(edges, start.select("root", F.col("root").alias("node")))
    first = start.join(edges, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node"))
    return closure_from(edges, first).withColumn("depth", F.col("depth") + 1)


def closure_from(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node, depth): everything reachable from each root's seeds (root, node), with its smallest distance from
    one. A root may be a group of files: the table has a row for each group and node, not for each pair of files."""
    edges = Written(edges.select("src", "dst").distinct(), "edges").df
    seen, more = Growing(seeds.select("root", "node", F.lit(0).alias("depth")).distinct(), "closure"), True
    while more:
        step = seen.last.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        more = seen.add(step.join(seen.df, ["root", "node"], "left_anti"))
    return seen.df


def spread_bounds(edges: DataFrame, own: DataFrame) -> DataFrame:
    """(path, lo, hi): the greatest lo and the least hi of all that each file (path, lo, hi) reaches, itself included; a
    null bounds nothing. Bounds move along the edges until none changes: a row for each file, no pairs."""
    edges = Written(edges.select("src", "dst").distinct(), "edges").df
    known = Written(own.groupBy("path").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")), "bounds")
    changed = known
    while True:
        offers = changed.df.join(edges, F.col("path") == F.col("dst")).groupBy("src").agg(F.max("lo").alias("more"), F.min("hi").alias("less"))
        new = known.df.join(offers, F.col("path") == F.col("src")).select("path", F.greatest("lo", "more").alias("new_lo"), F.least("hi", "less").alias("new_hi"), "lo", "hi")
        better = Written(new.where(~F.col("new_lo").eqNullSafe(F.col("lo")) | ~F.col("new_hi").eqNullSafe(F.col("hi"))).select("path", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi")), "better")
        if not better.df.head(1):
            return known.df
        after = Written(known.df.join(better.df.select("path"), "path", "left_anti").unionByName(better.df), "bounds")
        known.drop()
        if changed is not known:
            changed.drop()
        known, changed = after, better


def transitive_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(root, node) of each file (path): its dependencies, the file itself only on a cycle."""
    return closure(edges, files.select(F.col("path").alias("root")), include_self=False).select("root", "node")


def importers(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, importer): direct importers only."""
    return edges.join(files.select(F.col("path").alias("dst")).distinct(), "dst").select(F.col("dst").alias("path"), F.col("src").alias("importer")).distinct()


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node) of everything reachable from any seed (one column, node), seeds included."""
    edges = Written(edges.select("src", "dst").distinct(), "edges").df
    seen, more = Growing(seeds.select("node").distinct(), "reachable"), True
    while more:
        step = seen.last.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        more = seen.add(step.join(seen.df, "node", "left_anti"))
    return seen.df


def dirty_files(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(path): changed files (path) and everything that imports them, at any distance."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(back, changed.select(F.col("path").alias("node"))).select(F.col("node").alias("path"))


def dirty_by_interface(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(path) of dirty files where tests and scripts see sources by their interface alone.

    sources: path, kind (source, test, script, mock), changed, interface_changed. A changed file is dirty. A file with
    a changed transitive import is dirty if both are sources, or if the import is none (a mock or test), or if the
    import's interface changed.
    """
    kinds = sources.select("path", (F.col("kind") == "source").alias("is_source"), "changed", "interface_changed")
    reach = transitive_imports(edges, sources.select("path")).where("root <> node")
    a = kinds.select(F.col("path").alias("root"), F.col("is_source").alias("root_source"))
    b = kinds.select(F.col("path").alias("node"), F.col("is_source").alias("node_source"), "changed", "interface_changed").where("changed")
    hit = reach.join(b, "node").join(a, "root").where("(root_source and node_source) or not node_source or interface_changed")
    return hit.select(F.col("root").alias("path")).unionByName(kinds.where("changed").select("path")).distinct()


def ordered_dependencies(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, path, place): a target's closure by the size of each file's own closure, file name and path; the
    target comes last. Under cycles this is no topological order."""
    deps = closure(edges, targets.select(F.col("path").alias("root"))).select("root", "node")
    sizes = closure(edges, deps.select(F.col("node").alias("root")).distinct()).groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    rows = deps.join(sizes.withColumnRenamed("root", "node"), "node")
    key = F.struct((F.col("node") == F.col("root")).alias("last"), "size", file_name(F.col("node")).alias("name"), F.col("node").alias("path"))
    return rows.groupBy("root").agg(F.array_sort(F.collect_list(key)).alias("all")).select(F.col("root").alias("target"), F.posexplode("all").alias("place", "x")).select("target", F.col("x.path").alias("path"), "place")


def linking_dependencies(edges: DataFrame, files: DataFrame, libraries: DataFrame) -> DataFrame:
    """(path, dependency): direct imports that contain any library (libraries: path)."""
    return edges.join(files.select(F.col("path").alias("src")).distinct(), "src").join(libraries.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("path"), F.col("dst").alias("dependency")).distinct()


def sources_by_version(edges: DataFrame, inputs: DataFrame) -> DataFrame:
    """(language, version, profile, path, is_input) of inputs (path, language, version, profile) and what they import.

    A file is in a group once, as input if it is one there.
    """
    key = ["language", "version", "profile"]
    reach = closure_from(edges, inputs.select(F.struct(*key).alias("root"), F.col("path").alias("node"))).select("root.*", F.col("node").alias("path"))
    own = inputs.select(*key, "path", F.lit(True).alias("is_input")).distinct()
    return reach.join(own, [*key, "path"], "left").withColumn("is_input", F.coalesce("is_input", F.lit(False)))


def unresolved(resolved: DataFrame) -> DataFrame:
    """(import, file) of import rows (file, import, path) without a path; they don't stop anything."""
    return resolved.where("path is null").select("import", "file").distinct()


def render(edges: list[tuple[str, str]], root: str, ascii_only: bool = False) -> str:
    """A dependency tree as text; what was printed before, or is being printed, is marked (*)."""
    tee, last, bar = ("|-- ", "`-- ", "|   ") if ascii_only else ("├── ", "└── ", "│   ")
    children: dict[str, list[str]] = {}
    for a, b in edges:
        children.setdefault(a, []).append(b)
    lines, seen, stack = [], set(), [(root, "", "")]
    while stack:
        node, lead, mark = stack.pop()
        again = node in seen and children.get(node)
        lines.append(lead + mark + node + (" (*)" if again else ""))
        if node in seen:
            continue
        seen.add(node)
        below = lead + ("" if not mark else bar if mark == tee else "    ")
        kids = children.get(node, [])
        stack += [(k, below, last if i == len(kids) - 1 else tee) for i, k in reversed(list(enumerate(kids)))]
    return "\n".join(lines)


def standard_input(edges: DataFrame, targets: DataFrame, sources: DataFrame, root: str) -> DataFrame:
    """(target, path, content): a target and its imports, each once, with paths relative to root. Remappings, which lead
    to folders below root as well, are made relative by relative_remappings."""
    from buildlens.functions.paths import rebase_path

    reach = closure(edges, targets.select(F.col("path").alias("root"))).select(F.col("root").alias("target"), F.col("node").alias("path"))
    return reach.join(sources.select("path", "content"), "path").select("target", rebase_path(F.lit(root), F.col("path")).alias("path"), "content")


def relative_remappings(remappings: DataFrame, root: str) -> DataFrame:
    """remappings (ordinal, context, name, path) with contexts and paths relative to root where they are below it."""
    from buildlens.functions.paths import strip_prefix

    at = lambda c: strip_prefix(F.col(c), F.lit(root))
    return remappings.withColumns({"context": at("context"), "path": at("path")})


def finalize_imports(imports: DataFrame, by_language: dict) -> DataFrame:
    """imports (language, ...) after each language's own last step (a function from its rows to rows); other languages'
    rows stay as they are, and all of them in one table again."""
    out = imports.where(~F.coalesce(F.col("language").isin(*by_language), F.lit(False)))
    for language, step in by_language.items():
        out = out.unionByName(step(imports.where(F.col("language") == language)))
    return out


def format_imports(root: str, dependencies: list[tuple[str, str | None]], incompatible: set[str] = frozenset()) -> str:
    """A file and what it imports (path, requirement) as lines, incompatible ones marked with !."""
    line = lambda path, need: ("! " if path in incompatible else "") + path + (f" {need}" if need else "")
    own = dict(dependencies).get(root)
    return "\n    ".join([line(root, own) + " imports:", *(line(p, r) for p, r in dependencies if p != root)])
