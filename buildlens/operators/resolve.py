"""Import resolution: prefix joins against remappings and libraries, and lookups in the file listing.

Remappings and libraries are ordered configuration; ties are settled by their ordinal. The prefix join is an equi-join
on the leading components of the import path (exploded, a few for each import), so it needs no nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from buildlens.functions.paths import ancestors, clean_path, is_under, join_path, parent, strip_prefix


def _leading(path: Column) -> Column:
    """Every prefix of path by components, itself included, without a trailing slash; and the empty one."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def _first(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row of each group, the first in order, without a sort of whole groups."""
    best = [c for c in df.columns if c not in by]
    key = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    return df.groupBy(*by).agg(F.min_by(F.struct(*best), key).alias("_b")).select(*by, "_b.*")


def remapped(imports: DataFrame, remappings: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, path): where the first fitting remapping leads each import; imports: id, cwd, import (relative to the root).

    remappings: ordinal, context, name, path. A remapping fits when its context is null or above cwd and its name is a
    prefix of the import by components. A whole-file remapping to a .sol path gives that path. Where a path ends in
    contracts/, the rest begins with contracts/ and the joined path isn't there, the second contracts/ goes.
    """
    rules = remappings.select("ordinal", "context", F.col("path").alias("to"), F.rtrim("name", F.lit("/")).alias("prefix"))
    fits = imports.select("id", "cwd", "import", F.explode(_leading(F.rtrim("import", F.lit("/")))).alias("prefix")).join(rules, "prefix")
    fits = fits.where(F.col("context").isNull() | is_under(F.col("cwd"), F.coalesce("context", F.lit(""))))
    best = _first(fits.select("id", "ordinal", "import", "prefix", "to"), ["id"], ["ordinal"])
    rest = F.when(F.col("prefix") == "", F.col("import")).otherwise(strip_prefix(F.col("import"), F.col("prefix")))
    whole = (F.col("import") == F.col("prefix")) & F.endswith("to", F.lit(".sol"))
    best = best.withColumn("rest", F.when(F.col("import") == F.col("prefix"), F.lit("")).otherwise(rest))
    best = best.withColumn("joined", F.when(whole, F.col("to")).otherwise(join_path(F.col("to"), F.col("rest"))))
    there = listing.select(F.col("path").alias("joined"), F.lit(True).alias("there")).distinct()
    best = best.join(there, "joined", "left")
    twice = F.startswith("rest", F.lit("contracts/")) & F.endswith("to", F.lit("contracts/")) & F.col("there").isNull()
    return best.select("id", F.when(twice, join_path(F.col("to"), F.substr("rest", F.lit(11)))).otherwise(F.col("joined")).alias("path"))


def from_libraries(imports: DataFrame, libraries: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, path): the first existing of library/import and library/<first>/src/<rest>, in library order.

    libraries: ordinal, path. Absolute imports are taken as they are.
    """
    parts = F.split("import", "/")
    deep = F.when(F.size(parts) > 1, F.concat_ws("/", F.get(parts, 0), F.lit("src"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), "/")))
    forms = F.array(F.struct(F.lit(0).alias("form"), F.col("import").alias("tail")), F.struct(F.lit(1).alias("form"), deep.alias("tail")))
    roots = libraries.agg(F.sort_array(F.collect_list(F.struct("ordinal", "path"))).alias("roots"))  # configuration: a few rows
    wanted = imports.where(~F.startswith("import", F.lit("/"))).select("id", "import", F.explode(roots.scalar()).alias("root"))
    wanted = wanted.select("id", F.col("root.ordinal").alias("ordinal"), F.col("root.path").alias("root"), F.explode(forms).alias("f")).where("f.tail is not null")
    wanted = wanted.select("id", "ordinal", "f.form", join_path(F.col("root"), F.col("f.tail")).alias("path"))
    found = _first(wanted.join(listing.select("path").distinct(), "path", "left_semi").select("id", "ordinal", "form", "path"), ["id"], ["ordinal", "form"]).select("id", "path")
    return found.unionByName(imports.where(F.startswith("import", F.lit("/"))).select("id", F.col("import").alias("path")))


def relative(imports: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, path) of imports that begin with a dot, cleaned, if the file is there."""
    some = imports.where(F.startswith("import", F.lit("."))).select("id", clean_path(join_path(F.col("cwd"), F.col("import"))).alias("path"))
    return some.join(listing.select("path").distinct(), "path", "left_semi").select("id", "path")


def library_ancestor(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """(id, library): the first library, in order, that a file (id, path) lies under."""
    rows = files.select("id", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("up"))
    hits = rows.join(libraries.select("ordinal", F.rtrim("path", F.lit("/")).alias("up")), "up")
    return _first(hits.select("id", "ordinal", F.col("up").alias("library")), ["id"], ["ordinal"]).select("id", "library")


def within_library(imports: DataFrame, libraries: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, path): in the deepest directory from cwd up to its library's root where the import is there."""
    inside = imports.join(library_ancestor(imports.select("id", F.concat_ws("/", "cwd", F.lit("_")).alias("path")), libraries), "id")
    up = inside.select("id", "import", "library", F.posexplode(F.concat(F.array("cwd"), ancestors(F.col("cwd")))).alias("steps", "up")).where(is_under(F.col("up"), F.col("library")))
    wanted = up.select("id", "steps", join_path(F.col("up"), F.col("import")).alias("path"))
    return _first(wanted.join(listing.select("path").distinct(), "path", "left_semi").select("id", "steps", "path"), ["id"], ["steps"]).select("id", "path")


def redirected(resolved: DataFrame, remappings: DataFrame, listing: DataFrame) -> DataFrame:
    """(id, path): resolved paths (id, cwd, path) redirected by the first remapping whose target is there."""
    rules = remappings.select("ordinal", "context", F.col("path").alias("to"), F.rtrim("name", F.lit("/")).alias("prefix"))
    fits = resolved.select("id", "cwd", "path", F.explode(_leading(F.col("path"))).alias("prefix")).join(rules, "prefix")
    fits = fits.where(F.col("context").isNull() | is_under(F.col("cwd"), F.coalesce("context", F.lit(""))))
    rest = F.when(F.col("prefix") == F.col("path"), F.lit("")).when(F.col("prefix") == "", F.col("path")).otherwise(strip_prefix(F.col("path"), F.col("prefix")))
    goal = fits.select("id", "ordinal", F.when(rest == "", F.col("to")).otherwise(join_path(F.col("to"), rest)).alias("goal"))
    there = goal.join(listing.select(F.col("path").alias("goal")).distinct(), "goal", "left_semi")
    best = _first(there.select("id", "ordinal", "goal"), ["id"], ["ordinal"]).select("id", "goal")
    return resolved.select("id", "path").join(best, "id", "left").select("id", F.coalesce("goal", "path").alias("path"))


def resolve_imports(imports: DataFrame, remappings: DataFrame, libraries: DataFrame, listing: DataFrame, fallback_dirs: list[str] = ()) -> DataFrame:
    """(id, path, how): each import's file; path is null where it can't be resolved.

    In turn: relative (then redirected by remappings), remapping, library, inside the importing file's library, and
    the fallback directories (root, sources, tests, scripts) in order. Resolved paths must be in the listing.
    """
    rel = redirected(relative(imports, listing).join(imports.select("id", "cwd"), "id"), remappings, listing).withColumns({"rank": F.lit(0), "how": F.lit("relative")})
    bare = imports.where(~F.startswith("import", F.lit(".")))
    here = listing.select("path").distinct()
    ways = [rel]
    for rank, (how, found) in enumerate([("remapping", remapped(bare, remappings, listing)), ("library", from_libraries(bare, libraries, listing)), ("nested", within_library(bare, libraries, listing))], 1):
        ways.append(found.join(here, "path", "left_semi").select("id", "path", F.lit(rank).alias("rank"), F.lit(how).alias("how")))
    for i, d in enumerate(fallback_dirs):
        tried = bare.select("id", join_path(F.lit(d), F.col("import")).alias("path"))
        ways.append(tried.join(here, "path", "left_semi").select("id", "path", F.lit(10 + i).alias("rank"), F.lit("fallback").alias("how")))
    every = ways[0].select("id", "path", "rank", "how")
    for w in ways[1:]:
        every = every.unionByName(w)
    return imports.select("id").join(_first(every, ["id"], ["rank"]), "id", "left").select("id", "path", "how")


def resolve_vyper(imports: DataFrame, listing: DataFrame, libraries: DataFrame, extensions: tuple[str, ...] = ("vy", "vyi")) -> DataFrame:
    """(id, path) of imports (id, file, level, path with dots): relative ones from level - 1 directories up, others
    from the file's directory, the root and the libraries in order; the first that exists. Null where none does."""
    tail = F.replace("path", F.lit("."), F.lit("/"))
    dirs = F.concat(ancestors(F.col("file")), F.array(F.lit("")))
    roots = libraries.agg(F.sort_array(F.collect_list(F.struct("ordinal", "path"))).alias("roots"))
    bases = F.when(F.col("level") > 0, F.slice(dirs, F.col("level"), 1)).otherwise(F.concat(F.array(parent(F.col("file")), F.lit("")), F.transform("_roots", lambda r: r["path"])))
    tries = imports.withColumn("_roots", roots.scalar()).select("id", tail.alias("tail"), F.posexplode(bases).alias("i", "base"))
    tries = tries.select("id", "i", F.posexplode(F.array(*[F.concat("tail", F.lit(f".{e}")) for e in extensions])).alias("j", "file"), "base")
    tries = tries.select("id", "i", "j", clean_path(join_path(F.col("base"), F.col("file"))).alias("path")).join(listing.select("path").distinct(), "path", "left_semi")
    return imports.select("id").join(_first(tries.select("id", "i", "j", "path"), ["id"], ["i", "j"]).select("id", "path"), "id", "left")


def import_rows(parsed: DataFrame) -> DataFrame:
    """(file, ordinal, import, aliases) from parsed sources (path, imports)."""
    return parsed.select(F.col("path").alias("file"), F.posexplode("imports").alias("ordinal", "i")).select("file", "ordinal", F.col("i.path").alias("import"), F.col("i.aliases").alias("aliases"))


def first_in_order(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """One row of each group, the first in order."""
    return _first(df, by, order)


def numbered(df: DataFrame, by: list[str], order: list, name: str = "n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
