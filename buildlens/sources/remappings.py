"""Discovery of library remappings from a listing of files.

Each directory of a library folder is a candidate name; the remapping leads to where its sources are. The search works
on the listing as a table: a library's directories are judged together, and nothing is walked on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.operators.resolve import first_in_order

#: Directories that hold sources, in order of preference, and those that never count (fixed values).
SOURCE_DIRS, SKIPPED = ("src", "contracts"), ("test", "tests", "demo")
#: Directories that hold further libraries (fixed values).
WINDOWS = ("lib", "node_modules")


def candidates(listing: DataFrame, root: str) -> DataFrame:
    """(name, path, depth, is_src) of every directory below root that may be a library's source directory.

    A candidate is a directory that holds a source file, outside hidden and test directories. Its name is the directory
    below the nearest lib or node_modules (or below root).
    """
    rest = F.regexp_replace("path", "^" + root.rstrip("/") + "/", "")
    rows = listing.where(F.startswith("path", F.lit(root.rstrip("/") + "/")) & F.regexp_like("path", F.lit(r"\.sol$")))
    dirs = F.slice(F.split(rest, "/"), 1, F.size(F.split(rest, "/")) - 1)
    rows = rows.select(dirs.alias("dirs")).where(F.size("dirs") > 0).where(~F.exists("dirs", lambda d: F.startswith(d, F.lit(".")) | d.isin(*SKIPPED))).distinct()
    at = F.array_max(F.filter(F.sequence(F.lit(0), F.size("dirs") - 1), lambda i: F.get(F.col("dirs"), i).isin(*WINDOWS)))
    rows = rows.withColumn("window", F.coalesce(at + 1, F.lit(0))).where(F.col("window") < F.size("dirs"))
    source_at = F.array_min(F.filter(F.sequence(F.col("window") + 1, F.greatest(F.size("dirs") - 1, F.col("window") + 1)), lambda i: F.get(F.col("dirs"), i).isin(*SOURCE_DIRS)))
    depth = F.coalesce(source_at + 1, F.col("window") + 1)
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.array_join(F.slice("dirs", 1, depth), "/"), F.lit("/"))
    return rows.select(F.concat(F.get("dirs", F.col("window")), F.lit("/")).alias("name"), path.alias("path"), depth.alias("depth"), source_at.isNotNull().alias("is_src"), F.get("dirs", depth - 1).alias("last")).distinct()


def find_remappings(listing: DataFrame, root: str) -> DataFrame:
    """(name, path): for each name the best candidate: a source directory before others, the shallower, src before
    contracts, then the first path."""
    prefer = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SOURCE_DIRS)), F.col("last")), F.lit(0)), F.lit(9))
    return first_in_order(candidates(listing, root), ["name"], [~F.col("is_src"), "depth", prefer, "path"]).select("name", "path")
