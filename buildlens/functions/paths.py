"""Path and name rewriting as column expressions. Paths use "/" and compare by component."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slash_path(path: Column) -> Column:
    """Backslashes become slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def clean_path(path: Column) -> Column:
    """Lexical removal of "." and ".." (above the root ".." disappears; a relative path may begin with "..")."""
    rooted = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        pops = (part == "..") & last.isNotNull() & (last != "..")
        drops = (part == "..") & last.isNull() & rooted
        return F.when(pops, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(drops, done).otherwise(F.concat(done, F.array(part)))

    cleaned = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), cleaned)).otherwise(cleaned)


def join_path(base: Column, path: Column) -> Column:
    """base/path; an absolute path replaces the base, and an empty base adds nothing."""
    slash = F.when(F.endswith(base, F.lit("/")) | (base == ""), F.lit("")).otherwise(F.lit("/"))
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(base, slash, path))


def is_under(path: Column, prefix: Column) -> Column:
    """Whether path begins with all components of prefix (a trailing slash of prefix doesn't count)."""
    bare = F.rtrim(prefix, F.lit("/"))
    return (path == bare) | F.startswith(path, F.concat(bare, F.lit("/"))) | (prefix == "")


def strip_prefix(path: Column, prefix: Column) -> Column:
    """path without prefix, or as it is where it isn't under it."""
    bare = F.rtrim(prefix, F.lit("/"))
    return F.when((prefix != "") & is_under(path, prefix), F.ltrim(F.substr(path, F.length(bare) + 1), F.lit("/"))).otherwise(path)


def parent(path: Column) -> Column:
    """Everything before the last slash; empty without one, "/" directly below the root."""
    cut = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(F.startswith(path, F.lit("/")) & (cut == ""), F.lit("/")).otherwise(cut)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """The file name without its last extension; a name that only begins with a dot stays."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r".\.([^.]*)$", 1)


def ancestors(path: Column) -> Column:
    """The directories above path, deepest first, down to the first component (absolute paths: and "/")."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    rooted = F.startswith(path, F.lit("/"))
    many = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    dirs = F.transform(many, lambda n: F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(F.slice(parts, 1, n), "/")))
    return F.when(rooted, F.concat(dirs, F.array(F.lit("/")))).otherwise(dirs)


def _common(a: Column, b: Column) -> Column:
    """Number of leading elements in which two arrays agree."""
    n = F.least(F.size(a), F.size(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    differ = F.array_min(F.filter(at, lambda i: F.element_at(a, i) != F.element_at(b, i)))
    return F.coalesce(differ - 1, n)


def common_ancestor(a: Column, b: Column) -> Column:
    """Longest common prefix by component; null where there is none."""
    x, y = F.split(a, "/"), F.split(b, "/")
    found = F.array_join(F.slice(x, 1, _common(x, y)), "/")
    return F.when((found == "") & F.startswith(a, F.lit("/")) & F.startswith(b, F.lit("/")), F.lit("/")).when(found == "", F.lit(None)).otherwise(found)


def rebase_path(base: Column, path: Column) -> Column:
    """path relative to base, with ".." where it has to go up."""
    x, y = F.split(clean_path(base), "/"), F.split(clean_path(path), "/")
    n = _common(x, y)
    up = F.array_repeat(F.lit(".."), F.size(F.filter(F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0))), lambda p: p != "")))
    return F.array_join(F.concat(up, F.slice(y, n + 1, F.greatest(F.size(y) - n, F.lit(0)))), "/")


def slug(path: Column, name: Column) -> Column:
    return F.concat(file_stem(path), F.lit(".json:"), name)


def slug_versioned(path: Column, name: Column, version: Column) -> Column:
    """version: array<int> of major, minor, patch."""
    return F.concat(file_stem(path), F.lit("."), F.array_join(version.cast("array<string>"), "."), F.lit(".json:"), name)


def identifier(source: Column, name: Column) -> Column:
    return F.concat_ws(":", source, name)


def output_file_name(name: Column, version: Column | None = None, profile: Column | None = None) -> Column:
    """name[.version][.profile].json; null version or profile is left out."""
    version = F.lit(None).cast("string") if version is None else version
    profile = F.lit(None).cast("string") if profile is None else profile
    return F.concat(F.concat_ws(".", name, version, profile), F.lit(".json"))


def output_file(path: Column, name: Column, version: Column | None = None, profile: Column | None = None) -> Column:
    return F.concat(file_name(path), F.lit("/"), output_file_name(name, version, profile))


def parse_remapping(text: Column) -> Column:
    """[context:]name=path as struct<context, name, path>; null without "=" or with a blank name or path."""
    m = lambda i: F.regexp_extract(text, r"^(?:([^:=]*):)?([^=]*)=(.*)$", i)
    name, path, context = F.trim(m(2)), F.trim(m(3)), F.trim(m(1))
    return F.when((name != "") & (path != ""), F.struct(F.when(context != "", context).alias("context"), m(2).alias("name"), m(3).alias("path")))


def parse_contract_info(text: Column) -> Column:
    """path:name or name as struct<path, name>; of several colons, the segments next to the last one count."""
    parts = F.split(text, ":")
    return F.struct(F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("path"), F.element_at(parts, -1).alias("name"))


def guess_language(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "sol", F.lit("Solidity")).when(ext == "yul", F.lit("Yul")).when(ext.isin("vy", "vyi"), F.lit("Vyper"))
