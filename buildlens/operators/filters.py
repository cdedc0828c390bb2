"""Filters and predicates: files, diagnostics, output selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.functions.paths import is_under
from buildlens.functions.versions import satisfies

#: Severities from the gravest; a filter lets pass what is as grave as itself or graver (fixed order).
SEVERITIES = ("error", "warning", "info")
#: Codes of missing licences and of contract size, which don't count in test files (fixed values).
TEST_CODES = (1878, 5574)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(severity))


def is_test_file(path: Column) -> Column:
    return F.endswith(path, F.lit(".t.sol"))


def is_test(path: Column, function_names: Column) -> Column:
    """A test by its file's name, or by a function IS_TEST in its interface (null names: none)."""
    return is_test_file(path) | F.coalesce(F.array_contains(function_names, F.lit("IS_TEST")), F.lit(False))


def matching_files(files: DataFrame, condition: Column) -> DataFrame:
    return files.where(condition)


def sparse_outputs(jobs: DataFrame, required: DataFrame, wants_ast: bool) -> DataFrame:
    """jobs (job_id, path, dirty, matches) with `selected`: whether the file keeps its full output selection.

    Dirty files that match keep it, and so do the files they need for linking (required: job_id, path). When syntax
    trees are asked for nothing is pruned.
    """
    if wants_ast:
        return jobs.withColumn("selected", F.lit(True))
    needed = required.select("job_id", "path").distinct().withColumn("needed", F.lit(True))
    return jobs.join(needed, ["job_id", "path"], "left").withColumn("selected", (F.col("dirty") & F.col("matches")) | F.coalesce("needed", F.lit(False))).drop("needed")


def retain_files(outputs: DataFrame, kept: DataFrame, path_col: str = "path") -> DataFrame:
    """Rows of outputs whose path, in lower case, is among kept (path)."""
    names = kept.select(F.lower("path").alias("_path")).distinct()
    return outputs.join(names, F.lower(outputs[path_col]) == F.col("_path"), "left_semi")


def ignored(diagnostics: DataFrame, codes: list[int], paths: list[str], codes_from: list[tuple[str, list[int]]], tests: DataFrame | None = None) -> DataFrame:
    """diagnostics (severity, error_code, file, ...) with `ignored`.

    Only warnings with an error code can be: by the code, by a prefix of their file, by both together, or a test file's
    TEST_CODES. Prefixes compare by component. The three lists are configuration and small; tests (path) is joined.
    """
    file, code = F.col("file"), F.col("error_code")
    under = lambda prefix: F.coalesce(is_under(file, F.lit(prefix)), F.lit(False))
    hit = code.isin(codes) if codes else F.lit(False)
    for p in paths:
        hit = hit | under(p)
    for p, some in codes_from:
        hit = hit | (under(p) & code.isin(some))
    test = is_test_file(file)
    out = diagnostics
    if tests is not None:
        out = out.join(tests.select(F.col("path").alias("_test")).distinct(), F.col("file") == F.col("_test"), "left")
        test = test | F.col("_test").isNotNull()
    hit = hit | (F.coalesce(test, F.lit(False)) & code.isin(*TEST_CODES))
    out = out.withColumn("ignored", (F.lower("severity") == "warning") & code.isNotNull() & F.coalesce(hit, F.lit(False)))
    return out.drop("_test")


def has_error(judged: DataFrame, severity_filter: str = "error", by: list[str] | None = None) -> DataFrame:
    """has_error and has_warning over judged diagnostics (see ignored), for each group of `by`.

    An error always counts. A filter of warning counts every diagnostic that isn't ignored, infos as well; a filter of
    info counts all.
    """
    error = F.coalesce(F.bool_or(F.lower("severity") == "error"), F.lit(False))
    warning = F.coalesce(F.bool_or(~F.col("ignored")), F.lit(False))
    grave = F.coalesce(F.bool_or(severity_rank(F.col("severity")) <= SEVERITIES.index(severity_filter) + 1), F.lit(False))
    found = (error | (grave & warning)) if severity_filter == "warning" else (error | grave)
    return judged.groupBy(*(by or [])).agg(found.alias("has_error"), warning.alias("has_warning"))


def satisfies_restrictions(evm: Column, via_ir: Column, runs: Column, optimizer: Column, bytecode_hash: Column, r: Column) -> Column:
    """Whether settings meet a restriction r: struct<evm_min, evm_max, via_ir, runs_min, runs_max, bytecode_hash>.

    EVM versions are ranks. Runs above zero only count with the optimizer on.
    """
    return (
        satisfies(r["evm_min"], r["evm_max"], evm)
        & (r["via_ir"].isNull() | (r["via_ir"] == F.coalesce(via_ir, F.lit(False))))
        & (r["bytecode_hash"].isNull() | r["bytecode_hash"].eqNullSafe(bytecode_hash))
        & satisfies(r["runs_min"], r["runs_max"], runs)
        & (~F.coalesce(r["runs_min"] > 0, F.lit(False)) | F.coalesce(optimizer, F.lit(False)))
    )


def selection_rows(settings: DataFrame, key: str = "id", selection: str = "selection") -> DataFrame:
    """(key, file, contract, output) of map<file, map<contract, array<output>>>; an empty list has a null output."""
    files = settings.select(key, F.explode(selection).alias("file", "contracts"))
    return files.select(key, "file", F.explode("contracts").alias("contract", "outputs")).select(key, "file", "contract", F.explode_outer("outputs").alias("output"))


def is_subset(a: Column, b: Column) -> Column:
    """Whether selection a is part of b: every file, contract and output (wildcards are names like others)."""
    missing = lambda f, contracts: F.exists(
        F.map_keys(contracts), lambda c: ~F.coalesce(F.map_contains_key(b[f], c), F.lit(False)) | (F.size(F.array_except(contracts[c], b[f][c])) > 0)
    )
    return ~F.exists(F.map_entries(a), lambda e: ~F.map_contains_key(b, e["key"]) | missing(e["key"], e["value"]))


def can_use_cached(a: Column, b: Column, fields: list[str], selection: str = "selection") -> Column:
    """Settings structs a and b agree in all fields, and a's output selection is part of b's."""
    same = F.lit(True)
    for f in fields:
        same = same & a[f].eqNullSafe(b[f])
    return same & is_subset(a[selection], b[selection])


def contains_ast(selection: Column) -> Column:
    """Any file asks, for the empty contract name, for the syntax tree or for everything."""
    return F.exists(F.map_values(selection), lambda c: F.coalesce(F.exists(c[""], lambda x: x.isin("ast", "*")), F.lit(False)))


def contains_contract_definition(ast: Column) -> Column:
    """A VARIANT syntax tree has a contract, interface or library among its top nodes."""
    kinds = F.try_variant_get(ast, "$.nodes", "array<struct<nodeType string>>")
    return F.coalesce(F.exists(kinds, lambda n: n["nodeType"] == "ContractDefinition"), F.lit(False))


