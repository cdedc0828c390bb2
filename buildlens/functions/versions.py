"""Release versions as array<int> [major, minor, patch], and requirements as half-open intervals of them.

Every comparator is an interval [lo, hi), and their conjunction the intersection, so a requirement is one
struct<lo, hi> and a test two array comparisons. hi is null where there is no upper bound.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: EVM versions in order, and the first compiler that knows each of those from byzantium on (fixed values).
EVM_VERSIONS = ["homestead", "tangerineWhistle", "spuriousDragon", "byzantium", "constantinople", "petersburg", "istanbul", "berlin", "london", "paris", "shanghai", "cancun", "prague", "osaka"]
EVM_SINCE = {"byzantium": (0, 4, 21), "constantinople": (0, 4, 22), "petersburg": (0, 5, 5), "istanbul": (0, 5, 14), "berlin": (0, 8, 5), "london": (0, 8, 7), "paris": (0, 8, 18), "shanghai": (0, 8, 20), "cancun": (0, 8, 24), "prague": (0, 8, 27), "osaka": (0, 8, 29)}
#: First compiler releases that take a setting; older ones get null (fixed values).
SETTING_SINCE = {"bytecode_hash": (0, 6, 0), "debug": (0, 6, 0), "stop_after": (0, 7, 3), "via_ir": (0, 7, 5), "inliner": (0, 8, 5), "model_checker": (0, 8, 7), "debug_info": (0, 8, 10), "invariants": (0, 8, 10), "cbor_metadata": (0, 8, 18), "eldarica": (0, 8, 18), "show_proved_safe": (0, 8, 20), "show_unsupported": (0, 8, 20)}


def version(major: int, minor: int, patch: int) -> Column:
    return F.array(F.lit(major), F.lit(minor), F.lit(patch))


def parse_version(text: Column) -> Column:
    """array<int>; null unless text is three numbers (a pre-release or build part is left out)."""
    ok = F.regexp_like(F.trim(text), F.lit(r"^\d+\.\d+\.\d+([-+].*)?$"))
    return F.when(ok, F.transform(F.split(F.regexp_extract(F.trim(text), r"^(\d+\.\d+\.\d+)", 1), r"\."), lambda x: x.cast("int")))


_COMPARATOR = r"^(\^|~|>=|<=|>|<|=)?(\d+)(?:\.(\d+|\*|x|X))?(?:\.(\d+|\*|x|X))?(?:[-+].*)?$"


def _interval(text: Column, exact: Column) -> Column:
    """[lo, hi) of one comparator; null if it is none. exact: a bare version means exactly that one, not caret."""
    part = lambda i: F.regexp_extract(text, _COMPARATOR, i).try_cast("int")
    op, a, b, c = F.regexp_extract(text, _COMPARATOR, 1), part(2), part(3), part(4)
    zero = F.lit(0)
    b0, c0 = F.coalesce(b, zero), F.coalesce(c, zero)
    op = F.when(op != "", op).when(exact | F.regexp_like(text, F.lit(r"[*xX]")), F.lit("=")).otherwise(F.lit("^"))
    low = F.array(a, b0, c0)
    above = F.when(b.isNull(), F.array(a + 1, zero, zero)).when(c.isNull(), F.array(a, b + 1, zero)).otherwise(F.array(a, b, c + 1))  # just past it
    minor = F.when(b.isNull(), F.array(a + 1, zero, zero)).otherwise(F.array(a, b + 1, zero))
    caret = F.when((a > 0) | b.isNull(), F.array(a + 1, zero, zero)).when((b > 0) | c.isNull(), F.array(a, b + 1, zero)).otherwise(F.array(a, b, c + 1))
    least, none = version(0, 0, 0), F.lit(None).cast("array<int>")
    lo = F.when(op == ">", above).when(op.isin("<", "<="), least).otherwise(low)
    hi = F.when(op.isin(">", ">="), none).when(op == "<", low).when(op == "<=", above).when(op == "~", minor).when(op == "^", caret).otherwise(above)
    return F.when(text == "*", F.struct(least.alias("lo"), none.alias("hi"))).when(F.regexp_like(text, F.lit(_COMPARATOR)), F.struct(lo.alias("lo"), hi.alias("hi")))


def comparators(text: Column) -> Column:
    """The comparators of a pragma's requirement, as written."""
    return F.transform(F.split(F.replace(text, F.lit(" "), F.lit(",")), ","), lambda x: F.trim(x))


def parse_requirement(text: Column) -> Column:
    """struct<lo, hi>; null if a comparator can't be parsed (">= 0.8" has an empty one). Only a bare first version is exact."""
    parts = comparators(text)
    # of several comparators only the first one, without an operator, is patched to mean exactly that version
    each = F.transform(parts, lambda x, i: _interval(x, i == 0))
    lo = F.array_max(F.transform(each, lambda r: r["lo"]))
    hi = F.array_min(F.transform(each, lambda r: r["hi"]))
    return F.when(~F.exists(each, lambda r: r.isNull()), F.struct(lo.alias("lo"), hi.alias("hi")))


def merge_requirements(a: Column, b: Column) -> Column:
    """Both requirements; a null one demands nothing."""
    both = F.struct(F.greatest(a["lo"], b["lo"]).alias("lo"), F.least(a["hi"], b["hi"]).alias("hi"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def matches(requirement: Column, v: Column) -> Column:
    """Whether v meets the requirement; a null one is met by all."""
    return F.coalesce((v >= requirement["lo"]) & (requirement["hi"].isNull() | (v < requirement["hi"])), F.lit(True)) & v.isNotNull()


def evm_rank(name: Column) -> Column:
    """Place of an EVM version in order, from 1; null if unknown."""
    return F.nullif(F.array_position(F.array(*map(F.lit, EVM_VERSIONS)), name).cast("int"), F.lit(0))


def evm_name(rank: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, EVM_VERSIONS)), rank)


def highest_evm(v: Column) -> Column:
    """Rank of the newest EVM version that compiler v knows; null below 0.4.21."""
    return F.greatest(*[F.when(v >= version(*since), F.lit(EVM_VERSIONS.index(n) + 1)) for n, since in EVM_SINCE.items()])


def normalise_evm(name: Column, v: Column) -> Column:
    """name, lowered to the newest EVM version that compiler v knows; null below 0.4.21."""
    top = highest_evm(v)
    return F.when(top.isNotNull(), evm_name(F.least(evm_rank(name), top)))


def default_evm(v: Column) -> Column:
    """The EVM version that compiler v targets by itself."""
    found = normalise_evm(F.lit("prague"), v)
    return (
        F.when(found == "constantinople", F.lit("byzantium"))
        .when((found == "cancun") & (v == version(0, 8, 24)), F.lit("shanghai"))
        .when((found == "prague") & (v == version(0, 8, 27)), F.lit("cancun"))
        .otherwise(found)
    )


def sanitised(setting: str, value: Column, v: Column) -> Column:
    """value, or null if compiler v doesn't know the setting."""
    return F.when(v >= version(*SETTING_SINCE[setting]), value)


def sanitised_output_selection(selection: Column, unsupported: list[str]) -> Column:
    """An empty list becomes abi; then unsupported outputs go."""
    full = F.when(F.size(selection) == 0, F.array(F.lit("abi"))).otherwise(selection)
    return F.filter(full, lambda x: ~x.isin(unsupported)) if unsupported else full


# Restrictions: struct<min, max> of comparable values; null bounds restrict nothing.


def satisfies(low: Column, high: Column, value: Column) -> Column:
    """A null value satisfies only what isn't restricted."""
    return F.coalesce(value >= low, low.isNull()) & F.coalesce(value <= high, high.isNull())


def merge_restrictions(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """struct<min, max> of both; null where they exclude each other."""
    low, high = F.greatest(low1, low2), F.least(high1, high2)
    return F.when(F.coalesce(low <= high, F.lit(True)), F.struct(low.alias("min"), high.alias("max")))


def merge_flags(a: Column, b: Column) -> Column:
    """struct<ok, value>: whichever is set; not ok where both are and differ."""
    return F.struct((a.isNull() | b.isNull() | (a == b)).alias("ok"), F.coalesce(a, b).alias("value"))


def apply_restriction(low: Column, high: Column, value: Column) -> Column:
    """value clamped; a null value becomes the lower bound, or else the upper one."""
    return F.when(value.isNull(), F.coalesce(low, high)).when(value < low, low).when(value > high, high).otherwise(value)


#: Outputs that no Vyper release gives, by the first version that does (null: none does; fixed values).
VYPER_UNSUPPORTED = {"evm.bytecode.sourceMap": None, "evm.deployedBytecode.sourceMap": None}
VYPER_SEARCH_PATHS = (0, 4, 0)


def sanitised_vyper(selection: Column, search_paths: Column, v: Column) -> Column:
    """struct<selection, search_paths> that Vyper compiler v takes."""
    kept = sanitised_output_selection(selection, list(VYPER_UNSUPPORTED))
    return F.struct(kept.alias("selection"), F.when(v >= version(*VYPER_SEARCH_PATHS), search_paths).alias("search_paths"))


def merge_settings_restrictions(a: Column, b: Column) -> Column:
    """Both restrictions: struct<evm_min, evm_max, via_ir, runs_min, runs_max, bytecode_hash>; null where they conflict.

    EVM versions are ranks.
    """
    evm, runs = merge_restrictions(a["evm_min"], a["evm_max"], b["evm_min"], b["evm_max"]), merge_restrictions(a["runs_min"], a["runs_max"], b["runs_min"], b["runs_max"])
    ir, code = merge_flags(a["via_ir"], b["via_ir"]), merge_flags(a["bytecode_hash"], b["bytecode_hash"])
    both = F.struct(evm["min"].alias("evm_min"), evm["max"].alias("evm_max"), ir["value"].alias("via_ir"), runs["min"].alias("runs_min"), runs["max"].alias("runs_max"), code["value"].alias("bytecode_hash"))
    return F.when(evm.isNotNull() & runs.isNotNull() & ir["ok"] & code["ok"], both)
