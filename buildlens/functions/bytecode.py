"""Bytecode objects: link placeholders, linking and decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public standard: rotations and lanes of the permutation.
_ROTATIONS = [1, 3, 6, 10, 15, 21, 28, 36, 45, 55, 2, 14, 27, 41, 56, 8, 25, 43, 62, 18, 39, 61, 20, 44]
_LANES = [10, 7, 11, 17, 18, 3, 5, 16, 8, 21, 24, 4, 15, 23, 19, 13, 12, 2, 20, 14, 22, 9, 6, 1]
_MASK = (1 << 64) - 1


def _round_constants() -> list[int]:
    """From the public rule: bits of a linear feedback shift register (x^8 + x^6 + x^5 + x^4 + 1)."""
    out, state = [], 1
    for _ in range(24):
        word = 0
        for j in range(7):
            if state & 1:
                word |= 1 << ((1 << j) - 1)
            state = ((state << 1) ^ (0x171 if state & 0x80 else 0)) & 0xFF
        out.append(word)
    return out


_CONSTANTS = _round_constants()


def _permute(a: list[int]) -> None:
    for constant in _CONSTANTS:
        c = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
        for x in range(5):
            d = c[(x + 4) % 5] ^ ((c[(x + 1) % 5] << 1 | c[(x + 1) % 5] >> 63) & _MASK)
            for y in range(0, 25, 5):
                a[x + y] ^= d
        held = a[1]
        for lane, turn in zip(_LANES, _ROTATIONS, strict=True):
            a[lane], held = (held << turn | held >> (64 - turn)) & _MASK, a[lane]
        for y in range(0, 25, 5):
            row = a[y : y + 5]
            for x in range(5):
                a[x + y] = row[x] ^ (~row[(x + 1) % 5] & row[(x + 2) % 5] & _MASK)
        a[0] ^= constant


def keccak256(data: bytes) -> bytes:
    """Keccak-256 with the original padding, as contracts use it (not SHA3-256)."""
    rate, state = 136, [0] * 25
    data = bytearray(data) + b"\x01"
    data += b"\0" * (-len(data) % rate)
    data[-1] |= 0x80
    for i in range(0, len(data), rate):
        for j in range(0, rate, 8):
            state[j // 8] ^= int.from_bytes(data[i + j : i + j + 8], "little")
        _permute(state)
    return b"".join(x.to_bytes(8, "little") for x in state[:4])


def library_hash(name: Column) -> Column:
    """The first 17 bytes of the name's keccak-256, in hex (Spark has no such function: an Arrow-batched UDF)."""

    def digest(names: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return names.map(lambda x: None if x is None else known.setdefault(x, "") or known.update({x: keccak256(x.encode())[:17].hex()}) or known[x])

    return F.pandas_udf(digest, "string")(name)


def hash_placeholder(digest: Column) -> Column:
    """What newer compiler releases write, between two underscores, for a library with that hash."""
    return F.concat(F.lit("$"), digest, F.lit("$"))


def name_placeholder(qualified: Column) -> Column:
    """What older compiler releases write: the qualified name cut or filled to 36 characters."""
    return F.rpad(qualified, 36, "_")


def contains_placeholder(code: Column, qualified: Column, digest: Column) -> Column:
    return F.contains(code, hash_placeholder(digest)) | F.contains(code, name_placeholder(qualified))


def link(code: Column, qualified: Column, digest: Column, address: Column) -> Column:
    """Both kinds of placeholder replaced by the address (40 hex digits, with or without 0x)."""
    to = F.regexp_replace(F.lower(address), "^0x", "")
    once = F.replace(code, F.concat(F.lit("__"), hash_placeholder(digest), F.lit("__")), to)
    return F.replace(once, F.concat(F.lit("__"), name_placeholder(qualified), F.lit("__")), to)


def link_all(code: Column, references: Column, libraries: Column) -> Column:
    """struct<code, references, linked>: all of libraries (array<struct<file, name, digest, address>>) linked in turn.

    references, map<file, array<name>>, lose what was linked, and files without any; a library that they don't name is
    left alone. linked: no placeholder is left.
    """
    kind = "struct<code: string, refs: map<string, array<string>>>"
    start = F.struct(code.alias("code"), references.alias("refs")).cast(kind)

    def step(state: Column, lib: Column) -> Column:
        names = state["refs"][lib["file"]]
        named = F.coalesce(F.array_contains(names, lib["name"]), F.lit(False)) & is_unlinked(state["code"])
        left = F.transform_values(state["refs"], lambda f, n: F.when(f == lib["file"], F.array_remove(n, lib["name"])).otherwise(n))
        done = F.struct(link(state["code"], F.concat_ws(":", lib["file"], lib["name"]), lib["digest"], lib["address"]).alias("code"), F.map_filter(left, lambda _, n: F.size(n) > 0).alias("refs"))
        return F.when(named, done.cast(kind)).otherwise(state)

    out = F.aggregate(libraries, start, step)
    return F.struct(out["code"].alias("code"), out["refs"].alias("references"), (~is_unlinked(out["code"])).alias("linked"))


def is_unlinked(code: Column) -> Column:
    return F.contains(code, F.lit("__"))


def decode(code: Column) -> Column:
    """Bytes of hex digits, with or without 0x; null where it is no hex, as in unlinked code."""
    return F.try_to_binary(F.regexp_replace(code, "^0x", ""), F.lit("hex"))


def without_placeholders(code: Column) -> Column:
    """Every placeholder, underscores included, as 20 zero bytes, then decoded."""
    return decode(F.regexp_replace(code, r"__\$.{34}\$__", "00" * 20))


def merged_references(deployed: Column, runtime: Column) -> Column:
    """map of file to references: both maps, a file of the second replacing that of the first."""
    kept = F.map_filter(deployed, lambda k, _: ~F.map_contains_key(runtime, k))
    return F.map_concat(kept, runtime)


def state_mutability(explicit: Column, constant: Column, payable: Column) -> Column:
    """Mutability of old syntax trees, which have two flags instead."""
    return F.coalesce(explicit, F.when(payable, F.lit("payable")).when(constant, F.lit("view")).otherwise(F.lit("nonpayable")))


def function_kind(explicit: Column, is_constructor: Column, name: Column) -> Column:
    return F.coalesce(explicit, F.when(is_constructor, F.lit("constructor")).when(name == "", F.lit("fallback")).otherwise(F.lit("function")))


def variable_mutability(explicit: Column, constant: Column) -> Column:
    return F.coalesce(explicit, F.when(constant, F.lit("constant")).otherwise(F.lit("mutable")))


def source_location(text: Column) -> Column:
    """start:length:index as a struct; negative numbers are null."""
    at = lambda i: F.when(F.try_element_at(F.split(text, ":"), F.lit(i)).try_cast("bigint") >= 0, F.try_element_at(F.split(text, ":"), F.lit(i)).try_cast("bigint"))
    return F.struct(at(1).alias("start"), at(2).alias("length"), at(3).alias("index"))
