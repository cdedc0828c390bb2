"""Secret scan with corpus-wide ownership frequency.

Patterns find the base spans: assignments, access keys and hexadecimal strings. Further candidates are long tokens of
letters and digits that look random and lie outside the base spans. Every candidate's value is hashed, and the hashes
are counted over the whole corpus by distinct repositories and by distinct owners. A value that more than `most_owners`
owners have, or more than `most_repositories` repositories (be they all one owner's), is a widely copied example; one
that few repositories of its owner have looks live. Live-looking candidates are added as spans of kind "owned"; base
spans always stay, and are counted as live or example.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import Staged, batches_of, raw, tidied

KINDS = ("assign", "access", "hex", "owned")
_either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")  # a run of 32 or more: shorter runs are dropped anyway
OWNED = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_LONG_BYTES = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_BITS, MOST_OWNERS, MOST_REPOSITORIES = 3.0, 1, 10


def bits_per_character(value: str) -> float:
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's index, end, value), by start and kind; code points, end exclusive."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def further_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking tokens that overlap no base span."""
    out = []
    for m in OWNED.finditer(text):
        v = m[0]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and bits_per_character(v) >= MIN_BITS and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), 3, m.end(), v))
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("value", pa.int64())]))
    for b in batches_of(batches):
        counts, sha, spans = [], [], []
        for data in raw(b.column(2)):
            base, more = [], []
            if data:
                low = data.lower()
                named, long = any(h in low for h in _HINTS), _LONG_BYTES.search(data) is not None
                if named or long or b"AKIA" in data:
                    text = data.decode()
                    base = base_spans(text)
                    more = further_spans(text, base) if long else []
            counts.append([sum(k == i for _, k, _, _ in base) for i in range(3)])
            sha.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
            spans.append([(s, k, e, xxhash.xxh3_64_intdigest(v) - (1 << 63)) for s, k, e, v in sorted(base + more)])
        columns = [b.column(0), b.column(1), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(sha), pa.array([[dict(zip(("start", "kind", "stop", "value"), x, strict=True)) for x in row] for row in spans], span)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def scan_secrets(docs: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example.

    spans has kind:start:end of all base spans and of the added ones, by start and then kind, comma-joined; it is empty
    where there are none. n_live counts the base spans whose values at most `most_owners` owners and
    `most_repositories` repositories have, n_example the others. A repository is a document unless a column is named.
    Null texts count as empty, texts of any length are read whole, a null owner or repository counts as one of its own;
    repeated rows are judged each, but count once in the frequencies; an empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    repository = F.col(repository_col or id_col).cast("string")
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.struct(F.col(owner_col).cast("string").alias("owner"), repository.alias("repository")).alias("owner"), F.col(text_col).alias("text"))
    found = held.mapInArrow(tidied(_found), "doc_id long, owner struct<owner: string, repository: string>, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start: long, kind: int, stop: long, value: long>>")
    rows = Staged(found.withColumn("rid", F.monotonically_increasing_id()), "secrets").df
    each = rows.where(F.size("found") > 0).select("rid", "owner.*", F.explode("found").alias("span"))
    each = each.withColumn("value", F.col("span.value"))
    by_place = each.select("value", "owner", "repository").distinct()
    by_owner = by_place.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    owned = by_owner.groupBy("value").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    owned = Staged(owned, "owned").df
    judged = each.join(owned, "value").withColumn("live", (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories))
    kept = judged.where(F.col("live") | (F.col("span.kind") < 3)).groupBy("rid").agg(
        F.array_sort(F.collect_list(F.struct("span.start", "span.kind", "span.stop"))).alias("all"),
        F.count_if(F.col("live") & (F.col("span.kind") < 3)).alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
    )
    name = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    zero = F.lit(0).cast("long")
    return rows.join(kept, "rid", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"))
