"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios (Wang & Manning, 2012).

Features are the presence of hashed n-grams (of characters, in lower case, white-space runs as one space). Class
counts give each feature its log-count ratio; the features whose counts differ most between the classes (chi-squared)
stand for the text as their ratios, and a logistic regression is fitted on them. A classifier is fitted on at most
`sample` labelled rows, those with the smallest hash of their id; every text is scored whole.

FEATURES and L2 were chosen by `cross_validated`, whose folds lie within the rows that may be learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import Staged, batches_of, mix, odd_constants, raw, staging, tidied

ORDERS, BUCKETS, FEATURES, L2, SAMPLE = (3, 4, 5, 6), 1 << 20, 1 << 12, 1e-3, 12_000
_STEP = 1 << 20


def features(text: bytes | None) -> Iterator[np.ndarray]:
    """Hashed n-grams of a text's characters, in parts of bounded size; repeated ones are not removed."""
    data = (b" " + b" ".join((text or b"").split()) + b" ").decode().lower()
    c = odd_constants(max(ORDERS), 91)
    for at in range(0, len(data), _STEP):
        part = np.frombuffer(data[at : at + _STEP + max(ORDERS) - 1].encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        for n in ORDERS:
            m = len(part) - n + 1
            if m <= 0:
                continue
            code = part[:m] * c[0]
            for i in range(1, n):
                code = code + part[i : i + m] * c[i]
            yield (mix(code ^ np.uint64(n)) >> np.uint64(44)).astype(np.int32)


def _distinct(parts: Iterator[np.ndarray], wanted: np.ndarray | None = None) -> np.ndarray:
    found = [p if wanted is None else p[wanted[p]] for p in parts]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for b in batches_of(batches):
        for text, y in zip(raw(b.column(0)), b.column(1).to_pylist(), strict=True):
            total[y, _distinct(features(text))] += 1
    some = np.flatnonzero(total.any(axis=0))
    if len(some):
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["f", "n0", "n1"])


def _rows(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([_distinct(features(t), wanted).astype("<i4").tobytes() for t in raw(b.column(0))], pa.binary())], ["y", "f"])

    return run


def _logistic(rows: list[np.ndarray], y: np.ndarray, n: int, scale: np.ndarray, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-penalised logistic regression on presence times `scale` (Adam on all rows)."""
    at = np.concatenate(rows) if rows else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x = scale[at]
    w, b = np.zeros(n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v, step = np.zeros(n + 1), np.zeros(n + 1), 0.05
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], len(rows)) + b, -30, 30)))
        e = (p - y) / len(y)
        g = np.r_[np.bincount(at, e[row] * x, n) + l2 * w, e.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit(labelled: DataFrame, kept: int = FEATURES, l2: float = L2, rounds: int = 200) -> tuple[np.ndarray, float]:
    """A weight for each bucket and a bias, from labelled (text, y): y is 0 or 1."""
    drawn = labelled.select("text", F.col("y").cast("int").alias("y"))
    counts = drawn.mapInArrow(tidied(_counts), "f long, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    f, n0, n1 = (counts.column(c).to_numpy() for c in ("f", "n0", "n1"))
    of = {r["y"]: r["count"] for r in drawn.groupBy("y").count().collect()}
    a, b = of.get(1, 0), of.get(0, 0)
    ratio = np.log(((n1 + 1) / (a + 2)) / ((n0 + 1) / (b + 2))) if len(f) else np.empty(0)
    due1, due0 = (n0 + n1) * a / max(1, a + b), (n0 + n1) * b / max(1, a + b)
    differs = (n1 - due1) ** 2 / (due1 + 1e-9) + (n0 - due0) ** 2 / (due0 + 1e-9)  # chi-squared
    often = n0 + n1 >= 3
    best = np.argsort(-differs * often, kind="stable")[:kept]
    best = best[often[best]]
    wanted, number = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, np.int64)
    wanted[f[best]], number[f[best]] = True, np.arange(len(best))
    rows = drawn.mapInArrow(tidied(_rows(wanted)), "y int, f binary").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    w, b = _logistic([number[np.frombuffer(r, "<i4")] for r in rows.column("f").to_pylist()], y, len(best), ratio[best], l2, rounds)
    weights = np.zeros(BUCKETS, np.float32)
    weights[f[best]] = w * ratio[best]
    return weights, b


def _usable(labels: DataFrame, id_col: str, label_col: str, folds: int, held_out_fold: int) -> DataFrame:
    """(id, y) of the rows that may be learned from."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    return usable.where(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(folds)) != held_out_fold)


def cross_validated(docs: DataFrame, labels: DataFrame, kept: list[int], l2: list[float], inner: int = 3, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out_fold: int = 0) -> list[tuple[int, float, float, float]]:
    """(kept, l2, log loss, accuracy) for each pair of parameters, the least loss first, over `inner` folds of the
    sample. Held-out rows are in none of them; equal texts are in one fold, so that no copy of a judged text is learned."""
    drawn = _usable(labels, id_col, label_col, folds, held_out_fold).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    out = []
    with staging():
        rows = Staged(rows.select("text", "y", F.pmod(F.xxhash64("text"), F.lit(inner)).alias("fold")), "folds").df
        for k in kept:
            for penalty in l2:
                p, y = [], []
                for i in range(inner):
                    weights, bias = fit(rows.where(F.col("fold") != i), k, penalty)
                    judged = rows.where(F.col("fold") == i).select("text", "y").toArrow()
                    p += [_score(weights, bias, t) for t in raw(judged.column("text").combine_chunks())]
                    y += judged.column("y").to_pylist()
                p, y = np.clip(p, 1e-9, 1 - 1e-9), np.array(y)
                out.append((k, penalty, float(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))), float(np.mean((p >= 0.5) == (y == 1)))))
    return sorted(out, key=lambda r: r[2])


def _score(weights: np.ndarray, bias: float, text: bytes | None, wanted: np.ndarray | None = None) -> float:
    z = weights[_distinct(features(text), weights != 0 if wanted is None else wanted)].sum(dtype=np.float64) + bias
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels are learned only from rows whose crc32(id as text) mod `folds` is not `held_out_fold`; a score depends on the
    text alone. Null labels are left out, and of several labels of an id the largest counts. Null texts count as empty,
    and get the score of a text without features. Null ids are not held out and have no label. Without any usable label
    every score is 0 and nothing is predicted toxic. Repeated rows are scored each, texts of any length whole; an empty
    table stays empty. Other columns, of either table, are ignored, whatever their names.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))
    drawn = Staged(_usable(labels, id_col, label_col, folds, held_out_fold).orderBy(F.xxhash64("id"), "id").limit(sample), "drawn").df
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # `sample` rows of two numbers at most are broadcast, and so many texts staged, as fitting reads them twice
    chosen = Staged(held.join(F.broadcast(drawn), "id").select("text", "y"), "labelled")
    weights, bias = fit(chosen.df)
    chosen.drop()
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    known = bool(drawn.head(1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        wanted = w != 0
        for b in batches_of(batches):
            p = np.array([_score(w, bias, t, wanted) if known else 0.0 for t in raw(b.column(2))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return out.mapInArrow(tidied(score), "doc_id long, held_out boolean, score double, predicted int")
