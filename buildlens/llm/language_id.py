"""Language identification of mixed texts: script ranges, per-word scores and Viterbi with a switching penalty.

A word's score for a language is the mean-weighted log probability of its character n-grams (UTF-8 bytes of the
lower-cased word between boundary marks), relative to the mean over languages. Languages that don't use the word's
script are ruled out; a word in a script that no language uses speaks for none. The best path through the languages,
paying `penalty` for each change, labels spans of words; the language with the most words that speak for it is the
document's, and their share of all words with a letter is the score.

Where no other language gains more than half the penalty over the best single one in any run of words, the constant
path is the best one, and Viterbi isn't run; this changes no result. The model is fitted on at most `sample` documents,
those with the smallest hash of their id.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import batches_of, mix, odd_constants, raw, tidied

ORDERS, BUCKETS, SAMPLE, PENALTY, RULED_OUT, MIN_SCORE, CACHE = (1, 2, 3, 4), 1 << 17, 4_000, 6.0, -8.0, 0.3, 60_000
#: First and last code points of scripts (fixed values of Unicode blocks); anything else is script 0.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x1E00, 0x1EFF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x1F00, 0x1FFF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0750, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"),
    (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0D80, 0x0DFF, "Sinhala"), (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"),
    (0x0F00, 0x0FFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0xAC00, 0xD7AF, "Hangul"),
    (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"),
]
_NAMES = ["", *dict.fromkeys(n for _, _, n in SCRIPTS)]
_MARKS = b".,;:!?\"'()[]{}<>*#-_=/\\"


def script_of(word: str) -> int:
    """The script of the first letter (0: none of the table); -1 without a letter."""
    for c in word:
        if c.isalpha():
            at = ord(c)
            return next((_NAMES.index(n) for a, b, n in SCRIPTS if a <= at <= b), 0)
    return -1


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word's number, bucket) of all n-grams; words are already lower-cased and marked off with ^ and $."""
    size = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), size)
    c = odd_constants(max(ORDERS), 57)
    owners, buckets = [], []
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        code = data[:m] * c[0]
        for i in range(1, n):
            code = code + data[i : i + m] * c[i]
        inside = owner[:m] == owner[n - 1 :]
        owners.append(owner[:m][inside])
        buckets.append((mix(code[inside] ^ np.uint64(n)) >> np.uint64(47)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def _prepared(word: bytes) -> tuple[bytes, int]:
    text = unicodedata.normalize("NFC", word.strip(_MARKS).decode()).lower()
    return b"^" + text.encode() + b"$", script_of(text)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, bucket, n): n-gram counts (kind 0) and words by script (kind 1)."""
    for b in batches_of(batches, 1024, 3_000_000):
        by: dict[str, list[bytes]] = {}
        for text, lang in zip(raw(b.column(0)), b.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).extend((text or b"").split())
        for lang, words in by.items():
            found = [_prepared(w) for w in words]
            found = [(w, s) for w, s in found if s >= 0]
            if not found:
                continue
            _, buckets = word_grams([w for w, _ in found])
            counts = np.bincount(buckets, minlength=BUCKETS)
            some = np.flatnonzero(counts)
            scripts = np.bincount([s for _, s in found], minlength=len(_NAMES))
            kinds = np.flatnonzero(scripts)
            n = len(some) + len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(np.r_[np.zeros(len(some), np.int32), np.ones(len(kinds), np.int32)].astype(np.int32)), pa.array(np.r_[some, kinds]), pa.array(np.r_[counts[some], scripts[kinds]])], ["lang", "kind", "bucket", "n"])


class Model:
    """Languages, log probabilities (buckets, languages) and which scripts each language uses."""

    def __init__(self, table: pa.Table):
        lang, kind, bucket, n = (table.column(c).to_pylist() if c == "lang" else table.column(c).to_numpy() for c in ("lang", "kind", "bucket", "n"))
        self.languages = sorted(set(lang))
        at = np.array([self.languages.index(x) for x in lang], np.int64)
        counts, scripts = np.zeros((BUCKETS, len(self.languages))), np.zeros((len(_NAMES), len(self.languages)))
        np.add.at(counts, (bucket[kind == 0], at[kind == 0]), n[kind == 0])
        np.add.at(scripts, (bucket[kind == 1], at[kind == 1]), n[kind == 1])
        logs = np.log((counts + 0.05) / (counts.sum(axis=0) + 0.05 * BUCKETS))
        self.logs = (logs - logs.mean(axis=1, keepdims=True) if self.languages else logs).astype(np.float32)
        self.uses = scripts > 1e-3 * scripts.sum(axis=0)

    def scores(self, words: list[bytes]) -> np.ndarray:
        """(words, languages + 1): the scores, and 1 where the word has a letter, 2 if of a script that a language uses."""
        found = [_prepared(w) for w in words]
        out = np.zeros((len(words), len(self.languages) + 1), np.float32)
        letters = [i for i, (_, s) in enumerate(found) if s >= 0]
        if not letters:
            return out
        owner, bucket = word_grams([found[i][0] for i in letters])
        order = np.argsort(owner, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(owner[order]) > 0])
        part = np.add.reduceat(self.logs[bucket[order]], first, axis=0) / len(ORDERS)
        scripts = np.array([found[i][1] for i in letters])
        known = self.uses[scripts].any(axis=1, keepdims=True)
        out[letters, :-1] = np.where(self.uses[scripts] | ~known, part, part.min(axis=1, keepdims=True) + RULED_OUT)
        out[letters, -1] = 1 + known[:, 0]
        return out


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The best path through each (words, languages) matrix; all matrices step on together, the longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    size = np.array([len(scores[i]) for i in order])
    begin = np.r_[0, np.cumsum(size)]
    flat = np.concatenate([scores[i] for i in order])
    n, k = size[0], flat.shape[1]
    active = np.searchsorted(-size, -np.arange(n), "left")  # matrices longer than t
    best = flat[begin[:-1]].copy()
    top = np.zeros(len(flat), np.int16)  # the language from which a change to step t comes
    moved = np.zeros((len(flat), k), bool)
    for t in range(1, n):
        a = active[t]
        at = begin[:a] + t
        now = best[:a]
        high = now.argmax(axis=1)
        change = now[np.arange(a), high][:, None] - penalty
        move = change > now
        top[at], moved[at] = high, move
        best[:a] = np.where(move, change, now) + flat[at]
    path = np.zeros(len(flat), np.int16)
    state = best.argmax(axis=1)
    for t in range(n - 1, -1, -1):
        a = active[t]
        at, s = begin[:a] + t, state[:a]
        path[at] = s
        state[:a] = np.where(moved[at, s], top[at], s)
    out: list = [None] * len(scores)
    for j, i in enumerate(order):
        out[i] = path[begin[j] : begin[j + 1]]
    return out


def one_language(scores: np.ndarray, penalty: float) -> int:
    """The language of the best path where it is certainly constant, else -1."""
    sums = np.cumsum(scores.astype(np.float64), axis=0)
    lead = int(sums[-1].argmax())
    gain = np.vstack([np.zeros(scores.shape[1]), sums - sums[:, [lead]]])
    return lead if (gain - np.minimum.accumulate(gain, axis=0)).max() <= penalty / 2 else -1


class Labeller:
    def __init__(self, model: Model, penalty: float):
        self.model, self.penalty = model, penalty
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, len(self.model.languages) + 1), np.float32)

    def __call__(self, texts: list[bytes | None]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans of words) of each text."""
        out: list = [("und", 0.0, [])] * len(texts)
        if not self.model.languages:
            return out
        words = [t.split() if t else [] for t in texts]
        if len(self.known) > CACHE:
            self._clear()
        new = [w for w in dict.fromkeys(w for row in words for w in row) if w not in self.known]
        if new:
            start = len(self.known)
            self.table = np.concatenate([self.table, self.model.scores(new)])
            self.known.update(zip(new, range(start, start + len(new)), strict=True))
        mixed: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i, row in enumerate(words):
            rows = self.table[np.fromiter(map(self.known.__getitem__, row), np.int64, len(row))]
            has = rows[:, -1] > 0
            if not has.any():
                continue
            lead = one_language(rows[:, :-1], self.penalty)
            if lead >= 0:
                out[i] = (self.model.languages[lead], float((rows[:, -1] > 1).sum() / has.sum()), [(0, len(row), self.model.languages[lead])])
            else:
                mixed.append((i, rows[:, :-1], rows[:, -1]))
        if mixed:
            for (i, _, kind), path in zip(mixed, viterbi([s for _, s, _ in mixed], self.penalty), strict=True):
                has = kind > 0
                votes = np.bincount(path[kind > 1], minlength=len(self.model.languages))
                lead = int(votes.argmax())
                head = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
                spans = [(int(a), int(b), self.model.languages[path[a]]) for a, b in zip(head, np.r_[head[1:], len(path)], strict=True)]
                out[i] = (self.model.languages[lead], float(votes[lead] / has.sum()), spans)
        return out


def fit(learn: DataFrame) -> Model:
    """From (text, lang)."""
    return Model(learn.mapInArrow(tidied(_learn), "lang string, kind int, bucket long, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow())


def learned(docs: DataFrame, sample: int, id_col: str, text_col: str, lang_col: str, folds: int, held_out_fold: int) -> Model:
    usable = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).where(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) != held_out_fold)
    ids = usable.select(F.col(id_col).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    drawn = usable.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).join(F.broadcast(ids), "id")  # `sample` numbers at most
    return fit(drawn.select("text", "lang"))


def languages(docs: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY, spans: bool = True, learn: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score and, with `spans`, spans (start, stop, lang) of words.

    Learns from the text and non-null language of documents (of `learn`, or else of docs) whose crc32(id as text) mod
    `folds` is not `held_out_fold`; a prediction depends on the text alone. "und" with score 0 is predicted for null
    texts and texts without a letter, and for all if nothing could be learned. A text in scripts that no learned
    language uses has score 0 as well. Of languages with as many words the first by name counts. Null ids are not held
    out and not learned from. Texts of any length are read whole. Repeated rows are judged each; an empty table stays
    empty. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    model = learned(docs if learn is None else learn, sample, id_col, text_col, lang_col, folds, held_out_fold)
    shared = spark.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("lang", pa.string())]))
        for b in batches_of(batches, 1024, 3_000_000):
            found = labeller(raw(b.column(2)))
            columns = [b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if spans:
                columns.append(pa.array([[dict(zip(("start", "stop", "lang"), s, strict=True)) for s in x[2]] for x in found], kind))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "spans"][: len(columns)])

    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))
    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return held.mapInArrow(tidied(label), "doc_id long, held_out boolean, lang_pred string, score double" + ", spans array<struct<start: long, stop: long, lang: string>>" * spans)


def drop_unidentified(docs: DataFrame, kept: list[str] | None = None, min_score: float = MIN_SCORE, sample: int = SAMPLE, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """docs without the rows whose language isn't one of `kept` (all that were learned, if none are named) or whose score
    is below min_score: texts in other languages or scripts, texts that are too mixed, null texts and texts without a
    letter. Columns stay as they are, whatever their names.

    Rules as in languages; nothing shuffles. Where no language could be learned nothing is dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learned(docs, sample, id_col, text_col, lang_col, folds, held_out_fold))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        wanted, labeller = set(model.languages if kept is None else kept), Labeller(model, penalty)
        for b in batches_of(batches, 1024, 3_000_000):
            good = [not model.languages or (lang in wanted and score >= min_score) for lang, score, _ in labeller(raw(b.column(at)))]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(tidied(keep), docs.schema)
