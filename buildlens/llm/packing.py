"""Packing by vector bin packing with the dot-product heuristic.

An example is a vector of tokens, segments (one) and loss-bearing tokens; a sequence has a limit for each. One sequence
is filled at a time: of the examples held that fit, the one with the largest dot product of its demand and what is
left (both as shares of the limits) goes in. Parts as long as a whole sequence are cut off first and stand alone. When
nothing fits and a gap of `min_piece` tokens or more is left, one example is cut to fill it.

A task packs the rows of its own partition, holding at most `held` examples: nothing shuffles, memory is bounded, and a
task that runs again gives the same sequences. Each task leaves at most one sequence partly filled, but for the limits.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import KEPT, batches_of, raw, tidied

MAX_TOKENS, MAX_SEGMENTS, HELD, MIN_PIECE, END_ID, REMEMBERED = 2048, 64, 512, 16, 1, 500_000


@dataclass
class Piece:
    """Tokens start .. start + len(ids) of an example; loss: which bear loss (None: all)."""

    key: object
    start: int
    ids: np.ndarray
    total: int
    loss: np.ndarray | None = None

    def losses(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def fitting(self, tokens: int, losses: int) -> int:
        """How many tokens from the start are within both numbers."""
        if self.loss is None:
            return min(tokens, losses, len(self.ids))
        return min(tokens, int(np.searchsorted(np.cumsum(self.loss), losses, "right")))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.key, self.start, self.ids[:n], self.total, a), Piece(self.key, self.start + n, self.ids[n:], self.total, b)


@dataclass
class Packer:
    max_tokens: int = MAX_TOKENS
    max_segments: int = MAX_SEGMENTS
    max_loss: int = MAX_TOKENS
    held: int = HELD
    min_piece: int = MIN_PIECE
    free: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.limits = np.array([self.max_tokens, self.max_segments, self.max_loss], float)
        self.waiting: list[Piece | None] = [None] * self.held
        self.demand = np.full((self.held, 3), np.inf)  # a slot that holds nothing fits nowhere
        self.shares = np.zeros((self.held, 3))
        self.free = list(range(self.held))[::-1]

    def _hold(self, slot: int, piece: Piece) -> None:
        self.waiting[slot] = piece
        self.demand[slot] = len(piece.ids), 1, piece.losses()
        self.shares[slot] = self.demand[slot] / self.limits

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes a piece in; gives the sequences that are filled by it."""
        while len(piece.ids) >= self.max_tokens or piece.losses() >= self.max_loss:
            head, piece = piece.cut(piece.fitting(self.max_tokens, self.max_loss))
            yield [head]
        if len(piece.ids):
            self._hold(self.free.pop(), piece)
            while not self.free:
                yield self._fill()

    def rest(self) -> Iterator[list[Piece]]:
        while len(self.free) < self.held:
            yield self._fill()

    def _fill(self) -> list[Piece]:
        left, out = self.limits.copy(), []
        while True:
            fit = (self.demand <= left).all(axis=1)
            i = int(np.where(fit, self.shares @ (left / self.limits), -1.0).argmax())
            if fit[i]:
                out.append(self.waiting[i])
                left -= self.demand[i]
                self.waiting[i] = None
                self.demand[i] = np.inf
                self.free.append(i)
                continue
            if left[0] >= self.min_piece and left[1] >= 1 and len(self.free) < self.held:
                size = self.demand[:, 0]
                i = int(np.where(np.isfinite(size), size, -1.0).argmax())  # the longest: its rest is no small piece
                gap = self.waiting[i].fitting(int(left[0]), int(left[2]))
                if gap >= self.min_piece:
                    head, rest = self.waiting[i].cut(gap)
                    self._hold(i, rest)
                    out.append(head)
            return out


def _kept(name: str) -> dict:
    """What packing keeps in a Python worker: tokenizers, and ids of words by tokenizer."""
    return KEPT.setdefault("packing", {}).setdefault(name, {})


def load_tokenizer(path: str):
    """The tokenizer of a file, read once for each Python worker."""
    loaded = _kept("tokenizers")
    if path not in loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded[path] = Tokenizer.from_file(path)
    return loaded[path]


#: By byte: ASCII letters and digits (lower case), and other printable ASCII characters.
_ALNUM = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_PUNCTUATION = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])


def _byte_letters() -> dict[int, str]:
    """The letters for which byte-level tokenizers write bytes: printable ones as they are, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens:
    """Ids of texts, from remembered ids of words (of at most `most`, kept as long as the Python worker lives).

    Only for byte-level tokenizers that lower-case, mark word ends with </w>, never join across ASCII white space or
    between letters or digits and punctuation, take a run of letters as one word, and drop white space (as
    word_bpe_49k.json does). Runs of Latin letters go to the merges alone, many at a time.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.most = load_tokenizer(path), most
        loaded = _kept("merges")
        if path not in loaded:
            bare = Tokenizer.from_file(path)
            bare.normalizer, bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
            ends = np.zeros(bare.get_vocab_size(), bool)
            ends[[i for t, i in bare.get_vocab().items() if t.endswith("</w>")]] = True
            loaded[path] = bare, ends
        self.bare, self.ends = loaded[path]
        self.letters = _byte_letters()
        self.known = _kept(f"words of {path}")

    def _one(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, cores: list[bytes]) -> None:
        """Ids of words without upper-case ASCII letters."""
        letters, written, others = [], [], []
        for w in cores:
            if w.isalpha():
                letters.append(w)
                written.append(w.decode())
                continue
            text = unicodedata.normalize("NFC", w.decode()).lower()
            if text.isalpha() and max(text) < "\u0250":
                letters.append(w)
                written.append(text.encode().decode("latin-1").translate(self.letters))
            else:
                others.append(w)
        for i in range(0, len(letters), 1000):
            ids = np.array(self.bare.encode_batch_fast([" ".join(written[i : i + 1000])], add_special_tokens=False)[0].ids, "<u4")
            data, start = ids.tobytes(), 0
            for w, end in zip(letters[i : i + 1000], (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist(), strict=True):
                self.known[w] = data[start:end]
                start = end
        for i in range(0, len(others), 4096):
            part = others[i : i + 4096]
            for w, e in zip(part, self.tokenizer.encode_batch([w.decode() for w in part], add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def _words(self, text: bytes) -> list[bytes]:
        """Words in lower case (ASCII), parted where letters or digits and ASCII punctuation meet, but not after an
        apostrophe (the pre-tokenizer parts them there as well)."""
        low = text.lower()
        a = np.frombuffer(b" " + low + b"  ", np.uint8)
        at = np.flatnonzero(_PUNCTUATION[a])
        if not len(at):
            return low.split()
        one, two, three = a[at - 1], a[np.maximum(at - 2, 0)], a[np.minimum(at + 2, len(a) - 1)]
        after = a[at + 1]
        ends = _ALNUM[one] | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))
        begins = (a[at] != 39) & (_ALNUM[after] | ((after == 0xC3) & (three != 0x97) & (three != 0xB7)))
        return np.insert(a, np.concatenate([at[ends], at[begins] + 1]), 32).tobytes().split()

    def ids(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        known = self.known
        # a special token in a text has to be found as it is written
        rows = [None if t and b"<|" in t else self._words(t) if t else [] for t in texts]
        if len(known) > self.most:
            known.clear()
        new: set[bytes] = set()
        for words in rows:
            if words:
                new.update(set(words).difference(known))
        self._learn(list(new))
        for words, text in zip(rows, texts, strict=True):
            yield np.frombuffer(self._one(text) if words is None else b"".join(map(known.__getitem__, words)), "<u4")


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def conversation_parts(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(doc_id, parts) of conversations for pack_documents: the turns in order, those of `trained` roles bearing loss.

    Null turns come first, null texts are empty, null roles bear no loss; turns of equal number go by role and text. A
    conversation is one example, so its turns meet in one row.
    """
    part = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.coalesce(F.col(role_col).isin(*trained), F.lit(False)).alias("loss"))
    listed = turns.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part")).groupBy("doc_id").agg(F.array_sort(F.collect_list("part")).alias("all"))
    return listed.select("doc_id", F.transform("all", lambda p: F.struct(p["text"].alias("text"), p["loss"].alias("loss"))).alias("parts"))


def pack_documents(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, end_id: int | None = END_ID, ids: bool = False, id_col: str = "doc_id", text_col: str = "text", parts_col: str | None = None, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, with `ids` the ids, and with
    `parts_col` loss_tokens.

    A document is its text's ids and then end_id (which null and empty texts consist of; without end_id they give no
    row). All its tokens bear loss. With parts_col, an array of structs (text, loss), it is the ids of all its parts in
    turn, of which those of parts with loss bear loss (a null loss is none), and end_id does if the last part does; no
    sequence has more than max_loss of them. Every id lies in exactly one piece; pieces of a sequence follow each other
    from offset 0 without gaps. Sequence ids are unique over all tasks. Repeated rows and null ids are packed like
    others. Texts of any length are packed whole; a task holds all ids of the text at hand, four bytes each, and a worker
    remembers the ids of at most `remembered` words (some 200 bytes each). An empty table gives an empty result. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordTokens(tokenizer_path, remembered), Packer(max_tokens, max_segments, max_loss or max_tokens)
        number, rows = TaskContext.get().partitionId() << 40, []

        def place(sequence: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for p in sequence:
                rows.append((p.key, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, number, offset, p.losses(), p.ids.astype(np.int32) if ids else None))
                offset += len(p.ids)
            number += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays, names = [pa.array(c, pa.int64()) for c in columns[:7]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if ids:
                arrays.append(pa.array(columns[8], pa.list_(pa.int32())))
                names.append("ids")
            if parts_col:
                arrays.append(pa.array(columns[7], pa.int64()))
                names.append("loss_tokens")
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        def examples(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
            if not parts_col:
                yield from ((np.concatenate([found, end]), None) for found in words.ids(raw(b.column(1))))
                return
            listed = [x or [] for x in b.column(1).to_pylist()]
            found = words.ids([(p["text"] or "").encode() if p else b"" for x in listed for p in x])
            for parts in listed:
                own, loss = [], [bool(p and p["loss"]) for p in parts]
                for _ in parts:
                    own.append(next(found))
                last = loss[-1] if loss else False
                yield np.concatenate([*own, end]).astype("<u4"), np.repeat([*loss, last], [*map(len, own), len(end)])

        end = np.array([] if end_id is None else [end_id], "<u4")
        for b in batches_of(batches, 1024):
            for doc, (all_ids, loss) in zip(b.column(0).to_pylist(), examples(b), strict=True):
                for sequence in packer.add(Piece(doc, 0, all_ids, len(all_ids), loss)):
                    place(sequence)
                if len(rows) >= 8192:
                    yield out()
        for sequence in packer.rest():
            place(sequence)
        if rows:
            yield out()

    held = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(parts_col or text_col).alias("text"))
    return held.mapInArrow(tidied(run, keeps="packing"), _SCHEMA + ", ids array<int>" * ids + ", loss_tokens long" * bool(parts_col))
