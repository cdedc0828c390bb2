"""JSON files beyond a task's memory: one object whose members hold objects, read in parallel and in pieces.

The file is read as text parted at closing braces, so it splits anywhere. A first pass tells, for each block of it, whether
it ends inside a string and how deep, from either start; so a second pass knows where each block starts and cuts
behind each object at depth 2, which is a member of a member of the file. Pieces that lie in two blocks are put together.

Texts that one task gets or makes as a stream (inputs and outputs of compilers) are cut in the same way by `members`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.storage import Written

_PIECES = "file string, block long, n long, low boolean, seam int, text string"
HEAD, TAIL = 1, 2


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(file, block, bytes with their closing braces) of the rows of one block that a batch has."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        if not b.num_rows:
            continue
        text, files, blocks = b.column(0).cast(pa.large_binary()), b.column(1), b.column(2).to_numpy()
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        other = (blocks[1:] != blocks[:-1]) | pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
        for i, j in pairwise([0, *(np.flatnonzero(other) + 1).tolist(), b.num_rows]):
            yield files[i].as_py(), int(blocks[i]), np.insert(data[at[i] : at[j]], at[i + 1 : j + 1] - at[i], ord("}"))


def _structure(data) -> tuple:
    """Quotes that begin or end strings, and places and steps of brackets, those in strings too."""
    import numpy as np

    quotes, slash = np.flatnonzero(data == ord('"')), data == ord("\\")
    if slash.any():
        i = np.arange(len(data))
        run = i - np.maximum.accumulate(np.where(slash, -1, i))  # backslashes up to each place
        quotes = quotes[(quotes == 0) | (run[quotes - 1] % 2 == 0)]
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in "{["]], table[[ord(c) for c in "}]"]] = 1, -1
    steps = table[data]
    places = np.flatnonzero(steps)
    return quotes, places, steps[places]


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: the parity of its quotes, and what it adds to the depth if it starts outside or inside a string."""
    import numpy as np

    found: dict[tuple, list[int]] = {}
    for file, block, data in _runs(batches):
        s = found.setdefault((file, block), [0, 0, 0])
        quotes, places, steps = _structure(data)
        odd = (np.searchsorted(quotes, places) + s[0]) % 2
        found[file, block] = [(s[0] + len(quotes)) % 2, s[1] + int(steps[odd == 0].sum()), s[2] + int(steps[odd == 1].sum())]
    rows = [(*k, *v) for k, v in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.string()] + [pa.int64()] * 4, strict=True)], ["file", "block", "odd", "outside", "inside"])


def _cutter(starts: dict[tuple[str, int], tuple[int, int]]):
    """Pieces of each block; starts: whether a block starts inside a string, and its depth there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def rows(key, n, low, seam, text):
            k = len(text)
            columns = [pa.array([key[0]] * k, pa.string()), pa.array([key[1]] * k, pa.int64()), pa.array(np.arange(n, n + k)), pa.array(low, pa.bool_()), pa.array([seam] * k, pa.int32()), text]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "low", "seam", "text"])

        key, n, low, held, inside, depth = None, 0, False, [], 0, 0
        for file, block, data in _runs(batches):
            if key != (file, block):
                if held:
                    yield rows(key, n, [low], TAIL, pa.array([b"".join(held).decode()]))
                key, n, low, held = (file, block), 0, False, []
                inside, depth = starts[key]
            quotes, places, steps = _structure(data)
            out = (np.searchsorted(quotes, places) + inside) % 2 == 0
            inside = (inside + len(quotes)) % 2
            places, steps = places[out], steps[out]
            depths = depth + np.cumsum(steps)
            depth = int(depths[-1]) if len(depths) else depth
            cuts = np.flatnonzero((steps < 0) & (depths == 2) & (data[places] == ord("}")))
            if not len(cuts):
                held.append(data.tobytes())
                low = low or bool((depths < 2).any())
                continue
            lows = np.minimum.reduceat(depths[: cuts[-1] + 1], np.concatenate([[0], cuts[:-1] + 1])) < 2
            ends = places[cuts] + 1
            first = b"".join([*held, data[: ends[0]].tobytes()]).decode()
            yield rows(key, n, [low or bool(lows[0])], 0 if n else HEAD, pa.array([first]))
            if len(cuts) > 1:
                between = np.ascontiguousarray(data[ends[0] : ends[-1]])
                text = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(between)])
                yield rows(key, n + 1, lows[1:], 0, text)
            n += len(cuts)
            held = [data[ends[-1] :].tobytes()] if ends[-1] < len(data) else []
            low = bool((depths[cuts[-1] + 1 :] < 2).any())
        if held:
            yield rows(key, n, [low], TAIL, pa.array([b"".join(held).decode()]))

    return run


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces that leave depth 2: what belongs to the file's own object, the member that is open at the end (null: none,
    or no object), and what that member has begun with."""
    token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.DOTALL)
    named = re.compile(r'("(?:[^"\\]|\\.)*")\s*:\s*$', re.DOTALL)
    for b in batches:
        rows = []
        for first, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            depth, opened, string, name, closed = 0 if first else 2, None, (0, 0), None, None
            for m in token.finditer(text):
                c = m[0][0]
                if c == '"':
                    string = m.span() if depth == 1 else string
                    continue
                depth += 1 if c in "{[" else -1
                if depth == 2 and c in "{[":
                    opened, name = m.end(), named.fullmatch(text, string[0], m.start()) if c == "{" else None
                elif depth == 1 and c in "}]":
                    opened, name = None, None
                elif depth == 0:
                    closed = m.end()
                    break
            if closed or opened is None:
                rows.append((text[:closed] if closed else text, None, None))
            else:
                rows.append((text[:opened], name and name[1], text[opened:]))
        columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], ["file", "block", "n", "own", "member", "begun"])


def read_parts(spark: SparkSession, path: str, member: str) -> tuple[DataFrame, DataFrame] | None:
    """(own), one JSON text for each file, without the objects that its members hold; and (piece), JSON objects that
    together have what the member of that name holds. A file whose brackets don't match has no rows."""
    text = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    starts, inside, depth, whole, last = {}, 0, 0, {}, None
    for r in sorted(text.mapInArrow(_turns, "file string, block long, odd long, outside long, inside long").collect()):
        if r["file"] != last:
            last, inside, depth = r["file"], 0, 0
        starts[r["file"], r["block"]] = (inside, depth)
        depth += r["inside"] if inside else r["outside"]
        inside ^= r["odd"]
        whole[r["file"]] = not inside and depth in (0, -1)  # white space at the end counts as one that is closed
    good = [f for f, ok in whole.items() if ok]
    pieces = Written(text.where(F.col("file").isin(good)).mapInArrow(_cutter(starts), _PIECES), "pieces")
    order = "PARTITION BY file ORDER BY block, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    seams = pieces.df.where("seam > 0").withColumn("g", F.expr(f"coalesce(count_if(seam = {HEAD}) OVER ({order}), 0)"))
    parts = F.array_sort(F.collect_list(F.struct("block", "n", "text")))
    joined = seams.groupBy("file", "g").agg(F.max(F.struct("block", "n")).alias("at"), F.bool_or("low").alias("low"), F.array_join(parts["text"], "").alias("text"))
    every = pieces.df.where("seam = 0").select("file", "block", "n", "low", F.lit(False).alias("first"), "text").unionByName(joined.select("file", "at.*", "low", (F.col("g") == 0).alias("first"), "text"))
    few = Written(every.where("low").select("file", "block", "n", "first", "text").mapInArrow(_parted, "file string, block long, n long, own string, member string, begun string"), "members")
    marks = few.df.select("file", "block", "n", "member").orderBy("file", "block", "n").collect()
    held = F.lit(False)
    for i, m in enumerate(marks):
        if m["member"] == f'"{member}"':
            place = lambda r: F.struct(F.lit(r["block"]).cast("long").alias("block"), F.lit(r["n"]).cast("long").alias("n"))
            after = (F.col("file") == m["file"]) & (F.struct("block", "n") > place(m))
            end = marks[i + 1] if marks[i + 1 :] and marks[i + 1]["file"] == m["file"] else None
            held = held | (after & (F.struct("block", "n") < place(end)) if end else after)
    texts = every.where(~F.col("low") & held).select("text").unionByName(few.df.where(F.col("member") == f'"{member}"').select(F.col("begun").alias("text")))
    own = few.df.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "n", "own")))["own"], "").alias("own"))
    comma = F.regexp_replace("own", r"(?<=\{)\s*,", "")
    return own.select(comma.alias("own")), texts.select(F.concat(F.lit("{"), F.regexp_replace("text", r"^\s*,", ""), F.lit("}")).alias("piece"))


def members(pieces: Iterable[str]) -> Iterator[tuple[str, str, str, str]]:
    """(member, bracket, key, text) of a JSON object that comes in pieces, cut anywhere: what each of its members holds.

    bracket and key: { and the key, as JSON, in an object; [ and nothing in an array; neither for other values, which come
    whole. Only one of these values has to fit in memory. Whatever isn't one JSON object is an error.
    """
    decode, space, after, source = json.JSONDecoder().raw_decode, re.compile(r"[ \t\r\n]*"), set(",:]} \t\r\n"), iter(pieces)
    held, at, ended = "", 0, False

    def more() -> None:
        nonlocal held, at, ended
        got, n, least = [held[at:]], 0, max(1 << 16, len(held) - at)
        for p in source:
            got.append(p)
            n += len(p)
            if n >= least:
                break
        else:
            ended = True
        held, at = "".join(got), 0

    def look() -> str:
        nonlocal at
        while (c := held[at : at + 1]) <= " ":
            at = space.match(held, at).end()
            if at == len(held):
                if ended:
                    return ""
                more()
            elif held[at] <= " ":  # no white space of JSON
                break
        return c

    def passed(c: str) -> bool:
        nonlocal at
        found = look() == c
        at += found
        return found

    def need(c: str) -> None:
        if not passed(c):
            raise ValueError(f"JSON has {held[at : at + 20]!r} in place of {c}")

    def value() -> str:
        nonlocal at
        look()
        while True:
            try:
                _, end = decode(held, at)
                if held[end : end + 1] in after or ended:  # else a number may go on
                    text, at = held[at:end], end
                    return text
            except json.JSONDecodeError:
                if ended:
                    raise
            more()

    def key() -> str:
        if look() != '"':
            need('"')
        text = value()
        need(":")
        return text

    need("{")
    empty = passed("}")
    while not empty:
        name, bracket = json.loads(key()), look()
        if bracket in ("{", "["):
            need(bracket)
            close = "}" if bracket == "{" else "]"
            if not passed(close):
                yield name, bracket, key() if bracket == "{" else "", value()
                while passed(","):
                    yield name, bracket, key() if bracket == "{" else "", value()
                need(close)
        else:
            yield name, "", "", value()
        if not passed(","):
            need("}")
            break
    if look():
        raise ValueError(f"JSON goes on after its end with {held[at : at + 20]!r}")


def parts(pieces: Iterable[str], size: int = 1 << 13) -> Iterator[str]:
    """JSON objects of some size characters (or one value) that together hold what the members of one object hold."""
    for (name, bracket), rows in groupby(members(pieces), lambda r: r[:2]):
        start, end = f"{{{json.dumps(name)}:{bracket}", {"{": "}}", "[": "]}", "": "}"}[bracket]
        found, n = [], 0
        for *_, key, text in rows:
            found.append(f"{key}:{text}" if bracket == "{" else text)
            n += len(found[-1])
            if n >= size or not bracket:
                yield start + ",".join(found) + end
                found, n = [], 0
        if found:
            yield start + ",".join(found) + end
