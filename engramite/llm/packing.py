"""Bounded-space online packing of token sequences into training windows.

Each partition reads its documents once and keeps at most ``OPEN`` open windows.  A document goes to
the open window that it fills best; when it fits in none and all places are taken, the fullest
window is emitted.  A document longer than a window first gives full windows of its own, and its
rest is placed like a short one, so every token is in exactly one window.  What is open when a
partition ends is emitted as a leftover, and leftovers of many partitions are merged best-fit
decreasing in groups of bounded size.

A window carries its tokens: the pieces of text that they cover, which in order of their starts make each document
again, character by character; or with an ``Encoder``, here of a public rank file, the numbers of the tokens, one window long.

Cases: documents without tokens (null, empty or blank texts) take no place; a null id is packed as
a null member; repeated rows are packed as often as they occur; ties for the best fit go to the
window opened first; a very long text fills windows of its own, piece by piece; an id that is no whole number counts as null;
other columns, whatever their names, are ignored; an empty table gives no windows.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.llm import textops
from engramite.llm.common import ident, string, written

WINDOW, OPEN = 4096, 16
#: Partitions whose leftovers are merged together.
MERGED_PARTITIONS = 256

_WINDOW = "window_id string, n_tokens int, doc_ids array<long>, starts array<long>, lengths array<int>, "
_MEMBERS = ["doc_ids", "starts", "lengths"]


class Words:
    """Each word, and each other character but white space, is a token; a token goes with the text up to the next one."""

    column, kind, schema = "texts", pa.list_(pa.string()), "texts array<string>"

    def rows(self, column: pa.Array) -> Iterator[tuple[int, Callable[[int, int], list]]]:
        """The number of tokens of each row, and a function that gives so many of them from one on."""
        data, offs = textops.buffers(column)
        starts, per_row = textops.token_starts(data, offs)
        raw = data.tobytes()
        for k in range(len(offs) - 1):
            a, b = int(per_row[k]), int(per_row[k + 1])

            def cut(start: int, n: int, a: int = a, b: int = b, k: int = k) -> list:
                begin = offs[k] if start == 0 else starts[a + start]
                return [raw[begin : offs[k + 1] if a + start + n == b else starts[a + start + n]].decode()]

            yield b - a, cut


class Encoder:
    """The tokens of a rank file (base64 and rank a line), read at ``vocabulary`` by every worker."""

    column, kind, schema = "tokens", pa.list_(pa.int32()), "tokens array<int>"

    def __init__(self, vocabulary: str, pattern: str) -> None:
        self.vocabulary, self.pattern, self._encoding = vocabulary, pattern, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoding": None}

    @property
    def encoding(self) -> tiktoken.Encoding:
        if self._encoding is None:
            with open(self.vocabulary, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self._encoding = tiktoken.Encoding("packing", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._encoding

    def rows(self, column: pa.Array) -> Iterator[tuple[int, Callable[[int, int], list]]]:
        for text in column:
            ids = self.encoding.encode_ordinary(text.as_py() or "")
            yield len(ids), lambda start, n, ids=ids: ids[start : start + n]


Member = tuple[int | None, int, int, list]


class Packer:
    """The open windows of one partition; ``place`` yields windows as they are emitted."""

    def __init__(self, window: int, most: int) -> None:
        self.window, self.most, self.opened = window, most, 0
        self.free: list[tuple[int, int]] = []  # (free tokens, number), sorted
        self.content: dict[int, list[Member]] = {}

    def place(self, doc: int | None, n: int, cut: Callable[[int, int], list]) -> Iterator[list[Member]]:
        start = 0
        while n - start >= self.window:
            yield [(doc, start, self.window, cut(start, self.window))]
            start += self.window
        need = n - start
        if not need:
            return
        at = bisect_left(self.free, (need, -1))
        if at < len(self.free):
            free, number = self.free.pop(at)
        else:
            if len(self.free) == self.most:
                _, fullest = self.free.pop(0)
                yield self.content.pop(fullest)
            free, number = self.window, self.opened
            self.opened += 1
            self.content[number] = []
        self.content[number].append((doc, start, need, cut(start, need)))
        if free == need:
            yield self.content.pop(number)
        else:
            insort(self.free, (free - need, number))

    def rest(self) -> Iterator[list[Member]]:
        for _, number in self.free:
            yield self.content[number]


def _batch(part: int, rows: list[tuple[bool, str, list[Member]]], tokens: Words | Encoder) -> pa.RecordBatch:
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part] * len(rows), pa.int64()),
            pa.array([r[0] for r in rows], pa.bool_()),
            pa.array([r[1] for r in rows], pa.string()),
            pa.array([sum(x[2] for x in r[2]) for r in rows], pa.int32()),
            *[pa.array([[x[k] for x in r[2]] for r in rows], kind) for k, kind in enumerate((longs, longs, ints))],
            pa.array([[y for x in r[2] for y in x[3]] for r in rows], tokens.kind),
        ],
        names=["part", "leftover", "window_id", "n_tokens", *_MEMBERS, tokens.column],
    )


def _pack(batches: Iterator[pa.RecordBatch], tokens: Words | Encoder, window: int, most: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    part, packer, emitted, rows = context.partitionId() if context else 0, Packer(window, most), 0, []
    for piece in textops.slices(batches, "text"):
        for doc, (n, cut) in zip(piece.column("doc_id").to_pylist(), tokens.rows(piece.column("text")), strict=True):
            for content in packer.place(doc, n, cut):
                rows.append((False, f"{part}-{emitted}", content))
                emitted += 1
                if len(rows) > 100:
                    yield _batch(part, rows, tokens)
                    rows = []
    for content in packer.rest():
        rows.append((True, f"{part}-{emitted}", content))
        emitted += 1
    yield _batch(part, rows, tokens)


def _merge(table: pa.Table, window: int, column: str) -> pa.Table:
    """Best-fit decreasing over the leftovers of one group."""
    left = sorted(table.to_pylist(), key=lambda r: (-r["n_tokens"], r["part"], r["window_id"]))
    free: list[tuple[int, int]] = []
    merged: list[dict] = []
    for row in left:
        at = bisect_left(free, (row["n_tokens"], -1))
        if at < len(free):
            room, number = free.pop(at)
            for c in (*_MEMBERS, column):
                merged[number][c] += row[c]
            merged[number]["n_tokens"] += row["n_tokens"]
        else:
            room, number = window, len(merged)
            merged.append(row)
        insort(free, (room - row["n_tokens"], number))
    return pa.Table.from_pylist(merged, schema=table.schema).select(["window_id", "n_tokens", *_MEMBERS, column])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most: int = OPEN, tokens: Words | Encoder | None = None) -> DataFrame:
    """Windows of at most ``window`` tokens: (window_id, n_tokens, doc_ids, starts, lengths, texts), where the k-th member is
    ``lengths[k]`` tokens of document ``doc_ids[k]`` from its token ``starts[k]`` on, in ``texts[k]``; an ``Encoder`` gives
    ``tokens`` instead, those of all members one after the other."""
    tokens = tokens or Words()
    schema = _WINDOW + tokens.schema
    rows = docs.select(ident(id_col).alias("doc_id"), string(text_col).alias("text"))
    raw = written(rows.mapInArrow(lambda batches: _pack(batches, tokens, window, most), f"part long, leftover boolean, {schema}"))
    left = raw.where("leftover").groupBy((F.col("part") / MERGED_PARTITIONS).cast("long").alias("group"))
    return raw.where("not leftover").drop("part", "leftover").unionByName(left.applyInArrow(lambda t: _merge(t, window, tokens.column), schema))
