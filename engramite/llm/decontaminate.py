"""Benchmark decontamination by an FM-index of every training shard.

A shard is a slice of one partition's texts.  Its words become symbols: each word of the benchmark
has one, and since no phrase can hold another word, stretches without benchmark words shrink to a
separator, and so do stretches too short for a phrase; neither loses an occurrence.  All
benchmark phrases (every n consecutive words of an item; the whole item where it is shorter) are
searched backwards through wavelet-matrix ranks, located by sampled suffix positions, and
overlapping or adjacent occurrences merge to spans of words.

Items of fewer words than ``shortest`` are left out, which by default are none: an item of one word then removes that word
everywhere.  A shard lasts as long as its slice of the table is in hand; nothing of the index is kept.

Cases: null or empty texts and null or wordless items match nothing; a very long text is a shard of its own, searched whole;
equal items count once; repeated rows are searched each on their own; a null id stays null, and one that is no whole
number counts as null; columns with clashing names stay as they are; an empty table gives no rows and an empty benchmark
leaves all documents as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramite.llm import textops
from engramite.llm.common import ROW, ident, packed, spread, string
from engramite.llm.fmindex import FMIndex

PHRASE = 8
#: Phrases searched in one pass over the shards; a larger benchmark takes several passes.
PHRASES_PER_PASS = 1 << 20
#: Bytes of text in one shard.
SHARD_BYTES = 2 << 20


class Phrases:
    """The benchmark's vocabulary (sorted word hashes) and its phrases as rows of vocabulary numbers."""

    def __init__(self, texts: list[str | None], shortest: int = 1) -> None:
        hashes, offs = textops.words(pa.array(texts, pa.string()))
        size = np.diff(offs)
        ok = np.repeat(size >= shortest, size)
        self.vocabulary = np.unique(hashes[ok])
        number = np.searchsorted(self.vocabulary, hashes)
        rows: dict[int, list[np.ndarray]] = {}
        for start, n in zip(offs[:-1], size, strict=True):
            if n >= max(1, shortest):
                width = min(int(n), PHRASE)
                item = number[start : start + n]
                rows.setdefault(width, []).append(np.lib.stride_tricks.sliding_window_view(item, width))
        self.by_length = {n: np.unique(np.concatenate(x), axis=0) for n, x in rows.items()}
        self.least = min(self.by_length, default=0)
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True


def spans(column: pa.Array, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, word after the last) of the merged occurrences, in order."""
    none = np.zeros(0, dtype=np.int64)
    hashes, offs = textops.words(column)
    if not phrases.by_length or not hashes.size:
        return none, none, none
    at = np.flatnonzero(phrases.bitmap[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
    number = np.searchsorted(phrases.vocabulary, hashes[at])
    number[number == phrases.vocabulary.size] = 0
    ok = phrases.vocabulary[number] == hashes[at]
    at, number = at[ok], number[ok]
    row = np.searchsorted(offs, at, "right") - 1
    # runs of consecutive benchmark words of one text
    new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(row) > 0)]) if at.size else np.zeros(0, dtype=bool)
    run = np.cumsum(new) - 1
    keep = np.bincount(run)[run] >= phrases.least if at.size else new
    at, number, row, run = at[keep], number[keep], row[keep], run[keep]
    if not at.size:
        return none, none, none
    used, symbol = np.unique(number, return_inverse=True)
    place = np.arange(at.size) + np.concatenate([[0], np.cumsum(np.diff(run) > 0)])
    seq = np.ones(int(place[-1]) + 2, dtype=np.int64)
    seq[place] = symbol + 2
    word_at = np.zeros(seq.size, dtype=np.int64)
    word_at[place] = at
    index = FMIndex(seq)
    begin, end = [], []
    for length, rows in phrases.by_length.items():
        local = np.searchsorted(used, rows)
        local[local == used.size] = 0
        rows = local[(used[local] == rows).all(axis=1)] + 2
        low, high = index.search(rows)
        hit = np.repeat(low, high - low) + np.arange(int((high - low).sum())) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        first = word_at[index.locate(hit)]
        begin.append(first)
        end.append(first + length)
    begin, end = np.concatenate(begin), np.concatenate(end)
    if not begin.size:
        return none, none, none
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    doc = np.searchsorted(offs, begin, "right") - 1
    head = np.concatenate([[True], (begin[1:] > end[:-1]) | (doc[1:] > doc[:-1])])
    last = np.concatenate([head[1:], [True]])
    doc = doc[head]
    return doc, begin[head] - offs[doc], end[last] - offs[doc]


def cut(text: str, first: np.ndarray, after: np.ndarray) -> str:
    """The text without the bytes from each span's first word to its last."""
    data = text.encode()
    starts, ends = textops.boundaries(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
    out, at = [], 0
    for a, b in zip(first, after, strict=True):
        out.append(data[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, data[at:]]).decode()


def passes(benchmark: DataFrame, shortest: int = 1, text_col: str = "text") -> Iterator[Broadcast]:
    """The benchmark's phrases in broadcast sets of bounded size; the driver holds one set at a time."""
    share = benchmark.sparkSession.sparkContext.broadcast
    texts, n, sets = [], 0, 0
    for item in benchmark.select(string(text_col).alias("text")).where("text is not null").distinct().toLocalIterator():
        texts.append(item.text)
        n += len(item.text) // 4
        if n >= PHRASES_PER_PASS:
            yield share(Phrases(texts, shortest))
            texts, n, sets = [], 0, sets + 1
    if texts or not sets:
        yield share(Phrases(texts, shortest))


def _find(phrases: Phrases, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textops.slices(batches, "text", SHARD_BYTES):
        row, first, after = spans(part.column("text"), phrases)
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), part.column("key").take(pa.array(row)), pa.array(first, pa.int32()), pa.array(after, pa.int32())], names=["doc_id", "key", "first_word", "after_word"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 1) -> DataFrame:
    """(doc_id, first_word, after_word): the removal spans of every document, in words from 0."""
    rows = spread(docs.select(ident(id_col).alias("doc_id"), string(text_col).alias("text")))
    sets = list(passes(benchmark, shortest))
    schema = "doc_id long, key long, first_word int, after_word int"
    if len(sets) == 1:
        return _mapped(rows.withColumn("key", F.lit(0).cast("long")), sets[0], schema).drop("key")
    rows = rows.withColumn("key", F.monotonically_increasing_id())
    found = None
    for phrases in sets:
        one = _mapped(rows, phrases, schema)
        found = one if found is None else found.unionByName(one)
    # islands over the passes
    w = Window.partitionBy("key", "doc_id").orderBy("first_word", "after_word")
    head = found.withColumn("reach", F.max("after_word").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    isle = head.withColumn("isle", F.sum((F.coalesce(F.col("reach"), F.lit(-1)) < F.col("first_word")).cast("int")).over(w))
    return isle.groupBy("key", "doc_id", "isle").agg(F.min("first_word").alias("first_word"), F.max("after_word").alias("after_word")).drop("key", "isle")


def _mapped(rows: DataFrame, shared: Broadcast, schema: str) -> DataFrame:
    return rows.mapInArrow(lambda batches: _find(shared.value, batches), schema)


def _found(part: pa.RecordBatch, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of one pass, merged with those which the rows carry from earlier passes."""
    row, first, after = spans(part.column("text"), phrases)
    size = part.column("first").value_lengths().to_numpy(zero_copy_only=False)
    if not size.any():
        return row, first, after
    row = np.concatenate([np.repeat(np.arange(size.size), size), row])
    first, after = (np.concatenate([part.column(c).flatten().to_numpy(zero_copy_only=False), new]) for c, new in (("first", first), ("after", after)))
    order = np.lexsort((first, row))
    row, first = row[order], first[order]
    # one axis for all rows, so that reach never crosses from one to the next
    begin, reach = (row << 32) + first, np.maximum.accumulate((row << 32) + after[order])
    head = np.concatenate([[True], (begin[1:] > reach[:-1]) | (np.diff(row) > 0)])
    last = np.concatenate([head[1:], [True]])
    return row[head], first[head], reach[last] - (row[last] << 32)


def _mark(phrases: Phrases, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the spans found so far; the texts stay whole for the passes to come."""
    for part in textops.slices(batches, "text", SHARD_BYTES):
        row, first, after = _found(part, phrases)
        offs = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]), pa.int32())
        lists = [pa.ListArray.from_arrays(offs, pa.array(x, pa.int32())) for x in (first, after)]
        yield pa.RecordBatch.from_arrays([part.column(ROW), part.column("text"), *lists], names=[ROW, "text", "first", "after"])


def _clean(phrases: Phrases, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textops.slices(batches, "text", SHARD_BYTES):
        column = part.column("text")
        row, first, after = _found(part, phrases)
        if row.size:
            touched, begin = np.unique(row, return_index=True)
            end = [*begin[1:], row.size]
            new = pa.array([cut(column[int(r)].as_py(), first[a:b], after[a:b]) for r, a, b in zip(touched, begin, end, strict=True)], pa.string())
            mask = np.zeros(part.num_rows, dtype=bool)
            mask[touched] = True
            column = pc.replace_with_mask(column, pa.array(mask), new)
        yield pa.RecordBatch.from_arrays([part.column(ROW), column], names=[ROW, "text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size_col: str | None = "n_chars", shortest: int = 1) -> DataFrame:
    """``docs`` with the spans cut out of the texts and ``size_col`` (if there) set to the new length; all rows stay."""
    none = F.array().cast("array<int>")
    rows = packed(docs.withColumn(text_col, string(text_col)), text=string(text_col), first=none, after=none)
    # the text travels once: the packed row carries it only as a null
    rows = rows.withColumn(ROW, F.col(ROW).withField(f"`{text_col}`", F.lit(None).cast("string")))
    *earlier, last = passes(benchmark, shortest)
    for shared in earlier:
        rows = rows.mapInArrow(lambda batches, shared=shared: _mark(shared.value, batches), rows.schema)
    done = rows.mapInArrow(lambda batches: _clean(last.value, batches), rows.select(ROW, "text").schema)
    row = F.col(ROW).withField(f"`{text_col}`", F.col("text"))
    if size_col in docs.columns:
        row = row.withField(f"`{size_col}`", F.length("text").cast(docs.schema[size_col].dataType))
    return done.select(row.alias(ROW)).select(f"{ROW}.*")
