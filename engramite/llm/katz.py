"""Language-model scoring by Katz backoff over all documents.

The counts of all n-grams, from one occurrence up, are discounted by Good-Turing (counts above ``K`` aren't), and what a
context has left goes to its backoff weight, which is normalised exactly:

    P(w|h) = d(c(hw)) c(hw) / (c(h) + 1)     if hw occurs
           = a(h) P(w|h')                    otherwise, h' being h without its first word
    a(h)   = (1 - sum of P(w|h) over the w that follow h) / (1 - sum of P(w|h') over the same w)
    P(w)   = d(c(w)) c(w) / (tokens + 1); what the words leave of 1 is the probability of the unknown word

A context that nothing follows has weight 1.  The 1 in the denominators leaves every context some mass even if all its
n-grams are frequent.  A document's first word has no context and its second has one word; nothing crosses documents.

Documents become *blocks* of about ``BLOCK_TOKENS`` tokens, written once as local vocabularies and packed token numbers.
N-grams travel as sorted hashes of ``KEY_BITS`` bits in long packed runs, never as rows of their own, through a radix
exchange of two levels: C * C buckets share the key space, C of them are a part.  A block sends one run to each part, to
the *relay* of its group of about C blocks; a relay adds its group's runs up and sends one run to each bucket of its part;
a bucket makes the totals.  So B blocks make about B * C runs on either level, C being the root of the number of buckets,
and a run stays hundreds of keys long at any size of the corpus; a frequent word costs its bucket one number for each
group.  Totals go back the same way.  ``SPANS`` stretches of the key space follow one another, to halve what is on disk.
One block owns each n-gram and tells its context what it weighs, by the same exchange.

A weight is kept as its two exact sums, of d(c) c over the n-grams hw and over the h'w: all P(w|h') after one h share the
denominator c(h') + 1, so that a(h) = (1 - high / (c(h) + 1)) / (1 - low / (c(h') + 1)).  The sums have few distinct values
and so take a byte or two, where a weight would take eight.

The model is two tables, ``counts`` and ``backoff``, partitioned by order and part of the key space, and its ``meta``.
``score`` evaluates any documents by the tables: it asks for their n-grams and contexts by the same exchange and applies
the recursion to each token.  ``scored`` trains on documents and scores these by the totals that came back to them.

Cases: a null, empty or wordless text has no tokens, log-probability 0 and no perplexity; a very long text is in one block,
whole; repeated rows are scored each and counted each; null ids are kept, and an id that is no whole number counts as null;
other columns, whatever their names, are ignored; an empty table gives no rows, and by its model nothing is known.
Good-Turing ratios that aren't between 0 and 1, as in tiny corpora, give way to a discount of half a count.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramite.llm import textops
from engramite.llm.common import ident, removed, shared_dir, spread, stored, string, written

ORDER, K = 3, 5
KEY_BITS = 56
BLOCK_TOKENS = 1 << 19
#: Keys that a bucket receives, about.
BUCKET_KEYS = 1 << 20
#: Stretches of the key space that are exchanged one after the other: of trigrams, of contexts.
SPANS, CONTEXT_SPANS = 2, 3
#: Portions of the blocks that are joined with their totals one after the other.
PORTIONS = 3

_BLOCK = "block long, docs array<long>, sizes binary, vocabulary binary, tokens binary, grams array<long>"
_PRICED = f"{_BLOCK}, totals array<binary>, own array<binary>"
_SCORES = "doc_id long, n_tokens long, logprob double"
_RUN = "dest long, src long, n int, up boolean, keys binary, a binary, b binary, c binary, stats array<long>"
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
_NAMES = [x.split()[0] for x in _RUN.split(", ")]
#: What isn't addressed to anybody.
_STATS, _MODEL, _SCORED = -1, -2, -3


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    values = values.astype(np.uint64)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys.astype(np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_bits(mask: np.ndarray) -> bytes:
    return len(mask).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.packbits(mask).tobytes())


def unpack_bits(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data[8:])
    return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=int.from_bytes(data[:8], "little")).astype(bool)


def pack_floats(values: np.ndarray) -> bytes:
    """Floats of which many are equal: the distinct ones and numbers of them."""
    known, number = np.unique(values, return_inverse=True)
    return known.size.to_bytes(8, "little") + known.tobytes() + pack(number)


def unpack_floats(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(data, dtype=np.float64, count=size, offset=8)[unpack(data[8 + 8 * size :]).astype(np.int64)]


def _joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *parts])


@dataclass(frozen=True)
class Net:
    """The addresses of the exchange: ``coarse`` parts of as many buckets, and groups of blocks."""

    coarse: int
    groups: int

    @staticmethod
    def of(coarse: int, blocks: int) -> Net:
        return Net(coarse, max(1, math.ceil(blocks / coarse)))

    def relay(self, block: int, part: int) -> int:
        return int(textops.mix64(np.array([block]))[0]) % self.groups * self.coarse + part

    @staticmethod
    def cut(keys: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
        """(part, from, to) of the equal parts of the key space that some of the sorted keys falls in."""
        if not keys.size:
            return []
        part = ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(parts)) >> np.uint64(32)
        head = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        return list(zip(part[head].tolist(), head.tolist(), [*head[1:].tolist(), keys.size], strict=True))


def _span(keys: np.ndarray, span: tuple[int, int]) -> slice:
    """Those of the sorted keys that lie in the k-th of m equal stretches."""
    k, m = span
    ends = np.array([(k << KEY_BITS) // m, ((k + 1) << KEY_BITS) // m], dtype=np.uint64)
    return slice(*np.searchsorted(keys, ends).tolist())


def _runs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], names=_NAMES)


def _by_order(table: pa.Table, order: tuple[str, ...] = ("n", "src")) -> Iterator[tuple[int, list[dict]]]:
    rows = sorted(table.to_pylist(), key=lambda r: tuple(r[c] for c in order))
    for n, own in groupby(rows, key=lambda r: r["n"]):
        yield n, list(own)


class Block:
    """The n-grams of one block: of each token its hash, and of each order the sorted distinct ones."""

    def __init__(self, row: dict) -> None:
        self.number, self.docs = row["block"], row["docs"]
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        offs = np.concatenate([[0], np.cumsum(self.sizes)])
        self.doc = np.repeat(np.arange(self.sizes.size), self.sizes)
        self.place = np.arange(self.doc.size) - offs[self.doc]
        self.vocabulary, self.tokens = unpack(row["vocabulary"]), unpack(row["tokens"]).astype(np.int64)
        key = self.vocabulary[self.tokens]
        self.key = {1: key}
        for n in range(2, ORDER + 1):
            # from the hash of the n-1 words before and the word: chained, so that a context's hash is one of order n-1
            before = np.concatenate([np.zeros(1, dtype=np.uint64), self.key[n - 1][:-1]])[: key.size]
            self.key[n] = textops.mix64(before * np.uint64(0x9E3779B97F4A7C15) + key * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n)) >> np.uint64(64 - KEY_BITS)

    def counted(self, n: int, span: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams in a stretch of the key space and how often they occur here."""
        key = self.key[n][self.place >= n - 1]
        k, m = span
        if m > 1:
            key = key[(key >= np.uint64((k << KEY_BITS) // m)) & (key < np.uint64(((k + 1) << KEY_BITS) // m))]
        return np.unique(key, return_counts=True)

    def rank(self) -> None:
        """For each order the distinct n-grams (``keys``), each token's among them (``type``) and one token of each but words (``at``)."""
        order = np.argsort(self.vocabulary)
        place = np.empty(order.size, dtype=np.int32)
        place[order] = np.arange(order.size)
        self.keys, self.type, self.at = {1: self.vocabulary[order]}, {1: place[self.tokens]}, {}
        for n in range(2, ORDER + 1):
            here = np.flatnonzero(self.place >= n - 1)
            key = self.key[n][here]
            order = np.argsort(key)
            key = key[order]
            new = np.concatenate([np.ones(min(1, key.size), dtype=bool), key[1:] != key[:-1]])
            self.type[n] = np.full(self.doc.size, -1, dtype=np.int32)
            self.type[n][here[order]] = np.cumsum(new) - 1
            self.keys[n], self.at[n] = key[new], here[order[new]]

    def told(self, rows: list[dict], *columns: tuple[str, Callable[[bytes], np.ndarray], type]) -> list[dict]:
        """For each order what came back for ``keys``: the totals, and the values of other columns."""
        rows = sorted(rows, key=lambda r: r["src"])
        return [{n: _joined([unpacker(r[c]).astype(kind) for r in rows if r["n"] == n], kind) for n in range(1, ORDER + 1)} for c, unpacker, kind in (("a", unpack, np.int64), *columns)]

    def probabilities(self, total: dict, model: Discounts) -> dict:
        """The discounted probability of each n-gram after its context; 0 for those that the model doesn't have."""
        out = {1: np.where(total[1] > 0, model.discounted(1, total[1]) / (model.tokens + 1), model.unknown)}
        for n in range(2, ORDER + 1):
            context = total[n - 1][self.type[n - 1][self.at[n] - 1]] if total[n].size else total[n]
            out[n] = model.discounted(n, total[n]) / (context + 1)
        return out


class Discounts:
    """Good-Turing discounts from the counts of counts of each order."""

    def __init__(self, counts: dict[int, list[int]], tokens: int) -> None:
        self.tokens = tokens
        self.table = {}
        for n, r in counts.items():
            # r[k] n-grams were seen k times, for k from 1 to K + 1
            d = np.ones(K + 2)
            common = (K + 1) * r[K + 1] / r[1] if r[1] else 1.0
            for k in range(1, K + 1):
                ratio = ((k + 1) * r[k + 1] / (k * r[k]) - common) / (1 - common) if r[k] and common < 1 else -1.0
                d[k] = ratio if 0 < ratio < 1 else (k - 0.5) / k
            self.table[n] = d
        lost = math.fsum((1 - self.table[1][k]) * k * counts[1][k] for k in range(1, K + 1))
        #: What all words of the model leave to the unknown one.
        self.unknown = (1 + lost) / (tokens + 1)

    def discounted(self, n: int, count: np.ndarray) -> np.ndarray:
        return self.table[n][np.minimum(count, K + 1)] * count


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    docs: list = []
    hashes: list[np.ndarray] = []
    sizes: list[np.ndarray] = []

    def block() -> pa.RecordBatch:
        words = np.concatenate(hashes) >> np.uint64(64 - KEY_BITS)
        values, inverse, count = np.unique(words, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(order.size)
        size_of = np.concatenate(sizes)
        grams = [int(np.maximum(size_of - n + 1, 0).sum()) for n in range(1, ORDER + 1)]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        row = [number, docs, pack(size_of), pack(values[order]), pack(rank[inverse]), grams]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["block", "docs", "sizes", "vocabulary", "tokens", "grams"])

    held = 0
    for part in textops.slices(batches, "text"):
        found, offs = textops.words(part.column("text"))
        if held and held + found.size > size:
            yield block()
            number, docs, hashes, sizes, held = number + 1, [], [], [], 0
        docs += part.column("doc_id").to_pylist()
        hashes.append(found)
        sizes.append(np.diff(offs))
        held += found.size
    if docs:
        yield block()


def _send(batches: Iterator[pa.RecordBatch], net: Net, orders: list[int], span: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """A block's n-grams of some orders in a stretch of the key space, to its group's relays."""
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row)
            for n in orders:
                keys, count = block.counted(n, span)
                yield _runs([(net.relay(block.number, c), block.number, n, True, pack_sorted(keys[x:y]), pack(count[x:y]), None, None, None) for c, x, y in net.cut(keys, net.coarse)])


def _merged(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys of runs, and the place of each run's keys among them."""
    sent = [unpack_sorted(r["keys"]) for r in rows]
    keys = np.sort(np.concatenate(sent))
    keys = keys[np.concatenate([np.ones(min(1, keys.size), dtype=bool), keys[1:] != keys[:-1]])]
    return keys, [np.searchsorted(keys, s) for s in sent]


def _sums(rows: list[dict], places: list[np.ndarray], size: int, column: str, unpacker: Callable[[bytes], np.ndarray]) -> np.ndarray:
    return np.bincount(np.concatenate(places), weights=np.concatenate([unpacker(r[column]) for r in rows]), minlength=size)


def _first(places: list[np.ndarray], size: int) -> np.ndarray:
    """Of each key the number of the first run that has it."""
    first = np.zeros(size, dtype=np.int64)
    for k in range(len(places) - 1, -1, -1):
        first[places[k]] = k
    return first


def _relay(table: pa.Table, net: Net) -> pa.Table:
    """A group's counts of one part of the key space, to its buckets; where each block's n-grams are among them stays here."""
    out = []
    for n, rows in _by_order(table):
        keys, places = _merged(rows)
        total = _sums(rows, places, keys.size, "a", unpack).astype(np.int64)
        here = rows[0]["dest"]
        out += [(f, here, n, True, pack_sorted(keys[x:y]), pack(total[x:y]), None, None, None) for f, x, y in net.cut(keys, net.coarse**2)]
        out += [(here, r["src"], n, False, None, pack_sorted(p), None, None, None) for r, p in zip(rows, places, strict=True)]
    return pa.Table.from_batches([_runs(out)])


def _total(table: pa.Table) -> pa.Table:
    """A bucket's part of the model, its counts of counts, and its answers, which say who owns an n-gram."""
    out = []
    for n, rows in _by_order(table):
        keys, places = _merged(rows)
        total = _sums(rows, places, keys.size, "a", unpack).astype(np.int64)
        first = _first(places, keys.size)
        here = rows[0]["dest"]
        out.append((_STATS, here, n, False, None, None, None, None, np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2].tolist()))
        out.append((_MODEL, here, n, False, pack_sorted(keys), pack(total), None, None, None))
        out += [(r["src"], here, n, False, None, pack(total[p]), pack_bits(first[p] == k), None, None) for k, (r, p) in enumerate(zip(rows, places, strict=True))]
    return pa.Table.from_batches([_runs(out)])


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    """What the model's tables have for the n-grams that relays ask for: totals, and the sums that make backoff weights."""
    out = []
    tables: dict = {}
    for r in sorted(right.to_pylist(), key=lambda r: r["span"]):
        tables.setdefault((r["n"], r["name"]), []).append(r)

    def found(n: int, name: str, column: str, keys: np.ndarray, unpacker: Callable[[bytes], np.ndarray]) -> np.ndarray:
        rows = tables.get((n, name), [])
        have, values = _joined([unpack_sorted(r["keys"]) for r in rows], np.uint64), _joined([unpacker(r[column]) for r in rows], float)
        if not have.size:
            return np.zeros(keys.size)
        place = np.searchsorted(have, keys)
        place[place == have.size] = 0
        return np.where(have[place] == keys, values[place], 0.0)

    for n, rows in _by_order(left):
        for r in rows:
            keys = unpack_sorted(r["keys"])
            high, low = (pack_floats(found(n, "backoff", c, keys, unpack_floats)) for c in ("a", "b"))
            out.append((r["src"], r["dest"], n, False, None, pack(found(n, "counts", "a", keys, unpack)), high, low, None))
    return pa.Table.from_batches([_runs(out)])


def _down(left: pa.Table, right: pa.Table, net: Net, span: tuple[int, int], owned: bool) -> pa.Table:
    """A relay's answers to the blocks of its group."""
    out = []
    answers = dict(_by_order(right))
    part = span[0] * net.coarse
    for n, rows in _by_order(left):
        total = np.concatenate([unpack(r["a"]) for r in answers[n]])
        places = [unpack_sorted(r["a"]).astype(np.int64) for r in rows]
        if owned:
            own, first = np.concatenate([unpack_bits(r["b"]) for r in answers[n]]), _first(places, total.size)
            more = [(pack_bits(own[p] & (first[p] == k)), None) for k, p in enumerate(places)]
        else:
            sums = [np.concatenate([unpack_floats(r[c]) for r in answers[n]]) for c in ("b", "c")]
            more = [tuple(pack_floats(x[p]) for x in sums) for p in places]
        out += [(r["src"], part + r["dest"] % net.coarse, n, False, None, pack(total[p]), *extra, None) for r, p, extra in zip(rows, places, more, strict=True)]
    return pa.Table.from_batches([_runs(out)])


def _price(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block with the totals of its n-grams and which of them it owns, in order."""
    rows, replies = left.to_pylist(), sorted(right.to_pylist(), key=lambda r: r["src"])
    of = lambda n, c, unpacker, kind: _joined([unpacker(r[c]) for r in replies if r["n"] == n], kind)
    totals = [pack(of(n, "a", unpack, np.uint64)) for n in range(1, ORDER + 1)]
    own = [pack_bits(of(n, "b", unpack_bits, bool)) for n in range(1, ORDER + 1)]
    return pa.Table.from_pylist([r | {"totals": totals, "own": own} for r in rows], schema=left.schema.append(pa.field("totals", pa.list_(pa.binary()))).append(pa.field("own", pa.list_(pa.binary()))))


def _totals(row: dict) -> dict:
    return {n: unpack(x).astype(np.int64) for n, x in enumerate(row["totals"], 1)}


def _send_contexts(batches: Iterator[pa.RecordBatch], net: Net, model: Discounts) -> Iterator[pa.RecordBatch]:
    """What the n-grams that a block owns weigh together after each context, and by the next lower order; and the block's scores.

    The model's own documents never back off, so that the discounts are all that their scores need.
    """
    for row in (row for batch in batches for row in batch.to_pylist()):
        block, out, spans = Block(row), [], []
        block.rank()
        total, own = _totals(row), {n: unpack_bits(x) for n, x in enumerate(row["own"], 1)}
        for n in range(2, ORDER + 1):
            mine = np.flatnonzero(own[n])
            at = block.at[n][mine]
            context, size = block.type[n - 1][at - 1], block.keys[n - 1].size
            high = np.bincount(context, weights=model.discounted(n, total[n][mine]), minlength=size)
            low = np.bincount(context, weights=model.discounted(n - 1, total[n - 1][block.type[n - 1][at]]), minlength=size)
            has = np.flatnonzero(high > 0)
            keys, high, low = block.keys[n - 1][has], high[has], low[has]
            for k in range(CONTEXT_SPANS):
                inside = _span(keys, (k, CONTEXT_SPANS))
                cuts = net.cut(keys[inside], net.coarse)
                out += [(net.relay(block.number, c), block.number, n - 1, True, pack_sorted(keys[x:y]), pack_floats(high[x:y]), pack_floats(low[x:y]), None, None) for c, x, y in ((c, x + inside.start, y + inside.start) for c, x, y in cuts)]
                spans += [k] * len(cuts)
        out.append((_SCORED, block.number, 0, False, None, pack(block.sizes), _logprobs(block, model, total, []).tobytes(), None, block.docs))
        yield _runs(out).append_column("span", pa.array([*spans, _SCORED], pa.int32()))


def _add_contexts(table: pa.Table, net: Net, last: bool) -> pa.Table:
    """The sums of contexts, added up by a relay or, at last, by a bucket."""
    out = []
    for n, rows in _by_order(table):
        keys, places = _merged(rows)
        high, low = (_sums(rows, places, keys.size, c, unpack_floats) for c in ("a", "b"))
        here = rows[0]["dest"]
        to = [(_MODEL, 0, keys.size)] if last else net.cut(keys, net.coarse**2)
        out += [(f, here, n, True, pack_sorted(keys[x:y]), pack_floats(high[x:y]), pack_floats(low[x:y]), None, None) for f, x, y in to]
    return pa.Table.from_batches([_runs(out)])


def _logprobs(block: Block, model: Discounts, total: dict, weights: list[dict]) -> np.ndarray:
    """The recursion for each token of a block; without weights nothing may back off."""
    p = block.probabilities(total, model)
    score = np.log(p[1][block.type[1]])
    for n in range(2, ORDER + 1):
        here = np.flatnonzero(block.place >= n - 1)
        direct = p[n][block.type[n][here]]
        backed = score[here]
        if weights:
            context = block.type[n - 1][here - 1]
            shorter = model.tokens if n == 2 else total[n - 2][block.type[n - 2][here - 1]]
            high, low = (w[n - 1][context] for w in weights)
            backed = backed + np.log1p(-high / (total[n - 1][context] + 1)) - np.log1p(-low / (shorter + 1))
        with np.errstate(divide="ignore"):
            score[here] = np.where(direct > 0, np.log(direct), backed)
    return np.bincount(block.doc, weights=score, minlength=block.sizes.size)


def _results(block: Block, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block.docs, pa.int64()), pa.array(block.sizes, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "logprob"])


def _own_results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scores that came with the contexts, by document."""
    for row in (row for batch in batches for row in batch.to_pylist()):
        yield pa.RecordBatch.from_arrays([pa.array(row["stats"], pa.int64()), pa.array(unpack(row["a"]).astype(np.int64)), pa.array(np.frombuffer(row["b"]))], names=["doc_id", "n_tokens", "logprob"])


def _evaluate(left: pa.Table, right: pa.Table, model: Discounts) -> pa.Table:
    out = []
    for row in left.to_pylist():
        block = Block(row)
        block.rank()
        total, *weights = block.told(right.to_pylist(), ("b", unpack_floats, float), ("c", unpack_floats, float))
        out.append(_results(block, _logprobs(block, model, total, weights)))
    return pa.Table.from_batches(out)


def _bound(function: Callable, *more: object) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of two tables, which is what a cogroup takes."""
    return lambda left, right: function(left, right, *more)


def _cogrouped(left: DataFrame, by: str, right: DataFrame, to: str, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return left.groupBy(by).cogroup(right.groupBy(to)).applyInArrow(function, schema)


def _blocked(docs: DataFrame, id_col: str, text_col: str, folder: str, block_tokens: int) -> tuple[DataFrame, int, int]:
    """The blocks, and how many blocks and tokens there are."""
    rows = spread(docs.select(ident(id_col).alias("doc_id"), string(text_col).alias("text")))
    made = rows.mapInArrow(lambda batches: _blocks(batches, block_tokens), _BLOCK).withColumn("portion", F.pmod(F.xxhash64("block"), F.lit(PORTIONS)).cast("int"))
    stored(made.write.mode("overwrite").partitionBy("portion"), docs.sparkSession, folder)
    blocks = docs.sparkSession.read.schema(made.schema).parquet(folder)
    n, tokens = blocks.agg(F.count("*"), F.coalesce(F.sum(F.col("grams")[0]), F.lit(0))).first()
    return blocks, n, tokens


def _relayed(blocks: DataFrame, net: Net, orders: list[int], span: tuple[int, int], folder: str) -> DataFrame:
    sent = blocks.mapInArrow(lambda batches: _send(batches, net, orders, span), _RUN)
    return written(sent.groupBy("dest").applyInArrow(lambda t: _relay(t, net), _RUN), folder)


def _stored(rows: DataFrame, folder: str, net: Net, span: int) -> None:
    """Adds a bucket's runs to a table of the model; the write's own shuffles are dropped with it."""
    rows = rows.select(F.lit(span).alias("span"), F.col("src").alias("bucket"), "keys", "a", "b", "n", F.floor(F.col("src") / net.coarse).alias("part"))
    stored(rows.write.partitionBy("n", "part").mode("append"), rows.sparkSession, folder)


def _train(blocks: DataFrame, n_blocks: int, tokens: int, base: str, model_dir: str, bucket_keys: int) -> DataFrame:
    """Writes the model and gives the scores of its own blocks."""
    net = Net.of(max(1, math.ceil(math.sqrt(1.6 * tokens / bucket_keys))), n_blocks)
    counts = {n: [0] * (K + 2) for n in range(1, ORDER + 1)}
    told = None
    for name, (orders, span) in enumerate([([1, 2], (0, 1)), *(([3], (k, SPANS)) for k in range(SPANS))]):
        up = _relayed(blocks, net, orders, span, f"{base}/up-{name}")
        totals = written(up.where("up").groupBy("dest").applyInArrow(_total, _RUN), f"{base}/totals-{name}")
        for r in totals.where(F.col("dest") == _STATS).select("n", F.posexplode("stats")).groupBy("n", "pos").agg(F.sum("col").alias("v")).collect():
            counts[r.n][r.pos] += r.v
        _stored(totals.where(F.col("dest") == _MODEL), f"{model_dir}/counts", net, name)
        own = _cogrouped(up.where("NOT up"), "dest", totals.where("dest >= 0"), "dest", _bound(_down, net, span, True), _RUN)
        own = written(own, f"{base}/told-{name}")
        told = own if told is None else told.unionByName(own)
        removed(blocks.sparkSession, f"{base}/up-{name}", f"{base}/totals-{name}")
    spark = blocks.sparkSession
    priced = []
    for k in range(PORTIONS):
        # each portion takes the place of its blocks before the next one is made
        mine = blocks.where(F.col("portion") == k).drop("portion")
        priced.append(written(_cogrouped(mine, "block", told.where(F.pmod(F.xxhash64("dest"), F.lit(PORTIONS)) == k), "dest", _price, _PRICED), f"{base}/priced-{k}"))
        removed(spark, f"{base}/blocks/portion={k}")
    removed(spark, f"{base}/blocks", *[f"{base}/told-{k}" for k in range(SPANS + 1)])
    model = Discounts(counts, tokens)
    for k, part in enumerate(priced):
        # a block is taken apart once, for the contexts of all spans and its scores
        sent = part.mapInArrow(lambda batches: _send_contexts(batches, net, model), f"{_RUN}, span int")
        stored(sent.write.partitionBy("span").mode("append"), spark, f"{base}/contexts")
        removed(spark, f"{base}/priced-{k}")
    contexts = spark.read.schema(f"{_RUN}, span int").parquet(f"{base}/contexts")
    done = written(contexts.where(F.col("span") == _SCORED).mapInArrow(_own_results, _SCORES), f"{base}/scores")
    for k in range(CONTEXT_SPANS):
        sent = contexts.where(F.col("span") == k).drop("span")
        summed = sent.groupBy("dest").applyInArrow(lambda t: _add_contexts(t, net, False), _RUN).groupBy("dest").applyInArrow(lambda t: _add_contexts(t, net, True), _RUN)
        _stored(summed, f"{model_dir}/backoff", net, k)
        removed(spark, f"{base}/contexts/span={k}")
    removed(spark, f"{base}/contexts")
    spark.createDataFrame([(json.dumps({"coarse": net.coarse, "tokens": tokens, "counts": counts}),)], "meta string").coalesce(1).write.parquet(f"{model_dir}/meta")
    return done


def _scores(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_tokens", F.round("logprob", 4).alias("logprob"), F.when(F.col("n_tokens") > 0, F.round(F.exp(-F.col("logprob") / F.col("n_tokens")), 4)).alias("perplexity"))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_dir: str | None = None, block_tokens: int = BLOCK_TOKENS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """(doc_id, n_tokens, logprob, perplexity) of every row by the model of all rows, which ``model_dir`` keeps for ``score``."""
    spark = docs.sparkSession
    base = shared_dir(spark)
    blocks, n_blocks, tokens = _blocked(docs, id_col, text_col, f"{base}/blocks", block_tokens)
    return _scores(_train(blocks, n_blocks, tokens, base, model_dir or f"{base}/model", bucket_keys))


def load(spark: SparkSession, model_dir: str) -> tuple[Discounts, int, DataFrame]:
    """The discounts of a stored model, its number of parts, and the rows of both tables."""
    meta = json.loads(spark.read.parquet(f"{model_dir}/meta").first().meta)
    both = [spark.read.schema("span int, bucket long, keys binary, a binary, b binary, n int, part long").parquet(f"{model_dir}/{name}").withColumn("name", F.lit(name)) for name in ("counts", "backoff")]
    return Discounts({int(n): c for n, c in meta["counts"].items()}, meta["tokens"]), meta["coarse"], both[0].unionByName(both[1])


def score(docs: DataFrame, model_dir: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, logprob, perplexity) of any documents by a stored model."""
    spark = docs.sparkSession
    base = shared_dir(spark)
    model, coarse, tables = load(spark, model_dir)
    blocks, n_blocks, _ = _blocked(docs, id_col, text_col, f"{base}/blocks", block_tokens)
    net, whole = Net.of(coarse, n_blocks), (0, 1)
    up = _relayed(blocks, net, [1, 2, 3], whole, f"{base}/up")
    asked = up.where("up")
    # buckets that nothing asks for needn't travel
    tables = tables.join(asked.select(F.col("dest").alias("bucket")).distinct(), "bucket", "left_semi")
    answers = _cogrouped(asked, "dest", tables, "bucket", _answer, _RUN)
    told = written(_cogrouped(up.where("NOT up"), "dest", answers, "dest", _bound(_down, net, whole, False), _RUN), f"{base}/told")
    done = written(_cogrouped(blocks, "block", told, "dest", _bound(_evaluate, model), _SCORES), f"{base}/scores")
    removed(spark, f"{base}/blocks", f"{base}/up", f"{base}/told")
    return _scores(done)


_WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')"
#: DuckDB's form; the counts of counts give the discounts, and no n-gram of these documents backs off.
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, CAST([] AS VARCHAR[])) AS w FROM documents),
t AS (SELECT r, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1] END AS w2, CASE WHEN i > 2 THEN w[i - 2] END AS w3 FROM d, unnest(generate_series(1, len(w))) AS s(i)),
g AS (SELECT 1 AS n, CAST(NULL AS VARCHAR) AS x, CAST(NULL AS VARCHAR) AS y, w1 AS z, count(*) AS c FROM t GROUP BY w1
 UNION ALL SELECT 2, NULL, w2, w1, count(*) FROM t WHERE i > 1 GROUP BY w2, w1
 UNION ALL SELECT 3, w3, w2, w1, count(*) FROM t WHERE i > 2 GROUP BY w3, w2, w1),
k AS (SELECT n, CAST(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS r1, [{", ".join(f"CAST(sum(CASE WHEN c = {k} THEN 1 ELSE 0 END) AS DOUBLE)" for k in range(1, K + 2))}] AS rs FROM g GROUP BY n),
q AS (SELECT n, k, CASE WHEN rs[k] > 0 AND r1 > 0 AND {K + 1} * rs[{K + 1}] / r1 < 1 THEN ((k + 1) * rs[k + 1] / (k * rs[k]) - {K + 1} * rs[{K + 1}] / r1) / (1 - {K + 1} * rs[{K + 1}] / r1) END AS ratio FROM k, unnest(generate_series(1, {K})) AS s(k)),
c AS (SELECT n, k, CASE WHEN ratio > 0 AND ratio < 1 THEN ratio ELSE (k - 0.5e0) / k END AS d FROM q),
p AS (SELECT g.n, g.x, g.y, g.z, coalesce(c.d, 1.0e0) * g.c / (coalesce(h.c, (SELECT count(*) FROM t)) + 1.0e0) AS p FROM g LEFT JOIN c ON c.n = g.n AND c.k = g.c
 LEFT JOIN g h ON h.n = g.n - 1 AND h.z = g.y AND h.y IS NOT DISTINCT FROM g.x),
o AS (SELECT r, sum(ln(p)) AS s FROM t JOIN p ON p.n = least(i, 3) AND p.z = w1 AND p.y IS NOT DISTINCT FROM w2 AND p.x IS NOT DISTINCT FROM w3 GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, round(coalesce(s, 0.0e0), 4) AS logprob, CASE WHEN len(w) > 0 THEN round(exp(-s / len(w)), 4) END AS perplexity FROM d LEFT JOIN o USING (r)"""
