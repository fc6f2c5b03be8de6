"""Near-duplicate search: one-permutation MinHash with optimal densification, banded buckets, star edges.

Every document is hashed into 128 bins by one permutation of its word 3-grams; an empty bin borrows
from a bin chosen by a universal hash of (bin, attempt), as in Shrivastava's optimal densification.
32 bands of 4 bins make the buckets.  A bucket of n documents gives n-1 candidate edges, in a star of
stars: each task links what it holds of a bucket to its smallest key, and only these smallest keys
meet, so that a bucket of a third of all rows is a few rows for each task.  An edge stays if the
two signatures (8 bits of every bin) agree enough.  Connected components of what stays are the groups
of copies; every step of theirs is an aggregation that combines in the tasks, and a join that can be split.

Cases: a null text is never a copy of anything; texts without words are copies of each other only
if equal; a text of fewer than three words has one shingle, all its words; a very long text is hashed whole;
repeated rows, or rows that share a document id but differ in text, are separate members of a group; null ids may be
members, sort after others and so represent only groups without any id; an id that is no whole number counts as null;
ties for the smallest id go to the smaller key; other columns, whatever their names, stay as they are; an empty table has no groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramite.llm import textops
from engramite.llm.common import checkpointed, ident, is_small, packed, spread, string, unpacked, written

BINS, BANDS, SHINGLE = 128, 32, 3
#: Least estimated Jaccard similarity of an accepted edge; pairs from about 0.6 up are found nearly always.
THRESHOLD = 0.5
_EMPTY = np.uint64(1 << 40)
#: Pairs of bucket and key, or edges, that a task combines at a time.
COMBINED = 1 << 20


def _densify(sig: np.ndarray) -> np.ndarray:
    """Fills empty bins of rows that have at least one full bin."""
    full = sig != _EMPTY
    out = sig.copy()
    row, bin_ = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while row.size:
        attempt += 1
        donor = (textops.mix64(bin_.astype(np.uint64) * np.uint64(0x9E37) + np.uint64(attempt * 0x51ED27F)) >> np.uint64(40)) % np.uint64(BINS)
        ok = full[row, donor.astype(np.int64)]
        out[row[ok], bin_[ok]] = sig[row[ok], donor[ok].astype(np.int64)]
        row, bin_ = row[~ok], bin_[~ok]
    return out


def signatures(column: pa.Array) -> np.ndarray:
    """One row of BINS minima for each text; rows without words hold a hash of the text itself in every bin."""
    hashes, offs = textops.words(column)
    grams, goffs = textops.ngrams(hashes, offs, SHINGLE)
    n = len(goffs) - 1
    row = np.repeat(np.arange(n), np.diff(goffs))
    sig = np.full(n * BINS, _EMPTY, dtype=np.uint64)
    np.minimum.at(sig, row * BINS + (grams >> np.uint64(57)).astype(np.int64), (grams >> np.uint64(20)) & np.uint64(0xFFFFFFFF))
    sig = sig.reshape(n, BINS)
    bare = np.flatnonzero(np.diff(goffs) == 0)
    for i in bare:
        text = (column[int(i)].as_py() or "").encode()
        seed = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little")
        sig[i] = textops.mix64(np.arange(BINS, dtype=np.uint64) + np.uint64(seed)) & np.uint64(0xFFFFFFFF)
    return _densify(sig)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each signature; a key belongs to one band."""
    width = BINS // BANDS
    key = np.broadcast_to(textops.mix64(np.arange(BANDS, dtype=np.uint64)), (len(sig), BANDS)).copy()
    for k in range(width):
        key = textops.mix64(key + sig[:, k::width][:, :BANDS])
    return key.astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textops.slices(batches, "text", 1 << 20):
        sig = signatures(part.column("text"))
        n = len(sig)
        small = np.ascontiguousarray((sig & np.uint64(255)).astype(np.uint8))
        keys = band_keys(sig).reshape(-1)
        yield pa.RecordBatch.from_arrays(
            [
                part.column("key"),
                part.column("doc"),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * BINS, BINS, dtype=np.int32).tobytes()), pa.py_buffer(small.tobytes())]),
                pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys)),
            ],
            names=["key", "doc", "sig", "bands"],
        )


def row_key(id_col: Column, text_col: Column) -> Column:
    """What tells rows apart: repeated rows share it, rows with equal ids and other texts don't."""
    return F.xxhash64(id_col, text_col)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the edges whose signatures agree; the share of equal 8-bit values is corrected for chance."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for c in ("sa", "sb"))
        similar = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
        yield batch.select(["u", "v"]).filter(pa.array(similar >= THRESHOLD))


def _stars(batches: Iterator[pa.RecordBatch], edges: bool) -> Iterator[pa.RecordBatch]:
    """Of each bucket, as far as a task holds it: its smallest key, or the edges from that to its other keys."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        bucket, key = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        held.clear()
        order = np.lexsort((key, bucket))
        bucket, key = bucket[order], key[order]
        head = np.concatenate([np.ones(min(1, bucket.size), dtype=bool), bucket[1:] != bucket[:-1]])
        if not edges:
            return pa.RecordBatch.from_arrays([pa.array(bucket[head]), pa.array(key[head])], names=["bucket", "key"])
        pairs = np.stack([key[head][np.cumsum(head) - 1], key], axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    for batch in batches:
        bands = batch.column("bands").flatten().to_numpy(zero_copy_only=False)
        held.append((bands, np.repeat(batch.column("key").to_numpy(zero_copy_only=False), BANDS)))
        if sum(h[0].size for h in held) >= COMBINED:
            yield flush()
    if held:
        yield flush()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a task's edges, so many at a time, by a star for each of their components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def flush() -> pa.RecordBatch:
        pairs = [(x, find(x)) for x in parent]
        parent.clear()
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[1] for p in pairs], pa.int64()), pa.array([p[0] for p in pairs], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            if (x := find(a)) != (y := find(b)):
                parent[max(x, y)] = min(x, y)
        if len(parent) >= COMBINED:
            yield flush()
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star: (node, root) of every node that isn't its component's smallest."""
    now = checkpointed(edges.select("u", "v").mapInArrow(_contract, "u long, v long"))
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small-star: every node points to its larger ones' minimum
        low = large.join(large.groupBy("v").agg(F.min("u").alias("m")), "v")
        small = low.select(F.col("m").alias("u"), "v").unionByName(low.where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        now = checkpointed(small)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == state:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        state = new


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc, n, root, rep, rep_key): what is in groups of two or more rows, n times, and each group's representative."""
    rows = spread(docs.select(ident(id_col).alias("doc"), string(text_col).alias("text")))
    rows = rows.where("text is not null").select(row_key(F.col("doc"), F.col("text")).alias("key"), "doc", "text")
    signed = written(rows.mapInArrow(_sign, "key long, doc long, sig binary, bands array<long>"))
    local = signed.select("key", "bands")
    centre = local.mapInArrow(lambda batches: _stars(batches, False), "bucket long, key long")
    met = centre.select(F.min("key").over(Window.partitionBy("bucket")).alias("u"), F.col("key").alias("v")).where("u <> v")
    star = met.unionByName(local.mapInArrow(lambda batches: _stars(batches, True), "u long, v long")).distinct()
    sig = signed.select("key", "sig").groupBy("key").agg(F.any_value("sig").alias("sig"))
    edges = star.join(sig.select(F.col("key").alias("u"), F.col("sig").alias("sa")), "u").join(sig.select(F.col("key").alias("v"), F.col("sig").alias("sb")), "v")
    roots = components(edges.select("u", "v", "sa", "sb").mapInArrow(_agree, "u long, v long"))
    counted = signed.groupBy("key", "doc").agg(F.count("*").alias("n"))
    repeated = counted.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("key").alias("node"), F.col("key").alias("root"))
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).unionByName(repeated).groupBy("node").agg(F.min("root").alias("root"))
    member = counted.join(member, F.col("key") == F.col("node")).select("key", "doc", "n", "root")
    member = written(member)
    first = member.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("bare"), "doc", "key")).alias("first"))
    return member.join(first, "root").select("key", "doc", "n", "root", F.col("first.doc").alias("rep"), F.col("first.key").alias("rep_key"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc, root) of every row in a group of two or more rows; the root is a member's key."""
    return members(docs, id_col, text_col).select("key", "doc", "root", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("col")


_CHOSEN = "(key = rep_key AND doc <=> rep)"


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, duplicate_of, key, rep_key): each member of a group but its representative, the smallest id.

    Repeated rows are members as often as they occur, less one for a representative.
    """
    left = members(docs, id_col, text_col).withColumn("n", F.expr(f"n - CAST({_CHOSEN} AS INT)")).where("n > 0")
    return left.select(F.col("doc").alias("doc_id"), F.col("rep").alias("duplicate_of"), "key", "rep_key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")).drop("k")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each group left; other rows and all columns stay as they are.

    Texts aren't shuffled as long as the list of rows to leave out is small enough to be broadcast, by the size
    of its table; beyond that rows and list meet by key.  Only repeated rows, of which one stays, always meet.
    """
    decided = written(members(docs, id_col, text_col).select("key", F.col("doc").alias("d"), F.expr(f"NOT {_CHOSEN}").alias("gone"), (F.col("n") > 1).alias("again")).where("gone OR again"))
    rows = packed(docs, key=row_key(ident(id_col), string(text_col)), doc=ident(id_col))
    listed = F.broadcast(decided) if is_small(decided) else decided
    rows = rows.join(listed.withColumnRenamed("key", "k"), F.expr("key = k AND doc <=> d"), "left")
    single = rows.where("k IS NULL")
    if decided.where("again AND NOT gone").isEmpty():
        return unpacked(single)
    again = rows.where("again AND NOT gone").withColumn("n", F.row_number().over(Window.partitionBy("key", "doc").orderBy("key"))).where("n = 1")
    return unpacked(single.unionByName(again.drop("n")))
