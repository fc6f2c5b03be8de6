"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicons (a seed list in parts, and words and word prefixes mined from a bounded sample
of labelled rows, also in parts) and patterns over their hits.  Each document's votes are one bit
mask; how often each mask occurs over all documents is all that the label model needs, and there
are at most 2**VOTERS masks however large the corpus.  The model is a mixture of two classes; in
each the votes follow a tree, so that a voter's chance to fire depends on the class and on one other
voter.  EM estimates the accuracies and the correlations, the tree being the maximum spanning one by conditional
mutual information.  A logistic regression over hashed words and prefixes with an L1 penalty is
then fitted to the posteriors of a bounded sample of documents, and scores all documents.

Cases: null and empty texts are never toxic; labels that are null, or of no document, count for
nothing, and without labels only the seed lexicon votes; repeated rows get equal scores; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.llm import textops
from engramite.llm.common import ident, spread, string, written
from engramite.llm.minhash import row_key

#: Bounds of the fitting: labelled rows to mine, mined terms, documents of the smaller class for the classifier.
LABELLED_ROWS, MINED_TERMS, FIT_ROWS = 20_000, 5_000, 1_500
#: Terms that the classifier may use: those whose loss falls most at first.
FIT_TERMS = 4_096
PREFIXES = (4, 5, 6)
#: Least estimated probability of a reported document.
THRESHOLD = 0.5

SEEDS = (
    ("idiot", "idiots", "moron", "morons", "stupid", "imbecile", "dumb", "idiota", "estúpido", "stupide", "dumm", "dummkopf", "crétin", "imbécile"),
    ("scum", "trash", "worthless", "garbage", "vermin", "abschaum", "wertlos", "escoria", "basura", "ordure", "déchet", "inútil"),
    ("loser", "losers", "clown", "pathetic", "disgusting", "versager", "erbärmlich", "minable", "dégoûtant", "perdedor", "patético", "asqueroso"),
)
_WORD_PARTS = 4
#: Seed parts, mined words by hash, mined prefixes by length, then patterns: three different terms, one term again.
VOTERS = len(SEEDS) + _WORD_PARTS + len(PREFIXES) + 2


class Lexicon:
    """Terms by hash with the voter that each belongs to."""

    def __init__(self, mined: list[tuple[int, int]]) -> None:
        owner: dict[int, int] = {}
        for value, kind in mined:
            voter = len(SEEDS) + (value % _WORD_PARTS if kind == 0 else _WORD_PARTS + kind - 1)
            owner[value] = voter
        for part, group in enumerate(SEEDS):
            owner |= dict.fromkeys(textops.terms(pa.array(group), ())[0].tolist(), part)
        self.terms = textops.TermSet(np.array(list(owner), dtype=np.uint64))
        self.owner = np.array([owner[int(h)] for h in self.terms.hashes], dtype=np.int64)

    def votes(self, column: pa.Array) -> np.ndarray:
        """The bit mask of each row."""
        hashes, row = textops.terms(column, PREFIXES)
        at, place = self.terms.find(hashes)
        masks = np.zeros(len(column), dtype=np.int64)
        if at.size:
            pair, times = np.unique(row[at] * np.int64(self.owner.size) + place, return_counts=True)
            row, place = pair // self.owner.size, pair % self.owner.size
            np.bitwise_or.at(masks, row, 1 << self.owner[place])
            masks[np.bincount(row, minlength=masks.size) >= 3] |= 1 << (VOTERS - 2)
            masks[row[times >= 2]] |= 1 << (VOTERS - 1)
        return masks


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, kind, toxic, clean) over the labelled rows of one partition; kind 0 is a word, k a prefix of PREFIXES[k-1] bytes."""
    for part in textops.slices(batches, "text"):
        toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        for kind in range(len(PREFIXES) + 1):
            hashes, row = textops.terms(part.column("text"), PREFIXES[kind - 1 : kind] if kind else ())
            if kind:
                words = textops.terms(part.column("text"), ())[0].size
                hashes, row = hashes[words:], row[words:]
            order = np.lexsort((row, hashes))
            hashes, row = hashes[order], row[order]
            first = np.concatenate([[True], (np.diff(row) != 0) | (hashes[1:] != hashes[:-1])]) if hashes.size else np.zeros(0, dtype=bool)
            hashes, row = hashes[first], row[first]
            values, inverse = np.unique(hashes, return_inverse=True)
            bad = np.bincount(inverse, weights=toxic[row], minlength=values.size).astype(np.int64)
            all_ = np.bincount(inverse, minlength=values.size)
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(np.full(values.size, kind), pa.int32()), pa.array(bad), pa.array(all_ - bad)], names=["term", "kind", "toxic", "clean"])


def _one_shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least 3-gram hash, which near copies mostly share."""
    for part in textops.slices(batches, "text"):
        grams, offs = textops.ngrams(*textops.words(part.column("text")), 3)
        least = np.zeros(part.num_rows, dtype=np.uint64)
        full = np.flatnonzero(np.diff(offs))
        if full.size:
            least[full] = np.minimum.reduceat(grams, offs[full])
        yield pa.RecordBatch.from_arrays([part.column("text"), part.column("toxic"), pa.array(least.astype(np.int64))], names=["text", "toxic", "copy"])


def mined(rows: DataFrame, labels: DataFrame, label_rows: int = LABELLED_ROWS, most: int = MINED_TERMS) -> list[tuple[int, int]]:
    """Terms that mark labelled toxic documents: (hash, kind), from one document of each family of copies."""
    sample = labels.select(ident("doc_id").alias("doc"), F.col("toxic").cast("int").alias("toxic")).where("doc IS NOT NULL AND toxic IS NOT NULL")
    sample = sample.orderBy(F.xxhash64("doc"), "doc").limit(label_rows).groupBy("doc").agg(F.max("toxic").alias("toxic"))
    labelled = rows.where("doc IS NOT NULL").join(F.broadcast(sample), "doc").select("text", "toxic")
    single = labelled.mapInArrow(_one_shingle, "text string, toxic int, copy long").groupBy("copy", "toxic").agg(F.max("text").alias("text"))
    single = written(single.select("text", "toxic"))
    bad = single.where("toxic = 1").count()
    counts = single.mapInArrow(_count_terms, "term long, kind int, toxic long, clean long").groupBy("term", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    good = counts.where(F.col("toxic") >= max(4, bad // 250)).where("(toxic + 0.5D) / (toxic + clean + 1) >= 0.85D").orderBy(F.desc("toxic"), "clean", "term").limit(most)
    return [(r.term & ((1 << 64) - 1), r.kind) for r in good.collect()]


class LabelModel:
    """Two classes, in each a tree of dependent binary votes; fitted by EM to counted masks."""

    def __init__(self, masks: np.ndarray, counts: np.ndarray, rounds: int = 60) -> None:
        self.bits = ((masks[:, None] >> np.arange(VOTERS)) & 1).astype(np.int64)
        weight = self.weight = counts.astype(np.float64)
        fired = self.bits.sum(axis=1)
        belief = np.select([fired >= 2, fired == 1], [0.95, 0.4], 0.01)
        self.parent = np.full(VOTERS, -1)
        for step in range(rounds):
            if step % 10 == 5:
                self.parent = self._tree(weight, belief)
            self.prior = float(np.clip((weight @ belief + 1) / (weight.sum() + 2), 1e-6, 0.5))
            self.table = self._tables(weight, belief)
            new = self.posterior(self.bits)
            if step > 20 and np.abs(new - belief).max(initial=0) < 1e-6:
                break
            belief = new
        self.by_mask = dict(zip(masks.tolist(), self.posterior(self.bits).tolist(), strict=True))

    def _tree(self, weight: np.ndarray, belief: np.ndarray) -> np.ndarray:
        """Maximum spanning tree of mutual information given the class."""
        info = np.zeros((VOTERS, VOTERS))
        for w in (weight * belief, weight * (1 - belief)):
            total = w.sum() + 1e-9
            for i in range(VOTERS):
                for j in range(i):
                    for a in (0, 1):
                        for b in (0, 1):
                            p = (w @ ((self.bits[:, i] == a) & (self.bits[:, j] == b)) + 0.25) / (total + 1)
                            q = (w @ (self.bits[:, i] == a) + 0.5) / (total + 1) * (w @ (self.bits[:, j] == b) + 0.5) / (total + 1)
                            info[i, j] += total * p * np.log(p / q)
        info += info.T
        parent, inside = np.full(VOTERS, -1), [0]
        while len(inside) < VOTERS:
            i, j = max(((i, j) for i in inside for j in range(VOTERS) if j not in inside), key=lambda e: info[e])
            parent[j] = i
            inside.append(j)
        return parent

    def _tables(self, weight: np.ndarray, belief: np.ndarray) -> np.ndarray:
        """Chance of a vote by class and by the parent's vote."""
        table = np.zeros((2, VOTERS, 2))
        for y, w in enumerate((weight * (1 - belief), weight * belief)):
            for j in range(VOTERS):
                for b in (0, 1):
                    on = w if self.parent[j] < 0 else w * (self.bits[:, self.parent[j]] == b)
                    table[y, j, b] = (on @ self.bits[:, j] + 0.1) / (on.sum() + (1 if y else 20))
        return table

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        odds = np.full(len(bits), np.log(self.prior / (1 - self.prior)))
        for j in range(VOTERS):
            up = bits[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(bits), dtype=np.int64)
            one, zero = self.table[1, j][up], self.table[0, j][up]
            odds += np.where(bits[:, j] == 1, np.log(one / zero), np.log((1 - one) / (1 - zero)))
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def accuracies(self) -> np.ndarray:
        """Each voter's chance to fire on a toxic document, and its precision, over the counted masks."""
        toxic = self.weight * self.posterior(self.bits)
        return np.array([[(toxic @ b) / max(toxic.sum(), 1e-9), (toxic @ b) / max(self.weight @ b, 1e-9)] for b in self.bits.T])


class Linear:
    """Logistic regression on the presence of terms, fitted to soft labels by accelerated proximal gradient."""

    def __init__(self, features: list[np.ndarray], target: np.ndarray, penalty: float = 2e-4, rounds: int = 200) -> None:
        every = np.concatenate([*features, np.zeros(0, dtype=np.uint64)])
        values, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
        del every
        row = np.repeat(np.arange(len(features), dtype=np.int32), [f.size for f in features])
        slope = np.abs(np.bincount(inverse, weights=(target - target.mean())[row], minlength=values.size)) if row.size else np.zeros(0)
        frequent = np.flatnonzero((count >= 3) & (slope > penalty * len(features)))
        frequent = np.sort(frequent[np.argsort(-slope[frequent], kind="stable")[:FIT_TERMS]])
        number = np.full(values.size, -1)
        number[frequent] = np.arange(frequent.size)
        column = number[inverse]
        row, column = row[column >= 0], column[column >= 0]
        n, m = max(1, len(features)), frequent.size
        weight, bias, ahead, ahead_bias, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
        # rows differ in length by orders of magnitude; a bound by the mean row keeps steps useful, and backtracking safe
        rate = 4.0 * n / max(1, row.size) if row.size else 1.0

        def loss(w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
            z = np.bincount(row, weights=w[column], minlength=len(features)) + b
            return float(np.mean(np.logaddexp(0, z) - target * z)) if z.size else 0.0, z

        for _ in range(rounds):
            value, z = loss(ahead, ahead_bias)
            error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) / n
            grad, grad_bias = np.bincount(column, weights=error[row], minlength=m), float(error.sum())
            while True:
                new = ahead - rate * grad
                new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
                new_bias = ahead_bias - rate * grad_bias
                step, step_bias = new - ahead, new_bias - ahead_bias
                if loss(new, new_bias)[0] <= value + grad @ step + grad_bias * step_bias + (step @ step + step_bias**2) / (2 * rate) + 1e-12:
                    break
                rate /= 2
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = new + (t - 1) / after * (new - weight)
            ahead_bias = new_bias + (t - 1) / after * (new_bias - bias)
            weight, bias, t = new, new_bias, after
            rate *= 1.05
        used = np.flatnonzero(weight)
        self.terms = textops.TermSet(values[frequent[used]])
        self.weight, self.bias = weight[used], bias

    def scores(self, column: pa.Array) -> np.ndarray:
        hashes, row = textops.terms(column, PREFIXES)
        at, place = self.terms.find(hashes)
        z = np.full(len(column), self.bias)
        if at.size:
            pair = np.unique(row[at] * np.int64(self.weight.size) + place)
            z += np.bincount(pair // self.weight.size, weights=self.weight[pair % self.weight.size], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in textops.slices(batches, "text"):
        hashes, row = textops.terms(part.column("text"), PREFIXES)
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        first = np.concatenate([[True], (np.diff(row) != 0) | (hashes[1:] != hashes[:-1])]) if hashes.size else np.zeros(0, dtype=bool)
        hashes, row = hashes[first], row[first]
        ends = np.searchsorted(row, np.arange(part.num_rows + 1))
        yield pa.RecordBatch.from_arrays([pa.array([hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), part.column("belief")], names=["terms", "belief"])


def fitted(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[Lexicon, LabelModel, Linear]:
    """The voters, the label model over all documents, and the classifier."""
    spark = docs.sparkSession
    rows = docs.select(ident(id_col).alias("doc"), string(text_col).alias("text")).where("text IS NOT NULL")
    lexicon = Lexicon(mined(rows, labels) if labels is not None else [])
    shared = spark.sparkContext.broadcast(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textops.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(shared.value.votes(part.column("text")))], names=["key", "mask"])

    rows = spread(rows)
    keyed = rows.select(row_key(F.col("doc"), F.col("text")).alias("key"), "text")
    votes = written(keyed.mapInArrow(vote, "key long, mask long"))
    counted = votes.groupBy("mask").count().orderBy("mask").collect()
    model = LabelModel(np.array([r["mask"] for r in counted], dtype=np.int64), np.array([r["count"] for r in counted], dtype=np.int64))
    belief = spark.createDataFrame(list(model.by_mask.items()), "mask long, belief double")
    known = votes.join(F.broadcast(belief), "mask").select("key", "belief").distinct()
    order = F.xxhash64("key", F.lit(5))
    pick = known.where("belief >= 0.5").orderBy(order).limit(fit_rows).unionByName(known.where("belief < 0.5").orderBy(order).limit(2 * fit_rows))
    sample = keyed.join(F.broadcast(pick), "key").mapInArrow(_features, "terms binary, belief double").collect()
    linear = Linear([np.frombuffer(r.terms, dtype=np.uint64) for r in sample], np.array([r.belief for r in sample]))
    return lexicon, model, linear


def scored(docs: DataFrame, model: Linear, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxicity) of every document with a text."""
    rows = docs.select(ident(id_col).alias("doc_id"), string(text_col).alias("text")).where("text IS NOT NULL")
    rows, shared = spread(rows), docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in textops.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.scores(part.column("text")))], names=["doc_id", "toxicity"])

    return rows.mapInArrow(score, "doc_id long, toxicity double")


def toxic(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxicity) of the documents that the classifier, applied to all of them, finds toxic."""
    return scored(docs, fitted(docs, labels, id_col, text_col)[2], id_col, text_col).where(F.col("toxicity") >= threshold)
