import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from engramite.llm import katz
from tests.llm.frames import clashing, docs, prose
from tests.oracles import compare

K = 5


class Brute:
    """Katz backoff with dictionaries, written from the definition and without the module's own code."""

    def __init__(self, texts):
        self.seqs = [(t or "").lower().split() for t in texts]
        self.c = {n: Counter(tuple(s[i : i + n]) for s in self.seqs for i in range(len(s) - n + 1)) for n in (1, 2, 3)}
        self.tokens = sum(self.c[1].values())
        self.d = {n: self.discounts(self.c[n].values()) for n in (1, 2, 3)}
        self.after = defaultdict(set)
        for n in (2, 3):
            for g in self.c[n]:
                self.after[g[:-1]].add(g[-1])
        self.words = {g[0] for g in self.c[1]}
        self.unknown = 1 - sum(self.direct((w,)) for w in self.words)
        self.memo = {}

    @staticmethod
    def discounts(counts):
        r = Counter(counts)
        tail = (K + 1) * r[K + 1] / r[1] if r[1] else 1
        out = {}
        for k in range(1, K + 1):
            good = ((k + 1) * r[k + 1] / (k * r[k]) - tail) / (1 - tail) if r[k] and tail < 1 else 0
            out[k] = good if 0 < good < 1 else 1 - 0.5 / k
        return out

    def direct(self, g):
        c = self.c[len(g)].get(g, 0)
        return self.d[len(g)].get(c, 1) * c / ((self.tokens if len(g) == 1 else self.c[len(g) - 1].get(g[:-1], 0)) + 1)

    def weight(self, h):
        if h not in self.memo:
            follow = self.after.get(h, ())
            self.memo[h] = (1 - sum(self.direct((*h, w)) for w in follow)) / (1 - sum(self.p((*h[1:], w)) for w in follow)) if follow else 1.0
        return self.memo[h]

    def p(self, g):
        if self.c[len(g)].get(g, 0):
            return self.direct(g)
        return self.unknown if len(g) == 1 else self.weight(g[:-1]) * self.p(g[1:])

    def score(self, text):
        s = (text or "").lower().split()
        return sum(math.log(self.p(tuple(s[max(0, i - 2) : i + 1]))) for i in range(len(s)))


TEXTS = [prose(k % 7, 40) + " " + prose(100 + k, 20) for k in range(30)] + ["solo", None, "", " ", prose(0, 40), prose(0, 40)]
OTHERS = [prose(3, 25), prose(900, 60), "never seen words " + prose(5, 10), "solo solo solo", None, "", TEXTS[4][20:90], prose(1, 12) + " unheard " + prose(2, 12)]


@pytest.mark.parametrize(("block", "bucket"), [(1 << 19, 1 << 20), (60, 10)])
def test_scores_and_model_match_brute_force(spark, tmp_path, block, bucket):
    brute, out = Brute(TEXTS), f"file://{tmp_path}/model"
    got = {r.doc_id: r for r in katz.scored(docs(spark, TEXTS).repartition(3), model_dir=out, block_tokens=block, bucket_keys=bucket).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].logprob == pytest.approx(brute.score(t), abs=1e-4)
        assert got[i].n_tokens == len((t or "").split())
    assert got[31].perplexity is None and got[31].logprob == 0
    # the stored tables score the same documents alike, and others by backing off
    again = {r.doc_id: r for r in katz.score(docs(spark, TEXTS), out, block_tokens=block).collect()}
    assert {i: r.logprob for i, r in again.items()} == pytest.approx({i: r.logprob for i, r in got.items()}, abs=1e-4)
    other = {r.doc_id: r.logprob for r in katz.score(docs(spark, OTHERS), out, block_tokens=block).collect()}
    assert [other[i] for i in range(len(OTHERS))] == pytest.approx([brute.score(t) for t in OTHERS], abs=1e-4)


def test_brute_force_sums_to_one():
    brute = Brute([prose(k % 5, 30, ["a", "b", "c", "d", "e", "f"]) for k in range(12)])
    for h in [(), *brute.c[1], *brute.c[2]]:
        # the probability of every word and of the unknown one, which no context has seen
        assert sum(brute.p((*h, w)) for w in brute.words) + brute.p((*h, "unheard")) == pytest.approx(1, abs=1e-9)


def test_stored_model_sums_to_one(spark, tmp_path):
    texts, out = [prose(k % 5, 30, ["a", "b", "c", "d", "e", "f"]) for k in range(12)], f"file://{tmp_path}/model"
    brute = Brute(texts)
    katz.scored(docs(spark, texts), model_dir=out, bucket_keys=20).collect()
    model, _, tables = katz.load(spark, out)
    assert model.unknown == pytest.approx(brute.unknown, abs=1e-12)
    rows = tables.collect()
    for n in (1, 2):
        assert sorted(int(x) for r in rows if r.n == n and r.name == "counts" for x in katz.unpack(r.a)) == sorted(brute.c[n].values())
        sums = sorted(pair for r in rows if r.n == n and r.name == "backoff" for pair in zip(katz.unpack_floats(r.a), katz.unpack_floats(r.b), strict=True))
        mass = lambda g: brute.d[len(g)].get(brute.c[len(g)][g], 1) * brute.c[len(g)][g]
        want = sorted((sum(mass((*h, w)) for w in f), sum(mass((*h[1:], w)) for w in f)) for h, f in brute.after.items() if len(h) == n)
        assert np.array(sums) == pytest.approx(np.array(want), abs=1e-9)
    h = next(iter(brute.c[2]))
    asked = docs(spark, [" ".join((*h, w)) for w in [*sorted(brute.words), "unheard"]])
    given = brute.score(" ".join(h))
    assert sum(math.exp(r.logprob - given) for r in katz.score(asked, out).collect()) == pytest.approx(1, abs=1e-3)  # of rounded scores


def test_sql_agrees(spark):
    from engramite.llm import queries

    assert compare(queries.op6_katz_scoring(spark, "/root/testdata/sf0.001"), katz.ORACLE, "/root/testdata/sf0.001") is None


def test_tables_are_partitioned(spark, tmp_path):
    out = f"file://{tmp_path}/model"
    katz.scored(docs(spark, [prose(k % 3, 30) for k in range(9)]), model_dir=out, bucket_keys=10).collect()
    counts = spark.read.parquet(f"{out}/counts")
    assert {"n", "part"} <= set(counts.columns) and {r.n for r in counts.select("n").distinct().collect()} == {1, 2, 3}
    assert {r.n for r in spark.read.parquet(f"{out}/backoff").select("n").distinct().collect()} == {1, 2}


def test_cases(spark, tmp_path):
    table = clashing(docs(spark, ["a b c", "a b c", None, prose(1, 9_000)], [None, 1, 1, 2]))
    out = katz.scored(table).collect()
    assert len(out) == 4 and sorted(r.n_tokens for r in out) == [0, 3, 3, 9_000]
    empty = f"file://{tmp_path}/empty"
    assert katz.scored(docs(spark, []), model_dir=empty).count() == 0
    named = docs(spark, ["a b"]).selectExpr("'doc-17' AS `a.id`", "text AS `the text`")
    assert [(r.doc_id, r.n_tokens) for r in katz.scored(named, "a.id", "the text").collect()] == [(None, 2)]


def test_a_run_for_each_part_only():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << katz.KEY_BITS, 50_000).astype(np.uint64))
    net = katz.Net.of(40, 1000)
    assert net.groups == 25
    coarse, fine = net.cut(keys, 40), net.cut(keys, 1600)
    assert len(coarse) == 40 and len(fine) == 1600
    assert sorted({f // 40 for f, _, _ in fine}) == [c for c, _, _ in coarse]
    assert [(x, y) for _, x, y in coarse] == [(min(x for f, x, _ in fine if f // 40 == c), max(y for f, _, y in fine if f // 40 == c)) for c in range(40)]


def test_packed_numbers_round_trip():
    for values in ([], [0], [1, 2, 1 << 55], list(range(1000))):
        a = np.array(values, dtype=np.uint64)
        assert (katz.unpack(katz.pack(a)) == a).all() and (katz.unpack_sorted(katz.pack_sorted(a)) == a).all()
    mask = np.arange(77) % 3 == 0
    assert (katz.unpack_bits(katz.pack_bits(mask)) == mask).all()
    floats = np.random.default_rng(1).random(33)
    assert (katz.unpack_floats(katz.pack_floats(floats)) == floats).all()


def test_a_block_is_taken_apart_once_for_all_spans_and_its_scores(monkeypatch):
    texts, ranked, rank = [prose(k, 200) for k in range(5)] + [None], [], katz.Block.rank
    monkeypatch.setattr(katz.Block, "rank", lambda block: (ranked.append(block.number), rank(block)))
    row = next(katz._blocks(iter([pa.RecordBatch.from_pydict({"doc_id": [*range(5), None], "text": texts})]), 1 << 19)).to_pylist()[0]
    counted = {n: katz.Block(row).counted(n, (0, 1))[1] for n in (1, 2, 3)}
    row |= {"totals": [katz.pack(c) for c in counted.values()], "own": [katz.pack_bits(np.ones(c.size, dtype=bool)) for c in counted.values()]}
    model = katz.Discounts({n: np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2].tolist() for n, c in counted.items()}, int(counted[1].sum()))
    runs = [r for batch in katz._send_contexts(iter([pa.RecordBatch.from_pylist([row])]), katz.Net.of(2, 1), model) for r in batch.to_pylist()]
    assert len(ranked) == 1 and {r["span"] for r in runs} == {*range(katz.CONTEXT_SPANS), katz._SCORED}
    scores = next(katz._own_results(iter([pa.RecordBatch.from_pylist([r for r in runs if r["span"] == katz._SCORED])]))).to_pylist()
    assert [s["doc_id"] for s in scores] == [*range(5), None]
    assert [s["logprob"] for s in scores] == pytest.approx([Brute(texts).score(t) for t in texts])
