import random

import pytest
from pyspark.sql import functions as F

from engramite.functions import normalize as N
from engramite.functions import scoring as S
from engramite.functions import text
from engramite.operators import consolidate, coverage, goals, learn, relations, retrieve, similarity
from engramite.schema import CoverageConfig, RetrievalConfig

NODE = "id string, content string, node_type string, confidence double, embedding array<float>, updated_us long"
EDGE = "id string, source_id string, target_id string, edge_type string, weight double"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_normalisers(spark):
    f = F.lit
    out = one(spark, a=N.probability(f("0.5x")), b=N.probability(f(" 0.5")), c=N.probability(f(" 0.7"), 0.0, True), d=N.probability(f(7)), e=N.probability(f(None)), g=N.enum(f(" Causal "), ("causal",), "related"), h=N.optional_string(f("  ")), i=N.string_list(F.array(f(" a"), f("a"), f(""), f("b"))), j=N.json_list(f("[bad")), k=N.json_map(f("[1]")), m=N.json_map(f('{"a":1}')))
    assert out == {"a": 0.5, "b": 0.5, "c": 0.7, "d": 1.0, "e": 0.5, "g": "causal", "h": None, "i": ["a", "b"], "j": [], "k": "{}", "m": '{"a":1}'}
    assert [N.graph_limit(x) for x in (3, "4x", 0, None, "no", True)] == [3, 4, 10, 10, 10, 10]
    assert [N.goal_limit(x) for x in (3, "4", -1, None)] == [3, 4, None, None]
    assert N.boolean(" Yes ") and not N.boolean("0")


def test_cosine_cases(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    out = one(spark, same=S.cosine(v(1, 0), v(2, 0, 9)), opposite=S.cosine(v(1, 0), v(-1, 0)), zero=S.cosine(v(0, 0), v(1, 1)), empty=S.cosine(v(), v(1)), none=S.cosine(F.lit(None).cast("array<double>"), v(1)), fit=S.fit_dimension(v(3, 4), 3))
    assert out == {"same": 1.0, "opposite": -1.0, "zero": 0.0, "empty": 0.0, "none": 0.0, "fit": [0.6, 0.8, 0.0]}


def test_golden_learning_and_decay(spark):
    nodes = spark.createDataFrame([("a", 0.4), ("b", 0.8), ("c", 0.6), ("d", 0.2), ("e", 0.5)], "id string, confidence double")
    rows = [("1", "success", 1.0, "a"), ("2", "failure", 1.0, "b"), ("3", "partial_success", 1.0, "c"), ("3", "partial_success", 1.0, "d"), ("4", "timeout", 1.0, "e"), ("5", "success", 1.0, "gone")]
    told = spark.createDataFrame(rows, "action_id string, status string, confidence double, causal_node_id string")
    got = {r.node_id: r.new_confidence for r in learn.updates(nodes, told).collect()}
    assert got == pytest.approx({"a": 0.52, "b": 0.69, "c": 0.62, "d": 0.30, "e": 0.475, "gone": None})
    fates = {r.id: (round(r.new_confidence, 5), r.fate) for r in consolidate.fates(spark.createDataFrame([("x", 0.5), ("y", 0.102), ("z", 0.0)], "id string, confidence double")).collect()}
    assert fates == {"x": (0.49, "decayed"), "y": (0.09996, "pruned"), "z": (0.0, "pruned")}


def test_closed_form_matches_the_fold(spark):
    rnd = random.Random(5)
    start = {f"n{k}": rnd.random() for k in range(10)}
    rows = [(f"a{i}", i, rnd.choice(["success", "failure", "timeout", "partial_success"]), rnd.random(), f"n{rnd.randrange(12)}") for i in range(300)]
    signal = {"success": 1.0, "partial_success": 0.4, "failure": -0.5, "timeout": -0.25}
    want, seen = dict(start), {}
    for _, _, status, c, n in rows:
        if n in want:
            want[n] = want[n] * 0.8 + 0.2 * min(max((signal[status] * c + 1) / 2, 0), 1)
            seen[n] = seen.get(n, 0) + 1
    told = spark.createDataFrame(rows, "action_id string, seq long, status string, confidence double, causal_node_id string")
    got = learn.learn(spark.createDataFrame(list(start.items()), "id string, confidence double"), told).collect()
    assert {r.node_id: r.feedback_count for r in got} == seen
    assert {r.node_id: r.new_confidence for r in got} == pytest.approx({n: want[n] for n in seen})


def graph(seed, n=12, m=25):
    rnd = random.Random(seed)
    nodes = [(f"n{k:02}", f"text {k}", "semantic", rnd.randrange(101) / 100, [rnd.uniform(-1, 1) for _ in range(4)] if k % 4 else None, k) for k in range(n)]
    edges = [(f"e{i}", f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n + 2):02}", "related", rnd.randrange(97) / 96) for i in range(m)]
    return nodes, edges


def naive(query, nodes, edges, c):
    """Breadth-first retrieval with dictionaries."""
    def cos(a, b):
        if b is None:
            return 0.0
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        return dot / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    info = {n[0]: n for n in nodes}
    score = {n: cos(query, info[n][4]) * info[n][3] for n in info}
    top = sorted(info, key=lambda n: (-round(score[n], 6), -info[n][5], n))[: c.similarity_limit]
    out = {n: {"score": score[n], "hops": 0, "via": None, "source": "seed", "sim": cos(query, info[n][4])} for n in top}
    near = {}
    for _, a, b, _, w in edges:
        for x, y in {(a, b), (b, a)}:
            near.setdefault(x, {})[y] = max(w, near.get(x, {}).get(y, 0))
    frontier = {n: score[n] for n in top}
    for hop in range(1, c.expansion_hops + 1):
        reached = {}
        for n, s in frontier.items():
            for y, w in sorted(near.get(n, {}).items(), key=lambda e: (-e[1], e[0]))[: c.neighbors_per_node]:
                if y != n and y in info:
                    cand = (-round(max(s * w * c.hop_decay**hop, 0), 12), n, max(s * w * c.hop_decay**hop, 0))
                    reached[y] = min(reached.get(y, cand), cand)
        for y, (_, via, s) in reached.items():
            if y not in out:
                out[y] = {"score": s, "hops": hop, "via": via, "source": "neighbor", "sim": 0.0}
            elif round(s, 6) > round(out[y]["score"], 6):
                out[y] |= {"score": s, "sim": max(out[y]["sim"], 0.0), "via": out[y]["via"] or via}
        frontier = {y: s for y, (_, _, s) in reached.items()}
    return {n: (round(e["score"], 5), e["hops"], e["via"], e["source"]) for n, e in out.items()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("hops", [1, 2, 3])
def test_retrieval_matches_naive_search(spark, seed, hops):
    nodes, edges = graph(seed)
    config = RetrievalConfig(similarity_limit=3, expansion_hops=hops, neighbors_per_node=2)
    queries = [[1.0, 0.0, 0.5, -0.2], [-1.0, 1.0, 0.0, 0.3]]
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, vector array<double>")
    got = retrieve.entries(q, spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), config).collect()
    for k, query in enumerate(queries):
        mine = {r.node_id: (round(r.score, 5), r.hops, r.via, r.source) for r in got if r.query_id == k}
        assert mine == naive(query, nodes, edges, config)


def test_search_blocks_and_ragged_vectors(spark, monkeypatch):
    rnd = random.Random(2)
    nodes = [(f"n{k:03}", None, None, rnd.random(), [rnd.uniform(-1, 1) for _ in range(rnd.choice([0, 2, 4]))], k) for k in range(60)]
    queries = [(k, [rnd.uniform(-1, 1) for _ in range(rnd.choice([2, 3, 4]))]) for k in range(9)]
    n, q = spark.createDataFrame(nodes, NODE).repartition(3), spark.createDataFrame(queries, "query_id long, vector array<double>")
    plain = n.crossJoin(q).select("query_id", "id", F.round(S.cosine(F.col("vector"), F.col("embedding")) * F.col("confidence"), 6).alias("score"))
    want = {(r.query_id, r.id): r.score for r in plain.collect()}
    for block in (1024, 7):
        monkeypatch.setattr(similarity, "BLOCK", block)
        hits = similarity.search(q, n, 5).collect()
        assert len(hits) == 45
        for r in hits:
            assert r.score == pytest.approx(want[r.query_id, r.id], abs=2e-6)
        for k in range(9):
            assert sorted((r.score for r in hits if r.query_id == k), reverse=True) == pytest.approx(sorted((s for (a, _), s in want.items() if a == k), reverse=True)[:5], abs=2e-6)


def test_large_query_tables_are_not_broadcast(spark, monkeypatch):
    nodes, _ = graph(1)
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.5, -0.2])], "query_id long, vector array<double>")
    n = spark.createDataFrame(nodes, NODE)
    one = sorted(map(tuple, similarity.search(q, n, 4).collect()))
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = similarity.search(q, n, 4)
        assert "CartesianProduct" in df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, df.collect())) == one
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


HOUR = 3_600_000_000


def evaluate(spark, nodes, outcomes, now=0, **scalars):
    s = {"contradictions": 0, "graph_support": None, "known_unknowns": None, "goal_criticality": None} | scalars
    signals = spark.createDataFrame([("s", *s.values())], "signal_id string, contradictions long, graph_support double, known_unknowns double, goal_criticality double")
    n = spark.createDataFrame([("s", *x) for x in nodes], "signal_id string, score double, confidence double, similarity double, edge_count long, updated_us long")
    o = spark.createDataFrame([("s", *x) for x in outcomes], "signal_id string, status string, confidence double")
    return coverage.evaluate(signals, n, o, now, CoverageConfig()).first()


def test_coverage_without_evidence(spark):
    out = evaluate(spark, [], [])
    assert out.decision == "escalate" and out.outcome_reliability == 0.5 and out.semantic_coverage == 0 and out.consistency == 1
    assert out.uncertainty == pytest.approx(0.65) and out.risk == pytest.approx(0.225)


def test_coverage_of_good_evidence(spark):
    nodes = [(0.95, 0.9, 0.9, 4, 0), (0.92, 0.9, 0.9, 4, 0), (0.9, 0.9, 0.9, 4, 0)]
    out = evaluate(spark, nodes, [("success", 0.95), ("success", 0.9)], goal_criticality=0.2)
    assert out.decision == "act" and out.freshness == 1.0 and out.semantic_coverage == pytest.approx(0.923333)
    stale = evaluate(spark, [(0.9, None, None, 0, 0)], [("failure", 1.0)], now=168 * HOUR)
    assert stale.freshness == pytest.approx(0.36787944) and stale.consistency == pytest.approx(0.6)


def test_coverage_resolves_ids(spark):
    nodes = spark.createDataFrame([("a", 0.8, 0)], "id string, confidence double, updated_us long")
    ids = spark.createDataFrame([("s", "a"), ("s", "gone")], "signal_id string, node_id string")
    scores = {r.node_id: r.s for r in coverage.resolved(ids, nodes).select("node_id", coverage.node_score().alias("s")).collect()}
    assert scores == {"a": 0.4, "gone": 0.0}


def test_config_overrides():
    c = CoverageConfig.of(weights={"freshness": 1, "bogus": 3, "consistency": "x"}, thresholds={"act_coverage": 0.5}, top_k="8")
    assert c.weights["freshness"] == 1 and c.weights["consistency"] == 0.20 and "bogus" not in c.weights and c.thresholds["act_coverage"] == 0.5 and c.top_k == 8
    assert RetrievalConfig(hop_decay=9).hop_decay == 1.0


def test_goal_operators(spark):
    held = spark.createDataFrame([("g", "completed", 0.4), ("h", "active", 0.4)], "id string, status string, progress double")
    asked = spark.createDataFrame([("g", "active"), ("h", "completed"), ("nobody", "active"), ("g", "completed")], "goal_id string, to_status string")
    got = sorted((r.goal_id, r.to_status, r.result, r.progress) for r in goals.transition(held, asked, 1).collect())
    assert got == [("g", "active", "invalid_transition", 0.4), ("g", "completed", "applied", 1.0), ("h", "completed", "applied", 1.0), ("nobody", "active", "not_found", None)]
    chain = spark.createDataFrame([(f"g{i}", f"g{i + 1}") for i in range(70)], "goal_id string, dependency_goal_id string")
    assert goals.dependency_closure(chain).count() == 70 * 71 // 2
    gone = goals.remove_dependencies(chain, chain.where("goal_id = 'g3'"))
    assert gone.count() == 69


def test_limits_come_before_late_filters(spark):
    rows = [(f"g{k}", "active", "short_term" if k % 2 else "long_term", k) for k in range(10)]
    held = spark.createDataFrame(rows, "id string, status string, timescale string, updated_us long")
    assert [r.id for r in relations.list_goals(held, limit=4, timescale="long_term").collect()] == ["g8", "g6"]
    assert [r.id for r in relations.list_goals(held, limit=4, timescale="long_term", strict_limit=True).collect()] == ["g8", "g6", "g4", "g2"]


def test_similar_pairs(spark):
    rows = [("a", None, None, 0.1, [1.0, 0.0], 0), ("b", None, None, 0.2, [0.99, 0.01], 0), ("c", None, None, 0.3, [0.0, 1.0], 0), ("d", None, None, 0.3, None, 0)]
    pairs = consolidate.similar_pairs(spark.createDataFrame(rows, NODE), 0.95, 4)
    assert [(r.a, r.b) for r in pairs.collect()] == [("a", "b")]


def test_embedder(spark):
    import numpy as np

    v = text.hashed_vector("Postgres uses MVCC")
    assert v.size == 384 and np.linalg.norm(v) == pytest.approx(1)
    assert text.hashed_vector("") @ text.hashed_vector(None) == pytest.approx(1)
    df = spark.createDataFrame([(1, "a b", 5), (2, " ", 6), (3, None, 7)], "id long, content string, bucket int")
    out = {r.id: r.embedding for r in text.embedded(df, "content").collect()}
    assert len(out[1]) == 384 and out[2] is None and out[3] is None
    token = spark.createDataFrame([("été",), ("ab",), ("a",)], "t string").select(text.trigrams(F.col("t")).alias("g"))
    assert [r.g for r in token.collect()] == [["été"], ["ab"], ["a"]]


def test_plans_stay_in_the_jvm(spark):
    nodes = spark.createDataFrame([("a", 0.5)], "id string, confidence double")
    told = spark.createDataFrame([("x", 1, "success", 1.0, "a")], "action_id string, seq long, status string, confidence double, causal_node_id string")
    for df in (learn.learn(nodes, told), learn.updates(nodes, told), consolidate.fates(nodes)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapIn" not in plan


def test_nodes_without_vectors_rank_for_every_query(spark, monkeypatch):
    from engramite.operators import similarity
    from engramite.plans import graph_queries as q

    qs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, vector array<float>")
    vectors = [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [1.0, 1.0], None, None, [0.0, 0.0], None]
    nodes = spark.createDataFrame([(f"n{i}{k}", v, c, 10 - k) for k, c in enumerate([0.0, 0.5, None, 2.0]) for i, v in enumerate(vectors)], "id string, embedding array<float>, confidence double, updated_us long")

    def same(queries, nodes):
        whole = similarity.search(queries, nodes, 10**8).drop("raw_score").join(nodes.where("embedding IS NULL").select("id"), "id", "left_semi")
        got = similarity.without_vectors(queries, nodes)
        n = queries.count() * nodes.where("embedding IS NULL").count()
        rows = sorted(map(tuple, got.collect()))
        assert rows == sorted(map(tuple, whole.select(got.columns).collect())) and len(rows) == n > 0

    same(qs, nodes)
    sf = "/root/testdata/sf0.001"
    some = q.view(spark, sf, "nodes").withColumn("embedding", F.when(F.col("nid") % 7 > 0, F.col("embedding")))
    same(q.vectors(spark, sf), some)
    monkeypatch.setattr(q, "view", lambda *_: some)
    assert q.similarity_null_embedding_all(spark, sf).select("query_id").distinct().count() == q.vectors(spark, sf).count()


def test_best_of_many_blocks(monkeypatch):
    """Ties, equal and empty vectors and confidences of 0, in tiles of few and of many candidates."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(similarity, "TILE", (5, 16))
    for seed, copies in ((0, 1), (1, 4), (2, 40)):
        rnd = np.random.default_rng(seed)
        x, y = rnd.normal(size=(23, 8)).astype(np.float32), np.repeat(rnd.normal(size=(160 // copies, 8)), copies, axis=0).astype(np.float32)
        conf, tie = np.sort(rnd.integers(0, 5, len(y)) / 4.0)[::-1], rnd.permutation(len(y))
        vectors = [None if i % 50 == 7 else v for i, v in enumerate(y)]
        best = similarity.Best({"query_id": pa.array(range(23)), "vector": pa.array(list(x), pa.list_(pa.float32()))}, 6, 6)
        for at in range(0, len(y), 40):
            some = slice(at, at + 40)
            best.meet({"id": pa.array([f"n{t}" for t in tie[some]]), "embedding": pa.array(vectors[some], pa.list_(pa.float32())), "confidence": pa.array(conf[some]), "updated_us": pa.array(-tie[some]), "tie": pa.array(tie[some])})
        got = best.rows().to_pydict()
        assert len(got["id"]) == 23 * 6  # not 6 of every block
        cos = similarity.cosines(pa.array(list(x), pa.list_(pa.float32())), pa.array(vectors, pa.list_(pa.float32())))
        score = np.round(cos * conf, 6)
        for q in range(23):
            want = [(f"n{tie[j]}", score[q, j] + 0.0) for j in np.lexsort((tie, -score[q]))[:6]]
            assert [(i, s) for p, i, s in zip(got["query_id"], got["id"], got["score"], strict=True) if p == q] == want


def test_seeds_of_many_queries_are_searched_once(spark, monkeypatch):
    nodes, edges = graph(3)
    n, e = spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.5, -0.2]), (1, [0.1, 1.0, 0.5, 0.2])], "query_id long, vector array<double>")
    config = RetrievalConfig(similarity_limit=3, expansion_hops=2)
    want = sorted(map(str, retrieve.retrieve(q, n, e, config).collect()))
    monkeypatch.setattr(similarity, "BROADCAST_BYTES", 0)
    df = retrieve.retrieve(q, n, e, config)
    assert "CartesianProduct" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, df.collect())) == want


def test_zeros_are_tallied_by_query(monkeypatch):
    """A query has one row for a chunk, with the places of its zeros only."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(similarity, "TILE", (5, 16))
    rnd = np.random.default_rng(4)
    x, y = rnd.normal(size=(23, 8)), rnd.normal(size=(120, 8))
    x[:, 4:], y[::3, :4] = 0.0, 0.0
    one, conf = pa.list_(pa.float64()), np.full(120, 0.5)
    tally = similarity.Tally({"query_id": pa.array(range(23)), "vector": pa.array(list(x), one)}, 6)
    for at in (0, 60):
        tally.meet({"embedding": pa.array(list(y[at : at + 60]), one), "confidence": pa.array(conf[at : at + 60]), "before": pa.array(np.arange(at, at + 60))})
    total = np.round(similarity.cosines(pa.array(list(x), one), pa.array(list(y), one)) * conf, 6)
    got = tally.rows().to_pydict()
    assert got["positive"] == (total > 0).sum(axis=1).tolist()
    assert [sorted(c) for c in got["cuts"]] == [np.flatnonzero(t == 0).tolist() for t in total]


def test_trigrams_are_hashed_once_and_values_rounded(spark):
    import numpy as np

    text._features.cache_clear()
    text._feature.cache_clear()
    words = ["abcd", "abce", "abcd", "x", "xabc"]
    v = text.hashed_vectors([" ".join(words)])[0]
    assert text._feature.cache_info().misses == 5  # abc, bcd, bce, x, xab
    plain = np.zeros(384)
    for at, w in enumerate(words):
        buckets, weights = text._features(w, 384)
        np.add.at(plain, buckets, weights / (at + 1))
    assert v == pytest.approx(plain / np.linalg.norm(plain), abs=1e-12)
    df = spark.createDataFrame([(1, " ".join(words)), (2, None)], "k long, t string")
    rounded = {(r.k, r.bucket): r.value for r in text.bucket_weights(df, "k", "t", digits=2).collect()}
    assert rounded == {(r.k, r.bucket): round(r.value, 2) for r in text.bucket_weights(df, "k", "t").collect() if round(r.value, 2)}


def test_closure_with_cycles_and_nulls(spark):
    """A goal without an id once kept the rounds going for ever."""
    rnd = random.Random(5)
    pairs = {(rnd.randrange(15), rnd.randrange(15)) for _ in range(22)} | {(k, k + 1) for k in range(20, 27)} | {(None, 3), (4, None)}
    want = set(pairs)
    while True:
        more = {(a, d) for a, b in want for c, d in pairs if b is not None and b == c} - want
        if not more:
            break
        want |= more
    df = spark.createDataFrame(sorted(pairs, key=str), "goal_id int, dependency_goal_id int")
    for hops in (1, 2, 3):
        assert sorted(map(tuple, goals.dependency_closure(df, hops).collect()), key=str) == sorted(want, key=str)
