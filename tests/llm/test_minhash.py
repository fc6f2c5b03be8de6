import random

import numpy as np
import pyarrow as pa

from engramite.llm import minhash, textops
from tests.llm.frames import clashing, docs, prose


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))}


def near(text, seed, share):
    rnd = random.Random(seed)
    w = text.split()
    for i in rnd.sample(range(len(w)), int(len(w) * share)):
        w[i] = f"changed{rnd.randrange(1000)}"
    return " ".join(w)


def brute(texts, least):
    """Connected components of pairs of at least a Jaccard similarity: text number to its smallest member."""
    sets = [None if t is None else shingles(t) if t.split() else {t} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_groups_match_brute_force(spark):
    texts = [prose(k, 60) for k in range(40)]
    texts += [near(texts[k % 20], k, 0.02) for k in range(60)] + texts[:5]
    want = {i: r for i, r in enumerate(brute(texts, 0.6)) if r != i}
    got = {r.doc_id: r.duplicate_of for r in minhash.duplicates(docs(spark, texts)).collect()}
    assert len(set(want) & set(got)) >= 0.9 * len(want)
    assert all(brute([texts[i], texts[j]], 0.3)[1] == 0 or i in want for i, j in got.items())


def test_estimated_similarity_is_unbiased():
    texts, exact, estimate = [prose(k, 80) for k in range(60)], [], []
    for k, t in enumerate(texts):
        other = near(t, k, 0.01 * (k % 12))
        sig = minhash.signatures(pa.array([t, other]))
        a, b = shingles(t), shingles(other)
        exact.append(len(a & b) / len(a | b))
        estimate.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(np.array(exact) - np.array(estimate))) < 0.03


def test_densified_rows_have_no_empty_bin():
    sig = minhash.signatures(pa.array(["one two three four", "alone", "", None]))
    assert (sig[:3] != minhash._EMPTY).all()
    assert (minhash.signatures(pa.array(["alone"])) == sig[1]).all()


def test_cases(spark):
    long = prose(9, 30_000)
    rows = docs(spark, [None, None, "", "", " ", "hi", "hi", long, long + " end", "lonely words here", None], [1, 2, 3, 4, 5, 6, 6, 8, 9, None, None])
    out = sorted((r.doc_id, r.duplicate_of) for r in minhash.duplicates(rows).collect())
    assert out == [(4, 3), (6, 6), (9, 8)]
    kept = minhash.deduplicate(clashing(rows))
    assert kept.columns == clashing(rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 5, 6, 8, None, None]))


def test_empty_table(spark):
    assert minhash.duplicates(docs(spark, [])).count() == 0
    assert minhash.deduplicate(docs(spark, [])).count() == 0


def test_a_bucket_of_a_hundred_thousand_rows(spark):
    from pyspark.sql import functions as F

    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same few words again and again").otherwise("the same few words again and again").alias("text"))
    out = minhash.duplicates(rows).agg(F.count("*").alias("n"), F.max("duplicate_of").alias("rep"), F.count_distinct("doc_id").alias("ids")).first()
    assert (out.n, out.rep, out.ids) == (99_999, 0, 99_999)


def test_large_lists_of_rows_to_leave_out(spark, monkeypatch):
    from engramite.llm import common

    texts = [prose(k % 10, 30) for k in range(40)] + [None]
    small = sorted(str(tuple(r)) for r in minhash.deduplicate(docs(spark, texts)).collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert sorted(str(tuple(r)) for r in minhash.deduplicate(docs(spark, texts)).collect()) == small and len(small) == 11


def test_ids_that_are_no_numbers(spark):
    table = spark.createDataFrame([("doc-17", "a b c d"), ("doc-18", "a b c d"), ("3", "a b c d")], "`a.id` string, text string")
    assert [r["a.id"] for r in minhash.deduplicate(table, "a.id").collect()] == ["3"]


def test_long_chain_is_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "u long, v long").repartition(4)
    assert {r.root for r in minhash.components(edges).collect()} == {0}


def test_words_do_not_depend_on_case_or_neighbours():
    one, _ = textops.words(pa.array(["Straße GRÜN x"]))
    two, offs = textops.words(pa.array(["abc", "straße grün X", None, ""]))
    assert (one == two[1:4]).all() and offs.tolist() == [0, 1, 4, 4, 4]
