import random

import numpy as np

from engramite.llm import toxicity
from tests.llm.frames import clashing, docs, prose

SLURS = ["blorgface", "snarkwit", "grubling", "vilespawn", "muckbrain", "dregfiend", "toadkin", "slimewort"]


def corpus(n=400, seed=1):
    """Texts and truths: toxic ones hold several made-up insults, and some seeds."""
    rnd = random.Random(seed)
    texts, toxic = [], []
    for k in range(n):
        words = prose(1000 + k, 60).split()
        bad = k % 4 == 0
        for _ in range(rnd.randint(3, 6) if bad else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(SLURS + ["idiot", "scum"]))
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def labels(spark, pairs):
    return spark.createDataFrame([(i, 1, t) for i, t in pairs], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    texts, truth = corpus()
    told = [(i, truth[i]) for i in range(0, 200)]
    got = {r.doc_id for r in toxicity.toxic(docs(spark, texts), labels(spark, told)).collect()}
    held = range(200, 400)
    hits = sum((i in got) == bool(truth[i]) for i in held)
    assert hits >= 0.95 * len(held)
    assert sum(truth[i] for i in held if i in got) >= 0.9 * sum(truth[i] for i in held)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    hit = np.linspace(0.4, 0.8, toxicity.VOTERS)
    bits = np.where(y[:, None], rng.random((y.size, toxicity.VOTERS)) < hit, rng.random((y.size, toxicity.VOTERS)) < 0.01)
    masks, counts = np.unique(bits @ (1 << np.arange(toxicity.VOTERS)), return_counts=True)
    model = toxicity.LabelModel(masks, counts)
    assert abs(model.prior - 0.2) < 0.02
    assert np.abs(model.accuracies()[:, 0] - hit).max() < 0.05


def test_cases(spark):
    texts, truth = corpus(80)
    table = clashing(docs(spark, [*texts, None, "", texts[0], texts[0]], [*range(80), 80, 81, None, 0]))
    told = spark.createDataFrame([*[(i, 1, truth[i]) for i in range(80)], (None, 1, 1), (3, None, None), (999, 0, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = [r.doc_id for r in toxicity.toxic(table, told).collect()]
    assert 80 not in got and 81 not in got
    assert got.count(0) == 2 and got.count(None) == 1


def test_without_labels_the_seeds_vote(spark):
    texts = [prose(k, 40) + (" you idiot moron scum" if k % 5 == 0 else "") for k in range(60)]
    got = {r.doc_id for r in toxicity.toxic(docs(spark, texts)).collect()}
    assert got == set(range(0, 60, 5))


def test_empty_tables(spark):
    none = docs(spark, [])
    assert toxicity.toxic(none, labels(spark, [])).count() == 0
    assert toxicity.toxic(docs(spark, [None, ""]), labels(spark, [])).count() == 0
