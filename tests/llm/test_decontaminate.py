import re

import numpy as np

from engramite.llm import decontaminate, fmindex
from tests.llm.frames import clashing, docs, prose

ITEM = "which ancient river crossed the copper valley before the silver harbour engine was ever built there"
SHORT = "four words make this"


def items(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", text.lower()) if text else []


def brute(texts, benchmark):
    phrases = set()
    for t in benchmark:
        w = words(t)
        if w:
            n = min(len(w), 8)
            phrases |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = []
    for k, t in enumerate(texts):
        w, spans = words(t), []
        for i in range(len(w)):
            for n in sorted({len(p) for p in phrases}):
                if tuple(w[i : i + n]) in phrases:
                    if spans and spans[-1][0] >= 0 and i <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], i + n)
                    else:
                        spans.append([i, i + n])
        out += [(k, a, b) for a, b in spans]
    return sorted(out)


def test_spans_match_brute_force(spark):
    texts = [f"intro {ITEM.upper()}, outro", prose(3, 100), f"{prose(4, 20)} {ITEM} {ITEM} {prose(5, 20)}", " ".join(ITEM.split()[:8]), " ".join(ITEM.split()[:7]), f"x {SHORT} y", None, "", f"{prose(6, 30_000)} {ITEM}", f"intro {ITEM.upper()}, outro"]
    bench = [ITEM, SHORT, "too short", None, "", "über größe straße wörter acht neun zehn elf zwölf"]
    got = decontaminate.contaminated(docs(spark, texts), items(spark, bench))
    assert sorted(map(tuple, got.collect())) == brute(texts, bench)


def test_many_passes_give_the_same(spark, monkeypatch):
    texts, bench = [f"a {ITEM} b {prose(7, 30)}", prose(7, 30)], [ITEM, prose(7, 30)]
    one = sorted(map(tuple, decontaminate.contaminated(docs(spark, texts), items(spark, bench)).collect()))
    monkeypatch.setattr(decontaminate, "PHRASES_PER_PASS", 1)
    assert sorted(map(tuple, decontaminate.contaminated(docs(spark, texts), items(spark, bench)).collect())) == one


def test_short_items_can_be_left_out(spark):
    bench, texts = [ITEM, "too short", "alone"], [f"a too short b alone {ITEM} c"]
    assert len(decontaminate.contaminated(docs(spark, texts), items(spark, bench)).collect()) == 2
    assert len(decontaminate.contaminated(docs(spark, texts), items(spark, bench), shortest=4).collect()) == 1


def test_cut_texts(spark):
    table = clashing(docs(spark, [f"before {ITEM} after", None, "", "clean text", f"before {ITEM} after"], [1, 2, 3, None, 1]))
    out = decontaminate.decontaminate(table, items(spark, [ITEM]))
    assert out.columns == table.columns
    assert sorted(str((r.doc_id, r.text, r.n_chars)) for r in out.collect()) == sorted(map(str, [(1, "before  after", 13), (1, "before  after", 13), (2, None, None), (3, "", 0), (None, "clean text", 10)]))


def test_many_passes_cut_the_same(spark, monkeypatch):
    w = ITEM.split()
    bench = [" ".join(w[:11]), " ".join(w[5:]), " ".join(w[8:12]), "red kites over hills", "over hills red kites"]
    texts = [f"x {ITEM} y {ITEM} z", f"red kites {ITEM} over hills", f"{ITEM}, red kites over hills red kites end", None, "", "clean text", f"{prose(8, 30_000)} {ITEM} tail"]
    cut = lambda: sorted(str(tuple(r)) for r in decontaminate.decontaminate(docs(spark, texts).repartition(2), items(spark, bench)).collect())
    one = cut()
    monkeypatch.setattr(decontaminate, "PHRASES_PER_PASS", 1)
    assert len(list(decontaminate.passes(items(spark, bench)))) > 3
    assert cut() == one
    want = {k: t for k, t in enumerate(texts) if t is not None}
    for k, a, b in sorted(brute(texts, bench), reverse=True):
        at = [m.span() for m in re.finditer(r"[0-9A-Za-z]+", want[k])]
        want[k] = want[k][: at[a][0]] + want[k][at[b - 1][1] :]
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(docs(spark, texts), items(spark, bench)).collect() if r.text is not None} == want


def test_empty_tables(spark):
    assert decontaminate.contaminated(docs(spark, []), items(spark, [ITEM])).count() == 0
    assert decontaminate.contaminated(docs(spark, [ITEM]), items(spark, [])).count() == 0
    assert decontaminate.decontaminate(docs(spark, [ITEM]), items(spark, [])).first().text == ITEM


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(5)
    for size, kinds in ((1, 2), (50, 2), (400, 5), (300, 200)):
        seq = rng.integers(1, kinds + 1, size)
        index = fmindex.FMIndex(seq)
        for n in (1, 2, 4):
            for _ in range(20):
                phrase = rng.integers(1, kinds + 2, n)
                low, high = index.search(phrase[None, :])
                at = sorted(index.locate(np.arange(low[0], high[0])).tolist())
                assert at == [i for i in range(size - n + 1) if (seq[i : i + n] == phrase).all()]
