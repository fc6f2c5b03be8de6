from collections import Counter

import pyarrow as pa

from engramite.llm import packing
from tests.llm.frames import clashing, docs, prose


def brute(sizes, window, most):
    """The same policy over one partition, written with plain lists."""
    open_, out = [], []
    for doc, n in sizes:
        start = 0
        while n - start >= window:
            out.append([(doc, start, window)])
            start += window
        need = n - start
        if not need:
            continue
        fits = [w for w in open_ if window - sum(x[2] for x in w) >= need]
        if fits:
            best = max(fits, key=lambda w: sum(x[2] for x in w))
        else:
            if len(open_) == most:
                fullest = max(open_, key=lambda w: sum(x[2] for x in w))
                open_.remove(fullest)
                out.append(fullest)
            best = []
            open_.append(best)
        best.append((doc, start, need))
        if sum(x[2] for x in best) == window:
            open_.remove(best)
            out.append(best)
    return out, open_


def test_packer_matches_brute_force():
    import random

    for seed in range(20):
        rnd = random.Random(seed)
        sizes = [(k, rnd.choice([0, 1, 3, 7, 10, 16, 23, 40])) for k in range(200)]
        packer, out = packing.Packer(16, 4), []
        for doc, n in sizes:
            out += list(packer.place(doc, n, lambda start, n: []))
        want, left = brute(sizes, 16, 4)
        bare = lambda windows: sorted(sorted(x[:3] for x in w) for w in windows)
        assert bare(out) == sorted(map(sorted, want))
        assert bare(packer.rest()) == sorted(map(sorted, left))


def tokens(text):
    return [n for n, _ in packing.Words().rows(pa.array([text]))][0]


def check(windows, texts, window):
    """Every token of every document is in exactly one window, and the pieces make the documents again."""
    parts = {}
    for w in windows:
        assert w.n_tokens == sum(w.lengths) <= window and len(w.doc_ids) == len(w.starts) == len(w.lengths)
        for d, a, n, piece in zip(w.doc_ids, w.starts, w.lengths, w.texts, strict=True):
            parts.setdefault(d, []).append((a, n, piece))
    for d, text in texts.items():
        at, pieces = 0, sorted(parts.pop(d, []))
        assert "".join(p[2] for p in pieces) == (text if pieces else "")
        for a, n, piece in pieces:
            assert a == at and n == tokens(piece) > 0
            at += n
        assert at == (tokens(text) if text else 0)
    assert not parts


def test_every_token_once(spark):
    texts = {k: prose(k, 5 + 37 * k % 300) for k in range(120)} | {500: prose(1, 9000), 501: None, 502: "", 503: " \n "}
    windows = packing.pack(docs(spark, list(texts.values()), list(texts)).repartition(5), window=256, most=4).collect()
    check(windows, texts, 256)
    assert len(windows) <= 1.1 * sum(tokens(t) for t in texts.values() if t) / 256 + 5
    assert len({w.window_id for w in windows}) == len(windows)


def test_cases(spark):
    rows = clashing(docs(spark, ["one two", "one two", "x, y"], [7, 7, None]))
    out = packing.pack(rows.coalesce(1)).collect()
    assert len(out) == 1 and Counter(out[0].doc_ids) == Counter([7, 7, None]) and out[0].n_tokens == 7
    assert packing.pack(docs(spark, [])).count() == 0


def test_counts_words_and_marks():
    assert [n for n, _ in packing.Words().rows(pa.array(["a, b!", None, "", "naïve 12"]))] == [4, 0, 0, 2]


def test_public_tokenizer_round_trip(spark):
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoder = packing.Encoder("/opt/tokenizers/byte_bpe_50k.tiktoken", pattern)
    texts = {k: prose(k, 5 + 13 * k) + " naïve ünïcode 😀" for k in range(30)} | {90: None, 91: "", 92: prose(2, 3000)}
    windows = packing.pack(docs(spark, list(texts.values()), list(texts)).repartition(3), window=128, most=4, tokens=encoder).collect()
    parts = {}
    for w in windows:
        assert len(w.tokens) == w.n_tokens == sum(w.lengths) <= 128
        at = 0
        for d, a, n in zip(w.doc_ids, w.starts, w.lengths, strict=True):
            parts.setdefault(d, []).append((a, w.tokens[at : at + n]))
            at += n
    for d, text in texts.items():
        ids = [x for _, piece in sorted(parts.pop(d, [])) for x in piece]
        assert encoder.encoding.decode(ids) == (text or "")
    assert not parts
