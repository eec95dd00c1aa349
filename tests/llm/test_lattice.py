import zlib
from collections import Counter
from functools import cache
from math import log, log10

import numpy as np
import pytest

from quern.llm.lattice import Lattice, Pieces, is_held_out, score_documents


@pytest.fixture(scope="module")
def pieces():
    return Pieces()


def all_segmentations(pieces, weights, word):
    """Brute force: the sum over every way to cut the marked word into pieces; characters without a piece go by bytes."""
    text = "▁" + word

    @cache
    def total(i):
        if i == len(text):
            return 1.0
        out = sum(np.exp(weights[pieces.texts[text[i:j]]]) * total(j) for j in range(i + 1, len(text) + 1) if text[i:j] in pieces.texts)
        if text[i] not in pieces.texts:
            out += np.prod([np.exp(weights[pieces.byte_ids[b]]) for b in text[i].encode()]) * total(i + 1)
        return out

    return log10(total(0))


@pytest.mark.parametrize("word", ["a", "the", "internationalisation", "été", "漢字仮名", "▁x▁", "\U0001f9ff", "a" * 40])
def test_forward_equals_all_segmentations(pieces, word):
    weights = np.log(np.maximum(pieces.prior, 1e-300) / pieces.prior.sum())
    assert Lattice(pieces, weights).word(word) == pytest.approx(all_segmentations(pieces, weights, word))


def test_very_long_words_stay_finite(pieces):
    weights = np.log(np.maximum(pieces.prior, 1e-300) / pieces.prior.sum())
    assert -1e7 < Lattice(pieces, weights).word("x" * 50000) < -1000


def test_folds():
    assert is_held_out(7) == (zlib.crc32(b"7") % 5 == 1) and is_held_out(None) is False


def brute_base(rows):
    held = [is_held_out(i) for i, _ in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*(w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))), None] for _, t in rows]
    c = Counter(x for ts, h in zip(tokens, held, strict=True) if not h for x in ts)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ts), sum(c[x] > 0 for x in ts), n, sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)) for (i, _), h, ts in zip(rows, held, tokens, strict=True)]


def check(docs, rows, pieces):
    found = sorted(score_documents(docs).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    expected = sorted(brute_base(rows), key=lambda r: (str(r[0]), r[2]))
    for r, e in zip(found, expected, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == e[:5]
        assert r.base_score == pytest.approx(e[5], rel=1e-9)
        assert r.score < 0
    return found


def test_edges(edge_docs, no_docs, pieces):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    check(edge_docs, rows, pieces)
    assert score_documents(no_docs).count() == 0


def test_rare_words_join(spark, pieces, monkeypatch):
    from quern.llm import lattice

    rows = [(i, " ".join(f"w{i * k % 17}" for k in range(9))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = check(docs, rows, pieces)
    monkeypatch.setattr(lattice, "HEAD_TOKENS", 3)
    few = check(docs, rows, pieces)
    assert [r.score for r in few] == pytest.approx([r.score for r in whole])


def test_score_is_the_sum_of_its_words(spark, pieces):
    docs = spark.createDataFrame([(0, "aa bb aa"), (2, "cc")], "doc_id long, text string")
    counts = pieces.counts(["aa", "bb", "cc"], [2, 1, 1]) + pieces.prior
    counts[pieces.end] += 2
    weights = np.log(np.where(counts > 0, counts, 1e-300) / counts.sum())
    lattice = Lattice(pieces, weights)
    expected = 2 * lattice.word("aa") + lattice.word("bb") + weights[pieces.end] / log(10)
    assert score_documents(docs).filter("doc_id = 0").head().score == pytest.approx(expected)
