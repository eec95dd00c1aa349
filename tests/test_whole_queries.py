"""Registered queries that must not stop short of their operators' defaults, against plain Python."""

import math
import re
from collections import Counter
from datetime import datetime

import pytest

from quern.queries import QUERIES
from tests.against_sql import SF

TEXTS = [
    (1, "en", "the tide came in and the boats came home, the nets were dry"), (2, "en", "the harbour was quiet; boats and nets lay by the quay"),
    (3, "de", "der Hafen war ruhig und die Boote lagen am Kai"), (4, "de", "die Flut kam und die Boote kamen heim"),
    (5, "fr", "le port et les filets, le quai et la mer"), (6, "fr", None),
]


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def folder(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_distinctive_terms_keep_every_term_met_twice(spark, tmp_path):
    d = folder(spark, tmp_path, "documents", TEXTS, "doc_id long, lang string, text string")
    inside, sizes, corpus = Counter(), Counter(), Counter()
    for _, lang, text in TEXTS:
        for w in words(text):
            inside[lang, w] += 1
            sizes[lang] += 1
            corpus[w] += 1
    kept = {w: n for w, n in corpus.items() if n >= 2}
    a0, t = len(kept), sum(corpus.values())
    want = {}
    for g, size in sizes.items():
        for w, n in kept.items():
            x, y = inside[g, w] + a0 * n / t, n - inside[g, w] + a0 * n / t
            odds = math.log(x / (size + a0 - x)) - math.log(y / (t - size + a0 - y))
            want[g, w] = (inside[g, w], n - inside[g, w], round(odds, 4), round(odds / math.sqrt(1 / x + 1 / y), 4))
    found = {(r.group, r.term): (r.inside, r.outside, round(r.log_odds, 4), round(r.z, 4)) for r in QUERIES["t21_distinctive_terms_all"](spark, d).collect()}
    assert max(kept.values()) < 50
    assert found.keys() == want.keys()
    assert all(abs(p - q) < 2e-4 for k in want for p, q in zip(found[k], want[k], strict=True))


@pytest.mark.parametrize(("name", "iterations"), [("t7_permutation_control", 500), ("t13_cusum", 1000)])
def test_controls_shuffle_as_often_as_by_default(spark, name, iterations):
    found = [r.p * (iterations + 1) for r in QUERIES[name](spark, SF).collect()]
    assert found
    assert all(abs(p - round(p)) < 1e-6 and p >= 0.999 for p in found)


def test_clustering_null_has_every_iteration(spark):
    assert sorted(r.iteration for r in QUERIES["t18_clustering_null"](spark, SF).collect()) == list(range(199))


def test_tfidf_and_cosine_of_documents(spark, tmp_path):
    texts = [(i * 25, "en", t) for i, (_, _, t) in enumerate(TEXTS * 2)]
    d = folder(spark, tmp_path, "documents", texts, "doc_id long, lang string, text string")
    counts = {i: Counter(words(t)) for i, _, t in texts}
    df = Counter(w for c in counts.values() for w in c)
    weights = {i: {w: (1 + math.log(n)) * math.log(len(texts) / df[w]) for w, n in c.items() if df[w] < len(texts)} for i, c in counts.items()}
    for v in weights.values():
        norm = math.sqrt(sum(x * x for x in v.values()))
        v.update({w: x / norm for w, x in v.items()})
    want = {(i, w): x for i, v in weights.items() for w, x in v.items()}
    assert {(r.id, r.term): r.weight for r in QUERIES["t15_tfidf_documents"](spark, d).collect()} == pytest.approx(want, abs=2e-6)
    pairs = {(a, b): sum(weights[a][w] * weights[b][w] for w in weights[a].keys() & weights[b].keys()) for a in weights if a % 50 == 0 for b in weights if a != b and weights[a].keys() & weights[b].keys()}
    assert {(r.a, r.b): r.cosine for r in QUERIES["t16_cosine_pairs_documents"](spark, d).collect()} == pytest.approx(pairs, abs=2e-6)


def test_replay_counts_no_row_for_amounts_of_zero(spark, tmp_path):
    events = [(1, 1, "view", 5.0), (2, 1, "view", 0.0), (3, 1, "view", None), (4, 1, "click", 9.0), (5, 2, "view", -1.0), (6, 3, "click", 2.0), (7, 3, None, 2.0), (8, None, "view", 2.0)]
    rows = [(i, datetime(2024, 1, 1, 0, i), u, k, v, "{}") for i, u, k, v in events]
    d = folder(spark, tmp_path, "events", rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    found = {r.session_id: (r.agent_id, r.triggers, r.rows) for r in QUERIES["a18_replay_units"](spark, d).collect()}
    assert found == {"1": ("main", 3, 1), "2": ("main", 1, 0), "3": ("main", 0, 0), None: ("main", 1, 1)}
