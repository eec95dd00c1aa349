"""Cosine of some documents against all, against plain Python, and what it moves."""

import math
import random
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from quern.operators import cosine
from quern.queries import QUERIES


def brute_force(rows, asked):
    """Rows with equal keys, or without one, are one document."""
    counts = {}
    for i, text in rows:
        counts.setdefault(i, Counter()).update((text or "").split())
    n, df = len(rows), Counter(w for c in counts.values() for w in c)
    weights = {i: {w: (1 + math.log(k)) * math.log(n / df[w]) for w, k in c.items() if df[w] < n} for i, c in counts.items() if i is not None}
    norms = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in weights.items()}
    return {(a, b): sum(weights[a][w] * weights[b][w] for w in shared) / norms[a] / norms[b] for a in weights if asked(a) for b in weights if a != b and (shared := weights[a].keys() & weights[b].keys())}


def corpus(n, seed):
    draw = random.Random(seed)
    words = [f"w{int(k)}" for k in range(200)]
    return [(i, " ".join(draw.choices(words, [1 / (k + 1) for k in range(200)], k=draw.randrange(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_DOCS": 7, "ASKED_DOCS": 3, "DENSE_TERMS": 5, "SPARSE_PAIRS": 10, "OUT_ROWS": 4}, {"BLOCK_ENTRIES": 20, "DENSE_TERMS": 1}])
def test_blocks_of_any_size_give_the_pairs_of_brute_force(spark, monkeypatch, sizes):
    for k, v in sizes.items():
        monkeypatch.setattr(cosine, k, v)
    rows = [*corpus(120, "a"), (300, None), (301, ""), (302, "alone"), (303, "w3 w3 w9"), (305, "w3 w3 w9")]
    found = cosine.cosine_pairs(spark.createDataFrame(rows, "id long, text string").repartition(3), F.expr("id % 5 = 0")).collect()
    want = brute_force(rows, lambda i: i % 5 == 0)
    assert len(found) == len(want) > 1000
    assert {(r.a, r.b): r.cosine for r in found} == pytest.approx(want, abs=1e-12)


def test_rows_with_equal_keys_or_none_are_one_document(spark):
    rows = [*((None if i in (4, 5, 6) else f"k{i % 40}", t) for i, t in corpus(60, "b")), ("k3", None), (None, "w0 w1 w199")]
    found = cosine.cosine_pairs(spark.createDataFrame(rows, "name string, body string"), F.expr("name like 'k1%'"), "name", "body", digits=6).collect()
    want = brute_force(rows, lambda i: i.startswith("k1"))
    assert len(found) == len(want) > 200
    assert {(r.a, r.b): r.cosine for r in found} == pytest.approx(want, abs=5.1e-7)


def test_no_documents_and_no_asked_ones(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert cosine.cosine_pairs(empty, F.expr("id % 5 = 0")).collect() == []
    assert cosine.cosine_pairs(spark.createDataFrame(corpus(20, "c"), "id long, text string"), F.expr("id < 0")).collect() == []


def moved(spark):
    """Records written to shuffles so far, by stage."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_documents_of_common_words_do_not_move_a_row_per_document_and_term(spark, tmp_path):
    rows = [(i, " ".join(f"common{(i + k) % 40}" for k in range(20))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    before = moved(spark)
    found = {(r.a, r.b): r.cosine for r in QUERIES["t16_cosine_pairs_documents"](spark, str(tmp_path)).collect()}
    assert found == pytest.approx(brute_force(rows, lambda i: i % 50 == 0), abs=2e-6)
    assert sum(n for k, n in moved(spark).items() if k not in before) < 400 * 20


def written(spark):
    """Bytes written to shuffles so far, by stage, and bytes in the checkpoint folder."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._jvm.java.util.ArrayList()
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    folder = Path(urlparse(sc._jsc.sc().getCheckpointDir().get()).path)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}, sum(p.stat().st_size for p in folder.rglob("part-*"))


def test_words_of_one_document_alone_take_little_disk(spark, tmp_path):
    draw = random.Random("d")
    rows = [(i, " ".join(f"{draw.randrange(10**8)}" if k % 2 else f"common{draw.randrange(3000)}" for k in range(200))) for i in range(1000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    cosine.cosine_pairs(frame.limit(5), F.expr("doc_id % 50 = 0"), "doc_id").count()  # sets the checkpoint folder
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    shuffled, kept = written(spark)
    found = QUERIES["t16_cosine_pairs_documents"](spark, str(tmp_path))
    now, all_kept = written(spark)
    disk = sum(n for k, n in now.items() if k not in shuffled) + all_kept - kept
    size = sum(len(t) for _, t in rows)
    assert disk < 1.6 * size
    assert {(r.a, r.b): r.cosine for r in found.collect()} == pytest.approx(brute_force(rows, lambda i: i % 50 == 0), abs=2e-6)
