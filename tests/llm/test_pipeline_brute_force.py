"""The stages of the pipeline against brute force, each on what the one before it gave."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import neardup, packing
from quern.llm.common import read
from quern.llm.decontam import WINDOW, contamination, decontaminate_documents
from tests.llm import test_linededup, test_neardup, test_packing
from tests.llm.test_decontam import LOWER, WORD

SF = "/root/testdata/sf0.001"
ITEM = [f"item{i}" for i in range(20)]
#: Cutting the whole item out of the middle joins two parts of it.
REJOINED = " ".join([*(f"before{i}" for i in range(30)), *ITEM[:9], *ITEM, *ITEM[9:18], *(f"after{i}" for i in range(30))])


def brute_decontamination(text, items, most_coverage=0.8):
    """The words that stay, None for a document that goes."""
    windows = {}
    for item in items:
        w = WORD.findall((item or "").translate(LOWER))
        n = min(WINDOW, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(n, set()).add(tuple(w[k : k + n]))
    words = WORD.findall(text.translate(LOWER))
    total = len(words)
    while True:
        hit = {j for n, found in windows.items() for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in found for j in range(i, i + n)}
        if not hit:
            return words
        words = [w for i, w in enumerate(words) if i not in hit]
        if total - len(words) > most_coverage * total:
            return None


def test_stages_equal_brute_force(spark):
    docs, benchmark = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    stages = dict(corpus_pipeline.STAGES)
    fixed = lambda df: spark.createDataFrame(df.toPandas(), df.schema)
    clean = fixed(stages["toxicity"](spark, docs, SF))
    before = [(r.doc_id, r.text) for r in clean.collect()]
    items = [r.text for r in benchmark.collect()]

    lines = fixed(stages["line_dedup"](spark, clean, SF))
    got = {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in lines.collect()}
    assert got == {i: sha for i, _, _, sha in test_linededup.brute(before)}

    unique = fixed(stages["near_dedup"](spark, lines, SF))
    kept = {i for i, _, _, stays in test_neardup.brute([(r.doc_id, r.text) for r in lines.collect()], neardup.WORDS) if stays}
    assert {r.doc_id for r in unique.collect()} == kept

    freed = fixed(stages["decontamination"](spark, unique, SF))
    want = {r.doc_id: brute_decontamination(r.text or "", items) for r in unique.collect()}
    assert {r.doc_id: WORD.findall((r.text or "").translate(LOWER)) for r in freed.collect()} == {i: w for i, w in want.items() if w is not None}
    assert contamination(freed, benchmark).filter("contaminated").count() == 0

    pieces = stages["packing"](spark, freed, SF).collect()
    encode = packing.Encoder(None)
    lengths, crcs = [], {}
    for r in freed.collect():
        ids = np.array([*encode(r.text or ""), packing.END_ID], "<u4")
        starts = packing.piece_starts(len(ids), packing.CAPACITY)
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            lengths.append(b - a)
            crcs[r.doc_id, a] = (b - a, zlib.crc32(ids[a:b].tobytes()))
    assert {(p.doc_id, p.start): (p.length, p.ids_crc32) for p in pieces} == crcs
    assert len(pieces) == len(crcs)
    bins = {}
    for p in pieces:
        bins.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for placed in bins.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
    assert sorted(sum(n for _, n in placed) for placed in bins.values()) == test_packing.sequential_best_fit(lengths, packing.CAPACITY)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_what_a_cut_joins_is_cut_too(spark, block_bytes):
    rng, vocabulary = random.Random(11), "abc"
    rows = [(0, REJOINED), (1, None), (2, "before " + " ".join(ITEM))]
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(40)) + " z" * 200) for i in range(3, 40)]
    items = [(1, " ".join(ITEM)), (2, " ".join(rng.choice(vocabulary) for _ in range(4))), (3, "a b c c b")]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate_documents(docs, benchmark, block_bytes=block_bytes)
    assert contamination(out, benchmark).filter("contaminated").count() == 0
    got = {r.doc_id: WORD.findall((r.text or "")) for r in out.collect()}
    if block_bytes > 60:
        want = {i: brute_decontamination(t or "", [t for _, t in items]) for i, t in rows}
        assert got == {i: w for i, w in want.items() if w is not None}
    assert got[0] == REJOINED.split()[:30] + REJOINED.split()[-30:]
    assert 2 not in got
