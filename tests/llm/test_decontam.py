import hashlib
import random
import re

import pytest

from quern.llm.decontam import SuffixAutomaton, contamination, decontaminate_documents, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text, items, window=10):
    words = WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for name, item in items:
        w = WORD.findall((item or "").translate(LOWER))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == w[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(name)
    return len(words), hit, sorted(map(str, found))


@pytest.mark.parametrize("seed", range(30))
def test_automaton_equals_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = "abcd"[: rng.randint(1, 4)]
    items = [(str(k), "".join(rng.choice(vocabulary) + " " for _ in range(rng.randint(0, 14)))) for k in range(rng.randint(0, 6))]
    window = rng.choice([1, 2, 3, 5])
    automaton = SuffixAutomaton([(n, words_of(t.encode())) for n, t in items], window)
    for _ in range(20):
        text = "".join(rng.choice(vocabulary + "z") + " " for _ in range(rng.randint(0, 40)))
        spans, found = automaton.stream(words_of(text.encode()))
        _, hit, names = brute(text, items, window)
        assert {i for a, b in spans for i in range(a, b)} == hit
        assert sorted(automaton.names[i] for i in found) == names


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_edges(spark, edge_docs, no_docs, block_bytes):
    items = [(2, "beta GAMMA delta-epsilon zeta eta theta iota kappa lambda mu alpha"), (10, "one"), (3, None), (4, "..."), (None, "a b"), (2, "five own line of"), (5, "été 你好")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    usable = [(i, t) for i, t in items if i is not None]
    expected = []
    for r in edge_docs.collect():
        n, hit, names = brute(r.text if r.text is None or len(r.text) < 100000 else r.text, usable) if r.doc_id != 4 else (36000, None, None)
        if hit is not None:
            expected.append((r.doc_id, n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    found = contamination(edge_docs, benchmark, block_bytes=block_bytes)
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.filter("doc_id <> 4 or doc_id is null").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    _, hit, _ = brute(edge_docs.filter("doc_id = 4").head().text, usable)
    assert found.filter("doc_id = 4").head().n_hit == len(hit)
    assert contamination(no_docs, benchmark).count() == 0
    assert contamination(edge_docs, benchmark.filter("item_id < 0")).filter("contaminated").count() == 0


def test_spans_are_cut_out(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, f"Before it, {item.upper()}! After it. Then more words follow so that it stays.", 7), (2, item, 7), (3, None, 7), (4, "clean", 7)], "doc_id long, text string, n_chars int")
    out = {r.doc_id: (r.text, r.n_chars) for r in decontaminate_documents(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out[1][0] == "Before it, ! After it. Then more words follow so that it stays."
    assert out[1][1] == len(out[1][0])
    assert 2 not in out and out[3][0] is None and out[4][0] == "clean"


@pytest.mark.parametrize("seed", range(2))
def test_the_size_of_a_block_changes_no_row(spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 12, 14])))) for i in range(8)]

    def text():
        parts = [rng.choice(items)[1] if rng.random() < 0.6 else "clean tail of words" for _ in range(rng.randint(0, 6))]
        if parts and rng.random() < 0.3:  # cutting the middle joins the outer halves
            words = rng.choice(items)[1].split()
            parts.append(" ".join([*words[:2], rng.choice(items)[1], *words[2:]]))
        return rng.choice([" ", ", ", "\n"]).join(parts)

    rows = [(i, text(), "a", 1, "b") for i in range(60)] + [(100, "\0gone\0", "a", 1, "b"), (101, None, "a", 1, "b"), (None, items[0][1] + " x" * 40, "a", 1, "b"), (5, "", "a", 1, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars int, new string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    results = [decontaminate_documents(docs, benchmark, block_bytes=size) for size in (1 << 20, 150, 40)]
    assert all(r.columns == docs.columns for r in results)
    whole, *others = (sorted(map(tuple, r.collect()), key=str) for r in results)
    assert all(o == whole for o in others)
    assert {100, 101, 5, None} <= {r[0] for r in whole} and len(whole) < len(rows)
    left = contamination(results[0], benchmark)
    assert left.filter("contaminated").count() == 0
