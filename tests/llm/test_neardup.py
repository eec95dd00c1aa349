import random
from itertools import combinations

import numpy as np
import pytest

from quern.llm.neardup import Shingler, Signer, connected, near_duplicates, similar, without_near_duplicates


def shingles(text, n):
    words = text.encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def brute(rows, n, percent=80):
    sets = {i: shingles(t or "", n) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect() if r.doc_id is not None))


@pytest.mark.parametrize(("seed", "words"), [(1, 2), (2, 2), (3, 5)])
def test_equals_brute_force_around_the_threshold(spark, seed, words):
    """Groups of copies with so many edits that many pairs lie just over or under the threshold, and stars miss links."""
    rng = random.Random(seed)
    rows, doc_id = [], 0
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 20, 60, 150, 400]))]
        for _ in range(rng.choice([2, 5, 40])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((doc_id, " ".join(copy)))
            doc_id += 1
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(near_duplicates(docs, words=words)) == brute(rows, words)


def test_edges(edge_docs, no_docs):
    rows = {r.doc_id: r.text for r in edge_docs.collect()}
    found = near_duplicates(edge_docs, words=2)
    assert got(found) == brute(list(rows.items()), 2)
    assert found.filter("doc_id is null").count() == 2 and found.filter("doc_id is null and kept").count() == 2
    assert near_duplicates(no_docs).count() == 0


def test_documents_keep_one_of_each_group(edge_docs):
    out = without_near_duplicates(edge_docs)
    assert out.columns == edge_docs.columns
    # both rows of 8 share four of five 5-word shingles with 7, which stands for them
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "9", "10", "11", "None", "None"])


def test_components_of_paths_stars_and_rings(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(500, i) for i in range(501, 540)]
    ring = [(900 + i, 900 + (i + 1) % 9) for i in range(9)]
    found = {r.id: r.component for r in connected(spark.createDataFrame(path + star + ring, "a long, b long")).collect()}
    assert {found[i] for i in range(100, 141)} == {100} and {found[i] for i in range(500, 540)} == {500} and {found[i] for i in range(900, 909)} == {900}


@pytest.mark.parametrize("size", [3, 10, 40, 300])
def test_signatures_agree_as_often_as_sets_do(size):
    rng, signer = np.random.default_rng(7), Signer()
    agree = []
    for _ in range(60):
        both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (size * 8 // 10, size // 10 + 1, size // 10 + 1))
        x, y = np.unique(np.r_[both, a]), np.unique(np.r_[both, b])
        truth = len(both) / (len(both) + len(a) + len(b))
        agree.append((signer.signature(x) == signer.signature(y)).mean() - truth)
    assert abs(np.mean(agree)) < 0.05


def test_similarity_is_exact_at_the_threshold():
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert similar(a, b)  # 8 of 10
    assert not similar(np.arange(9, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64))  # 8 of 11


def test_short_texts_make_one_shingle():
    s = Shingler(5)
    assert len(s(b"")) == 0 and len(s(b" \n")) == 0 and len(s(b"a b")) == 1
    assert s(b"a b").tolist() == s(b"A  B\n").tolist() != s(b"a b c").tolist()


def test_names_of_columns_do_not_clash(edge_docs):
    docs = edge_docs.withColumnsRenamed({"kept": "__gone", "n_lines": "gone", "lang": "id"})
    out = without_near_duplicates(docs)
    ids = {r.doc_id for r in out.collect()}  # four of the five shingles of 7 are those of 8
    assert out.columns == docs.columns and {7, None} <= ids and 8 not in ids
