import random
import zlib

import numpy as np
import pytest

from quern.llm.packing import END_ID, CapacityTree, Encoder, best_fit_plan, pack, packed_sequences, piece_starts


def sequential_best_fit(lengths, capacity):
    """Brute force: each piece, longest first, into the open bin with the least room that holds it."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, used in enumerate(bins) if used + n <= capacity]
        if fits:
            bins[max(fits, key=lambda i: bins[i])] += n
        else:
            bins.append(n)
    return sorted(bins)


@pytest.mark.parametrize("seed", range(20))
def test_plan_equals_sequential_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 31, 100])
    lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.randint(1, 1 + capacity // 4) for _ in range(rng.randint(1, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = best_fit_plan(counts, capacity)
    bins = {}
    for n, count in counts.items():
        rows = sorted(p for p in plan if p[0] == n)
        for rank in range(count):
            _, first_rank, each, first_bin, offset = [p for p in rows if p[1] <= rank][-1]
            nth = rank - first_rank
            bins.setdefault(first_bin + nth // each, []).append((offset + nth % each * n, n))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(sum(n for _, n in p) for p in bins.values()) == sequential_best_fit(lengths, capacity)


def test_tree_finds_the_tightest():
    tree, rng, held = CapacityTree(50), random.Random(1), set()
    for _ in range(500):
        room = rng.randint(1, 50)
        (held.discard if room in held else held.add)(room)
        tree.set(room, room in held)
        asked = rng.randint(1, 50)
        assert tree.tightest(asked) == min((r for r in held if r >= asked), default=None)


def test_only_long_documents_are_cut():
    assert piece_starts(10, 10) == [0]
    assert piece_starts(20, 10) == [0, 10]
    assert piece_starts(23, 10) == [0, 3, 13]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizer_files(spark):
    full, encode = tokenizer(), Encoder()
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(5)
    # every code point of the first planes beside letters, digits, spaces and line ends
    for start in [*range(0, 0xD800, 64), *range(0xE000, 0x20000, 64)]:
        texts.append("".join(f"{chr(c)}a {chr(c)}1\n{chr(c)} " for c in range(start, start + 64)))
    texts += ["".join(rng.choice("aA1 \n\t'st\u00a0\u0085\u2028é漢\U0001f600<|>") for _ in range(60)) for _ in range(300)]
    texts.append("x <|endoftext|> y")
    for text in texts:
        assert encode(text) == full.encode(text, add_special_tokens=False).ids


def test_edges(edge_docs, no_docs):
    capacity, full = 64, tokenizer()
    rows = pack(edge_docs, capacity).toPandas()
    docs = edge_docs.select("doc_id", "text").collect()
    expected = []
    for doc_id, text in docs:
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")
        starts = piece_starts(len(ids), capacity)
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            expected.append((-1 if doc_id is None else doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = rows.assign(doc_id=rows.doc_id.fillna(-1).astype(int))
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(expected)
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= capacity
    assert rows.sequence_id.nunique() == len(sequential_best_fit(rows.length.tolist(), capacity))
    assert pack(no_docs).count() == 0


def test_sequences_hold_the_pieces(edge_docs):
    found = packed_sequences(edge_docs.filter("doc_id < 9"), 128).collect()
    assert all(0 < len(r.ids) <= 128 for r in found)
    assert sum(r.ids.count(END_ID) for r in found) >= edge_docs.filter("doc_id < 9").count()
