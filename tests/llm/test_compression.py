import base64
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm.compression import CompressionJudge, duplicate_lines, judge, learn_limits, length_step, repeated_words

PROSE = "The committee met on Tuesday to weigh the harbour plan, and after two hours of careful debate its members asked for new drawings, a budget, and some proof that fishing boats would still find berths. "


def brute_repeats(words):
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)})


@pytest.mark.parametrize("seed", range(20))
def test_repeats_equal_brute_force(seed):
    rng = random.Random(seed)
    words = [rng.choice([b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]) for _ in range(rng.randint(0, 60))]
    assert repeated_words(words) == brute_repeats(words)


def test_duplicate_lines_have_words():
    assert duplicate_lines(b"a\n\n\n a\na\n \n \nb\nb\nb") == 3


def test_bands():
    one, rng = CompressionJudge(), random.Random(3)
    prose = "".join(rng.choice("etaoinshrdlu  bcfmpw") + rng.choice("aeiou ") for _ in range(20000)).encode()
    assert not one(prose)[3]
    assert one(b"spam " * 2000)[3]
    assert one(bytes(rng.randrange(33, 127) for _ in range(20000)))[3]
    # repetition inside a document that is fine as a whole
    assert one(prose + b"ha " * 15000)[3]
    assert one(b"") == (None, 0, 0, False)


def varied_prose(size, seed=7):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlucm") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    return " ".join(rng.choice(words) for _ in range(size // 2)).encode()[:size]


def encoded(size, seed=7):
    return base64.encodebytes(random.Random(seed).randbytes(size))[:size]


def random_ascii(size, seed=7):
    rng = random.Random(seed)
    return bytes(rng.randrange(33, 127) if rng.random() > 0.15 else 32 for _ in range(size))


@pytest.mark.parametrize("size", [1000, 2000, 3000, 5000, 7000, 10000, 20000, 30000, 100000])
def test_encoded_and_random_text_fall_outside(size):
    one = CompressionJudge()
    assert one(encoded(size))[3]
    assert one(random_ascii(size))[3]
    assert not one(varied_prose(size))[3]


@pytest.mark.parametrize("junk", [encoded, random_ascii])
def test_prose_with_a_long_encoded_part(junk):
    _, chunks, bad, failed = CompressionJudge()(varied_prose(30000) + junk(70000))
    assert failed
    assert bad >= 16


def phrase(size):
    return (b"buy the best cheap watches now at our store today " * (size // 50 + 1))[:size]


@pytest.mark.parametrize(("prose", "junk"), [(8192, phrase(4090)), (8192, encoded(4090)), (80000, phrase(20000)), (80000, encoded(20000)), (400000, phrase(12000))])
def test_junk_at_the_end(prose, junk):
    one, text = CompressionJudge(), varied_prose(prose)
    assert not one(text)[3]
    ratio, chunks, bad, failed = one(text + junk)
    assert failed
    low, high = one.band(len(text + junk))
    assert low <= ratio <= high
    assert chunks == -(-len(text + junk) // 4096)


def test_junk_spread_over_a_text():
    one = CompressionJudge()
    assert one(b"".join(varied_prose(24576, seed) + phrase(4096) for seed in range(4)))[1:] == (28, 4, True)
    # one bad chunk of many is let by, as is a short odd end
    assert one(varied_prose(94208) + phrase(4096))[1:] == (24, 1, False)
    assert not one(varied_prose(8192) + b"-" * 70)[3]


def test_short_remainder_belongs_to_the_chunk_before():
    one = CompressionJudge()
    assert one.cuts(4096) == [0, 4096]
    assert one.cuts(4096 + 64) == [0, 4160]
    assert one.cuts(4096 + 65) == [0, 4096, 4161]
    assert one.cuts(30) == [0, 30]


def test_edges(edge_docs, no_docs):
    found = judge(edge_docs).collect()
    for r, (i, t) in zip(sorted(found, key=lambda r: (str(r.doc_id), r.word_chars)), sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=lambda x: (str(x[0]), len(x[1] or ""))), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols) == (i, len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
        assert not (r.kept and r.base_failed)
    assert judge(no_docs).count() == 0


def test_prose_is_kept(spark):
    words = PROSE.split()
    text = " ".join(random.Random(1).sample(words, len(words)) + words)
    assert judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).head().kept


def test_length_steps_are_half_octaves():
    for n in [1, 2, 3, 5, 90, 91, 127, 128, 181, 182, 1 << 40]:
        assert 2 ** (length_step(n) / 2) <= n * (1 + 1e-12) and n < 2 ** ((length_step(n) + 1) / 2) * (1 + 1e-12)
    assert length_step(0) == -1


def test_learnt_limits_reject_what_the_fixed_bands_keep(spark):
    """Limits from the even ids' labels, held against the odd ones: without the method nothing of this is rejected."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    plain = judge(docs).filter("not base_failed").select("doc_id", F.col("kept").alias("fixed"))
    learnt = judge(docs, labels.filter("doc_id % 2 = 0")).filter("not base_failed").select("doc_id", "kept")
    held = {r.quality: r for r in learnt.join(plain, "doc_id").join(labels.filter("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.avg(F.col("fixed").cast("int")).alias("fixed")).collect()}
    assert held[0].fixed > 0.99 and held[0].kept < 0.5
    assert held[1].kept > 0.99


def test_learning_from_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, None), (None, 1), (99, 1), (8, 1), (8, 0)], "doc_id long, quality int")
    for some in (labels, labels.filter("false")):
        assert learn_limits(edge_docs, some) == {}
        assert sorted(judge(edge_docs, some).collect(), key=str) == sorted(judge(edge_docs).collect(), key=str)
        assert judge(no_docs, some).count() == 0


def test_a_document_teaches_once(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(150, 170)))) for i in range(250)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, quality int")
    repeated = docs.union(docs.filter("doc_id < 2").crossJoin(spark.range(500)).select("doc_id", "text"))
    once = learn_limits(docs, labels)
    assert once and learn_limits(repeated, labels.union(labels)) == once


def test_every_labelled_document_teaches(spark):
    """30,000 good documents, more than the 20,000 that were the most: their count in a half octave decides whether it has limits."""
    text, rare = varied_prose(1000).decode(), varied_prose(3000).decode()
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).repartition(4)
    docs = docs.union(spark.range(30_000, 30_110).select("id", F.lit(rare)))
    limits = learn_limits(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert set(limits) == {length_step(len(text)), length_step(len(rare))}


def test_base_columns_equal_brute_force(edge_docs):
    space = re.compile(r"[^\x20\x09-\x0D]+")
    for r, got in zip(edge_docs.collect(), judge(edge_docs).collect(), strict=True):
        text = r.text or ""
        words, seen, repeated_lines = space.findall(text), set(), 0
        for line in text.split("\n"):
            if space.search(line):
                repeated_lines += line in seen
                seen.add(line)
        places = {}
        for i in range(len(words) - 2):
            places.setdefault(tuple(words[i : i + 3]), []).append(i)
        covered = {i + k for found in places.values() if len(found) > 1 for i in found for k in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want = (r.doc_id, len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), repeated_lines, len(covered), failed)
        assert (got.doc_id, got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words, got.base_failed) == want
