import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm.urlfilter import ALPHABET, END, FOLDS, ORDER, START, calibrate, judge_urls, log_ratios


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://www.Example.COM/en/75?x#y", "www.example.com", "/en/75", "example.com/en/7", "allow"),
        ("http://a.com/en/1", "a.com", "/en/1", "com/en/", "block"),
        ("http://com/en/1", "com", "/en/1", "com/en/", "block"),
        ("http://telecom/en/1", "telecom", "/en/1", None, None),
        ("x://b.net/de/8", "b.net", "/de/8", "net/de/", "allow"),
        ("x://b.example.net/de/8", "b.example.net", "/de/8", "example.net/de/8", "block"),
        ("x://notexample.net/de/8", "notexample.net", "/de/8", "net/de/", "allow"),
        ("http://o.org/es/#q?z", "o.org", "/es/", "org/es/", "block"),
        ("http://o.org?/es/", "o.org", "", None, None),
        ("http://o.org#a://b.com/en/", "o.org", "", None, None),
        ("no scheme.com/en/", "", "", None, None),
        ("://", "", "", None, None),
        ("http://É.com\n/en/\nx", "É.com\n", "/en/\nx", None, None),
        (None, "", "", None, None),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    r = judge_urls(spark.createDataFrame([(1, url, "q")], "page_id long, url string, w string")).head()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == (verdict or "allow")


def test_model_is_interpolated_witten_bell(spark):
    good, bad = ["http://ab.c/aab", "http://ab.c/abb"], ["http://zz.c/zaz"]
    counts = [Counter(), Counter()]
    for side, urls in enumerate((good, bad)):
        for u in urls:
            p = START * ORDER + u + END
            counts[side].update(p[i : i + ORDER + 1] for i in range(len(p) - ORDER))
    rows = [(w, counts[0][w], counts[1][w]) for w in counts[0] | counts[1]]

    def probability(table, w):
        p = 1 / ALPHABET
        for k in range(ORDER + 1):
            context = w[ORDER - k : ORDER]
            followers = Counter()
            for x, n in table.items():
                if x[ORDER - k : ORDER] == context:
                    followers[x[-1]] += n
            total, kinds = sum(followers.values()), len(followers)
            if total:
                p = (followers[w[-1]] + kinds * p) / (total + kinds)
        return p

    for r in log_ratios(spark.createDataFrame(rows, "w string, good long, bad long")).collect():
        assert r.llr == pytest.approx(math.log(probability(counts[1], r.w)) - math.log(probability(counts[0], r.w)))


def test_calibration_takes_the_middle_of_the_least_error(spark):
    scored = spark.createDataFrame([("allow", -0.5), ("allow", 0.1), ("block", 0.2), ("block", 0.9)], "verdict string, llr double")
    assert calibrate(scored) == pytest.approx(0.155)
    assert calibrate(scored.filter("verdict = 'allow'")) == 10.0
    assert calibrate(scored.selectExpr("verdict", "-llr as llr")) == 10.0
    assert calibrate(scored.selectExpr("verdict", "100 * llr as llr")) == pytest.approx(0.0, abs=0.01)


def test_ruleless_urls_follow_their_likeness(spark):
    rows = [(i, f"http://shop{i % 7}.com/en/buy-now-{i}") for i in range(100)] + [(100 + i, f"http://wiki{i % 7}.net/de/artikel-{i}") for i in range(100)]
    rows += [(300, "http://shop3.com/fr/buy-now-5"), (301, "http://wiki3.net/fr/artikel-5"), (301, "http://wiki3.net/fr/artikel-5"), (None, None)]
    found = judge_urls(spark.createDataFrame(rows, "page_id long, url string")).filter("rule is null")
    assert sorted((r.page_id or 0, r.verdict) for r in found.collect()) == [(0, "allow"), (300, "block"), (301, "allow"), (301, "allow")]
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice(['a', 'b', 'shop', 'news'])}{rng.randint(0, 9)}.{rng.choice(['com/en', 'net/de', 'org/es', 'edu/fr'])}/{rng.choice(['buy', 'read', 'x'])}-{rng.randint(0, 40)}") for i in range(300)]
    rows += [(400, "ftp"), (401, ""), (402, None), *rows[:20]]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    ruled = {r.page_id: r.verdict for r in got if r.rule}
    padded = lambda u: START * ORDER + (u or "") + END
    grams = lambda u: [padded(u)[i : i + ORDER + 1] for i in range(len(padded(u)) - ORDER)]
    fold = {i: zlib.crc32((u or "").encode()) % FOLDS for i, u in rows}

    def model(verdict, without):
        grams_of = Counter(g for i, u in rows if ruled.get(i) == verdict and fold[i] != without for g in grams(u))
        tables = []
        for k in range(ORDER + 1):
            followers = defaultdict(Counter)
            for g, n in grams_of.items():
                followers[g[ORDER - k : ORDER]][g[-1]] += n
            tables.append(followers)

        def log_probability(g):
            p = 1 / ALPHABET
            for k, followers in enumerate(tables):
                seen = followers.get(g[ORDER - k : ORDER])
                if seen:
                    p = (seen[g[-1]] + len(seen) * p) / (seen.total() + len(seen))
            return math.log(p)

        return log_probability

    models = {m: (model("block", m), model("allow", m)) for m in [*range(FOLDS), None]}
    score = {}
    for i, u in rows:
        bad, good = models[fold[i] if i in ruled else None]
        score[i] = sum(bad(g) - good(g) for g in grams(u)) / len(grams(u))
    bins = sorted({math.floor(100 * score[i]) for i, _ in rows if i in ruled})
    classes = {v: [math.floor(100 * score[i]) for i, _ in rows if ruled.get(i) == v] for v in ("allow", "block")}
    cost = lambda b: sum(s > b for s in classes["allow"]) / len(classes["allow"]) + sum(s <= b for s in classes["block"]) / len(classes["block"])
    _, _, low, high = min((round(cost(b), 12), b - c, b + 1, c) for b, c in itertools.pairwise(bins))
    for r in got:
        if r.rule is None:
            assert r.llr == pytest.approx(score[r.page_id])
            if abs(r.llr - (low + high) / 200) > 1e-9:
                assert r.verdict == ("block" if r.llr > (low + high) / 200 and dict(rows)[r.page_id] else "allow")
    assert len({r.verdict for r in got if r.rule is None}) == 2


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    plan = judge_urls(pages).withColumn("x", F.lit(1))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
