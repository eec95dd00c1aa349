import math
import random
from collections import Counter

import numpy as np
import pytest

from quern.functions.proportion import chi2_p, detectable_reduction, normal_quantile, power_verdict, required_units
from quern.functions.rng import Mulberry, seed_of
from quern.operators import sampling
from quern.operators.association import benjamini_hochberg, permutation_control, permutation_null
from quern.operators.sampling import allocate, diverse_sample, fit_to_budget, random_sample, stratified_sample
from quern.operators.series import cusum_statistic, pettitt_statistic
from quern.operators.terms import agglomerate, collapse_near_duplicates, components, cut_tree, minhash_signature, silhouette, sweep_threshold


@pytest.mark.parametrize(("df", "critical"), [(1, 3.841), (2, 5.991), (5, 11.070), (10, 18.307), (30, 43.773)])
def test_chi_square_tail_at_published_points(df, critical):
    assert chi2_p(critical, df) == pytest.approx(0.05, abs=1e-4)
    assert chi2_p(0, df) == 1


def test_normal_quantiles():
    assert normal_quantile(0.975) == pytest.approx(1.959963984540054) and normal_quantile(0.5) == pytest.approx(0)


def test_sample_sizes():
    n = required_units(0.5, 0.4)
    assert 380 < n < 395 and required_units(0.5, 0.5) is None and required_units(0.5, 0.4, deff=2) in (2 * n, 2 * n - 1)
    r = detectable_reduction(0.5, n)
    assert r == pytest.approx(0.2, abs=2e-3) and detectable_reduction(0.01, 5) is None
    assert [power_verdict(0.5, u, 0.2) for u in (n, n - 10)] == ["enough", "short"]


def test_generator_against_an_independent_one():
    """32-bit arithmetic done on unsigned integers of numpy."""
    state, out = np.uint32(seed_of("quern")), []
    with np.errstate(over="ignore"):
        for _ in range(20):
            state = state + np.uint32(0x6D2B79F5)
            t = (state ^ (state >> np.uint32(15))) * (state | np.uint32(1))
            t = t ^ (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61)))
            out.append(float(t ^ (t >> np.uint32(14))) / 2**32)
    rng = Mulberry("quern")
    assert [rng.random() for _ in range(20)] == out
    assert Mulberry("quern").take(20).tolist() == out
    assert Mulberry("quern", skip=7).random() == out[7]


def test_seed_hash_vectors():
    assert seed_of("") == 0x811C9DC5 and seed_of("a") == 0xE40C292C and seed_of("foobar") == 0xBF9CF968


def test_block_permutation_vectors():
    """A confounded table has chi-square 0; a real one is matched by 2 of its 56 arrangements."""
    rows = [("D1", "Tue", x) for x in "PPPPQQQQ"] + [("D2", "Thu", "P")] * 2 + [("D3", "Wed", "P"), ("D3", "Wed", "Q")] + [("D4", "Thu", "Q")] * 2
    found = permutation_null([r[1] for r in rows], [r[2] for r in rows], 200, blocks=[r[0] for r in rows])
    assert found["chi2"] == pytest.approx(0) and found["p"] == 1
    rows = [(f"D{k}", "Thu", x) for k in range(1, 7) for x in "PQ"] + [("D7", "Tue", "P")] * 4 + [("D8", "Wed", "Q")] * 4
    found = permutation_null([r[1] for r in rows], [r[2] for r in rows], 2000, blocks=[r[0] for r in rows])
    assert found["p"] == pytest.approx(2 / 56, abs=0.02)


@pytest.mark.parametrize("seed", range(15))
def test_pettitt_equals_its_definition(seed):
    rng = random.Random(seed)
    v = [rng.randint(0, 6) for _ in range(rng.randint(3, 40))]
    u = [sum(np.sign(a - b) for a in v[: t + 1] for b in v) for t in range(len(v) - 1)]
    place, k, p = pettitt_statistic(v)
    assert k == max(map(abs, u)) and place == [abs(x) for x in u].index(k)
    assert p == pytest.approx(min(1, 2 * math.exp(-6 * k * k / (len(v) ** 3 + len(v) ** 2))))


def test_cusum_sees_a_shift():
    assert cusum_statistic([1, 2, 1, 2, 1, 2, 9, 8, 9, 8, 9, 8], 200)[0] == 5
    assert cusum_statistic([1, 2, 1, 2, 1, 2, 9, 8, 9, 8, 9, 8], 200)[2] < 0.05 < cusum_statistic([1, 2, 1, 2, 1, 2, 1, 2], 200)[2]


@pytest.mark.parametrize("seed", range(20))
def test_allocation(seed):
    rng = random.Random(seed)
    populations = [rng.choice([0, 1, 2, 50, 400]) for _ in range(rng.randint(1, 9))]
    size = rng.randint(1, 60)
    out = allocate(populations, size)
    assert sum(out) == min(size, sum(populations)) and all(a <= p for a, p in zip(out, populations, strict=True))
    if size >= sum(p > 0 for p in populations):
        assert all(a > 0 for a, p in zip(out, populations, strict=True) if p)


def test_samples_are_seeded(spark):
    df = spark.range(200).selectExpr("id", "id % 7 as s", "cast(id % 3 as string) as t")
    a, b = (sorted(r.id for r in random_sample(df, "id", 20, seed).collect()) for seed in ("x", "y"))
    assert a == sorted(r.id for r in random_sample(df, "id", 20, "x").collect()) != b and len(set(a)) == 20
    assert {r.s for r in stratified_sample(df, "id", "s", 10).collect()} == set(range(7))
    assert len(diverse_sample(df, "id", ["s", "t"], 50).collect()) == 7


def test_arrays_shuffle_as_lists_do():
    for n in (0, 1, 2, 2001, 2002, 40_000, 200_001):
        one, other = Mulberry("x"), Mulberry("x")
        array, values = np.arange(n) % 251, [i % 251 for i in range(n)]
        for _ in range(2):
            one.shuffle_array(array)
            other.shuffle(values)
        assert array.tolist() == values and one.state == other.state


def test_permutation_control_has_no_limit_of_rows(spark):
    """More rows than the 100,000 that were the limit, out of order, over several partitions and Arrow batches, with nulls."""
    df = spark.range(0, 103_000, 1, 3).selectExpr("id * 7919 % 103001 as at", "nullif(concat('v', id % 5), 'v4') as x", "case when id % 9 > 0 then (id * id) % 3 = 1 end as y", "'one' as z")
    found = {(r.a, r.b): r for r in permutation_control(df, ["x", "y", "z"], ["at"], iterations=3, seed="s").collect()}
    rows = df.toPandas().sort_values("at")
    for a, b in (("x", "y"), ("x", "z"), ("y", "z")):
        both = rows[rows[a].notna() & rows[b].notna()]
        x, y = both[a].astype(str).tolist(), both[b].astype(str).tolist()
        expected, rng, stats = Counter(), Mulberry("s"), []
        for v, n in Counter(x).items():
            for w, m in Counter(y).items():
                expected[v, w] = n * m / len(x)
        chi2 = lambda: sum((table[k] - e) ** 2 / e for k, e in expected.items())  # noqa: B023, E731
        table = Counter(zip(x, y, strict=True))
        observed = chi2()
        for _ in range(3):
            rng.shuffle(y)
            table = Counter(zip(x, y, strict=True))
            stats.append(chi2())
        got = found[a, b]
        assert (got.chi2, got.median, got.p95, got.most) == pytest.approx((observed, sorted(stats)[1], max(stats), max(stats)), abs=1e-9)
        assert got.p == (sum(s >= observed - 1e-12 for s in stats) + 1) / 4


def drawn_by_hand(df, key, size, seed, stratum=None):
    by = {}
    for r in df.select(key, *([stratum] if stratum else [])).orderBy(key).collect():
        by.setdefault(r[1] if stratum else 0, []).append(r[0])
    names, rng = sorted(by, key=lambda x: (x is None, x)), Mulberry(seed)
    return [k for x, n in zip(names, allocate([len(by[x]) for x in names], size), strict=True) for k in rng.draw(by[x], n)]


def odd_keys(spark):
    """Keys out of order over several partitions, some repeated and some null."""
    df = spark.range(0, 900, 1, 7).selectExpr("id * 7919 % 1009 as id", "cast(id % 5 as string) as s")
    return df.union(df.filter("id < 30")).union(spark.sql("select cast(null as long), '1' union all select 5000, null union all select 5001, null"))


def as_before(df, key, chosen):
    return sorted(r[key] for r in df.collect() if r[key] is not None and r[key] in set(chosen))


@pytest.mark.parametrize("size", [1, 40, 2000])
def test_random_sample_has_no_limit_of_ids(spark, monkeypatch, size):
    monkeypatch.setattr(sampling, "MOST_IDS", 10)
    df = odd_keys(spark)
    assert [r.id for r in random_sample(df, "id", size, "x").collect()] == as_before(df, "id", drawn_by_hand(df, "id", size, "x"))
    assert random_sample(df.filter("false"), "id", size).count() == 0


@pytest.mark.parametrize("size", [2, 6, 40, 2000])
def test_stratified_sample_has_no_limit_of_ids(spark, monkeypatch, size):
    """Sizes below the six strata, equal to them, above, and of more rows than there are."""
    monkeypatch.setattr(sampling, "MOST_IDS", 10)
    df = odd_keys(spark)
    assert [r.id for r in stratified_sample(df, "id", "s", size, "x").collect()] == as_before(df, "id", drawn_by_hand(df, "id", size, "x", "s"))
    assert stratified_sample(df.filter("false"), "id", "s", size).count() == 0


def test_budget():
    assert fit_to_budget(["aaaa", "bb", "c"], 3) == 2 and fit_to_budget([], 3) == 0


def test_clusters():
    points = np.array([0, 0.1, 0.2, 5, 5.1, 9])
    d = np.abs(points[:, None] - points[None])
    for linkage in ("average", "complete", "single"):
        merges = agglomerate(d, linkage)
        assert len(merges) == 5
        labels = cut_tree(merges, 6, 1.0)
        assert labels == [0, 0, 0, 3, 3, 5]
    assert silhouette(d, [0, 0, 0, 3, 3, 5]) > 0.7
    assert sweep_threshold(d, [0.01, 1.0, 100]) == [(0.01, 0, 0.0), (1.0, 2, 5 / 6), (100, 1, 1.0)]


def test_collapse_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(15):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([1, 2, 5, 40, 80]))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows.append((len(rows), "..."))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(max(1, len(t.split()) - 2))} for i, t in rows[:-1]}
    root = {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    found = collapse_near_duplicates(spark.createDataFrame(rows, "id long, text string")).collect()
    assert {r.id: r.group for r in found} == {i: find(i) for i, _ in rows}
    assert all(find(r.representative) == r.group for r in found)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 60), (60, 55)]
    assert {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {**dict.fromkeys(range(31), 0), 50: 50, 60: 50, 55: 50}


def test_minhash_agrees_like_jaccard():
    a, b = {str(i) for i in range(100)}, {str(i) for i in range(10, 110)}
    same = np.mean(np.array(minhash_signature(a)) == np.array(minhash_signature(b)))
    assert abs(same - 90 / 110) < 0.15 and minhash_signature(set()) == [0xFFFFFFFF] * 128


def test_adjusted_p_values_over_several_partitions(spark):
    p = [(f, round((i * 7919 % 613) / 613, 3)) for f in ("x", "y") for i in range(900 if f == "x" else 40)] + [("x", None), (None, 0.5)]
    want = {}
    for f in ("x", "y"):
        values = sorted(v for g, v in p if g == f and v is not None)
        least = 1.0
        for rank in range(len(values), 0, -1):
            least = min(least, len(values) / rank * values[rank - 1])
            want[f, values[rank - 1]] = least
    rows = benjamini_hochberg(spark.createDataFrame(p, "f string, p double"), family=["f"]).collect()
    assert len(rows) == len(p)
    for r in rows:
        expected = want.get((r.f, r.p))
        assert r.p_adjusted == (expected if expected is None else pytest.approx(expected))
    alone = [v for f, v in p if f == "y"]
    for r in benjamini_hochberg(spark.createDataFrame([(v,) for v in alone], "p double")).collect():
        assert r.p_adjusted == pytest.approx(want["y", r.p])
