"""Statistics of words: distinctive terms, tf-idf, near-duplicate groups, clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.rng import DEFAULT_SEED, Mulberry
from quern.operators.association import benjamini_hochberg, chi2_tail
from quern.operators.search import tokens
from quern.plans.shared import cut

MOST_CLUSTERED = 5_000


def token_rows(docs: DataFrame, key: str = "id", text: str = "text", *keep: str) -> DataFrame:
    """(key, term): one row per token."""
    return docs.select(F.col(key).alias("id"), *keep, F.explode(tokens(F.col(text))).alias("term"))


def distinctive_terms(docs: DataFrame, group: str, text: str = "text", least: int = 2, prior: float | None = None) -> DataFrame:
    """(group, term, inside, outside, log_odds, z, p, p_adjusted): log-odds with an informative Dirichlet prior, for every group and frequent term.

    Counts are made per (group, term) before the shuffle; groups are few, so their totals are broadcast.
    """
    counted = docs.select(F.col(group).alias("group"), F.explode(tokens(F.col(text))).alias("term")).groupBy("group", "term").agg(F.count("*").alias("n"))
    counted = cut(counted)
    background = counted.groupBy("term").agg(F.sum("n").alias("corpus")).filter(F.col("corpus") >= least)
    sizes = counted.groupBy("group").agg(F.sum("n").alias("size"))
    told = sizes.agg(F.sum("size").alias("t")).head()["t"] or 0
    vocabulary = background.count()
    a0 = float(prior if prior is not None else vocabulary)
    cells = background.join(F.broadcast(sizes), F.lit(True)).join(counted, ["group", "term"], "left")
    inside = F.coalesce("n", F.lit(0))
    alpha = F.lit(a0) * F.col("corpus") / F.lit(max(1, told))
    cells = cells.withColumn("inside", inside).withColumn("outside", F.col("corpus") - F.col("inside")).withColumn("x", F.col("inside") + alpha).withColumn("y", F.col("outside") + alpha)
    cells = cells.withColumn("dx", F.col("size") + a0 - F.col("x")).withColumn("dy", F.lit(told) - F.col("size") + a0 - F.col("y")).filter("dx > 0 and dy > 0")
    odds = F.log(F.col("x") / F.col("dx")) - F.log(F.col("y") / F.col("dy"))
    cells = cells.withColumn("log_odds", odds).withColumn("z", F.col("log_odds") / F.sqrt(1 / F.col("x") + 1 / F.col("y")))
    scored = cells.select("group", "term", "inside", "outside", "log_odds", "z", chi2_tail(F.col("z") * F.col("z"), F.lit(1)).alias("p"))
    return benjamini_hochberg(cut(scored))


def tfidf(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, term, weight): (1 + ln tf) * ln(N / df), unit length; terms in every document weigh nothing and go."""
    n = docs.count()
    tf = token_rows(docs, key, text).groupBy("id", "term").agg(F.count("*").alias("c"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") < n)
    weighed = tf.join(df, "term").withColumn("w", (1 + F.log("c")) * F.log(F.lit(float(n)) / F.col("df")))
    norms = weighed.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def shingle_sets(docs: DataFrame, key: str = "id", text: str = "text", size: int = 3) -> DataFrame:
    """(id, n_tokens, shingles): distinct runs of ``size`` tokens; a shorter document is one shingle."""
    t = tokens(F.col(text))
    made = docs.select(F.col(key).alias("id"), t.alias("t")).withColumn("n_tokens", F.size("t"))
    runs = F.transform(F.sequence(F.lit(1), F.col("n_tokens") - size + 1), lambda i: F.array_join(F.slice("t", i, size), "\0"))
    whole = F.when(F.col("n_tokens") > size, runs).when(F.col("n_tokens") > 0, F.array(F.array_join("t", "\0"))).otherwise(F.array().cast("array<string>"))
    return made.select("id", "n_tokens", F.array_distinct(whole).alias("shingles"))


def collapse_near_duplicates(docs: DataFrame, key: str = "id", text: str = "text", threshold: float = 0.9, size: int = 3) -> DataFrame:
    """(id, group, representative): groups of documents joined by shingle similarity of at least ``threshold``.

    Exact, by prefixes: in a common order of shingles, rarest first, two sets that similar share one of their first
    n - ceil(threshold * n) + 1. So only rare shingles meet, and boilerplate never makes pairs. Equal sets are one row first.
    The representative has the most tokens, then the smallest id.
    """
    # 128-bit hashes stand for equal sets, 64-bit ones for shingles: their strings are not moved
    hashed = F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(s)))
    sets = shingle_sets(docs, key, text, size).withColumn("h", F.substring(F.sha2(F.array_join(F.array_sort("shingles"), "\1"), 256), 1, 32))
    sets = cut(sets.withColumn("shingles", hashed))
    heads = sets.filter(F.size("shingles") > 0).groupBy("h").agg(F.min("id").alias("head"))
    unique = sets.join(heads, (sets["h"] == heads["h"]) & (sets["id"] == heads["head"]), "left_semi").select("id", "shingles")
    rows = unique.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    df = rows.groupBy("s").agg(F.count("*").alias("df"))
    ordered = rows.join(df, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    kept = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1
    prefix = cut(ordered.select("id", "n", F.explode(F.slice("o", F.lit(1), kept)).alias("x")).filter("x.df > 1").select("id", "n", F.col("x.s").alias("s")))
    left, right = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "s"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "s")
    pairs = left.join(right, "s").filter(f"a < b and least(na, nb) >= {threshold} * greatest(na, nb) - 1e-9").select("a", "b").distinct()
    both = pairs.join(unique.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(unique.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    edges = both.filter(shared / (F.size("sa") + F.size("sb") - shared) >= threshold).select("a", "b")
    labels = components(edges)
    joined = sets.join(heads, "h", "left").withColumn("node", F.coalesce("head", "id")).join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    grouped = joined.select("id", "n_tokens", F.coalesce("component", "node").alias("group"))
    best = grouped.groupBy("group").agg(F.min(F.struct((-F.col("n_tokens")).alias("m"), "id"))["id"].alias("representative"))
    return grouped.join(best, "group").select("id", "group", "representative")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): labels spread and jump along their own labels until none changes, so rounds grow with the logarithm of the longest path."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("j"))
        following = cut(labels.join(near, "id").join(jump, "component").select("id", F.least("component", "m", "j").alias("c"), F.col("component").alias("old")))
        moved = following.filter("c <> old").limit(1).count()
        labels = following.select("id", F.col("c").alias("component"))
        if not moved:
            return labels


def minhash_signature(shingles: set[str], permutations: int = 128, seed: str = DEFAULT_SEED) -> list[int]:
    """The least of each permuted 32-bit hash."""
    from quern.functions.rng import seed_of

    rng = Mulberry(seed)
    hashes = np.array([seed_of(s) for s in shingles], np.uint64)
    out = []
    for _ in range(permutations):
        a, b = int(rng.random() * 0xFFFFFFFF) | 1, int(rng.random() * 0xFFFFFFFF)
        out.append(int(((hashes * np.uint64(a) + np.uint64(b)) & np.uint64(0xFFFFFFFF)).min()) if len(hashes) else 0xFFFFFFFF)
    return out


def agglomerate(distance: np.ndarray, linkage: str = "average") -> list[tuple[int, int, float]]:
    """Merges (a, b, height) of nearest-neighbour-chain clustering; a cluster keeps its smallest member's number."""
    d = distance.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            row = np.where(alive, d[chain[-1]], np.inf)
            nearest = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[nearest]:
                nearest = chain[-2]
            if len(chain) > 1 and nearest == chain[-2]:
                break
            chain.append(nearest)
        b, a = chain.pop(), chain.pop()
        a, b = min(a, b), max(a, b)
        merges.append((a, b, float(d[a, b])))
        joined = {"average": lambda: (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b]), "complete": lambda: np.maximum(d[a], d[b]), "single": lambda: np.minimum(d[a], d[b])}[linkage]()
        d[a], d[:, a] = joined, joined
        d[a, a] = np.inf
        alive[b] = False
        size[a] += size[b]
    return merges


def cut_tree(merges: list[tuple[int, int, float]], n: int, height: float) -> list[int]:
    """A cluster number for each leaf: merges of at most ``height`` hold."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b, h in sorted(merges, key=lambda m: m[2]):
        if h <= height:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(i) for i in range(n)]


def silhouette(distance: np.ndarray, labels: list[int]) -> float:
    """Mean silhouette; a cluster of one counts 0."""
    names = sorted(set(labels))
    if len(names) < 2:
        return 0.0
    at = np.array([names.index(x) for x in labels])
    sums = np.column_stack([distance[:, at == k].sum(1) for k in range(len(names))])
    sizes = np.bincount(at)
    own = sums[np.arange(len(at)), at] / np.maximum(1, sizes[at] - 1)
    other = sums / sizes
    other[np.arange(len(at)), at] = np.inf
    nearest = other.min(1)
    return float(np.where(sizes[at] > 1, (nearest - own) / np.maximum(np.maximum(own, nearest), 1e-300), 0.0).mean())


def cluster_documents(docs: DataFrame, key: str = "id", text: str = "text", threshold: float = 0.8, linkage: str = "average", most: int = MOST_CLUSTERED) -> DataFrame:
    """(id, cluster, size, representative): agglomerative clusters of tf-idf vectors, ids numbered in order. The distance matrix
    is square, so more than ``most`` documents are refused, never sampled."""
    n = docs.count()
    if n > most:
        raise ValueError(f"clustering holds every distance at once: {most} documents at most")
    weights = tfidf(docs, key, text).toPandas()
    ids = sorted(r["id"] for r in docs.select(F.col(key).alias("id")).collect())
    labels, distance = cluster_vectors(ids, weights, threshold, linkage)
    rows = []
    for name in sorted(set(labels)):
        members = [i for i, x in enumerate(labels) if x == name]
        mean = distance[np.ix_(members, members)].sum(1)
        centre = members[int(mean.argmin())]
        rows += [(ids[i], ids[members[0]], len(members), ids[centre]) for i in members]
    kind = docs.schema[key].dataType.simpleString()
    return docs.sparkSession.createDataFrame(rows, f"id {kind}, cluster {kind}, size int, representative {kind}")


def cluster_vectors(ids: list, weights, threshold: float, linkage: str) -> tuple[list[int], np.ndarray]:
    place = {x: i for i, x in enumerate(ids)}
    term = {t: j for j, t in enumerate(sorted(set(weights["term"])))}
    m = np.zeros((len(ids), max(1, len(term))))
    m[[place[x] for x in weights["id"]], [term[t] for t in weights["term"]]] = weights["weight"]
    distance = np.clip(1 - m @ m.T, 0, None)
    np.fill_diagonal(distance, 0)
    return cut_tree(agglomerate(distance, linkage), len(ids), threshold), distance


def vectors_of(token_lists: list[list[str]]) -> np.ndarray:
    """Distances of documents given as tokens, by the same weights as ``tfidf``."""
    terms: dict[str, int] = {}
    counts = [{} for _ in token_lists]
    for row, found in zip(counts, token_lists, strict=True):
        for t in found:
            j = terms.setdefault(t, len(terms))
            row[j] = row.get(j, 0) + 1
    m = np.zeros((len(token_lists), max(1, len(terms))))
    for i, row in enumerate(counts):
        m[i, list(row)] = 1 + np.log(list(row.values()))
    df = (m > 0).sum(0)
    m *= np.log(len(token_lists) / np.maximum(df, 1))
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    m = m / np.where(norm > 0, norm, 1)
    distance = np.clip(1 - m @ m.T, 0, None)
    np.fill_diagonal(distance, 0)
    return distance


def clustering_null(docs: DataFrame, key: str = "id", text: str = "text", threshold: float = 0.8, linkage: str = "average", iterations: int = 199, seed: str = DEFAULT_SEED, most: int = MOST_CLUSTERED) -> DataFrame:
    """(iteration, clusters, share): how much clusters when the same tokens are dealt at random into documents of the same lengths.

    Each iteration shuffles a fresh pool from its own place in the generator's sequence, so iterations run side by side.
    """
    if docs.count() > most:
        raise ValueError(f"clustering holds every distance at once: {most} documents at most")
    lists = [r["t"] for r in docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("t")).orderBy("id").collect()]
    shared = docs.sparkSession.sparkContext.broadcast(lists)
    step = max(0, sum(map(len, lists)) - 1)

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for k in batch["id"]:
                pool = [t for found in shared.value for t in found]
                Mulberry(seed, skip=int(k) * step).shuffle(pool)
                dealt, at = [], 0
                for found in shared.value:
                    dealt.append(pool[at : at + len(found)])
                    at += len(found)
                _, clusters, share = sweep_threshold(vectors_of(dealt), [threshold], linkage)[0]
                rows.append((k, clusters, share))
            yield pd.DataFrame(rows, columns=["iteration", "clusters", "share"])

    return docs.sparkSession.range(0, iterations, 1, min(iterations, 64)).mapInPandas(run, "iteration long, clusters long, share double")


def sweep_threshold(distance: np.ndarray, thresholds: list[float], linkage: str = "average") -> list[tuple[float, int, float]]:
    """(threshold, clusters of two or more, share of documents in them), cutting one tree again."""
    merges, n = agglomerate(distance, linkage), len(distance)
    out = []
    for t in thresholds:
        sizes = np.bincount(cut_tree(merges, n, t))
        out.append((t, int((sizes > 1).sum()), float(sizes[sizes > 1].sum() / max(1, n))))
    return out


def log_factor(n: int, df: int) -> float:
    return math.log(n / df)
