"""Toxicity by a chain of linear classifiers.

The labelled categories are predicted one after the other. Each model is a logistic regression over a text's words
and word beginnings, and over the probabilities of the categories before it in the chain. While training, those
earlier probabilities come out of folds: each row's is predicted by models that did not see it, so that a later
model learns how far an earlier one can be trusted on unseen text.

Features enter a model only if their link with the category is beyond chance, so ordinary words weigh exactly
nothing and long clean documents gather no score. Features add up over the distinct words of a text, so a word is
weighed once per task and a text costs one look-up for each.

A chain is fitted on at most ``MOST_LABELLED`` labelled rows (the smallest hashes of their ids); it judges all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes
from quern.llm.decontam import words_of

#: (label column, the value that counts as the category), in the chain's order.
CHAIN = (("quality", 0), ("toxic", 1))
MOST_LABELLED = 8_000
BINS = 1 << 20
FOLDS = 4
#: Least chi-square of a feature with the category: about one in 10^6 by chance.
LEAST_CHI2 = 24.0
LEAST_DOCS = 4
#: Lengths in bytes of the word beginnings that are features: inflected forms share them.
PREFIXES = (4, 5, 6)
L2 = 1e-3
STEPS = 300
CACHE_WORDS = 200_000
#: Rows handled at a time, so that long texts are not all held twice.
PART = 500
THRESHOLD = 0.5


def word_features(word: bytes) -> tuple[int, ...]:
    """Feature numbers of a word: itself and its beginnings."""
    return (xxhash.xxh3_64_intdigest(word) % BINS, *(xxhash.xxh3_64_intdigest(word[:n], seed=n) % BINS for n in PREFIXES if len(word) > n))


def features(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` and (bins, counts): the features of each text and the number of distinct words that have them."""
    kept = docs.select(*columns, as_bytes("text").alias("text"))
    inner = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, PART) for b in batches for at in range(0, b.num_rows, PART)):
            bins, counts = [], []
            for text in batch["text"].to_pylist():
                found = np.array([f for w in set(words_of(text)) for f in word_features(w)], np.int32)
                b, c = np.unique(found, return_counts=True)
                bins.append(b.astype(np.int32))
                counts.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bins, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], [*columns, "bins", "counts"])

    return kept.mapInArrow(run, inner + ", bins array<int>, counts array<int>")


class Model(NamedTuple):
    """A logistic regression: weights of bins, weights of earlier categories' probabilities, bias."""

    bins: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def margin(self, word_sum: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return word_sum + earlier @ self.earlier + self.bias


class Rows:
    """Labelled rows as sparse features: row starts, bins, values."""

    def __init__(self, bins: list[np.ndarray], counts: list[np.ndarray]):
        self.n = len(bins)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(b) for b in bins])
        self.bin = np.concatenate(bins) if bins else np.empty(0, np.int32)
        self.value = np.concatenate(counts).astype(np.float32) if counts else np.empty(0, np.float32)

    def sums(self, model: Model) -> np.ndarray:
        """Each row's sum of its features' weights."""
        if not len(model.bins):
            return np.zeros(self.n)
        at = np.minimum(np.searchsorted(model.bins, self.bin), len(model.bins) - 1)
        weight = np.where(model.bins[at] == self.bin, model.weights[at], 0.0)
        return np.bincount(self.row, weight * self.value, self.n)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: Rows, earlier: np.ndarray, label: np.ndarray, use: np.ndarray) -> Model:
    """Screens the features on the rows in ``use`` and fits by accelerated gradient descent."""
    n, positive = int(use.sum()), int(label[use].sum())
    if not positive or positive == n:
        return Model(np.empty(0, np.int64), np.empty(0), np.zeros(earlier.shape[1]), 35.0 if n and positive else -35.0)
    inside = use[rows.row]
    row, feature, value = rows.row[inside], rows.bin[inside], rows.value[inside]
    df = np.bincount(feature, minlength=BINS)
    hits = np.bincount(feature, label[row], BINS)
    p, q = positive / n, df / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = (hits - df * p) ** 2 / np.maximum(df * p * (1 - p) * (1 - q), 1e-12)
    good = (chi2 >= LEAST_CHI2) & (df >= LEAST_DOCS)
    names = np.flatnonzero(good)
    keep = good[feature]
    row, code, value = row[keep], (np.cumsum(good) - 1)[feature[keep]], value[keep].astype(float)
    index = np.full(rows.n, -1)
    index[use] = np.arange(n)
    row, y, dense = index[row], label[use].astype(float), earlier[use]
    d, k = len(names), earlier.shape[1]
    # features are scaled to unit root mean square, so one step size suits all
    scale = np.sqrt(np.maximum(np.bincount(code, value**2, d), 1.0) / n)
    value = value / scale[code]
    step = 4.0 / (1.0 + k + np.bincount(row, value**2, n).mean())
    w, c, b = np.zeros(d), np.zeros(k), float(np.log(p / (1 - p)))
    vw, vc, vb = w.copy(), c.copy(), b
    for t in range(1, STEPS + 1):
        gap = sigmoid(np.bincount(row, value * vw[code], n) + dense @ vc + vb) - y
        nw = vw - step * (np.bincount(code, value * gap[row], d) / n + L2 * vw)
        nc, nb = vc - step * (dense.T @ gap / n + L2 * vc), vb - step * gap.mean()
        m = t / (t + 3)
        vw, vc, vb = nw + m * (nw - w), nc + m * (nc - c), nb + m * (nb - b)
        w, c, b = nw, nc, nb
    return Model(names, w / scale, c, float(b))


def fit_chain(rows: Rows, labels: np.ndarray, folds: np.ndarray) -> list[Model]:
    """One model per label column. Later ones learn from out-of-fold probabilities of the earlier ones."""
    n, chain = rows.n, []
    earlier = np.zeros((n, 0))
    for j in range(labels.shape[1]):
        label = labels[:, j]
        chain.append(fit(rows, earlier, label, np.ones(n, bool)))
        held = np.zeros(n)
        for fold in range(FOLDS):
            out = folds == fold
            if out.any():
                model = fit(rows, earlier, label, ~out)
                held[out] = sigmoid(model.margin(rows.sums(model), earlier))[out]
        earlier = np.column_stack([earlier, held])
    return chain


def train(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, int], ...] = CHAIN, most: int = MOST_LABELLED) -> list[Model]:
    """Fit the chain on at most ``most`` documents that carry all its labels.

    Of a document's differing label rows the least counts, of its differing texts the greatest, so that each is learnt from once.
    """
    columns = [c for c, _ in chain]
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).dropna().groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("told"))
    wanted = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "told.*")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id")  # at most ``most`` ids
    # ids alone tell whether rows repeat one; unrepeated texts stay where they lie
    if texts.groupBy("doc_id").count().filter("count > 1").head(1):
        texts = texts.groupBy("doc_id", *columns).agg(F.max("text").alias("text"))
    # fitted by one task: the features of all its rows take more memory than a driver should give
    fitted = features(texts, ["doc_id", *columns]).repartition(1).mapInArrow(lambda batches: fit_batches(batches, chain), "models binary").head()
    return [Model(*m) for m in pickle.loads(fitted["models"])] if fitted else fit_chain(Rows([], []), np.empty((0, len(chain)), int), np.empty(0, int))


def fit_batches(batches: Iterator[pa.RecordBatch], chain: tuple[tuple[str, int], ...]) -> Iterator[pa.RecordBatch]:
    """The chain's models, pickled as one row, from the rows of ``features`` in the order of their ids; nothing from no rows."""
    some = list(batches)
    if not sum(b.num_rows for b in some):
        return
    found = pa.Table.from_batches(some).combine_chunks()
    order = np.argsort(found["doc_id"].to_numpy(), kind="stable")
    bins, counts = ([x[i].values.to_numpy() for i in order] for x in (found["bins"].combine_chunks(), found["counts"].combine_chunks()))
    y = np.column_stack([(found[c].to_numpy()[order] == value).astype(int) for c, value in chain])
    folds = np.array([xxhash.xxh32_intdigest(str(i)) % FOLDS for i in found["doc_id"].to_numpy()[order]])
    models = [tuple(m) for m in fit_chain(Rows(bins, counts), y, folds)]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(models)], pa.binary())], ["models"])


def scorer(models: list[tuple]) -> Callable[[bytes], list[float]]:
    """A function that gives a text's probability for each model of the chain. It holds a cache of words, so it belongs to one task."""
    tables = [dict(zip(bins.tolist(), weights.tolist(), strict=True)) for bins, weights, _, _ in models]
    rest = [(earlier.tolist(), bias) for _, _, earlier, bias in models]
    zero = (0.0,) * len(tables)
    cache: dict[bytes, tuple[float, ...]] = {}

    def weigh(word: bytes) -> tuple[float, ...]:
        if len(cache) > CACHE_WORDS:
            cache.clear()
        own = word_features(word)
        found = tuple(sum(t.get(f, 0.0) for f in own) for t in tables)
        cache[word] = found = found if any(found) else zero
        return found

    def one(text: bytes) -> list[float]:
        sums = [0.0] * len(tables)
        for word in set(words_of(text)):
            found = cache.get(word) or weigh(word)
            if found is not zero:
                for j, x in enumerate(found):
                    sums[j] += x
        out: list[float] = []
        for s, (earlier, bias) in zip(sums, rest, strict=True):
            margin = s + bias + sum(a * p for a, p in zip(earlier, out, strict=True))
            out.append(float(sigmoid(np.float64(margin))))
        return out

    return one


def parts_with_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batches in parts, and the texts of each part as bytes, null as no bytes."""
    for part in (b.slice(at, PART) for b in batches for at in range(0, b.num_rows, PART)):
        yield part, [(t or "").encode() for t in part["text"].to_pylist()]


def predict(docs: DataFrame, models: list[Model], names: list[str]) -> DataFrame:
    """doc_id and a probability ``p_<name>`` for each model of the chain."""
    shared = docs.sparkSession.sparkContext.broadcast([tuple(m) for m in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer(shared.value)
        for part, texts in parts_with_texts(batches):
            scores = zip(*map(one, texts), strict=True)
            yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, pa.float64()) for c in scores)], ["doc_id", *(f"p_{n}" for n in names)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long" + "".join(f", p_{n} double" for n in names))


def judge(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, int], ...] = CHAIN, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, a probability per category of the chain, and ``toxic``: whether the last category's reaches the threshold.

    Null or empty text has no features and gets the models' base rates. Null doc_ids are judged too. Labels without a
    document, and rows with a null label, are not learnt from; without any labelled row nothing is toxic. Repeated rows are
    judged each. An empty table gives an empty result. Other columns are ignored.
    """
    names = ["low_quality" if c == "quality" else c for c, _ in chain]
    scored = predict(docs, train(docs, labels, chain), names)
    return scored.withColumn("toxic", F.col(f"p_{names[-1]}") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, chain: tuple[tuple[str, int], ...] = CHAIN, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` less the rows whose last category's probability reaches the threshold. Columns stay, whatever their names.

    Null and empty texts get the models' base rates; rows that repeat a doc_id are judged each; rows without one are judged too. Without
    labelled rows all stay. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast([tuple(m) for m in train(docs, labels, chain)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = scorer(shared.value)
        for part, texts in parts_with_texts(batches):
            yield part.filter(pa.array([one(t)[-1] < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
