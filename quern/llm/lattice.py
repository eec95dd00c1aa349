"""Subword lattice likelihood.

The model is a unigram over the pieces of an existing vocabulary: a text's probability is the sum over all its
segmentations into pieces, found by a forward recursion in log space. No piece reaches over a word's start, so
the lattice of a text falls into the lattices of its words, joined by products: each distinct word is scored once,
and texts only add up logarithms.

Piece weights come from the training documents: every distinct training word is segmented by the vocabulary's
own scores, pieces are counted with the words' frequencies, and pseudo-counts that follow the vocabulary's order
smooth pieces the corpus lacks. Words missing from the vocabulary's characters fall back to bytes.

The most frequent words, at most ``HEAD_TOKENS`` of at most ``HEAD_BYTES`` bytes, are broadcast; occurrences of all others
join the word table, so the vocabulary may grow with the corpus without bound.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import exp, inf, log, log1p, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, cut, slices, to_batches

VOCABULARY = "piece_bpe_32k.model"
HEAD_TOKENS = 100_000
HEAD_BYTES = 64
#: Pseudo-counts in all, dealt over the pieces by 1 / (rank + 10).
PRIOR = 10_000.0
MARK = "▁"
FOLDS, HELD_OUT = 5, 1
LN10 = log(10.0)


def is_held_out(doc_id: int | None) -> bool:
    """By the CRC-32 of the id as text; a null id is the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


class Pieces:
    """The vocabulary: what the lattice may use, and the pseudo-counts its order gives."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
        self.size = sp.get_piece_size()
        self.end = sp.eos_id()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        special = {i for i in range(self.size) if sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i)}
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        bytes_here = set(self.byte_ids)
        # a mark inside a piece would join two words
        self.texts = {p: i for i, p in enumerate(pieces) if i not in special and i not in bytes_here and MARK not in p[1:]}
        usable = sorted([*self.texts.values(), *self.byte_ids, self.end], key=lambda i: (-sp.get_score(i), i))
        self.prior = np.zeros(self.size)
        self.prior[usable] = 1 / (np.arange(len(usable)) + 10.0)
        self.prior *= PRIOR / self.prior.sum()

    def counts(self, words: list[str], weights: list[int]) -> np.ndarray:
        """Pieces in the vocabulary's own segmentation of the words, weighted."""
        found = self.processor.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int64, int(sizes.sum()))
        return np.bincount(flat, np.repeat(np.asarray(weights, float), sizes), self.size)


class Lattice:
    """Marginal log10 probabilities of words under given piece log weights (natural, by id)."""

    def __init__(self, pieces: Pieces, log_weights: np.ndarray):
        # every prefix of a piece is a key, so that a walk ends where no longer piece can match
        self.table: dict[str, float | None] = {}
        for text, i in pieces.texts.items():
            for n in range(1, len(text)):
                self.table.setdefault(text[:n], None)
        for text, i in pieces.texts.items():
            self.table[text] = float(log_weights[i])
        self.bytes = [float(log_weights[i]) for i in pieces.byte_ids]

    def word(self, word: str) -> float:
        """Forward recursion over the lattice of one word."""
        text, table = MARK + word, self.table
        n, end = len(text), object()
        alpha = [-inf] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            here = alpha[i]
            if here == -inf:
                continue
            j, single = i + 1, False
            while j <= n:
                weight = table.get(text[i:j], end)
                if weight is end:
                    break
                if weight is not None:
                    single = single or j == i + 1
                    alpha[j] = _add(alpha[j], here + weight)
                j += 1
            if not single:
                alpha[i + 1] = _add(alpha[i + 1], here + sum(self.bytes[b] for b in text[i].encode("utf-8", "surrogatepass")))
        return alpha[n] / LN10


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -inf else a + log1p(exp(b - a))


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c): words of all documents and their occurrences in training documents, gathered per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        fields = [("token", pa.binary()), ("c", pa.int64())]
        for rows in slices(batches):
            for doc_id, text in rows:
                words = text.lower().split()
                if is_held_out(doc_id):
                    for w in words:
                        train.setdefault(w, 0)
                else:
                    train.update(words)
            if len(train) > 400_000:  # bounded memory; the sums meet after the shuffle
                yield from to_batches(list(train.items()), fields)
                train.clear()
        yield from to_batches(list(train.items()), fields)

    return docs.select(F.col("doc_id").cast("long"), as_bytes("text")).mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def piece_weights(counts: DataFrame, n_texts: int, vocabulary: str | None = None) -> np.ndarray:
    """Natural log weights by piece id, from the counted words of the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(vocabulary)
        total = np.zeros(pieces.size)
        for rows in slices(batches, 2000):
            total += pieces.counts([w.decode("utf-8", "replace") for w, _ in rows], [c for _, c in rows])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    summed = counts.filter("c > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # at most the vocabulary
    pieces = Pieces(vocabulary)
    weights = pieces.prior.copy()
    weights[summed["piece"].to_numpy(np.int64)] += summed["n"].to_numpy()
    weights[pieces.end] += n_texts
    with np.errstate(divide="ignore"):
        return np.log(weights / weights.sum())


def scored_tokens(counts: DataFrame, log_weights: np.ndarray, vocabulary: str | None = None) -> DataFrame:
    """(token, c, lm): each distinct word's marginal log10 probability."""
    shared = counts.sparkSession.sparkContext.broadcast(log_weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(Pieces(vocabulary), shared.value)
        for rows in slices(batches, 2000):
            yield from to_batches([(w, c, lattice.word(w.decode("utf-8", "replace"))) for w, c in rows], [("token", pa.binary()), ("c", pa.int64()), ("lm", pa.float64())])

    return counts.select("token", "c").mapInArrow(run, "token binary, c long, lm double")


def score_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words and one end. Null or empty text is the end alone. Null doc_id counts as the empty text when
    folds are dealt. Repeated rows are learnt from and scored each. An empty table gives an empty result; with no training
    document the pieces keep their pseudo-counts. Other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = cut(token_counts(texts), "token-counts")
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    n_train = texts.agg(F.count_if(F.crc32(id_text) % FOLDS != HELD_OUT).alias("n")).head()["n"] or 0
    told = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).head()
    total, distinct = (told["n"] or 0) + n_train, (told["v"] or 0) + (n_train > 0)
    log_weights = piece_weights(counts, n_train, vocabulary)
    tokens = cut(scored_tokens(counts, log_weights, vocabulary), "tokens")
    head = tokens.filter(F.octet_length("token") <= HEAD_BYTES).orderBy(F.desc("c"), "token").limit(HEAD_TOKENS).toArrow()
    shared = spark.sparkContext.broadcast((head["token"].to_pylist(), head["c"].to_numpy(), head["lm"].to_numpy()))
    scale = total + 0.5 * (distinct + 1)
    end_lm = float(log_weights[Pieces(vocabulary).end]) / LN10
    end_base = log10((n_train + 0.5) / scale)
    rare = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("rare", rare)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cs, lms = shared.value
        known = {w: (c > 0, b, m) for w, c, b, m in zip(words, cs.tolist(), np.log10((cs + 0.5) / scale).tolist(), lms.tolist(), strict=True)}
        for rows in slices(batches):
            out = []
            for doc_id, text in rows:
                found = Counter(text.lower().split())
                n_known, base, lm, others = int(n_train > 0), end_base, end_lm, []
                for w, n in found.items():
                    entry = known.get(w)
                    if entry is None:
                        others.append({"token": w, "n": n})
                    else:
                        n_known += n * entry[0]
                        base += n * entry[1]
                        lm += n * entry[2]
                out.append((doc_id, is_held_out(doc_id), sum(found.values()) + 1, n_known, base, lm, others))
            yield from to_batches(out, fields)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<token:binary,n:long>>"
    partial = cut(texts.select("doc_id", as_bytes("text")).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    occurrences = partial.select("row", F.inline("rare"))
    base = F.log10((F.col("c") + 0.5) / F.lit(scale))
    rest = occurrences.join(tokens, "token").groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * base).alias("more_base"), F.sum(F.col("n") * F.col("lm")).alias("more_lm"))
    both = partial.drop("rare").join(rest, "row", "left")
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_lm", F.lit(0.0))).alias("score"),
    )
