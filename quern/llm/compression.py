"""Quality rules by compression bands.

Zstandard shrinks repetitive text far more than prose and encoded or random text far less. Each whole
document and each fixed chunk of it must have a compressed-to-raw ratio inside the band for its length: short
inputs carry little context, so their bands are wider. What remains behind the last full chunk is a chunk too, with
the band for its length. A document outside its band, or with more than a stated share of its bytes or a stated run
of bytes in chunks outside theirs, is rejected. One pass over the texts, none of which is shuffled.

Fixed bands part text from what is not text. Where labels of quality are at hand, limits of whole documents are learnt within them for
each half octave of length: next to the extreme ratios of good documents that the base rules keep.
"""

from __future__ import annotations

from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, cut, map_rows


class Band(NamedTuple):
    """Ratios accepted for inputs of at most ``most_bytes`` bytes."""

    most_bytes: float
    low: float
    high: float


#: Ratios of zstandard level 3. The upper limits lie between prose and encoded or random text of each length, as measured: prose up to
#: 0.95 at 256 bytes, 0.79 at 512, 0.70 at 1 KB, 0.61 at 2 KB, 0.56 at 4 KB, 0.52 at 8 KB, 0.47 beyond; base64 from 0.95, 0.85, 0.80 and
#: 0.77 at the first four and 0.75 for long texts; random ASCII higher still. Hex digits, at 0.50 to 0.52 from 2 KB on, shrink like prose.
BANDS = (
    Band(64, 0.0, 3.0),
    Band(128, 0.40, 1.3),
    Band(256, 0.40, 1.0),
    Band(512, 0.42, 0.82),
    Band(1024, 0.38, 0.75),
    Band(2048, 0.33, 0.68),
    Band(4096, 0.30, 0.64),
    Band(8192, 0.28, 0.62),
    Band(32768, 0.25, 0.60),
    Band(float("inf"), 0.20, 0.58),
)
CHUNK_BYTES = 4096
#: A chunk's lower limit is wider than a document's of its length; its upper one is as far from prose (0.52) as from base64 (0.75).
CHUNK_BAND = (0.25, 0.63)
#: Share of a text's bytes that may lie in chunks outside their band.
MOST_BAD = 0.1
#: Bytes in neighbouring chunks outside their band from which a text of any length is rejected.
BAD_RUN = 2 * CHUNK_BYTES
#: A remainder of at most so many bytes says nothing by itself and belongs to the chunk before it.
LEAST_REMAINDER = 64
LEVEL = 3
#: Ratios are counted to so many digits while limits are learnt, so that a half octave's counts have a bounded size.
DIGITS = 5
#: Good documents that a half octave of length needs for limits of its own; with fewer the fixed band holds.
LEAST_GOOD = 100
#: Share of the good documents on each side that may be extreme by accident, and how far beyond it a limit lies.
TAIL, MARGIN = 0.005, 0.01

FIELDS = [
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("ratio", pa.float64()),
    ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64()), ("compression_failed", pa.bool_()), ("kept", pa.bool_()), ("length_step", pa.int64()),
]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, compression_failed boolean, kept boolean, length_step long"
SYMBOLS = b"#*$%&|<>"


def code_points(utf8: bytes) -> int:
    return len(utf8) if utf8.isascii() else len(utf8.decode("utf-8", "replace"))


def repeated_words(words: list[bytes]) -> int:
    """Words covered by the 3-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    # pairs get dense numbers before the third word joins, so that no product overflows
    pair = np.unique(ids[:-2] * len(number) + ids[1:-1], return_inverse=True)[1]
    _, window, count = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    hit = count[window] > 1
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + len(hit)] |= hit
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def length_step(size: int) -> int:
    """Half octaves of a length in bytes: 2 log2(size), rounded down; -1 for no bytes."""
    octave = size.bit_length() - 1
    return 2 * octave + (size * size >= 1 << (2 * octave + 1)) if size else -1


class CompressionJudge:
    """Measures one text; holds one compressor, so a judge belongs to one task."""

    def __init__(
        self, bands: tuple[Band, ...] = BANDS, chunk_bytes: int = CHUNK_BYTES, chunk_band: tuple[float, float] = CHUNK_BAND,
        most_bad: float = MOST_BAD, bad_run: int = BAD_RUN,
    ):
        self.bands, self.chunk_bytes, self.chunk_band, self.most_bad, self.bad_run = bands, chunk_bytes, chunk_band, most_bad, bad_run
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

    def ratio(self, raw: bytes) -> float:
        return len(self._zstd.compress(raw)) / len(raw)

    def band(self, size: int) -> tuple[float, float]:
        return next((b.low, b.high) for b in self.bands if size <= b.most_bytes)

    def cuts(self, size: int) -> list[int]:
        """Where the chunks of a text begin, and its end."""
        starts = list(range(0, size, self.chunk_bytes))
        if len(starts) > 1 and size - starts[-1] <= LEAST_REMAINDER:
            starts.pop()
        return [*starts, size]

    def __call__(self, text: bytes) -> tuple[float | None, int, int, bool]:
        """(ratio of the whole, chunks, those outside the band, failed). A text without bytes has no ratio and does not fail here."""
        if not text:
            return None, 0, 0, False
        ratio = self.ratio(text)
        low, high = self.band(len(text))
        cuts = self.cuts(len(text))
        bad = bad_bytes = run = longest = 0
        for at, end in pairwise(cuts):
            least, most = self.chunk_band if end - at >= self.chunk_bytes else self.band(end - at)
            if least <= (self.ratio(text[at:end]) if end - at < len(text) else ratio) <= most:
                run = 0
                continue
            bad += 1
            bad_bytes += end - at
            run += end - at
            longest = max(longest, run)
        return ratio, len(cuts) - 1, bad, not low <= ratio <= high or bad_bytes > self.most_bad * len(text) or longest >= self.bad_run


def learn_limits(docs: DataFrame, labels: DataFrame, **limits) -> dict[int, tuple[float, float]]:
    """Least and greatest ratio for each half octave of length, from all documents that every label row calls good (quality 1).

    Documents that the base rules or the fixed bands reject teach nothing. A doc_id teaches once, by its least text's figures.
    """
    return limits_of(measure(docs, **limits), labels)


def limits_of(measured: DataFrame, labels: DataFrame) -> dict[int, tuple[float, float]]:
    """``learn_limits`` from what ``measure`` found: no text is moved."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("least"))
    seen = measured.filter("kept").select("doc_id", "length_step", "ratio").join(told.filter("least = 1").select("doc_id"), "doc_id")
    once = seen.groupBy("doc_id").agg(F.min(F.struct("length_step", "ratio")).alias("x")).select("x.length_step", F.round("x.ratio", DIGITS).alias("ratio"))
    counted = once.groupBy("length_step", "ratio").agg(F.count("*").alias("n"))
    tails = counted.groupBy("length_step").agg(F.percentile("ratio", [TAIL, 1 - TAIL], F.col("n")).alias("tails"), F.sum("n").alias("n")).filter(F.col("n") >= LEAST_GOOD)
    return {r["length_step"]: (r["tails"][0] * (1 - MARGIN), r["tails"][1] * (1 + MARGIN)) for r in tails.collect()}  # two for each octave of lengths


def judge(docs: DataFrame, labels: DataFrame | None = None, **limits) -> DataFrame:
    """One row per input row: word and line statistics, the base rules' verdict, the compression verdict.

    With ``labels`` (doc_id, quality) the limits of whole documents are learnt from the good ones; without any, the fixed bands hold.
    Null or empty text: no words, so ``base_failed`` and not kept; its ratio is null. Null doc_id is carried through.
    Repeated rows are judged each by itself; other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    measured = measure(docs, **limits)
    if labels is None:
        return measured
    # texts are read once: what was measured is kept, and the learnt limits are laid over it
    measured = cut(measured, "quality")
    rows = [(step, low, high) for step, (low, high) in limits_of(measured, labels).items()]
    learnt = docs.sparkSession.createDataFrame(rows, "length_step long, __low double, __high double")  # two for each octave of lengths
    judged = measured.join(F.broadcast(learnt), "length_step", "left")
    outside = F.coalesce(~F.col("ratio").between(F.col("__low"), F.col("__high")), F.lit(False))
    judged = judged.withColumn("compression_failed", F.col("compression_failed") | outside).withColumn("kept", F.col("kept") & ~outside)
    return judged.select(measured.columns)


def measure(docs: DataFrame, **limits) -> DataFrame:
    """What ``judge`` returns by the fixed bands, in one pass."""

    def make():
        compression = CompressionJudge(**limits)

        def one(doc_id: int | None, text: bytes) -> tuple:
            words = text.split()
            n, repeats = len(words), repeated_words(words)
            failed = n < 50 or 100 * repeats > 50 * n
            ratio, chunks, bad, out_of_band = compression(text)
            symbols = sum(text.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
            return doc_id, n, sum(map(code_points, words)), symbols, duplicate_lines(text), repeats, failed, ratio, chunks, bad, out_of_band, not (failed or out_of_band), length_step(len(text))

        return one

    return map_rows(docs.select(F.col("doc_id").cast("long"), as_bytes("text")), make, SCHEMA, FIELDS)
