"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (line hash, number of documents, largest document), bucketed and sorted by the hash, so
that runs merge without shuffling. Each batch of documents is reduced to its own lines; a merge-anti-join with
the older runs parts them: lines that no run holds become a new run at level 0, lines that one holds only leave their
count and largest document behind as updates. So a line stands in one run only, and what is written for a batch is
what is new in it. When a level holds ``fanout`` runs they are compacted into one of the next level. Hashes have 128 bits: at
10^13 lines a false match stays below one in 10^12.

Only hashes, counts and ids move before the last step; a line that half of all documents hold is one row per
task after the partial aggregation, and its occurrences meet their one run row where they lie.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, cut, partitions, remove, shared_path, slices, to_batches, unused

LEAST_CHARS = 20
LEAST_DOCS = 3
#: Documents of one batch, and batches at least: with four the second level fills.
BATCH_DOCS = 1 << 30
LEAST_BATCHES = 4
FANOUT = 2
#: The share of all occurrences, inverted, over which a line is handled where it lies; so many such lines exist at most.
HOT_LINES = 5000
HASH = ["h1", "h2"]


def line_key(line: bytes) -> bytes:
    """Stripped of ASCII white space, A-Z lower-cased; bytes methods do exactly that and leave other code points alone."""
    return line.strip().lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", "replace")) >= least)


def line_digests(text: bytes, least: int) -> list[bytes | None]:
    """A digest for each line, None where its key is too short to count."""
    keys = map(line_key, text.split(b"\n"))
    return [xxhash.xxh3_128_digest(k) if long_enough(k, least) else None for k in keys]


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, h1, h2) once for each document row and long line. Rows without a doc_id give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            ids: list[int] = []
            digests: list[bytes] = []
            for doc_id, text in rows:
                own = {d for d in line_digests(text, least_chars) if d}
                ids += [doc_id] * len(own)
                digests += own
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", *HASH])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), as_bytes("text")).mapInArrow(run, "doc_id long, h1 long, h2 long")


class LineRuns:
    """The levelled runs. They live as bucketed tables under the session's shared folder, until ``drop``."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.buckets = spark, fanout, partitions(spark)
        self.levels: list[list[tuple[str, str]]] = []
        self.updates: list[DataFrame] = []

    def _write(self, run: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_path(self.spark, "line-run")
        run.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"drop table {run[0]}")
        remove(self.spark, run[1])

    def drop(self) -> None:
        """Remove all runs' tables and files."""
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    @staticmethod
    def _merge(left: DataFrame, right: DataFrame) -> DataFrame:
        """Two runs, which share no line, into one: a full outer merge join keeps the bucketing that a union would lose."""
        a, b = left.alias("a"), right.alias("b")
        return a.join(b, HASH, "full_outer").select(*HASH, *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("n_docs", "last_doc")))

    def add(self, lines: DataFrame) -> None:
        """Add a batch of (doc_id, h1, h2), once per document and line."""
        own, older = self._write(lines.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))), self.runs()
        if not older:
            self._add(own, 0)
            return
        fresh = known = self.spark.table(own[0])
        for run in older:
            fresh = fresh.join(run.hint("merge"), HASH, "left_anti")
        fresh_run = self._write(fresh)
        self.updates.append(cut(known.join(self.spark.table(fresh_run[0]).hint("merge"), HASH, "left_anti"), "line-updates"))
        self._drop(own)
        self._add(fresh_run, 0)

    def _add(self, run: tuple[str, str], level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """Merge a level's runs into one run of the next level."""
        old, self.levels[level] = self.levels[level], []
        merged = self._write(reduce(self._merge, (self.spark.table(name) for name, _ in old)))
        for run in old:
            self._drop(run)
        self._add(merged, level + 1)

    def merged(self) -> DataFrame:
        """(h1, h2, n_docs, last_doc) of every line: each run's with the updates that came after it."""
        lines = reduce(self._merge, self.runs())
        if not self.updates:
            return lines
        later = reduce(DataFrame.unionByName, self.updates).groupBy(*HASH).agg(F.sum("n_docs").alias("n_more"), F.max("last_doc").alias("last_more"))
        return lines.join(later, HASH, "left").select(*HASH, (F.col("n_docs") + F.coalesce("n_more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "last_more").alias("last_doc"))


def doomed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, doomed): for each document that loses lines, the digests of their keys."""
    spark = docs.sparkSession
    batches = batches or max(LEAST_BATCHES, -(-docs.count() // BATCH_DOCS))
    found = occurrences(docs, least_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    # rows that share a doc_id are one document; ids alone tell whether there are any, at a fraction of the lines' cost
    if docs.groupBy("doc_id").count().filter("doc_id is not null and count > 1").head(1):
        found = found.distinct()
    found = cut(found, "lines", ["batch"])
    index = LineRuns(spark, fanout)
    for batch in range(batches):
        index.add(found.filter(F.col("batch") == batch).drop("batch"))
    shared = cut(index.merged().filter(F.col("n_docs") >= least_docs).select(*HASH, "n_docs", "last_doc"), "shared-lines")
    index.drop()
    # At most HOT_LINES lines can each hold 1 / HOT_LINES of all occurrences: these meet theirs where they lie, so that
    # no task gets all occurrences of a line; the rest meet by hash.
    often = F.col("n_docs") > found.count() // HOT_LINES
    hot, rest = F.broadcast(shared.filter(often)), shared.filter(~often)
    lost = found.join(hot, HASH).unionByName(found.join(hot, HASH, "left_anti").join(rest, HASH), allowMissingColumns=True).filter("doc_id <> last_doc")
    return lost.groupBy("doc_id").agg(F.collect_list(F.struct(*HASH)).alias("doomed"))


def keep_lines(text: bytes, doomed: set[bytes], least_chars: int) -> tuple[int, int, bytes]:
    lines = text.split(b"\n")
    if not doomed:
        return len(lines), 0, text
    kept = [line for line, d in zip(lines, line_digests(text, least_chars), strict=True) if d not in doomed]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def dedup_lines(docs: DataFrame, with_text: bool = True, **limits) -> DataFrame:
    """Per document row: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, the kept text.

    A key held by at least ``least_docs`` documents stays only in the largest doc_id that holds it. Null or empty text is one
    empty line. Rows without a doc_id take no part and keep all their lines. Rows sharing a doc_id count as one document and
    are rewritten each. An empty table gives an empty result. Other columns are ignored.
    """
    least_chars = limits.get("least_chars", LEAST_CHARS)
    texts = docs.select(F.col("doc_id").cast("long"), as_bytes("text").alias("text"))
    joined = texts.join(doomed_lines(docs, **limits), "doc_id", "left").select("doc_id", "text", "doomed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            out = []
            for doc_id, text, doomed in rows:
                gone = set(np.array([(d["h1"], d["h2"]) for d in doomed], ">i8").tobytes()[i : i + 16] for i in range(0, 16 * len(doomed), 16)) if doomed else set()
                n, dropped, kept = keep_lines(text, gone, least_chars)
                out.append((doc_id, n, dropped, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
            yield from to_batches(out, fields)

    fields = [("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), *([("kept_text", pa.string())] if with_text else [])]
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * with_text)


def dedup_line_documents(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with each text reduced to the lines it keeps and n_chars, if there, counted anew. Columns stay, whatever their names, and rows do.

    Null and empty texts stay as they are, as do rows without a doc_id; rows sharing a doc_id count as one document and are rewritten each.
    An empty table stays empty.
    """
    least_chars = limits.get("least_chars", LEAST_CHARS)
    key, lost = unused(docs, "key"), unused(docs, "lost")
    doomed = doomed_lines(docs, **limits).select(F.col("doc_id").alias(key), F.col("doomed").alias(lost))
    joined = docs.join(doomed, docs["doc_id"] == doomed[key], "left").drop(key)

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, gone: pd.Series) -> pd.Series:
        def one(t, d):
            if t is None or d is None or not len(d):
                return t
            raw = np.array([(x["h1"], x["h2"]) for x in d], ">i8").tobytes()
            return keep_lines(t.encode(), {raw[i : i + 16] for i in range(0, len(raw), 16)}, least_chars)[2].decode()

        return pd.Series([one(t, d) for t, d in zip(text, gone, strict=True)], dtype=object)

    out = joined.withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(rewrite("text", lost)))
    return restore(out.drop(lost), docs)


def restore(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order, n_chars set to the new text's length."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
