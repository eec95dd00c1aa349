"""Best-fit-decreasing packing of tokenised documents into sequences.

Pieces of one length are interchangeable, and there are at most ``capacity`` lengths. So the driver packs the
histogram of lengths, not the pieces: longest first, each into the open bin with the least room that still holds
it, found by a segment tree over remaining capacities. Bins with the same room are ranges of numbers; a range
takes all the pieces of a length at once, exactly as one-by-one best fit would. Every time a range is used its
room falls below half, so the plan stays under ``24 * capacity`` rows however many documents there are, and is
broadcast. Each piece then finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, slices

CAPACITY = 2048
VOCABULARY = "byte_bpe_50k"
END_ID = 0
#: The one string that the tokenizer file adds to its byte-level vocabulary.
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of the byte-level BPE file. The same vocabulary as ranks encodes several times faster and to the same ids; texts with
    the special string, which ranks do not know, go through the tokenizer file itself."""

    def __init__(self, folder: str | None = None, name: str = VOCABULARY):
        import public_tokenizers
        import tiktoken

        self._json = f"{folder}/{name}.json" if folder else public_tokenizers.path(f"{name}.json")
        ranks_file = f"{folder}/{name}.tiktoken" if folder else public_tokenizers.path(f"{name}.tiktoken")
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._full = None

    def __call__(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self._ranks.encode_ordinary(text)
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self._json)
        return self._full.encode(text, add_special_tokens=False).ids


def piece_starts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of n ids: whole if it fits, else full pieces after a first one that takes what is over."""
    if n <= capacity:
        return [0]
    first = n % capacity
    return ([0] if first else []) + list(range(first, n, capacity))


class CapacityTree:
    """Segment tree over remaining capacities: which have open bins, and the least that is large enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        at = room + self.size
        self.open[at] = is_open
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` with an open bin."""
        at = length + self.size
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, pieces per bin, first bin, first offset) that place the pieces of each length by rank."""
    tree, ranges, bins, plan = CapacityTree(capacity), {}, 0, []

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            ranges.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = ranges[room].pop()
                if not ranges[room]:
                    tree.set(room, False)
            each = room // length
            used = min(left, n * each)
            plan.append((length, rank, each, first, capacity - room))
            full, over = divmod(used, each)
            leave(room - each * length, first, full)
            if over:
                leave(room - over * length, first + full, 1)
            touched = full + (over > 0)
            leave(room, first + touched, n - touched)
            left, rank = left - used, rank + used
    return plan


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def tokenised_pieces(docs: DataFrame, capacity: int, folder: str | None, with_ids: bool) -> DataFrame:
    """The pieces of every row, with the writing task and the rank among that task's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = Encoder(folder), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for rows in slices(batches, 64):
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids")}
            for doc_id, text in rows:
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                starts = piece_starts(len(ids), capacity)
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    for name, value in (("doc_id", doc_id), ("piece", piece), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(ids[a:b].tobytes())), ("rank", seen[b - a])):
                        out[name].append(value)
                    seen[b - a] += 1
                    if with_ids:
                        out["ids"].append(ids[a:b].astype(np.int32))
            n = len(out["piece"])
            arrays = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")), pa.array([part] * n, pa.int32()), pa.array(out["rank"], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if with_ids:
                arrays.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_SCHEMA + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer_folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Null or empty text is the single end id. Repeated rows and null doc_ids are packed like any others, each row on its own. An
    empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = cut(tokenised_pieces(docs, capacity, tokenizer_folder, with_ids), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = cut(counts, "lengths")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = np.array(sorted(best_fit_plan(total, capacity)), np.int64).reshape(-1, 5)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("length", "part", before.alias("before")), ["length", "part"])
    shared = spark.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        # one sorted key for (length, rank); 2^48 pieces of one length are room enough
        key = table[:, 0] * (1 << 48) + table[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["global_rank"].to_numpy()
            row = table[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length
            kept = [n for n in batch.schema.names if n != "global_rank"]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long," + "ids array<int>," * with_ids + "sequence_id long, offset long"
    return ranked.select(*columns, (F.col("rank") + F.col("before")).alias("global_rank")).mapInArrow(place, schema)


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, tokenizer_folder: str | None = None) -> DataFrame:
    """The sequences themselves: sequence_id, ids, and doc_ids in order. A group holds at most ``capacity`` ids."""
    pieces = pack(docs, capacity, tokenizer_folder, with_ids=True)
    rows = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(rows.alias("r")).select("sequence_id", F.flatten(F.col("r.ids")).alias("ids"), F.col("r.doc_id").alias("doc_ids"))
