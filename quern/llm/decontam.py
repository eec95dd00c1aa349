"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items go into one automaton over word numbers. Training text streams through it: the state
and the matched length after each word give the longest item substring ending there. A window is a run of
``window`` item words, or a whole shorter item; whenever the matched length reaches a window, its words are hit
and the automaton's state names the items it belongs to. An automaton is built for blocks of items of bounded
size, so that neither the driver nor a worker ever holds more than one block, however large the item table is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, cut, slices, to_batches, unused
from quern.llm.linededup import restore

WINDOW = 10
#: UTF-8 bytes of item text in one automaton; more items make more automata, each streamed over all documents.
BLOCK_BYTES = 8 << 20
#: Rows handled at a time, so that long texts are not all held twice.
PART = 256

#: ASCII letters (lower-cased), digits and every byte of a non-ASCII code point make words; all else divides them.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the words, in order."""
    spans, at = [], 0
    folded = text.translate(FOLD)
    for word in folded.split():
        at = folded.index(word, at)
        spans.append((at, at + len(word)))
        at += len(word)
    return spans


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences with, per window, the items that hold it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        coded = [(place[name], [self.number.setdefault(w, len(self.number)) for w in words]) for name, words in items if words]
        for _, word_ids in coded:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        #: State -> [(window length, items)], for the windows whose state it is.
        ends: dict[int, dict[int, set[int]]] = {}
        for item, word_ids in coded:
            need, state, matched = min(window, len(word_ids)), 0, 0
            for w in word_ids:
                state, matched = self.next[state][w], matched + 1
                while self.length[self.link[state]] >= need:
                    state = self.link[state]
                    matched = self.length[state]
                if matched >= need:
                    ends.setdefault(state, {}).setdefault(need, set()).add(item)
        #: For each state all windows that end there, its own and those of its suffixes: (longest-first lengths, items).
        self.windows: list[list[tuple[int, frozenset[int]]]] = [[] for _ in self.next]
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = [(n, frozenset(who)) for n, who in ends.get(s, {}).items()]
            self.windows[s] = sorted(own + self.windows[self.link[s]], key=lambda x: -x[0])
        self.shortest = min((min(window, len(ids)) for _, ids in coded), default=window)
        size = max(1, len(self.number))
        pairs = {a * size + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p == -1:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone], self.link[q] = self.link[q], clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(hit spans [start, end) in words, numbers of the items with a window that occurs)."""
        get, n = self.number.get, len(words)
        ids = np.fromiter((get(w, -1) for w in words), np.int64, n)
        # Where two neighbouring words never stand together in an item the automaton falls back below two words, so only
        # stretches between such places can reach a window of two words or more.
        if self.shortest >= 2:
            if n < self.shortest or not len(self.pairs):
                return [], set()
            code = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(self.number) + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (self.pairs[at] == code).view(np.int8), [0]))))
            stretches = [(a, b + 1) for a, b in edges.reshape(-1, 2).tolist() if b + 1 - a >= self.shortest]
        else:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
            stretches = edges.reshape(-1, 2).tolist()
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        step, link, length, windows = self.next, self.link, self.length, self.windows
        for start, end in stretches:
            state = matched = 0
            for i in range(start, end):
                w = int(ids[i])
                while state and w not in step[state]:
                    state = link[state]
                    matched = length[state]
                if w in step[state]:
                    state, matched = step[state][w], matched + 1
                longest = 0
                for need, items in windows[state]:
                    if need <= matched:
                        longest = longest or need
                        found |= items
                if longest:
                    a = i + 1 - longest
                    if spans and a <= spans[-1][1]:
                        spans[-1] = (min(a, spans[-1][0]), i + 1)
                    else:
                        spans.append((a, i + 1))
        return spans, found


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The items dealt into as many blocks as their total size asks for. An item's repeated rows stay in one block."""
    total = benchmark.agg(F.sum(F.octet_length("text")).alias("b")).head()["b"] or 0
    blocks = int(total // block_bytes) + 1
    return [benchmark.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks)]


def clean_items(benchmark: DataFrame) -> DataFrame:
    return benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")


def share_block(block: DataFrame) -> Broadcast:
    """The block's items for the executors: at most a block's bytes, unless one item alone is larger."""
    return block.sparkSession.sparkContext.broadcast({"items": [(r["item_id"], words_of(r["text"].encode())) for r in block.collect()]})


def automaton_of(shared: dict, window: int) -> SuffixAutomaton:
    """The automaton of a shared block. It stays with the block, so that a worker builds it once for all its tasks."""
    if window not in shared:
        shared[window] = SuffixAutomaton(shared["items"], window)
    return shared[window]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of words) and item_ids.

    Null text has no words; null item_id or item text takes no part; repeated items count once; rows sharing a doc_id are each
    judged by themselves. An empty item table leaves every document clean.
    """
    shares = [share_block(b) for b in item_blocks(clean_items(benchmark), block_bytes)]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if len(shares) == 1:
        return finish(scan(shares[0], source, window))
    # several automata: each leaves its own spans, which meet again by row
    keyed = cut(source.withColumn("row", F.monotonically_increasing_id()), "decontam")
    gathered = gather(shares, keyed.select("row", "text"), window)
    return finish(gathered.join(keyed.select("row", "doc_id"), "row").drop("row"))


def scan(shared: Broadcast, source: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, spans, item_ids) for each row of (doc_id, text): what one automaton finds."""
    schema = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, item_ids array<string>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shared.value, window)
        for rows in slices(batches):
            out = []
            for doc_id, text in rows:
                words = words_of(text)
                spans, found = automaton.stream(words)
                out.append((doc_id, len(words), [{"start": a, "end": b} for a, b in spans], sorted(automaton.names[i] for i in found)))
            yield from to_batches(out, [("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", span), ("item_ids", pa.list_(pa.string()))])

    return source.select("doc_id", as_bytes("text")).mapInArrow(run, schema)


def gather(shares: list[Broadcast], keyed: DataFrame, window: int) -> DataFrame:
    """(row, n_words, spans, item_ids) for each row of (row, text): what the automata of all blocks find."""
    parts = [scan(s, keyed.select(F.col("row").alias("doc_id"), "text"), window).withColumnRenamed("doc_id", "row") for s in shares]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("item_ids")).alias("item_ids"))


def finish(found: DataFrame) -> DataFrame:
    spans = F.array_sort("spans")
    merged = F.aggregate(
        spans, F.expr("named_struct('upto', 0L, 'hit', 0L)"),
        lambda acc, s: F.struct(F.greatest(acc["upto"], s["end"]).alias("upto"), (acc["hit"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["upto"], s["start"]))).alias("hit")),
    )["hit"]
    return found.withColumn("item_ids", F.array_sort("item_ids")).select(
        "doc_id", "n_words", merged.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans", "item_ids",
    )


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """In order, without overlap; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from each span's first word to its last; what stood around it stays. Spans are merged ones."""
    places, out, at = word_spans(text), [], 0
    for start, end in spans:
        out.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def hit_words(spans: list[tuple[int, int]]) -> int:
    return sum(end - start for start, end in spans)


def decontaminate_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, most_coverage: float = 0.8) -> DataFrame:
    """``docs`` without the hit spans; a document more than ``most_coverage`` of whose words are hit goes. Columns stay, n_chars is counted anew.

    What a cut joins may be a hit again, so cutting goes on until no item is left. Each time the spans of all items are taken
    together, however many blocks hold them, and coverage is their words of all rounds over the words at first: the size of a block changes no row.
    Null and empty texts stay as they are, as do rows without a doc_id; repeated rows are cut each. An empty item table leaves every row. An
    empty table stays empty.
    """
    shares = [share_block(b) for b in item_blocks(clean_items(benchmark), block_bytes)]
    freed = _free_in_place(shares[0], docs, window, most_coverage) if len(shares) == 1 else _free_in_rounds(shares, docs, window, most_coverage)
    return restore(freed, docs)


def _free_in_place(shared: Broadcast, docs: DataFrame, window: int, most_coverage: float) -> DataFrame:
    """One pass where one automaton holds all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(shared.value, window)

        def free(text: str | None) -> tuple[bool, str | None]:
            if text is None:
                return True, None
            raw, n, hit = text.encode(), None, 0
            while True:
                words = words_of(raw)
                n = len(words) if n is None else n
                spans = merge_spans(automaton.stream(words)[0])
                if not spans:
                    return True, raw.decode()
                hit += hit_words(spans)
                if hit > most_coverage * n:
                    return False, None
                raw = cut_spans(raw, spans)

        for part in (b.slice(at, PART) for b in batches for at in range(0, b.num_rows, PART)):
            kept, texts = zip(*map(free, part["text"].to_pylist()), strict=True)
            at = part.schema.get_field_index("text")
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type)).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _free_in_rounds(shares: list[Broadcast], docs: DataFrame, window: int, most_coverage: float) -> DataFrame:
    """Rounds over all blocks. Only documents that a round cut go into the next; every round but the last takes words away."""
    row, new = unused(docs, "row"), unused(docs, "new")
    keyed = cut(docs.withColumn(row, F.monotonically_increasing_id()), "decontam")
    schema = "row long, text string, total long, hit long"
    fields = [("row", pa.int64()), ("text", pa.string()), ("total", pa.int64()), ("hit", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            out = []
            for number, text, total, hit, spans in rows:
                merged = merge_spans([(s["start"], s["end"]) for s in spans])
                hit += hit_words(merged)
                out.append((number, None if hit > most_coverage * total else cut_spans(text, merged).decode(), total, hit))
            yield from to_batches(out, fields)

    active = keyed.select(F.col(row).alias("row"), "text", F.lit(None).cast("long").alias("total"), F.lit(0).cast("long").alias("hit"))
    rounds: list[DataFrame] = []  # of a row the last counts; a null text is a document that goes
    while True:
        found = gather(shares, active, window).filter(F.size("spans") > 0)
        joined = active.join(found, "row").select("row", as_bytes("text"), F.coalesce("total", "n_words"), "hit", "spans")
        rounds.append(cut(joined.mapInArrow(run, schema), "decontam-round"))
        active = rounds[-1].filter("text is not null")
        if not active.head(1):
            break
    last = [r.join(after.select("row"), "row", "left_anti") for r, after in pairwise(rounds)] + rounds[-1:]
    changed = reduce(DataFrame.unionByName, last).select(F.col("row").alias(row), F.struct("text").alias(new))
    text = F.when(F.col(new).isNull(), F.col("text")).otherwise(F.col(new)["text"])
    return keyed.join(changed, row, "left").filter(F.col(new).isNull() | F.col(new)["text"].isNotNull()).withColumn("text", text).drop(row, new)
