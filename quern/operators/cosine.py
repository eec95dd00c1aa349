"""Cosine of tf-idf vectors: some documents against all.

Documents become blocks of counts. Of a block only its distinct terms move, to learn in how many documents they occur; then each block
of asked documents is multiplied with each block of all. Neither a row per document and term nor one per pair and term exists. All that
is kept or moved is compressed: whole columns of numbers, and terms in buckets; of a term that one block alone has nothing returns.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.terms import token_rows
from quern.plans.shared import cut

#: A block ends with the document that reaches one of these; asked documents have blocks of their own.
BLOCK_DOCS, BLOCK_ENTRIES, ASKED_DOCS = 2_048, 1_000_000, 512
#: A bucket of terms, or a task, for so many blocks.
BLOCKS = 4
#: Terms multiplied at once as a dense matrix, terms that rarely meet at once as pairs of entries, and rows of an Arrow batch.
DENSE_TERMS, SPARSE_PAIRS, OUT_ROWS = 512, 4_000_000, 100_000
#: Bits of a term's place within a block, and of a block's number within a task.
PLACE, BLOCK = 30, 16
#: All bytes of lower-cased text that belong to no term, as spaces.
SPACED = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 32 for c in range(256))


def cosine_pairs(docs: DataFrame, asked: Column, key: str = "id", text: str = "text", digits: int | None = None) -> DataFrame:
    """(a, b, cosine) of the documents whose key fulfils ``asked`` with all documents that share a term; weights as in ``tfidf``."""
    kind, n = docs.schema[key].dataType.simpleString(), docs.count()
    blocks = cut(by_document(docs, key, text, asked).mapInArrow(counted, f"block long, ids array<{kind}>, asked binary, ends binary, at binary, counts binary, terms binary"))
    parts = max(1, blocks.count() // BLOCKS)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return bucketed(batches, parts)

    def weigh(vocabulary: pa.Table, block: pa.Table) -> pa.Table:
        return weighed(vocabulary, block, n)

    vectors = f"ids array<{kind}>, asked binary, ends binary, at binary, counts binary, terms binary, idf binary, norms binary"
    everywhere = blocks.drop("ids", "counts").mapInArrow(spread, "bucket int, block long, pos binary, terms binary, df binary, wanted binary")
    everywhere = everywhere.groupBy("bucket").applyInArrow(summed, "block long, pos binary, term binary, df binary, wanted binary")
    # as many tasks as there are blocks for, not as the few bytes that move suggest
    everywhere, counts = (x.repartition(parts, "block").groupBy("block") for x in (everywhere, blocks.drop("terms")))
    weights = cut(everywhere.cogroup(counts).applyInArrow(weigh, vectors))
    groups = max(1, round(docs.filter(asked).count() / ASKED_DOCS))
    queries = cut(weights.mapInArrow(only_asked, vectors).repartition(groups).mapInArrow(gathered, vectors))
    pairs = weights.hint("shuffle_replicate_nl").crossJoin(queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns)))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return multiplied(batches, digits)

    return pairs.mapInArrow(multiply, f"a {kind}, b {kind}, cosine double")


def by_document(docs: DataFrame, key: str, text: str, asked: Column) -> DataFrame:
    """(id, asked, text, words, counts): one row per key. Rows with equal keys, or without one, are one document, as in ``tfidf``; its terms come counted."""
    flagged = docs.select(F.col(key).alias("id"), F.coalesce(asked, F.lit(False)).alias("asked"), F.col(text).alias("text"))
    none, number = F.lit(None).cast("array<string>").alias("words"), F.lit(None).cast("array<long>").alias("counts")
    single = lambda rows: rows.select("id", "asked", F.lower("text").alias("text"), none, number)
    again = flagged.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("other"))
    if again.isEmpty():
        return single(flagged)
    same = F.col("id").eqNullSafe(F.col("other"))
    tf = token_rows(flagged.join(again, same, "left_semi"), "id", "text", "asked").groupBy("id", "asked", "term").agg(F.count("*").alias("c"))
    merged = tf.groupBy("id", "asked").agg(F.collect_list(F.struct("term", "c")).alias("x"))
    return single(flagged.join(again, same, "left_anti")).union(merged.select("id", "asked", F.lit(None).cast("string"), "x.term", "x.c"))


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes as their largest needs, compressed: all lowest bytes first, then the next ones."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + squeezed(values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    found = np.frombuffer(restored(data[1:]), np.uint8).reshape(data[0], -1).T
    return np.ascontiguousarray(found).view(f"u{data[0]}").ravel().astype(np.int64)


def stepped(at: np.ndarray, ends: np.ndarray) -> bytes:
    """Places that ascend up to each of ``ends``, as steps from one to the next."""
    steps, starts = np.diff(at, prepend=0), np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0].astype(np.int64)
    steps[starts] = at[starts]
    return packed(steps)


def places(data: bytes, ends: np.ndarray) -> np.ndarray:
    """What ``stepped`` was given."""
    total = np.concatenate([[0], np.cumsum(unpacked(data))])
    return total[1:] - np.repeat(total[np.concatenate([[0], ends[:-1]])] if len(ends) else total[:0], np.diff(ends, prepend=0))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: ids, entries (place of the term in the block's list, count) up to the end of each document, and the terms."""
    part, number = TaskContext.get().partitionId(), 0
    ids: list = []
    flags: list[bool] = []
    ends: list[int] = []
    at: list[int] = []
    counts: list[int] = []
    place: dict[bytes, int] = {}
    kind = None

    def block() -> pa.RecordBatch:
        own, upto = np.array(at, np.int64), np.array(ends, np.int64)
        order = np.lexsort((own, np.repeat(np.arange(len(ids)), np.diff(upto, prepend=0))))
        found = [[np.array(flags).tobytes()], [upto.tobytes()], [stepped(own[order], upto)], [packed(np.array(counts, np.int64)[order])], [squeezed(b" ".join(place))]]
        return pa.RecordBatch.from_arrays([pa.array([(part << BLOCK) + number]), pa.array([ids], pa.list_(kind)), *(pa.array(x, pa.binary()) for x in found)], ["block", "ids", "asked", "ends", "at", "counts", "terms"])

    for batch in batches:
        kind = batch.column("id").type
        for start in range(0, batch.num_rows, 256):
            for i, flag, text, words, numbers in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                own = dict(zip((w.encode() for w in words), numbers, strict=True)) if words is not None else Counter((text or "").encode().translate(SPACED).split())
                if not own:
                    continue
                at += [place.setdefault(w, len(place)) for w in own]
                counts += own.values()
                ids.append(i)
                flags.append(flag)
                ends.append(len(at))
                if len(ids) >= BLOCK_DOCS or len(at) >= BLOCK_ENTRIES:
                    yield block()
                    number += 1
                    for x in (ids, flags, ends, at, counts, place):
                        x.clear()
    if ids:
        yield block()


def entries_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Asked or not by document, the row and the place of each entry, and the documents and asked documents of each place."""
    asked, ends = np.frombuffer(row["asked"], bool), np.frombuffer(row["ends"], np.int64)
    rows, at = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), places(row["at"], ends)
    return asked, rows, at, np.stack([np.bincount(at), np.bincount(at, asked[rows]).astype(np.int64)])


def bucketed(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The terms of each block, dealt into buckets, with their places, documents and asked documents."""
    for batch in batches:
        for row in batch.to_pylist():
            terms, (df, wanted) = np.array(restored(row["terms"]).split(b" "), object), entries_of(row)[-1]
            bucket = np.array([crc32(w) for w in terms]) % buckets
            order = np.argsort(bucket, kind="stable")
            for pos in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                whole = [stepped(pos, np.array([len(pos)])), squeezed(b" ".join(terms[pos])), packed(df[pos]), packed(wanted[pos])]
                yield pa.RecordBatch.from_arrays([pa.array([bucket[pos[0]]], pa.int32()), pa.array([row["block"]]), *(pa.array([x], pa.binary()) for x in whole)], ["bucket", "block", "pos", "terms", "df", "wanted"])


def summed(bucket: pa.Table) -> pa.Table:
    """For each block the terms of this bucket that other blocks have too: their first block and place there as a number, documents and asked documents in all."""
    held = bucket.sort_by("block").to_pylist()
    pos = [places(x["pos"], np.array([len(unpacked(x["pos"]))])) for x in held]
    found = pa.array(b" ".join(restored(x["terms"]) for x in held).split(b" "), pa.binary()).dictionary_encode()
    word, size = found.indices.to_numpy(), len(found.dictionary)
    df, wanted = (np.bincount(word, np.concatenate([unpacked(x[c]) for x in held]), size).astype(np.int64) for c in ("df", "wanted"))
    first = np.empty(size, np.int64)
    first[word[::-1]] = np.concatenate([(x["block"] << PLACE) + p for x, p in zip(held, pos, strict=True)])[::-1]
    again, start, rows = np.bincount(word) > 1, 0, []
    for x, p in zip(held, pos, strict=True):
        own = word[start : start + len(p)]
        start += len(p)
        if (kept := again[own]).any():
            rows.append((x["block"], stepped(p[kept], np.array([kept.sum()])), packed(first[own[kept]]), packed(df[own[kept]]), packed(wanted[own[kept]])))
    return pa.table([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * 5, [pa.int64(), *[pa.binary()] * 4], strict=True)], ["block", "pos", "term", "df", "wanted"])


NAMES = ["ids", "asked", "ends", "at", "counts", "terms", "idf", "norms"]


def vectors_of(ids: pa.Array, asked: np.ndarray, rows: np.ndarray, at: np.ndarray, counts: np.ndarray, terms: np.ndarray, idf: np.ndarray, norms: np.ndarray) -> pa.RecordBatch:
    """One row: a block whose entries are (rows, at, counts), rows ascending. Terms that no entry has go, the others and the entries of a row are in ascending order."""
    used, at = np.unique(at, return_inverse=True)
    order = np.argsort(terms[used])
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    used, at = used[order], back[at]
    ends, order = np.cumsum(np.bincount(rows, minlength=len(ids))).astype(np.int64), np.lexsort((at, rows))
    # the bits of a float from 0 are a whole number from 0
    whole = [asked.tobytes(), ends.tobytes(), stepped(at[order], ends), packed(counts[order]), stepped(terms[used], np.array([len(used)])), packed(idf[used].view(np.int64)), norms.tobytes()]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x], pa.binary()) for x in whole)], NAMES)


def read(row: dict) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``vectors_of`` was given."""
    ends, idf = np.frombuffer(row["ends"], np.int64), unpacked(row["idf"]).view(np.float64)
    rows = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return row["ids"], np.frombuffer(row["asked"], bool), rows, places(row["at"], ends), unpacked(row["counts"]), places(row["terms"], np.array([len(idf)])), idf, np.frombuffer(row["norms"])


def rows_of(batch: pa.RecordBatch | pa.Table, prefix: str = "") -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: x.values if c == "ids" else x.as_py() for c in NAMES if prefix + c in batch.schema.names and (x := batch.column(prefix + c)[i]) is not None}


def weighed(vocabulary: pa.Table, block: pa.Table, n: int) -> pa.Table:
    """The block with weights and norms. A vector keeps only entries that can meet: of terms that an asked document has, and another one."""
    row = next(rows_of(block))
    flags, rows, at, (df, wanted) = entries_of(row)
    number, counts, term = block["block"][0].as_py(), unpacked(row["counts"]), np.arange(len(df))
    term += number << PLACE
    for x in vocabulary.to_pylist():
        pos = places(x["pos"], np.array([len(unpacked(x["pos"]))]))
        term[pos], df[pos], wanted[pos] = (unpacked(x[c]) for c in ("term", "df", "wanted"))
    idf = np.where(df < n, np.log(n / df), 0)
    norms = np.sqrt(np.bincount(rows, ((1 + np.log(counts)) * idf[at]) ** 2, minlength=len(flags)))
    meets = ((df > 1) & (df < n) & (wanted > 0))[at]
    valid = row["ids"].is_valid().to_numpy(zero_copy_only=False)
    kept = valid & (np.bincount(rows[meets], minlength=len(flags)) > 0)
    meets &= kept[rows]
    number = np.cumsum(kept) - 1
    found = vectors_of(row["ids"].filter(pa.array(kept)), flags[kept], number[rows[meets]], at[meets], counts[meets], term, idf, norms[kept])
    return pa.Table.from_batches([found.slice(0, int(kept.any()))])


def only_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in rows_of(batch):
            ids, asked, rows, at, counts, terms, idf, norms = read(row)
            if asked.any():
                own, number = asked[rows], np.cumsum(asked) - 1
                yield vectors_of(ids.filter(pa.array(asked)), asked[asked], number[rows[own]], at[own], counts[own], terms, idf, norms[asked])


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small blocks put together into such of ``ASKED_DOCS`` documents or ``BLOCK_ENTRIES`` entries, or the next end of a small one."""
    held: list[tuple] = []

    def together() -> pa.RecordBatch:
        ids, asked, rows, at, counts, terms, idf, norms = zip(*held, strict=True)
        docs, words = (np.cumsum([0, *map(len, x)]) for x in (ids, terms))
        all_terms, first, same = np.unique(np.concatenate(terms), return_index=True, return_inverse=True)
        rows, at = (np.concatenate([x + y for x, y in zip(a, b, strict=False)]) for a, b in ((rows, docs), (at, words)))
        return vectors_of(pa.concat_arrays(ids), np.concatenate(asked), rows, same[at], np.concatenate(counts), all_terms, np.concatenate(idf)[first], np.concatenate(norms))

    for batch in batches:
        for row in rows_of(batch):
            held.append(read(row))
            if sum(len(x[0]) for x in held) >= ASKED_DOCS or sum(len(x[2]) for x in held) >= BLOCK_ENTRIES:
                yield together()
                held.clear()
    if held:
        yield together()


def multiplied(batches: Iterator[pa.RecordBatch], digits: int | None) -> Iterator[pa.RecordBatch]:
    """The pairs of each pair of blocks that share a term, cosines to ``digits`` if given; in the order of cosines, which files hold in fewer bytes."""
    for batch in batches:
        for own, other in zip(rows_of(batch), rows_of(batch, "q_"), strict=True):
            (b, *right), (a, *left) = read(own), read(other)
            cosine = products(left, right, len(a), len(b))
            same = pc.index_in(b, value_set=a).to_numpy(zero_copy_only=False)
            self_at = np.flatnonzero(~np.isnan(same.astype(float)))
            cosine[same[self_at].astype(np.int64), self_at] = 0  # all weights are positive: 0 is where nothing is shared
            i, j = np.nonzero(cosine)
            values = cosine[i, j]
            if digits is not None:
                values = np.floor(values * 10.0**digits + 0.5) / 10.0**digits
            order = np.argsort(values)
            i, j, values = i[order], j[order], values[order]
            for start in range(0, len(i), OUT_ROWS):
                s = slice(start, start + OUT_ROWS)
                yield pa.RecordBatch.from_arrays([a.take(pa.array(i[s])), b.take(pa.array(j[s])), pa.array(values[s])], ["a", "b", "cosine"])


def products(left: list[np.ndarray], right: list[np.ndarray], m: int, n: int) -> np.ndarray:
    """The matrix of sums of products, ``m`` by ``n``. Terms that meet most often are multiplied as dense matrices, others entry by entry."""

    def entries(rows: np.ndarray, at: np.ndarray, column: np.ndarray, counts: np.ndarray, idf: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept = np.flatnonzero((column >= 0)[at])
        rows, at, logs = rows[kept], at[kept], 1 + np.log(np.arange(1, counts.max(initial=0) + 1))
        return rows, column[at], logs[counts[kept] - 1] * idf[at] / norms[rows]

    (_, lr, la, lc, lt, li, ln), (_, rr, ra, rc, rt, ri, rn) = left, right
    shared, lp, rp = np.intersect1d(lt, rt, assume_unique=True, return_indices=True)
    found = np.zeros((m, n))
    meetings = np.bincount(la, minlength=len(lt))[lp] * np.bincount(ra, minlength=len(rt))[rp]
    rank = np.empty(len(shared), np.int64)
    rank[np.argsort(-meetings, kind="stable")] = np.arange(len(shared))
    lcol, rcol = np.full(len(lt), -1), np.full(len(rt), -1)
    lcol[lp], rcol[rp] = rank, rank
    (lr, lcol, lw), (rr, rcol, rw) = entries(lr, la, lcol, lc, li, ln), entries(rr, ra, rcol, rc, ri, rn)
    meetings, done = np.sort(meetings)[::-1], 0
    while meetings[done : done + DENSE_TERMS].sum() > m * n:
        x, y = np.zeros((m, DENSE_TERMS)), np.zeros((DENSE_TERMS, n))
        ls, rs = (np.flatnonzero(c < done + DENSE_TERMS) for c in (lcol, rcol))
        x[lr[ls], lcol[ls] - done], y[rcol[rs] - done, rr[rs]] = lw[ls], rw[rs]
        found += x @ y
        done += DENSE_TERMS
        (lr, lcol, lw), (rr, rcol, rw) = ([v[k] for v in side] for side, k in (((lr, lcol, lw), np.flatnonzero(lcol >= done)), ((rr, rcol, rw), np.flatnonzero(rcol >= done))))
    # of each entry on the right the entries on the left with its term, in runs of bounded size
    order = np.argsort(lcol)
    lr, lcol, lw = lr[order] * n, lcol[order], lw[order]
    starts = np.searchsorted(lcol, np.arange(len(shared) + 1))
    many = np.diff(starts)[rcol]
    total = np.cumsum(many)
    start = 0
    while start < len(rr):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + SPARSE_PAIRS, "right")))
        k = many[start:end]
        at = np.repeat(starts[rcol[start:end]] - np.cumsum(k) + k, k) + np.arange(k.sum())
        found += np.bincount(lr[at] + np.repeat(rr[start:end], k), lw[at] * np.repeat(rw[start:end], k), m * n).reshape(m, n)
        start = end
    return found
