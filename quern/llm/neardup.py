"""Near-duplicate documents by one-permutation MinHash.

1. Documents with the same shingle set fall into one class; only its smallest document goes on.
2. One hash of every shingle fills ``bands * rows`` bins (one-permutation hashing); empty bins borrow from filled ones by
   optimal densification, so short documents keep the collision probability of their similarity.
3. Banded buckets give candidates as stars: each member with the bucket's smallest document, so a bucket of n members
   makes n - 1 edges and not n * n.
4. Every edge is confirmed on the full sets; confirmed edges are joined into components by alternating large-star and
   small-star steps.
5. A star can miss a link between two members that are both unlike its centre. Stars whose members ended in different
   components are therefore compared again, in blocks of bounded size, and only across components: pairs that are
   already connected cannot change the result. The blocks hold the full sets and return only links that connect, so
   their results never outgrow their members. Bins decide which members can have a partner at all and bring their sets.

With 28 bands of 4 rows a pair at similarity 0.8 shares a bucket with probability 1 - 4e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import as_bytes, cut, partitions, remove, shared_path, slices, unused

WORDS = 5
PERCENT = 80
BANDS = 28
ROWS = 4
#: Members of one block of a star, and so at most twice as many sets in one group of a confirming task.
BLOCK = 256
#: Agreement of two documents' bins below which their sets are not compared: 0.8 minus five standard deviations at 112 bins.
LEAST_AGREEMENT = 0.6
#: Sets below this size are checked whatever their bins, which are no longer independent once most are borrowed.
SMALL_SET = 60
#: Word hashes kept by one task.
CACHE_WORDS = 200_000

MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that every bit of a result depends on all bits of its input."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, words: int):
        self.words, self._cache = words, {}

    def __call__(self, text: bytes) -> np.ndarray:
        """ASCII letters lower-cased, words divided by ASCII white space; fewer words than a shingle has make one shingle."""
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        cache = self._cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        hashes = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh3_64_intdigest(w)
            hashes[i] = h
        size = min(self.words, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = mix(out * MIX + hashes[k : len(words) - size + 1 + k])
        return np.unique(out)


class Signer:
    """One-permutation signatures with optimal densification."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        tries = np.arange(self.bins, dtype=np.uint64)
        self._try = lambda attempt: (mix(tries * MIX + np.uint64(attempt)) % np.uint64(self.bins)).astype(np.int64)
        self._tries = [self._try(a) for a in range(1, 64)]

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The least hash in each bin; a bin is a shingle's leading bits, so sorted hashes have their bins in order."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        filled, first = np.unique(bins, return_index=True)
        values, has = np.zeros(self.bins, np.uint64), np.zeros(self.bins, bool)
        values[filled], has[filled] = hashes[first], True
        empty, attempt, out = np.flatnonzero(~has), 0, values.copy()
        while len(empty):
            attempt += 1
            from_bin = (self._tries[attempt - 1] if attempt <= 63 else self._try(attempt))[empty]
            got = has[from_bin]
            out[empty[got]] = values[from_bin[got]]
            empty = empty[~got]
        return out

    def band_keys(self, signature: np.ndarray) -> np.ndarray:
        by_band = signature.reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for r in range(self.rows):
                key = mix(key * MIX + by_band[:, r])
        return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """100 * |a & b| >= percent * |a | b|, in integers, for sorted distinct arrays."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, keys, bins): set size, a 128-bit digest of the set, band keys, a byte of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(words), Signer(bands, rows)
        for group in slices(batches):
            ids, sizes, digests, keys, bins = [], [], [], [], []
            for doc_id, text in group:
                hashes = shingle(text)
                ids.append(doc_id)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                signature = sign.signature(hashes) if len(hashes) else None
                keys.append(None if signature is None else sign.band_keys(signature))
                bins.append(None if signature is None else mix(signature * MIX).astype(np.uint8).tobytes())
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(bins, pa.binary())],
                ["doc_id", "n_shingles", "s1", "s2", "keys", "bins"],
            )

    return docs.select(F.col("doc_id").cast("long"), as_bytes("text")).mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, bins binary")


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, hashes): the full sets, as bytes, of the documents named in ``ids`` (id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for group in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in group], pa.int64()), pa.array([shingle(t).tobytes() for _, t in group], pa.binary())], ["id", "hashes"])

    # written first, so that the join is planned by the ids' real size: texts move only where the ids are too many to be sent
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), as_bytes("text").alias("text")).join(cut(ids, "wanted"), "id", "left_semi")
    return wanted.mapInArrow(run, "id long, hashes binary")


def confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (g1, g2, a, b) whose full sets are similar enough, as (a, b).

    Pairs come in groups of bounded size; each document's set travels once to each group that names it, not once per pair.
    """
    members = pairs.select("g1", "g2", F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets_of(docs, members.select("id").distinct(), words)
    loaded = members.join(sets, "id")

    def check(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        held = {i: np.frombuffer(h, np.uint64) for i, h in zip(left["id"].to_pylist(), left["hashes"].to_pylist(), strict=True)}
        a, b = right["a"].to_pylist(), right["b"].to_pylist()
        good = [(x, y) for x, y in zip(a, b, strict=True) if similar(held[x], held[y], percent)]
        return pa.table({"a": pa.array([x for x, _ in good], pa.int64()), "b": pa.array([y for _, y in good], pa.int64())})

    left = loaded.select(F.col("g1").alias("k1"), F.col("g2").alias("k2"), "id", "hashes")
    return left.groupBy("k1", "k2").cogroup(pairs.groupBy("g1", "g2")).applyInArrow(check, "a long, b long")


def star_edges(banded: DataFrame) -> DataFrame:
    """From (key, id) the distinct edges (a, b), a the smallest id of a bucket, b another member.

    Buckets lie sorted over ranges of (key, id): one shuffle, and a bucket of any size is read as a stream by as many tasks as it
    fills. A bucket that goes over a range's end has a centre in each; these few are then replaced by the first.
    """
    spark = banded.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_key = last_key = centre = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids = batch["key"].to_numpy(), batch["id"].to_numpy()
            starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1))
            heads = ids[starts]
            if last_key is not None and key[0] == last_key:
                heads = np.concatenate(([centre], heads[1:]))
            first_key = key[0] if first_key is None else first_key
            a = np.repeat(heads, np.diff(np.concatenate((starts, [len(key)]))))
            # a centre's own row names the bucket's centre in this range, which matters at the range's ends
            keep = a != ids
            keep |= (key == first_key) | (key == key[-1])
            last_key, centre = key[-1], heads[-1]
            border = (key == first_key) | (key == last_key)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(ids[keep]), pa.array(key[keep], mask=~border[keep])], ["a", "b", "border"])

    dealt = banded.select("key", "id").repartitionByRange(partitions(spark), "key", "id").sortWithinPartitions("key", "id")
    raw = cut(dealt.mapInArrow(run, "a long, b long, border long"), "raw-stars")
    over = raw.filter("border is not null").groupBy("border").agg(F.min("a").alias("centre"), F.max("a").alias("other")).filter("centre <> other").select("border", "centre")
    # a bucket with two centres goes over the end of a range: no more than there are ranges
    fixed = raw.join(F.broadcast(over), "border", "left").select(F.coalesce("centre", "a").alias("a"), "b")
    return fixed.filter("a <> b").distinct()


def near_edges(stars: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The edges whose ends may be similar, by sizes and bins."""
    sides = [heads.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("bins").alias(f"s{x}")) for x in "ab"]
    both = stars.join(sides[0], "a").join(sides[1], "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
            sa, sb = (np.frombuffer(b"".join(batch[x].to_pylist()), np.uint8).reshape(len(na), -1) for x in ("sa", "sb"))
            small, large = np.minimum(na, nb), np.maximum(na, nb)
            near = (100 * small >= percent * large) & (((sa == sb).mean(1) >= LEAST_AGREEMENT) | (small < SMALL_SET))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(near)), batch["b"].filter(pa.array(near))], ["a", "b"])

    return both.select("a", "b", "na", "nb", "sa", "sb").filter("na is not null").mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the edges (a, b); component is the smallest id that can be reached.

    Alternating large-star and small-star; each round is written to the shared folder, and the folder before it goes.
    """
    spark = edges.sparkSession
    path = shared_path(spark, "edges")
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", path=path)
    state = None
    while True:
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
        if (told["n"], told["h"]) == state or not told["n"]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        state = (told["n"], told["h"])
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        old, path = path, shared_path(spark, "edges")
        now = cut(small, "edges", path=path)
        remove(spark, old)


def missed_links(stars: DataFrame, labels: DataFrame, heads: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members of a star (a, b) that lie in different components.

    Of a star, the members of its largest component meet only the rest, and the rest meet each other; both in blocks by the
    hash of the id, so that no group holds more than two blocks. First the blocks hold bins and name the members that have a
    possible partner in another component; then only those bring their full sets.
    """
    members = stars.select(F.col("a").alias("star"), F.col("b").alias("id")).union(stars.select("a", "a").distinct())
    named = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("star", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("star").agg(F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("all"), F.count("*").alias("kinds")).filter("kinds > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = cut(mixed.select("star", F.col("largest.component").alias("main"), blocks(F.col("largest.n")).alias("mains"), blocks(F.col("all") - F.col("largest.n")).alias("rests")), "mixed-stars")
    rows = named.join(mixed, "star").withColumn("is_main", F.col("component") == F.col("main"))
    block = F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")
    rows = rows.withColumn("block", block)
    # group (i, j): rest block i with main block j, or with rest block j - mains
    i, mains, rests = F.col("block"), F.col("mains"), F.col("rests")
    with_rest = F.transform(F.sequence(F.lit(0), rests - 1), lambda k: F.struct(k.alias("i"), i.alias("j")))
    with_main = F.transform(F.sequence(F.lit(0), mains - 1), lambda k: F.struct(i.alias("i"), k.alias("j")))
    among = F.transform(F.sequence(F.lit(0), rests - 1), lambda k: F.struct(F.least(i, k).alias("i"), (mains + F.greatest(i, k)).alias("j")))
    dealt = rows.select("star", "id", "component", F.inline(F.when(F.col("is_main"), with_rest).otherwise(F.concat(with_main, among))))
    dealt = dealt.join(heads.select("id", "n_shingles", "bins"), "id")

    def candidates(x: int, label: np.ndarray, size: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Later members of other components that may be similar to member x, and their agreement."""
        others = np.arange(x + 1, len(size))
        small, large = np.minimum(size[others], size[x]), np.maximum(size[others], size[x])
        others = others[(label[others] != label[x]) & (100 * small >= percent * large)]
        agree = (bins[others] == bins[x]).mean(1) if len(others) else np.empty(0)
        near = (agree >= LEAST_AGREEMENT) | (np.minimum(size[others], size[x]) < SMALL_SET)
        return others[near], agree[near]

    def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = table["n_shingles"].to_numpy()
        return np.unique(table["component"].to_numpy(), return_inverse=True)[1], size, np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(len(size), -1)

    def possible(key: tuple, table: pa.Table) -> pa.Table:
        label, size, bins = columns(table)
        has = np.zeros(len(size), bool)
        for x in range(len(size) - 1):
            others, _ = candidates(x, label, size, bins)
            has[others] = True
            has[x] |= len(others) > 0
        return table.filter(pa.array(has))

    def link(key: tuple, table: pa.Table) -> pa.Table:
        ids, sets, found = table["id"].to_pylist(), [np.frombuffer(h, np.uint64) for h in table["hashes"].to_pylist()], []
        # a component's label changes for all its members when it is linked
        label, size, bins = columns(table)
        for x in range(len(ids) - 1):
            others, agree = candidates(x, label, size, bins)
            for y in others[np.argsort(-agree, kind="stable")].tolist():
                if label[y] != label[x] and similar(sets[x], sets[y], percent):
                    found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                    label[label == label[y]] = label[x]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    schema = "star long, i int, j int, id long, component long, n_shingles long, bins binary"
    left = cut(dealt.select("star", "i", "j", "id", "component", "n_shingles", "bins").groupBy("star", "i", "j").applyInArrow(possible, schema), "possible-links")
    loaded = left.join(sets_of(docs, left.select("id").distinct(), words), "id")
    return loaded.groupBy("star", "i", "j").applyInArrow(link, "a long, b long")


#: No pair under this ratio of set sizes can reach the lowest similarity the operator is used with.
PERCENT_FLOOR = 80


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept.

    Documents without words have an empty set, link with nothing and are kept. Rows without a doc_id take no part and are
    returned kept, without a component. Rows that repeat a doc_id are one document, with the greatest of their texts, and
    return one row. An empty table gives an empty result; other columns are ignored.
    """
    if percent < PERCENT_FLOOR:
        raise ValueError(f"the signatures are laid out for similarities of {PERCENT_FLOOR} % or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if docs.groupBy("doc_id").count().filter("doc_id is not null and count > 1").head(1):
        docs = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text")).union(docs.filter("doc_id is null"))
    table = cut(signed(docs, words, bands, rows), "signatures")
    usable = table.filter("doc_id is not null and n_shingles > 0")
    classes = cut(usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("id")), "classes")
    heads = cut(usable.join(classes.select("id"), usable["doc_id"] == classes["id"], "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "keys", "bins"), "heads")
    stars = cut(star_edges(heads.select("id", F.explode("keys").alias("key"))), "stars")
    near = cut(near_edges(stars, heads, percent), "near-stars")
    # a centre's edges are dealt into groups of about a block
    groups = near.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("groups"))
    grouped = near.join(groups, "a").select(F.col("a").alias("g1"), F.pmod(F.xxhash64("b"), "groups").alias("g2"), "a", "b")
    links = cut(confirm(cut(grouped, "grouped-stars"), docs, words, percent), "links")
    labels = cut(connected(links), "components")
    more = cut(missed_links(stars, labels, heads, docs, words, percent), "missed-links")
    if more.head(1):
        labels = cut(connected(links.union(more)), "components")
    named = classes.join(labels, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component_id"))
    with_set = table.join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return with_set.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` less the documents that a smaller doc_id of their group stands for. Columns stay, whatever their names.

    Of rows that repeat a kept doc_id all stay, as do null and empty texts and rows without a doc_id. An empty table stays empty.
    """
    name = unused(docs, "gone")
    gone = near_duplicates(docs, **how).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
