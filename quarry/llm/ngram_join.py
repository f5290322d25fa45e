"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection.

A document's set holds the hashes of its distinct word shingles.  All pairs of
documents with ``Jaccard >= threshold`` are linked, exactly, without ever
listing all pairs of a group:

1. ``sets``: each document's set size and a 128-bit digest of its set.  Equal
   sets are one class; only classes are compared.
2. Groups: in one fixed order of all shingles (frequent ones last), two sets
   that reach the threshold share one of their first ``n - ceil(t n) + 1``
   shingles.  Classes are grouped by these, as packed arrays of (shingle, class)
   dealt by shingle; groups repeated by other shingles are sent once.
3. Tiles: the classes of a group in blocks of bounded size, in size bands, a
   band against itself and the next.  Hashed bitmap signatures bound the overlap
   from above: ``|x & y| <= (|x| + |y| - popcount(bx ^ by)) / 2``.  Only a
   spanning forest of the pairs that pass is sent on.
4. The components of those pairs are small families of look-alikes.  Their sorted
   arrays meet in tiles once more; pairs whose bitmaps pass and which no chain of
   links joins yet are intersected exactly.  The components of these links, with
   the classes' members, are the result.

The order of shingles only steers the work; it is taken from counts over all
documents.  Nothing about all documents reaches the driver except the bounded
list of most frequent shingles.

Defined results: a null or wordless text has an empty set and is linked with
nothing; fewer words than a shingle make one shingle of the whole sequence; a
null id is linked with nothing and has a null component; repeated rows fall in
one class and give repeated rows; other columns are ignored; an empty table
gives no rows.  Shingles are compared by 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Links, batch_of, columns_of, free_name, key_runs, map_rows, mix64, slices, text_or_empty
from quarry.llm.components import components
from quarry.session import broadcast_if_small, write_table

WORDS = 5
THRESHOLD = Fraction(3, 4)
#: Shingles found in this many documents or more are put last, the most frequent at the very end.
FREQUENT_FROM = 48
#: Bound of that list (16 bytes each); beyond it, order is by hash, with the same result.
FREQUENT_MAX = 1 << 18
#: Most classes of a block; a tile holds two blocks.
BLOCK = 2048
#: Bits of a signature for each shingle of the larger set of a tile, at least.
BITS_PER_SHINGLE, MIN_BITS, MAX_BITS = 4, 256, 1 << 14
#: Packed (shingle, class) pairs that one reducing task holds, about, and the least number of such tasks.
TASK_PAIRS, MIN_TASKS = 3_000_000, 8
#: Texts worked on at once, and most numbers of an unpacked block of signatures.
SLICE, UNPACKED = 2000, 1 << 23
#: Words whose hash a worker remembers.
REMEMBER = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBER:
            self[word] = h
        return h


_HASHES = _WordHashes()


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    tokens = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z only, ASCII white space only
    n = len(tokens)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), dtype=np.uint64, count=n)
    k = min(words, n)
    s = np.full(n - k + 1, k, dtype=np.uint64)
    for j in range(k):
        s = mix64(s * np.uint64(0x100000001B3) + h[j:n - k + 1 + j])
    return np.unique(s)


def _digest(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _least_overlap(n: int, t: Fraction) -> int:
    return -(-n * t.numerator // t.denominator)


def _prefix(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray, t: Fraction) -> np.ndarray:
    """The first shingles of a set in the fixed order: rare ones by hash, then frequent ones by rank."""
    keep = len(s) - _least_overlap(len(s), t) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        common = frequent[at] == s
        if common.any():
            rare = s[~common]
            if len(rare) >= keep:
                return rare[:keep]
            late = s[common][np.argsort(rank[at[common]], kind="stable")]
            return np.concatenate([rare, late[:keep - len(rare)]])
    return s[:keep]


# -- 1. sets -------------------------------------------------------------------

def document_sets(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, n_shingles, digest, mark)`` of documents, and rows ``(keys, counts)`` of shingles seen often in a batch.

    ``mark`` is a 64-bit hash of the text, by which rows that share an id are told apart.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, SLICE):
            texts, = columns_of(batch, "text")
            sizes, digests, seen, sets = [], [], set(), []
            for text in texts:
                s = shingle_set(text, words)
                d = _digest(s)
                sizes.append(len(s))
                digests.append(d)
                if d is not None and d not in seen:
                    seen.add(d)
                    sets.append(s)
            kind = pa.schema([("doc_id", batch.column(0).type), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("mark", pa.int64()),
                              ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
            none = [None] * len(sizes)
            yield batch_of(kind, batch.column(0), sizes, digests, batch.column(2), none, none)
            if sets:
                keys, counts = np.unique(np.concatenate(sets), return_counts=True)
                often = counts >= 3
                if often.any():
                    yield batch_of(kind, [None], [None], [None], [None], [keys[often].view(np.int64)], [counts[often]])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    return map_rows(rows, run, f"doc_id {id_type}, n_shingles long, digest binary, mark long, keys array<long>, counts array<long>")


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, rank) of the most frequent shingles: FREQUENT_MAX at most."""
    rows = (sets.filter("keys IS NOT NULL").select(F.explode(F.arrays_zip("keys", "counts")).alias("x"))
            .groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.counts").alias("n")).filter(F.col("n") >= FREQUENT_FROM)
            .orderBy(F.desc("n"), "key").limit(FREQUENT_MAX).toPandas())
    keys = rows["key"].to_numpy(dtype=np.int64).view(np.uint64)
    rank = np.arange(len(keys), 0, -1)  # the most frequent comes last
    order = np.argsort(keys)
    return keys[order], rank[order]


# -- 2. groups -----------------------------------------------------------------

def _groups(docs: DataFrame, words: int, t: Fraction, frequent, parts: int) -> DataFrame:
    """``(group, node)``: classes that share an early shingle; each distinct group once a task.

    What is dealt is small: 32 bits of a shingle, which its bucket completes, and
    the first 64 bits of a class's digest, once a bucket and slice.  Two shingles
    or classes that share these bits only make a group larger than it need be.
    """
    buckets = parts * 2
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def deal(batches):
        keys_sorted, rank = sent.value
        kind = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("owner", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])
        for batch in slices(batches, SLICE):
            texts, = columns_of(batch, "text")
            index: dict[bytes, int] = {}
            keys, owner, sizes = [], [], []
            for text in texts:
                s = shingle_set(text, words)
                d = _digest(s)
                if d is None or d in index:
                    continue
                sizes.append(len(s))
                p = _prefix(s, keys_sorted, rank, t)
                owner.append(np.full(len(p), len(index), dtype=np.uint16))
                index[d] = len(index)
                keys.append(p)
            if not index:
                continue
            k, o = mix64(np.concatenate(keys)), np.concatenate(owner)
            b = (k % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort([o, b])
            k, o, b = (k[order] >> np.uint64(32)).astype(np.uint32), o[order], b[order]
            nodes = np.frombuffer(b"".join(index), dtype=">u8")[::2].astype(np.uint64)
            sizes = np.array(sizes, dtype=np.uint32)
            cuts = np.flatnonzero(np.diff(b)) + 1
            rows = []
            for lo, hi in zip([0, *cuts], [*cuts, len(b)]):
                used, local = np.unique(o[lo:hi], return_inverse=True)
                rows.append((int(b[lo]), k[lo:hi].tobytes(), local.astype(np.uint16).tobytes(), nodes[used].tobytes(), sizes[used].tobytes()))
            yield batch_of(kind, *zip(*rows))

    def meet(batches):
        keys, owner, nodes, sizes, base = [], [], [], [], 0
        for batch in batches:
            for bucket, k, o, n, z in zip(*columns_of(batch, "bucket", "keys", "owner", "nodes", "sizes")):
                keys.append(np.frombuffer(k, dtype=np.uint32) | np.uint64(bucket) << np.uint64(32))
                owner.append(np.frombuffer(o, dtype=np.uint16) + np.uint32(base))
                nodes.append(np.frombuffer(n, dtype=np.uint64))
                sizes.append(np.frombuffer(z, dtype=np.uint32))
                base += len(nodes[-1])
        if not keys:
            return
        nodes, first, same = np.unique(np.concatenate(nodes), return_index=True, return_inverse=True)
        sizes = np.concatenate(sizes)[first].astype(np.int64)
        o = same.astype(np.uint32)[np.concatenate(owner)]
        k = np.concatenate(keys)
        del keys, owner, same
        order = np.lexsort([o, sizes[o], k])
        k, o = k[order], o[order]
        del order
        fresh = np.ones(len(k), dtype=bool)
        fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        k, o = k[fresh], o[fresh]
        # a group ends where the next larger set is too large for any of the smaller ones
        gap = sizes[o[:-1]] * t.denominator < sizes[o[1:]] * t.numerator
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | gap]))
        ends = np.append(starts[1:], len(k))
        many = np.flatnonzero(ends - starts > 1)
        # large groups first; one whose classes all lie in one group sent before adds no pair
        many = many[np.argsort(-(ends[many] - starts[many]), kind="stable")]
        first_group = np.full(len(nodes), -1, dtype=np.int64)
        kind = pa.schema([("group", pa.int64()), ("node", pa.int64())])
        out, held_rows, done = [], 0, set()
        for g in many:
            members = o[starts[g]:ends[g]]
            held = first_group[members]
            if held[0] >= 0 and (held == held[0]).all():
                continue
            name = xxhash.xxh3_64_intdigest(nodes[members].tobytes())
            if name in done:
                continue
            done.add(name)
            first_group[members[held < 0]] = g
            out.append((np.full(len(members), name, dtype=np.uint64).view(np.int64), nodes[members].view(np.int64)))
            held_rows += len(members)
            if held_rows > 50_000:
                yield batch_of(kind, *(pa.array(np.concatenate(c)) for c in zip(*out)))
                out, held_rows = [], 0
        if out:
            yield batch_of(kind, *(pa.array(np.concatenate(c)) for c in zip(*out)))

    dealt = map_rows(docs.select(text_or_empty("text").alias("text")), deal, "bucket int, keys binary, owner binary, nodes binary, sizes binary")
    met = map_rows(dealt.repartition(parts, "bucket"), meet, "group long, node long")
    return met.distinct()


# -- 3. and 4. tiles -------------------------------------------------------------

def band(n, t: Fraction = THRESHOLD):
    """Size band: sets that reach the threshold lie in the same or in neighbouring bands."""
    return np.floor(np.log(n) / math.log(1 / t) + 1e-9).astype(np.int64)


def signature(s: np.ndarray, bits: int) -> bytes:
    """Hashed bitmap of a set; folding its halves together gives the one of half the bits."""
    out = np.zeros(bits, dtype=bool)
    out[(s % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def bits_for(n: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << max(1, n * BITS_PER_SHINGLE - 1).bit_length()))


def _unpacked(signatures: list[bytes], bits: int) -> np.ndarray:
    out = np.empty((len(signatures), bits), dtype=np.float32)
    for i, s in enumerate(signatures):
        b = np.unpackbits(np.frombuffer(s, dtype=np.uint8), bitorder="little")
        while len(b) > bits:
            b = b[:len(b) // 2] | b[len(b) // 2:]
        out[i] = b
    return out


def _passing(n: np.ndarray, signatures: list[bytes], left: np.ndarray, right: np.ndarray, t: Fraction):
    """(row, columns) of pairs between the sides that the bitmap bound lets pass, by size bands and bounded blocks."""
    b = band(n, t)
    width = np.array([len(x) * 8 for x in signatures])
    for x in np.unique(b[left]):
        rows = left[b[left] == x]
        near = right[(b[right] >= x - 1) & (b[right] <= x + 1)]
        if not len(near):
            continue
        bits = int(min(width[rows].min(), width[near].min()))
        step = max(64, UNPACKED // bits)
        for at in range(0, len(near), step):
            cols = near[at:at + step]
            c = _unpacked([signatures[i] for i in cols], bits)
            c_ones = c.sum(axis=1)
            for lo in range(0, len(rows), 256):
                part = rows[lo:lo + 256]
                r = _unpacked([signatures[i] for i in part], bits)
                apart = r.sum(axis=1)[:, None] + c_ones[None, :] - 2 * (r @ c.T)
                both = (n[part][:, None] + n[cols][None, :]).astype(np.float32)
                overlap = np.minimum(np.floor((both - apart) / 2), np.minimum(n[part][:, None], n[cols][None, :]))
                # overlap / (both - overlap) >= t
                ok = overlap * (t.numerator + t.denominator) >= t.numerator * both
                for i in np.flatnonzero(ok.any(axis=1)):
                    hit = cols[ok[i]]
                    yield int(part[i]), hit[hit != part[i]]


def _blocked(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """Adds ``tile`` and ``side``: large groups are cut into blocks by hash, and each pair of blocks is a tile.

    ``side`` 0: the pairs within the tile's rows; 1 and 2: the pairs between the sides.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > block)
    counts = broadcast_if_small(counts.select(F.col(key).alias("large"), F.ceil(F.col("members") / (block * 0.8)).cast("int").alias("blocks")))
    j = rows.join(counts, rows[key] == F.col("large"), "left")
    mine = F.pmod(F.xxhash64(member), F.col("blocks")).cast("int")
    j = j.withColumn("mine", mine).withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    return (j.withColumn("tile", F.when(F.col("blocks").isNull(), F.col(key).cast("long")).otherwise(F.xxhash64(F.col(key), lo, hi)))
            .withColumn("side", F.when(F.col("blocks").isNull() | (lo == hi), 0).when(F.col("mine") == lo, 1).otherwise(2))
            .drop("large", "blocks", "mine", "other"))


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if (side == 0).all():
        every = np.arange(len(side))
        return every, every
    return np.flatnonzero(side == 1), np.flatnonzero(side == 2)


def _candidates_in_tiles(t: Fraction):
    def run(batches):
        kind = pa.schema([("u", pa.binary()), ("v", pa.binary())])
        for tile in key_runs(batches, "tile"):
            digests = tile.column("digest").to_pylist()
            n = tile.column("n").to_numpy()
            signatures = tile.column("signature").to_pylist()
            links = Links(len(n))
            for i, hits in _passing(n, signatures, *_sides(tile.column("side").to_numpy()), t):
                links.join(i, hits)
            if links.edges:
                yield batch_of(kind, [digests[i] for i, _ in links.edges], [digests[j] for _, j in links.edges])
    return run


def _links_in_tiles(t: Fraction):
    def run(batches):
        kind = pa.schema([("u", pa.binary()), ("v", pa.binary())])
        for tile in key_runs(batches, "tile"):
            digests = tile.column("digest").to_pylist()
            n = tile.column("n").to_numpy()
            signatures = tile.column("signature").to_pylist()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in tile.column("shingles").to_pylist()]
            links = Links(len(n))
            for i, hits in _passing(n, signatures, *_sides(tile.column("side").to_numpy()), t):
                todo = links.apart(i, hits)
                if not len(todo):
                    continue
                # exact overlaps of one sorted array with several
                joined, sizes = np.concatenate([sets[j] for j in todo]), np.array([len(sets[j]) for j in todo])
                at = np.minimum(np.searchsorted(sets[i], joined), len(sets[i]) - 1)
                common = np.add.reduceat((sets[i][at] == joined).astype(np.int64), np.cumsum(sizes) - sizes)
                links.join(i, todo[common * t.denominator >= t.numerator * (len(sets[i]) + sizes - common)])
            if links.edges:
                yield batch_of(kind, [digests[i] for i, _ in links.edges], [digests[j] for _, j in links.edges])
    return run


def _signed_sets(docs: DataFrame, words: int, shingles: bool) -> DataFrame:
    """``(digest, n, signature)`` of each document, and its sorted ``shingles`` where asked for."""
    def run(batches):
        kind = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("signature", pa.binary())] + [("shingles", pa.binary())] * shingles)
        for batch in slices(batches, 500):
            part = [s for s in (shingle_set(x, words) for x in columns_of(batch, "text")[0]) if len(s)]
            yield batch_of(kind, [_digest(s) for s in part], [len(s) for s in part], [signature(s, bits_for(len(s))) for s in part],
                           *[[s.tobytes() for s in part]] * shingles)
    return map_rows(docs.select(text_or_empty("text").alias("text")), run, "digest binary, n long, signature binary" + ", shingles binary" * shingles)


def _tiled(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "tile").sortWithinPartitions("tile")


# -- the operator ------------------------------------------------------------------

def jaccard_components(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, id_col: str = "doc_id",
                       text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of each document."""
    return _components_of_rows(docs, words, threshold, id_col, text_col, block).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")


def _components_of_rows(docs: DataFrame, words: int, threshold: Fraction, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """``(doc_id, n_shingles, component_id, component, digest, mark)``: two components may share their least id, not their ``component``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = write_table(document_sets(rows, words), "ngram_sets")
    real = sets.filter("keys IS NULL").select("doc_id", "n_shingles", "digest", "mark")
    named = rows.filter("doc_id IS NOT NULL")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = real.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(MIN_TASKS, math.ceil(total * float(1 - threshold) / TASK_PAIRS))

    classes = real.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    groups = write_table(_groups(named, words, threshold, _frequent(sets), parts), "ngram_groups")
    node = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")  # the first 8 bytes
    def texts_of(wanted, on):
        """One text of each wanted class: its least id."""
        ids = write_table(classes.withColumn("node", node).join(wanted, on, "left_semi").select(F.col("least").alias("doc_id")).distinct(), "ngram_ids")
        chosen = named.join(broadcast_if_small(ids), "doc_id", "left_semi")
        if real.join(ids, "doc_id", "left_semi").groupBy("doc_id").count().filter("count > 1").limit(1).count():
            chosen = chosen.dropDuplicates()  # repeated rows: each text once
        return chosen

    signed = write_table(_signed_sets(texts_of(groups.select("node").distinct(), "node"), words, False).withColumn("node", node), "ngram_signed")
    tiles = _blocked(groups, "group", "node", block).join(signed, "node")
    edges = map_rows(_tiled(tiles.select("tile", "side", "digest", "n", "signature"), shuffles), _candidates_in_tiles(threshold), "u binary, v binary")
    families = components(edges, "ngram_candidates").select(F.xxhash64("component").alias("family"), F.col("node").alias("digest"))
    families = write_table(_blocked(families, "family", "digest", block), "ngram_families")
    # only the families' arrays are made and sent
    arrays = _signed_sets(texts_of(families.select("digest").distinct(), "digest"), words, True)
    tiles = arrays.join(broadcast_if_small(families), "digest")
    links = map_rows(_tiled(tiles.select("tile", "side", "digest", "n", "signature", "shingles"), shuffles), _links_in_tiles(threshold), "u binary, v binary")
    linked = components(links, "ngram_links").withColumnRenamed("node", "digest")

    by_class = classes.join(linked, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    least = by_class.filter(F.col("copies") > 1).select("digest", F.col("least").alias("component_id"), F.col("component"))
    if linked.limit(1).count():
        of_component = by_class.join(linked.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("least").alias("component_id"))
        least = (by_class.join(of_component, "component", "left").filter(F.col("component_id").isNotNull() | (F.col("copies") > 1))
                 .select("digest", F.coalesce("component_id", "least").alias("component_id"), "component"))
    least = write_table(least.select("digest", "component_id", "component"), "ngram_components")
    out = real.join(broadcast_if_small(least), "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
                      F.coalesce("component", "digest").alias("component"), "digest", "mark")


def keep_one_each(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that with the least id; all columns.  Rows without an id stay as they are.

    Rows that share an id are told apart by their texts: of a component's texts under its
    least id that with the least digest stays, once, and a text without words stays with
    each id.
    """
    name, mark = free_name(docs, "kept_id"), free_name(docs, "kept_mark")
    rows = write_table(_components_of_rows(docs, words, threshold, id_col, text_col).filter("doc_id IS NOT NULL"), "ngram_rows")
    least = rows.filter(F.col("doc_id") == F.col("component_id"))
    one = least.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("digest", "doc_id", "mark")).alias("k")).select("k.doc_id", "k.mark")
    kept = one.unionByName(least.filter("component IS NULL").select("doc_id", "mark").distinct())
    kept = broadcast_if_small(write_table(kept, "ngram_kept").select(F.col("doc_id").alias(name), F.col("mark").alias(mark)))
    same = (F.col(id_col) == F.col(name)) & (F.xxhash64(text_or_empty(text_col)) == F.col(mark))
    named = docs.filter(F.col(id_col).isNotNull()).join(kept, same, "left_semi")
    if rows.groupBy("doc_id", "mark").count().filter("count > 1").limit(1).count():  # repeated rows: only then are whole rows shuffled
        named = named.withColumn(mark, F.xxhash64(text_or_empty(text_col))).dropDuplicates([id_col, mark]).drop(mark)
    return named.unionByName(docs.filter(F.col(id_col).isNull()))
