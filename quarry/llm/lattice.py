"""Embedding near-duplicates: lattice hashing on E8.

Unit vectors are projected at random to 8 dimensions and decoded to the nearest
point of the E8 lattice, in several independent tables.  A vector is filed under
its own cell and the cells it is nearest to besides (probes); two vectors meet in
a table when one's own cell is among the other's.  What meets is verified by the
cosine in double precision, so no pair below the threshold is linked.

1. Equal vectors of a label are one class (128-bit digest); only classes go on.
2. Cells are counted first; only cells that hold a class of their own and another
   class are joined with vectors.  Large cells are cut into blocks, and every
   pair of blocks is a tile of bounded size; the pairs between the blocks of one
   cell are never listed.
3. A tile returns, for each class, how many vectors it links, counting a pair
   only in the first cell where it meets, and a spanning forest of its links.
   Sums and connected components of these are the result.

Recall depends on the scale and the numbers of tables and probes;
``tests/llm/test_joins.py`` and the README give it against brute force.

Defined results: a null label or a vector that is null, empty, zero, or has null
or non-finite components links with nothing (no links, its own component);
vectors of different length never link; equal vectors link (cosine 1); a null id
counts as a vector but has a null component; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Links, batch_of, columns_of, key_runs, map_rows, mix64
from quarry.llm.components import components
from quarry.session import broadcast_if_small, write_table

THRESHOLD = 0.98
TABLES = 8
PROBES = 4
#: Lattice units per unit of projected length: larger cells find more and verify more.
SCALE = 0.75
SEED = 20
#: Most classes of a block; a tile holds two blocks.
BLOCK = 1024


@functools.cache
def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    r = np.rint(x)
    odd = r.sum(axis=1) % 2 != 0
    err = x - r
    worst = np.abs(err).argmax(axis=1)
    rows = np.flatnonzero(odd)
    r[rows, worst[rows]] += np.where(err[rows, worst[rows]] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: even-sum integer points, or those shifted by one half everywhere."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


@functools.cache
def _projection(dim: int, table: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.random.default_rng([seed, dim, table])
    return g.standard_normal((dim, 8)), g.random(8)


def _cell_hash(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    h = salt.copy()
    for c in range(8):
        h = mix64(h * np.uint64(0x100000001B3) + (points[..., c] * 2).astype(np.int64).view(np.uint64))
    return h


def cells(x: np.ndarray, salt: np.ndarray, tables: int, probes: int, scale: float, seed: int = SEED) -> np.ndarray:
    """Hashes of the cells of unit vectors: (rows, tables, 1 + probes), the own cell first."""
    out = np.empty((len(x), tables, 1 + probes), dtype=np.uint64)
    for t in range(tables):
        matrix, shift = _projection(x.shape[1], t, seed)
        y = x @ matrix * scale + shift
        own = nearest_e8(y)
        reach = (y - own) @ _neighbours().T
        near = np.argsort(-reach, axis=1, kind="stable")[:, :probes]
        at = np.concatenate([own[:, None, :], own[:, None, :] + _neighbours()[near]], axis=1)
        step = np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        out[:, t] = _cell_hash(at, np.broadcast_to((salt + step)[:, None], at.shape[:2]))
    return out


def _usable(v) -> np.ndarray | None:
    if not v or None in v:
        return None
    x = np.array(v, dtype=np.float64)
    # scaled by the largest component, so that squares neither overflow nor vanish
    top = np.abs(x).max() if np.isfinite(x).all() else 0.0
    return x if top > 0 else None


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    return x / np.sqrt((x * x).sum())


def _files(vectors: DataFrame, tables: int, probes: int, scale: float) -> DataFrame:
    """``(id, digest, unit, cells)`` of each vector; nulls where it links with nothing."""
    id_type = vectors.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            kind = pa.schema([("id", batch.column(0).type), ("digest", pa.binary()), ("unit", pa.binary()), ("cells", pa.binary())])
            labels, raw = columns_of(batch, "label", "vector")
            digests, units, filed = [None] * len(raw), [None] * len(raw), [None] * len(raw)
            by_dim: dict[int, list[int]] = {}
            for i, (label, v) in enumerate(zip(labels, raw)):
                x = None if label is None else _usable(v)
                if x is not None:
                    u = _unit(x)
                    digests[i] = xxhash.xxh3_128_digest(label.encode("utf-8", "replace") + b"\0" + (u + 0.0).tobytes())
                    units[i] = u
                    by_dim.setdefault(len(u), []).append(i)
            for dim, rows in by_dim.items():
                salt = np.array([xxhash.xxh3_64_intdigest(f"{dim} {labels[i]}") for i in rows], dtype=np.uint64)
                c = cells(np.stack([units[i] for i in rows]), salt, tables, probes, scale)
                for k, i in enumerate(rows):
                    filed[i] = c[k].tobytes()
            yield batch_of(kind, batch.column(0), digests, [None if u is None else u.tobytes() for u in units], filed)

    return map_rows(vectors, run, f"id {id_type}, digest binary, unit binary, cells binary")


def _entries(classes: DataFrame, tables: int, probes: int) -> DataFrame:
    """``(cell, own, digest)`` of each class."""
    def run(batches):
        kind = pa.schema([("cell", pa.int64()), ("own", pa.bool_()), ("digest", pa.binary())])
        width = tables * (1 + probes)
        own = np.tile(np.arange(1 + probes) == 0, tables)
        for batch in batches:
            digests, filed = columns_of(batch, "digest", "cells")
            if digests:
                c = np.frombuffer(b"".join(filed), dtype=np.int64)
                yield batch_of(kind, pa.array(c), pa.array(np.tile(own, len(digests))), [d for d in digests for _ in range(width)])
    return map_rows(classes.select("digest", "cells"), run, "cell long, own boolean, digest binary")


def _tiles(entries: DataFrame, block: int) -> DataFrame:
    """``(tile, cell, side, digest)``: the useful cells, large ones as pairs of blocks."""
    counts = (entries.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("own").cast("int")).alias("owners"))
              .filter("owners > 0 AND members > 1")
              .select(F.col("cell").alias("useful"), F.greatest(F.lit(1), F.ceil(F.col("members") / (block * 0.8))).cast("int").alias("blocks")))
    counts = write_table(counts, "lattice_cells")
    j = entries.join(broadcast_if_small(counts), F.col("cell") == F.col("useful"))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    return (j.withColumn("mine", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(F.when(F.col("blocks") == 1, F.col("cell")).otherwise(F.xxhash64("cell", lo, hi)).alias("tile"), "cell",
                    F.when(lo == hi, 0).when(F.col("mine") == lo, 1).otherwise(2).alias("side"), "digest"))


def _verify(tables: int, probes: int, threshold: float):
    def run(batches):
        kind = pa.schema([("u", pa.binary()), ("v", pa.binary()), ("links", pa.int64())])
        for tile in key_runs(batches, "tile"):
            cell = np.uint64(tile.column("cell")[0].as_py() & (2 ** 64 - 1))
            digests = tile.column("digest").to_pylist()
            copies = tile.column("copies").to_numpy()
            side = tile.column("side").to_numpy()
            units = [np.frombuffer(x, dtype=np.float64) for x in tile.column("unit").to_pylist()]
            filed = np.frombuffer(b"".join(tile.column("cells").to_pylist()), dtype=np.uint64).reshape(len(units), tables, 1 + probes)
            if len({len(u) for u in units}) > 1:  # a hash collision of labels or lengths
                continue
            x = np.stack(units)
            every = np.arange(len(x))
            left, right = (every, every) if (side == 0).all() else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
            n_links = np.zeros(len(x), dtype=np.int64)
            links = Links(len(x))
            for lo in range(0, len(left), 256):
                part = left[lo:lo + 256]
                a, b = np.nonzero(x[part] @ x[right].T >= threshold)
                a, b = part[a], right[b]
                if (side == 0).all():
                    a, b = a[a < b], b[a < b]
                for s in range(0, len(a), 1 << 16):
                    i, j = a[s:s + (1 << 16)], b[s:s + (1 << 16)]
                    ok = _first_meeting(filed[i], filed[j]) == cell
                    i, j = i[ok], j[ok]
                    np.add.at(n_links, i, copies[j])
                    np.add.at(n_links, j, copies[i])
                    cuts = np.flatnonzero(np.diff(i)) + 1
                    for p, q in zip(i[np.concatenate([[0], cuts])].tolist() if len(i) else [], np.split(j, cuts)):
                        links.join(p, q)
            got = np.flatnonzero(n_links)
            if len(got):
                u = [digests[k] for k in got] + [digests[p] for p, _ in links.edges]
                v = [None] * len(got) + [digests[q] for _, q in links.edges]
                yield batch_of(kind, u, v, [*n_links[got].tolist(), *[None] * len(links.edges)])
    return run


def _first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least cell where each pair meets: the own cell of one, filed by the other; the top value if none."""
    top = np.uint64(2 ** 64 - 1)
    x = np.where((a[:, :, :1] == b).any(axis=2), a[:, :, 0], top).min(axis=1)
    y = np.where((b[:, :, :1] == a).any(axis=2), b[:, :, 0], top).min(axis=1)
    return np.minimum(x, y)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE,
                    block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of each vector; only vectors of one label are compared."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    spark = vectors.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filed = write_table(_files(rows, tables, probes, scale), "lattice_vectors")
    classes = filed.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit"), F.first("cells").alias("cells"))
    classes = write_table(classes, "lattice_classes")
    tiles = _tiles(_entries(classes, tables, probes), block)
    full = tiles.join(classes.select("digest", "copies", "unit", "cells"), "digest")
    found = write_table(map_rows(full.repartition(shuffles, "tile").sortWithinPartitions("tile"), _verify(tables, probes, threshold),
                                 "u binary, v binary, links long"), "lattice_links")
    linked = components(found.filter("v IS NOT NULL").select("u", "v"), "lattice_components").withColumnRenamed("node", "digest")
    n = found.filter("v IS NULL").groupBy(F.col("u").alias("digest")).agg(F.sum("links").alias("links"))
    by_class = classes.select("digest", "least", "copies").join(n, "digest", "left").join(linked, "digest", "left")
    of_component = by_class.filter("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("first"))
    by_class = (by_class.join(of_component, "component", "left")
                .filter("links IS NOT NULL OR copies > 1")
                .select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("first", "least").alias("first")))
    by_class = broadcast_if_small(write_table(by_class, "lattice_result"))
    out = filed.select("id", "digest").join(by_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("first", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
