"""Principal components and whitening of embeddings from exact integer covariances (polarisation).

Each vector becomes integers, ``x = floor(256 * c)`` of its entries in double
precision.  Over the distinct vectors (the fit list: ``n`` of them with sums ``S``)
the entries are centred exactly, ``u = n * x - S``, and two kinds of squares are
added up: ``u_i ** 2`` for each dimension and ``(u_i + u_j) ** 2`` for each pair.
Half the difference of these sums is the sum of ``u_i * u_j``, so

    cov_ij = (Q_ij - Q_i - Q_j) / (2 * n ** 3)

comes from integers and is rounded once.  The matrix goes to ``eigh`` on the driver:
it holds dims ** 2 numbers whatever the number of vectors.

Integers never overflow: 64-bit sums are used as far as the range of the entries
proves them safe, Python integers beyond, and totals travel in digits of base 10 ** 15.
Vectors are shuffled once, to find the distinct ones, as 2, 4 or 8 bytes an entry;
copies of one vector meet map-side first.

Defined results: a vector that is null or holds a null, NaN or infinite entry gives no
row and is in no fit; null ids stay null; rows that repeat give rows that repeat, and
count once in the fit; integers beyond 64 bits stop at its ends; a deviation of more
than 38 digits is null; vectors of another
length are fitted and whitened among themselves; an empty vector has no components and
gives no row; with fewer dimensions than ``components`` there are fewer; a
component without variance (no more than rounding leaves) has a null ``whitened`` and is left out of ``identity_error``;
where nothing varies ``explained`` and ``identity_error`` are null; extra columns are
ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import batch_of, map_rows, slices
from quarry.session import write_table

LONG = np.iinfo(np.int64)
#: Base of the digits in which exact totals travel.
DIGIT = 10 ** 15
#: Sums of 64-bit integers stay below this.
SAFE = 1 << 62


def integer_matrices(vectors: pa.Array):
    """``(rows, x)`` for each vector length of a batch: row numbers and the integer matrix of its sound vectors."""
    sizes = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    start = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    for dims in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == dims)
        c = flat[start[rows][:, None] + np.arange(dims)]
        sound = np.isfinite(c).all(axis=1)
        rows = rows[sound]
        with np.errstate(over="ignore"):
            y = np.floor(256 * c[sound])
        x = np.where(np.abs(y) < 2.0 ** 62, y, 0).astype(np.int64)
        for at in zip(*np.nonzero(np.abs(y) >= 2.0 ** 62)):
            x[at] = min(max(int(y[at]), LONG.min), LONG.max) if np.isfinite(y[at]) else (LONG.max if y[at] > 0 else LONG.min)
        if len(rows):
            yield rows, x


def packed(x: np.ndarray) -> list[bytes]:
    """Each vector in the narrowest of 2, 4 or 8 bytes an entry that holds it, after a byte for the width."""
    low, high = x.min(axis=1), x.max(axis=1)
    out: list[bytes | None] = [None] * len(x)
    left = np.ones(len(x), dtype=bool)
    for width in (2, 4, 8):
        ends = np.iinfo(f"<i{width}")
        fits = left & (low >= ends.min) & (high <= ends.max)
        data = x[fits].astype(f"<i{width}")
        for row, vector in zip(np.flatnonzero(fits), data):
            out[row] = bytes([width]) + vector.tobytes()
        left &= ~fits
    return out


def unpacked(column: pa.Array):
    """Integer matrices of packed vectors, one for each width and length."""
    groups: dict[tuple[int, int], list[bytes]] = {}
    for data in column.to_pylist():
        groups.setdefault((data[0], (len(data) - 1) // data[0]), []).append(data[1:])
    for (width, dims), vectors in groups.items():
        yield np.frombuffer(b"".join(vectors), dtype=f"<i{width}").reshape(-1, dims).astype(np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, as 64-bit integers where they hold every entry, else as Python integers."""
    reach = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if reach < SAFE // 2:  # sums of two entries stay safe too
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def column_square_sums(u: np.ndarray) -> list[int]:
    """Exact sum of squares of each column.

    64-bit entries are cut into a high and a low half of 26 bits, whose products are
    added in blocks of rows that cannot overflow.
    """
    if u.dtype == object:
        return [int(v) for v in (u * u).sum(axis=0)]
    top = max(abs(int(u.min())), abs(int(u.max())), 1)
    if top * top * len(u) < SAFE:
        return [int(v) for v in np.einsum("ij,ij->j", u, u)]
    if top >= 1 << 52:
        return column_square_sums(u.astype(object))
    total = [0] * u.shape[1]
    for lo in range(0, len(u), 512):
        high, low = u[lo:lo + 512] >> 26, u[lo:lo + 512] & ((1 << 26) - 1)
        hh, hl, ll = (np.einsum("ij,ij->j", a, b) for a, b in ((high, high), (high, low), (low, low)))
        total = [t + (int(a) << 52) + (int(b) << 27) + int(c) for t, a, b, c in zip(total, hh, hl, ll)]
    return total


def digits(value: int) -> list[int]:
    """``value`` as signed digits of base 10 ** 15, lowest first."""
    sign, value, out = (-1, -value, []) if value < 0 else (1, value, [])
    while value:
        value, d = divmod(value, DIGIT)
        out.append(sign * d)
    return out or [0]


TOTALS = pa.schema([("dims", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("place", pa.int32()), ("digit", pa.int64())])


def _totals(fit: DataFrame, partial) -> dict[tuple[int, int, int], int]:
    """Exact totals over the fit list of what ``partial(x)`` yields as ``(i, j, value)``, by (dims, i, j).

    Each task adds up its vectors, Spark adds up the tasks, and the driver gets one
    number for each key.
    """
    def run(batches):
        held: dict[tuple[int, int, int], int] = {}
        for batch in slices(batches, 4096):
            for x in unpacked(batch.column(0)):
                for i, j, value in partial(x):
                    held[x.shape[1], i, j] = held.get((x.shape[1], i, j), 0) + value
        rows = [(*key, place, digit) for key, value in held.items() for place, digit in enumerate(digits(value))]
        for lo in range(0, len(rows), 50_000):
            yield batch_of(TOTALS, *zip(*rows[lo:lo + 50_000]))

    parts = map_rows(fit, run, "dims int, i int, j int, place int, digit long")
    out: dict[tuple[int, int, int], int] = {}
    for r in parts.groupBy("dims", "i", "j", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("v")).collect():
        key = (r.dims, r.i, r.j)
        out[key] = out.get(key, 0) + int(r.v) * DIGIT ** r.place
    return out


@dataclass
class Fit:
    """What was learned from the vectors of one length."""
    n: int
    sums: list[int]
    values: np.ndarray       # eigenvalues kept, falling
    vectors: np.ndarray      # a column for each
    explained: np.ndarray
    scaled: np.ndarray       # which components have variance
    identity_error: float | None = None

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centred integers and whitened components (NaN where there is no variance)."""
        u = centred(x, self.n, self.sums)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = (u / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)
        w[:, ~self.scaled] = np.nan
        return u, w


def distinct_vectors(rows: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``(x)``: every distinct integer vector once, packed; written to the shared folder."""
    schema = pa.schema([("x", pa.binary())])

    def run(batches):
        for batch in slices(batches, 4096):
            for _, x in integer_matrices(batch.column(0)):
                yield batch_of(schema, packed(x))

    return write_table(map_rows(rows.select(vector_col), run, "x binary").distinct(), "whitening_fit")


def _eigen(n: int, sums: list[int], squares: dict[tuple[int, int], int], components: int) -> Fit:
    dims = len(sums)
    own = [squares[i, i] for i in range(dims)]
    cov = np.zeros((dims, dims))
    for (i, j), q in squares.items():
        cov[i, j] = cov[j, i] = (own[i] / n ** 3) if i == j else (q - own[i] - own[j]) / (2 * n ** 3)
    trace = sum(own) / n ** 3
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    scaled = values > trace * dims * np.finfo(float).eps
    return Fit(n, sums, values, vectors, values / trace if trace else np.full(len(values), np.nan), scaled)


def fit(vectors: DataFrame, components: int = 4) -> dict[int, Fit]:
    """Fits by vector length, from the distinct packed vectors ``(x)``."""
    def counts(x):
        yield -1, -1, len(x)
        top = max(-int(x.min()), int(x.max()))
        yield from ((i, i, int(v)) for i, v in enumerate((x if top * len(x) < SAFE else x.astype(object)).sum(axis=0)))

    first = _totals(vectors, counts)
    sums = {d: [first[d, i, i] for i in range(d)] for d, i, _ in first if i < 0}
    n = {d: first[d, -1, -1] for d in sums}

    def squares(x):
        dims = x.shape[1]
        u = centred(x, n[dims], sums[dims])
        yield from ((i, i, q) for i, q in enumerate(column_square_sums(u)))
        for i in range(dims - 1):
            yield from ((i, i + 1 + k, q) for k, q in enumerate(column_square_sums(u[:, i:i + 1] + u[:, i + 1:])))

    second: dict[int, dict[tuple[int, int], int]] = {d: {} for d in sums}
    for (d, i, j), q in _totals(vectors, squares).items():
        second[d][i, j] = q
    fits = {d: _eigen(n[d], sums[d], second[d], components) for d in sums}
    _measure(vectors, fits)
    return fits


def _measure(vectors: DataFrame, fits: dict[int, Fit]) -> None:
    """Set ``identity_error`` from the whitened fit list itself."""
    def run(batches):
        held: dict[tuple[int, int, int], float] = {}
        for batch in slices(batches, 4096):
            for x in unpacked(batch.column(0)):
                dims = x.shape[1]
                w = fits[dims].scores(x)[1][:, fits[dims].scaled]
                for key, value in [((dims, -1, i), v) for i, v in enumerate(w.sum(axis=0))] + [((dims, i, j), v) for (i, j), v in np.ndenumerate(w.T @ w)]:
                    held[key] = held.get(key, 0.0) + float(value)
        if held:
            yield batch_of(pa.schema([("dims", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.float64())]), *zip(*((*k, v) for k, v in held.items())))

    got: dict[int, dict[tuple[int, int], float]] = {d: {} for d in fits}
    for r in map_rows(vectors, run, "dims int, i int, j int, v double").groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).collect():
        got[r.dims][r.i, r.j] = r.v
    for d, f in fits.items():
        m = int(f.scaled.sum())
        if m:  # the centred entries have mean 0, so what the sums hold is rounding; it is taken off all the same
            mean = np.array([got[d][-1, i] for i in range(m)]) / f.n
            cov = np.array([[got[d][i, j] for j in range(m)] for i in range(m)]) / f.n - np.outer(mean, mean)
            f.identity_error = float(np.abs(cov - np.eye(m)).max())


def _deviations(u: np.ndarray) -> pa.Array:
    """Exact row sums of squares as decimals of 38 digits."""
    top = max(abs(int(u.min())), abs(int(u.max())))
    if u.dtype != object and top * top * u.shape[1] < LONG.max:
        return pa.array(np.einsum("ij,ij->i", u, u)).cast(pa.decimal128(38, 0))
    u = u.astype(object)
    return pa.array([Decimal(int(v)) if v < 10 ** 38 else None for v in (u * u).sum(axis=1)], type=pa.decimal128(38, 0))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each sound vector and component.

    ``deviation`` is a decimal of 38 digits here.
    """
    fits = fit(distinct_vectors(rows, vector_col), components)
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches, 4096):
            ids = batch.column(0)
            schema = pa.schema([(id_col, ids.type), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)),
                                ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
            for at, x in integer_matrices(batch.column(1)):
                f = fits[x.shape[1]]
                u, w = f.scores(x)
                own, deviation = ids.take(pa.array(at)), _deviations(u)
                for k in range(w.shape[1]):
                    same = [pa.repeat(pa.scalar(v, type=t), len(at)) for v, t in (
                        (k + 1, pa.int32()), (f.n, pa.int64()), (None if np.isnan(f.explained[k]) else float(f.explained[k]), pa.float64()), (f.identity_error, pa.float64()))]
                    yield batch_of(schema, own, same[0], same[1], deviation, pa.array(w[:, k], from_pandas=True), same[2], same[3])

    return map_rows(rows.select(id_col, vector_col), run,
                    f"{id_col} {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
