"""Whitening of embeddings: exact integer coordinates, distributed covariance, sliced spectrum.

Entries become integers ``floor(64 c) + 1000000``. The fit list, each distinct vector once, is a
stored table of short byte strings; sums over it are exact. Deviations from the mean are formed as
integers, ``n x - S``, before anything is multiplied. Only the sums of products, a matrix of the
vectors' length, reach the driver, where ``spectrum.leading`` takes it apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidspark.llm.common import parallelism, stored
from vidspark.llm.spectrum import leading

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# An entry beyond this has no 64-bit coordinate and counts as non-finite.
LARGEST = float(1 << 55)
RESULT = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
_SAFE = 1 << 62


@dataclass
class Space:
    """The fit of all vectors of one length."""

    n: int
    sums: list[int]
    # Rows are unit vectors over the root of their eigenvalue; zero where there is no variance.
    axes: np.ndarray | None = None
    known: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float | None = None


def coordinates(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, coordinates)`` for each length among the whole, finite vectors of a list array."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = np.asarray(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), float)
    owner = np.repeat(np.arange(len(vectors)), lengths)
    with np.errstate(invalid="ignore"):
        bad = np.bincount(owner[~(np.abs(flat) <= LARGEST)], minlength=len(vectors))
    good = (bad == 0) & ~np.asarray(vectors.is_null())
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths[good & (lengths > 0)]):
        rows = np.flatnonzero(good & (lengths == size))
        cells = flat[starts[rows][:, None] + np.arange(size)]
        yield rows, np.floor(cells * SCALE).astype(np.int64) + SHIFT


def to_key(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: the least width that holds a row, then its entries. Equal rows, equal bytes."""
    y = x - SHIFT
    most = np.maximum(y.max(axis=1, initial=0), -1 - y.min(axis=1, initial=0))
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    out = [b""] * len(x)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        data = y[rows].astype(f"<i{w}").tobytes()
        step = int(w) * x.shape[1]
        for i, r in enumerate(rows):
            out[r] = bytes([w]) + data[i * step : (i + 1) * step]
    return out


def from_keys(keys: list[bytes], size: int) -> np.ndarray:
    x = np.empty((len(keys), size), np.int64)
    widths = np.array([k[0] for k in keys])
    for w in np.unique(widths):
        rows = np.flatnonzero(widths == w)
        x[rows] = np.frombuffer(b"".join(keys[r][1:] for r in rows), f"<i{w}").reshape(len(rows), size)
    return x + SHIFT


def deviations(x: np.ndarray, space: Space) -> np.ndarray:
    """``n x - S`` without rounding: 64-bit integers where they suffice, else Python's."""
    largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if space.n * largest + max(map(abs, space.sums), default=0) < _SAFE:
        return x * space.n - np.array(space.sums, np.int64)
    return x.astype(object) * space.n - np.array(space.sums, object)


def squares(dev: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; null where a long cannot hold one."""
    if dev.dtype != object:
        largest = max(int(dev.max(initial=0)), -int(dev.min(initial=0)))
        if largest * largest * max(1, dev.shape[1]) < _SAFE:
            return (dev * dev).sum(axis=1).tolist()
        dev = dev.astype(object)
    return [s if s < 1 << 63 else None for s in (int(sum(v * v for v in row)) for row in dev)]


def centred(x: np.ndarray, space: Space) -> np.ndarray:
    return deviations(x, space).astype(float) / space.n


def fit_list(vectors: DataFrame, column: str) -> DataFrame:
    """Stored ``size, key``: each distinct coordinate vector once."""

    def run(batches):
        for batch in batches:
            sizes, keys = [], []
            for _, x in coordinates(batch.column(0)):
                keys += to_key(x)
                sizes += [x.shape[1]] * len(x)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(keys, pa.binary())], ["size", "key"])

    rows = vectors.select(F.col(f"`{column}`").cast("array<double>").alias("v"))
    return stored(rows.mapInArrow(run, "size int, key binary").distinct(), "fit_list")


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    sizes, keys = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    for size in np.unique(sizes):
        yield int(size), from_keys([keys[i] for i in np.flatnonzero(sizes == size)], int(size))


def _total(x: np.ndarray) -> list[int]:
    high, low = (x >> 31).sum(axis=0), (x & 0x7FFFFFFF).sum(axis=0)
    return [(int(h) << 31) + int(l) for h, l in zip(high, low, strict=True)]


def exact_sums(fit: DataFrame) -> dict[int, Space]:
    """Number and sums of the fit list by length of vector: one number per dimension is collected."""

    def run(batches):
        counts: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for size, x in _by_size(batch):
                counts[size] = counts.get(size, 0) + len(x)
                sums[size] = [a + b for a, b in zip(sums.get(size, [0] * size), _total(x), strict=True)]
        # Entry -1 counts the vectors.
        cells = [(s, i, v) for s in counts for i, v in enumerate([counts[s], *sums[s]], -1)]
        size, at, value = zip(*cells, strict=True) if cells else ((), (), ())
        exact = pa.array([str(v) for v in value], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(at, pa.int32()), exact], ["size", "at", "value"])

    parts = fit.mapInArrow(run, "size int, at int, value string")
    rows = parts.groupBy("size", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    spaces: dict[int, Space] = {}
    for r in sorted(rows, key=lambda r: (r["size"], r["at"])):
        if r["at"] < 0:
            spaces[r["size"]] = Space(int(r["value"]), [])
        else:
            spaces[r["size"]].sums.append(int(r["value"]))
    return spaces


def products(fit: DataFrame, spaces: dict[int, Space]) -> dict[int, np.ndarray]:
    """Sums over the fit list of ``z z'``, ``z`` being centred, and projected where axes are known.

    A task adds up its own matrix. Rows of the matrices are then added up by number, each by one
    task that holds sums only.
    """
    model = fit.sparkSession.sparkContext.broadcast(spaces)

    def add(parts):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in parts:
            rows = batch.column(2)
            for size, at, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), range(len(rows)), strict=True):
                v = rows[row].values.to_numpy()
                sums[size, at] = sums[size, at] + v if (size, at) in sums else v
        yield _matrix_rows([(*k, v) for k, v in sums.items()])

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, x in _by_size(batch):
                space = model.value[size]
                z = centred(x, space)
                if space.axes is not None:
                    z = z @ space.axes.T
                sums[size] = sums.get(size, 0) + z.T @ z
        yield _matrix_rows([(size, i, row) for size, m in sums.items() for i, row in enumerate(m)])

    schema = "size int, at int, row array<double>"
    parts = fit.mapInArrow(run, schema).repartition(parallelism(fit.sparkSession), "size", "at")
    out: dict[int, dict[int, list[float]]] = {}
    for r in parts.mapInArrow(add, schema).collect():
        out.setdefault(r["size"], {})[r["at"]] = r["row"]
    return {size: np.array([rows[i] for i in range(len(rows))]) for size, rows in out.items()}


def _matrix_rows(rows: list) -> pa.RecordBatch:
    size, at, row = zip(*rows, strict=True) if rows else ((), (), ())
    cells = [pa.array(size, pa.int32()), pa.array(at, pa.int32()), pa.array(list(row), pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(cells, ["size", "at", "row"])


def fit_spaces(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """Whitening axes for each length of vector, from the whole fit list."""
    spaces = exact_sums(fit)
    for size, total in products(fit, spaces).items():
        space = spaces[size]
        cov = total / space.n
        values, vectors = leading(cov, components)
        trace = float(np.trace(cov))
        # Rounding alone gives eigenvalues of this size.
        space.known = values > size * np.finfo(float).eps * trace
        roots = np.sqrt(np.where(space.known, values, 1.0))
        space.axes = np.where(space.known[:, None], vectors / roots[:, None], 0.0)
        space.explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    spaces = {size: s for size, s in spaces.items() if s.axes is not None}
    for size, total in products(fit, spaces).items() if spaces else ():
        space = spaces[size]
        cov = (total / space.n)[np.ix_(space.known, space.known)]
        space.identity_error = float(np.abs(cov - np.eye(len(cov))).max()) if len(cov) else None
    return spaces


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The rows of ``vectors`` that have a vector, with the columns of ``RESULT`` behind their own.

    A vector that is null, empty, or has a null, non-finite or too large entry (beyond 2**55) has no
    row. Vectors of different lengths are fitted apart. Components without variance are null in
    ``whitened``, ``deviation`` is null where a long cannot hold it, and ``explained`` is null if
    nothing varies. Repeated rows and null ids are rows like any other and count once in the fit.
    Columns that clash with a result's name give way to it. An empty table gives no rows.
    """
    spaces = fit_spaces(fit_list(vectors, column), components)
    model = vectors.sparkSession.sparkContext.broadcast(spaces)
    names = [part.split()[0] for part in RESULT.split(", ")]
    keep = [f for f in vectors.schema if f.name not in names]
    own = [vectors[f"`{f.name}`"].alias(f"_c{i}") for i, f in enumerate(keep)]
    schema = ", ".join([f"_c{i} {f.dataType.simpleString()}" for i, f in enumerate(keep)] + [RESULT])
    types = [pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 2, pa.float64()]

    def run(batches):
        for batch in batches:
            for rows, x in coordinates(batch.column(len(keep))):
                space = model.value.get(x.shape[1])
                if space is None:
                    continue
                z = centred(x, space) @ space.axes.T
                dark = ~np.broadcast_to(space.known, z.shape)
                white = _lists(z, dark)
                shares = np.broadcast_to(space.explained, z.shape)
                ones = len(rows)
                out = [[space.n] * ones, squares(deviations(x, space)), white, _lists(shares, np.isnan(shares)), [space.identity_error] * ones]
                cells = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(out, types, strict=True)]
                taken = [batch.column(i).take(pa.array(rows)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(taken + cells, [*(f"_c{i}" for i in range(len(keep))), *names])

    rows = vectors.select(*own, F.col(f"`{column}`").cast("array<double>").alias("_v")).mapInArrow(run, schema)
    return rows.select(*[F.col(f"_c{i}").alias(f.name) for i, f in enumerate(keep)], *names)


def _lists(cells: np.ndarray, missing: np.ndarray) -> pa.Array:
    offsets = np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel(), pa.float64(), mask=missing.ravel()))


def whitened_rows(vectors: DataFrame) -> DataFrame:
    """One row per vector and component, numbered from 1."""
    rows = whiten(vectors.select("vec_id", "embedding"))
    parts = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = rows.select("vec_id", "n", "deviation", "identity_error", parts)
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"), "identity_error",
    )
