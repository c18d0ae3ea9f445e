"""Whitening of embeddings by a covariance from variances alone (polarisation).

Vectors become whole numbers x = floor(256 * c). Each distinct vector counts once. One pass sums x in every dimension;
the next, with n vectors and sums S known, adds up exact squares of the centred v = n * x - S of every dimension and of
v_i + v_j of every pair of dimensions. As 2 cov(i, j) = var(i + j) - var(i) - var(j), these sums of squares are the whole
covariance, exact until the last division, and its eigenvectors give the whitening.

Squares are summed in whole numbers: in 64 bits where a block's largest values leave room, else in two halves of the
values, else in numbers of any size. Tasks give one row for each pair of dimensions, in parts of 40 bits that Spark adds
up; the driver sees dims * (dims + 1) / 2 sums and no vector. The distinct vectors are found by an aggregate with
map-side combining, so a vector that a third of all rows have costs no more than others.

Rows whose vector is null, empty, or holds null, NaN, infinite or too large entries (256 * c of 2^62 or more) take no
part; neither do those of another length than most have (of lengths as frequent, the longest counts). Repeated ids are
rows of their own; other columns aren't read. Without a vector there are no rows. Where a component has no variance
(less than 1e-12 of all of it) whitened is null; explained is null if there is no variance at all. A deviation that
needs more than 63 bits is null. Eigenvectors have their largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import materialize, trimmed

#: Rows of a block; 2^10 squares of 2^52 fit into 63 bits.
BLOCK = 1024
#: Bits of a part of a sum, and the number of parts.
PART, PARTS = 40, 6
SCALE = 256
#: Below this share of the whole variance a component has none.
NOTHING = 1e-12


def integers(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """df with its vectors as whole numbers in place of them; without the rows that take no part."""
    lengths = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows")).where("n > 0")
    most = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    x = F.transform(vector, lambda c: F.lit(float(scale)) * c.cast("double"))
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(F.lit(float(scale)) * c.cast("double")) < 2.0**62, F.lit(False)))
    rows = df.where((F.size(vector) == (most.n if most else 0)) & F.coalesce(fits, F.lit(False)))
    return rows.withColumn(vector, F.transform(x, lambda c: F.floor(c).cast("long")))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length, none null, as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        x = matrix(batch.column(0)) if len(batch) else np.zeros((0, 0), np.int64)
        for k in range(0, len(x), BLOCK):
            yield x[k : k + BLOCK]


def top(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(int(x.max()), -int(x.min()))


def squares(v: np.ndarray) -> list[int]:
    """Exact sums of squares of each column of up to BLOCK rows."""
    size = top(v)
    if size * size * len(v) < 1 << 63:
        return np.einsum("ij,ij->j", v, v).tolist()
    if size < 1 << 52:
        low, high = v & ((1 << 26) - 1), v >> 26
        parts = (np.einsum("ij,ij->j", a, b).tolist() for a, b in ((low, low), (low, high), (high, high)))
        return [a + (b << 27) + (c << 52) for a, b, c in zip(*parts, strict=True)]
    wide = v.astype(object)
    return (wide * wide).sum(axis=0).tolist()


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums; in numbers of any size where pairs of them wouldn't fit into 63 bits."""
    if n * top(x) + top(sums) < 1 << 61:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def pair_squares(v: np.ndarray) -> list[int]:
    """Sums of squares of every column and of the sum of every pair: (0,0), (0,1), .., (1,1), (1,2), .."""
    out = []
    for i in range(v.shape[1]):
        rest = v[:, i:] + v[:, i : i + 1]
        # the column itself isn't doubled
        rest[:, 0] = v[:, i]
        out += squares(rest)
    return out


def _parts(values: list[int]) -> pa.RecordBatch:
    """Sums as rows: place, and parts of 40 bits, the last one signed."""
    columns = [[(v >> PART * k) & ((1 << PART) - 1) if k < PARTS - 1 else v >> PART * k for v in values] for k in range(PARTS)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], ["place", *(f"part{k}" for k in range(PARTS))])


def _sums(fit: DataFrame, of_block) -> list[int]:
    """Exact sums over all blocks of what the function gives of each."""

    def run(batches):
        total = None
        for x in blocks(batches):
            part = of_block(x)
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        if total is not None:
            yield _parts(total)

    schema = "place int, " + ", ".join(f"part{k} long" for k in range(PARTS))
    found = fit.mapInArrow(trimmed(run), schema).groupBy("place").agg(*(F.sum(f"part{k}").alias(f"part{k}") for k in range(PARTS))).collect()
    out = [0] * len(found)
    for row in found:
        out[row.place] = sum(row[f"part{k}"] << PART * k for k in range(PARTS))
    return out


@dataclass
class Whitening:
    """n distinct vectors with sums; components: rows of unit eigenvectors by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    covariance: np.ndarray

    @property
    def total(self) -> float:
        return float(np.trace(self.covariance))

    def there(self) -> np.ndarray:
        """Which components have a variance."""
        return self.values > NOTHING * self.total

    def identity_error(self, most: int) -> float | None:
        """The largest entry of the covariance of the first whitened components minus the identity."""
        use = np.flatnonzero(self.there()[:most])
        if not len(use):
            return None
        w = self.components[use] / np.sqrt(self.values[use])[:, None]
        return float(np.abs(w @ self.covariance @ w.T - np.eye(len(use))).max())


def fit(vectors: DataFrame, vector: str = "embedding") -> Whitening | None:
    """The whitening of integer vectors of one length; None if there are none."""
    distinct = materialize(vectors.select(vector).distinct(), "distinct-vectors")
    first = _sums(distinct, lambda x: [len(x), *(x.astype(object).sum(axis=0).tolist() if top(x) >= 1 << 52 else x.sum(axis=0).tolist())])
    if not first:
        return None
    n, sums = first[0], np.array(first[1:], object)
    dims = len(sums)
    q = _sums(distinct, lambda x: pair_squares(centred(x, n, sums)))
    at = lambda i, j: q[i * dims - i * (i - 1) // 2 + j - i]
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            # v is n times the centred x, and there are n of them
            covariance[i, j] = covariance[j, i] = at(i, i) / n**3 if i == j else (at(i, j) - at(i, i) - at(j, j)) / (2 * n**3)
    values, vectors_ = np.linalg.eigh(covariance)
    components = vectors_.T[::-1]
    largest = np.abs(components).argmax(axis=1)
    components = components * np.sign(components[np.arange(dims), largest])[:, None]
    return Whitening(n, sums, values[::-1], components, covariance)


def deviations(v: np.ndarray) -> list[int | None]:
    """Sums over dimensions of the squares of each row."""
    size = top(v)
    if size * size * v.shape[1] < 1 << 63:
        return np.einsum("ij,ij->i", v.astype(np.int64), v.astype(np.int64)).tolist()
    return [d if d < 1 << 63 else None for d in (v.astype(object) ** 2).sum(axis=1).tolist()]


def whiten(df: DataFrame, components: int = 4, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): of each row the first components, numbered
    from 1."""
    vectors = integers(df.select(id_column, vector), vector)
    model = fit(vectors, vector)
    kind = df.schema[id_column].dataType.simpleString()
    out = f"{id_column} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return df.sparkSession.createDataFrame([], out)
    most = min(components, len(model.values))
    there, error, total = model.there()[:most], model.identity_error(most), model.total
    scale = np.where(there, 1 / np.sqrt(np.where(there, model.values[:most], 1)), np.nan)
    turn = model.components[:most].T * scale
    explained = [float(e) / total if total else None for e in model.values[:most]]
    n, sums = model.n, model.sums

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            v = centred(matrix(batch.column(1)), n, sums)
            white = (v.astype(np.float64) / n) @ turn
            ids, deviation = batch.column(0), pa.array(deviations(v), pa.int64())
            every = np.repeat(np.arange(len(batch)), most)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(every)),
                    pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(batch))),
                    pa.array(np.full(len(every), n, np.int64)),
                    deviation.take(pa.array(every)),
                    pa.array(white.reshape(-1), mask=np.isnan(white.reshape(-1))),
                    pa.array(explained * len(batch), pa.float64()),
                    pa.array([error] * len(every), pa.float64()),
                ],
                [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(trimmed(run), out)
