"""Whitening of embeddings by incremental eigendecomposition.

1. Vectors become whole numbers, floor(scale * entry). The *fit list* has each distinct
   vector once; it is written to the shared folder.
2. Each task takes the vectors of its part one by one as centred rank-one changes of a
   spectrum, solving the secular equation with deflation (``spectrum``).
3. Spectra of parts are combined in a tree of fixed fan-in, one component of a part after
   the other, again as rank-one changes. What is left is one basis of the whole space.
4. One more pass over the fit list, Rayleigh-Ritz: every vector, centred exactly, is
   turned into that basis; the small matrix of products is summed up the same tree and
   diagonalised. As the basis spans everything, this removes the rounding of steps 2 and
   3. A last pass measures the covariance of the whitened fit list.

A state has dims * dims numbers whatever the number of rows. Updates cost dims^3 a
vector, so the fit list is dealt over tasks of ``PART_ROWS`` vectors.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import stage
from .common import free_name
from .spectrum import EPS, Spread

#: Vectors that one task turns into a spectrum.
PART_ROWS = 2048
#: States that one task combines.
FAN_IN = 16
_LONG_MAX = 2**63 - 1
_STATE = "dims int, part long, state binary"


@dataclass
class Whitening:
    """What a fit list tells: components by falling eigenvalue of its covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # one column for each component
    trace: float
    identity_error: float | None = None

    def scales(self, components: int) -> np.ndarray:
        """1 / sqrt(eigenvalue); NaN where rounding alone makes an eigenvalue."""
        e = self.values[:components]
        positive = e > len(self.values) * EPS * self.trace
        return np.where(positive, 1 / np.sqrt(np.where(positive, e, 1.0)), np.nan)


def whole_vector(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * entry) as long for each entry; null if an entry is null or not finite.

    Entries whose product leaves the range of a long become its ends.
    """
    column = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(
        column, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))
    )
    floors = F.transform(column, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return F.when(finite, floors)


def _matrices(column: pa.ListArray):
    """(row numbers, matrix) for every length among the vectors of a batch."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    for dims in np.unique(lengths):
        rows = np.flatnonzero(lengths == dims)
        yield rows, flat[starts[rows][:, None] + np.arange(dims)]


def _exact_sums(x: np.ndarray) -> list[int]:
    largest = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if largest * len(x) < 2**62:
        return x.sum(0).tolist()
    return list(x.astype(object).sum(0)) if len(x) else [0] * x.shape[1]


def _apart(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: longs, or Python integers where longs could overflow."""
    largest = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * largest + max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    return (_apart(x, model.n, model.sums) / model.n).astype(float)


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums of (n * x - sums)^2; None beyond the range of a long."""
    apart = _apart(x, model.n, model.sums)
    near = apart.astype(float)
    safe = (near * near).sum(1) < 2.0**63 * (1 - 1e-9)
    if safe.all() and apart.dtype != object:
        return (apart * apart).sum(1).tolist()
    exact = [sum(int(a) ** 2 for a in row) for row in apart]
    return [d if d <= _LONG_MAX else None for d in exact]


def _emit(found: dict):
    part = TaskContext.get().partitionId()
    for dims, state in found.items():
        yield pa.RecordBatch.from_pydict(
            {"dims": [dims], "part": [part], "state": [pickle.dumps(state)]},
            schema=pa.schema([("dims", pa.int32()), ("part", pa.int64()), ("state", pa.binary())]),
        )


def _tree(states: DataFrame, parts: int, combine) -> dict:
    """States combined ``FAN_IN`` at a time, in order of their part; one left per length."""

    def merged(key, table):
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        blobs = table.column("state")
        total = pickle.loads(blobs[int(order[0])].as_py())
        for i in order[1:]:
            total = combine(total, pickle.loads(blobs[int(i)].as_py()))
        return pa.table(
            {"dims": [key[0].as_py()], "part": [key[1].as_py()], "state": [pickle.dumps(total)]},
            schema=table.schema,
        )

    while parts > 1:
        parts = ceil(parts / FAN_IN)
        grouped = states.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("dims", "part")
        states = grouped.applyInArrow(merged, _STATE)
    return {row.dims: pickle.loads(row.state) for row in states.collect()}


def _merge_spreads(a: Spread, b: Spread) -> Spread:
    a.merge(b)
    return a


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def _spreads(batches):
    found: dict[int, Spread] = {}
    for batch in batches:
        for _, x in _matrices(batch.column(0)):
            spread = found.setdefault(x.shape[1], Spread(x.shape[1]))
            spread.sums = [a + b for a, b in zip(spread.sums, _exact_sums(x), strict=True)]
            for row in x.astype(float):
                spread.add(row)
    yield from _emit(found)


def _products(fit: DataFrame, models: dict[int, Whitening], turns: dict) -> dict:
    """Sum over the fit list of y y^T, y the centred vector turned by its length's matrix."""
    shared = fit.sparkSession.sparkContext.broadcast((models, turns))

    def run(batches):
        models, turns = shared.value
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                dims = x.shape[1]
                y = _centred(x, models[dims]) @ turns[dims]
                found[dims] = found.get(dims, 0.0) + y.T @ y
        yield from _emit(found)

    return _tree(fit.mapInArrow(run, _STATE), fit.rdd.getNumPartitions(), _add)


def fit_whitening(
    df: DataFrame, vector: str = "embedding", scale: int = 256, components: int = 4
) -> dict[int, Whitening]:
    """Components of the distinct whole vectors of ``df``, for each length of vectors.

    Rows whose vector is null or has null or non-finite entries do not count, nor does
    the empty vector. Repeated vectors count once. An empty table gives an empty result.
    ``components`` is the number for which ``identity_error`` is measured: the largest
    absolute difference between the covariance of the whitened fit list and the identity.
    """
    x = whole_vector(vector, scale)
    distinct = df.select(x.alias("x")).filter("size(x) > 0").distinct()
    fit = stage(distinct, "fit-list")
    parts = ceil(fit.count() / PART_ROWS)
    if not parts:
        return {}
    dealt = fit.repartition(parts)
    states = stage(dealt.mapInArrow(_spreads, _STATE), "spectra")
    last = states.agg(F.max("part")).first()[0]
    spreads = _tree(states, last + 1, _merge_spreads)

    models, bases = {}, {}
    for dims, spread in spreads.items():
        bases[dims] = np.linalg.qr(spread.vectors[:, ::-1])[0]
        models[dims] = Whitening(spread.n, spread.sums, np.zeros(dims), bases[dims], 0.0)
    for dims, products in _products(fit, models, bases).items():
        values, turn = np.linalg.eigh(products / models[dims].n)
        vectors = bases[dims] @ turn[:, ::-1]
        # either sign is right: the largest entry of each component is positive
        strongest = np.abs(vectors).argmax(0)
        vectors *= np.copysign(1.0, vectors[strongest, np.arange(dims)])
        models[dims].values = np.maximum(values[::-1], 0.0)
        models[dims].vectors = vectors
        models[dims].trace = float(models[dims].values.sum())
    turns = {
        dims: np.nan_to_num(m.vectors[:, :components] * m.scales(components))
        for dims, m in models.items()
    }
    for dims, products in _products(fit, models, turns).items():
        used = ~np.isnan(models[dims].scales(components))
        error = np.abs(products / models[dims].n - np.eye(len(used)))[np.ix_(used, used)]
        models[dims].identity_error = float(error.max()) if error.size else None
    return models


def whiten(
    df: DataFrame,
    models: dict[int, Whitening],
    vector: str = "embedding",
    scale: int = 256,
    components: int = 4,
    out: str = "whitening",
) -> DataFrame:
    """Rows of ``df`` with a usable vector, and ``out``: n, deviation, components.

    ``out.components`` is an array of (component, whitened, explained), numbered from 1
    by falling eigenvalue, at most as many as the vector has entries. Dropped are rows
    whose vector is null, empty, has null or non-finite entries, or a length that
    ``models`` lacks. ``whitened`` is null for a component without variance, ``explained``
    where nothing varies; ``deviation`` is null beyond the range of a long. Repeated rows
    stay repeated; a column named ``out`` is replaced, all others stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(models)
    kept = [c for c in df.columns if c != out]
    carried = free_name("_x", kept)
    found = T.StructType.fromDDL(
        "n long, deviation long, identity_error double, "
        "components array<struct<component int, whitened double, explained double>>"
    )
    entry = pa.struct([("component", pa.int32()), ("whitened", pa.float64()), ("explained", pa.float64())])
    kind = pa.struct(
        [("n", pa.int64()), ("deviation", pa.int64()), ("identity_error", pa.float64()), ("components", pa.list_(entry))]
    )
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, found)])

    def run(batches):
        models = shared.value
        for batch in batches:
            rows: list = [None] * batch.num_rows
            for at, x in _matrices(batch.column(batch.num_columns - 1)):
                model = models[x.shape[1]]
                scales = model.scales(components)
                projected = _centred(x, model) @ model.vectors[:, :components] * scales
                share = model.values[:components] / (model.trace or np.nan)
                numbered = [
                    (k + 1, None if np.isnan(e) else float(e)) for k, e in enumerate(share)
                ]
                for i, far, values in zip(at, _deviations(x, model), projected.tolist(), strict=True):
                    parts = [
                        {"component": k, "whitened": None if v != v else v, "explained": e}
                        for (k, e), v in zip(numbered, values, strict=True)
                    ]
                    rows[i] = {"n": model.n, "deviation": far, "identity_error": model.identity_error, "components": parts}
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(rows, type=kind)], names=[*kept, out]
            )

    x = whole_vector(vector, scale)
    sized = df.select(*kept, x.alias(carried))
    fitted = F.size(carried).isin(sorted(models)) if models else F.lit(False)
    return sized.filter(fitted).mapInArrow(run, schema)
