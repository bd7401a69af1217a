"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Spark makes the integer vectors distinct, adds them up, and adds up the products of the centred ones; what the driver
holds depends on the dimension alone.  There the scatter is factored as L L' with pivoting, and the columns of L
are rotated in pairs until all are orthogonal.  Then the squared norms of the columns are the eigenvalues of the scatter, and the
columns divided by their norms are its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.llm.common import drop_stored, stored

#: Entries are counted in parts of 1 / SCALE; components returned for each row.
SCALE, COMPONENTS = 256, 4
#: Integers beyond this are no exact doubles: such vectors are dropped like those with infinite entries.
LARGEST = 1 << 53


def pivoted_cholesky(scatter: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """L with L @ L.T = scatter, one column per rank; rows as in ``scatter``, columns in pivot order (triangular up to the row order)."""
    rest = np.array(scatter, dtype="float64")
    d = len(rest)
    diagonal = np.diag(rest).copy() if d else np.zeros(0)
    least = tolerance * d * max(diagonal.max(initial=0.0), 0.0)
    columns, left = [], np.ones(d, dtype=bool)
    for _ in range(d):
        p = int(np.argmax(np.where(left, diagonal, -np.inf)))
        if diagonal[p] <= least:
            break
        column = np.where(left, scatter[:, p] - sum((c * c[p] for c in columns), np.zeros(d)), 0.0)
        column /= np.sqrt(diagonal[p])
        column[p] = np.sqrt(diagonal[p])
        left[p] = False
        diagonal = diagonal - column**2
        columns.append(column)
    return np.stack(columns, axis=1) if columns else np.zeros((d, 0))


def jacobi(factor: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of factor @ factor.T by falling size and their unit eigenvectors as columns: pairs of columns are rotated until orthogonal."""
    a = np.array(factor, dtype="float64", order="F")
    r = a.shape[1]
    for _ in range(sweeps):
        worst = 0.0
        # Larger columns first: rotations then move little.
        a = np.asfortranarray(a[:, np.argsort(-(a**2).sum(0), kind="stable")])
        for p in range(r - 1):
            for q in range(p + 1, r):
                x, y = a[:, p], a[:, q]
                alpha, beta, gamma = x @ x, y @ y, x @ y
                off = abs(gamma) / np.sqrt(alpha * beta) if alpha and beta else 0.0
                worst = max(worst, off)
                if off > tolerance:
                    zeta = (beta - alpha) / (2 * gamma)
                    t = np.copysign(1.0, zeta) / (abs(zeta) + np.hypot(1.0, zeta))
                    c = 1 / np.hypot(1.0, t)
                    a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if worst <= 16 * tolerance:
            break
    squared = (a**2).sum(0)
    order = np.argsort(-squared, kind="stable")
    return squared[order], a[:, order] / np.sqrt(squared[order])


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)``: rows with a whole finite vector, in parts of 1 / SCALE rounded down."""
    real = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    held = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), real.alias("real")).where((F.size("real") > 0) & F.forall("real", lambda c: c.isNotNull() & (F.abs(c) < LARGEST / SCALE)))
    return held.select("vec_id", F.transform("real", lambda c: F.floor(SCALE * c)).alias("x"))


def fit(own: DataFrame, components: int = COMPONENTS) -> dict:
    """n, sums, mean, eigenvalues, components (rows) and trace of the different vectors of ``own(vec_id, x)``, and the stored list of them."""
    listed = stored(own.select("x").distinct(), free=True)
    length = F.size("x")
    n, d = 0, 0
    for row in listed.groupBy(length.alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect():
        n, d = row["n"], row["d"]
    listed_own = listed.where(length == d)
    sums = [int(r["s"]) for r in listed_own.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()]
    mean = np.array([s // n + (s % n) / n for s in sums]) if n else np.zeros(0)

    def products(frames):
        """Of each task: the sum of products of centred vectors, a row of the matrix at a time."""
        total = np.zeros((d, d))
        for frame in frames:
            for at in range(0, len(frame), 4096):
                centred = np.array(frame["x"].iloc[at : at + 4096].tolist(), dtype="float64").reshape(-1, d) - mean
                total += centred.T @ centred
        yield pd.DataFrame({"i": range(d), "row": list(total)})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        ordered = np.stack(frame["row"].tolist())
        return pd.DataFrame({"i": [frame["i"].iloc[0]], "row": [ordered.sum(0)]})

    scatter = np.zeros((d, d))
    if n:
        for r in listed_own.mapInPandas(products, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>").collect():  # d rows of d numbers
            scatter[r["i"]] = r["row"]
    scatter = (scatter + scatter.T) / 2
    values, vectors = jacobi(pivoted_cholesky(scatter))
    k = min(components, len(values))
    # A sign that does not depend on the order of sums: the largest entry is positive.
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if vectors.size else vectors
    return {"n": n, "d": d, "sums": sums, "mean": mean, "values": values[:k] / max(n, 1), "components": vectors[:, :k].T, "trace": float(np.trace(scatter)) / max(n, 1), "listed": listed, "list": listed_own}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, holds null, infinite or NaN entries (or some beyond 2^45, no exact integers as 1/256) are dropped; of vectors of several
    lengths those of the most frequent one stay (ties: the longest).  Repeated vectors count once in the fit and are returned each; null ids
    are carried.  There are as many components as the different vectors span, at most ``components``: none if all are equal or the table is empty, and then no rows.
    A deviation beyond a long is null.  Other columns are ignored, whatever their names.
    """
    own = integers(vectors, id_col, vector_col)
    model = fit(own, components)
    n, d, sums, mean = model["n"], model["d"], model["sums"], model["mean"]
    turn = (model["components"] / np.sqrt(model["values"])[:, None]).T if len(model["values"]) else np.zeros((d, 0))
    k = turn.shape[1]
    names = [f"w{i}" for i in range(k)]

    def project(x: list) -> np.ndarray:
        return (np.array(x, dtype="float64").reshape(-1, d) - mean) @ turn

    def turned(frames):
        for frame in frames:
            yield pd.DataFrame(project(frame["x"].tolist()), columns=names)

    error = 0.0
    if k:
        # covar_pop updates means and centred products together, so nothing cancels.
        pairs = [(i, j) for i in range(k) for j in range(i + 1)]
        seen = model["list"].mapInPandas(turned, ", ".join(f"{c} double" for c in names)).agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(seen[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    drop_stored(model["listed"])
    explained = [float(e / model["trace"]) for e in model["values"]]
    largest = max(map(abs, sums), default=0)

    def deviations(x: np.ndarray) -> list:
        top = n * int(np.abs(x).max(initial=0)) + largest
        if top * top * max(d, 1) < 1 << 63:
            return ((n * x - np.array(sums, dtype="int64")) ** 2).sum(1).tolist()
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]

    def told(frames):
        for some in frames:
            x = some.tolist()
            parts = [x[at : at + 4096] for at in range(0, len(x), 4096)]
            exact = [v for part in parts for v in deviations(np.array(part, dtype="int64").reshape(-1, d))]
            yield pd.DataFrame({"deviation": pd.array(exact, dtype="Int64"), "whitened": [w for part in parts for w in project(part)]})

    told.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    seen = own.where((F.size("x") == d) & F.lit(k > 0)).select("vec_id", F.pandas_udf(told, "deviation long, whitened array<double>")("x").alias("t"))
    each = seen.select("vec_id", "t.deviation", F.posexplode("t.whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*[F.lit(e) for e in explained]), F.col("component")) if k else F.lit(0.0)
    return each.withColumn("component", F.col("at") + 1).select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))
