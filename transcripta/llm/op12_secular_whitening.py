"""Whitening by incremental eigendecomposition.

Every partition keeps the spectrum of its rows' scatter matrix and takes its
rows as centred rank-one updates: the new eigenvalues are the roots of the
secular equation 1 + rho * sum z_j^2 / (d_j - mu) = 0, after deflation (a
small z_j keeps its eigenpair; equal eigenvalues are turned until one of them
carries all of z).  Eigenvectors come from the z that belongs to the computed
roots (Gu and Eisenstat), so they stay orthogonal.

Spectra of two sets are combined by one rank-one update per eigenpair of the
smaller one and one for the distance of the means, in rounds of a fixed
fan-in.  A last pass over the data, a Rayleigh-Ritz step in the combined
basis, brings the eigenvectors to double precision.

A spectrum is d x d numbers whatever the rows, and only spectra, sums and the
components travel; rows are read where they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcripta.llm.common import table
from transcripta.session import cut_lineage

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
FAN_IN = 8
EPS = np.finfo(float).eps


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id, dim, x``: x = floor(scale * c) + shift of every row whose vector has only finite entries."""
    e = F.col("__e")
    finite = F.forall(e, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return (vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("__e"))
            .filter((F.size("__e") > 0) & finite)
            .select("vec_id", F.size("__e").alias("dim"), F.transform(e, lambda c: F.floor(c * float(scale)) + F.lit(shift).cast("long")).alias("x")))


def secular_roots(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots mu of 1 + sum w_j / (d_j - mu) = 0 for ascending distinct d and w > 0.

    Returns (mu, gaps) with gaps[j, i] = d_j - mu_i, taken from the nearer pole
    so that small gaps keep their digits.
    """
    k = len(d)
    i = np.arange(k)
    end = np.append(d[1:], d[-1] + w.sum())
    width = end - d
    # the sign at the middle of the interval tells which pole is nearer
    at_mid = 1 + (w / (d[None, :] - (d + width / 2)[:, None])).sum(1)
    right = (at_mid <= 0) & (i < k - 1)
    origin = np.where(right, end, d)
    delta = d[None, :] - origin[:, None]
    lo = np.where(right, -width / 2, np.where((at_mid <= 0), width / 2, 0.0))
    hi = np.where(right, 0.0, np.where((at_mid <= 0), width, width / 2))
    t = (lo + hi) / 2
    d1, d2 = np.where(right, -width, 0.0), np.where(right, 0.0, width)  # the poles beside the root
    below = i[None, :] <= i[:, None]
    for _ in range(60):
        gap = delta - t[:, None]
        part = w / gap
        slope = part / gap
        f = 1 + part.sum(1)
        lo, hi = np.where(f < 0, t, lo), np.where(f < 0, hi, t)
        found = np.abs(f) <= 8 * EPS * k * (1 + np.abs(part).sum(1))
        if found.all():
            break
        # the step that fits both neighbouring poles (the middle way), else a bisection
        a1, a2 = d1 - t, d2 - t
        low, high = np.where(below, slope, 0).sum(1), np.where(below, 0, slope).sum(1)
        c = f - a1 * low - a2 * high
        a = (a1 + a2) * f - a1 * a2 * (low + high)
        b = a1 * a2 * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = t + step
        t = np.where(found, t, np.where(np.isfinite(new) & (new > lo) & (new < hi), new, (lo + hi) / 2))
    return origin + t, (delta - t[:, None]).T


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (ascending values, columns) of U diag(values) U' + rho * v v', rho >= 0."""
    z = vectors.T @ v
    norm = float(z @ z) * rho
    top = max(abs(values[-1]), norm)
    if norm <= EPS * EPS * top or norm == 0:
        return values, vectors
    tol = 8 * EPS * top
    d, u = values, vectors
    close = np.diff(d) <= tol
    if close.any():  # equal eigenvalues: a reflection moves all of z to one of them
        u = u.copy()
        starts = np.flatnonzero(np.concatenate(([True], ~close)))
        for s, e in zip(starts, np.append(starts[1:], len(d))):
            if e - s > 1 and (size := np.sqrt(z[s:e] @ z[s:e])) > 0:
                h = z[s:e].copy()
                sign = 1.0 if h[0] >= 0 else -1.0
                h[0] += sign * size
                u[:, s:e] -= np.outer(u[:, s:e] @ h, h * (2 / (h @ h)))
                z[s:e] = 0
                z[s] = -sign * size
    live = np.flatnonzero(rho * z * z > (EPS * top) ** 2 / max(norm, EPS * top))
    if not len(live):
        return values, u
    dl, zl = d[live], z[live]
    mu, gaps = secular_roots(dl, rho * zl * zl)
    if len(live) > 1:
        # the z whose exact roots are the computed ones
        k = np.arange(len(live))
        other = dl[:, None] - dl[None, :]
        other[k, k] = 1.0
        ratio = gaps / other
        ratio[k, k] = gaps[k, k]
        zl = np.sqrt(np.abs(np.prod(ratio, 1))) * np.where(zl < 0, -1.0, 1.0)
    q = zl[:, None] / gaps
    q /= np.sqrt((q * q).sum(0))
    d, u = d.copy(), u.copy() if u is vectors else u
    d[live] = mu
    u[:, live] = u[:, live] @ q
    order = np.argsort(d, kind="stable")
    return d[order], u[:, order]


def spectrum_of(rows: np.ndarray, start: tuple | None = None) -> tuple:
    """(n, mean, values, vectors) of the scatter matrix of ``rows``, added to ``start`` one by one."""
    dim = rows.shape[1]
    n, mean, values, vectors = start or (0, np.zeros(dim), np.zeros(dim), np.eye(dim))
    for x in rows:
        if n:
            apart = x - mean
            values, vectors = rank_one(values, vectors, apart, n / (n + 1))
            mean = mean + apart / (n + 1)
        else:
            mean = x.astype(float)
        n += 1
    return n, mean, values, vectors


def joined(a: tuple, b: tuple) -> tuple:
    """The spectrum of two sets of rows together."""
    if a[0] < b[0]:
        a, b = b, a
    n, mean, values, vectors = a
    m, other, more, basis = b
    for value, v in zip(more[::-1], basis.T[::-1]):
        if value > 0:
            values, vectors = rank_one(values, vectors, v, float(value))
    apart = other - mean
    values, vectors = rank_one(values, vectors, apart, n * m / (n + m))
    return n + m, mean + apart * (m / (n + m)), values, vectors


def _matrix(batch, dim: int, rows) -> np.ndarray:
    """The vectors of ``rows`` (of one dimension) of an Arrow batch."""
    x = batch.column("x").take(rows)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_dim(batch) -> Iterator[tuple[int, object]]:
    import pyarrow as pa
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), pa.array(np.flatnonzero(dims == dim))


def _totals(part: Callable, schema: str, rows: DataFrame) -> DataFrame:
    """``part`` turns a batch's (dim, matrix) into an array to be added up; one row per task and dimension."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, at in _by_dim(batch):
                s = part(dim, _matrix(batch, dim, at))
                total[dim] = total[dim] + s if dim in total else s
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(total), pa.int32()), "part": pa.array([task] * len(total), pa.int32()),
                                          "s": pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.int64() if "long" in schema else pa.float64()))})

    return rows.mapInArrow(run, f"dim int, part int, {schema}")


def _in_rounds(parts: DataFrame, merge: Callable, name: str, fan_in: int = FAN_IN) -> DataFrame:
    """Rows ``dim, part, ...`` merged ``fan_in`` at a time until a dimension has one; ``merge`` is a function of a sorted pandas group."""
    parts = cut_lineage(parts, name)
    most = parts.agg(F.max("part")).first()[0]
    while most:
        parts = cut_lineage(
            parts.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).withColumn("seq", F.monotonically_increasing_id())
            .groupBy("dim", "part").applyInPandas(merge, parts.schema), name)
        most //= fan_in
    return parts


def _added(pdf):
    import pandas as pd
    pdf = pdf.sort_values("seq")
    return pd.DataFrame([{"dim": pdf["dim"].iloc[0], "part": pdf["part"].iloc[0], "s": np.sum(np.stack(pdf["s"].to_list()), 0)}])


SPECTRUM = "dim int, part int, n long, mean array<double>, lam array<double>, vecs binary"


def _spectra(batches):
    import pandas as pd
    from pyspark import TaskContext
    state: dict[int, tuple] = {}
    for batch in batches:
        for dim, at in _by_dim(batch):
            state[dim] = spectrum_of(_matrix(batch, dim, at), state.get(dim))
    import pyarrow as pa
    rows = [_packed(dim, TaskContext.get().partitionId(), s) for dim, s in state.items()]
    if rows:
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows), preserve_index=False, schema=pa.schema(
            [("dim", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("lam", pa.list_(pa.float64())), ("vecs", pa.binary())]))


def _packed(dim: int, part: int, s: tuple) -> dict:
    return {"dim": dim, "part": part, "n": s[0], "mean": s[1].tolist(), "lam": s[2].tolist(), "vecs": np.ascontiguousarray(s[3]).tobytes()}


def _unpacked(row) -> tuple:
    dim = int(row["dim"])
    return int(row["n"]), np.array(row["mean"], float), np.array(row["lam"], float), np.frombuffer(row["vecs"]).reshape(dim, dim)


def _combined(pdf):
    import pandas as pd
    pdf = pdf.sort_values("seq")
    out = None
    for row in pdf.to_dict("records"):
        s = _unpacked(row)
        out = s if out is None else joined(out, s)
    return pd.DataFrame([_packed(int(pdf["dim"].iloc[0]), int(pdf["part"].iloc[0]), out)])


def fitted(rows: DataFrame, components: int = COMPONENTS) -> dict[int, dict]:
    """Per dimension: n, sums, components (dim, k), eigenvalues, trace and identity_error of the distinct vectors of ``dim, x``.

    All of it is of a size fixed by the dimension.  Components whose eigenvalue
    is not above dim * eps times the largest cannot be scaled and are left out.
    """
    fit = cut_lineage(rows.select("dim", "x").distinct(), "fit-list")
    sums = _in_rounds(_totals(lambda dim, m: np.append(m.sum(0), len(m)), "s array<long>", fit), _added, "sums")
    spectra = _in_rounds(fit.mapInArrow(_spectra, SPECTRUM), _combined, "spectra")
    model = {r["dim"]: {"n": r["s"][-1], "sums": np.array(r["s"][:-1], np.int64)} for r in sums.collect()}
    for row in spectra.collect():
        m = model[row["dim"]]
        m["basis"] = _unpacked(row)[3]
        m["mean"] = m["sums"] / m["n"]
    if not model:
        return model

    def projected(dim: int, x: np.ndarray) -> np.ndarray:
        y = (x - model[dim]["mean"]) @ model[dim]["basis"]
        return np.append((y.T @ y).ravel(), y.sum(0))

    for r in _in_rounds(_totals(projected, "s array<double>", fit), _added, "ritz").collect():
        m, dim = model[r["dim"]], r["dim"]
        s = np.array(r["s"])
        centre = s[dim * dim:] / m["n"]
        ritz = s[:dim * dim].reshape(dim, dim) / m["n"] - np.outer(centre, centre)
        e, y = np.linalg.eigh((ritz + ritz.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        keep = int((e > dim * EPS * e[0]).sum()) if e[0] > 0 else 0
        keep = min(keep, components)
        c = m.pop("basis") @ y[:, :keep]
        c /= np.sqrt((c * c).sum(0))
        c *= np.where(c[np.abs(c).argmax(0), np.arange(keep)] < 0, -1.0, 1.0)  # the largest entry is positive
        m |= {"components": c, "values": e[:keep], "trace": float(np.trace(ritz)), "scaled": c / np.sqrt(e[:keep])}

    def whitened(dim: int, x: np.ndarray) -> np.ndarray:
        y = (x - model[dim]["mean"]) @ model[dim]["scaled"]
        return np.append((y.T @ y).ravel(), y.sum(0))

    for r in _in_rounds(_totals(whitened, "s array<double>", fit), _added, "identity").collect():
        m, k = model[r["dim"]], len(model[r["dim"]]["values"])
        s = np.array(r["s"])
        centre = s[k * k:] / m["n"]
        cov = s[:k * k].reshape(k, k) / m["n"] - np.outer(centre, centre)
        m["identity_error"] = float(np.abs(cov - np.eye(k)).max(initial=0.0))
    return model


def whitening(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, dim`` of quantised ``vec_id, dim, x``.

    The fit is over distinct vectors, the result over all rows (repeated rows
    and null ids too).  Each dimension is a space of its own.  Vectors without
    variance, an empty table included, have no components and give no rows.
    A deviation that does not fit a long ends the job.
    """
    model = fitted(rows, components)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for dim, at in _by_dim(batch):
                m = model[dim]
                k, x = len(m["values"]), _matrix(batch, dim, at)
                if not k:
                    continue
                far = np.abs(m["n"] * (x - m["mean"])).max(initial=0.0)
                if far * far * dim > 2.0 ** 62 or m["n"] * float(np.abs(x).max(initial=0)) > 2.0 ** 62:
                    raise ArithmeticError("a deviation does not fit a long")
                apart = m["n"] * x - m["sums"]
                white = (x - m["mean"]) @ m["scaled"]
                rows_ = len(x)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(at).take(pa.array(np.repeat(np.arange(rows_), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)),
                    pa.array(np.full(rows_ * k, m["n"], np.int64)),
                    pa.array(np.repeat((apart * apart).sum(1), k)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(m["values"] / m["trace"], rows_)),
                    pa.array(np.full(rows_ * k, m["identity_error"])),
                    pa.array(np.full(rows_ * k, dim, np.int32))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "dim"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, dim int")


def op12_secular_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(quantised(table(spark, sf_dir, "embeddings")))
