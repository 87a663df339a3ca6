"""Fits by sums over all rows: exponential tilts, diagonal mixtures, rates by bisection, own-gene-free propensities.

What the driver holds is a few numbers for each state; rows are read once a step and leave tasks as sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled


def _by_state(rows: DataFrame, columns: list[str], sums) -> dict:
    """For each state the sums of its rows. ``sums`` takes a state and its rows of a batch and gives an array.

    Arrays leave a task once for each state and are added up place by place."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for state, part in batch.groupby("by", sort=False):
                v = sums(state, part)
                held[state] = held[state] + v if state in held else v
        if held:  # a frame without rows has no type of its own
            yield pd.DataFrame({"by": list(held), "v": [v.tolist() for v in held.values()]})

    parts = rows.select("by", *columns).mapInPandas(partial, f"by {dict(rows.dtypes)['by']}, v array<double>")
    return _whole(parts.select("by", F.posexplode("v").alias("i", "x")).groupBy("by", "i").agg(F.sum("x").alias("x")))


def _whole(places: DataFrame) -> dict:
    """by, i, x as an array for each state: some hundreds or thousands of numbers each."""
    out: dict = {}
    for r in places.toLocalIterator():
        out.setdefault(r["by"], []).append((r["i"], r["x"]))
    return {state: np.array([x for _, x in sorted(v)]) for state, v in out.items()}


def _by_state_scaled(rows: DataFrame, columns: list[str], sums) -> dict:
    """The same for sums of exponentials: ``sums`` gives the log of a scale and the sums divided by it. Tasks' sums meet at the
    largest scale of their state. Gives log scale and sums."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for state, part in batch.groupby("by", sort=False):
                top, v = sums(state, part)
                if state in held:
                    both = max(top, held[state][0])
                    held[state] = both, held[state][1] * np.exp(held[state][0] - both) + v * np.exp(top - both)
                else:
                    held[state] = top, v
        if held:
            yield pd.DataFrame({"by": list(held), "top": [t for t, _ in held.values()], "v": [v.tolist() for _, v in held.values()]})

    parts = settled(rows.select("by", *columns).mapInPandas(partial, f"by {dict(rows.dtypes)['by']}, top double, v array<double>"))
    tops = {r["by"]: r["most"] for r in parts.groupBy("by").agg(F.max("top").alias("most")).toLocalIterator()}
    most = parts.groupBy("by").agg(F.max("top").alias("most"))
    scaled = parts.join(most, "by").select("by", F.transform("v", lambda x: x * F.exp(F.col("top") - F.col("most"))).alias("v"))
    return {s: (tops[s], v) for s, v in _whole(scaled.select("by", F.posexplode("v").alias("i", "x")).groupBy("by", "i").agg(F.sum("x").alias("x"))).items()}


def moment_tilt(rows: DataFrame, targets: dict, ridge: float, bound: float, tolerance: float = 1e-7, rounds: int = 100) -> dict:
    """For each state the theta within +-bound that minimises log mean exp(theta.f) - theta.target + ridge / 2 |theta|^2.

    rows: by, f (an array of numbers); targets: an array for each state. Where no bound is met, the mean of f under the
    weights exp(theta.f) is the target less ridge * theta. Newton steps over the coordinates that no bound holds, halved until
    the objective falls; a step is one pass that gives the first and second moments of all states. Returns theta, the tilted
    mean and the length of the projected gradient of each state; raises if that stays above ``tolerance``.
    """
    size = len(next(iter(targets.values()))) if targets else 0
    rows = rows.where(F.col("by").isin(list(targets)))

    def moments(theta: dict) -> dict:
        def sums(state, part: pd.DataFrame):
            f = np.stack(part["f"].to_list())
            logits = f @ theta[state]
            top = float(logits.max())
            w = np.exp(logits - top)
            return top, np.concatenate([[w.sum()], w @ f, ((f * w[:, None]).T @ f).ravel()])

        out = {}
        for state, (top, v) in _by_state_scaled(rows, ["f"], sums).items():
            mean = v[1 : 1 + size] / v[0]
            out[state] = top + np.log(v[0]), mean, v[1 + size :].reshape(size, size) / v[0] - np.outer(mean, mean)
        return out

    theta = {s: np.zeros(size) for s in targets}
    step = {s: np.zeros(size) for s in targets}
    value = dict.fromkeys(targets, np.inf)
    best, found = {}, {}
    for _ in range(rounds):
        trial = {s: np.clip(theta[s] + step[s], -bound, bound) for s in targets}
        at = moments(trial)
        for s in at.keys() - found.keys():
            log, mean, cov = at[s]
            now = log - trial[s] @ targets[s] + ridge / 2 * trial[s] @ trial[s]
            if now > value[s] + 1e-12 * max(1.0, abs(value[s])):
                step[s] = step[s] / 2
                if np.abs(step[s]).max() < 1e-14:
                    found[s] = best[s]
                continue
            theta[s], value[s] = trial[s], now
            gradient = mean - targets[s] + ridge * theta[s]
            held = (theta[s] <= -bound) & (gradient > 0) | (theta[s] >= bound) & (gradient < 0)
            free = ~held
            best[s] = theta[s], mean, float(np.sqrt((gradient[free] ** 2).sum()))
            if best[s][2] < tolerance:
                found[s] = best[s]
            step[s] = np.zeros(size)
            hessian = cov[np.ix_(free, free)] + (ridge + 1e-12) * np.eye(free.sum())
            step[s][free] = -np.linalg.solve(hessian, gradient[free])
        if found.keys() >= at.keys():
            break
    worst = max((best[s][2] for s in best), default=0.0)
    if worst >= tolerance:
        raise ValueError(f"gradient {worst} after {rounds} steps")
    return {s: best[s] for s in best}


class Mixture:
    """Gaussians with diagonal covariances: weights (k), means and variances (k x d)."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, var: np.ndarray):
        self.weight, self.mean, self.var = weight, mean, var

    def logs(self, z: np.ndarray) -> np.ndarray:
        """log (weight * density) of each row and component."""
        out = np.log(self.weight) - 0.5 * (z.shape[1] * np.log(2 * np.pi) + np.log(self.var).sum(1))
        return out - 0.5 * (((z[:, None] - self.mean) ** 2) / self.var).sum(2)

    def shares(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each component is answerable for each row, and the log density of the row."""
        logs = self.logs(z)
        top = logs.max(1, keepdims=True)
        w = np.exp(logs - top)
        total = w.sum(1, keepdims=True)
        return w / total, (top + np.log(total))[:, 0]


def _spread_out(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows: the first, then always the one furthest from those taken."""
    taken = [0]
    gap = ((sample - sample[0]) ** 2).sum(1)
    while len(taken) < k:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[taken[-1]]) ** 2).sum(1))
    return sample[taken]


def diagonal_mixtures(rows: DataFrame, most: int, least_cells: int, floor: float = 0.05, tolerance: float = 1e-3, rounds: int = 500, seeds: int = 256) -> dict:
    """A mixture of diagonal Gaussians for each state, by expectation and maximisation over all rows.

    rows: by, cell, z (an array). A state of n cells has max(2, min(most, n // least_cells)) components (one, if it has one
    cell). Means start at rows far apart among the ``seeds`` first by hash, variances at the state's own; ``floor`` is added
    to variances. A step is one pass for all states. Gives for each state the mixture, the mean log density after each
    step (which never falls but for the floor), and whether its gain fell below ``tolerance``.
    """
    from pyspark.sql.window import Window

    rows = settled(rows.select("by", "cell", "z"))
    sizes = {r["by"]: (r["n"], r["d"]) for r in rows.groupBy("by").agg(F.count("*").alias("n"), F.max(F.size("z")).alias("d")).toLocalIterator()}
    at = F.row_number().over(Window.partitionBy("by").orderBy(F.xxhash64("cell"), "cell"))
    first: dict = {}
    for r in rows.withColumn("_k", at).where(F.col("_k") <= seeds).orderBy("by", "_k").toLocalIterator():
        first.setdefault(r["by"], []).append(r["z"])
    whole = Mixture(np.ones(1), np.zeros((1, 1)), np.ones((1, 1)))
    models = {s: whole for s in sizes}

    def passed(models: dict) -> dict:
        def sums(state, part: pd.DataFrame):
            z = np.stack(part["z"].to_list())
            share, log = models[state].shares(z)
            return np.concatenate([share.sum(0), (share.T @ z).ravel(), (share.T @ (z * z)).ravel(), [log.sum()]])

        return _by_state(rows.where(F.col("by").isin(list(models))), ["z"], sums) if models else {}

    def moved(v: np.ndarray, k: int, d: int, n: int) -> tuple[Mixture, float]:
        mass = v[:k] + 10 * np.finfo(float).eps
        mean, square = v[k : k + k * d].reshape(k, d) / mass[:, None], v[k + k * d : k + 2 * k * d].reshape(k, d) / mass[:, None]
        return Mixture(mass / mass.sum(), mean, np.maximum(square - mean**2, 0) + floor), v[-1] / n

    for s, v in passed({s: Mixture(np.ones(1), np.zeros((1, d)), np.ones((1, d))) for s, (_, d) in sizes.items()}).items():
        n, d = sizes[s]
        own, _ = moved(v, 1, d, n)
        k = min(max(2, min(most, n // least_cells)), n)
        centres = _spread_out(np.array(first[s]), min(k, len(first[s])))
        models[s] = Mixture(np.full(len(centres), 1 / len(centres)), centres, np.repeat(own.var, len(centres), 0))
    logs: dict = {s: [] for s in models}
    done: set = set()
    for _ in range(rounds):
        waiting = {s: m for s, m in models.items() if s not in done}
        if not waiting:
            break
        for s, v in passed(waiting).items():
            n, d = sizes[s]
            new, log = moved(v, len(models[s].weight), d, n)
            logs[s].append(log)
            if len(logs[s]) > 1 and abs(log - logs[s][-2]) < tolerance:
                done.add(s)
            else:
                models[s] = new
    return {s: (models[s], logs[s], s in done) for s in models}


def mixture_shares(rows: DataFrame, models: dict) -> DataFrame:
    """by, cell and each component's share of the cell; models as ``diagonal_mixtures`` gives them."""
    kinds = dict(rows.dtypes)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.Series([[]] * len(batch), index=batch.index, dtype=object)
            for state, part in batch.groupby("by", sort=False):
                out[part.index] = pd.Series(models[state][0].shares(np.stack(part["z"].to_list()))[0].tolist(), index=part.index)
            yield pd.DataFrame({"by": batch["by"], "cell": batch["cell"], "share": out})

    return rows.where(F.col("by").isin(list(models))).select("by", "cell", "z").mapInPandas(shares, f"by {kinds['by']}, cell {kinds['cell']}, share array<double>")


def calibrated_rates(df: DataFrame, by: list[str], v: str, target: str, limit: float, steps: int = 36, wide: int = 4) -> DataFrame:
    """Per group the r with mean(log1p(expm1(v) e^r)) at the target, by bisection within +-limit; 0 if all v are 0.

    All groups are halved at once. A pass takes ``wide`` halvings together: it sums at all ends that they may meet, for each
    group, and the group keeps the stretch where the mean crosses its target. No group is held as an array.
    """
    rows = df.select(*by, F.expm1(v).alias("_c"), F.col(target).alias("_t")).where("_c is not null")
    at = rows.groupBy(*by).agg(F.max("_t").alias("_t"), F.max("_c").alias("_most")).withColumns({"_lo": F.lit(-float(limit)), "_hi": F.lit(float(limit))})
    at = settled(at)
    entries = settled(rows.where("_c > 0").select(*by, "_c"))
    sizes = settled(rows.groupBy(*by).agg(F.count("*").alias("_n")))
    while steps:
        cuts = 2 ** min(wide, steps)
        steps -= min(wide, steps)
        place = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (i / cuts)
        sums = entries.join(at.select(*by, "_lo", "_hi"), by).groupBy(*by).agg(*(F.sum(F.log1p(F.col("_c") * F.exp(place(i)))).alias(f"_s{i}") for i in range(1, cuts)))
        met = at.join(sums, by, "left").join(sizes, by)
        below = sum((F.coalesce((F.col(f"_s{i}") / F.col("_n") < F.col("_t")).cast("int"), F.lit(0)) for i in range(1, cuts)), F.lit(0))
        width = (F.col("_hi") - F.col("_lo")) / cuts
        at = settled(met.select(*by, "_t", "_most", (F.col("_lo") + below * width).alias("_lo"), (F.col("_lo") + (below + 1) * width).alias("_hi")))
    return at.select(*by, F.when(F.col("_most") > 0, (F.col("_lo") + F.col("_hi")) / 2).otherwise(0.0).alias("rate"))


def principal_axes(rows: DataFrame, x: str, size: int, k: int) -> np.ndarray:
    """The leading axes (size x k) of arrays of ``size`` numbers, from sums over all rows."""
    from .models import estimated_covariance

    c, _ = estimated_covariance(rows, x, size)
    return np.linalg.eigh(c)[1][:, ::-1][:, :k]


def principal_frames(rows: DataFrame, k: int) -> dict:
    """For each state the mean and the leading axes of its arrays: rows by, x. From sums over all rows."""

    def sums(_, part: pd.DataFrame):
        x = np.stack(part["x"].to_list()).astype(float)
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    out = {}
    for state, v in _by_state(rows, ["x"], sums).items():
        d = int(round((np.sqrt(4 * len(v) - 3) - 1) / 2))
        mean = v[1 : 1 + d] / v[0]
        out[state] = mean, np.linalg.eigh(v[1 + d :].reshape(d, d) / v[0] - np.outer(mean, mean))[1][:, ::-1][:, :k]
    return out


def detection_propensity(cells: DataFrame, axes: np.ndarray, least: int = 20, share: float = 0.1) -> DataFrame:
    """cell, propensity (an array by gene): how a cell's components, a gene's own part taken out of them, foretell the gene.

    cells: cell, state, x (an array of as many genes as ``axes`` has rows). Within a state z are the centred components, x the
    centred values, y centred detection. Gene j leaves the components as z - x_j axes_j, so its ridge needs the state's sums z'z,
    z'y, z'x, x'x and x'y alone: the Gram matrix is downdated by rank one on either side, for each gene. The penalty is
    ``share`` of the mean diagonal, or of 1 if that is less. States of fewer than ``least`` cells get zeros.
    """
    genes, k = axes.shape
    kind = dict(cells.dtypes)
    at = [F.avg(F.get("x", F.lit(g))).alias(f"x{g}") for g in range(genes)] + [F.avg((F.get("x", F.lit(g)) > 0).cast("double")).alias(f"y{g}") for g in range(genes)]
    centres = {r["state"]: (np.array([r[f"x{g}"] for g in range(genes)], float), np.array([r[f"y{g}"] for g in range(genes)], float), r["n"]) for r in cells.groupBy("state").agg(*at, F.count("*").alias("n")).toLocalIterator()}
    centres = {s: c for s, c in centres.items() if c[2] >= least}
    ends = np.cumsum([k * k, k * genes, k * genes, genes, genes])[:-1]

    def sums(state, part: pd.DataFrame):
        x = np.stack(part["x"].to_list()).astype(float)
        d, y = x - centres[state][0], (x > 0) - centres[state][1]
        z = d @ axes
        return np.concatenate([(z.T @ z).ravel(), (z.T @ y).ravel(), (z.T @ d).ravel(), (d * d).sum(0), (d * y).sum(0)])

    large = cells.where(F.col("state").isin(list(centres))).withColumn("by", F.col("state"))
    slopes = {}
    for state, v in (_by_state(large, ["x"], sums) if centres else {}).items():
        zz, zy, zx, xx, xy = np.split(v, ends)
        zz, zy, zx = zz.reshape(k, k), zy.reshape(k, genes), zx.reshape(k, genes)
        gram = zz - zx.T[:, :, None] * axes[:, None, :] - axes[:, :, None] * zx.T[:, None, :] + xx[:, None, None] * axes[:, :, None] * axes[:, None, :]
        penalty = share * np.maximum(np.trace(gram, axis1=1, axis2=2) / k, 1.0)
        right = zy.T - axes * xy[:, None]
        slopes[state] = np.linalg.solve(gram + penalty[:, None, None] * np.eye(k), right[..., None])[..., 0]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.Series([[0.0] * genes] * len(batch), index=batch.index, dtype=object)
            for state, part in batch.groupby("state", sort=False):
                if state in slopes:
                    d = np.stack(part["x"].to_list()).astype(float) - centres[state][0]
                    p = d @ axes @ slopes[state].T - d * (axes * slopes[state]).sum(1)
                    out[part.index] = pd.Series(p.tolist(), index=part.index)
            yield pd.DataFrame({"cell": batch["cell"], "propensity": out})

    return cells.select("cell", "state", "x").mapInPandas(apply, f"cell {kind['cell']}, propensity array<double>")


class KernelFeatures:
    """Features whose products are Gaussian kernels, exactly for the landmarks and by projection on them for other rows."""

    def __init__(self, landmarks: np.ndarray, centre: np.ndarray, spread: np.ndarray):
        self.centre, self.spread = centre, spread
        self.landmarks = (landmarks - centre) / spread
        gap = self._gaps(self.landmarks)
        apart = gap[np.triu_indices(len(gap), 1)]
        self.width = float(np.median(apart)) if len(apart) and np.median(apart) > 0 else 1.0
        size, turn = np.linalg.eigh(np.exp(-gap / (2 * self.width)))
        kept = size > 1e-10 * size.max()
        self.turn = turn[:, kept] / np.sqrt(size[kept])

    def _gaps(self, x: np.ndarray) -> np.ndarray:
        """Mean squared differences to the landmarks."""
        square = (x * x).sum(1)[:, None] + (self.landmarks * self.landmarks).sum(1) - 2 * x @ self.landmarks.T
        return np.maximum(square, 0) / x.shape[1]

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-self._gaps((x - self.centre) / self.spread) / (2 * self.width)) @ self.turn


def kernel_predictor(train: DataFrame, new: DataFrame, alpha: float, rank: int | None = None, landmarks: int = 256) -> DataFrame:
    """id, prediction (an array): ridge on kernel features of the training rows, for their leading response factors.

    train: id, x, y; new: id, x. Features come from the ``landmarks`` first training rows by hash, the kernel's width from the
    median distance among those. All training rows enter sums of features by features, features by responses and responses by
    responses; the factors are the leading axes of the last. With as many landmarks as training rows and no ``rank`` this is
    kernel ridge on all rows.
    """
    x_size, y_size = train.select(F.max(F.size("x")), F.max(F.size("y"))).first()
    moments = train.agg(*(f(F.get("x", F.lit(i))) for i in range(x_size) for f in (F.avg, F.stddev_pop)), *(F.avg(F.get("y", F.lit(i))) for i in range(y_size))).first()
    centre, spread, level = np.array(moments[: 2 * x_size : 2], float), np.array(moments[1 : 2 * x_size : 2], float), np.array(moments[2 * x_size :], float)
    some = train.orderBy(F.xxhash64("id"), "id").limit(landmarks).select("x").collect()
    features = KernelFeatures(np.array([r["x"] for r in some]), centre, np.maximum(spread, 1e-9))
    m = features.turn.shape[1]

    def sums(_, part: pd.DataFrame):
        f, y = features.of(np.stack(part["x"].to_list())), np.stack(part["y"].to_list()) - level
        return np.concatenate([(f.T @ f).ravel(), (f.T @ y).ravel(), (y.T @ y).ravel()])

    gram, right, responses = np.split(_by_state(train.withColumn("by", F.lit(0)), ["x", "y"], sums)[0], [m * m, m * m + m * y_size])
    factors = np.linalg.eigh(responses.reshape(y_size, y_size))[1][:, ::-1][:, : rank or y_size]
    weights = np.linalg.solve(gram.reshape(m, m) + alpha * np.eye(m), right.reshape(m, y_size)) @ factors @ factors.T

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"id": batch["id"], "prediction": (level + features.of(np.stack(batch["x"].to_list())) @ weights).tolist()})

    return new.select("id", "x").mapInPandas(predict, f"id {dict(new.dtypes)['id']}, prediction array<double>")


def term_embedding(entries: DataFrame, rank: int, tolerance: float = 1e-9, rounds: int = 200, spare: int = 8, seed: int = 7) -> DataFrame:
    """row, embedding: rows of a sparse table (row, term, v) on its leading ``rank`` left singular vectors, times the singular
    values, at length 1; zeros for a row without weight there.

    Subspace iteration: a block of vectors goes through the table to the terms and back, by two joins with sums, and is made
    orthonormal by its Gram matrix, a small square of numbers that alone reaches the driver. ``spare`` vectors more than are asked for
    go along, so that it ends sooner: when the leading singular values stand still; raises if they do not. A vector's
    largest component is positive.
    """
    block = rank + spare
    entries = settled(entries.select("row", "term", F.col("v").cast("double").alias("v")))
    start = [F.hash("row", F.lit(seed + k)) / float(1 << 31) for k in range(block)]
    q = entries.select("row").distinct().select("row", *(c.alias(f"q{k}") for k, c in enumerate(start)))
    names, values = [f"q{k}" for k in range(block)], None

    def gram(df: DataFrame) -> np.ndarray:
        pairs = [(i, j) for i in range(block) for j in range(i, block)]
        row = df.agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs)).first()
        return np.array([[row[f"g{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(block)] for i in range(block)])

    def turned(df: DataFrame, m: np.ndarray) -> DataFrame:
        return df.select("row", *(sum((F.col(f"q{i}") * float(m[i, k]) for i in range(len(m))), F.lit(0.0)).alias(f"q{k}") for k in range(m.shape[1])))

    for _ in range(rounds):
        size, axes = np.linalg.eigh(gram(q))
        q = turned(q, axes / np.sqrt(np.maximum(size, 1e-300)) * (size > 1e-14 * size.max()))
        terms = entries.join(q, "row").groupBy("term").agg(*(F.sum(F.col("v") * F.col(n)).alias(n) for n in names))
        z = settled(entries.join(terms, "term").groupBy("row").agg(*(F.sum(F.col("v") * F.col(n)).alias(n) for n in names)))
        g = gram(z)
        now = np.sqrt(np.maximum(np.linalg.eigvalsh(g)[::-1], 0))[:rank]  # squares of singular values, near the end
        if values is not None and np.abs(now - values).max() <= tolerance * max(now[0], 1e-300):
            break
        q, values = z, now
    else:
        raise ValueError("singular values still move")
    # At the end z = A A' q with q orthonormal in the space of the leading vectors: its own axes are the singular vectors.
    size, axes = np.linalg.eigh(g)
    size, axes, whole = size[::-1][:rank], axes[:, ::-1][:, :rank], size.max()
    u = settled(turned(z, axes / np.sqrt(np.maximum(size, 1e-300)) * (size > 1e-14 * whole)))
    names = names[:rank]
    top = u.agg(*(F.max_by(n, F.struct(F.round(F.abs(n), 9), "row")).alias(n) for n in names)).first()
    scaled = turned(u, np.diag([np.sign(top[n] or 1.0) * np.sqrt(np.sqrt(max(s, 0.0))) for n, s in zip(names, size, strict=True)]))
    length = F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0)))
    return scaled.select("row", F.array(*(F.when(length > 1e-12, F.col(n) / length).otherwise(0.0) for n in names)).alias("embedding"))
