"""Learned operators on numpy: isolation forest, recurrent autoencoder, boosted-tree-free meta classifier, exact Shapley values.

Models are fitted on a bounded sample (the rows with the least hash, `sample` of them) and scored by Arrow batches.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, cols: list[str], keys: list[str], sample: int) -> pd.DataFrame:
    """At most `sample` rows, chosen by hash of their keys, so the choice doesn't depend on partitioning."""
    return df.select(*cols, F.xxhash64(*keys).alias("_h")).orderBy("_h").limit(sample).toPandas().drop(columns="_h")


def _c(n: float) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0 if n == 2 else 0.0


class IsolationForest:
    """Random isolation trees as flat arrays: split feature (-1: leaf), threshold, children, depth plus c(size)."""

    def __init__(self, x: np.ndarray, trees: int = 150, share: float = 0.8, seed: int = 42):
        rng = np.random.default_rng(seed)
        n = max(2, int(len(x) * share))
        self.norm = max(_c(n), 1e-9)
        self.trees = [self._grow(x[rng.choice(len(x), n, replace=False)] if len(x) >= n else x, rng, int(np.ceil(np.log2(n)))) for _ in range(trees)]

    @staticmethod
    def _grow(x, rng, most):
        feature, cut, left, right, path = [], [], [], [], []

        def node(rows, depth):
            at = len(feature)
            for a in (feature, cut, left, right, path):
                a.append(0)
            low, high = rows.min(0), rows.max(0)
            usable = np.flatnonzero(high > low)
            if depth >= most or len(rows) < 2 or not len(usable):
                feature[at], path[at] = -1, depth + _c(len(rows))
                return at
            f = int(rng.choice(usable))
            c = rng.uniform(low[f], high[f])
            c = c if low[f] < c <= high[f] else high[f]  # between neighbouring floats rounding would leave one side empty
            go = rows[:, f] < c
            feature[at], cut[at] = f, c
            left[at], right[at] = node(rows[go], depth + 1), node(rows[~go], depth + 1)
            return at

        node(x, 0)
        return tuple(np.array(a) for a in (feature, cut, left, right, path))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2^(-mean path / c): towards 1 is easy to isolate."""
        total = np.zeros(len(x))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(x), int)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                k = at[inner]
                at[inner] = np.where(x[inner, feature[k]] < cut[k], left[k], right[k])
            total += path[at]
        return 2 ** (-total / len(self.trees) / self.norm)


class GRU:
    """One gated recurrent layer; gates in order reset, update, new."""

    def __init__(self, n_in: int, n_hidden: int, rng):
        k = 1 / np.sqrt(n_hidden)
        u = lambda *s: rng.uniform(-k, k, s)
        self.w, self.u, self.b, self.c, self.h = u(3 * n_hidden, n_in), u(3 * n_hidden, n_hidden), u(3 * n_hidden), u(3 * n_hidden), n_hidden

    def run(self, x: np.ndarray) -> np.ndarray:
        """(batch, steps, in) -> (batch, steps, hidden)."""
        s = lambda z: 1 / (1 + np.exp(-z))
        h, out, n = np.zeros((len(x), self.h)), [], self.h
        for t in range(x.shape[1]):
            a, b = x[:, t] @ self.w.T + self.b, h @ self.u.T + self.c
            r, z = s(a[:, :n] + b[:, :n]), s(a[:, n : 2 * n] + b[:, n : 2 * n])
            h = (1 - z) * np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :]) + z * h
            out.append(h)
        return np.stack(out, 1)


class RecurrentAutoencoder:
    """A fixed random recurrent encoder with a read-out fitted by ridge regression (an echo-state reconstruction).

    The read-out predicts each step's readings from the state before it, so the error of a step tells how unusual it is.
    """

    def __init__(self, n_in: int, hidden: int = 32, seed: int = 7, ridge: float = 1e-2):
        self.layer, self.ridge, self.read = GRU(n_in, hidden, np.random.default_rng(seed)), ridge, None

    def _states(self, x):
        h = self.layer.run(x)
        before = np.concatenate([np.zeros_like(h[:, :1]), h[:, :-1]], 1)
        return np.concatenate([before, np.ones_like(before[..., :1])], -1)

    def fit(self, x: np.ndarray) -> RecurrentAutoencoder:
        s, y = self._states(x).reshape(-1, self.layer.h + 1), x.reshape(-1, x.shape[-1])
        self.read = np.linalg.solve(s.T @ s + self.ridge * np.eye(s.shape[1]), s.T @ y)
        return self

    def errors(self, x: np.ndarray) -> np.ndarray:
        """(batch, steps): mean squared error of each step."""
        return ((self._states(x) @ self.read - x) ** 2).mean(-1)


def scatter_mean(errors: np.ndarray, n: int) -> np.ndarray:
    """Mean over all windows (stride 1) that cover a row."""
    total, count = np.zeros(n), np.zeros(n)
    for i, e in enumerate(errors):
        total[i : i + len(e)] += e
        count[i : i + len(e)] += 1
    return total / np.maximum(count, 1)


def window_scores(df: DataFrame, model: RecurrentAutoencoder, cols: list[str], size: int, out: str) -> DataFrame:
    """Adds each row's mean error over its segment's windows; short segments are padded with their first row.

    Grouped by (station, segment); windows exist only inside the task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp")
        x = pdf[cols].to_numpy(float)
        pad = max(0, size - len(x))
        full = np.concatenate([np.repeat(x[:1], pad, 0), x])
        parts = [model.errors(np.stack([full[i : i + size] for i in range(a, min(a + 512, len(full) - size + 1))])) for a in range(0, len(full) - size + 1, 512)]
        return pdf.assign(**{out: scatter_mean(np.concatenate(parts), len(full))[pad:]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy("station_id", "segment_id").applyInPandas(run, f"{fields}, {out} double")


def add_scores(df: DataFrame, cols: list[str], score, out: str) -> DataFrame:
    """Adds score(matrix of cols); rows with a null among cols get null and don't reach the model."""

    @F.pandas_udf("double")
    def run(part: pd.DataFrame) -> pd.Series:
        x = part.to_numpy(float)
        ok = ~np.isnan(x).any(1)
        y = np.full(len(x), np.nan)
        if ok.any():
            y[ok] = score(x[ok])
        return pd.Series(y)

    return df.withColumn(out, F.nanvl(run(F.struct(*[F.col(c).cast("double") for c in cols])), F.lit(None)))


class MetaClassifier:
    """Weighted softmax regression on features and their pairwise products, by gradient descent; classes in sorted order."""

    def __init__(self, x: np.ndarray, labels, weights: dict[str, float], rounds: int = 300, step: float = 0.5, decay: float = 1e-3):
        self.classes = sorted(set(labels))
        self.mean, self.std = x.mean(0), np.where(x.std(0) == 0, 1, x.std(0))
        f = self._expand(x)
        y = np.array([[c == v for c in self.classes] for v in labels], float)
        w = np.array([weights.get(v, 1.0) for v in labels])
        w /= w.sum()
        self.coef = np.zeros((f.shape[1], len(self.classes)))
        for _ in range(rounds):
            self.coef -= step * (f.T @ (w[:, None] * (self._soft(f @ self.coef) - y)) + decay * self.coef)

    def _expand(self, x):
        z = np.clip((x - self.mean) / self.std, -8, 8)
        pairs = [z[:, [i]] * z[:, [j]] / 8 for i in range(z.shape[1]) for j in range(i, z.shape[1])]
        return np.concatenate([np.ones((len(z), 1)), z, *pairs], 1)

    @staticmethod
    def _soft(m):
        e = np.exp(m - m.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self._expand(np.asarray(x, float)) @ self.coef

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._soft(self.margin(x))


def shapley(margin, x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Exact Shapley values of margin(x) against a base row: all coalitions of the few features. Sum = margin(x) - margin(base)."""
    n = x.shape[1]
    value = {}
    for size in range(n + 1):
        for s in combinations(range(n), size):
            z = np.tile(base, (len(x), 1))
            z[:, list(s)] = x[:, list(s)]
            value[s] = margin(z)
    out = np.zeros((len(x), n))
    for i in range(n):
        for s in value:
            if i not in s:
                w = factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n)
                out[:, i] += w * (value[tuple(sorted((*s, i)))] - value[s])
    return out


def rationale(df: DataFrame) -> DataFrame:
    """Adds rationale_text from top_feature, top_value and predicted."""
    text = F.format_string("%s: %s contributes %+.2f", F.replace(F.col("predicted"), F.lit("_"), F.lit(" ")), F.col("top_feature"), F.col("top_value"))
    return df.withColumn("rationale_text", F.when(F.col("predicted") == "normal", "no fault indicated").otherwise(text))
