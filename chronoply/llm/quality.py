"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over quantile bins. Cyclic boosting visits one
feature after the other and adds a shallow tree (at most four leaves) on that feature alone;
then the pairs with the most left to explain get two-way tables the same way. A score is the
logistic of the sum of table entries: one vectorised addition for each table.

Only the fit is bounded: it uses at most ``rows`` labelled texts, those of least id hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

FEATURES = ("words", "word_length", "upper", "digit", "punctuation", "symbol", "exclaim", "space", "high", "unique", "top", "repeated_lines", "line_length", "bare", "stops")
_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)


def features(texts: list[str | None]) -> np.ndarray:
    """One row of FEATURES for each whole text; null is the empty text."""
    out = np.zeros((len(texts), len(FEATURES)))
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        n = max(len(raw), 1)
        seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x and not x.isspace()]
        letters = seen[65:91].sum() + seen[97:123].sum()
        marks = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
        symbols = seen[[35, 42, 36, 37, 38, 124, 60, 62]].sum()
        m = max(len(words), 1)
        kinds: dict[bytes, int] = {}
        for w in words:
            kinds[w] = kinds.get(w, 0) + 1
        out[k] = (
            np.log1p(len(words)), (n - seen[32] - seen[10]) / m, seen[65:91].sum() / max(letters, 1), seen[48:58].sum() / n, marks / n, symbols / m, seen[33] / m,
            (seen[9:14].sum() + seen[32]) / n, seen[128:].sum() / n, len(kinds) / m, max(kinds.values(), default=0) / m,
            1 - len(set(lines)) / max(len(lines), 1), np.log1p(len(words) / max(len(lines), 1)), (seen[124] + seen[91:96].sum()) / m, (seen[46] + seen[44]) / m,
        )
    return out


def _cuts(grad: np.ndarray, hess: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values by bin of a depth-two tree on one binned feature."""

    def best(lo: int, hi: int) -> tuple[float, int]:
        g, h = np.cumsum(grad[lo:hi]), np.cumsum(hess[lo:hi])
        if hi - lo < 2:
            return 0.0, 0
        left = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge) - g[-1] ** 2 / (h[-1] + ridge)
        at = int(np.argmax(left))
        return float(left[at]), lo + at + 1

    edges = [0, len(grad)]
    gain, first = best(0, len(grad))
    if gain > 0:
        edges = [0, first, len(grad)]
        edges = sorted({*edges, *(c for a, b in ((0, first), (first, len(grad))) for g, c in [best(a, b)] if g > 0)})
    out = np.zeros(len(grad))
    for a, b in zip(edges, edges[1:], strict=False):
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + ridge)
    return out


@dataclass
class AdditiveModel:
    """Bin edges and tables; ``pairs`` maps feature pairs to two-way tables over coarse bins."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edge, x[:, f], side="right")]
        for (a, b), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))

    def score_column(self, text: Column) -> Column:
        model = self

        @pandas_udf("double")
        def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(model.score(features(texts.tolist())) if len(texts) else [], dtype="float64")

        return quality(text.cast("string"))


def fit_tables(x: np.ndarray, y: np.ndarray, *, bins: int = 64, coarse: int = 12, rounds: int = 60, pair_rounds: int = 30, pairs: int = 6, rate: float = 0.15, ridge: float = 4.0) -> AdditiveModel:
    """Cyclic boosting on a sample; without both labels the score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    if not len(y):
        return model

    def edges(n: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) for f in range(x.shape[1])]

    model.edges, model.coarse = edges(bins), edges(coarse)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    rough = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    total = np.full(len(y), model.base)

    def slopes(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes(total)
            step = rate * _cuts(np.bincount(at[f], g, len(table)), np.bincount(at[f], h, len(table)), ridge)
            table += step
            total += step[at[f]]

    def grids(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        cell = rough[a] * shape[1] + rough[b]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    def quadrants(gg: np.ndarray, hh: np.ndarray) -> tuple[float, np.ndarray]:
        """The best tree of a cut in one feature and a cut in the other."""
        cg, ch = gg.cumsum(0).cumsum(1), hh.cumsum(0).cumsum(1)
        none = (0.0, np.zeros_like(gg))
        if min(gg.shape) < 2:
            return none
        q = [(cg[:-1, :-1], ch[:-1, :-1])]
        q.append((cg[:-1, -1:] - q[0][0], ch[:-1, -1:] - q[0][1]))
        q.append((cg[-1:, :-1] - q[0][0], ch[-1:, :-1] - q[0][1]))
        q.append((cg[-1, -1] - q[0][0] - q[1][0] - q[2][0], ch[-1, -1] - q[0][1] - q[1][1] - q[2][1]))
        gain = sum(a**2 / (b + ridge) for a, b in q)
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        out = np.zeros_like(gg)
        for (a, b), rows, cols in zip(q, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None)), strict=True):
            out[rows, cols] = a[i, j] / (b[i, j] + ridge)
        return float(gain[i, j]), out

    g, h = slopes(total)
    gains = sorted(((quadrants(*grids(a, b, g, h))[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = {(a, b): np.zeros((len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)) for gain, a, b in gains[:pairs] if gain > 0}
    for _ in range(pair_rounds):
        for (a, b), table in model.pairs.items():
            step = rate * quadrants(*grids(a, b, *slopes(total)))[1]
            table += step
            total += step[rough[a], rough[b]]
    return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 20_000) -> AdditiveModel:
    """Fit on at most ``rows`` labelled documents, those of least id hash. Rows without an id
    or a label are left out; a document that is labelled twice counts twice."""
    named = labels.select(F.col(id_col).alias("id"), (F.col(label_col) == 1).cast("int").alias("y")).where("id is not null and y is not null")
    sample = F.broadcast(named.orderBy(F.xxhash64("id"), "id", "y").limit(rows))  # at most ``rows`` small rows

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"y": b["y"], "x": list(features(b["text"].tolist()))})

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(sample, "id").select("text", "y")
    got = texts.limit(rows).mapInPandas(measure, "y int, x array<double>").toPandas()  # ids that repeat in docs don't break the bound
    x = np.array(got["x"].tolist(), dtype=float).reshape(len(got), len(FEATURES))
    order = np.lexsort((*x.T, got["y"].to_numpy(float)))  # the same fit whatever order rows arrive in
    return fit_tables(x[order], got["y"].to_numpy(float)[order])


def classify(docs: DataFrame, model: AdditiveModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score, predicted for every row; null and empty texts are scored as empty. Repeated
    rows get the same score; only the id and the text of ``docs`` are read."""
    scored = docs.select(F.col(id_col), model.score_column(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
