"""Language identification by error-correcting output codes.

Each language has a binary codeword. For each bit a linear classifier over hashed byte
trigrams tells the languages with a 1 from those with a 0. Decoding weights each bit's
logistic loss by how well that bit was told in training and takes the codeword of least
loss; a small lead over the next is flagged as ambiguous.

Only the fit is bounded: it uses at most ``rows`` texts, those of least hash of id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

WIDTH = 4096
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def grams(texts: list[str | None]) -> np.ndarray:
    """Square roots of trigram shares, of length one; a zero row for a text without trigrams."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for k, text in enumerate(texts):
        raw = np.frombuffer(b" " + (text or "").lower().encode().translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
        if len(raw) > 2:
            mixed = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA6B) + raw[2:] * np.uint32(0xC2B2AE35)
            seen = np.bincount(mixed >> np.uint32(20), minlength=WIDTH)
            out[k] = np.sqrt(seen / seen.sum())
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: all splits for up to 5 languages, else the best of seeded draws."""
    if n <= 5:
        bits = [[(split >> k) & 1 for k in range(n)] for split in range(1, 2 ** max(n - 1, 1))]
        return np.array(bits or [[0] * n]).T * 2 - 1
    rng, length, best, far = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, length)) * 2 - 1
        near = min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a))
        if near > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, near
    return best


@dataclass
class OutputCodes:
    names: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, lead: 0 for a tie to 1)."""
        margin = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(axis=1) for c in self.code], axis=1)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        return loss.argmin(axis=1), share.max(axis=1)

    def column(self, text: Column) -> Column:
        """struct of lang (``und`` for null or no letter) and score (0 for ``und``)."""
        model = self

        @pandas_udf("lang string, score double")
        def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = batch.tolist()
                names, scores = [], []
                for at in range(0, len(texts), 500):
                    part = texts[at : at + 500]
                    which, lead = model.decode(grams(part)) if model.names else (np.zeros(len(part), int), np.zeros(len(part)))
                    for t, w, s in zip(part, which.tolist(), lead.tolist(), strict=True):
                        known = bool(model.names) and t is not None and any(map(str.isalpha, t))
                        names.append(model.names[w] if known else "und")
                        scores.append(s if known else 0.0)
                yield pd.DataFrame({"lang": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

        return language(text.cast("string"))


def fit_codes(x: np.ndarray, names: list[str], *, steps: int = 300, rate: float = 8.0, ridge: float = 1e-4) -> OutputCodes:
    """Logistic regressions for all bits at once, by gradient descent with momentum."""
    known = sorted(set(names))
    code = codewords(len(known)) if known else np.zeros((0, 1))
    y = np.array([known.index(n) for n in names], dtype=int)
    target = code[y].astype(np.float32) if known else np.zeros((0, 1), np.float32)
    counts = np.bincount(y, minlength=max(len(known), 1)) if known else np.ones(1)
    even = (len(y) / (len(known) * counts[y])).astype(np.float32)[:, None] if known else np.ones((0, 1), np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps if known else 0):
        pull = even * target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) / len(y)
        vw = 0.9 * vw + pull.T.dot(x).T - ridge * w
        vb = 0.9 * vb + pull.sum(axis=0)
        w, b = w + rate * vw, b + rate * vb
    right = ((x @ w + b) * target > 0).mean(axis=0) if known else np.ones(code.shape[1])
    return OutputCodes(known, code, w, b, np.clip(2 * right - 1, 0.05, 1.0))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 3_000) -> OutputCodes:
    """Fit on at most ``rows`` rows with a language and a text, those of least hash of id and
    text. Repeated rows count as often as they are there, but no more than ``rows`` in all."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    own = F.xxhash64(F.lit(11), "id", "lang", "text")
    picked = known.select(own.alias("h")).orderBy("h").limit(rows)
    few = known.join(F.broadcast(picked.distinct()), own == F.col("h")).limit(rows)  # at most ``rows`` longs; copies of the last may be over

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"lang": b["lang"], "x": [r.astype(np.float16).tobytes() for r in grams(b["text"].tolist())]})

    got = few.select("text", "lang").mapInPandas(measure, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.float16).reshape(len(got), WIDTH).astype(np.float32)
    return fit_codes(x, got["lang"].tolist())


def identify(docs: DataFrame, model: OutputCodes, *, id_col: str = "doc_id", text_col: str = "text", ambiguous: float = 0.6) -> DataFrame:
    """id, lang_pred, score, ambiguous for every row, over its whole text; null texts and those
    without a letter are ``und`` with score 0, and ambiguous. Repeated rows get the same answer.
    A column of ``docs`` that is named like one of the result is left out."""
    told = docs.select(F.col(id_col), model.column(F.col(text_col)).alias("__told"))
    return told.select(id_col, F.col("__told.lang").alias("lang_pred"), F.col("__told.score").alias("score"), (F.col("__told.score") < ambiguous).alias("ambiguous"))
