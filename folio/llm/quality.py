"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are taken where the rows are; the trees are fitted on a sample of labelled rows whose size is bounded by
`TRAIN_ROWS`, and flattened into arrays (a complete tree per row, node k has children 2k+1 and 2k+2), which every task
walks level by level for a whole batch at once.

Null and empty texts have the same, all-zero statistics and get the score that these lead to. Labels that are null do not
count; of several labels of one document the lowest counts. Without two classes to learn from, every score is the share
of good labels (1 without labels). Repeated rows are scored alike; other columns are carried along.
"""

from __future__ import annotations

import operator
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most about this many labelled rows are used to fit.
TRAIN_ROWS = 12_000
TREES = 60
DEPTH = 4
BINS = 32
RATE = 0.2
LEAST_ROWS = 20
SHRINK = 1.0
THRESHOLD = 0.3
FEATURES = (
    "log_chars", "log_words", "chars_per_word", "distinct_words", "repeated_neighbours", "long_words", "lines_per_word",
    "distinct_lines", "chars_per_line", "lower", "upper", "digits", "blanks", "beyond_ascii", "stops", "commas", "bangs",
    "bars", "marks", "other_punctuation", "controls", "top_byte", "byte_entropy", "deflated", "upper_words", "marked_words",
)
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789",
    "blanks": b" \n\t\r",
    "stops": b".?",
    "commas": b",;:",
    "bangs": b"!",
    "bars": b"|<>{}[]\\/_=~^",
    "marks": b"*#&$%@",
    "other_punctuation": b"\"'()-+`",
    "controls": bytes([*range(9), 11, 12, *range(14, 32), 127]),
}
_UPPER_WORD = re.compile(r"\b[A-Z]{2,}\b")
_MARKED_WORD = re.compile(r"[!*#&$%@|]{1,3}(?=\s|\Z)")


def _class_matrix() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 1))
    for k, chars in enumerate(_CLASSES.values()):
        table[list(chars), k] = 1
    table[128:, len(_CLASSES)] = 1
    return table


_TABLE = _class_matrix()


def statistics(text: str | None) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = dict(zip([*_CLASSES, "beyond_ascii"], counts @ _TABLE / len(raw)))
    p = counts[counts > 0] / len(raw)
    words = text.split()
    n = max(1, len(words))
    lines = text.split("\n")
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / n,
        len(set(words)) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        sum(map((20).__lt__, map(len, words))) / n,
        len(lines) / n,
        len(set(lines)) / len(lines),
        np.log1p(len(text) / len(lines)),
        share["lower"],
        share["upper"],
        share["digits"],
        share["blanks"],
        share["beyond_ascii"],
        share["stops"],
        share["commas"],
        share["bangs"],
        share["bars"],
        share["marks"],
        share["other_punctuation"],
        share["controls"],
        float(p.max()),
        float(-(p * np.log2(p)).sum()),
        len(zlib.compress(raw, 1)) / len(raw),
        len(_UPPER_WORD.findall(text)) / n,
        len(_MARKED_WORD.findall(text)) / n,
    ]


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """Flattened trees: split feature and threshold of inner nodes, value of the leaves; `base` in log odds."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += value[node - inner]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting with logistic loss on quantile bins; all nodes of a level share one histogram pass per feature."""
    none = np.zeros((0, 0))
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return Trees(float(np.log((share + 1e-9) / (1 - share + 1e-9))), none.astype(int), none, none)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), base)
    inner = 2**DEPTH - 1
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            gain, choice = np.full(width, 1e-6), [None] * width
            for f, bins in enumerate(binned):
                at = (node - first) * BINS + bins
                gs = np.bincount(at, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(at, h, width * BINS).reshape(width, BINS).cumsum(1)
                ns = np.bincount(at, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                won = gs**2 / (hs + SHRINK) + (gt - gs) ** 2 / (ht - hs + SHRINK) - gt**2 / (ht + SHRINK)
                won[(ns < LEAST_ROWS) | (nt - ns < LEAST_ROWS)] = -1
                won[:, len(edges[f]) :] = -1
                best = won.argmax(1)
                for k in np.flatnonzero(won[np.arange(width), best] > gain):
                    gain[k], choice[k] = won[k, best[k]], (f, int(best[k]))
            for k, c in enumerate(choice):
                if c:
                    feature[first + k], threshold[first + k] = c[0], edges[c[0]][c[1]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value = -RATE * gl / (hl + SHRINK)
        raw += value[leaf]
        trees.append((feature, threshold, value))
    return Trees(base, *(np.stack(part) for part in zip(*trees)))


def train(labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id") -> Trees:
    """Trees from rows with a text and a 0/1 label; of more than TRAIN_ROWS rows, those whose hash falls below a share."""
    rows = labelled.where(F.col(label).isNotNull())
    n = rows.count()
    share = min(1.0, TRAIN_ROWS / max(1, n))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000))

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(texts)))

    got = chosen.select(stats(F.col(text)).alias("x"), F.col(label).cast("double").alias("y")).toPandas()
    x = np.array(got["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    y = got["y"].to_numpy(np.float64)
    order = np.lexsort([*x.T, y])  # the same trees whatever order the rows came in
    return fit(x[order], y[order])


def score(df: DataFrame, trees: Trees, text: str = "text", out: str = "score") -> DataFrame:
    """`df` with the column `out`: how likely a good label is, 0 to 1."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(trees.predict(matrix(texts)))

    return df.withColumn(out, scored(F.col(text)))


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, text and label of the documents that have one."""
    lowest = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    return docs.select("doc_id", "text").join(lowest, "doc_id")
