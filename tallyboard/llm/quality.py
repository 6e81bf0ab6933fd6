"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.common import bounded_sample, crc_mod

WORD = re.compile(r"[^\W\d_]+")
SYMBOL = re.compile(r"[^\w\s]")
PIECE = 1 << 17
FEATURES = (
    "chars", "words", "mean_word", "letters", "digits", "upper", "spaces", "symbols", "odd_symbols", "stops",
    "lines", "mean_line", "short_lines", "repeated_lines", "distinct_words", "top_word", "title_words", "long_words",
    "top_symbol", "short_words", "non_ascii", "wide_words",
)


def document_statistics(text: str | None) -> list[float]:
    """The values named in `FEATURES` for one whole text; null counts as empty."""
    text = text if isinstance(text, str) else ""
    n = max(1, len(text))
    tokens = text.split()
    lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) if tokens else np.zeros(1, dtype=np.int64)
    counts, total = Counter(tokens), max(1, len(tokens))
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    low = np.bincount(np.minimum(codes, 255), minlength=256)
    upper = low[65:91].sum()
    letters = low[97:123].sum() + upper + low[192:].sum()
    digits = low[48:58].sum()
    marks = np.concatenate((low[33:48], low[58:65], low[91:97], low[123:127]))
    plain = low[44] + low[46] + low[33] + low[63] + low[39] + low[45]
    lines = text.split("\n")
    filled = [line for line in lines if line.strip()]
    n_lines = max(1, len(filled))
    return [
        float(np.log1p(len(text))),
        float(np.log1p(len(tokens))),
        float(lengths.mean()),
        letters / n,
        digits / n,
        upper / n,
        (low[32] + low[10] + low[9]) / n,
        marks.sum() / n,
        (marks.sum() - plain) / n,
        (low[46] + low[33] + low[63]) / total,
        float(np.log1p(len(lines))),
        len(text) / n_lines,
        sum(len(line) < 30 for line in filled) / n_lines,
        1.0 - len(set(filled)) / n_lines,
        len(counts) / total,
        max(counts.values(), default=0) / total,
        sum(word[0].isupper() for word in counts) / max(1, len(counts)),
        float((lengths > 12).mean()),
        float(marks.max()) / n,
        float((lengths <= 3).mean()),
        low[128:].sum() / n,
        float((lengths > 30).mean()),
    ]


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth, flattened: node k of a tree has the children 2k+1 and 2k+2."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right where value > threshold
    leaf: np.ndarray  # trees x leaves
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row; all rows go down a tree together."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1.0 / (1.0 + np.exp(-total))


def fit_forest(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0
) -> Forest:
    """Boosted trees for the logistic loss; splits are found on histograms of quantile bins."""
    n, width = x.shape
    inner = (1 << depth) - 1
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin = np.full(n, base)
    features, thresholds = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf)
    leaves = np.zeros((trees, inner + 1))
    cell = binned + np.arange(width) * bins
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        slope, weight = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            place = ((node - first)[:, None] * (width * bins) + cell).ravel()
            size = count * width * bins
            g = np.bincount(place, np.repeat(slope, width), size).reshape(count, width, bins).cumsum(axis=2)
            h = np.bincount(place, np.repeat(weight, width), size).reshape(count, width, bins).cumsum(axis=2)
            whole_g, whole_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (whole_g - g) ** 2 / (whole_h - h + ridge) - whole_g**2 / (whole_h + ridge)
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -np.inf
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    features[t, first + k], thresholds[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        end = node - inner
        g, h = np.bincount(end, slope, inner + 1), np.bincount(end, weight, inner + 1)
        leaves[t] = -rate * g / (h + ridge)
        margin += leaves[t][end]
    return Forest(features, thresholds, leaves, base, depth)


def statistics_of(texts: pd.Series) -> np.ndarray:
    return np.array([document_statistics(text) for text in texts]).reshape(-1, len(FEATURES))


def train(labelled: DataFrame, text: str = "text", label: str = "quality") -> Forest:
    """Statistics are computed on the executors; the bounded sample's numbers are fitted on the driver."""

    @F.pandas_udf("array<double>")
    def statistics(texts: pd.Series) -> pd.Series:
        return pd.Series(list(statistics_of(texts)))

    rows = labelled.select(statistics(F.col(text)).alias("x"), F.col(label).cast("double").alias("y")).toPandas()
    if rows.empty:
        return Forest(np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), 0.0, 1)
    return fit_forest(np.stack(rows["x"].to_list()), rows["y"].to_numpy())


def predict(documents: DataFrame, forest: Forest, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """`documents` with `score` (0 to 1) and `predicted` (1 from `threshold` on); null text counts as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.score(statistics_of(batch)))

    kept = [c for c in documents.columns if c not in ("score", "predicted")]
    rows = documents.select(*kept, scored(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str, rows_per_label: int = 8000) -> DataFrame:
    """Quality score of every document; learned from labels of documents whose crc32(doc_id) mod 4 is not 2.

    At most about `rows_per_label` labelled documents of each label, 0 and 1, are used. A document with several different
    labels takes part with the smallest.
    """
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.filter(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), 4) != 2))
    chosen = bounded_sample(labels.groupBy("doc_id").agg(F.min("quality").alias("quality")), "quality", "doc_id", rows_per_label)
    forest = train(documents.join(F.broadcast(chosen), "doc_id"))  # two labels of about `rows_per_label` ids at most
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return predict(documents, forest).select("doc_id", held_out.alias("held_out"), "score", "predicted")
