"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.llm.common import batches_by_size, bounded_sample, crc_mod

UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
PIECE = 1 << 15  # characters scored at a time
MAX_LANGUAGES = 2000
EVIDENCE = 40.0  # n-grams after which more text no longer sharpens the score


@dataclass(frozen=True)
class LanguageModel:
    """log P(n-gram | language), one row per bucket; `prior` is log P(language)."""

    languages: list[str]
    weights: np.ndarray  # buckets x languages, float32
    prior: np.ndarray


@cache
def _letters_only() -> np.ndarray:
    """Code point -> itself for letters, else a space; the last entry stands for all beyond the basic plane."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x10000)] + [0x10000], dtype=np.uint32)


def ngram_buckets(text: str, buckets: int) -> np.ndarray:
    """Buckets of all bigrams and trigrams of lower-cased `text`, in which all but letters is spaces."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    codes = _letters_only()[np.minimum(codes, 0x10000)]
    grams = np.empty(2 * len(codes) - 3, dtype=np.uint32)
    two, three = grams[: len(codes) - 1], grams[len(codes) - 1 :]
    np.multiply(codes[:-1], np.uint32(0x9E3779B1), out=two)
    two += codes[1:]
    np.multiply(two[:-1], np.uint32(0x85EBCA77), out=three)
    three += codes[2:]
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x2C1B3C6D)
    grams >>= np.uint32(12)
    return grams & np.uint32(buckets - 1)


def _pieces(text: str) -> Iterator[str]:
    for start in range(0, max(1, len(text)), PIECE):
        yield text[start : start + PIECE]


def train(labelled: DataFrame, text: str = "text", label: str = "lang", buckets: int = 1 << 15) -> LanguageModel:
    """Count n-grams per language on the executors; the driver gets one number per language and bucket.

    `buckets` is a power of two, 2**20 at most.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for frame in frames:
            for lang, bodies in frame.groupby("_lang")["_text"]:
                own = totals.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                docs[lang] = docs.get(lang, 0) + len(bodies)
                for part in batches_by_size([len(body) for body in bodies], 8 * PIECE):
                    grams = [ngram_buckets(piece, buckets) for body in bodies.iloc[list(part)] for piece in _pieces(body)]
                    own += np.bincount(np.concatenate(grams), minlength=buckets)
        for lang, own in totals.items():
            used = np.flatnonzero(own)
            yield pd.DataFrame({"_lang": lang, "bucket": np.append(used, -1), "n": np.append(own[used], docs[lang])})

    rows = labelled.filter(F.col(text).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col(label).alias("_lang"), F.col(text).alias("_text"))
    counted = rows.mapInPandas(count, "_lang string, bucket long, n long").groupBy("_lang", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toPandas()
    if found.empty:
        return LanguageModel([], np.zeros((buckets, 0), dtype=np.float32), np.zeros(0))
    languages = sorted(found["_lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} labels; the broadcast matrix is meant for {MAX_LANGUAGES} at most")
    counts, docs = np.ones((buckets, len(languages))), np.zeros(len(languages))
    column = found["_lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy()
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    gram = bucket >= 0
    counts[bucket[gram], column[gram]] += n[gram]
    docs[column[~gram]] = n[~gram]
    weights = np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)
    return LanguageModel(languages, weights, np.log(docs / docs.sum()))


def score_texts(texts: list[str | None], model: LanguageModel) -> tuple[list[str], np.ndarray]:
    """Most probable language and its probability per text; ties go to the first name."""
    names, scores = [], np.zeros(len(texts))
    buckets = len(model.weights)
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not model.languages or not LETTER.search(text):
            names.append(UNKNOWN)
            continue
        total, n = np.zeros(len(model.languages)), 0
        for piece in _pieces(text):
            grams = ngram_buckets(piece, buckets)
            total += np.ones(len(grams), dtype=np.float32) @ model.weights.take(grams, axis=0)
            n += len(grams)
        logits = model.prior + total * (min(n, EVIDENCE) / max(n, 1))
        best = int(np.argmax(logits))
        names.append(model.languages[best])
        scores[i] = 1.0 / np.exp(logits - logits[best]).sum()
    return names, scores


def predict(documents: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """`documents` with `lang_pred` and `score`. Null, empty and letterless texts give `und` and 0.

    Columns named `lang_pred` or `score` are replaced; all others stay.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            names, scores = score_texts(list(batch), shared.value)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    kept = [c for c in documents.columns if c not in ("lang_pred", "score", "_scored")]
    rows = documents.select(*kept, scored(F.col(text)).alias("_scored"))
    return rows.select(*kept, "_scored.lang_pred", "_scored.score")


def fit_on_documents(documents: DataFrame, rows_per_language: int = 4000) -> LanguageModel:
    """Train on the documents that are not held out: about `rows_per_language` of each language at most."""
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.filter(F.coalesce(crc_mod(F.col("doc_id"), 3), F.lit(0)) != 1)
    return train(bounded_sample(known.select("doc_id", "lang", "text"), "lang", "doc_id", rows_per_language))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from the documents whose crc32(doc_id) mod 3 is not 1."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(documents.select("doc_id", "text"), fit_on_documents(documents))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_known_language(documents: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Documents with a predicted language of at least `min_score`; texts without letters, or between languages, go."""
    found = predict(documents, fit_on_documents(documents))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*documents.columns)
