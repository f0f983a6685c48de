"""The reading level of each document: familiar words and sentence length, fitted to levels given by raters."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut

LEAST_CHARS = 200
LEVELS = (1, 5)
#: Labelled documents used for the fit at most, chosen by hash.
MOST_LABELLED = 20_000
#: A script with fewer labelled documents is read by the unfitted formula.
LEAST_LABELLED = 30

#: Buckets of the table of document frequencies, per script; a word of Latin script or a run of four Thai letters has one.
_BUCKETS = 1 << 20
_THAI_RUN = 4
#: The high-frequency list: words in at least this share of the documents of their script.
_FAMILIAR = 0.002
#: A word is unfamiliar at a cut if fewer than this share of documents has it.
CUTS = (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01, 0.005)
_N = len(CUTS) + 7
RIDGES = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0)

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_SENTENCE = re.compile(r"[.!?\n\r。！？]+")
_SPACE = re.compile(r"\s+")
_THAI = re.compile("[ก-๛]")


def is_thai(text: str) -> bool:
    """Thai when Thai letters make up more than three tenths of the text; lang columns are not relied on."""
    return len(_THAI.findall(text)) > 0.3 * len(text)


def _thai_words(text: str) -> np.ndarray:
    """Buckets of the runs of four Thai characters. Thai is written without blanks between words, so runs of letters
    take the place of words: the runs of familiar words are familiar."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) - 0x0E00
    ok = (x > 0) & (x < 0x5C)
    n = len(x) - _THAI_RUN + 1
    if n <= 0:
        return np.empty(0, np.int64)
    h = np.zeros(n, np.int64)
    good = np.ones(n, bool)
    for i in range(_THAI_RUN):
        h = h * 128 + np.where(ok[i : i + n], x[i : i + n], 0)
        good &= ok[i : i + n]
    h = h[good]
    return ((h * 0x9E3779B1) >> 7) & (_BUCKETS - 1)


class _Latin:
    """Buckets of words, remembered up to a bound."""

    def __init__(self):
        self.seen: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, float]:
        words = _WORD.findall(text.lower())
        seen = self.seen
        if len(seen) > 500_000:
            seen.clear()
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            b = seen.get(w)
            if b is None:
                b = seen[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) & (_BUCKETS - 1)
            out[i] = b
        return out, sum(map(len, words)) / max(1, len(words))


def _readable(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") >= LEAST_CHARS)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(script, bucket, df) over all documents: each task adds its documents up in a table of fixed size and sends what
    is not zero; bucket -1 holds the number of documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = {s: np.zeros(_BUCKETS, np.int32) for s in (0, 1)}
        n, latin = [0, 0], _Latin()
        for b in batches:
            for t in b["text"]:
                s = int(is_thai(t))
                n[s] += 1
                tables[s][np.unique(_thai_words(t) if s else latin(t)[0])] += 1
        for s in (0, 1):
            at = np.flatnonzero(tables[s])
            yield pd.DataFrame({"script": s, "bucket": np.r_[-1, at], "df": np.r_[n[s], tables[s][at]].astype(np.int64)})

    return docs.select("text").mapInPandas(count, "script int, bucket long, df long").groupBy("script", "bucket").agg(F.sum("df").alias("df"))


def familiar_words(docs: DataFrame) -> dict[int, np.ndarray]:
    """Per script a table of document shares, zero for words outside the high-frequency list. The list is bounded: words
    in at least ``_FAMILIAR`` of the documents, so no more than a document's mean distinct words over that share."""
    df = cut(document_frequencies(docs))
    n = {r["script"]: r["df"] for r in df.filter("bucket = -1").collect()}
    limit = F.create_map(*[F.lit(x) for s in (0, 1) for x in (s, float(max(1.0, n.get(s, 0) * _FAMILIAR)))])
    top = df.filter((F.col("bucket") >= 0) & (F.col("df") >= F.element_at(limit, F.col("script")))).toPandas()
    out = {}
    for s in (0, 1):
        share = np.zeros(_BUCKETS, np.float32)
        own = top[top["script"] == s]
        share[own["bucket"].to_numpy(np.int64)] = own["df"].to_numpy() / max(1, n.get(s, 0))
        out[s] = share
    return out


def _features(text: str, thai: bool, shares: dict[int, np.ndarray], latin: _Latin) -> np.ndarray:
    """Shares of words outside the list at every cut; the mean sentence length and its logarithm, the median, the ninetieth
    percentile and the mean logarithm of the lengths; the mean length of words (for Thai, of runs between blanks); the mean
    rarity of words. A Thai sentence is a run between blanks, as Thai ends sentences with a blank."""
    if thai:
        buckets = _thai_words(text)
        lengths = np.array([len(x) for x in _SPACE.split(text) if x], dtype=float)
    else:
        buckets, mean_word = latin(text)
        lengths = np.array([len(x) for x in _SENTENCE.split(text) if x.strip()], dtype=float)
    if not len(lengths):
        lengths = np.zeros(1)
    d = np.sort(shares[int(thai)][buckets])
    n = max(1, len(d))
    outside = np.searchsorted(d, np.array(CUTS, np.float32)) / n
    rarity = float(-np.log(d + 1e-4).mean()) if len(d) else 0.0
    mean = lengths.mean()
    return np.r_[outside, mean, np.log(mean + 1), np.median(lengths), np.percentile(lengths, 90), np.log(lengths + 1).mean(), mean if thai else mean_word, rarity]


def features(docs: DataFrame, shares: dict[int, np.ndarray]) -> DataFrame:
    """(doc_id, script, x): a document's script, 1 for Thai, and its features. A narrow pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(shares)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        latin = _Latin()
        for b in batches:
            scripts = [is_thai(t) for t in b["text"]]
            x = [_features(t, s, shared.value, latin) for t, s in zip(b["text"], scripts)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "script": np.array(scripts, dtype=np.int32), "x": x})

    return docs.mapInPandas(measure, "doc_id long, script int, x array<double>")


@dataclass
class Formula:
    """A quadratic function of the features, centred and scaled."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Formula:
        """Ridge regression on the centred features and their squares; the ridge is the one of RIDGES with the least
        generalised cross-validation error, so that few labels give a stiffer formula than many."""
        centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = (x - centre) / scale
        a = np.c_[z, z**2]
        shift = a.mean(axis=0)
        u, s, vt = np.linalg.svd(a - shift, full_matrices=False)
        uy, n = u.T @ (y - y.mean()), len(y)
        best = None
        for ridge in RIDGES:
            keep = s**2 / (s**2 + ridge)
            rss = float(((y - y.mean() - u @ (keep * uy)) ** 2).sum())
            error = rss / max(n - 1 - keep.sum(), 1e-9) ** 2
            if best is None or error < best[0]:
                best = error, vt.T @ (s / (s**2 + ridge) * uy)
        w = best[1]
        return cls(centre, scale, np.r_[y.mean() - shift @ w, w])

    @classmethod
    def unfitted(cls) -> Formula:
        """Without labels, the plain familiar-word formula: a level more for every fifth of the words outside the list at the
        cut of a tenth, and half a level for every doubling or so of the mean sentence length from sixty letters."""
        w = np.zeros(1 + 2 * _N)
        w[0], w[1 + CUTS.index(0.1)], w[1 + len(CUTS) + 1] = 0.5 + LEVELS[0] - 0.7 * np.log(61), float(LEVELS[1]), 0.7
        return cls(np.zeros(_N), np.ones(_N), w)

    def column(self, x: Column) -> Column:
        """The score as a Column; like the fit, it is linear in the features and their squares."""
        total = F.lit(float(self.weights[0]))
        for i in range(_N):
            z = (x[i] - float(self.centre[i])) / float(self.scale[i])
            total = total + z * float(self.weights[1 + i]) + z * z * float(self.weights[1 + _N + i])
        return total


def reading_levels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", level: str = "reading_level") -> DataFrame:
    """(doc_id, reading_level): a level from 1 to 5 for every document with at least 200 characters.

    The familiar-word formula, widened: the share of words outside a high-frequency list, the list being taken at twelve
    cuts of the document frequencies counted over the whole corpus, and the mean sentence length; beside them the mean
    rarity of words, their length and four other measures of sentence length, and the squares of all (see _features; the
    README has the figures with and without). The weights, one set per script, are fitted to the raters' levels (their mean per document) on at most MOST_LABELLED labelled documents,
    chosen by hash; the fit is the only part that sees a sample. A script without enough labels gets the formula
    unfitted. Documents with null or shorter text have no row; equal rows are scored each.

    Two narrow passes over the texts: one counts, one measures. What is shuffled are counts per word and task; what is
    joined with the labels are features, never texts.
    """
    readable = _readable(docs, doc_id, text)
    every = docs.select(F.col(text).alias("text")).filter("text IS NOT NULL")
    measured = cut(features(readable, familiar_words(every)))
    rated = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(level).cast("double").alias("y")).dropna().groupBy("doc_id").agg(F.avg("y").alias("y"))
    sample = measured.join(rated, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED).toPandas()
    score = None
    for s in (0, 1):
        own = sample[sample["script"] == s]
        f = Formula.fit(np.stack(own["x"].to_list()), own["y"].to_numpy()) if len(own) >= LEAST_LABELLED else Formula.unfitted()
        score = f.column(F.col("x")) if score is None else F.when(F.col("script") == s, f.column(F.col("x"))).otherwise(score)
    return measured.select("doc_id", F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[1]), F.rint(score).cast("int"))).alias("reading_level"))


def level_profile(levels: DataFrame) -> DataFrame:
    """How many documents there are of each level."""
    return levels.groupBy("reading_level").agg(F.count("*").alias("n_docs"))
