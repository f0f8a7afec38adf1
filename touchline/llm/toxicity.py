"""Toxicity (operator 2): multiple-instance learning from document labels.

A document is a bag of sentences.  A sentence's score is a logistic function of the words it holds;
a document's score is the noisy-or of its sentences' scores, 1 - prod(1 - p).  Weights are trained by
gradient descent on the likelihood of the document labels, so no sentence needs a label; the trained
sentence scores then locate the offending sentences.

Bounds: ``max_train`` labelled documents (those with the smallest hash of their text) and
``max_words`` words (those whose document frequencies differ most between the labels, by the
log-likelihood ratio, ``MIN_RATIO`` or more).  The word statistics come from distributed aggregates, and only each training
document's chosen words reach the driver.  Scoring reads whole texts of every row.

Edge cases: null and empty texts are one sentence without words and get a score; documents with
several label rows are toxic if one says so; null labels don't count; without labels of both kinds
every score is the prior of an empty bag; repeated rows and null doc_ids are scored like others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, text_batches

THRESHOLD = 0.7
MAX_TRAIN = 12_000
MAX_WORDS = 512
PLAIN = -9.0  # log-odds of a sentence without chosen words, at most
MIN_RATIO = 10.0  # log-likelihood ratio under which a word is chance among so many words
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None):
    """(start, end, words) of each sentence that has words."""
    text = text or ""
    at = 0
    for stop in [*(m.span() for m in _SENTENCE.finditer(text)), (len(text), len(text))]:
        words = set(_WORD.findall(text[at : stop[0]].lower()))
        if words:
            yield at, stop[0], words
        at = stop[1]


def bags(text: str | None, chosen: dict) -> tuple[list[list], int]:
    """The chosen words of each sentence that has any, and the number of other sentences."""
    low = (text or "").lower()
    found, plain = [], 0
    for s in _SENTENCE.split(low):
        words = chosen.keys() & _WORD.findall(s)
        if words:
            found.append(sorted(chosen[w] for w in words))
        elif s and not s.isspace():
            plain += 1
    return found, plain if found or plain else 1


@dataclass
class Model:
    bias: float = PLAIN
    weights: dict[str, float] = field(default_factory=dict)

    def sentence(self, z: float) -> float:
        return 1.0 / (1.0 + np.exp(-(self.bias + z)))

    def score(self, text: str | None) -> float:
        found, plain = bags(text, self.weights)
        keep = plain * np.log1p(-self.sentence(0.0))
        for ws in found:
            keep += np.log1p(-min(self.sentence(sum(ws)), 1 - 1e-12))
        return float(min(1.0, max(0.0, -np.expm1(keep))))

    def offending(self, text: str | None, least: float = 0.5):
        """(start, end, score) of the sentences that score ``least`` or more; a text that scores less has none."""
        for a, b, words in sentences(text):
            p = self.sentence(sum(self.weights.get(w, 0.0) for w in words))
            if p >= least:
                yield a, b, float(p)


def fit_noisy_or(docs: list[tuple[list[list[int]], int, int]], n_words: int, steps: int = 600, rate: float = 0.1, decay: float = 1e-5) -> tuple[float, np.ndarray]:
    """(bias, weights) that make the labels likely; docs: (word numbers by sentence, other sentences, label)."""
    y = np.array([d[2] for d in docs], float)
    plain = np.array([d[1] for d in docs], float)
    owner = np.array([i for i, d in enumerate(docs) for _ in d[0]], int)
    flat = np.array([w for d in docs for s in d[0] for w in s], int)
    which = np.repeat(np.arange(len(owner)), [len(s) for d in docs for s in d[0]]) if len(owner) else np.zeros(0, int)
    theta, m, v = np.concatenate([[PLAIN], np.zeros(n_words)]), np.zeros(n_words + 1), np.zeros(n_words + 1)
    weight = 1.0 / max(1, len(docs))
    for t in range(1, steps + 1):
        z = theta[0] + np.bincount(which, weights=theta[1:][flat], minlength=len(owner)) if len(owner) else np.zeros(0)
        p, p0 = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-theta[0]))
        # log of the chance that no sentence offends
        keep = plain * np.log1p(-p0) + np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(docs))
        none = np.exp(keep)
        # of the loss, by -keep; keep falls by p for each unit of z
        g = weight * np.where(y > 0, -none / np.maximum(1 - none, 1e-9), 1.0)
        gz = g[owner] * p if len(owner) else np.zeros(0)
        grad = np.concatenate([[gz.sum() + (g * plain * p0).sum()], np.bincount(flat, weights=gz[which], minlength=n_words) if len(flat) else np.zeros(n_words)])
        grad[1:] += decay * theta[1:]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        theta[0] = min(theta[0], PLAIN)  # or long clean texts add up to a high score
    return float(theta[0]), theta[1:]


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_words: int = MAX_WORDS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the labels of ``docs``; the caller leaves out what must not be learned from."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("_y"))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h")).join(marks, "_id")
    pick = rows.orderBy("_h", "_id").limit(max_train).select("_id", "_y")
    pick = stage(pick, "tox-pick")
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(pick), "_id")  # at most max_train rows
    text = text_batches(stage(text, "tox-train"))

    def words_of(batches):
        for pdf in batches:
            out = [(w, int(y)) for t, y in zip(pdf["_text"], pdf["_y"]) for w in set(_WORD.findall((t or "").lower()))]
            frame = pd.DataFrame(out, columns=["word", "y"]).value_counts(["word", "y"], sort=False).reset_index(name="n") if out else pd.DataFrame({"word": [], "y": [], "n": []})
            yield frame.astype({"y": int, "n": "int64"})

    total = {r["_y"]: r["n"] for r in pick.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(total.get(1, 0)), float(total.get(0, 0))
    if not n1 or not n0:
        return Model()
    df = text.mapInPandas(words_of, "word string, y int, n long").groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    p1, p0, p = (F.col("a") + 0.5) / (n1 + 1), (F.col("b") + 0.5) / (n0 + 1), (F.col("a") + F.col("b") + 1) / (n1 + n0 + 2)
    ratio = F.col("a") * F.log(p1 / p) + F.col("b") * F.log(p0 / p)
    top = df.withColumn("r", ratio).where(F.col("r") >= MIN_RATIO).orderBy(F.col("r").desc(), "word").limit(max_words).select("word").collect()
    chosen = {r["word"]: i for i, r in enumerate(top)}

    def bags_of(batches):
        for pdf in batches:
            got = [bags(t, chosen) for t in pdf["_text"]]
            yield pd.DataFrame({"s": [g[0] for g in got], "plain": [g[1] for g in got], "y": pdf["_y"].astype(int)})

    local = text.mapInPandas(bags_of, "s array<array<int>>, plain long, y int").collect()
    docs_ = sorted(([list(map(list, r["s"])), r["plain"], r["y"]] for r in local), key=repr)
    bias, w = fit_noisy_or(docs_, len(chosen))
    return Model(bias, {word: float(w[i]) for word, i in chosen.items()})


def scorer(model: Model):
    """A function from a text column to its score; only texts go to Python, only numbers come back."""

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in text], dtype=float)

    return run


def marker(model: Model, least: float = 0.5):
    """A function from a text column to (score, offending): the spans ``start:end`` of the sentences that
    score ``least`` or more, joined by commas."""

    @F.pandas_udf("score double, offending string")
    def run(text: pd.Series) -> pd.DataFrame:
        scores = [model.score(t) for t in text]
        return pd.DataFrame({"score": scores, "offending": [",".join(f"{a}:{b}" for a, b, _ in model.offending(t, least)) if s >= least else "" for t, s in zip(text, scores)]})

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_score``, the score of its text; other columns pass through as they are."""
    return text_batches(docs).withColumn("_score", scorer(model)(F.col(text_col)))


def offending(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, sentence_score): the sentences that score ``least`` or more."""

    def run(batches):
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                out += [(None if pd.isna(doc) else int(doc), *found) for found in model.offending(text, least)]
            frame = pd.DataFrame(out, columns=["doc_id", "start", "end", "sentence_score"])
            yield frame.assign(doc_id=pd.array([x[0] for x in out], dtype="Int64"))

    return text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, start long, end long, sentence_score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, offending (spans of sentences), for every document.

    Labels of held-out rows (crc32 of the id's text mod 3 is 1) are never read."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    learn = train(docs.where(fold != 1), labels.where(fold != 1))
    out = text_batches(docs.select("doc_id", "text")).select("doc_id", marker(learn)(F.col("text")).alias("found"))
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), F.col("found.score").alias("score"), (F.col("found.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("found.offending").alias("offending"))
