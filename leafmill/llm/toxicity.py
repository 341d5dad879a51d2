"""Toxicity by a weighted lexicon that Aho-Corasick matches in folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

TRAIN_ROWS = 20_000
"""Most labelled rows that a lexicon is learned from, the first by a hash of doc_id."""
STEMS = (4, 5, 6, 7)
MIN_HITS = 5
MIN_SHARE = 0.01
MIN_ODDS = 60

# Letters that look alike, and digits or signs that stand for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "н": "h", "т": "t", "в": "b", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "ɑ": "a", "ɡ": "g"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
SIGNS = frozenset(c for c in SUBSTITUTES if not c.isdigit())
# Words to begin with, and phrases in which such a word is harmless.
SEED_TERMS = ("idiot", "stupid", "moron", "loser", "pathetic", "worthless", "disgusting", "scum", "trash", "clown", "imbecile", "dumbass", "asshole", "bastard", "bitch")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "pond scum", "pathetic fallacy", "sore loser")


class Folding(dict):
    """Translation of each character to one folded letter: case, accents, homoglyphs, digits and signs."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if code >= 128:
            c = HOMOGLYPHS.get(c.lower(), c)
            c = unicodedata.normalize("NFKD", c)[:1] or chr(code)
        c = c.lower()[:1]
        c = HOMOGLYPHS.get(c, c)
        self[code] = c = SUBSTITUTES.get(c, c)
        return c


FOLDED_WORD = re.compile(r"[^\W_]+(?:[@$!|€][^\W_]+)*")


def fold(text: str) -> str:
    return text.translate(Folding())


class Lexicon:
    """Matches weighted terms; a term that ends with * matches any word that begins with it.

    A match counts if the text has a letter or a substituting sign in it, so
    words mostly written in substitutes count and numbers do not.
    """

    def __init__(self, terms: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        import ahocorasick

        self.folding = Folding()
        self.automaton = ahocorasick.Automaton()
        for term, weight in terms.items():
            stem = term.rstrip("*")
            self.automaton.add_word(stem, (len(stem), weight, term.endswith("*"), ""))
        for phrase in exceptions:
            folded = phrase.translate(self.folding)
            self.automaton.add_word(folded, (len(folded), 0.0, False, folded))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float, int]:
        """(sum of weights of matches, that sum to 100 words, number of matches)."""
        if not text or self.empty:
            return 0.0, 0.0, 0
        folded = text.translate(self.folding)
        spans, spared = [], []
        for end, (length, weight, is_stem, phrase) in self.automaton.iter(folded):
            start, end = end - length + 1, end + 1
            if start and text[start - 1].isalnum():
                continue
            if not is_stem and end < len(text) and text[end].isalnum():
                continue
            if phrase:
                spared.append((start, end))
            elif any(c.isalpha() or c in SIGNS for c in text[start:end]):
                spans.append((start, end, weight))
        if not spans:
            return 0.0, 0.0, 0
        total, n, done, reach, at = 0.0, 0, -1, -1, 0
        spared.sort()
        for start, end, weight in sorted(spans, key=lambda s: (s[0], -s[2], -s[1])):
            while at < len(spared) and spared[at][0] <= start:
                reach, at = max(reach, spared[at][1]), at + 1
            if start < done or end <= reach:  # `reach` is the furthest end of the phrases that begin no later
                continue
            total, n, done = total + weight, n + 1, end
        words = text.count(" ") + text.count("\n") + 1
        return total, 100.0 * total / words, n


def _is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, y) of at most `limit` labelled documents, the first by a hash of doc_id; a row without a label is none, and of rows that repeat a doc_id the least text counts."""
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")


def _terms(batches):
    folding = Folding()
    for pdf in batches:
        counts: dict[str, list[int]] = {}
        for text, y in zip(pdf["text"], pdf["y"]):
            found = set(FOLDED_WORD.findall(text.translate(folding)))
            for w in list(found):
                found.update(w[:k] + "*" for k in STEMS if len(w) > k)
            for w in found:
                counts.setdefault(w, [0, 0])[y > 0] += 1
        yield pd.DataFrame([(w, a, b) for w, (a, b) in counts.items()], columns=["term", "clean", "toxic"])


def learn_terms(sample: DataFrame) -> dict[str, float]:
    """Words and word beginnings that mark label 1 in (text, y), weighted by smoothed log odds, with the seed terms.

    A term needs MIN_HITS toxic texts and MIN_SHARE of them, and MIN_ODDS times
    the share that it has among the others. The counts are over the whole
    sample, and MIN_SHARE bounds the number of terms by the sample's texts.
    """
    n = sample.agg(F.sum(F.when(F.col("y") > 0, 1)).alias("toxic"), F.sum(F.when(F.col("y") <= 0, 1)).alias("clean")).first()
    toxic, clean = (n["toxic"] or 0), (n["clean"] or 0)
    weights = {t.translate(Folding()): 4.0 for t in SEED_TERMS}
    if not toxic or not clean:
        return weights
    counts = sample.mapInPandas(_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log(((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1)))
    strong = counts.where(F.col("toxic") >= max(MIN_HITS, MIN_SHARE * toxic)).withColumn("w", odds).where(f"w > {math.log(MIN_ODDS)}")
    top = strong.orderBy("term").select("term", "w").toPandas()
    learned = dict(zip(top["term"], top["w"]))
    return weights | {t: w for t, w in learned.items() if not any(t[:k] + "*" in learned for k in STEMS if k < len(t.rstrip("*")))}


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, penalty: float = 1e-3) -> np.ndarray:
    """Weights and bias of a logistic regression by Newton steps."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) / len(y) + penalty * np.r_[w[:-1], 0]
        hess = (z * (p * (1 - p))[:, None]).T @ z / len(y) + penalty * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


def _inputs(total: np.ndarray, density: np.ndarray) -> np.ndarray:
    return np.c_[np.log1p(total), np.log1p(density)]


class Toxicity:
    """A fitted scorer: score(docs) adds what the lexicon finds."""

    def __init__(self, terms: dict[str, float], weights: np.ndarray):
        self.terms, self.weights = terms, weights

    def found(self, text: str) -> Column:
        """A struct of n_hits and score of the text column of that name."""
        terms, weights = self.terms, self.weights

        @F.pandas_udf("n_hits int, score double")
        def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            lexicon = Lexicon(terms)
            for texts in parts:
                hits = np.array([lexicon.features(t or "") for t in texts], float).reshape(-1, 3)
                p = 1 / (1 + np.exp(-(np.c_[_inputs(hits[:, 0], hits[:, 1]), np.ones(len(hits))] @ weights)))
                yield pd.DataFrame({"n_hits": hits[:, 2].astype("int32"), "score": p})

        return scored(text)

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_hits, score): probability that the text is toxic; null and empty texts score as texts without a match."""
        return docs.select("doc_id", self.found("text").alias("toxicity_")).select("doc_id", "toxicity_.n_hits", "toxicity_.score")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Toxicity:
    """Learns the lexicon and a length-normalised score from labels(doc_id, toxic) on at most max_rows rows.

    Label 1 means toxic. Without both labels the seed terms score alone.
    Labels of documents that are not there, null labels and null ids count for
    nothing; rows that repeat a doc_id count once. An empty table of documents
    or labels gives a scorer all the same. Other columns are ignored, and a
    very long text is matched whole in time linear in its length.
    """
    from .arrow_text import bounded_batches
    from .components import settle

    bounded_batches(docs.sparkSession)
    sample = settle(bounded_sample(docs, labels, "toxic", max_rows))
    terms = learn_terms(sample)

    def features(batches):
        lexicon = Lexicon(terms)
        for pdf in batches:
            found = [lexicon.features(t)[:2] for t in pdf["text"]]
            yield pd.DataFrame({"a": [f[0] for f in found], "b": [f[1] for f in found], "y": pdf["y"].to_numpy()}).astype({"a": float, "b": float})

    seen = sample.mapInPandas(features, "a double, b double, y int").toPandas()
    if seen["y"].nunique() < 2:
        return Toxicity(terms, np.array([2.0, 1.0, -2.0]))
    return Toxicity(terms, fit_logistic(_inputs(seen["a"].to_numpy(), seen["b"].to_numpy()), (seen["y"] > 0).to_numpy(float)))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels.where(~_is_held_out(F.col("doc_id"))))
    return model.score(docs).select(
        "doc_id", _is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits"
    )
