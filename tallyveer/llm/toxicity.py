"""Toxicity by class-conditional Kneser-Ney models of letters in words.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary labelled texts, give a word's letters their
probability after the three letters before. Counts of the longest runs are kept by class; all shorter runs share their
continuation counts, so what one class has not seen falls back to the same estimate in both and counts as no evidence. A text's figure is
the mean over its words of the log-likelihood ratio beyond a margin, so its length cancels out and noise of rare letters does not
add up. A logistic curve fitted to the labelled sample turns it into a score.

The sample is bounded (``SAMPLE_PER_CLASS`` labelled documents of each class, first by the hash of their id, texts up to
``SAMPLE_CHARACTERS``); so is the model, whatever the corpus. Scoring covers every whole text.

Defined results: null and empty texts have no words and get the score of no evidence; a document labelled twice counts as
toxic if either label says so; without labels of both classes every score is 0; repeated rows score alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveer.llm.common import field, held_out, per_text, sample_order, scored, stored

WORD = re.compile(r"[^\W\d_]+")
ORDER = 4
DISCOUNT = 0.75
#: Log-likelihood ratio of a word that is taken for noise.
MARGIN = 3.0
SAMPLE_PER_CLASS = 1500
SAMPLE_CHARACTERS = 20_000
#: Rows with crc32(doc_id) mod FOLDS equal to HELD are never learnt from.
FOLDS, HELD = 5, 0
#: Words whose figure a task remembers.
REMEMBERED = 200_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def runs_of(word: str) -> Iterator[str]:
    """Each letter of a word (and its end) after up to ORDER - 1 symbols before it."""
    line = f"^{word}$"
    for i in range(1, len(line)):
        yield line[max(0, i - ORDER + 1) : i + 1]


class KneserNeyPair:
    """Log-likelihood ratio of two models from the counts of their longest runs."""

    def __init__(self, toxic: Counter, ordinary: Counter):
        both = (toxic, ordinary)
        totals, kinds = [Counter(), Counter()], [Counter(), Counter()]
        for c, counts in enumerate(both):
            for run, n in counts.items():
                totals[c][run[:-1]] += n
                kinds[c][run[:-1]] += 1
        self._share(set(toxic) | set(ordinary))

        def given(c: int, run: str, lower: float) -> float:
            n = totals[c][run[:-1]]
            if not n:
                return lower
            return (max(both[c][run] - DISCOUNT, 0.0) + DISCOUNT * kinds[c][run[:-1]] * lower) / n

        self.ratio = {}
        for run in set(toxic) | set(ordinary):
            lower = self._shared(run[1:])
            self.ratio[run] = math.log(given(0, run, lower) / given(1, run, lower))
        # after a known context an unknown letter leaves only the ratio of the two backoff weights
        weight = [{x: DISCOUNT * kinds[c][x] / n for x, n in totals[c].items()} for c in (0, 1)]
        self.backoff = {
            x: math.log(weight[0].get(x, 1.0) / weight[1].get(x, 1.0)) for x in set(weight[0]) | set(weight[1])
        }
        self.letters = self.continuations = self.spread = self.branches = None  # not needed to score

    def _share(self, runs: set[str]) -> None:
        """Continuation counts of all shorter runs, over both classes."""
        self.continuations, self.spread, self.branches = Counter(), Counter(), Counter()
        while runs:
            shorter = Counter(run[1:] for run in runs if len(run) > 1)
            runs = {run for run in shorter if run not in self.continuations}
            self.continuations.update(shorter)
        for run, n in self.continuations.items():
            self.spread[run[:-1]] += n
            self.branches[run[:-1]] += 1
        self.letters = max(1, self.branches[""])

    def _shared(self, run: str) -> float:
        if not run:
            return 1.0 / self.letters
        n, lower = self.spread[run[:-1]], self._shared(run[1:])
        if not n:
            return lower
        return (max(self.continuations[run] - DISCOUNT, 0.0) + DISCOUNT * self.branches[run[:-1]] * lower) / n

    def word(self, word: str) -> float:
        ratio, backoff = self.ratio, self.backoff
        return sum(ratio[r] if r in ratio else backoff.get(r[:-1], 0.0) for r in runs_of(word))


class Scorer:
    """A text's length-normalised evidence, and its score on a logistic curve."""

    def __init__(self, pair: KneserNeyPair | None, slope: float = 0.0, offset: float = 0.0):
        self.pair, self.slope, self.offset, self.seen = pair, slope, offset, {}

    def evidence(self, text: str) -> float:
        words, total = words_of(text), 0.0
        for w in words:
            v = self.seen.get(w)
            if v is None:
                v = max(self.pair.word(w) - MARGIN, 0.0)
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                if len(w) <= 64:
                    self.seen[w] = v
            total += v
        return total / max(len(words), 1)

    def score(self, text: str) -> float:
        if self.pair is None:
            return 0.0
        return 1.0 / (1.0 + math.exp(-min(max(self.slope * self.evidence(text) + self.offset, -50.0), 50.0)))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """Columns toxic and text of the bounded training sample."""
    known = labels.where(~held_out(F.col("doc_id"), FOLDS, HELD) & F.col("doc_id").isNotNull())
    known = known.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    first = [
        known.where(F.col("toxic") == c).orderBy(sample_order(F.col("doc_id")), "doc_id").limit(SAMPLE_PER_CLASS)
        for c in (0, 1)
    ]
    chosen = first[0].union(first[1]).withColumnRenamed("doc_id", "labelled id")
    pairs = docs.select(field(key).alias("id"), field(text).alias("text")).join(
        F.broadcast(chosen),  # at most 2 * SAMPLE_PER_CLASS rows
        F.col("id") == F.col("labelled id"),
    )
    return pairs.where(F.length("text") <= SAMPLE_CHARACTERS).select("toxic", "text")


def fitted(values: Iterable[tuple[int, float]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve, classes weighted alike, lightly held to zero."""
    y, x = (np.array(v, dtype=float) for v in zip(*values, strict=True))
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    scale = x.std() or 1.0
    rows, b, hold = np.stack([x / scale, np.ones_like(x)], axis=1), np.zeros(2), np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ b, -50, 50)))
        slope = rows.T @ (weight * (p - y)) + hold @ b
        b -= np.linalg.solve((rows * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ rows + hold, slope)
    return float(b[0] / scale), float(b[1])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Scorer:
    """Count runs of letters on the executors, then smooth and fit; the driver gets distinct runs and one figure a text."""
    sample = stored(labelled_sample(docs, labels, key, text), "toxicity-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for c, part in rows.groupby("toxic"):
                words = Counter(w for t in part["text"] for w in words_of(t))
                runs = Counter()
                for w, n in words.items():
                    for r in runs_of(w):
                        runs[r] += n
                if runs:
                    yield pd.DataFrame({"toxic": c, "run": list(runs), "n": list(runs.values())})

    counted = sample.mapInPandas(count, "toxic int, run string, n long").groupBy("toxic", "run").agg(F.sum("n").alias("n"))
    counts = (Counter(), Counter())
    for c, run, n in counted.collect():
        counts[c][run] = n
    if not counts[0] or not counts[1]:
        return Scorer(None)
    scorer = Scorer(KneserNeyPair(counts[1], counts[0]))
    figures = sample.select("toxic", per_text(lambda: lambda t: (scorer.evidence(t),), "x double")("text")["x"].alias("x"))
    return Scorer(scorer.pair, *fitted([tuple(r) for r in figures.collect()]))


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, whether the id is held out, score, and the verdict at one half."""
    out = scored(docs, per_text(lambda: lambda t: (scorer.score(t),), "score double"), key, text)
    return out.select(
        field(key),
        held_out(field(key), FOLDS, HELD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    temporary = "toxicity result"
    out = docs.withColumn(temporary, per_text(lambda: lambda t: (scorer.score(t),), "score double")(field(text)))
    return out.where(field(temporary)["score"] < 0.5).select(*[field(c) for c in docs.columns])
