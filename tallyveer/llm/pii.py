"""Personal data: fixed shapes, and candidates that boosted trees accept.

High-recall generators propose overlapping spans of several kinds. Each candidate is described by its format (digits, separators, groups,
checksums) and its context (cue words and characters before it). Gradient-boosted trees, trained here on labelled
candidates, give it a probability; a threshold per kind, calibrated on a fold of the sample that the trees did not see,
selects what is added to the shapes' own spans.

The labelled sample: candidates in a bounded sample of documents, positive where a shape accepts them, and written examples of
formats that the shapes leave out (positive) and of dates, versions, prices and serial numbers (negative), drawn with a fixed seed.

Defined results: a null text counts as empty; a candidate that touches a span of a shape or a better candidate is not added;
equal starts are ordered by kind; repeated rows are scanned alike; an empty corpus still trains on the drawn examples. Spans are
code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field as member
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveer.llm.common import Taken, field, per_batch, scored, stored

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds beside them.
ADDED = ("mail_text", "phone_local", "national_id", "account")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, so no run is tried from its middle
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Generators: overlapping on purpose, wide on purpose.
GENERATORS = (
    (0, re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9.-]{1,64}(?:\s?[\[(]\s?dot\s?[\])]\s?[A-Za-z]{2,10})?", re.I)),
    (1, re.compile(r"(?<![0-9A-Za-z])[(]?[0-9]{2,4}[)]?(?:[\x20.-]?[(]?[0-9]{2,4}[)]?){2,4}(?![0-9A-Za-z])")),
    (2, re.compile(r"(?<![0-9A-Za-z-])[0-9]{2,3}[\x20-][0-9]{2}[\x20-][0-9]{3,4}(?![0-9A-Za-z-])")),
    (3, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
)
#: What every span of the first generator holds: without it the text need not be tried from each letter.
AT = re.compile(r"[\[(]\s?at\s?[\])]", re.I)
CUES = (
    ("mail", "e-mail", "contact", "correo", "courriel"),
    ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono"),
    ("ssn", "social", "passport", "national", "ausweis", "dni"),
    ("iban", "account", "konto", "cuenta", "compte", "bank"),
    ("version", "release", "isbn", "serial", "order", "invoice", "date", "price", "part"),
)

CORPUS_WEIGHT = 20_000
PRECISION = 0.98
#: Probabilities are calibrated in steps of one part in so many.
STEPS = 10_000
#: Rows that a task takes together.
POOL_ROWS = 1 << 16


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Found from the at signs, so a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed shapes, leftmost and not overlapping within a kind."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    return found + [(a, 3, b) for a, b in phones(text)]


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, generator, end) of what may be personal data."""
    return [(m.start(), g, m.end()) for g, shape in GENERATORS if g or AT.search(text) for m in shape.finditer(text)]


def features(text: str, start: int, generator: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span, before = text[start:end], text[max(0, start - 40) : start].lower()
    digits = re.sub(r"[^0-9]", "", span)
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    year = any(len(g) == 4 and 1900 <= int(g) <= 2100 for g in re.findall(r"[0-9]+", span))
    cues = [float(any(c in before for c in words)) for words in CUES]
    return [
        float(generator),
        float(len(span)),
        float(len(digits)),
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(groups[-1] if groups else 0),
        float(groups[0] if groups else 0),
        float(span.count("-")),
        float(span.count(".")),
        float(span.count(" ")),
        float(span.count("(")),
        float(sum(c.isalpha() for c in span)),
        float(len(set(digits))),
        float(year),
        float(bool(digits) and luhn(digits)),
        float(before.endswith((".", ",", "$", "€", "/", ":", "="))),
        float(before.rstrip().endswith("+")),
        *cues,
    ]


def drawn_examples(seed: int = 11, each: int = 150) -> list[tuple[str, int, int, int, int]]:
    """Labelled examples (text, start, generator, end, label) of formats with and without personal data."""
    rng = random.Random(seed)

    def number(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def letters(n: int) -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    good = (
        lambda: f"{letters(6)} [at] {letters(7)} [dot] com",
        lambda: f"{letters(5)}.{letters(6)}(at){letters(8)}.org",
        lambda: f"({number(3)}) {number(3)}-{number(4)}",
        lambda: f"{number(3)}-{number(3)}-{number(4)}",
        lambda: f"{number(3)}.{number(3)}.{number(4)}",
        lambda: f"{number(3)}-{number(2)}-{number(4)}",
        lambda: f"{rng.choice(('DE', 'FR', 'ES', 'GB'))}{number(2)} " + " ".join(number(4) for _ in range(4)),
    )
    bad = (
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        lambda: f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1990, 2030)}",
        lambda: f"{rng.randint(1, 28):02d}-{rng.randint(1, 12):02d}-{rng.randint(1990, 2030)}",
        lambda: f"{number(2)}.{number(2)}.{number(2)}",
        lambda: f"{number(3)} {number(3)} {number(3)}",
        lambda: f"978-{number(2)}-{number(4)}-{number(3)}",
        lambda: f"{number(2)} {number(2)} {number(2)} {number(2)}",
        lambda: f"{number(8)}",
        lambda: f"{number(16)}",
        lambda: f"AB{number(2)}{letters(12).upper()}",
    )
    cue = {0: ("write to", "contact", ""), 1: ("call", "tel:", ""), 2: ("ssn", "national id", ""), 3: ("iban", "account", "")}
    out = []
    for label, makers in ((1, good), (0, bad)):
        for make in makers:
            for _ in range(each):
                span = make()
                for _, g, _ in candidates(span)[:1]:
                    lead = rng.choice(cue[g] if label else ("", "on", "version", "order no", "see"))
                    text = f"{letters(5)} {lead} {span} {letters(4)}"
                    start = text.index(span)
                    out += [(text, a, k, b, label) for a, k, b in candidates(text) if a >= start]
    return out


@dataclass
class BoostedTrees:
    """Logistic gradient boosting of depth-limited trees, second-order splits over feature thresholds.

    A tree is complete: node i has children 2i and 2i + 1, the root is 1; what is not split sends everything left. Rows are known by the
    codes of their features, the numbers of thresholds below them.
    """

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    hold: float = 1.0
    least: float = 5
    offset: float = 0.0
    cuts: list[np.ndarray] = member(default_factory=list)
    #: Per tree: feature and threshold of each inner node, and values of the leaves.
    features: list[np.ndarray] = member(default_factory=list)
    limits: list[np.ndarray] = member(default_factory=list)
    leaves: list[np.ndarray] = member(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        weight = np.ones(len(y))
        self.cuts = [thresholds(*np.unique(column, return_counts=True)) for column in x.T]
        codes = self.codes(x)
        return self.learn(y.mean(), lambda tree: self.sums(tree, codes, y, weight))

    def learn(self, share: float, sums) -> BoostedTrees:
        """Trees from ``sums(tree so far)``, see :meth:`sums`; a tree so far has the features and limits of its upper levels."""
        share = min(max(share, 1e-3), 1 - 1e-3)
        self.offset = float(np.log(share / (1 - share)))
        for _ in range(self.rounds):
            feature, limit = np.zeros(1 << self.depth, dtype=np.int64), np.full(1 << self.depth, 255, dtype=np.int64)
            value = np.zeros(2 << self.depth)
            for level in range(self.depth):
                cells = sums((feature[: 1 << level], limit[: 1 << level]))
                for node, own in enumerate(cells, 1 << level):
                    self._split(node, own, feature, limit, value)
            self.features.append(feature)
            self.limits.append(limit)
            self.leaves.append(self.rate * value[1 << self.depth :])
        return self

    def _split(self, node: int, own: np.ndarray, feature: np.ndarray, limit: np.ndarray, value: np.ndarray) -> None:
        """The best split of a node from its sums (slope, bend, weight) by feature and code."""
        worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + self.hold)
        whole = own[0].sum(axis=0)
        left = np.cumsum(own, axis=1)[:, :-1]
        right = whole - left
        gain = worth(left) + worth(right) - worth(whole)
        gain[np.minimum(left[..., 2], right[..., 2]) < self.least] = 0
        best = gain.max(initial=0)
        if best > 1e-6:
            # sums may differ in their last digits from run to run, so nearly equal gains count as equal
            f, c = np.argwhere(gain >= best * (1 - 1e-9))[0]
            feature[node], limit[node] = f, c
            parts = left[f, c], right[f, c]
        else:
            parts = whole, np.zeros(3)
        value[2 * node : 2 * node + 2] = [g / (h + self.hold) for g, h, _ in parts]

    def sums(self, tree: tuple[np.ndarray, np.ndarray], codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Slope, bend and weight by node of the tree's next level, feature and code."""
        feature, limit = tree
        nodes, width = len(feature), max(map(len, self.cuts)) + 1
        node = self._walk(codes, feature[None], limit[None], nodes.bit_length() - 1)[:, 0] - nodes
        p = 1 / (1 + np.exp(-self.total(codes)))
        cell = ((node[:, None] * codes.shape[1] + np.arange(codes.shape[1])) * width + codes).ravel()
        size = nodes * codes.shape[1] * width
        parts = [np.bincount(cell, np.repeat(v, codes.shape[1]), size) for v in (weight * (y - p), weight * p * (1 - p), weight)]
        return np.stack(parts, axis=1).reshape(nodes, codes.shape[1], width, 3)

    @staticmethod
    def _walk(codes: np.ndarray, feature: np.ndarray, limit: np.ndarray, depth: int) -> np.ndarray:
        """Node of each row in each tree after ``depth`` steps."""
        node = np.ones((len(codes), len(feature)), dtype=np.int64)
        rows, trees = np.arange(len(codes))[:, None], np.arange(len(feature))
        for _ in range(depth):
            node = 2 * node + (codes[rows, feature[trees, node]] > limit[trees, node])
        return node

    def total(self, codes: np.ndarray) -> np.ndarray:
        if not self.leaves:
            return np.full(len(codes), self.offset)
        node = self._walk(codes, np.array(self.features), np.array(self.limits), self.depth) - (1 << self.depth)
        return self.offset + np.array(self.leaves)[np.arange(len(self.leaves)), node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.total(self.codes(x))))


def thresholds(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """At most 32 thresholds of a feature, at evenly spaced shares of the weight."""
    order = np.argsort(values)
    upto = np.cumsum(weight[order])
    at = np.searchsorted(upto, np.linspace(0.03, 0.97, 32) * upto[-1])
    return np.unique(values[order][np.minimum(at, len(values) - 1)])


@dataclass
class Selector:
    """Trees and the threshold of each generator."""

    trees: BoostedTrees
    thresholds: list[float]

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """Spans of the shapes, and all spans with the method's; kinds of the method count on from the shapes'."""
        base = base_spans(text)
        taken = Taken((a, b) for a, _, b in base)
        proposed = [c for c in candidates(text) if not taken.overlaps(c[0], c[2])]
        if not proposed:
            return sorted(base), sorted(base)
        chance = self.trees.probability(np.array([features(text, *c) for c in proposed]))
        spans = list(base)
        # nearly equal chances: the later, narrower generator names the span
        for i in sorted(range(len(proposed)), key=lambda i: (-round(chance[i], 2), -proposed[i][1], proposed[i][0])):
            a, g, b = proposed[i]
            if chance[i] >= self.thresholds[g] and not taken.overlaps(a, b):
                taken.add(a, b)
                spans.append((a, len(KINDS) + g, b))
        return sorted(base), sorted(spans)


def calibrated(step: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float = PRECISION) -> float:
    """The smallest threshold from which on the share of positives is at least ``precision``; above one if none is.

    Rows are the positives and weights of each step of the probability.
    """
    order = np.argsort(-step)
    good = np.flatnonzero(np.cumsum(y[order]) >= precision * np.cumsum(weight[order]))
    if not len(good):
        return 1.1
    below = step[order][good[-1] + 1 :]
    return float(max((below[0] + 1) / STEPS if len(below) else 0, 0.5))


def labelled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``fold, row, n``: how often a label and features stand in all documents; a quarter of the ids is the fold."""

    def describe(texts):
        for t in texts:
            t = t or ""
            found = candidates(t)
            # a phone without its country sign looks like a local one; other overlaps with shapes say nothing
            ends = phones(t) if found else []
            starts = [s for s, _ in ends]

            def label(a: int, b: int) -> int:
                i = bisect_right(starts, a)
                return int(i > 0 and b <= ends[i - 1][1])

            yield ([[float(label(a, b)), *features(t, a, g, b)] for a, g, b in found],)

    rows = per_batch(lambda: describe, "rows array<array<double>>")(field(text))["rows"]
    fold = (F.pmod(F.xxhash64(field(key)), F.lit(4)) == 0).alias("fold")
    return docs.select(fold, rows.alias("rows")).select("fold", F.explode("rows").alias("row")).groupBy("fold", "row").agg(
        F.count(F.lit(1)).alias("n")
    )


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Selector:
    """Trees and thresholds from the candidates of all documents and of the drawn examples."""
    spark = docs.sparkSession
    found = stored(labelled(docs, key, text), "candidates")
    share = CORPUS_WEIGHT / max(found.agg(F.sum("n")).first()[0] or 0, CORPUS_WEIGHT)
    # every fourth example of each generator and label belongs to the fold
    drawn, places = [], defaultdict(count)
    for t, a, g, b, label in drawn_examples():
        drawn.append((next(places[g, label]) % 4 == 0, [float(label), *features(t, a, g, b)], 1.0))
    rows = found.select("fold", "row", (F.col("n") * share).alias("w"))
    rows = rows.union(spark.createDataFrame(drawn, "fold boolean, row array<double>, w double"))

    # features are small whole numbers, so all their values are few; the label comes first
    seen = rows.where("NOT fold").select(F.posexplode("row").alias("at", "value"), "w").groupBy("at", "value").agg(F.sum("w"))
    counts = np.array(sorted(tuple(r) for r in seen.collect()))
    label, *by_feature = [counts[counts[:, 0] == at, 1:] for at in range(int(counts[:, 0].max()) + 1)]
    trees = BoostedTrees(cuts=[thresholds(c[:, 0], c[:, 1]) for c in by_feature])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["row"].to_list()) if len(b) else np.zeros((0, 1 + len(by_feature)))
            out = pd.DataFrame({"fold": b["fold"], "y": x[:, 0], "g": x[:, 1].astype(np.int32), "w": b["w"]})
            yield out.assign(codes=[c.tobytes() for c in trees.codes(x[:, 1:])])

    coded = rows.mapInPandas(encode, "fold boolean, y double, g int, w double, codes binary")
    coded = stored(coded.groupBy("fold", "y", "g", "codes").agg(F.sum("w").alias("w")), "coded-candidates")

    def pooled(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        pool: list[pd.DataFrame] = []

        def joined() -> tuple[pd.DataFrame, np.ndarray]:
            whole = pd.concat(pool)
            return whole, np.frombuffer(b"".join(whole["codes"]), dtype=np.uint8).reshape(len(whole), -1)

        for b in batches:
            pool.append(b)
            if sum(map(len, pool)) >= POOL_ROWS:
                yield joined()
                pool = []
        if sum(map(len, pool)):
            yield joined()

    learnt = coded.where("NOT fold").select("y", "w", "codes")

    def sums(tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [trees.sums(tree, codes, b["y"].to_numpy(), b["w"].to_numpy()) for b, codes in pooled(batches)]
            if parts:
                yield pd.DataFrame({"sums": [np.sum(parts, axis=0).tobytes()]})

        # a row per task, of at most 8 bytes for each node, feature, code and sum; tasks are as many as the coded rows' files need
        found = [np.frombuffer(r.sums) for r in learnt.mapInPandas(run, "sums binary").collect()]
        return np.sum(found, axis=0).reshape(len(tree[0]), len(by_feature), -1, 3)

    trees.learn(float(label[:, 0] @ label[:, 1] / label[:, 1].sum()), sums)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, codes in pooled(batches):
            step = np.floor(STEPS / (1 + np.exp(-trees.total(codes)))).astype(np.int64)
            yield pd.DataFrame({"g": b["g"], "step": step, "y": b["y"] * b["w"], "w": b["w"]})

    judged = coded.where("fold").mapInPandas(judge, "g int, step long, y double, w double")
    held = judged.groupBy("g", "step").agg(F.sum("y"), F.sum("w")).collect()  # a row per kind and step at most
    held = np.array(sorted(tuple(r) for r in held)).reshape(-1, 4)
    kinds = [held[held[:, 0] == g] for g in range(len(GENERATORS))]
    return Selector(trees, [calibrated(*k[:, 1:].T) for k in kinds])


def named(spans: list[tuple[int, int, int]]) -> str:
    kinds = KINDS + ADDED
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, selector: Selector, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the shapes, digest of their spans, and all spans of each document."""

    def find(texts):
        for t in texts:
            base, every = selector.spans(t or "")
            counts = [sum(k == i for _, k, _ in base) for i in range(len(KINDS))]
            yield *counts, hashlib.sha256(named(base).encode()).hexdigest(), named(every)

    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return scored(docs, per_batch(lambda: find, fields), key, text)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each stretch of touching spans replaced by the name of its first kind."""
    out, at, upto = [], 0, -1
    for a, k, b in sorted(spans):
        if a > upto:
            out += [text[at:a], f"[{(KINDS + ADDED)[k].upper()}]"]
        at = upto = max(upto, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, selector: Selector, text: str = "text") -> DataFrame:
    """The documents with personal data replaced by its kind; a null text stays null."""

    def make(texts):
        return ((None if t is None else redact(t, selector.spans(t)[1]),) for t in texts)

    new = per_batch(lambda: make, "text string")(field(text))["text"]
    return docs.select(*[new.alias(c) if c == text else field(c) for c in docs.columns])
