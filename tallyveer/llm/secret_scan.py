"""Secrets in texts: fixed shapes, and strings that a Markov model of random strings explains better than one of names.

Two character Markov models of the first order, one of random strings and one of ordinary identifiers, are trained from
labelled samples: random are the values that the fixed shapes find in a bounded sample of documents and drawn strings of
usual alphabets, ordinary are the other words of that sample, names composed of them
and lines drawn with one sign. A candidate (an unbroken run of token characters) is a secret if
its log-likelihood ratio exceeds the log of the odds against a random string.

Defined results: a null text counts as empty and has no spans; what the shapes take of a candidate is cut out of it, and every
rest of ``LEAST_LENGTH`` characters or more is scored by itself; equal starts are ordered by kind; repeated rows are scanned alike; a corpus without labelled words still trains on
the drawn strings, with an even model of ordinary names. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveer.llm.common import Taken, field, per_text, sample_order, scored

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run that fails holds no longer match further on
HEX = re.compile(r"[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
#: Characters that a span of the method has at least.
LEAST_LENGTH = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}")

#: Symbols of the models: token characters, then the border of a string.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
BORDER = len(SYMBOLS)
SIZE = BORDER + 1
CODE = {c: i for i, c in enumerate(SYMBOLS)}
BYTE_CODES = np.array([CODE.get(chr(b), BORDER) for b in range(256)])

#: Documents that the models are trained from, at most.
SAMPLE_DOCUMENTS = 20_000
#: Odds against a candidate being random, before it is read.
ODDS_AGAINST = 1e6


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed shapes, leftmost and not overlapping within a kind."""
    found = []
    if "=" in text or ":" in text:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def transitions(words: Iterable[str]) -> np.ndarray:
    """Counts of symbol pairs, borders included."""
    line = "\n".join(["", *words, ""]).encode("ascii", "replace")
    codes = BYTE_CODES[np.frombuffer(line, dtype=np.uint8)]
    return np.bincount(codes[:-1] * SIZE + codes[1:], minlength=SIZE * SIZE)


def drawn_strings(seed: int = 7, each: int = 200, length: int = 32) -> list[str]:
    """Labelled random strings over usual alphabets, the same in every run."""
    rng, letters = random.Random(seed), SYMBOLS[:62]
    alphabets = (letters, SYMBOLS[:64], SYMBOLS[26:62], SYMBOLS[:26] + SYMBOLS[52:62], SYMBOLS[52:62] + "abcdef")
    return ["".join(rng.choice(a) for _ in range(length)) for a in alphabets for _ in range(each)]


class MarkovPair:
    """Log-likelihood ratio of two transition models, add-one smoothed."""

    def __init__(self, random_counts: np.ndarray, ordinary_counts: np.ndarray):
        def logs(counts: np.ndarray) -> np.ndarray:
            table = counts.reshape(SIZE, SIZE).astype(float) + 1.0
            return np.log(table / table.sum(axis=1, keepdims=True))

        self.table = (logs(random_counts) - logs(ordinary_counts)).tolist()

    def ratio(self, word: str) -> float:
        last, total = BORDER, 0.0
        for c in word:
            now = CODE.get(c, BORDER)
            total += self.table[last][now]
            last = now
        return total + self.table[last][BORDER]


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SAMPLE_DOCUMENTS) -> MarkovPair:
    """Models from the ``limit`` documents that come first by the hash of their id.

    Counting runs on the executors; the driver gets two tables of symbol pairs, whose size is fixed.
    """
    order = sample_order(field(key))
    last = docs.select(order.alias("o")).orderBy("o").limit(limit).agg(F.max("o")).first()[0]
    chosen = docs.where(order <= last) if last is not None else docs.limit(0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            secret, ordinary = [], []
            for t in rows["t"]:
                for found, into in zip(labelled(t), (secret, ordinary), strict=True):
                    into.extend(found)
            counts = np.concatenate([transitions(secret), transitions(ordinary)])
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"pair": at, "n": counts[at]})

    rows = chosen.select(F.coalesce(field(text), F.lit("")).alias("t")).mapInPandas(count, "pair long, n long")
    counts = np.zeros(2 * SIZE * SIZE, dtype=np.int64)
    for pair, n in rows.groupBy("pair").agg(F.sum("n")).collect():  # at most 2 * SIZE * SIZE rows
        counts[pair] = n
    ordinary = counts[SIZE * SIZE :] + transitions(rules())
    return MarkovPair(counts[: SIZE * SIZE] + transitions(drawn_strings()), ordinary)


def rules(each: int = 20) -> list[str]:
    """Labelled ordinary strings: lines drawn with one sign."""
    return [c * n for c in SYMBOLS[62:] for n in (16, 32, 64)] * each


def labelled(text: str) -> tuple[list[str], list[str]]:
    """The values that the shapes find, and the other token-like words."""
    spans = sorted(base_spans(text))
    secret = [ASSIGN.match(text, a, b)[2] if k == 0 else text[a:b] for a, k, b in spans]
    rest, at = [], 0
    for a, _, b in spans:
        rest.append(text[at : max(a, at)])
        at = max(at, b)
    rest.append(text[at:])
    words = [w for part in rest for w in IDENTIFIER.findall(part)]
    return secret, words + compounds(words)


def compounds(words: list[str]) -> list[str]:
    """Names as programs and paths write them, of neighbouring words in turn."""
    styles = (
        "_".join,
        "-".join,
        "/".join,
        lambda w: "".join(x.capitalize() for x in w),
        lambda w: w[0].lower() + "".join(x.capitalize() for x in w[1:]),
    )
    return [styles[i % len(styles)](words[i : i + 3]) for i in range(0, len(words) - 2, 2)]


def find(text: str, model: MarkovPair, threshold: float = math.log(ODDS_AGAINST)) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind, end), by start and kind."""
    if max(map(len, text.split()), default=0) < 16 and "=" not in text and ":" not in text:
        return []  # every shape but an assignment is a run of 16 characters or more
    spans = base_spans(text)
    known = Taken((a, b) for a, _, b in spans)
    for m in CANDIDATE.finditer(text):
        for a, b in known.free(*m.span()):
            if b - a >= LEAST_LENGTH and model.ratio(text[a:b]) > threshold:
                spans.append((a, 3, b))
    return sorted(spans)


def named(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with each stretch of touching spans replaced by ``mark``."""
    out, at, upto = [], 0, -1
    for a, _, b in sorted(spans):
        if a > upto:
            out += [text[at:a], mark]
        at = upto = max(upto, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, model: MarkovPair, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the shapes, digest of their spans, and all spans of each document."""

    def make():
        def one(t: str):
            spans = find(t, model)
            base = [s for s in spans if s[1] < 3]
            counts = [sum(k == i for _, k, _ in base) for i in range(3)]
            return *counts, hashlib.sha256(named(base).encode()).hexdigest(), named(spans)

        return one

    return scored(
        docs, per_text(make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"), key, text
    )


def redacted(docs: DataFrame, model: MarkovPair, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents with secrets replaced; a column ``length`` follows the new text. A null text stays null."""

    def make():
        return lambda t: (redact(t, spans) if (spans := find(t, model)) else None,)

    temporary = "secret scan result"
    out = docs.withColumn(temporary, per_text(make, "text string")(field(text)))
    new = field(temporary)["text"]
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.coalesce(new, field(c)).alias(c))
        elif c == length:
            kind = docs.schema[c].dataType
            columns.append(F.when(new.isNull(), field(c)).otherwise(F.length(new).cast(kind)).alias(c))
        else:
            columns.append(field(c))
    return out.select(*columns)
