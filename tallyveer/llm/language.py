"""Log-likelihood of whole texts under a gated recurrent language model.

Word counts cover all training documents. The output softmax is factored: a small recurrent network predicts the class of the next
token from everything before it, and within a class a token has its smoothed share of the corpus counts,
``(c + 1) / (N_class + V_class + 1)``, one slot being left for what was never seen. Frequent words get their classes from the company they keep
in all training documents, all others by their last two bytes, so every token has a class and a probability.

Texts are split twice: once to count words, once to be encoded. The encoding (numbers of frequent words, suffix groups of all others, and
the others themselves for their counts) is a stored table, from which the network learns and scores.

The network (numpy, truncated backpropagation) is warmed up on a bounded sample and then trained by every training document
once: each task starts from the same weights, carries the state of its streams from window to window, and the weights of all
tasks are averaged by tokens. Scoring runs each document from its first to its last token with its state carried
along, whatever its length.

Counts of frequent words travel with the tasks: a word with at least one in ``HEAD_SHARE`` training tokens, of which there are at most
``HEAD_SHARE`` (and the end token). All other words are joined with the table of counts; none of them is common, so no key is hot. Nothing
else grows with the corpus outside Spark's own tables.

Defined results: a null or blank text is its end token alone; a document without id is never held out; repeated rows are learnt from and scored
each; without training documents the counts are zero, the network stays untrained, and scores follow the smoothing alone.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveer.llm.common import field, held_out, stored

FOLDS, HELD = 7, 2
#: A word is frequent from one in this many training tokens on.
HEAD_SHARE = 1 << 18
#: Frequent words with a class of their own choosing, and those that are inputs of their own.
CHOSEN_WORDS, INPUT_WORDS = 4096, 1024
SUFFIX_GROUPS = 512
CLASSES = 48
STATE = 16
#: Streams and steps of one truncated backpropagation.
STREAMS, WINDOW = 512, 16
#: Tokens whose softmax is taken together in scoring.
SOFTMAX_TOKENS = 1 << 14
#: Documents of the warm-up sample, and tokens of the window that each of them gives.
SAMPLE_DOCUMENTS, SAMPLE_TOKENS = 2000, 4096
WARM_PASSES = 6
WARM_RATE, RATE = 0.01, 0.002
#: Distinct words that a counting task holds, and tokens that a scoring task takes together.
HELD_WORDS, POOL_TOKENS = 400_000, 1 << 21
#: Frequent words that describe their neighbours, units that are described (chosen words and suffix groups), neighbour counts that place one.
CONTEXTS, UNITS, LEAST_SEEN = 128, CHOSEN_WORDS + SUFFIX_GROUPS, 5
END = b""  # no word is empty
#: Number of an end token that no training document has.
UNKNOWN_END = -1 - SUFFIX_GROUPS


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


def suffix_group(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIX_GROUPS


def suffix_column(word: Column) -> Column:
    """``suffix_group`` of a binary column."""
    return (F.crc32(F.substring(word, -2, 2)) % SUFFIX_GROUPS).cast("int")


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """``word, n`` over all documents, the end token included."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for rows in batches:
            for t in rows["t"]:
                counts.update(words_of(t))
            counts[END] += len(rows)
            if len(counts) >= HELD_WORDS:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts = Counter()
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})

    counted = docs.select(field(text).alias("t")).mapInPandas(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class Network:
    """Gated recurrent units over token inputs, with a softmax over classes.

    Gates (update and reset) and the new state have arrays of their own, so every operation runs over whole rows.
    """

    names = ("input_gates", "input_new", "state_gates", "state_new", "output", "bias")

    def __init__(self, n_inputs: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.n_inputs = n_inputs
        self.input_gates, self.input_new = small(n_inputs, 2 * STATE), small(n_inputs, STATE)
        self.state_gates, self.state_new = small(STATE, 2 * STATE), small(STATE, STATE)
        self.output, self.bias = small(STATE, CLASSES), np.zeros(CLASSES, dtype=np.float32)

    def weights(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.names])

    def load(self, weights: np.ndarray) -> Network:
        at = 0
        for n in self.names:
            old = getattr(self, n)
            setattr(self, n, weights[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def step(self, gates: np.ndarray, new: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Next state from the inputs' parts (which are overwritten), and what its gradient needs."""
        gates += h @ self.state_gates
        gates *= 0.5
        np.tanh(gates, out=gates)  # half of it plus one half is the logistic curve
        gates *= 0.5
        gates += 0.5
        inner = h @ self.state_new
        new += gates[:, STATE:] * inner
        np.tanh(new, out=new)
        after = h - new
        after *= gates[:, :STATE]
        after += new
        return after, inner

    def exponentials(self, states: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled probabilities of all classes, their sums, and the logits of the goals on the same scale.

        States lie within one, so the weights bound the logits; only large weights need the row's maximum taken off.
        """
        logits = states @ self.output
        logits += self.bias
        if np.abs(self.bias).max() + np.abs(self.output).sum(axis=0).max() > 60:
            logits -= logits.max(axis=1, keepdims=True)
        right = logits[np.arange(len(goal)), goal]
        np.exp(logits, out=logits)
        return logits, logits.sum(axis=1), right

    def gradients(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, h: np.ndarray) -> tuple[list, np.ndarray, float]:
        """Truncated backpropagation through one window (steps by streams); ``first`` marks starts of documents."""
        steps, streams = x.shape
        ids, goal, keep = x.ravel(), y.ravel(), (~first).astype(h.dtype)[:, :, None]
        gates = self.input_gates[ids].reshape(steps, streams, -1)
        new = self.input_new[ids].reshape(steps, streams, -1)
        past, inner, after = np.empty_like(new), np.empty_like(new), np.empty_like(new)
        for t in range(steps):
            h = past[t] = h * keep[t]
            h, inner[t] = self.step(gates[t], new[t], h)
            after[t] = h
        states = after.reshape(-1, STATE)
        error, sums, right = self.exponentials(states, goal)
        loss = float(np.log(sums).sum() - right.sum())
        error /= sums[:, None]
        error[np.arange(len(goal)), goal] -= 1
        error /= len(goal)
        into = (error @ self.output.T).reshape(new.shape)
        # what each step's gradient is multiplied by does not depend on later steps
        z, r = gates[:, :, :STATE], gates[:, :, STATE:]
        by_new = (1 - z) * (1 - new * new)
        by_update = (past - new) * (z * (1 - z))
        by_reset = inner * (r * (1 - r))
        d_gates, d_new, d_inner = np.empty_like(gates), np.empty_like(new), np.empty_like(new)
        back_gates, back_new, dh = self.state_gates.T.copy(), self.state_new.T.copy(), np.zeros_like(h)
        for t in reversed(range(steps)):
            dh += into[t]
            np.multiply(dh, by_new[t], out=d_new[t])
            np.multiply(dh, by_update[t], out=d_gates[t, :, :STATE])
            np.multiply(d_new[t], by_reset[t], out=d_gates[t, :, STATE:])
            np.multiply(d_new[t], r[t], out=d_inner[t])
            dh *= z[t]
            dh += d_gates[t] @ back_gates
            dh += d_inner[t] @ back_new
            dh *= keep[t]
        before = past.reshape(-1, STATE).T
        d_gates, d_new = d_gates.reshape(len(ids), -1), d_new.reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        start = np.flatnonzero(np.diff(ids[order], prepend=-1))
        d_inputs = []
        for rows, weights in ((d_gates, self.input_gates), (d_new, self.input_new)):
            d = np.zeros_like(weights)
            d[ids[order][start]] = np.add.reduceat(rows[order], start, axis=0)
            d_inputs.append(d)
        parts = [*d_inputs, before @ d_gates, before @ d_inner.reshape(len(ids), -1), states.T @ error, error.sum(axis=0)]
        return parts, h, loss

    def fit(self, documents: list[tuple[np.ndarray, np.ndarray]], rate: float, moments: dict) -> float:
        """One pass over (inputs, classes) of documents laid out in parallel streams; mean loss of a token."""
        x = np.concatenate([d[0] for d in documents])
        y = np.concatenate([d[1] for d in documents])
        first = np.zeros(len(x), dtype=bool)
        first[np.cumsum([0, *(len(d[0]) for d in documents[:-1])])] = True
        streams = max(1, min(STREAMS, len(x) // WINDOW))
        length = -(-len(x) // streams)
        # the last stream is filled up from the beginning
        x, y, first = (
            np.ascontiguousarray(np.resize(v, streams * length).reshape(streams, length).T) for v in (x, y, first)
        )
        h, total = np.zeros((streams, STATE), dtype=np.float32), 0.0
        for i in range(0, length, WINDOW):
            parts, h, loss = self.gradients(x[i : i + WINDOW], y[i : i + WINDOW], first[i : i + WINDOW], h)
            total += loss
            self._adjust(parts, rate, moments)
        return total / x.size

    def _adjust(self, parts: list, rate: float, moments: dict) -> None:
        """Adam."""
        n = moments["n"] = moments.get("n", 0) + 1
        scale = rate * math.sqrt(1 - 0.999**n) / (1 - 0.9**n)
        for name, g in zip(self.names, parts, strict=True):
            m, v = moments.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            getattr(self, name)[...] -= scale * m / (np.sqrt(v) + 1e-8)

    def log_likelihoods(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Natural log-probability of each document's classes; states run through whole documents."""
        if not documents:
            return np.zeros(0)
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i][0]))
        lengths = np.array([len(documents[i][0]) for i in order])
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        # documents longer than each step; they come first
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left").tolist()
        x = np.concatenate([documents[i][0] for i in order])
        y = np.concatenate([documents[i][1] for i in order])
        total, h = np.zeros(len(order)), np.zeros((len(order), STATE), dtype=np.float32)
        states, goals = [], []

        def settle() -> None:
            """Windows bound the memory of the softmax, not the state."""
            _, sums, right = self.exponentials(np.concatenate(states), np.concatenate(goals))
            right -= np.log(sums)
            at = 0
            for g in goals:
                total[: len(g)] += right[at : at + len(g)]
                at += len(g)
            states.clear()
            goals.clear()

        waiting = 0
        for t, n in enumerate(active):
            places = starts[:n] + t
            ids = x[places]
            h = self.step(self.input_gates[ids], self.input_new[ids], h[:n])[0]
            states.append(h)
            goals.append(y[places])
            waiting += n
            if waiting >= SOFTMAX_TOKENS:
                settle()
                waiting = 0
        settle()
        out = np.zeros(len(order))
        out[order] = total
        return out


@dataclass
class Vocabulary:
    """Frequent words and the classes of all words.

    Inputs of the network: the first words by count, then the classes, then the start of a document.
    """

    index: dict[bytes, int]
    counts: np.ndarray
    chosen_class: np.ndarray
    group_class: np.ndarray
    log_total: np.ndarray | None = None  # log10(N_class + V_class + 1)

    @property
    def start(self) -> int:
        return INPUT_WORDS + CLASSES

    def __post_init__(self):
        self.log_count = np.log10(self.counts + 1.0)
        self.classes = np.array([self._class(w, i) for w, i in self.index.items()], dtype=np.int16)

    def _class(self, word: bytes, i: int) -> int:
        if word == END:
            return CLASSES - 1
        c = self.chosen_class[i] if i < len(self.chosen_class) else -1
        return int(c if c >= 0 else self.group_class[suffix_group(word)])

    def network_input(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Network inputs and classes of an encoded document, see :func:`encoded`."""
        classes = self.group_class[np.clip(-1 - numbers, 0, SUFFIX_GROUPS - 1)]
        known = numbers >= 0
        classes[known] = self.classes[numbers[known]]
        classes[numbers == UNKNOWN_END] = CLASSES - 1
        classes = classes.astype(np.int16)
        inputs = np.empty(len(numbers), dtype=np.int16)
        own = numbers[:-1]
        inputs[0] = self.start
        inputs[1:] = np.where((own >= 0) & (own < INPUT_WORDS), own, INPUT_WORDS + classes[:-1])
        return inputs, classes


class Endings(dict):
    """Number of the words that end in these two bytes and are not frequent: ``-1 - suffix group``."""

    def __missing__(self, ending: bytes) -> int:
        self[ending] = found = -1 - suffix_group(ending)
        return found


#: Columns of the table of encoded documents, and of the neighbour counts that lie in it, a row of them per task.
ENCODED = "row long, id string, learnt boolean, numbers array<int>, words binary, cells array<int>, cell_counts array<long>"


def encoded(docs: DataFrame, key: str, text: str, index: dict[bytes, int]) -> DataFrame:
    """Encoded documents, and how often each frequent word stands before and after each unit in those that are learnt from.

    ``numbers`` has a number per token, the end token last (``UNKNOWN_END`` where it was never counted); ``words`` are the words that are not
    frequent, parted by blanks. A task holds one table of ``UNITS`` rows for the neighbours and hands on its cells that are not zero, in a row
    without document.
    """
    end = index.get(END, UNKNOWN_END)
    unit_of = np.arange(len(index) + SUFFIX_GROUPS)  # of a number; numbers below zero count from the end
    unit_of[CHOSEN_WORDS : len(index)] = [CHOSEN_WORDS + suffix_group(w) for w, i in index.items() if i >= CHOSEN_WORDS]
    unit_of[len(index) :] = CHOSEN_WORDS + np.arange(SUFFIX_GROUPS)[::-1]
    width = 2 * CONTEXTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        endings, table, pool, waiting = Endings(), np.zeros(UNITS * width, dtype=np.int64), [], 0
        for rows in batches:
            numbers, words = [], []
            for t, learnt in zip(rows["t"], rows["learnt"], strict=True):
                own = words_of(t)
                found = np.fromiter(map(index.get, own, repeat(-1)), dtype=np.int32, count=len(own))
                at = np.flatnonzero(found < 0)
                rare = [own[i] for i in at.tolist()]
                found[at] = [endings[w[-2:]] for w in rare]
                numbers.append(np.append(found, np.int32(end)))
                words.append(b" ".join(rare))
                if learnt:
                    pool.append(numbers[-1])
                    waiting += len(found)
            if waiting >= POOL_TOKENS // 4:
                add(table, pool)
                pool, waiting = [], 0
            out = rows[["row", "id", "learnt"]].assign(numbers=numbers, words=words)
            yield out.assign(cells=None, cell_counts=None)
        if pool:
            add(table, pool)
        cells = np.flatnonzero(table)
        if len(cells):
            yield pd.DataFrame(
                {"row": [-1], "id": [None], "learnt": [False], "numbers": [None], "words": [None],
                 "cells": [cells.astype(np.int32)], "cell_counts": [table[cells]]}
            )

    def add(table: np.ndarray, pool: list[np.ndarray]) -> None:
        numbers = np.concatenate(pool)
        inner = numbers != end  # no word is next to those of another document
        units = unit_of[np.where(inner, numbers, 0)]
        for a, b, shift in ((slice(1, None), slice(None, -1), 0), (slice(None, -1), slice(1, None), CONTEXTS)):
            near = np.flatnonzero(inner[a] & inner[b] & (numbers[b] >= 0) & (numbers[b] < CONTEXTS))
            table += np.bincount(units[a][near] * width + numbers[b][near] + shift, minlength=len(table))

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        field(key).cast("string").alias("id"),
        (~held_out(field(key), FOLDS, HELD)).alias("learnt"),
        field(text).alias("t"),
    )
    return stored(rows.mapInPandas(run, ENCODED), "encoded-documents")


def neighbours(table: DataFrame) -> np.ndarray:
    """The neighbour counts of all tasks, units by contexts."""
    pairs = table.where("row < 0").select(F.explode(F.arrays_zip("cells", "cell_counts")).alias("p"))
    found = pairs.groupBy("p.cells").agg(F.sum("p.cell_counts").alias("n")).toPandas()  # at most UNITS * 2 * CONTEXTS rows
    counts = np.zeros(UNITS * 2 * CONTEXTS)
    counts[found["cells"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.float64)
    return counts.reshape(UNITS, 2 * CONTEXTS)


def classes_of(table: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the chosen words (-1: too rare) and of the suffix groups, by their neighbours: spherical k-means."""
    seen = table.sum(axis=1)
    known = np.flatnonzero(seen >= LEAST_SEEN)
    labels = np.full(UNITS, -1)
    k = min(CLASSES - 1, len(known))
    if k:
        rows = np.sqrt(table[known] / seen[known, None])
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        rng = np.random.default_rng(seed)
        centres = rows[rng.choice(len(known), k, replace=False, p=seen[known] / seen[known].sum())]
        for _ in range(15):
            own = np.argmax(rows @ centres.T, axis=1)
            for c in range(k):
                if (own == c).any():
                    centres[c] = (rows[own == c] * np.sqrt(seen[known][own == c])[:, None]).sum(axis=0)
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        labels[known] = own
    groups = labels[CHOSEN_WORDS:]
    return labels[:CHOSEN_WORDS], np.where(groups < 0, np.arange(SUFFIX_GROUPS) % (CLASSES - 1), groups)


@dataclass
class Model:
    """What scoring needs: the vocabulary and network travel with the tasks, the counts stay a table.

    ``documents`` are the encoded documents that it was trained from, held-out ones included.
    """

    counts: DataFrame
    documents: DataFrame
    tokens: int
    kinds: int
    vocabulary: Vocabulary
    network: Network


def train(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Count all training documents, choose classes, warm up on the sample, train on all training documents."""
    learnt = docs.where(~held_out(field(key), FOLDS, HELD))
    counts = stored(count_words(learnt, text), "word-counts")
    tokens, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    common = (F.col("n") * HEAD_SHARE >= tokens) | (F.length("word") == 0)  # the end token always
    frequent = counts.where(common).collect()  # at most HEAD_SHARE + 1 rows
    head = sorted(((-r.n, bytes(r.word)) for r in frequent))
    index = {w: i for i, (_, w) in enumerate(head)}

    table = encoded(docs, key, text, index)
    documents = table.where("row >= 0").drop("cells", "cell_counts")
    chosen_class, group_class = classes_of(neighbours(table))
    vocabulary = Vocabulary(index, np.array([-n for n, _ in head], dtype=np.float64), chosen_class, group_class)
    vocabulary.log_total = class_totals(counts, vocabulary)

    network = Network(INPUT_WORDS + CLASSES + 1)
    shares = 10.0 ** vocabulary.log_total
    network.bias[:] = np.log(shares / shares.sum())
    warm, moments = [vocabulary.network_input(numbers) for numbers in sample(documents)], {}
    for i in range(WARM_PASSES if warm else 0):
        network.fit(warm, WARM_RATE * (1 - i / (WARM_PASSES + 1)), moments)
    network = averaged(documents, vocabulary, network)
    return Model(counts, documents, int(tokens), int(kinds), vocabulary, network)


def sample(documents: DataFrame) -> list[np.ndarray]:
    """Numbers of ``SAMPLE_DOCUMENTS`` learnt documents, in a fixed order; of a longer one a window at a place fixed by its id."""
    room = F.greatest(F.size("numbers") - SAMPLE_TOKENS, F.lit(0)) + 1
    window = F.slice("numbers", (F.pmod(F.xxhash64("id"), room) + 1).cast("int"), F.lit(SAMPLE_TOKENS))
    rows = documents.where("learnt").select(F.xxhash64(F.lit("warm-up"), "id").alias("o"), window.alias("numbers"))
    # the places first: tasks hand on as many numbers as there are documents to choose, not as many windows
    last = rows.select("o").orderBy("o").limit(SAMPLE_DOCUMENTS).agg(F.max("o")).first()[0]
    if last is None:
        return []
    # ids that occur often could be more
    chosen = rows.where(F.col("o") <= last).limit(SAMPLE_DOCUMENTS).collect()
    return [np.array(r.numbers, dtype=np.int64) for r in sorted(chosen, key=lambda r: (r.o, r.numbers))]


def class_totals(counts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """log10(N_class + V_class + 1) over all counted words."""
    totals = np.ones(CLASSES)
    by_group = counts.where(F.length("word") > 0).groupBy(suffix_column(F.col("word")).alias("g"))
    for g, n, kinds in by_group.agg(F.sum("n"), F.count(F.lit(1))).collect():  # at most SUFFIX_GROUPS rows
        totals[vocabulary.group_class[g]] += n + kinds
    for word, i in vocabulary.index.items():
        n, c = vocabulary.counts[i] + 1, vocabulary.classes[i]
        if word != END:
            totals[vocabulary.group_class[suffix_group(word)]] -= n
        totals[c] += n
    return np.log10(totals)


def averaged(documents: DataFrame, vocabulary: Vocabulary, network: Network) -> Network:
    """Every learnt document once, in each task from the same weights; the mean of the tasks' weights by tokens."""
    before = network.weights()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, moments, pool, waiting, done = Network(network.n_inputs).load(before), {}, [], 0, 0
        for rows in batches:
            for numbers in rows["numbers"]:
                pool.append(vocabulary.network_input(numbers))
                waiting += len(numbers)
            if waiting >= POOL_TOKENS:
                own.fit(pool, RATE, moments)
                pool, waiting, done = [], 0, done + waiting
        if pool:
            own.fit(pool, RATE, moments)
            done += waiting
        if done:
            yield pd.DataFrame({"tokens": [done], "weights": [own.weights().astype(np.float64) * done]})

    learnt = documents.where("learnt").select("numbers").mapInPandas(run, "tokens long, weights array<double>")
    single = learnt.select("tokens", F.posexplode("weights").alias("at", "w"))
    # one row per weight, whatever the number of tasks
    sums = single.groupBy("at").agg(F.sum("w").alias("w"), F.sum("tokens").alias("n")).collect()
    if not sums:
        return network
    mean = np.zeros(len(before))
    for at, w, n in sums:
        mean[at] = w / n
    return Network(network.n_inputs).load(mean)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of tokens, the base score and the model's log10 probability of each whole document."""
    table = encoded(docs, key, text, model.vocabulary.index)
    return scored_documents(table.where("row >= 0"), model, key, docs.schema[key].dataType.simpleString())


def score_own(model: Model, key: str, kind: str) -> DataFrame:
    """As :func:`score` for the documents that the model was trained from, which are encoded already."""
    return scored_documents(model.documents, model, key, kind)


def scored_documents(documents: DataFrame, model: Model, key: str, kind: str) -> DataFrame:
    vocabulary, network = model.vocabulary, model.network

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, waiting = [], 0
        for rows in batches:
            for row, key_text, numbers in zip(rows["row"], rows["id"], rows["numbers"], strict=True):
                inputs, classes = vocabulary.network_input(numbers)
                known = numbers[numbers >= 0]
                fixed = vocabulary.log_count[known].sum() if len(known) else 0.0
                share = -vocabulary.log_total[classes].sum()
                pool.append((row, key_text, len(numbers), len(known), fixed, share, inputs, classes))
                waiting += len(numbers)
            if waiting >= POOL_TOKENS:
                yield finished(pool)
                pool, waiting = [], 0
        if pool:
            yield finished(pool)

    def finished(pool: list[tuple]) -> pd.DataFrame:
        logs = network.log_likelihoods([p[-2:] for p in pool]) / math.log(10)
        out = pd.DataFrame([p[:6] for p in pool], columns=["row", "id", "n_tokens", "known", "fixed", "share"])
        out["share"] += logs
        return out

    schema = "row long, id string, n_tokens long, known long, fixed double, share double"
    rows = documents.select("row", "id", "numbers").mapInPandas(run, schema)
    words = F.explode(F.split(F.col("words").cast("string"), " ")).alias("word")
    pairs = documents.where(F.length("words") > 0).select("row", words).withColumn("word", F.col("word").cast("binary"))
    joined = pairs.join(model.counts, "word")  # a word without count adds log10(1) to both scores
    rare = joined.groupBy("row").agg(
        F.sum(F.log10(F.col("n") + 1.0)).alias("rare"), F.count(F.lit(1)).alias("rare_known")
    )
    total = F.col("fixed") + F.coalesce("rare", F.lit(0.0))
    spread = math.log10(model.tokens + model.kinds + 1)
    out = rows.join(rare, "row", "left").withColumn("key", F.col("id").cast(kind))
    return out.select(
        F.col("key").alias(key),
        held_out(F.col("key"), FOLDS, HELD).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (total - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        (total + F.col("share")).alias("score"),
    )
