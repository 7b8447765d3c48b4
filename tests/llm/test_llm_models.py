"""Language model and toxicity scores."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyveer.llm import language, toxicity


def plain_base(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t in rows]
    counts = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (str(i), h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 5))
        for (i, _), h, ws in zip(rows, held, tokens, strict=True)
    )


def scored_rows(docs, monkeypatch, share=None):
    if share:  # as if most words were rare, so that they go through the join
        monkeypatch.setattr(language, "HEAD_SHARE", share)
    rows = language.score(docs, language.train(docs)).collect()
    base = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows)
    return rows, base


@pytest.mark.parametrize("share", [None, 40])
def test_base_score_on_edges(edges, monkeypatch, share):
    rows, base = scored_rows(edges, monkeypatch, share)
    assert base == plain_base([tuple(r) for r in edges.select("doc_id", "text").collect()])
    assert all(r.score < 0 and np.isfinite(r.score) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 5}) == 1


def test_table_scores_and_gain_over_counts(sample, monkeypatch):
    rows, base = scored_rows(sample, monkeypatch, 500)
    assert base == plain_base([tuple(r) for r in sample.select("doc_id", "text").collect()])
    held = [r for r in rows if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.1


def test_no_documents_and_no_training_documents(nothing, make_docs):
    assert language.score(nothing, language.train(nothing)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = make_docs([(held, "all alone here")])
    row = language.score(docs, language.train(docs)).first()
    assert row.held_out and row.train_tokens == row.n_known == 0 and row.base_score == 0.0 and row.score < 0


def test_neighbours_of_all_training_documents_are_counted(make_docs, monkeypatch):
    """Also of documents that the warm-up sample leaves out, and of long ones; not of held-out ones."""
    rng = random.Random(3)
    vocabulary = [f"w{i:02d}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=n)) for n in (5, 9, 3000, 1, 0, 400, 70, 12)] + [None, "w01 w02 rarely w01"]
    held = [i for i in range(100, 300) if zlib.crc32(str(i).encode()) % 7 == 2]
    learnt = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [*zip(learnt, texts, strict=False), (held[0], "w01 w02 w03"), (None, "w05 w06")]
    texts.append("w05 w06")
    docs = make_docs(rows).repartition(3)
    index = {w.encode(): i for i, w in enumerate(vocabulary)} | {language.END: 60}
    want = np.zeros((language.UNITS, 2 * language.CONTEXTS))
    unit = lambda w: index.get(w, language.CHOSEN_WORDS + language.suffix_group(w))
    for words in map(language.words_of, texts):
        for a, b in zip(words, words[1:], strict=False):
            if a in index:
                want[unit(b), index[a]] += 1
            if b in index:
                want[unit(a), language.CONTEXTS + index[b]] += 1
    monkeypatch.setattr(language, "POOL_TOKENS", 400)
    table = language.encoded(docs, "doc_id", "text", index)
    assert (language.neighbours(table) == want).all()
    assert table.where("row >= 0").count() == len(rows)


def test_documents_are_encoded_whole(make_docs):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "of", "Äpfel", f"x{rng.randint(0, 40)}"]) for _ in range(n)) for n in (0, 1, 5, 2000)]
    index = {b"the": 0, language.END: 1, b"of": 2}
    table = language.encoded(make_docs([*enumerate(texts), (None, None)]), "doc_id", "text", index).where("row >= 0")
    got = {r.id: r for r in table.collect()}
    for i, t in [*enumerate(texts), (None, "")]:
        words = language.words_of(t)
        row = got[None if i is None else str(i)]
        assert row.numbers == [index.get(w, -1 - language.suffix_group(w)) for w in words] + [1]
        assert bytes(row.words) == b" ".join(w for w in words if w not in index)


def test_the_warm_up_takes_windows_of_long_documents(make_docs, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_TOKENS", 50)
    monkeypatch.setattr(language, "SAMPLE_DOCUMENTS", 30)
    index = {b"a": 0, language.END: 1}
    docs = make_docs([(i, "a " * (20 if i % 2 else 3000)) for i in range(80)])
    table = language.encoded(docs, "doc_id", "text", index).where("row >= 0")
    found = language.sample(table)
    assert len(found) == 30 and {len(x) for x in found} == {21, 50} and all(x[:-1].sum() == 0 for x in found)
    assert [list(x) for x in language.sample(table.repartition(3))] == [list(x) for x in found]


def test_own_documents_score_as_any(sample):
    model = language.train(sample)
    own = {(r.doc_id, round(r.score, 4), round(r.base_score, 6), r.n_known) for r in language.score_own(model, "doc_id", "bigint").collect()}
    assert own == {(r.doc_id, round(r.score, 4), round(r.base_score, 6), r.n_known) for r in language.score(sample, model).collect()}


def test_classes_do_not_rest_on_the_sample(make_docs, monkeypatch):
    """Words of documents that the sample leaves out get classes by their company."""
    monkeypatch.setattr(language, "SAMPLE_DOCUMENTS", 1)
    monkeypatch.setattr(language, "SAMPLE_TOKENS", 2)
    rng = random.Random(5)
    long = [" ".join(f"the {rng.choice(['cat', 'dog'])} of {rng.choice(['red', 'tin'])}" for _ in range(200)) for _ in range(6)]
    model = language.train(make_docs([(i, t) for i, t in enumerate([*long, "ab"])]))
    at = {w: c for w, c in zip(model.vocabulary.index, model.vocabulary.chosen_class, strict=False)}
    assert all(at[w] >= 0 for w in (b"the", b"of", b"cat", b"dog", b"red", b"tin"))


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    net = language.Network(7, seed=1)
    for name in net.names:
        setattr(net, name, (rng.standard_normal(getattr(net, name).shape) * 0.4).astype(np.float64))
    x, y = rng.integers(0, 7, (5, 3)), rng.integers(0, language.CLASSES, (5, 3))
    first = np.zeros((5, 3), dtype=bool)
    first[0], first[3, 1] = True, True
    h = rng.standard_normal((3, language.STATE))

    def loss() -> float:
        return net.gradients(x, y, first, h)[2] / x.size

    parts, _, _ = net.gradients(x, y, first, h)
    for name, part in zip(net.names, parts, strict=True):
        weights = getattr(net, name)
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in weights.shape)
            kept, step = weights[at], 1e-3
            weights[at] = kept + step
            up = loss()
            weights[at] = kept - step
            down = loss()
            weights[at] = kept
            assert abs((up - down) / (2 * step) - part[at]) < 1e-4


def test_state_is_carried_through_whole_documents():
    rng = np.random.default_rng(3)
    net = language.Network(language.INPUT_WORDS + language.CLASSES + 1, seed=4)
    documents = [
        (rng.integers(0, net.n_inputs, n), rng.integers(0, language.CLASSES, n)) for n in (1, 700, 3, 64, 20_000, 64)
    ]
    got = net.log_likelihoods(documents)
    for (x, y), value in zip(documents, got, strict=True):
        h, total = np.zeros((1, language.STATE), dtype=np.float32), 0.0
        for a, b in zip(x, y, strict=True):
            h = net.step(net.input_gates[[a]], net.input_new[[a]], h)[0]
            every, sums, _ = net.exponentials(h, np.array([b]))
            total += float(np.log(every[0, b] / sums[0]))
        assert abs(total - value) < 1e-3 * max(1, abs(total))


def test_probabilities_of_known_words_sum_to_less_than_one(sample):
    model = language.train(sample)
    voc = model.vocabulary
    counts = {bytes(r.word): r.n for r in model.counts.collect()}
    mass = np.zeros(language.CLASSES)
    for w, n in counts.items():
        number = voc.index.get(w, -1 - language.suffix_group(w))
        c = voc.network_input(np.array([number, voc.index[language.END]]))[1][0]
        mass[c] += (n + 1) / 10 ** voc.log_total[c]
    assert (mass <= 1 + 1e-9).all() and (mass[mass > 0] < 1).all()


def test_shared_backoff_leaves_unseen_letters_without_evidence():
    toxic, ordinary = Counter(), Counter()
    for w in ["idiot", "house", "garden", "idiot"] * 5:
        for r in toxicity.runs_of(w):
            toxic[r] += 1
    for w in ["house", "garden", "window", "idiom"] * 5:
        for r in toxicity.runs_of(w):
            ordinary[r] += 1
    pair = toxicity.KneserNeyPair(toxic, ordinary)
    assert pair.word("idiot") > 1 > abs(pair.word("house")) and pair.word("window") < 0
    assert abs(pair.word("漢字")) < 1.5
    for context in ("^", "hou", "^id"):
        letters = {r[-1] for r in set(toxic) | set(ordinary) if r[:-1] == context}
        assert letters


def test_toxicity_accuracy_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.97


def test_held_out_labels_are_never_learnt_from(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    flipped = labels.withColumn("toxic", (1 - labels.toxic).cast("int")).where("crc32(cast(doc_id as string)) % 5 = 0")
    mixed = labels.where("crc32(cast(doc_id as string)) % 5 <> 0").union(flipped.select(labels.columns))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, mixed)
    assert a.pair.ratio == b.pair.ratio and (a.slope, a.offset) == (b.slope, b.offset)


def test_toxicity_on_edges(spark, edges, nothing):
    rng = random.Random(1)
    rows = [(i, rng.choice((0, 1)), i % 2) for i in [1, 1, 2, 3, 5, 6, 7, 8, 9, 99]] + [(None, 1, 1), (4, 0, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        scorer = toxicity.train(edges, known)
        out = toxicity.score(edges, scorer).collect()
        assert len(out) == edges.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
        assert len({r.score for r in out if r.doc_id in (2, 3, 4)}) == 1
        kept = toxicity.reject_toxic(edges, scorer)
        assert kept.columns == edges.columns and kept.count() == sum(r.predicted == 0 for r in out)
    assert toxicity.score(nothing, toxicity.train(nothing, labels)).count() == 0
