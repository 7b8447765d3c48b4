"""Fingerprint and vector near-duplicates against brute force, and components."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyveer.llm import embeddings, simhash
from tallyveer.llm.common import connected_components, merged


def components_of(nodes, edges) -> dict:
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_connected_components(spark, shape):
    rng = random.Random(4)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 300)] + [(300, 301)],
        "random": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)],
        "none": [(5, 5)],
    }[shape]
    rng.shuffle(edges)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components_of({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if any(n in e for e in edges if e[0] != e[1])}


def test_merged_labels():
    label = merged(np.arange(6), np.array([5, 3, 1]), np.array([3, 1, 4]))
    assert label.tolist() == [0, 1, 2, 1, 1, 1]


def plain_print(t: str) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows) -> list[tuple]:
    prints = {t: plain_print(t or "") for _, t in rows}
    distinct = sorted(set(prints.values()))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 4]
    of = components_of(distinct, links)
    least: dict = {}
    for i, t in rows:
        if i is not None:
            least[of[prints[t]]] = min(i, least.get(of[prints[t]], i))
    return sorted((str(i), f"{prints[t]:016x}", str(least.get(of[prints[t]]))) for i, t in rows)


def got_components(docs) -> list[tuple]:
    rows = simhash.near_duplicates(docs).collect()
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows)


def test_simhash_on_edges_and_table(edges, sample, nothing):
    for docs in (edges, sample):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert got_components(docs) == plain_components([(i, t) for i, t in rows])
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_keeps_one_of_each_component(edges, sample, nothing):
    for docs in (edges, sample):
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        components = {c for _, _, c in got_components(docs)}
        ids = [str(r.doc_id) for r in kept.collect()]
        assert len(ids) == len(components) and set(ids) - {"None"} == components - {"None"}
    assert simhash.keep_one(nothing).count() == 0


def clumps(n: int, seed: int = 6) -> np.ndarray:
    """Random prints, and prints around a few centres."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    rows = [rng.integers(0, 1 << 63, n, dtype=np.uint64)]
    for c in centres:
        for bits in (1, 3, 6):
            flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, bits, False).astype(np.uint64)) for _ in range(n // 8)]
            rows.append(c ^ np.array(flips, dtype=np.uint64))
    return np.unique(np.concatenate(rows))


@pytest.mark.parametrize(("shard", "cap"), [(1024, 4096), (32, 4096), (32, 40)])
def test_print_links_connect_what_brute_force_connects(spark, monkeypatch, shard, cap):
    monkeypatch.setattr(simhash, "SHARD_CAP", cap)
    prints = clumps(400)
    label = np.arange(len(prints))
    for i, p in enumerate(prints):
        near = np.flatnonzero(np.bitwise_count(prints ^ p) <= 4)
        label = merged(label, np.full(len(near), i), near)
    signed = prints.astype(np.int64)
    table = spark.createDataFrame([(int(v),) for v in signed], "print long").repartition(3).cache()
    links = [(r.a, r.b) for r in simhash.print_links(table, shard=shard).collect()]
    got = components_of(signed.tolist(), links)
    want: dict[int, int] = {}
    for i, v in enumerate(signed.tolist()):
        want[int(label[i])] = min(v, want.get(int(label[i]), v))
    assert got == {v: want[int(label[i])] for i, v in enumerate(signed.tolist())}


def test_meetings_bring_everyone_together_once():
    for residents in (1, 2, 5):
        for guests in (1, 2, 4):
            at: dict = {}
            for home, n in ((True, residents), (False, guests)):
                for c in range(n):
                    for i, j, lives in simhash.meetings(residents, guests, c, home):
                        at.setdefault((i, j), []).append((home, c, lives))
            met = []
            for (i, j), chunks in at.items():
                own = [c for home, c, lives in chunks if lives]
                assert own == [i] and len(chunks) <= 3
                met += [(i, "r" if home else "v", c) for home, c, lives in chunks if not lives]
                met += [(i, "r", i)] if i == j else []
            want = [(i, "r", c) for c in range(residents) for i in range(c + 1)]
            want += [(i, "v", c) for c in range(guests) for i in range(residents)]
            assert sorted(met) == sorted(want)


def test_a_block_that_half_of_the_prints_share(spark, monkeypatch):
    rng = np.random.default_rng(12)
    shared = rng.integers(0, 1 << 48, 3000).astype(np.uint64) << np.uint64(16) | np.uint64(0xBEEF)
    near = shared[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    prints = np.unique(np.concatenate([shared, near, rng.integers(0, 1 << 63, 2500).astype(np.uint64)]))
    monkeypatch.setattr(simhash, "SHARD_CAP", 100)
    table = spark.createDataFrame([(int(v),) for v in prints.astype(np.int64)], "print long").repartition(4).cache()
    sizes = simhash.dealt_prints(table, shard=64).groupBy("tree", "leaf", "i", "j").count().agg({"count": "max"}).first()[0]
    assert sizes <= 3 * 1.5 * 100
    signed = prints.astype(np.int64)
    got = components_of(signed.tolist(), [(r.a, r.b) for r in simhash.print_links(table, shard=64).collect()])
    label = np.arange(len(prints))
    for i, p in enumerate(prints):
        close = np.flatnonzero(np.bitwise_count(prints ^ p) <= 4)
        label = merged(label, np.full(len(close), i), close)
    want: dict[int, int] = {}
    for i, v in enumerate(signed.tolist()):
        want[int(label[i])] = min(v, want.get(int(label[i]), v))
    assert got == {v: want[int(label[i])] for i, v in enumerate(signed.tolist())}


def test_every_near_pair_of_blocks_meets_in_a_leaf():
    rng = np.random.default_rng(8)
    values = rng.integers(0, 1 << 16, 3000).astype(np.uint64)
    tree = simhash.grow(values[:500], 16, iter(range(10_000)))
    homes, seen = {}, {}
    for leaf, rows, home in simhash.visits(tree, values, 1):
        for r in rows.tolist():
            seen.setdefault(r, set()).add(leaf)
            if home:
                assert r not in homes
                homes[r] = leaf
    assert len(homes) == len(values)
    for i in range(300):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 1).tolist():
            assert homes[j] in seen[i] or homes[i] in seen[j]


def plain_vectors(rows) -> list[tuple]:
    good = {
        k: np.array(v, dtype=float)
        for k, (_, v) in enumerate(rows)
        if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    size = max((len(v) for v in good.values()), default=1)
    unit = {k: np.pad(v, (0, size - len(v))) / np.linalg.norm(v) for k, v in good.items()}
    keys = list(unit)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if unit[a] @ unit[b] >= 0.9]
    of = components_of(range(len(rows)), links)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[of[k]] = min(i, least.get(of[k], i))
    n = [sum(k in e for e in links) for k in range(len(rows))]
    return sorted((str(i), n[k], str(least.get(of[k]))) for k, (i, _) in enumerate(rows))


def got_vectors(df) -> list[tuple]:
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embeddings.near_duplicates(df).collect())


def test_vectors_on_edges(spark):
    big, nan = 1e38, float("nan")
    rows = [
        (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]),
        (6, [nan, 1.0, 0.0]), (7, [float("inf"), 1.0, 0.0]), (8, [None, 1.0, 0.0]), (9, [big, big / 5, 0.0]),
        (10, [1e-30, 0.0, 0.0]), (11, [0.0, 1.0, 0.0]), (None, [0.0, 0.0, 1.0]), (None, [0.0, 0.1, 1.0]), (12, [2.0]),
        (13, [-1.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label string, node string")
    assert got_vectors(df) == plain_vectors(rows)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [2048, 24])
def test_vector_recall_and_precision(spark, monkeypatch, cap):
    monkeypatch.setattr(embeddings, "LIST_CAP", cap)
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(250):
        centre = rng.standard_normal(64)
        rows.append(centre)
        angle = rng.uniform(0.88, 0.99)
        away = rng.standard_normal(64)
        away -= away @ centre / (centre @ centre) * centre
        rows.append(angle * centre / np.linalg.norm(centre) + np.sqrt(1 - angle**2) * away / np.linalg.norm(away))
    hot = rng.standard_normal(64)
    rows += [hot + rng.standard_normal(64) * rng.uniform(0.05, 0.3) for _ in range(200)] + [hot] * 40
    table = [(i, np.float32(v).tolist()) for i, v in enumerate(rows)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    want = plain_vectors([(i, np.array(v)) for i, v in table])
    got = got_vectors(df)
    found, there = sum(n for _, n, _ in got), sum(n for _, n, _ in want)
    assert 0.99 * there <= found <= there
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.98


def test_table_vectors_match_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    assert got_vectors(df) == plain_vectors([(r.vec_id, r.embedding) for r in df.collect()])
    kept = embeddings.near_duplicates(df).where(F.col("kept") != (F.col("vec_id") == F.col("component_id")))
    assert kept.count() == 0


def cone(n: int, width: float, seed: int = 12) -> list[tuple]:
    """Vectors around one axis, half of them near-copies of the others."""
    rng = np.random.default_rng(seed)
    axis = rng.standard_normal(64)
    rows = axis / np.linalg.norm(axis) + rng.standard_normal((n // 2, 64)) / 8 * width
    away = rng.standard_normal(rows.shape) / 8 * width * rng.uniform(0.05, 0.5, (len(rows), 1))
    return [(i, np.float32(v).tolist()) for i, v in enumerate(np.concatenate([rows, rows + away]))]


@pytest.mark.parametrize(("width", "cap"), [(0.6, 2048), (0.5, 2048), (0.33, 2048), (0.33, 100), (0.1, 2048)])
def test_vectors_in_a_cone(spark, monkeypatch, width, cap):
    monkeypatch.setattr(embeddings, "LIST_CAP", cap)
    table = cone(600, width)
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    want = plain_vectors([(i, np.array(v)) for i, v in table])
    got = got_vectors(df)
    found, there = sum(n for _, n, _ in got), sum(n for _, n, _ in want)
    assert there >= 600 and 0.99 * there <= found <= there
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.98


def test_a_table_of_two_or_three_near_copies(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.95, 0.31225]), (3, [0.96, 0.28])]
    for n in (2, 3):
        df = spark.createDataFrame(rows[:n], "vec_id long, embedding array<double>")
        assert got_vectors(df) == plain_vectors([(i, np.array(v)) for i, v in rows[:n]]) == [(str(i + 1), n - 1, "1") for i in range(n)]


@pytest.mark.parametrize(("shared", "cap"), [(1, 2048), (2, 2048), (2, 24), (3, 24)])
def test_pairs_that_share_pivots_meet_once(spark, monkeypatch, shared, cap):
    monkeypatch.setattr(embeddings, "LIST_CAP", cap)
    monkeypatch.setattr(embeddings, "TOGETHER", 500)
    table = cone(400, 0.33)
    unit = np.array([v for _, v in table], dtype=float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    index = embeddings.Index(unit.mean(axis=0), embeddings.directions(unit[:50], unit.mean(axis=0)), 6, shared)
    monkeypatch.setattr(embeddings, "fitted", lambda *_: (index, 0.0))
    inside = np.zeros((400, 50))
    np.put_along_axis(inside, index.describe(unit)[0], 1, axis=1)
    near = (unit @ unit.T >= 0.9) & (inside @ inside.T >= shared)
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).collect()}
    assert got == {i: int(near[i].sum()) - 1 for i in range(400)}
    assert 400 < sum(got.values()) < (unit @ unit.T >= 0.9).sum() - 400


def test_prefixes_are_ordered_and_ties_go_to_the_earlier_pivot():
    rng = np.random.default_rng(3)
    rows, pivots = rng.integers(-2, 3, (200, 4)).astype(float), rng.integers(-2, 3, (30, 4)).astype(float)
    want = np.argsort(-(rows @ pivots.T), axis=1, kind="stable")
    for nearest in (1, 5, 29, 30):
        assert (embeddings.prefixes(rows, pivots, nearest) == want[:, :nearest]).all()


def test_work_grows_slower_than_the_table():
    rows = np.random.default_rng(4).standard_normal((6000, 24))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    small, large = (embeddings.fitted(rows, n, 0.9)[1] for n in (50_000, 5_000_000))
    assert small < 50_000 / 10 and large < 40 * small


def test_one_missed_link_is_counted():
    rng = np.random.default_rng(13)
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    sample = np.concatenate([np.tile(axes[0], (400, 1)), np.repeat(axes[1:21], 2, axis=0)])
    prefix = np.zeros((440, 16), dtype=int) + np.arange(16)
    prefix[400:] += 16 * np.arange(40)[:, None]  # no two of the small groups share a pivot
    assert embeddings.whole(sample, prefix, 1024, 0.9, [2]) == [pytest.approx(400 / 440)]
