"""Sharding, source divergence and the Merkle manifest against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyveer.llm import divergence, manifest, sharding
from tallyveer.llm.queries import ORACLES


def docs_of(make_docs, rows):
    """Documents from (id, text, lang, source)."""
    docs = make_docs([(i, t) for i, t, _, _ in rows]).withColumn("at", F.monotonically_increasing_id())
    spark = docs.sparkSession
    more = spark.createDataFrame([(n, lang, source) for n, (_, _, lang, source) in enumerate(rows)], "n long, l string, s string")
    order = docs.rdd.zipWithIndex().map(lambda r: (r[1], r[0]["at"])).toDF(["n", "at"])
    joined = docs.join(order, "at").join(more, "n")
    return joined.withColumns({"lang": F.col("l"), "source": F.col("s")}).drop("n", "at", "l", "s").cache()


# sharding


def test_room_tree_finds_the_tightest_and_stays_level():
    rng, tree, held = random.Random(1), sharding.RoomTree(), set()
    for step in range(4000):
        if held and rng.random() < 0.45:
            gone = rng.choice(sorted(held))
            tree.remove(*gone)
            held.discard(gone)
        else:
            new = (rng.randint(0, 60), step)
            tree.add(*new)
            held.add(new)
        size = rng.randint(0, 70)
        assert tree.tightest(size) == min((h for h in held if h[0] >= size), default=None)

    def height(node):
        if node is None:
            return 0
        a, b = height(node[1]), height(node[2])
        assert abs(a - b) <= 1 and node[3] == 1 + max(a, b)
        return node[3]

    height(tree.root)


def one_by_one(sizes, capacity):
    """Best fit of single groups, largest first."""
    rooms, out = [], []
    for size in sorted(sizes, reverse=True):
        fitting = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fitting:
            i = min(fitting)[1]
        else:
            i = len(rooms)
            rooms.append(max(capacity, size))
        rooms[i] -= size
        out.append((size, i))
    return Counter(out)


def test_equal_sizes_are_placed_as_one_by_one():
    rng = random.Random(2)
    for _ in range(300):
        sizes = [rng.randint(1, 12) for _ in range(rng.randint(0, 40))]
        capacity = rng.randint(5, 30)
        items = sorted(Counter(sizes).items(), reverse=True)
        got = Counter()
        for (size, _), place in zip(items, sharding.best_fit(items, capacity), strict=True):
            for shard, n in place:
                got[size, shard] += n
        assert got == one_by_one(sizes, capacity)


def test_even_shards_are_few_and_even():
    rng = random.Random(3)
    for _ in range(200):
        items = sorted(Counter(rng.randint(1, 50) for _ in range(rng.randint(40, 400))).items(), reverse=True)
        items = [(rng.randint(500, 3000), 1), *items] if rng.random() < 0.3 else items
        room = defaultdict(int)
        for (size, n), place in zip(items, sharding.even_shards(items, 8), strict=True):
            assert sum(k for _, k in place) == n
            for shard, k in place:
                room[shard] += size * k
        assert set(room) <= set(range(8))
        if items[0][0] <= 50:
            assert max(room.values()) <= sum(s * n for s, n in items) / 8 + 50


def check_shards(docs, rows, most=None):
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, t in texts.items() for _ in t)
    slots, group, sizes = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        facts = [(len(t.encode()) + 1, zlib.crc32(t.encode())) for t in texts[r.doc_id]]
        assert (r.size, r.text_crc32) in facts
        slots[r.shard].append(r.slot)
        group[r.size, r.text_crc32].add(r.shard)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in group.values())
    return sizes


@pytest.mark.parametrize("part_rows", [16_384, 5])
def test_shards_hold_whole_groups_in_even_sizes(edges, sample, part_rows):
    rows = sharding.shard(sample, part_rows=part_rows).collect()
    sizes = check_shards(sample, rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) <= 1.01 * min(sizes.values())
    check_shards(edges, sharding.shard(edges, part_rows=part_rows).collect())


def test_shards_of_a_capacity(edges, sample, nothing):
    rows = sharding.shard(sample, capacity=40_000).collect()
    sizes = check_shards(sample, rows)
    groups = Counter()
    for r in sample.collect():
        groups[r.text or ""] += len((r.text or "").encode()) + 1
    want = one_by_one(groups.values(), 40_000)
    assert max(sizes.values()) <= max(40_000, *groups.values())
    assert len(sizes) <= 1 + len({shard for _, shard in want})
    assert sharding.shard(nothing).count() == sharding.shard(nothing, capacity=10).count() == 0


def test_a_group_beyond_an_even_share_is_alone(make_docs):
    hot = [(i, "the same " * 50) for i in range(300)]
    docs = make_docs(hot + [(1000 + i, f"text {i} " * 9) for i in range(600)])
    rows = sharding.shard(docs, part_rows=32).collect()
    sizes = check_shards(docs, rows)
    alone = {r.shard for r in rows if r.doc_id < 1000}
    assert len(alone) == 1 and not {r.shard for r in rows if r.doc_id >= 1000} & alone
    rest = [n for s, n in sizes.items() if s not in alone]
    assert len(rest) == 7 and max(rest) - min(rest) <= 100


# divergence


def words_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_pointers_are_sorted_and_runs_counted(depth):
    rng = random.Random(4)
    kinds = ["a", "ab", "Äpfel", "漢字", "abcdefgh", "abcdefghi", "abcdefgh" * 9 + "x", "abcdefgh" * 9, "z" * 200, "Zebra"]
    texts = ["".join(rng.choice(kinds) + rng.choice([" ", "-", "1", "\n", ""]) for _ in range(rng.randint(0, 30))) for _ in range(50)]
    raw = [t.encode() for t in texts]
    data = divergence.LOWER_BYTE[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    bounds = np.cumsum([0, *map(len, raw)])
    starts, lengths = divergence.word_pointers(data, bounds)
    order, head = divergence.sorted_runs(data, starts, lengths, depth)
    words = divergence.words_at(data, starts[order], lengths[order])
    want = sorted((w for t in texts for w in words_of(t)), key=str.encode)
    assert words == want
    assert [w for w, h in zip(words, head, strict=True) if h] == sorted(set(want), key=str.encode)


def plain_audit(rows, least=10, top=10):
    rows = [((lang or ""), (source or ""), words_of(t or "")) for _, t, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = Counter(w for x, _, words in rows if x == lang for w in set(words))
        kept = sorted(w for w, n in docs.items() if n >= least)
        count = defaultdict(Counter)
        for x, source, words in rows:
            if x == lang:
                count[source].update(w for w in words if w in set(kept))

        def shares(c):
            whole = sum(c.values()) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // whole for w in kept}

        p = {s: shares(c) for s, c in count.items()}
        q = shares(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in p if o != s]
            marks = [(f(p[s][w], q[w]), w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", marks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, o, v, i) for i, (v, o) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def rows_for_audit():
    rng = random.Random(5)
    words = ["Alpha", "beta", "Gämma", "漢字", "delta-epsilon", "longerthaneight", "longerthanseven", "x1y", "!!", "ωmega"]
    rows = [
        (i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s10", None]))
        for i in range(300)
    ]
    return [*rows, (None, None, None, None), (1, "", "fr", "s1"), (2, "seul", "fr", "s2"), (3, None, "fr", "s3"), *rows[:20],
            (4, "Alpha beta " * 3000, "en", "s1"), (5, "q" * 100_000 + " alpha", "en", "s2"), (5, "q" * 100_000 + " alpha", "en", "s2")]


@pytest.mark.parametrize(("shard", "cells"), [(4 << 20, 1 << 20), (1000, 1 << 20), (500, 8)])
def test_audit_matches_plain_counts(make_docs, shard, cells):
    rows = rows_for_audit()
    docs = docs_of(make_docs, rows)
    got = sorted(tuple(r) for r in divergence.audit(docs, block_cells=cells, shard_bytes=shard).collect())
    assert got == plain_audit(rows)


def test_audit_edges_and_sql(edges, nothing, make_docs):
    assert divergence.audit(nothing).count() == 0
    con = duckdb.connect()
    docs = edges.union(edges).union(docs_of(make_docs, rows_for_audit()))
    con.register("documents", docs.select("text", "lang", "source").toArrow())
    want = sorted(map(tuple, con.execute(ORACLES["op12_divergence_audit"]).fetchall()))
    assert sorted(tuple(r) for r in divergence.audit(docs).collect()) == want


# manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    texts = [None if v is None else str(v) for v in values]
    return sha("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def plain_proofs(entries, arity):
    """For (group, id, leaf, seen): the row of each leaf, with its siblings per level."""

    def climb(leaves):
        ways, spots = [[] for _ in leaves], list(range(len(leaves)))
        while len(leaves) > 1:
            for i, at in enumerate(spots):
                run = at - at % arity
                ways[i].append(("".join(leaves[run:at]), "".join(leaves[at + 1 : run + arity])))
                spots[i] = at // arity
            leaves = [sha("".join(leaves[i : i + arity])) for i in range(0, len(leaves), arity)]
        return leaves[0], ways

    groups = defaultdict(list)
    for group, key, leaf, seen in entries:
        groups[group].append((key is not None, key, leaf, seen))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda r: (r[0], r[1] if r[0] else 0, r[2]))
        trees.append(climb([r[2] for r in groups[g]]))
    root, tops = climb([t[0] for t in trees])
    out = []
    for g, (subroot, ways), top in zip(names, trees, tops, strict=True):
        for (_, key, leaf, seen), way in zip(groups[g], ways, strict=True):
            h = seen
            for left, right in way + top:
                h = sha(left + h + right)
            proof = sha("".join(left + right for left, right in way + top))
            out.append((key, leaf, subroot, root, proof, h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("arity", [8, 2, 3])
@pytest.mark.parametrize("size", [1, 2, 9, 300])
def test_proofs_match_a_plain_tree(make_docs, arity, size):
    rng = random.Random(size)
    langs = ["en", None, "", "de", *[f"x{i}" for i in range(min(size // 4, 20))]]
    weights = [size, size / 3, *[1] * (len(langs) - 2)]
    rows = [(rng.choice([None, i, i // 2]), rng.choice(["Text", "", None, f"T {i}"]), rng.choices(langs, weights)[0], "s") for i in range(size)]
    rows += rows[: size // 5]
    docs = docs_of(make_docs, rows)
    seen = {"text": F.lower("text")}
    got = manifest.verified(manifest.prove(manifest.leaves(docs, seen=seen), arity)).collect()
    facts = [
        (lang, i, plain_leaf((i, s, lang, len(t or ""), t)), plain_leaf((i, s, lang, len(t or ""), t and t.lower())))
        for i, t, lang, s in rows
    ]
    assert sorted((tuple(r) for r in got), key=str) == plain_proofs(facts, arity)


def test_long_ways_take_several_rounds(spark, make_docs, monkeypatch):
    monkeypatch.setattr(manifest, "SHARE", 4)
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "s") for i in range(1500)]
    docs = docs_of(make_docs, rows)
    proofs = manifest.prove(manifest.leaves(docs), 2).collect()
    assert {len(r.steps) for r in proofs} == {10 + 1, 9 + 1}
    for r in proofs[::50]:
        h = r.leaf
        for s in r.steps:
            h = sha(s.left + h + s.right)
        assert h == r.root


def test_manifest_edges_and_sql(edges, nothing):
    assert manifest.verified(manifest.prove(manifest.leaves(nothing))).count() == 0
    con = duckdb.connect()
    con.register("documents", edges.select("doc_id", "source", "lang", "n_chars", "text").toArrow())
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaves = manifest.leaves(edges, seen={"text": F.when(hit, lowered).otherwise(F.col("text"))})
    got = sorted((tuple(r) for r in manifest.verified(manifest.prove(leaves)).collect()), key=str)
    want = con.execute(ORACLES["op13_merkle_manifest"]).fetchall()
    assert got == sorted(map(tuple, want), key=str)
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)
