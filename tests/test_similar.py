import random

import pytest

from tallyveer.operators import similar as sm

TEXTS, NUMBERS = ["name", "street"], ["amount"]
SCHEMA = "id long, name string, street string, amount double, note string"


def people(n, seed=1):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    rows = [(i, f"{word(6)} {word(8)}", f"{word(9)} {rng.randint(1, 99)}", round(rng.uniform(10, 900), 2), "x") for i in range(n)]

    def edited(text):
        at = rng.randrange(len(text))
        return rng.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text.upper(), text[:at] + "zz" + text[at + 1 :]])

    copies = []
    for i in range(n // 3):
        _, name, street, amount, _ = rng.choice(rows)
        kind = i % 4
        name = edited(name) if kind in (0, 3) else name
        street = edited(street) if kind in (1, 3) else street
        copies.append((n + i, name, street, round(amount * 1.01, 2) if kind in (2, 3) else amount, "y"))
    return rows + copies


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def alike(r, s):
    total = 0.0
    for i in (1, 2):
        a, b = r[i], s[i]
        if a is None or b is None:
            total += float(a is None and b is None)
        else:
            a, b = a.lower(), b.lower()
            total += 1 - edits(a, b) / max(len(a), len(b)) if a or b else 1.0
    a, b = r[3], s[3]
    total += float(a is None and b is None) if a is None or b is None else max(0.0, 1 - abs(a - b) / max(abs(a), abs(b), 1e-300))
    return total / 3


def all_links(rows, least):
    return {(r[0], s[0]) for i, r in enumerate(rows) for s in rows[i + 1 :] if r[1:4] != s[1:4] and alike(r, s) >= least}


@pytest.mark.parametrize("block", [4096, 20])
def test_recall_against_all_pairs(spark, block):
    rows = people(240)
    pairs, members = sm.similar_pairs(spark.createDataFrame(rows, SCHEMA), "id", TEXTS, NUMBERS, block=block)
    stands = {r["key"]: r["id"] for r in members.collect()}
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    want = {tuple(sorted((stands[a], stands[b]))) for a, b in all_links(rows, sm.LEAST)}
    assert got <= want and len(got) >= 0.97 * len(want) > 60


def test_classes_and_copies(spark):
    rows = people(90, seed=2)
    rows += [(1000 + i, *rows[0][1:4], "again") for i in range(50)]  # a group of exact copies
    rows += [(2000, None, "", None, "n"), (2001, None, "", None, "n"), (2002, "", "", 0.0, "n")]
    out = {r["id"]: r for r in sm.near_duplicate_rows(spark.createDataFrame(rows, SCHEMA), "id", TEXTS, NUMBERS).collect()}
    assert len(out) == len(rows)
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, r in enumerate(rows):
        for s in rows[i + 1 :]:
            if r[1:4] == s[1:4] or alike(r, s) >= sm.LEAST:
                a, b = sorted((root(r[0]), root(s[0])))
                parent[b] = a
    assert {i: r["class"] for i, r in out.items()} == {r[0]: root(r[0]) for r in rows}
    assert out[1000]["copies"] >= 51 and out[2000]["copies"] == 2 and out[2001]["class"] == 2000


def test_long_chains_and_empty_tables(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 900)], "a long, b long")
    found = {r["id"]: r["class"] for r in sm.classes(pairs).collect()}
    assert {found[i] for i in range(1, 201)} == {1} and found[900] == 500
    assert sm.near_duplicate_rows(spark.createDataFrame([], SCHEMA), "id", TEXTS, NUMBERS).count() == 0
    alone = spark.createDataFrame([(7, "a", "b", 1.0, "")], SCHEMA)
    assert [tuple(r) for r in sm.near_duplicate_rows(alone, "id", TEXTS).collect()] == [(7, 7, 1, 0)]
