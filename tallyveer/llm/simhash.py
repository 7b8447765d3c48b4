"""SimHash near-duplicates: fingerprints in vantage-point trees under Hamming distance.

Two fingerprints that differ in at most ``bits`` of 64 differ in at most ``bits // BLOCKS`` bits of one of ``BLOCKS``
blocks. So each block has a vantage-point tree of its own, under the Hamming distance of that block: a node parts its prints
at a distance from a vantage value, and the triangle inequality says which prints near that border must also be looked
up on the other side. The leaves are shards. A print lives in one shard per tree and visits the shards that its ball overlaps, which are few
whatever the number of prints, as a block of 16 bits has 17 values within one bit. Inside a shard the same search goes on in
memory, and whole fingerprints decide.

Equal fingerprints are one print from the start, so copies never meet as pairs. A shard gives each print's smallest known
partner instead of pairs. Where more than ``SHARD_CAP`` prints live in a shard or visit it, both are dealt out in chunks of their own,
so a task holds three chunks at most whatever the shard. Trees come from a bounded sample of prints; wrong guesses there cost balance, never links.

Defined results: a text without words (null too) has fingerprint zero and is linked like any other; repeated rows share their
component; a component without any id has a null component id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveer.llm.common import connected_components, field, merged, per_text, stored

SHINGLE = 4
BITS = 4
SEED = 42
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
#: Prints that trees are built from, at most.
SAMPLE_PRINTS = 1 << 16
#: Prints of a shard that a tree aims at, and those that a task takes at most.
SHARD = 1024
SHARD_CAP = 4 * SHARD
#: Prints that go down a tree together.
POOL = 1 << 15
#: Cells of one comparison of prints in memory.
CELLS = 1 << 20


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, repeats included; A-Z are lower-cased."""
    words = text.encode().lower().split()  # of bytes: splits at the six ASCII blanks only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(shingle: int = SHINGLE):
    """Column function: text to fingerprint, as a signed long."""

    def make():
        return lambda t: (int(np.uint64(fingerprint(t, shingle)).astype(np.int64)),)

    return per_text(make, "print long")


@dataclass
class Node:
    """An inner node (vantage value, distance of the border, sides) or a leaf (number)."""

    leaf: int = -1
    vantage: int = 0
    border: int = 0
    near: Node | None = None
    far: Node | None = None


def block_of(prints: np.ndarray, block: int) -> np.ndarray:
    """Bits of one block of unsigned fingerprints."""
    return (prints >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)


def distances(values: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(values ^ np.uint64(vantage)).astype(np.int16)


def border_of(values: np.ndarray, tries: int = 8) -> tuple[int, int] | None:
    """The vantage and border that part ``values`` best: even sides, few prints at the border; None if all are equal."""
    best, choice = 0.0, None
    for vantage in dict.fromkeys(values[np.linspace(0, len(values) - 1, tries).astype(int)].tolist()):
        counts = np.bincount(distances(values, vantage), minlength=BLOCK_BITS + 2)
        below = np.cumsum(counts)
        for border in np.flatnonzero((below > 0) & (below < len(values))).tolist():
            even = min(below[border], len(values) - below[border])
            worth = even / (len(values) + counts[border] + counts[border + 1])
            if worth > best:
                best, choice = worth, (int(vantage), border)
    return choice


def grow(values: np.ndarray, size: float, leaves: Iterator[int]) -> Node:
    """Tree over block values whose leaves hold about ``size`` sample values."""
    choice = border_of(values) if len(values) > size else None
    if choice is None:
        return Node(leaf=next(leaves))
    near = distances(values, choice[0]) <= choice[1]
    return Node(
        vantage=choice[0],
        border=choice[1],
        near=grow(values[near], size, leaves),
        far=grow(values[~near], size, leaves),
    )


def visits(node: Node, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(leaf, rows, whether they live there) for all rows: each lives in one leaf and visits those its ball overlaps.

    Of two prints that a border parts, the near one visits the far side; a visitor follows its whole ball.
    """

    def descend(at: Node, rows: np.ndarray, home: bool):
        if not len(rows):
            return
        if at.leaf >= 0:
            yield at.leaf, rows, home
            return
        d = distances(values[rows], at.vantage)
        if home:
            yield from descend(at.near, rows[d <= at.border], True)
            yield from descend(at.far, rows[d > at.border], True)
            yield from descend(at.far, rows[(d <= at.border) & (d + radius > at.border)], False)
        else:
            yield from descend(at.near, rows[d - radius <= at.border], False)
            yield from descend(at.far, rows[d + radius > at.border], False)

    yield from descend(node, np.arange(len(values)), True)


class Groups:
    """Components of the prints of one shard."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.label = prints, np.arange(len(prints))

    def compare(self, rows: np.ndarray, others: np.ndarray, bits: int, within: bool) -> None:
        """Join each of ``rows`` with those of ``others`` that are near, and ``within`` with one another."""
        every = np.concatenate([rows, others]) if within else others
        step = max(1, CELLS // max(len(every), 1))
        for i in range(0, len(rows) if len(every) else 0, step):
            part = rows[i : i + step]
            if (self.label[every] == self.label[part[0]]).all() and (self.label[part] == self.label[part[0]]).all():
                continue  # one group already: no comparison can add to it
            near = np.bitwise_count(self.prints[part][:, None] ^ self.prints[every][None, :]) <= bits
            near &= self.label[part][:, None] != self.label[every][None, :]
            x, y = np.nonzero(near)
            self.label = merged(self.label, part[x], every[y])

    def search(
        self, values: np.ndarray, home: np.ndarray, guests: np.ndarray, bits: int, radius: int, within: bool = True
    ) -> None:
        """Part the shard further, pruning by the triangle inequality, and compare what remains together."""
        todo = [(home, guests)]
        while todo:
            rows, others = todo.pop()
            if not len(rows) or not (within or len(others)):
                continue
            small = len(rows) * (len(rows) + len(others)) <= CELLS // 64
            choice = None if small else border_of(values[rows])
            if choice is None:
                self.compare(rows, others, bits, within)
                continue
            d, e = distances(values[rows], choice[0]), distances(values[others], choice[0])
            crossing = rows[(d <= choice[1]) & (d + radius > choice[1])] if within else rows[:0]
            todo.append((rows[d <= choice[1]], others[e - radius <= choice[1]]))
            todo.append((rows[d > choice[1]], np.concatenate([others[e + radius > choice[1]], crossing])))

    def links(self) -> pd.DataFrame:
        """Each print with the smallest of its group, where that is another."""
        signed = self.prints.astype(np.int64)
        order = np.lexsort((signed, self.label))
        first = np.ones(len(order), dtype=bool)
        first[1:] = self.label[order][1:] != self.label[order][:-1]
        least = signed[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        apart = least != signed[order]
        return pd.DataFrame({"a": signed[order][apart], "b": least[apart]})


def pooled(batches: Iterator[pd.DataFrame], size: int = POOL) -> Iterator[np.ndarray]:
    """Prints of several batches together."""
    pool: list[np.ndarray] = []
    for part in batches:
        pool.append(part["print"].to_numpy(np.int64))
        if sum(map(len, pool)) >= size:
            yield np.concatenate(pool)
            pool = []
    if pool:
        yield np.concatenate(pool)


def meetings(residents: int, visitors: int, chunk: int, home: bool) -> Iterator[tuple[int, int, bool]]:
    """Tasks (i, j) of a leaf that a print of this chunk goes to, and whether it lives there (True) or is a guest.

    Residents and visitors are dealt into chunks of their own, by their own numbers. Residents of chunk i meet one another and the
    first chunk of visitors in (i, i), residents of a later chunk j in (i, j), and visitors of a further chunk k in
    (i, residents + k - 1). So a task holds two or three chunks, however many prints live in a leaf or visit it.
    """
    if home:
        for j in range(chunk, residents + visitors - 1):
            yield chunk, j, True
        for i in range(chunk):
            yield i, chunk, False
    else:
        for i in range(residents):
            yield i, i if chunk == 0 else residents + chunk - 1, False


def dealt_prints(prints: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """``tree, leaf, i, j, print, home``: every print in each task it takes part in, as one that lives there or as a guest."""
    radius, total = bits // BLOCKS, prints.count()
    chosen = prints.orderBy(F.xxhash64("print"), "print").limit(SAMPLE_PRINTS).collect()  # at most SAMPLE_PRINTS longs
    sample = np.array([r[0] for r in chosen], dtype=np.int64).astype(np.uint64)
    size = max(16.0, shard * len(sample) / max(total, 1))
    trees, first = [], 0
    for b in range(BLOCKS):
        leaves = count(first)
        trees.append(grow(block_of(sample, b), size, leaves))
        first = next(leaves)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for signed in pooled(batches):
            values = signed.astype(np.uint64)
            found = [
                (leaf, home, len(rows))
                for b, tree in enumerate(trees)
                for leaf, rows, home in visits(tree, block_of(values, b), radius)
            ]
            yield pd.DataFrame(found, columns=["leaf", "home", "n"])

    counted = prints.mapInPandas(held, "leaf long, home boolean, n long").groupBy("leaf", "home").agg(F.sum("n").alias("n"))
    large = counted.where(F.col("n") > SHARD_CAP).collect()  # leaves only
    chunks = {(r.leaf, r.home): -(-r.n // SHARD_CAP) for r in large}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for signed in pooled(batches):
            values = signed.astype(np.uint64)
            mixed = (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            for b, tree in enumerate(trees):
                out = []
                for leaf, rows, home in visits(tree, block_of(values, b), radius):
                    n, guests = chunks.get((leaf, True), 1), chunks.get((leaf, False), 1)
                    own = (mixed[rows] % np.uint64(n if home else guests)).astype(np.int64)
                    for c in range(n if home else guests):
                        here = rows[own == c]
                        for i, j, lives in meetings(n, guests, c, home) if len(here) else ():
                            out.append((np.broadcast_to(np.array([leaf, i, j]), (len(here), 3)), here, np.full(len(here), lives)))
                places, rows, lives = (np.concatenate(x) for x in zip(*out, strict=True))
                columns = dict(zip(("leaf", "i", "j"), places.T, strict=True))
                yield pd.DataFrame({"tree": b, **columns, "print": signed[rows], "home": lives})

    return prints.mapInPandas(deal, "tree int, leaf long, i int, j int, print long, home boolean")


def print_links(prints: DataFrame, bits: int = BITS, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``print``) that connect all pairs within ``bits``."""
    radius = bits // BLOCKS

    def match(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        values = part["print"].to_numpy(np.int64).astype(np.uint64)
        home = part["home"].to_numpy(bool)
        groups = Groups(values)
        blocks = block_of(values, int(key[0]))
        groups.search(blocks, np.flatnonzero(home), np.flatnonzero(~home), bits, radius, within=key[2] == key[3])
        return groups.links()

    dealt = dealt_prints(prints, bits, shard)
    return dealt.groupBy("tree", "leaf", "i", "j").applyInPandas(match, "a long, b long")


def components(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """``print, component`` for each distinct fingerprint in ``rows`` (column ``print``): the component's smallest print."""
    # prints are narrow rows, but each is worth many visits: as many tasks as a shuffle has
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = stored(rows.select("print").distinct().repartition(tasks, "print"), "simhash-prints")
    labels = connected_components(print_links(prints, bits))
    out = prints.join(labels.withColumnRenamed("node", "print"), "print", "left")
    return out.select("print", F.coalesce("label", "print").alias("component"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """Id, fingerprint in hexadecimal and the smallest id of the component of each document."""
    prints = fingerprints()(field(text))["print"]
    rows = stored(docs.select(field(key).alias("id"), prints.alias("print")), "simhash-documents")
    least = rows.groupBy("print").agg(F.min("id").alias("least"))
    found = stored(components(rows, bits).join(least, "print"), "simhash-components")
    names = found.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = found.select("print", "component").join(names, "component").select("print", "component_id")
    out = rows.join(ids, "print")
    return out.select(
        F.col("id").alias(key),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One document of each component, with its own columns: the one with the smallest id (null last)."""
    prints = fingerprints()(field(text))["print"]
    names = ("simhash row", "simhash print")
    rows = docs.select("*", F.monotonically_increasing_id().alias(names[0]), prints.alias(names[1]))
    rows = stored(rows, "simhash-documents")
    small = rows.select(field(key).alias("id"), field(names[0]).alias("row"), field(names[1]).alias("print"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    least = small.groupBy("print").agg(F.min(place).alias("place"))
    chosen = components(small, bits).join(least, "print").groupBy("component").agg(F.min("place").alias("place"))
    kept = chosen.select(F.col("place.row").alias(names[0]))
    return rows.join(kept, names[0], "left_semi").select(*[field(c) for c in docs.columns])
