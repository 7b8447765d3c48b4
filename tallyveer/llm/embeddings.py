"""Near-duplicate vectors through a pivot-permutation index.

Reference vectors (pivots) come from a bounded sample and lie well apart, seen from the origin or, so that vectors in a narrow cone
are told apart too, from the sample's mean. A vector is described by its pivots in order of cosine. It enters one inverted list per
combination of ``shared`` pivots among its ``nearest`` first ones, so two vectors meet if, and only if, they share that many. Only the
list of their smallest shared pivots verifies the cosine, in double precision, so each link is found once. Equal vectors are one
entry with a weight. Small lists travel together; a list over ``LIST_CAP`` entries is dealt out as pairs of chunks, so a
combination that many vectors share does not meet in one task. A list reports sums and one partner per entry, never its pairs.

The index is fitted on at most ``SAMPLE_VECTORS`` vectors; every vector is indexed. The number of pivots grows with the root of the table.
Origin or mean, the number of pivots, ``nearest`` and ``shared`` are chosen by what they cost at the table's size (pairs compared, copies of
vectors, pivots compared), among those that find a share ``PLANTED`` of partners planted just above the threshold beside the sample's
vectors, and all sampled links of a share ``WHOLE`` of them. If none does, or none compares fewer pairs than there are, one list holds
all vectors; so it is where most vectors are near-copies of most others and the links themselves are a large part of all
pairs. Recall against brute force is measured in the tests and stated in the README.

Defined results: vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing; shorter vectors count
as filled up with zeros; ties between pivots go to the earlier pivot; repeated rows link with one another; a component
without any id has a null component id; an empty table gives an empty result; other columns of the table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveer.llm.common import connected_components, field, merged, stored

COSINE = 0.9
#: Most pivots, and pivots per root of the table's size.
PIVOTS, PER_ROOT = 4096, 4
#: Lengths of the ordered prefixes that are tried, pivots that two vectors have to share, and lists per vector at most.
NEAREST = (4, 5, 6, 7, 8, 10, 12, 14, 16)
SHARED = (1, 2, 3, 4)
LISTS = 600
#: Pivots at most this similar to each other are taken first.
PIVOT_COSINE = 0.5
SAMPLE_VECTORS = 16_384
#: Share of planted partners that must be found, and of the sample's vectors whose links must all be; vectors that are asked.
PLANTED, WHOLE, PROBES = 0.99, 0.999, 2048
#: Compared pairs that take as long as bringing one more copy of a vector to a list, and as comparing it with a pivot.
PAIRS_PER_COPY, PAIRS_PER_PIVOT = 256, 2
LIST_CAP = 2048
#: Entries of small lists that one task takes together, about.
TOGETHER = 8192
#: Cells of one comparison in memory.
CELLS = 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(vectors: list, size: int) -> np.ndarray:
    """Rows of length one, filled up with zeros to ``size``; scaled first, so squares neither vanish nor overflow."""
    if vectors and all(len(v) == size for v in vectors):
        out = np.array(vectors, dtype=np.float64)
    else:
        out = np.zeros((len(vectors), size))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def directions(rows: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Rows of length one as seen from the mean; a row that is the mean has no direction."""
    away = rows - mean
    length = np.linalg.norm(away, axis=1, keepdims=True)
    return away / np.where(length > 0, length, 1)


def spread_pivots(sample: np.ndarray, fill: bool, pivots: int, cosine: float = PIVOT_COSINE) -> np.ndarray:
    """The first vectors of the sample that keep their distance from those taken before; to fill up, the farthest of the others."""
    taken, closest = [], np.full(len(sample), -2.0)
    while len(taken) < min(pivots, len(sample)):
        apart = closest <= cosine
        i = int(apart.argmax() if apart.any() else closest.argmin())
        if not apart[i] and (not fill or closest[i] >= 1 - 1e-9):  # copies of pivots are of no use
            break
        taken.append(i)
        np.maximum(closest, sample @ sample[i], out=closest)
        closest[i] = 2
    return sample[taken]


def whole(sample: np.ndarray, prefix: np.ndarray, pivots: int, cosine: float, needed: list[int]) -> list[float]:
    """Share of the sample's vectors with links that share enough pivots with all their partners."""
    words, good, asked = masks(prefix, pivots), np.zeros(len(needed)), 0
    step, last = max(1, CELLS // len(sample)), min(PROBES, len(sample))
    for i in range(0, last, step):
        near = sample[i : min(i + step, last)] @ sample.T >= cosine
        near[np.arange(len(near)), i + np.arange(len(near))] = False
        x, y = np.nonzero(near)
        least = np.full(len(near), prefix.shape[1])
        for j in range(0, len(x), CELLS // 16):
            a, b = x[j : j + CELLS // 16], y[j : j + CELLS // 16]
            np.minimum.at(least, a, np.bitwise_count(words[i + a] & words[b]).sum(axis=1))
        linked = near.any(axis=1)
        asked += int(linked.sum())
        good += [(least[linked] >= k).sum() for k in needed]
    return (good / asked if asked else good + 1).tolist()


def prefixes(rows: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Numbers of the nearest pivots in order, per row."""
    near = rows @ pivots.T
    if nearest >= len(pivots):
        return np.argsort(-near, axis=1, kind="stable")
    # the last one that counts; ties with it go to the earlier pivots
    least = np.partition(near, len(pivots) - nearest, axis=1)[:, [len(pivots) - nearest]]
    ties = (near == least) & (np.cumsum(near == least, axis=1) <= nearest - (near > least).sum(axis=1, keepdims=True))
    first = np.nonzero((near > least) | ties)[1].reshape(len(rows), nearest)
    order = np.argsort(-np.take_along_axis(near, first, axis=1), axis=1, kind="stable")
    return np.take_along_axis(first, order, axis=1)


def masks(prefix: np.ndarray, pivots: int) -> np.ndarray:
    """Each row's pivots as bits of 64-bit words."""
    words = np.zeros((len(prefix), -(-pivots // 64)), dtype=np.uint64)
    row = np.repeat(np.arange(len(prefix)), prefix.shape[1])
    flat = prefix.ravel()
    np.bitwise_or.at(words, (row, flat // 64), np.uint64(1) << (flat % 64).astype(np.uint64))
    return words


def lists(prefix: np.ndarray, pivots: int, shared: int) -> np.ndarray:
    """Numbers of the lists that rows enter: one per combination of ``shared`` of their pivots, the largest pivot leading."""
    ordered = np.sort(prefix, axis=1).astype(np.int64)
    chosen = np.array(list(combinations(range(prefix.shape[1]), shared)), dtype=np.int64)
    out = np.zeros((len(prefix), len(chosen)), dtype=np.int64)
    for k in reversed(range(shared)):
        out = out * pivots + ordered[:, chosen[:, k]]
    return out


@dataclass(frozen=True)
class Index:
    """The point that vectors are seen from, pivots, length of the ordered prefix, and pivots that candidates share."""

    mean: np.ndarray
    pivots: np.ndarray
    nearest: int
    shared: int

    def describe(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefixes and lists of rows of length one."""
        if not self.shared:
            return np.zeros((len(rows), 0), dtype=np.int64), np.zeros((len(rows), 1), dtype=np.int64)
        prefix = prefixes(directions(rows, self.mean), self.pivots, self.nearest)
        return prefix, lists(prefix, len(self.pivots), self.shared)


def planted(sample: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the sample and, for each, a partner just above the threshold in the direction of another one."""
    rng = np.random.default_rng(17)
    own, other = sample[rng.integers(0, len(sample), PROBES)], sample[rng.integers(0, len(sample), PROBES)]
    away = other - (own * other).sum(axis=1, keepdims=True) * own
    length = np.linalg.norm(away, axis=1)
    own, away = own[length > 1e-6], away[length > 1e-6] / length[length > 1e-6, None]
    at = rng.uniform(cosine, (3 * cosine + 1) / 4, (len(own), 1))
    return own, at * own + np.sqrt(1 - at**2) * away


def fitted(sample: np.ndarray, n: int, cosine: float) -> tuple[Index, float]:
    """The index for a table of ``n`` vectors and the pairs it compares per vector, as the sample has it."""
    origin, found = np.zeros(sample.shape[1]), []
    most = max(2, min(PIVOTS, int(PER_ROOT * n**0.5), len(sample) // 2))
    own, partner = planted(sample, cosine) if len(sample) else (sample, sample)
    for fill, mean in ((False, origin), (True, sample.mean(axis=0))) if len(sample) else ():
        seen = directions(sample, mean)
        spread = spread_pivots(seen, fill, most)
        for pivots in {len(spread): spread, -(-len(spread) // 4): spread[: -(-len(spread) // 4)]}.values():
            of, a, b = (prefixes(r, pivots, NEAREST[-1]) for r in (seen, directions(own, mean), directions(partner, mean)))
            for shared in SHARED:
                for nearest in NEAREST:
                    ways = comb(nearest, shared)
                    dearer = found and PAIRS_PER_COPY * ways >= min(f[0] for f in found)
                    if nearest > len(pivots) or ways > LISTS or dearer:
                        break
                    both = masks(a[:, :nearest], len(pivots)) & masks(b[:, :nearest], len(pivots))
                    if (np.bitwise_count(both).sum(axis=1) >= shared).mean() < PLANTED:
                        continue
                    together = np.unique(lists(of[:, :nearest], len(pivots), shared), return_counts=True)[1].astype(float)
                    pairs = float((together * (together - 1)).sum()) / len(sample) * (n / len(sample))
                    if pairs < n:
                        cost = pairs + PAIRS_PER_COPY * ways + PAIRS_PER_PIVOT * len(pivots)
                        found.append((cost, pairs, Index(mean, pivots, nearest, shared), of))
                    break  # longer prefixes cost more
    for _, pairs, index, of in sorted(found, key=lambda f: f[0]):
        if whole(sample, of[:, : index.nearest], len(index.pivots), cosine, [index.shared])[0] >= WHOLE:
            return index, pairs
    return Index(origin, sample[:1], 0, 0), float(n)  # one list of all vectors


def linked(rows: np.ndarray, below: np.ndarray, shared: int, home: int, within: bool, cosine: float) -> Iterator[tuple]:
    """Blocks of pairs of a list, or of two of its chunks, that link and whose smallest shared pivots name this list.

    ``below`` tells which of the pivots before the list's largest a row has: such pairs share just the list's others.
    """
    step = max(1, CELLS // len(rows))
    for i in range(0, home, step):
        block = slice(i, min(i + step, home))
        here = below[block] @ below.T == max(shared - 1, 0)
        if here.any():
            here &= rows[block] @ rows.T >= cosine
            x, y = np.nonzero(here)
            x += i
            once = (y > x) if within else (y >= home)
            yield x[once], y[once]


def link_lists(groups: DataFrame, size: int, cosine: float) -> DataFrame:
    """Per list and entry: weight of the entries it links with and the smallest node of its group there.

    ``groups`` has columns node, weight and vector, the vectors all usable and different.
    """
    n = groups.count()
    chosen = groups.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_VECTORS).select("vector").collect()
    index, _ = fitted(units([r[0] for r in chosen], size) if chosen else np.zeros((0, size)), n, cosine)
    n_pivots, shared = len(index.pivots), index.shared

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            prefix, keys = index.describe(units(part["vector"].tolist(), size))
            yield part.assign(prefix=list(prefix.astype(np.int32)), keys=list(keys))

    kind = groups.schema["vector"].dataType.simpleString()
    schema = f"node long, weight long, vector {kind}, prefix array<int>, keys array<long>"
    described = stored(groups.select("node", "weight", "vector").mapInPandas(describe, schema), "pivot-prefixes")
    counted = described.select(F.explode("keys").alias("key")).groupBy("key").count().where(F.col("count") > LIST_CAP)
    hot = stored(counted.select("key", F.ceil(F.col("count") / LIST_CAP).cast("int").alias("parts")), "pivot-hot-lists")

    entries = described.select("node", "weight", "vector", "prefix", F.explode("keys").alias("key")).join(hot, "key", "left")
    bins = -(-n * max(1, comb(index.nearest, shared)) // TOGETHER) or 1
    entries = entries.withColumn("bin", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("key"), F.lit(bins))).otherwise(-1 - F.col("key")))
    entries = entries.withColumn("parts", F.coalesce("parts", F.lit(1)))
    entries = entries.withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    # chunk c meets itself in (c, c), a later chunk in (c, j) and an earlier one in (i, c): a task holds two chunks at most
    own, tasks = F.col("own"), F.sequence(F.lit(0), F.col("parts") - 1)
    meets = F.transform(tasks, lambda t: F.struct(F.least(own, t).alias("i"), F.greatest(own, t).alias("j")))
    entries = entries.withColumn("task", F.explode(meets)).select("*", "task.i", "task.j")
    entries = entries.withColumn("home", F.col("i") == F.col("own")).drop("task", "parts", "own")

    def match(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "home", "node"], ascending=[True, False, True], ignore_index=True)
        within = key[1] == key[2]
        name, nodes, weight = part["key"].to_numpy(), part["node"].to_numpy(), part["weight"].to_numpy()
        all_rows, prefix = units(part["vector"].tolist(), size), np.array(part["prefix"].tolist(), dtype=np.int64).reshape(len(part), -1)
        ends = np.flatnonzero(np.diff(name, append=name[-1] - 1))
        begins = np.concatenate([[0], ends[:-1] + 1])
        degree, least = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
        for start, end in zip(begins.tolist(), (ends + 1).tolist(), strict=True):
            if end - start < 2:
                continue
            rows, count, at = all_rows[start:end], weight[start:end], nodes[start:end]
            largest = int(name[start]) // n_pivots ** max(shared - 1, 0) if shared else 0
            own = prefix[start:end]
            which, number = np.unique(own[own < largest], return_inverse=True)
            below = np.zeros((len(rows), len(which)), dtype=np.float32)
            below[np.nonzero(own < largest)[0], number] = 1
            home = int(part["home"].to_numpy()[start:end].sum())
            links, label = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
            for a, b in linked(rows, below, shared, home, within, cosine):
                links += np.bincount(a, count[b], len(rows)).astype(np.int64) + np.bincount(b, count[a], len(rows)).astype(np.int64)
                label = merged(label, a, b)
            first = np.full(len(rows), np.iinfo(np.int64).max)
            np.minimum.at(first, label, at)
            degree[start:end], least[start:end] = links, first[label]
        found = degree > 0
        return pd.DataFrame({"node": nodes[found], "degree": degree[found], "partner": least[found]})

    return entries.groupBy("bin", "i", "j").applyInPandas(match, "node long, degree long, partner long")


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """Id, number of vectors linked directly, smallest id of the component, and whether that is the vector itself."""
    rows = vectors.select(field(key).alias("id"), field(column).alias("vector"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows.withColumn("usable", usable(F.col("vector"))), "vectors")
    good = rows.where("usable")
    groups = good.groupBy("vector").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    groups = stored(groups, "vector-groups")
    size = groups.agg(F.max(F.size("vector"))).first()[0] or 1
    found = stored(link_lists(groups, size, cosine), "vector-links")
    degrees = found.groupBy("node").agg(F.sum("degree").alias("degree"))
    labels = connected_components(found.select(F.col("node").alias("a"), F.col("partner").alias("b")))
    known = groups.join(degrees, "node", "left").join(labels, "node", "left")
    known = known.select(
        "vector",
        "least",
        (F.coalesce("degree", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("label", "node").alias("label"),
    )
    known = stored(known, "vector-components")
    names = known.groupBy("label").agg(F.min("least").alias("component_id"))
    known = known.join(names, "label").select("vector", "n_links", "component_id")
    linked = good.join(known, "vector").select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.union(alone).select(F.col("id").alias(key), "n_links", "component_id", kept.alias("kept"))
