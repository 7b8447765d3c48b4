"""Sharding: indivisible groups of rows packed into shards by best fit, largest first.

Rows with equal texts are a group and stay together. Groups sorted by size enter the shard with the least room that still
holds them; shards stand in a balanced tree by room, so each step is one search. With a capacity, a new shard opens when none
has room, which keeps their number low. With a number of shards, the least capacity that fits into so many is looked for, so
their sizes come out nearly equal; a group beyond an even share gets a shard of its own, and the others share the rest.

The driver sees the histogram of group sizes, not the groups: groups of one size are alike, so the packing places them
by the count and says how many go where; inside Spark each group takes the place of its rank. Sizes up to ``EXACT`` have a
class each; beyond it, ``PER_DOUBLING`` classes a doubling, and a class counts with its largest group, so no capacity
is exceeded. Ranks are taken in parts of about ``PART_ROWS``, so neither a common size nor a large shard meets in one task; the
histogram has a row per class and part, which is what the driver's memory grows with.

Defined results: a null text counts as empty: size 1, checksum 0, a group with the empty texts; a null id is a row like any other;
repeated rows are placed each; groups of one size go by their digest, rows of a shard are numbered in an order fixed by
the stored table; a group larger than the given capacity is a shard of its own; an empty table gives an empty
result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyveer.llm.common import field, stored

#: Sizes with a class of their own, and classes per doubling beyond them.
EXACT = 4096
PER_DOUBLING = 1024
SHARDS = 8
#: Groups, or rows of a shard, that one task orders, about.
PART_ROWS = 16_384


class RoomTree:
    """Shards by room, as an AVL tree of ``(room, shard)``: insertion, removal and the least room that suffices."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, left, right, height]

    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    def _level(self, node: list) -> list:
        """The subtree with its two sides at most one apart in height."""
        lean = self._height(node[1]) - self._height(node[2])
        if abs(lean) > 1:
            near, far = (1, 2) if lean > 1 else (2, 1)
            child = node[near]
            if self._height(child[far]) > self._height(child[near]):
                node[near] = self._turned(child, far, near)
            return self._turned(node, near, far)
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        return node

    def _turned(self, node: list, near: int, far: int) -> list:
        """The ``near`` child becomes the parent."""
        child = node[near]
        node[near], child[far] = child[far], node
        for n in (node, child):
            n[3] = 1 + max(self._height(n[1]), self._height(n[2]))
        return child

    def _path(self, key: tuple[int, int]) -> list[tuple[list, int]]:
        """Nodes above the key's place, each with the side that leads on."""
        path, node = [], self.root
        while node and node[0] != key:
            side = 1 if key < node[0] else 2
            path.append((node, side))
            node = node[side]
        return path

    def _hang(self, path: list[tuple[list, int]], node: list | None) -> None:
        """Put ``node`` at the end of the path and level every subtree on the way up."""
        for above, side in reversed(path):
            above[side] = node
            node = self._level(above)
        self.root = node

    def add(self, room: int, shard: int) -> None:
        self._hang(self._path((room, shard)), [(room, shard), None, None, 1])

    def remove(self, room: int, shard: int) -> None:
        path = self._path((room, shard))
        node = path[-1][0][path[-1][1]] if path else self.root
        if node[1] and node[2]:  # its successor takes its place
            path.append((node, 2))
            low = node[2]
            while low[1]:
                path.append((low, 1))
                low = low[1]
            node[0] = low[0]
            node = low
        self._hang(path, node[1] or node[2])

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least room of ``size`` or more, with its shard."""
        best, node = None, self.root
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best


def best_fit(items: Sequence[tuple[int, int]], capacity: int) -> list[list[tuple[int, int]]]:
    """Per item ``(size, how many)``, in descending sizes: the shards they enter, as ``(shard, how many)``.

    Equal sizes are placed together: after one enters the tightest shard, that one is the tightest for the next as long as it fits.
    """
    rooms, opened, places = RoomTree(), 0, []
    for size, many in items:
        place = []
        while many:
            found = rooms.tightest(size)
            if found is None:
                room, shard = max(capacity, size), opened
                opened += 1
            else:
                room, shard = found
                rooms.remove(room, shard)
            take = min(many, room // size)
            many -= take
            place.append((shard, take))
            if room > take * size:
                rooms.add(room - take * size, shard)
        places.append(place)
    return places


def shards_used(places: Sequence[Sequence[tuple[int, int]]]) -> int:
    return 1 + max((s for place in places for s, _ in place), default=-1)


def even_shards(items: Sequence[tuple[int, int]], shards: int) -> list[list[tuple[int, int]]]:
    """As :func:`best_fit` with the least capacity found that needs at most ``shards``."""
    rest, total, alone = [list(i) for i in items], sum(s * n for s, n in items), []
    left = shards
    for i, (size, many) in enumerate(items):
        own = 0
        while own < many and left > 1 and size * left > total:
            own, left, total = own + 1, left - 1, total - size
        alone.append(own)
        rest[i][1] -= own
        if own < many:
            break
    alone += [0] * (len(items) - len(alone))
    largest = max((s for s, n in rest if n), default=0)
    low = max(-(-total // left), largest)
    high = low + largest  # always enough: a shard without room for a group would be filled beyond an even share
    places = best_fit(rest, high)
    while low < high:
        middle = (low + high) // 2
        tried = best_fit(rest, middle)
        if shards_used(tried) <= left:
            high, places = middle, tried
        else:
            low = middle + 1
    first = sum(alone)
    owners = iter(range(first))
    return [
        [(next(owners), 1) for _ in range(own)] + [(shard + first, n) for shard, n in place]
        for own, place in zip(alone, places, strict=True)
    ]


def class_of(size: Column) -> Column:
    """Number of the size class, growing with the size."""
    beyond = F.floor(F.log2(size / F.lit(EXACT)) * PER_DOUBLING).cast("long")
    return F.when(size <= EXACT, size).otherwise(EXACT + 1 + beyond)


def part_of(digest: Column, rows: Column, part_rows: int) -> Column:
    """One of as many parts as ``rows`` need."""
    return F.pmod(F.xxhash64(digest), F.ceil(rows / part_rows).cast("long"))


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, size, crc, digest, row`` of every row."""
    value = F.coalesce(field(text), F.lit(""))
    return docs.select(
        field(key).alias("id"),
        (F.octet_length(value) + F.lit(1)).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("crc"),
        F.unhex(F.sha2(value, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )


def segments(bins: Sequence[tuple[int, int, int, int]], capacity: int | None, shards: int) -> Iterator[tuple]:
    """Per class and part ``(class, part, ends, shards)``: the ranks below ``ends[i]`` go to ``shards[i]``.

    ``bins`` are rows of (class, part, groups, largest size); a class counts with its largest group.
    """
    largest: dict[int, int] = {}
    for number, _, _, size in bins:
        largest[number] = max(size, largest.get(number, 0))
    bins = sorted(bins, key=lambda b: (-b[0], b[1]))
    items = [(largest[number], many) for number, _, many, _ in bins]
    places = even_shards(items, shards) if capacity is None else best_fit(items, capacity)
    for (number, part, _, _), place in zip(bins, places, strict=True):
        ends, at = [], 0
        for _, many in place:
            at += many
            ends.append(at)
        yield number, part, ends, [shard for shard, _ in place]


def shard(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int | None = None,
    shards: int = SHARDS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Id, size, checksum, shard and slot (from 0 in each shard) of every row.

    With ``capacity`` in bytes, as few shards as best fit finds; otherwise ``shards`` of nearly equal sizes.
    """
    spark = docs.sparkSession
    rows = stored(measured(docs, key, text), "sharding-rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    groups = stored(groups.withColumn("class", class_of(F.col("bytes"))), "sharding-groups")
    sizes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("many"))
    groups = stored(
        groups.join(sizes, "class").withColumn("part", part_of(F.col("digest"), F.col("many"), part_rows)), "sharding-parts"
    )
    bins = groups.groupBy("class", "part").agg(F.count(F.lit(1)), F.max("bytes"), F.sum("rows")).collect()
    plan = list(segments([tuple(b)[:4] for b in bins], capacity, shards))
    places = spark.createDataFrame(plan, "class long, part long, ends array<long>, shards array<int>")
    rank = F.row_number().over(Window.partitionBy("class", "part").orderBy("digest"))
    ranked = groups.select("digest", "class", "part", rank.alias("rank")).join(places, ["class", "part"])
    before = F.size(F.filter("ends", lambda end: end < F.col("rank")))
    placed = ranked.select("digest", F.get("shards", before).alias("shard"))

    total = sum(b[4] for b in bins)
    part = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-total // part_rows))))
    rows = rows.join(placed, "digest").select("id", "size", "crc", "shard", "row", part.alias("part"))
    rows = stored(rows, "sharding-placed")
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("held"))
    held = held.select("shard", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    rows = rows.withColumn("inside", inside).join(held, ["shard", "part"])
    return rows.select(
        F.col("id").alias(key),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("inside") + F.col("before")).alias("slot"),
    )
