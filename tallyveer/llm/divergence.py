"""Divergence audit: how far the sources of a language differ in their words, and which words tell them apart.

Terms are counted by sorting pointers. A task takes its texts in shards of some megabytes as Arrow hands them over, and builds a
pointer to every word's start in the shard's byte buffer. The pointers are sorted by multikey quicksort: by the next eight
bytes of their words, then every slice of equal bytes whose words go on by the eight after them. Equal words end up in a run;
along a run, the documents a word occurs in and its occurrences per source are counted. The runs of all shards are summed in Spark.

A term is kept in a language if enough of its documents have it. A group (language and source) and a language give every
kept term a share of their occurrences, smoothed and scaled to whole numbers, so all results are exact. Two sources differ by the sum of
``f = (p - q)^2 div (p + q)`` over all kept terms; a term marks a source by ``f`` against its language where it is more common.

Pairs of sources are the result, so their number is what it is; pairs of documents are never made. The kept terms of a language are
dealt into blocks; a block holds a bounded table of terms and sources, from which one task adds up all pairs.

Defined results: null text, language and source count as empty; a group without terms has the smoothed shares; in a language
without kept terms all pairs have 0; a text of any length is cut into pieces between words, and still counts as one document;
ties are ranked by the item's bytes; repeated rows count each; an empty table gives an empty result. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyveer.llm.common import field, stored

#: Documents of a language that must have a term.
LEAST_DOCS = 10
#: Terms listed per group.
TOP = 10
#: Bytes of text whose pointers are sorted together, about.
SHARD_BYTES = 4 << 20
#: Keys of eight bytes by which pointers are compared before the rest of their words is.
DEPTH = 8
#: Cells (terms by sources) of a block, about.
BLOCK_CELLS = 1 << 16
#: The scale of shares is the product of these two: shares are divided in two steps, within 64 bits up to 2.8e14 occurrences.
STEPS = (31_250, 32_000)

#: Bytes of terms: letters and everything beyond ASCII; only A to Z are lower-cased.
TERM_BYTE = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
LOWER_BYTE = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: The first n bytes of a key of eight.
KEPT_BYTES = np.array([((1 << 64) - 1) ^ ((1 << (64 - 8 * n)) - 1) for n in range(9)], dtype=np.uint64)

COUNTS = "lang string, source string, term string, n long, docs long"


def word_pointers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every word; no word crosses one of ``bounds``, where documents begin."""
    inside = TERM_BYTE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[bounds] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts


def keys_at(padded: np.ndarray, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each start as a number that sorts as they do; ``left`` bytes belong to the word."""
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    keys = windows[starts].view(">u8").ravel().astype(np.uint64)
    return keys & KEPT_BYTES[np.clip(left, 0, 8)]


def sorted_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in order of their words, and whether each begins a run of equal words.

    A level sorts by the next key inside the slices that are equal so far, and goes on with the slices whose keys are full: words of
    at least eight more bytes. Slices left after ``depth`` keys are sorted by the rest of their words.
    """
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    keys = keys_at(padded, starts, lengths)
    order = np.argsort(keys)
    keys = keys[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = keys[1:] != keys[:-1]
    full, level = (keys & np.uint64(0xFF)) != 0, 1
    active = np.flatnonzero(full & ~(head & np.append(head[1:], True)))
    while len(active) and level < depth:
        slices = np.cumsum(head)[active]
        words = order[active]
        keys = keys_at(padded, np.minimum(starts[words] + 8 * level, len(data)), lengths[words] - 8 * level)
        inner = np.lexsort((keys, slices))  # slices stay in place, in ascending order
        keys, slices = keys[inner], slices[inner]
        order[active] = words[inner]
        new = np.ones(len(active), dtype=bool)
        new[1:] = (keys[1:] != keys[:-1]) | (slices[1:] != slices[:-1])
        head[active] = new
        alone = new & np.append(new[1:], True)
        active, level = active[((keys & np.uint64(0xFF)) != 0) & ~alone], level + 1
    if len(active):
        slices = np.cumsum(head)[active]
        rest = [data[starts[w] + 8 * level : starts[w] + lengths[w]].tobytes() for w in order[active]]
        inner = sorted(range(len(active)), key=lambda i: (slices[i], rest[i]))
        order[active] = order[active][inner]
        pairs = [(slices[i], rest[i]) for i in inner]
        head[active] = [i == 0 or pairs[i] != pairs[i - 1] for i in range(len(pairs))]
    return order, head


def words_at(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a : a + n].decode("utf-8", "replace") for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def shard_counts(data: np.ndarray, bounds: np.ndarray, groups: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a shard in order, and of each word and group that has it: (word, group), occurrences, documents.

    ``bounds`` are where documents begin, and the end; ``groups`` the group number of each document. The second array holds word
    times number of groups plus group.
    """
    starts, lengths = word_pointers(data, bounds)
    if not len(starts):
        return [], *[np.zeros(0, dtype=np.int64)] * 3
    order, head = sorted_runs(data, starts, lengths)
    word = np.empty(len(order), dtype=np.int64)
    word[order] = np.cumsum(head) - 1
    firsts = order[head]
    # documents in order of their groups, so that a run lists a group's documents together
    docs, by_group = len(groups), np.argsort(groups, kind="stable")
    place = np.empty(docs, dtype=np.int64)
    place[by_group] = np.arange(docs)
    held = np.diff(np.searchsorted(starts, bounds))
    pairs = np.sort(word * docs + np.repeat(place, held))
    begins = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    times, pairs = np.diff(np.append(begins, len(pairs))), pairs[begins]
    many = int(groups.max()) + 1
    cell = pairs // docs * many + groups[by_group][pairs % docs]
    begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    return (
        words_at(data, starts[firsts], lengths[firsts]),
        cell[begins],
        np.add.reduceat(times, begins),
        np.diff(np.append(begins, len(cell))),
    )


def pieces(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """A long text cut between words into pieces of about ``size`` bytes."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and TERM_BYTE[data[end]]:
            ahead = np.flatnonzero(~TERM_BYTE[data[end : end + size]])
            end = end + int(ahead[0]) if len(ahead) else min(end + size, len(data))
        yield data[at:end]
        at = end


def counted(batches: Iterator[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents per language, source and term of each shard of (lang, source, text)."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.column(2).nbytes
        if size >= shard_bytes:
            yield from shards_of(waiting, shard_bytes)
            waiting, size = [], 0
    if waiting:
        yield from shards_of(waiting, shard_bytes)


def shards_of(batches: list[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """The counts of each run of documents of about ``shard_bytes``, or of one longer document in pieces."""
    table = pa.Table.from_batches(batches).combine_chunks()
    if not table.num_rows:
        return
    pairs = pa.StructArray.from_arrays([table.column(i).combine_chunks() for i in (0, 1)], ["lang", "source"])
    names = pd.MultiIndex.from_arrays([pairs.field(0).to_pandas(), pairs.field(1).to_pandas()])
    groups, known = names.factorize()
    texts = table.column(2).combine_chunks().cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(int(np.searchsorted(offsets, offsets[at] + shard_bytes, "right")) - 1, at + 1)
        shard = LOWER_BYTE[data[offsets[at] : offsets[end]]]
        if end == at + 1 and len(shard) > shard_bytes:
            total: Counter[str] = Counter()
            for piece in pieces(shard, shard_bytes):
                words, _, times, _ = shard_counts(piece, np.array([0, len(piece)]), np.zeros(1, dtype=np.int64))
                total.update(dict(zip(words, times.tolist(), strict=True)))
            cells = np.full(len(total), groups[at])
            out = cells, list(total), list(total.values()), np.ones(len(total), dtype=np.int64)
        else:
            here = groups[at:end]
            words, cell, times, docs = shard_counts(shard, offsets[at : end + 1] - offsets[at], here)
            many = int(here.max()) + 1
            out = cell % many, pa.array(words, pa.string()).take(pa.array(cell // many)), times, docs
        cells, terms, times, docs = out
        where = known[cells]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(where.get_level_values(0), pa.string()),
                pa.array(where.get_level_values(1), pa.string()),
                terms if isinstance(terms, pa.Array) else pa.array(terms, pa.string()),
                pa.array(times, pa.int64()),
                pa.array(docs, pa.int64()),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )
        at = end


def groups_of(docs: DataFrame, lang: str, source: str) -> list[Column]:
    return [F.coalesce(field(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]


def term_counts(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term in every group."""
    rows = docs.select(*groups_of(docs, lang, source), F.coalesce(field(text), F.lit("")).alias("text"))
    parts = rows.mapInArrow(lambda batches: counted(batches, shard_bytes), COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + 10^9 (count + 2) div (total + 2 terms)``, exact; 1 where there are no terms."""
    whole = total + 2 * terms
    first, then = STEPS
    scaled = (count + 2) * F.lit(first).cast("long")
    rest = F.call_function("div", (scaled % whole) * F.lit(then).cast("long"), whole)
    return F.when(whole == 0, F.lit(1).cast("long")).otherwise(1 + F.call_function("div", scaled, whole) * then + rest)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(block: pd.DataFrame) -> pd.DataFrame:
    """Distances of all pairs of sources over the terms of a block; rows without term give a source's share of absent terms."""
    absent = block[block["term"].isna()].sort_values("source")
    sources = pd.Index(absent["source"])
    given = block[block["term"].notna()]
    terms, known = pd.factorize(given["term"])
    table = np.tile(absent["p"].to_numpy(np.int64), (len(known), 1))
    table[terms, sources.get_indexer(given["source"])] = given["p"].to_numpy(np.int64)
    found = []
    for i in range(len(sources) - 1):
        mine, others = table[:, i : i + 1], table[:, i + 1 :]
        apart = mine - others
        sums = (apart * apart // (mine + others)).sum(axis=0)
        found.append(pd.DataFrame({"a": sources[i], "b": sources[i + 1 :], "value": sums}))
    out = pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "value": []})
    out.insert(0, "lang", block["lang"].iloc[0])
    return out.astype({"value": "int64"})


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
    block_cells: int = BLOCK_CELLS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances of a group to the other sources, and its ``top`` terms."""
    counts = stored(term_counts(docs, text, lang, source, shard_bytes), "divergence-counts")
    word = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"held": F.sum("docs").over(word), "total": F.sum("n").over(word)})
    kept = stored(kept.where(F.col("held") >= least_docs).drop("docs", "held"), "divergence-kept")

    words = kept.groupBy("lang").agg(F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select(*groups_of(docs, lang, source)).distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(words, ["lang"], "left")
    groups = groups.na.fill(0, ["group_n", "terms", "lang_n"])
    many = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") * many / block_cells)).cast("int")
    groups = stored(groups.withColumn("blocks", blocks), "divergence-groups")

    full = kept.join(groups, ["lang", "source"])
    p = share(F.col("n"), F.col("group_n"), F.col("terms"))
    q = share(F.col("total"), F.col("lang_n"), F.col("terms"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    full = full.select("lang", "source", "term", block.alias("block"), p.alias("p"), q.alias("q"))

    marks = full.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = marks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    absent = groups.select(
        "lang",
        "source",
        F.lit(None).cast("string").alias("term"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        share(F.lit(0).cast("long"), F.col("group_n"), F.col("terms")).alias("p"),
    )
    cells = full.drop("q").unionByName(absent)
    pairs = cells.groupBy("lang", "block").applyInPandas(pair_sums, "lang string, a string, b string, value long")
    pairs = stored(pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "divergence-pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(
        pairs.select("lang", "b", "a", "value")
    )
    both = both.withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        both.withColumn("part", F.lit("pair")).select(columns).union(marks.withColumn("part", F.lit("term")).select(columns))
    )
