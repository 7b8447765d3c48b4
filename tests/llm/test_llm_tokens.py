"""Byte-level BPE and packing."""

from __future__ import annotations

import hashlib
import itertools
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyveer.llm import bpe, packing

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    ranks = bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids_match_plain_encoding_on_odd_texts(plain):
    rng = random.Random(1)
    pieces = ["a", "aa", "Ä", "é", "漢字", "🙂", "‍", "\r\n", "  ", "\t", "'s", "'re", "1", "42", "!", "\x00", "́", "ﬁ", " "]
    texts = ["".join(rng.choice(pieces) * rng.randint(1, 4) for _ in range(rng.randint(0, 12))) for _ in range(5000)]
    texts += ["a" * 20_000, " " * 5000, "<|endoftext|>", "퟿"]
    codec = bpe.codec(PATH, PATTERN)
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == plain(t)
        assert codec.decode(ids) == t.encode()


def test_ids_match_plain_encoding_for_all_characters(plain):
    chars = [chr(c) for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b1{c}{c} {c}'s \n{c}" for c in chars]
    for t, ids in zip(texts, bpe.codec(PATH, PATTERN).encode(texts), strict=True):
        assert ids == plain(t), hex(ord(t[1]))


def test_offsets_cover_the_characters_of_each_token():
    texts = ["Grüße 漢字🙂 end", "a🙂b"]
    codec = bpe.codec(PATH, PATTERN)
    for t, (ids, at) in zip(texts, codec.encode_with_offsets(texts), strict=True):
        assert at[0][0] == 0 and at[-1][1] == len(t)
        for i, (a, b) in zip(ids, at, strict=True):
            assert codec.decode([i]) in t[a:b].encode()


def test_query_and_round_trip_on_edges(edges, sample, nothing, plain):
    for docs in (edges, sample.limit(100)):
        rows = {(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs, PATH, PATTERN).collect()}
        want = set()
        for r in docs.select("doc_id", "text").collect():
            t = r.text or ""
            ids = plain(t)
            digests = hashlib.sha256(",".join(map(str, ids)).encode()), hashlib.sha256(t.encode())
            want.add((str(r.doc_id), len(ids), *(d.hexdigest() for d in digests)))
        assert rows == want
    back = bpe.decode(bpe.encode(edges.where("doc_id < 5"), PATH, PATTERN), PATH, PATTERN)
    texts = {r.doc_id: r.text or "" for r in edges.collect()}
    assert all(r.text == texts[r.doc_id] and bytes(r.data) == r.text.encode() for r in back.collect())
    assert bpe.round_trip_digests(nothing, PATH, PATTERN).count() == bpe.encode(nothing, PATH, PATTERN).count() == 0


def test_cut_characters_decode_to_replacement_marks(spark):
    ids = bpe.codec(PATH, PATTERN).tokenizer.encode("🙂").ids
    rows = spark.createDataFrame([(1, ids[:1]), (2, None)], "doc_id long, ids array<int>")
    out = {r.doc_id: r for r in bpe.decode(rows, PATH, PATTERN).collect()}
    assert out[1].text == "�" and "🙂".encode().startswith(bytes(out[1].data)) and out[2].text == ""


def test_borders_have_the_least_padding():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.randint(0, 30) for _ in range(rng.randint(1, 40)))
        kinds = sorted(set(lengths))
        bins = [(k, lengths.count(k), k * lengths.count(k), k) for k in kinds]
        n = rng.randint(1, 4)
        plan = packing.best_buckets(bins, n)
        best = min(
            sum(min(e for e in [*ends, kinds[-1]] if e >= x) - x for x in lengths)
            for k in range(min(n, len(kinds)))
            for ends in itertools.combinations(kinds[:-1], k)
        )
        assert plan.padding == best and sum(plan.rows) == len(lengths)
        assert sum(min(e for e in plan.lengths if e >= x) - x for x in lengths) == best


@pytest.mark.parametrize("part_rows", [4096, 7])
def test_batches_hold_every_document_once_within_the_budget(edges, sample, nothing, part_rows):
    for docs in (edges, sample):
        rows = packing.pack(docs, budget=2000, part_rows=part_rows).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
        batches: dict = {}
        for r in rows:
            assert r.padding == r.bucket_length - r.n_tokens >= 0
            batches.setdefault(r.batch_id, []).append(r)
        for batch in batches.values():
            assert len({r.bucket for r in batch}) == 1
            assert sorted(r.place for r in batch) == list(range(len(batch)))
            assert len(batch) == 1 or len(batch) * batch[0].bucket_length <= 2000
    assert packing.pack(nothing).count() == 0


def test_lengths_and_padding_of_the_table(sample):
    rows = packing.pack(sample).collect()
    lengths = sorted(len([w for w in (r.text or "").encode().split()]) for r in sample.collect())
    assert sorted(r.n_tokens for r in rows) == lengths
    bins: dict[int, list[int]] = {}
    for x, b in sample.select(packing.length_of(F.col("text")).alias("n")).select("n", packing.bin_of(F.col("n"))).collect():
        bins.setdefault(b, []).append(x)
    plan = packing.best_buckets([(b, len(v), sum(v), max(v)) for b, v in bins.items()])
    assert sum(r.padding for r in rows) == plan.padding


def test_texts_without_blanks_are_packed_by_their_bytes(make_docs):
    texts = ["漢字" * n for n in range(0, 3000, 50)] + ["x" * 40_000, None, "ab cd"]
    rows = packing.pack(make_docs(list(enumerate(texts))), budget=4096, length=packing.by_bytes).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: -(-len((t or "").encode()) // 4) for i, t in enumerate(texts)}
    batches: dict = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    assert all(len(b) == 1 or len(b) * b[0].bucket_length <= 4096 for b in batches.values())
    assert [len(b) for b in batches.values() if b[0].n_tokens == 10_000] == [1]
    words = packing.pack(make_docs(list(enumerate(texts))), budget=4096)
    assert {r.n_tokens for r in words.collect()} == {0, 1, 2}
