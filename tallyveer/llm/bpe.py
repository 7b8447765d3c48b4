"""Byte-level BPE: encoding and decoding by a rank table, through the tokenizers library over Arrow batches.

A rank table maps byte strings to ids; a pair merges if its joined bytes have an id, the smallest id first. The library
wants characters and a merge list instead, so each byte is written as one printable character and every split of a known
string into two known strings becomes a merge, in order of its result. Offsets are in code points: all tokens that share
a character split between them carry that character's range. Decoding reverses the byte table; bytes that do not form a
character (a cut between tokens) become U+FFFD in text and stay as they are in bytes.

Defined results: a null text counts as empty and has no ids; an unknown id in a decoding is an error; repeated rows are
encoded alike; texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from tallyveer.llm.common import per_batch, scored

#: Code points that are handed to the library at once.
CHUNK = 1 << 20


def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [chr(b).isprintable() and chr(b) != " " for b in range(256)]
    later = iter(range(256, 512))
    return [chr(b) if own[b] else chr(next(later)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one rank table and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        shown = byte_characters()
        text = {k: "".join(shown[b] for b in k) for k in ranks}
        merges = [
            (text[k[:i]], text[k[i:]])
            for k in sorted(ranks, key=ranks.__getitem__)
            for i in range(1, len(k))
            if k[:i] in ranks and k[i:] in ranks
        ]
        vocab = {text[k]: r for k, r in ranks.items()}
        self.tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        byte_of = {c: b for b, c in enumerate(shown)}
        self.bytes_of = {r: bytes(byte_of[c] for c in t) for t, r in vocab.items()}
        self.name_of = {r: str(r) for r in self.bytes_of}

    def _batches(self, texts: list[str]) -> Iterator[list[str]]:
        batch, size = [], 0
        for t in texts:
            batch.append(t)
            size += len(t)
            if size >= CHUNK:
                yield batch
                batch, size = [], 0
        if batch:
            yield batch

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for batch in self._batches(texts):
            for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                yield e.ids

    def encode_with_offsets(self, texts: list[str]) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
        for batch in self._batches(texts):
            for e in self.tokenizer.encode_batch(batch, add_special_tokens=False):
                yield e.ids, e.offsets

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, token ids and the code-point range of each token. ``path`` must exist on every executor."""

    def make():
        c = codec(path, pattern)
        return lambda texts: (
            (ids, [a for a, _ in at], [b for _, b in at])
            for ids, at in c.encode_with_offsets(["" if t is None else t for t in texts])
        )

    return scored(docs, per_batch(make, "ids array<int>, starts array<int>, ends array<int>"), key, text)


def decode(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Id, bytes and text of each list of token ids; a null list decodes to nothing."""

    def make():
        c = codec(path, pattern)

        def one(values) -> tuple[bytes, str]:
            data = b"" if values is None else c.decode([int(i) for i in values])
            return data, data.decode("utf-8", "replace")

        return lambda lists: map(one, lists)

    return scored(rows, per_batch(make, "data binary, text string"), key, ids)


def round_trip_digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count, digest of the ids and digest of the bytes that the ids decode to, in one pass over the texts."""

    def make():
        c = codec(path, pattern)
        name = c.name_of.__getitem__
        return lambda texts: (
            (
                len(ids),
                hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest(),
                hashlib.sha256(c.decode(ids)).hexdigest(),
            )
            for ids in c.encode(["" if t is None else t for t in texts])
        )

    return scored(docs, per_batch(make, "n_tokens long, ids_sha256 string, decoded_sha256 string"), key, text)
