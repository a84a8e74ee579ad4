"""Encoding of texts with a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash over the vocabulary resolves whole pre-tokens
that are tokens; the misses are merged by a heap over linked bytes. Both give
what the vocabulary's own merge order gives. No special tokens are added and
their strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a .tiktoken file; ids are merge ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of byte strings to ids, by displacement.

    Keys fall into buckets by one hash; buckets, the fullest first, take the
    first displacement under which all their keys land on free slots, and those
    of one key name a slot that is left; n keys fill n slots. A lookup is one hash, one displacement and one comparison with
    the stored key, which turns keys that are not in the set into misses.
    """

    def __init__(self, items: dict[bytes, int]):
        self.keys: list[bytes] = [b""] * len(items)
        self.ids = np.zeros(len(items), np.int64)
        n = self.n = len(items)
        self.buckets = max(1, n // 3)
        self.shift = np.zeros(self.buckets, np.int64)
        groups: dict[int, list[tuple[int, int, bytes]]] = {}
        for key in items:
            h, a, b = self._hashes(key)
            groups.setdefault(h, []).append((a, b, key))
        taken = bytearray(n)
        free = 0
        for h, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                while taken[free]:
                    free += 1
                taken[free] = 1
                self.shift[h] = -free - 1
                self.keys[free], self.ids[free] = members[0][2], items[members[0][2]]
                continue
            d = 0
            while True:
                slots = {(a + d * b + (d // n)) % n for a, b, _ in members}
                if len(slots) == len(members) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[h] = d
            for a, b, key in members:
                s = (a + d * b + (d // n)) % n
                taken[s] = 1
                self.keys[s], self.ids[s] = key, items[key]
        self._shift, self._ids = self.shift.tolist(), self.ids.tolist()

    def _hashes(self, key: bytes) -> tuple[int, int, int]:
        x = xxhash.xxh3_128_intdigest(key)
        # the step must not share a factor with n for a bucket's keys to part
        return (x & 0xFFFFFFFF) % self.buckets, (x >> 32 & 0xFFFFFFFF) % self.n, 1 + (x >> 64 & 0xFFFFFFFF) % max(1, self.n - 1)

    def get(self, key: bytes) -> int:
        """The id of a key, -1 if it is not in the set."""
        if not self.n:
            return -1
        h, a, b = self._hashes(key)
        d = self._shift[h]
        s = (a + d * b + (d // self.n)) % self.n if d >= 0 else -d - 1
        return self._ids[s] if self.keys[s] == key else -1


def merge(piece: bytes, get) -> list[int]:
    """Ids of a pre-token that is no token: the pair of lowest rank merges first, the leftmost of equals.

    Bytes are a doubly linked list; a heap holds the ranks of neighbours that
    form a token. An entry is stale, and skipped, once either end has changed.
    """
    n = len(piece)
    nxt = list(range(1, n + 1))
    prv = list(range(-1, n - 1))
    end = list(range(1, n + 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r >= 0:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != e:
            continue
        alive[j] = False
        end[i], nxt[i] = e, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        if nxt[i] < n:
            r = get(piece[i : end[nxt[i]]])
            if r >= 0:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prv[i] >= 0:
            p = prv[i]
            r = get(piece[p:e])
            if r >= 0:
                heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(get(piece[i : end[i]]))
        i = nxt[i]
    return out


class Encoder:
    """Encodes texts; remembers the ids of up to ``memory`` pre-tokens of at most 64 characters."""

    def __init__(self, table: PerfectHash, memory: int = 100_000):
        self.table, self.memory = table, memory
        self.find = regex.compile(PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}

    def piece(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.table.get(raw)
        ids = (whole,) if whole >= 0 else tuple(merge(raw, self.table.get))
        if len(word) <= 64:
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        known = self.known.get
        for word in self.find(text or ""):
            out += known(word) or self.piece(word)
        return out


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: str, table: PerfectHash) -> Encoder:
    """One encoder per worker process and vocabulary, so its memory outlasts a task."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(table)
    return _ENCODERS[vocabulary]


def encode_texts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the token ids of each text; null and empty texts have an empty list.

    vocabulary: a .tiktoken file the driver can read; the hash made of it (one
    entry per token, so of a fixed size) is sent to the workers. One pass, no
    shuffle; texts are encoded whole.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(PerfectHash(load_ranks(vocabulary)))
    schema = docs.select(F.col(key), F.lit(None).cast("array<int>").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, table.value)
        for batch in batches:
            ids, ends = [], [0]
            for t in batch.column(1).to_pylist():
                ids += encoder.encode(t)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)
