"""Evaluation texts that leak into a corpus, by pigeonhole edit matching.

With k words that may be lost and k + t pieces of a test item, t pieces at least
survive in any copy. Pieces are words, since a word that is added can part any
longer piece, and the item's rarest are taken, so that few documents have t of
them. Where the item's words stand closely enough in a document, a bit-parallel
edit distance over words (Myers) verifies the copy. Long passages that are kept word by word are found by the
same lookup with no error allowed, where the piece is the passage.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.llm.lookalike import looks
from orderloom.session import cut

_TAG = regex.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")

#: Items, and characters of their texts, per pass over the corpus; the index of one block is sent to the workers.
BLOCK, BLOCK_CHARS = 20_000, 20_000_000


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits; case, tags and differences that can't be seen don't count."""
    if not text:
        return []
    seen = looks(_TAG.sub(" ", text) if "<" in text else text)
    if seen.isascii():
        return _ASCII_WORD.findall(seen.lower())
    return _WORD.findall(unicodedata.normalize("NFC", seen).lower())


def distances(pattern: dict[int, int], m: int, text: list[int]) -> Iterator[int]:
    """Least edit distance of the pattern to a part of the text that ends before each place, from the start on.

    pattern: the bits at which each word stands. Bits are Python integers, so
    patterns of any length take one step per word of the text.
    """
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    yield score
    for c in text:
        eq = pattern.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        yield score


def nearest(pattern: dict[int, int], m: int, text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and where the first such part ends."""
    return min((d, end) for end, d in enumerate(distances(pattern, m, text)))


def kept_in_order(pattern: dict[int, int], m: int, text: list[int]) -> int:
    """Most words of the pattern that stand in the text in order (bit-parallel)."""
    full = v = (1 << m) - 1
    for c in text:
        u = v & pattern.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


class LeakIndex:
    """Passages, pieces and words of a block of test items."""

    def __init__(self, items: list[tuple[int, str]], run: int = 12, long: int = 20, keep: float = 2 / 3):
        self.run = run
        self.ids: dict[str, int] = {}
        self.runs: dict[tuple[int, ...], set[int]] = defaultdict(set)
        words: list[list[int]] = []
        self.long: list[int] = []  # items of which copies are looked for
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids)) for x in words_of(text)]
            if not w:
                continue
            size = min(run, len(w))
            for i in range(len(w) - size + 1):
                self.runs[tuple(w[i : i + size])].add(item)
            if len(w) > long:
                self.long.append(item)
                words.append(w)
        heads: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for r in self.runs:
            heads[r[:2]].add(len(r))
        #: by their first two words (or the only one), the lengths of the passages that begin so
        self.heads = {h: sorted(sizes) for h, sizes in heads.items()}

        known: Counter = Counter()
        for w in words:
            known.update(set(w))
        self.counts = [Counter(w) for w in words]
        self.bits: list[dict[int, int]] = []
        self.limits: list[tuple[int, int, int]] = []  # words, words to keep, edits allowed
        least = []
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, w in enumerate(words):
            n = len(w)
            need = -(-n * 2 // 3) if keep == 2 / 3 else int(n * keep + 0.999999)
            lost = n - need
            bits: dict[int, int] = defaultdict(int)
            for i, x in enumerate(w):
                bits[x] |= 1 << i
            self.bits.append(dict(bits))
            # a third of the words lost, and as many added
            self.limits.append((n, need, 2 * lost))
            several = max(1, need // 3)
            least.append(several)
            rarest = sorted(w, key=lambda x: (known[x], x))[: lost + several]
            for x, m in Counter(rarest).items():
                postings[x].append((k, m))
        self.least = np.array(least, np.int64)
        self.pieces = {x: (np.array([k for k, _ in p]), np.array([m for _, m in p])) for x, p in postings.items()}

    def leaks(self, text: str | None) -> set[int]:
        """Items of which the text holds a passage or a copy."""
        return self.leaks_of([self.ids.get(x, -1) for x in words_of(text)])

    def leaks_of(self, w: list[int]) -> set[int]:
        found: set[int] = set()
        for i, head in enumerate(zip(w, [*w[1:], -1], strict=False)):
            for key in (head, head[:1]):
                for size in self.heads.get(key, ()):
                    found |= self.runs.get(tuple(w[i : i + size]), set())
        have = Counter(w)
        del have[-1]
        for k in self.candidates(have):
            if self.long[k] not in found and self._copied(k, w, have):
                found.add(self.long[k])
        return found

    def candidates(self, have: Counter) -> list[int]:
        """Places of the items that have enough of their pieces, in any order, among the words of a text."""
        hits = [(*self.pieces[x], n) for x, n in have.items() if x in self.pieces]
        if not hits:
            return []
        items = np.concatenate([h[0] for h in hits])
        times = np.concatenate([np.minimum(m, n) for _, m, n in hits])
        there, at = np.unique(items, return_inverse=True)
        return there[np.bincount(at, times) >= self.least[there]].tolist()

    def _copied(self, k: int, w: list[int], have: Counter) -> bool:
        n, need, errors = self.limits[k]
        if sum(min(c, have[x]) for x, c in self.counts[k].items()) < need:
            return False
        bits, size = self.bits[k], n + errors
        # windows in which as many of the item's words stand as must be kept
        places = [i for i, x in enumerate(w) if x in bits]
        windows: list[list[int]] = []
        for first, last in zip(places, places[need - 1 :], strict=False):
            if last - first < size:
                if windows and first <= windows[-1][1]:
                    windows[-1][1] = last + 1
                else:
                    windows.append([first, last + 1])
        for lo, hi in windows:
            part = w[lo:hi]
            for end, distance in enumerate(distances(bits, n, part)):
                if distance <= n - need:
                    return True
                if distance <= errors and part[end - 1] in bits and kept_in_order(bits, n, part[max(0, end - size) : end]) >= need:
                    return True
        return False


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_key, item_key): documents that hold a passage or a near copy of a test item.

    A passage is ``run`` (12) words in a row, or the whole of a shorter item. A
    near copy, looked for where an item has more than 20 words, keeps two thirds
    of its words in order. Items without words and null texts never match; equal
    items are each reported. Test items are taken in blocks of about BLOCK items
    and BLOCK_CHARS characters, one after the other, each a pass over the corpus
    without a shuffle; with several blocks the corpus is split into words once.
    """
    spark = docs.sparkSession
    known = items.select(F.col(item_key).alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    n, chars = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-chars // BLOCK_CHARS))
    schema = docs.select(F.col(doc_key), F.lit(None).cast(items.schema[item_key].dataType).alias(item_key)).schema
    kind = schema[item_key].dataType
    texts = docs.select(F.col(doc_key), F.col(text).alias("_text")).where(F.col(doc_key).isNotNull())
    if blocks > 1:
        texts = cut(texts.mapInArrow(_split, texts.drop("_text").select("*", F.lit(None).cast("array<string>").alias("_words")).schema), "words")
    out = None
    for b in range(blocks):
        index = LeakIndex([(r["i"], r["t"]) for r in known.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()])
        shared = spark.sparkContext.broadcast(index)
        del index

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            ids = shared.value.ids
            for batch in batches:
                rows, found = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for item in sorted(shared.value.leaks_of([ids.get(x, -1) for x in (words_of(t) if blocks == 1 else t)])):
                        rows.append(i)
                        found.append(item)
                keys = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(found, to_arrow_type(kind))], names=[doc_key, item_key])

        part = texts.mapInArrow(run, schema)
        if blocks > 1:
            # one block after the other, so that only one index is in memory
            part = cut(part, "leaks")
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = pa.array([words_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), words], names=[batch.schema.names[0], "_words"])
