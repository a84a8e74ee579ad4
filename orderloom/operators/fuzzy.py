"""A weighted similarity of two texts from their longest common subsequence.

The plain ratio counts characters in common order. Token forms compare sorted
words, and the words shared with those that differ; where one text is much
longer, its best part of the other's length is compared instead.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.session import cut

#: Entries that are sent to the workers at once; more are taken in blocks, each with a pass over the queries.
BLOCK_ENTRIES = 20_000


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    if not a or not b:
        return 0
    bits: dict[str, int] = {}
    for i, ch in enumerate(a):
        bits[ch] = bits.get(ch, 0) | 1 << i
    full = v = (1 << len(a)) - 1
    for ch in b:
        u = v & bits.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """100 for equal texts, 0 for texts without a common character or an empty one."""
    return 200.0 * common(a, b) / (len(a) + len(b)) if a and b else 0.0


def partial_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """Best ratio of the shorter text to a part of the longer of at most its length; ``floor`` if none is better.

    A part slides along the longer text with the number of characters it shares
    with the shorter in any order, which bounds its ratio; only parts whose bound
    beats the best so far are compared in full.
    """
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return floor
    n, best = len(short), floor
    want = Counter(short)
    have: Counter = Counter()
    shared = 0
    for end in range(1, len(long) + n):
        start = end - n
        if end <= len(long):
            ch = long[end - 1]
            have[ch] += 1
            shared += have[ch] <= want.get(ch, 0)
        if start > 0:
            ch = long[start - 1]
            shared -= have[ch] <= want.get(ch, 0)
            have[ch] -= 1
        part = min(end, len(long)) - max(start, 0)
        if 200.0 * shared / (n + part) > best:
            best = max(best, ratio(short, long[max(start, 0) : end]))
            if best >= 100.0:
                break
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and either side's shared and further words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (not x - y or not y - x):
        return 100.0
    left, right = (f"{both} {' '.join(sorted(d))}".strip() for d in (x - y, y - x))
    scores = [ratio(left, right)]
    if both:
        scores += [ratio(both, left), ratio(both, right)]
    return max(scores)


def partial_token_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """The partial ratio of sorted words, ``floor`` if that is not better; texts that share a word reach 100."""
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 100.0
    best = partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())), floor)
    return partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)), best)


def weighted_ratio(a: str | None, b: str | None) -> float:
    """0 to 100; 0 if either text is missing or empty."""
    if not a or not b:
        return 0.0
    plain = ratio(a, b)
    size = max(len(a), len(b)) / min(len(a), len(b))
    if size < 1.5:
        return max(plain, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if size <= 8 else 0.6
    best = max(plain, 0.95 * scale * partial_token_ratio(a, b, plain / (0.95 * scale)))
    return max(best, scale * partial_ratio(a, b, best / scale))


def weighted_ratio_column(a: Column, b: Column) -> Column:
    """The weighted ratio from 0 to 1, over Arrow batches."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([weighted_ratio(p, q) / 100.0 for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)


class Entries:
    """A list of texts that finds the best of them for a query by the weighted ratio, exactly.

    A text at least 1.5 and at most 8 times as long that shares a word has a
    ratio of ``SHARED`` or more. Where k texts do, only texts that can reach that
    ratio otherwise are compared: those that hold a near copy of the query, which
    must have most of its runs of four characters, and those of about its length,
    by their lengths and common words. Elsewhere the longest common subsequence
    with a whole text bounds that with any part of it. It is computed for all texts
    at once, one bit per character of the query; only entries whose bound reaches
    the k-th best score so far are compared in full.
    """

    BITS, STEP, RUN = 64, 64, 4
    SHARED = 0.95 * 0.9 * 100.0

    def __init__(self, entries: list[tuple[str, str]]):
        entries = sorted(entries)
        self.codes, self.texts = [c for c, _ in entries], [t for _, t in entries]
        self.letters = {ch: i + 1 for i, ch in enumerate(sorted({ch for t in self.texts for ch in t} | {" "}))}
        self.shapes = [self._shapes(t) for t in self.texts]
        self.forms = [self._form(f) for f in zip(*self.shapes, strict=True)]
        self.few = [np.array([x[f].count(" ") < 2 for x in self.shapes]) for f in range(3)]
        self.words = self._index(t.split() for t in self.texts)
        self.runs = self._index((t[i : i + self.RUN] for i in range(len(t) - self.RUN + 1)) for t in self.texts)

    @staticmethod
    def _index(parts) -> dict[str, np.ndarray]:
        found: dict[str, list[int]] = defaultdict(list)
        for i, own in enumerate(parts):
            for w in set(own):
                found[w].append(i)
        return {w: np.array(i) for w, i in found.items()}

    @staticmethod
    def _shapes(text: str) -> tuple[str, str, str]:
        return text, " ".join(sorted(text.split())), " ".join(sorted(set(text.split())))

    def _form(self, texts: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Letters as numbers (position x text, 0 past the end) and lengths."""
        lens = np.array([len(t) for t in texts])
        grid = np.zeros((int(lens.max()), len(texts)), np.uint16)
        for i, t in enumerate(texts):
            grid[: len(t), i] = [self.letters[ch] for ch in t]
        return grid, lens

    def _bits(self, part: str) -> np.ndarray:
        bits = [0] * (len(self.letters) + 1)
        for i, ch in enumerate(part):
            if ch in self.letters:
                bits[self.letters[ch]] |= 1 << i
        return np.array(bits, np.uint64)

    def _most_common(self, form: int, q: str, rows: np.ndarray | None = None) -> np.ndarray:
        """Length of the longest common subsequence; of queries over 64 characters an upper bound (the sum over their parts)."""
        grid = self.forms[form][0] if rows is None else self.forms[form][0][:, rows]
        total = np.zeros(grid.shape[1], np.int64)
        for at in range(0, len(q), self.BITS):
            part = q[at : at + self.BITS]
            full = np.uint64((1 << len(part)) - 1)
            v = np.full(grid.shape[1], full)
            for eq in self._bits(part)[grid]:
                u = v & eq
                v = (v + u) | (v - u)
            total += len(part) - np.bitwise_count(v & full).astype(np.int64)
        return total

    def _best_part(self, form: int, q: str, rows: np.ndarray) -> np.ndarray:
        """The partial ratio of q (at most 64 characters and no longer than the texts) to each text."""
        n, (grid, lens) = len(q), self.forms[form]
        if not n:
            return np.zeros(len(rows))
        bits = self._bits(q)[grid[:, rows].T]
        wide = np.zeros((len(rows), bits.shape[1] + 2 * n - 2), np.uint64)
        wide[:, n - 1 : n - 1 + bits.shape[1]] = bits
        starts = wide.shape[1] - n + 1
        full = np.uint64((1 << n) - 1)
        v = np.full((len(rows), starts), full)
        u, rest = np.empty_like(v), np.empty_like(v)
        for j in range(n):
            np.bitwise_and(v, wide[:, j : j + starts], out=u)
            np.subtract(v, u, out=rest)
            np.add(v, u, out=v)
            np.bitwise_or(v, rest, out=v)
        shared = n - np.bitwise_count(v & full).astype(np.int64)
        first = np.arange(starts) - (n - 1)
        size = np.minimum(first + n, lens[rows][:, None]) - np.maximum(first, 0)
        return np.where(size > 0, 200.0 * shared / (n + np.maximum(size, 1)), 0.0).max(axis=1)

    def _exact(self, q: str, shapes: tuple[str, str, str], rows: np.ndarray, shares: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        lens = [f[1][rows] for f in self.forms]
        fast = (lens[0] >= 1.5 * len(q)) & (shares[rows] | (lens[1] >= len(shapes[1])) & (lens[2] >= len(shapes[2]))) & (len(q) <= self.BITS)
        for i in np.flatnonzero(~fast):
            out[i] = weighted_ratio(q, self.texts[rows[i]])
        at = np.flatnonzero(fast)
        if len(at):
            lens = lens[0][at]
            tokens = np.full(len(at), 100.0)
            apart = np.flatnonzero(~shares[rows[at]])
            if len(apart):
                r = rows[at[apart]]
                tokens[apart] = np.maximum(self._best_part(1, shapes[1], r), self._best_part(2, shapes[2], r))
            scale = np.where(lens / len(q) <= 8, 0.9, 0.6)
            plain = np.zeros(len(at))
            open_ = np.flatnonzero(~(shares[rows[at]] & (scale == 0.9)))  # a text this long has a plain ratio below SHARED
            if len(open_):
                plain[open_] = 200.0 * self._most_common(0, q, rows[at[open_]]) / (lens[open_] + len(q))
            out[at] = np.maximum(np.maximum(plain, 0.95 * scale * tokens), scale * self._best_part(0, q, rows[at]))
        return out

    def _near(self, q: str, shapes: tuple[str, str, str], shares: np.ndarray) -> np.ndarray:
        """Texts that may have a part with a ratio of 95 or more to q, or whose sorted words may have one of 100 without a common word."""
        n = len(q)
        if n < self.RUN:
            near = np.array([q in t for t in self.texts])
        else:
            # a part p with that ratio is at most 0.05 (n + p) characters away, each of which costs at most RUN runs
            runs = {q[i : i + self.RUN] for i in range(n - self.RUN + 1)}
            hits = [self.runs[r] for r in runs if r in self.runs]
            have = np.bincount(np.concatenate(hits), minlength=len(self.texts)) if hits else np.zeros(len(self.texts), np.int64)
            near = have >= len(runs) - self.RUN * int(0.1 * n + 1e-9)
        for form in (1, 2):  # of three words the one between would be common
            mine, theirs = shapes[form], self.shapes
            for i in np.flatnonzero(~shares & ~near & (self.few[form] | (mine.count(" ") < 2))):
                near[i] = mine in theirs[i][form] or theirs[i][form] in mine
        return near

    def _level(self, q: str, shapes: tuple[str, str, str], rows: np.ndarray, common_words: np.ndarray) -> np.ndarray:
        """Upper bound of the ratio for texts of less than 1.5 times the query's length, by lengths and the length of the common words, then by subsequences."""
        lens = [f[1][rows] for f in self.forms]
        plain, by_sort, by_set = (200.0 * np.minimum(m, len(s)) / np.maximum(1, m + len(s)) for m, s in zip(lens, shapes, strict=True))
        both = common_words[rows]
        by_set = np.maximum(by_set, np.where(both > 0, 200.0 * both / (both + np.minimum(lens[2], len(shapes[2]))), 0.0))
        by_set = np.where((both > 0) & (both >= np.minimum(lens[2], len(shapes[2]))), 100.0, by_set)
        wide = np.maximum(lens[0], len(q)) >= 1.5 * np.minimum(lens[0], len(q))
        at_most = np.where(wide, 100.0, np.maximum(plain, 0.95 * np.maximum(by_sort, by_set)))
        at = np.flatnonzero(~wide & (at_most >= self.SHARED - 1e-6))
        if len(at):
            r = rows[at]
            c = [self._most_common(f, shapes[f], r) for f in (0, 1, 2)]
            plain, by_sort = (200.0 * c[f] / np.maximum(1, lens[f][at] + len(shapes[f])) for f in (0, 1))
            # the common words stand first on both sides, and what differs is a subsequence of either form
            b = both[at]
            left, right = len(shapes[2]), lens[2][at]
            shared = np.where(b > 0, b + 1 + np.minimum(np.minimum(left, right) - b, c[2]), c[2])
            by_set = np.maximum(200.0 * np.minimum(shared, np.minimum(left, right)) / np.maximum(1, left + right), np.where(b > 0, 200.0 * b / (b + np.minimum(left, right)), 0.0))
            by_set = np.where((b > 0) & (b >= np.minimum(left, right)), 100.0, by_set)
            at_most[at] = np.maximum(plain, 0.95 * np.maximum(by_sort, by_set))
        at_most[lens[0] == 0] = 0.0
        return at_most

    def search(self, q: str, k: int, also: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the k best texts (by ratio, then code) and their ratios from 0 to 1; those of the places ``also``. Ratios of 0 count too."""
        also = np.zeros(0, np.int64) if also is None else also
        if not q or not self.texts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(len(also))
        shapes, lens = self._shapes(q), self.forms[0][1]
        shares, common_words = np.zeros(len(lens), bool), np.full(len(lens), -1)
        for w in set(q.split()):
            if w in self.words:
                shares[self.words[w]] = True
                common_words[self.words[w]] += len(w) + 1
        longer = lens >= 1.5 * len(q)
        sure = longer & shares & (lens <= 8 * len(q))
        if np.count_nonzero(sure) >= k:
            score, known = np.where(sure, self.SHARED, 0.0), sure
            rows = np.flatnonzero(longer & (lens <= 8 * len(q)) & self._near(q, shapes, shares))
            level = np.flatnonzero(~longer)
            if len(level):
                rows = np.concatenate([rows, level[self._level(q, shapes, level, common_words) >= self.SHARED - 1e-6]])
            if len(rows):
                score[rows], known[rows] = self._exact(q, shapes, rows, shares), True
        else:
            score, known = self._bounded(q, k, shapes, shares)
        value = np.round(score / 100.0, 8)
        open_ = also[~known[also]]
        if len(open_):
            score[open_] = self._exact(q, shapes, open_, shares)
        top = np.argsort(-value, kind="stable")[:k]
        return top, value[top], np.round(score[also] / 100.0, 8)

    def _bounded(self, q: str, k: int, shapes: tuple[str, str, str], shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios (0 to 100) that are exact where known, and for the k best."""
        lens = self.forms[0][1]
        least, size = np.minimum(lens, len(q)), np.maximum(lens, len(q)) / np.maximum(1, np.minimum(lens, len(q)))
        wide, scale = size >= 1.5, np.where(size <= 8, 0.9, 0.6)
        part = lambda c, short: 200.0 * np.minimum(c, short) / np.maximum(1, short + np.minimum(c, short))
        c = self._most_common(0, q)
        plain = 200.0 * c / (lens + len(q))
        tokens, whole = np.full(len(lens), 100.0), np.full(len(lens), 100.0)
        apart = np.flatnonzero(~shares)
        if len(apart):
            both = [(self._most_common(f, shapes[f], apart), self.forms[f][1][apart], len(shapes[f])) for f in (1, 2)]
            tokens[apart] = np.maximum(*(part(c, np.minimum(m, n)) for c, m, n in both))
            whole[apart] = np.maximum(*(200.0 * c / np.maximum(1, m + n) for c, m, n in both))
        at_most = np.where(wide, np.maximum(np.maximum(plain, 0.95 * scale * tokens), scale * part(c, least)), np.maximum(plain, 0.95 * whole))
        at_most[lens == 0] = 0.0
        score = np.where(wide & shares, 0.95 * scale * 100.0, 0.0)
        order = np.flatnonzero(at_most > score + 1e-9)
        known = at_most <= score + 1e-9
        order = order[np.argsort(-at_most[order], kind="stable")]
        for i in range(0, len(order), self.STEP):
            kth = np.partition(score, -k)[-k] if len(score) > k else 0.0
            rows = order[i : i + self.STEP]
            rows = rows[at_most[rows] >= kth - 1e-5]
            if not len(rows):
                break
            score[rows], known[rows] = self._exact(q, shapes, rows, shares), True
        return score, known

    def top(self, q: str, k: int) -> list[tuple[str, float]]:
        """(code, ratio from 0 to 1) of the k best, by ratio, then code. Ratios of 0 count too."""
        rows, value, _ = self.search(q, k)
        return [(self.codes[i], float(v)) for i, v in zip(rows, value, strict=True)]


_ENTRIES: dict[str, dict[str, Entries]] = {}


def _entries(key: str, block: dict[str, list[tuple[str, str]]]) -> dict[str, Entries]:
    """Lists of a worker process, made once per block."""
    if key not in _ENTRIES:
        _ENTRIES.clear()
        _ENTRIES[key] = {t: Entries(e) for t, e in block.items()}
    return _ENTRIES[key]


def top_k(queries: DataFrame, docs: DataFrame, k: int = 20, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(tenant, q, item_code, score, place): the k best entries of the tenant by weighted ratio of each distinct query text.

    queries: tenant, q. docs: tenant, item_code, text. Ties by code; scores of 0
    are kept, so a text has k candidates unless it is empty or the list shorter.
    """
    spark = queries.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = cut(docs.select("tenant", "item_code", F.coalesce("text", F.lit("")).alias("text")).where("tenant IS NOT NULL").distinct(), "docs")
    asked = cut(queries.select("tenant", "q").where("tenant IS NOT NULL AND q <> ''").distinct(), "asked")
    blocks = max(1, -(-docs.count() // block_entries))
    schema = "tenant string, q string, item_code string, score double"
    out = None
    for b in range(blocks):
        block: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for r in docs.where(F.pmod(F.xxhash64("tenant", "item_code"), F.lit(blocks)) == b).collect():
            block[r["tenant"]].append((r["item_code"], r["text"]))
        shared, key = spark.sparkContext.broadcast(dict(block)), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame], shared=shared, key=key) -> Iterator[pd.DataFrame]:
            lists = _entries(key, shared.value)
            for batch in batches:
                for at in range(0, len(batch), 1000):
                    rows = [(t, q, c, s) for t, q in zip(batch["tenant"][at : at + 1000], batch["q"][at : at + 1000], strict=True) if t in lists for c, s in lists[t].top(q, k)]
                    yield pd.DataFrame(rows, columns=["tenant", "q", "item_code", "score"])

        # tasks by rows, not by bytes: the work of a text is the whole list
        part = asked.repartition(n, "tenant", "q").mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("tenant", "q").orderBy(F.desc("score"), F.asc("item_code"))
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
