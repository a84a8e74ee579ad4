"""Freely typed values mapped to the one entry of a reference list they name.

Values are deduplicated and normalised (case, accents, digits typed for letters,
measures in one unit). Each word of a value retrieves reference words by an
inverted index of character n-grams and is scored by weighted cosine, by slips
of typing and as an abbreviation; words learned from confirmed values (other
languages, trade names) score by their share. An entry is accepted if its
weighted cosine with the value and the share of the value's weight that it
explains are above their thresholds, and if no other comes within a margin of
that share: what is not written must not tell entries apart, and it would by
their norms. What is written and fits no entry, or two alike, is reported as
unmatched.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.operators.units import UNIT_SPELLINGS
from orderloom.session import cut

UNMATCHED = "UNMATCHED"
#: What mapping a value gives besides a code: nothing of the list is named, or what is named is no one entry.
NOTHING = ""

#: Fixed value: confirmed values of a tenant in which a word must be left over to be learned from, whatever their number.
LEAST_SEEN = 3

#: Most entries of one block of the reference list that is sent to the workers; more are taken in further blocks.
BLOCK_ENTRIES = 200_000

_SPECIAL = str.maketrans({"æ": "ae", "ø": "o", "ß": "ss", "ð": "d", "þ": "th", "œ": "oe", "ł": "l", "đ": "d", "×": "x", "”": '"', "“": '"', "″": '"', "’": "'", "‘": "'", "′": "'"})
#: Digits and signs typed for letters, inside words only.
_TYPED = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s", "8": "b", "7": "t"})

_N = r"\d+(?:[.,]\d+)?"
_UNITS = "|".join(sorted({s for words in UNIT_SPELLINGS.values() for s in words}, key=len, reverse=True))
_QUANTITY = [
    regex.compile(rf"[,\s]*\bqty\s*[:.=]?\s*[\d.,½¼¾/ x]+\s*(?:(?:{_UNITS})\b\.?)?\s*$"),
    regex.compile(rf"\(\s*(?:[\d.,½¼¾/ ]+|\d+\s*x\s*\d+)\s*(?:{_UNITS})\.?\s*\)\s*$"),
    regex.compile(rf"\s-\s*(?:[\d.,½¼¾]+|\d+\s*x\s*\d+|\d+ \d/\d)\s*(?:{_UNITS})\.?\s*$"),
    regex.compile(rf"^\s*(?:[\d.,½¼¾]+|\d+\s*x\s*\d+|\d+ \d/\d)\s*(?:{_UNITS})\b\.?\s+(?:of\s+)?(?=\S)"),
]
_MEASURES = [
    # pattern, maker of the token
    (regex.compile(r"(?<![\p{L}\d.])(m?)\s?(\d+(?:\.\d+)?)\s*(?:x|\*|by)\s*(\d+(?:\.\d+)?)(?!\d)"), lambda m: f"#{m[1]}{_num(m[2])}x{_num(m[3])}"),
    (regex.compile(r"(?<![\p{L}\d.])(\d+)[- ](\d)/(\d)\s*(?:\"|''|in(?:ch(?:es)?)?\b)"), lambda m: f"#in{_num(float(m[1]) + float(m[2]) / max(1, float(m[3])))}"),
    (regex.compile(r"(?<![\p{L}\d/])(\d+)/(\d+)\s*(?:\"|''|in(?:ch(?:es)?)?\b)"), lambda m: f"#in{_num(float(m[1]) / max(1, float(m[2])))}"),
    (regex.compile(r"(?<![\p{L}\d/.])(\d+(?:\.\d+)?)\s*(?:\"|''|in(?:ch(?:es)?)?\b)"), lambda m: f"#in{_num(m[1])}"),
    (regex.compile(rf"(?<![\p{{L}}\d/.])({_N})\s*(mm|cm|kgs?|g|gr|gm|ml|ltr|l|m)\b"), lambda m: _measure(m[1], m[2])),
    (regex.compile(r"\b(?:dn|nb)[- ]?(\d+)\b"), lambda m: f"#dn{m[1]}"),
    (regex.compile(r"\bm\s?(\d+)\b"), lambda m: f"#m{m[1]}"),
    (regex.compile(r"\b(?:size|sz)[- .]*(\d+)\b"), lambda m: f"#size{m[1]}"),
    (regex.compile(r"\b(?:grade|grd|gr|g)[- .]*(\d+\.\d)\b"), lambda m: f"#grade{m[1]}"),
    (regex.compile(r"\b(?:type|typ|ty)[- .]*([a-z])\b"), lambda m: f"#type{m[1]}"),
    (regex.compile(r"(?<![\p{L}\d])(\d+)\s*(?:pcs|pc|pieces|pce)\b"), lambda m: f"#pcs{m[1]}"),
    (regex.compile(r"(?<![\p{L}\d])(\d+)\s*(?:'?s|slices?|slc)\b"), lambda m: f"#s{m[1]}"),
    (regex.compile(r"\b(?:ss|s/s|s\.s\.|s s|stainless(?: steel)?)[- ]*(\d{3})\b"), lambda m: f" stainless #n{m[1]}"),
]


def _num(x: str | float) -> str:
    return f"{float(str(x).replace(',', '.')):.4f}".rstrip("0").rstrip(".")


def _measure(n: str, unit: str) -> str:
    v = float(n.replace(",", "."))
    if unit in ("mm", "cm", "m"):
        return f"#mm{_num(v * {'mm': 1, 'cm': 10, 'm': 1000}[unit])}"
    if unit in ("kg", "kgs", "g", "gr", "gm"):
        return f"#g{_num(v * (1000 if unit.startswith('kg') else 1))}"
    return f"#ml{_num(v * (1 if unit == 'ml' else 1000))}"


def plain(text: str) -> str:
    """Lower case, no accents, plain quotes; letters without parts are spelled out."""
    t = unicodedata.normalize("NFKD", text.lower().translate(_SPECIAL).replace("½", " 1/2").replace("¼", " 1/4").replace("¾", " 3/4"))
    return "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").translate(_SPECIAL)


def split(text: str) -> tuple[list[str], list[str]]:
    """Measures (as #tokens in one unit) and words of a plain text."""
    measures: list[str] = []

    def take(make):
        def one(m: regex.Match) -> str:
            found = make(m).split()
            measures.extend(x for x in found if x[0] == "#")
            return " " + " ".join(x for x in found if x[0] != "#") + " "

        return one

    t = regex.sub(r"\bs/s\b", "ss", text.replace("_", " "))
    t = regex.sub(r"\bt/([a-z])\b", r"type \1", t)
    t = regex.sub(r"(?<=\p{L})/|/(?=\p{L})", " ", t)
    for pattern, make in _MEASURES:
        t = pattern.sub(take(make), t)
    words = []
    for w in regex.findall(r"[\p{L}\p{N}@$.']+", t.replace("-", " ").replace("/", " ")):
        w = w.replace(".", "").replace("'", "")
        if w.isdigit():
            measures.append(f"#n{int(w)}")
            continue
        letters = sum(c.isalpha() for c in w)
        if letters * 2 >= len(w) and letters:
            w = w.translate(_TYPED)
        if w:
            words.append(w)
    return measures, words


def grams(word: str) -> Counter:
    padded = f"^{word}$"
    return Counter([padded[i : i + 2] for i in range(len(padded) - 1)] + [padded[i : i + 3] for i in range(len(padded) - 2)])


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1]


def within(short: str, word: str) -> bool:
    it = iter(word)
    return all(c in it for c in short)


class WordIndex:
    """Reference words by their character n-grams."""

    def __init__(self, words: set[str], floor: float = 0.45):
        self.words, self.floor = sorted(words), floor
        df: Counter = Counter()
        per = [grams(w) for w in self.words]
        for g in per:
            df.update(g.keys())
        self.idf = {g: math.log(1 + len(self.words) / n) for g, n in df.items()}
        self.odd = math.log(1 + len(self.words))
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, g in enumerate(per):
            norm = math.sqrt(sum((n * self.idf[x]) ** 2 for x, n in g.items()))
            for x, n in g.items():
                self.postings[x].append((k, n * self.idf[x] / norm))
        self.known: dict[str, dict[str, float]] = {}

    def near(self, word: str) -> dict[str, float]:
        """Similarity of the reference words that a typed word may stand for."""
        if (found := self.known.get(word)) is not None:
            return found
        out: dict[str, float] = {}
        g = grams(word)
        norm = math.sqrt(sum((n * self.idf.get(x, self.odd)) ** 2 for x, n in g.items()))
        cosine: dict[int, float] = defaultdict(float)
        for x, n in g.items():
            for k, weight in self.postings.get(x, ()):
                cosine[k] += weight * n * self.idf[x] / norm
        for k, c in cosine.items():
            w = self.words[k]
            s = 1.0 if w == word else c * 0.9
            if s < 1 and len(word) >= 3:
                most = 1 if len(w) <= 4 else 2 if len(w) <= 8 else 3
                if abs(len(word) - len(w)) <= most and (d := edits(word, w, most)) <= most:
                    s = max(s, 1 - 0.12 * d - 0.4 * d / len(w))
                if word[0] == w[0] and len(word) < len(w):
                    if w.startswith(word):
                        s = max(s, 0.85)
                    elif within(word, w):
                        s = max(s, 0.82 if word[-1] == w[-1] else 0.72)
            elif s < 1 and len(word) == 2 and w.startswith(word):
                s = max(s, 0.6)
            if s >= self.floor:
                out[w] = s
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = out
        return out


class Entry:
    __slots__ = ("code", "words", "measures", "bulk", "slots", "kind")

    def __init__(self, code: str, name: str, brand: str, kind: str):
        self.code = code
        text = plain(name)
        self.bulk = bool(regex.search(r"\(bulk\)", text))
        measures, words = split(regex.sub(r"\(bulk\)", " ", text))
        self.measures = frozenset(measures)
        self.words = tuple(words)
        brand_words, kind_words = set(split(plain(brand))[1]), set(split(plain(kind))[1])
        self.kind = " ".join(split(plain(kind))[1])
        self.slots = {w: "brand" if w in brand_words else "kind" if w in kind_words else "finish" for w in words}


class Vocabulary:
    """Words of a tenant's whole list: their weights, the index of their n-grams, and pairs that may be run together."""

    def __init__(self, size: int, df: dict[str, int], joined: dict[str, tuple[str, str]]):
        self.weight = {w: math.log(1 + size / n) for w, n in df.items()}
        self.joined = joined
        self.index = WordIndex(set(df) | set(joined))

    @staticmethod
    def parts(entries: list[Entry]) -> tuple[Counter, dict[str, tuple[str, str]]]:
        """How many entries have each word, and the pairs of words in a row by their letters (the last of several)."""
        df: Counter = Counter()
        joined: dict[str, tuple[str, str]] = {}
        for e in entries:
            df.update(set(e.words))
            for a, b in zip(e.words, e.words[1:], strict=False):
                joined[a + b] = max(joined.get(a + b, (a, b)), (a, b))
        return df, joined


class Matcher:
    """Maps values to the entries of one tenant's list, or of a part of it.

    vocabulary: that of the whole list; unset, the entries are the whole list.
    """

    #: Accept at this share of the value's weight explained; every word that is no filler must be explained by LEAST.
    THRESHOLD, MARGIN, LEAST, NEARLY = 0.62, 0.035, 0.5, 0.2
    #: Least weighted cosine of an entry that is accepted.
    COSINE = 0.5

    def __init__(
        self, entries: list[tuple[str, str, str, str]], aliases: dict[str, dict[str, float]] | None = None, fillers: frozenset[str] = frozenset(), vocabulary: Vocabulary | None = None
    ):
        self.entries = [Entry(*e) for e in sorted(set(entries))]
        self.aliases, self.fillers = aliases or {}, fillers
        vocabulary = vocabulary or Vocabulary(len(self.entries), *Vocabulary.parts(self.entries))
        self.weight, self.joined, self.index = vocabulary.weight, vocabulary.joined, vocabulary.index
        self.told: dict[str, dict[str, float]] = {}
        self.by_word: dict[str, set[int]] = defaultdict(set)
        self.norms = [math.sqrt(sum(self.weight.get(w, 0.0) ** 2 for w in e.words)) for e in self.entries]
        for k, e in enumerate(self.entries):
            for w in e.words:
                self.by_word[w].add(k)

    def near(self, word: str) -> dict[str, float]:
        """Reference words by similarity: as typed, as learned, and two that are run together."""
        if (known := self.told.get(word)) is not None:
            return known
        out: dict[str, float] = {}
        # a word of the list stands for itself; what is only like it would be dropped below
        for w, s in {word: 1.0}.items() if word in self.weight else self.index.near(word).items():
            if w in self.weight:
                out[w] = max(out.get(w, 0), s)
            if w in self.joined and s >= 0.7 and edits(word, w, 2) <= 2:
                for part in self.joined[w]:
                    out[part] = max(out.get(part, 0), s * 0.98)
        for w, s in self.aliases.get(word, {}).items():
            out[w] = max(out.get(w, 0), s)
        # a word of the list stands for itself, another for what is nearly as near as the nearest
        best = max(out.values(), default=0)
        least = 0.95 if best >= 0.99 else best - self.NEARLY
        if len(self.told) > 200_000:
            self.told.clear()
        self.told[word] = {w: s for w, s in out.items() if s >= least}
        return self.told[word]

    @staticmethod
    def read(value: str) -> tuple[list[str], list[str], list[str], bool]:
        """Words, measures, measures that may be a quantity, and whether bulk is written."""
        t = plain(value)
        spare: list[str] = []
        for q in _QUANTITY:
            if m := q.search(t):
                spare = split(m[0])[0]
                t = t[: m.start()] + " " + t[m.end() :]
                break
        t = regex.sub(r"^\s*(?:\d{1,2}[.)](?!\d)|>>|\*|-)\s*", " ", t)
        measures, words = split(t)
        bulk = any(w == "bulk" for w in words)
        return [w for w in words if w != "bulk"], measures, spare, bulk

    def explain(self, words: list[str]) -> list[tuple[str, dict[str, float]]]:
        return [(w, self.near(w)) for w in words]

    def match(self, value: str | None, parsed: tuple | None = None) -> str:
        """A code, UNMATCHED, or NOTHING if the value names nothing of the list."""
        return self.decide(*self.candidates(value, parsed))

    def candidates(self, value: str | None, parsed: tuple | None = None) -> tuple[bool, bool, list[tuple[float, str, bool, bool]]]:
        """Whether the value names anything; whether a size may stand in its quantity; and the best entries.

        An entry is (share, code, sized, accepted): the share of the value's
        weight it explains, whether it has the size that may stand in the
        quantity, and whether its cosine and all words of the value allow it. Of
        sized ones and of others the two best are given, which is what a decision
        over several parts of a list can need. parsed: what read() gives, if known.
        """
        if not value or not value.strip():
            return False, False, []
        words, measures, spare, bulk = parsed or self.read(value)
        told = [(w, near) for w, near in self.explain(words) if not (w in self.fillers and max(near.values(), default=0) < 1)]
        # words typed in two parts, or fillers that are not learned yet, explain nothing
        strong = [(w, n) for w, n in told if max(n.values(), default=0) >= self.LEAST]
        odd = [w for w, n in told if max(n.values(), default=0) < self.LEAST and len(w) > 2]
        if not self._names(strong):
            return False, False, []
        weights = []
        for _, near in strong:
            best = max(near.values())
            weights.append(max(self.weight[w] for w, s in near.items() if s >= best - 0.1))
        total = sum(weights)
        # an entry near enough to be accepted, or to stand beside one, has one of the weightiest words
        # that make up more than the rest of the value's weight
        found: set[int] = set()
        seen = 0.0
        for i in sorted(range(len(strong)), key=lambda i: -weights[i]):
            if seen > (1 - self.THRESHOLD + self.MARGIN) * total:
                break
            seen += weights[i]
            for w, s in strong[i][1].items():
                if s >= self.LEAST:
                    found |= self.by_word[w]
        wanted, sizes = set(measures), set(spare)
        length = math.sqrt(sum(w * w for w in weights))
        fits = []
        for k in found:
            e = self.entries[k]
            if e.bulk != bulk or not wanted <= e.measures:
                continue
            share = dot = 0.0
            for weight, (_, near) in zip(weights, strong, strict=True):
                # of a word's readings each entry counts its best
                s, w = max(((s, x) for x, s in near.items() if x in e.slots), default=(0.0, ""))
                if s >= self.LEAST:
                    share += weight * s
                    dot += weight * s * self.weight[w]
            fits.append((share / total, k, bool(sizes) and sizes <= e.measures, dot / (length * self.norms[k])))
        fits.sort(key=lambda x: (-x[0], self.entries[x[1]].code))
        kept = []
        for sized in (True, False):
            kept += [(s, self.entries[k].code, z, c >= self.COSINE and self._explained(self.entries[k], strong, odd)) for s, k, z, c in [f for f in fits if f[2] == sized][:2]]
        return True, bool(spare), kept

    @classmethod
    def decide(cls, named: bool, spare: bool, kept: list[tuple[float, str, bool, bool]]) -> str:
        """Accepts the best entry above the threshold if no other comes within the margin."""
        if not named:
            return NOTHING
        top = max((s for s, *_ in kept), default=0.0)
        close = [c for c in kept if c[0] >= top - cls.MARGIN]
        if len(close) > 1 and spare:
            # a number with a unit that may be the size, where no other size is written
            close = [c for c in close if c[2]] or close
        return close[0][1] if top >= cls.THRESHOLD and len(close) == 1 and close[0][3] else UNMATCHED

    def _explained(self, e: Entry, strong: list[tuple[str, dict[str, float]]], odd: list[str]) -> bool:
        """Every strong word is explained by the entry itself, every other is a bad slip of one that is still open."""
        open_ = list(e.words)
        for _, near in strong:
            mine = max(e.words, key=lambda w: near.get(w, 0))
            if near.get(mine, 0) < self.LEAST:
                return False
            if mine in open_:
                open_.remove(mine)
        for word in odd:
            slip = min(open_, key=lambda w: edits(word, w, 4), default=None)
            if slip is None or edits(word, slip, 4) * 2 > len(word):
                return False
            open_.remove(slip)
        return True

    @staticmethod
    def _names(strong: list[tuple[str, dict[str, float]]]) -> bool:
        """Two words of the list are there, or one as it is written there."""
        return len(strong) > 1 or any(s >= 0.95 for _, near in strong for s in near.values())

    def residue(self, words: list[str], code_words: tuple[str, ...]) -> tuple[list[str], list[str], bool]:
        """Of a confirmed value's words those that its entry doesn't explain, words of the entry that
        nothing in the value explains, and whether the value names the entry at all."""
        told = [(w, self.near(w)) for w in words]
        left = [w for w, near in told if max((near.get(x, 0) for x in code_words), default=0) < self.LEAST]
        open_ = [x for x in code_words if max((near.get(x, 0) for _, near in told), default=0) < self.LEAST]
        return left, open_, len(open_) < len(code_words)


def learned(counts: list[tuple[str, str, int]], labelled: int, single: bool = False) -> tuple[dict[str, dict[str, float]], frozenset[str]]:
    """Aliases and fillers from residue counts (word, entry word or '' or None, n).

    n counts confirmed values in which the word was left over: with '' if nothing
    of the entry was open (or nothing was named), else with each open word; with
    None in all. A word that mostly leaves nothing open says nothing; one that
    mostly comes with the same open word stands for it. Words seen less than
    LEAST_SEEN times aren't learned from, however many values are confirmed (labelled).
    """
    all_, empty = {}, {}
    pairs: dict[str, dict[str, int]] = defaultdict(dict)
    for word, target, n in counts:
        if target is None:
            all_[word] = n
        elif target == "":
            empty[word] = n
        else:
            pairs[word][target] = n
    aliases: dict[str, dict[str, float]] = {}
    fillers = set()
    for word, n in all_.items():
        if n < LEAST_SEEN:
            continue
        if empty.get(word, 0) >= 0.6 * n:
            fillers.add(word)
        elif found := {t: 0.95 * c / n for t, c in pairs.get(word, {}).items() if c >= 0.5 * n}:
            top = max(found.values())
            kept = {t: max(0.6, s) for t, s in found.items() if s >= top - 0.2}
            if len(kept) == 1 or not single:
                aliases[word] = kept
    return aliases, frozenset(fillers)


def _decided(counts: DataFrame, single: bool) -> DataFrame:
    """(tenant, word, target, n, all) of learned words only, by the rules of learned(): target '' for fillers, else what the word stands for."""
    of = Window.partitionBy("tenant", "word")
    n, all_, target = F.col("n"), F.col("all"), F.col("target")
    seen = counts.withColumn("all", F.max(F.when(target.isNull(), n)).over(of)).where(all_ >= LEAST_SEEN).where("target IS NOT NULL")
    seen = seen.withColumn("filler", F.coalesce(F.max(F.when(target == "", n)).over(of), F.lit(0)) >= all_ * 0.6)
    seen = seen.withColumn("share", F.when((target != "") & (n >= all_ * 0.5), F.lit(0.95) * n / all_))
    seen = seen.withColumn("kept", F.coalesce(F.col("share") >= F.max("share").over(of) - 0.2, F.lit(False)))
    alias = F.col("kept") & ((F.sum(F.col("kept").cast("int")).over(of) == 1) if single else F.lit(True))
    seen = seen.withColumn("alias", alias)
    return seen.where((F.col("filler") & (target == "")) | (~F.col("filler") & F.col("alias"))).select("tenant", "word", "target", "n", "all")


_MATCHERS: dict[str, dict[str, Matcher]] = {}


def _matchers(key: str, model: dict[str, tuple], lists: dict[str, list[tuple]]) -> dict[str, Matcher]:
    """Matchers of a worker process, made once per model. model: tenant to (vocabulary parts, aliases, fillers)."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = {t: Matcher(lists.get(t, []), aliases, fillers, Vocabulary(*parts)) for t, (parts, aliases, fillers) in model.items()}
    return _MATCHERS[key]


def _vocabularies(entries: DataFrame) -> dict[str, tuple[int, dict[str, int], dict[str, tuple[str, str]]]]:
    """tenant: number of entries, entries per word, joined pairs. Only words come to the driver, not the list."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for tenant, *fields in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                df, joined = Vocabulary.parts([Entry(*(f or "" for f in fields))])
                total.update({(tenant, w, None, None): 1 for w in df} | {(tenant, w, *pair): 1 for w, pair in joined.items()} | {(tenant, None, None, None): 1})
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in total], pa.string()) for i in range(4)] + [pa.array(list(total.values()), pa.int64())], names=["tenant", "word", "a", "b", "n"])

    counts = entries.select("tenant", "code", "name", "brand", "kind").mapInArrow(count, "tenant string, word string, a string, b string, n long").groupBy("tenant", "word", "a", "b").agg(F.sum("n").alias("n"))
    sizes: dict[str, int] = {}
    df: dict[str, dict[str, int]] = defaultdict(dict)
    joined: dict[str, dict[str, tuple[str, str]]] = defaultdict(dict)
    for r in counts.collect():
        if r["word"] is None:
            sizes[r["tenant"]] = r["n"]
        elif r["a"] is None:
            df[r["tenant"]][r["word"]] = r["n"]
        else:
            pair = (r["a"], r["b"])
            joined[r["tenant"]][r["word"]] = max(joined[r["tenant"]].get(r["word"], pair), pair)
    return {t: (n, df[t], joined[t]) for t, n in sizes.items()}


_READ = "tenant string, value string, asked boolean, words array<string>, measures array<string>, spare array<string>, bulk boolean, odd array<string>"
_NEAR = "tenant string, word string, near array<struct<w: string, s: double>>"


def _read_values(values: DataFrame, vocabularies: dict[str, tuple]) -> DataFrame:
    """(tenant, value, asked, words, measures, spare, bulk, near): each value read once, with its words' similarities.

    Distinct words that are not of the list are looked up once each in the index
    of n-grams, and the table of what they are like is joined to the values.
    """
    spark = values.sparkSession
    shared, key = spark.sparkContext.broadcast({t: (parts, {}, frozenset()) for t, parts in vocabularies.items()}), uuid.uuid4().hex

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for tenant, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, *rest = Matcher.read(value)
                known = model[tenant][0][1]
                for column, v in zip(columns, (words, *rest, sorted({w for w in words if w not in known})), strict=True):
                    column.append(v)
            kinds = [pa.list_(pa.string())] * 3 + [pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["tenant", "value", "asked", "words", "measures", "spare", "bulk", "odd"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = _matchers(key, shared.value, {})
        kind = pa.list_(pa.struct([("w", pa.string()), ("s", pa.float64())]))
        for batch in batches:
            near = [[{"w": w, "s": s} for w, s in matchers[t].index.near(word).items()] for t, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, kind)], names=["tenant", "word", "near"])

    parsed = cut(_spread(values.select("tenant", "value", "asked")).mapInArrow(read, _READ), "read")
    words = parsed.select("tenant", "value", F.explode("odd").alias("word"))
    near = cut(_spread(words.select("tenant", "word").distinct(), "word").mapInArrow(look_up, _NEAR), "near")
    told = words.join(near, ["tenant", "word"]).groupBy("tenant", "value").agg(F.collect_list(F.struct("word", "near")).alias("near"))
    ready = cut(parsed.drop("odd").join(told, ["tenant", "value"], "left"), "values")
    shared.destroy()
    return ready


def _prime(matcher: Matcher, near: list[dict] | None) -> None:
    """Gives a matcher the similarities that were looked up before."""
    for x in near or ():
        if x["word"] not in matcher.index.known:
            matcher.index.known[x["word"]] = {n["w"]: n["s"] for n in x["near"]}


def _learn(confirmed: DataFrame, entries: DataFrame, vocabularies: dict[str, tuple]) -> dict[str, tuple]:
    """tenant: (vocabulary parts, aliases, fillers), learned from all confirmed values in two rounds.

    confirmed: tenant, code, words, near. Each is joined to its entry's name, so
    no list is needed.
    """
    spark = confirmed.sparkSession
    model = {t: (parts, {}, frozenset()) for t, parts in vocabularies.items()}
    named = entries.groupBy("tenant", "code").agg(F.max(F.struct(*(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "brand", "kind")))).alias("e"))
    rows = cut(confirmed.join(named, ["tenant", "code"]).select("tenant", "value", "words", "near", "code", "e.name", "e.brand", "e.kind"), "confirmed")
    for single in (True, False):
        shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

        def residues(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            matchers = _matchers(key, shared.value, {})
            words: dict[tuple, tuple] = {}
            total: Counter = Counter()
            for batch in batches:
                for tenant, _, typed, near, *fields in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                    name = tuple(fields)
                    if name not in words:
                        words[name] = Entry(*name).words
                    if not words[name]:
                        continue
                    _prime(matchers[tenant], near)
                    left, open_, is_named = matchers[tenant].residue(typed, words[name])
                    for w in set(left):
                        total[tenant, w, None] += 1
                        for o in set(open_) if is_named and open_ else {""}:
                            total[tenant, w, o] += 1
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in total], pa.string()) for i in range(3)] + [pa.array(list(total.values()), pa.int64())], names=["tenant", "word", "target", "n"])

        counts = _spread(rows).mapInArrow(residues, "tenant string, word string, target string, n long").groupBy("tenant", "word", "target").agg(F.sum("n").alias("n"))
        per: dict[str, list] = defaultdict(list)
        for r in _decided(counts, single).collect():
            per[r["tenant"]] += [(r["word"], None, r["all"]), (r["word"], r["target"], r["n"])]
        for t, (parts, aliases, _) in model.copy().items():
            more, fillers = learned(per.get(t, []), len(per.get(t, [])), single)
            model[t] = (parts, aliases | more, fillers)
        shared.destroy()
    return model


def _spread(rows: DataFrame, by: str = "value") -> DataFrame:
    """Rows over as many tasks as the session shuffles into: a value costs time, not bytes, so tasks go by rows.

    By a hash, since a partitioning that is there already would be kept and its small partitions joined.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, F.xxhash64("tenant", by))


def _blocks(entries: DataFrame, sizes: dict[str, int], most: int) -> Iterator[tuple[bool, dict[str, list[tuple]]]]:
    """The list in blocks of about ``most`` entries, one at a time, and whether the block is a part of one tenant's list."""
    fetched = lambda df: [(r["tenant"], (r["code"], r["name"] or "", r["brand"] or "", r["kind"] or "")) for r in df.collect()]

    def block(df: DataFrame) -> dict[str, list[tuple]]:
        out: dict[str, list[tuple]] = defaultdict(list)
        for tenant, entry in fetched(df):
            out[tenant].append(entry)
        return dict(out)

    group: list[str] = []
    for tenant, n in sorted(sizes.items()):
        if n > most:
            parts = -(-n // most)
            for p in range(parts):
                yield True, block(entries.where((F.col("tenant") == tenant) & (F.pmod(F.xxhash64("code", "name"), F.lit(parts)) == p)))
            continue
        if group and sum(sizes[t] for t in group) + n > most:
            yield False, block(entries.where(F.col("tenant").isin(group)))
            group = []
        group.append(tenant)
    if group:
        yield False, block(entries.where(F.col("tenant").isin(group)))


_CANDIDATES = "tenant string, value string, named boolean, spare boolean, kept array<struct<share: double, code: string, sized: boolean, accepted: boolean>>"


def map_to_list(values: DataFrame, entries: DataFrame, confirmed: DataFrame, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(tenant, value, code): the entry that each distinct value names.

    values: tenant, value. entries: tenant, code, name, brand, kind (of which
    only codes matter if several share a name: such values fit two alike).
    confirmed: tenant, value, code, from which words of the trade are learned.
    code is UNMATCHED where what is written fits no entry or several, and ''
    where the value (also a null or blank one) names nothing of the list.
    Values of a tenant without entries name nothing. Repeated values are mapped
    once; values longer than the names are read whole. The list is taken in
    blocks of ``block_entries``, one after the other; of a tenant whose list is
    in several blocks each value keeps the best entries of each, from which the
    decision is made as from one list.
    """
    spark = values.sparkSession
    asked = values.select("tenant", "value").where("tenant IS NOT NULL AND trim(value) <> ''")
    entries = cut(entries.select("tenant", "code", "name", "brand", "kind").where("tenant IS NOT NULL AND code IS NOT NULL AND name IS NOT NULL").distinct(), "entries")
    taught = confirmed.select("tenant", "value", "code").where("trim(value) <> '' AND code IS NOT NULL").distinct()
    vocabularies = _vocabularies(entries)
    sizes = {t: parts[0] for t, parts in vocabularies.items()}
    if not sizes:
        return asked.distinct().select("tenant", "value", F.lit(NOTHING).alias("code"))
    every = asked.select("*", F.lit(True).alias("asked")).unionByName(taught.select("tenant", "value", F.lit(False).alias("asked")))
    ready = _read_values(every.where(F.col("tenant").isin(list(sizes))).groupBy("tenant", "value").agg(F.bool_or("asked").alias("asked")), vocabularies)
    model = _learn(taught.join(ready.select("tenant", "value", "words", "near"), ["tenant", "value"]), entries, vocabularies)
    distinct = _spread(ready.where("asked").drop("asked"))
    whole, several = [], []
    single = sum(sizes.values()) <= block_entries
    for is_part, lists in _blocks(entries, sizes, block_entries):
        shared, key = spark.sparkContext.broadcast(({t: model[t] for t in lists}, lists)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key, is_part=is_part) -> Iterator[pa.RecordBatch]:
            matchers = _matchers(key, *shared.value)
            for batch in batches:
                found, codes = [], []
                for tenant, value, *parsed, near in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                    _prime(matchers[tenant], near)
                    best = matchers[tenant].candidates(value, parsed)
                    if is_part:
                        kept = [dict(zip(("share", "code", "sized", "accepted"), c, strict=True)) for c in best[2]]
                        found.append({"tenant": tenant, "value": value, "named": best[0], "spare": best[1], "kept": kept})
                    else:
                        codes.append(Matcher.decide(*best))
                if is_part:
                    yield pa.RecordBatch.from_pylist(found, schema=_CANDIDATES_ARROW)
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string())], names=["tenant", "value", "code"])

        part = distinct.where(F.col("tenant").isin(list(lists))).mapInArrow(run, _CANDIDATES if is_part else "tenant string, value string, code string")
        if not single:
            # one block after the other, so that only one is in memory
            part = cut(part, "block")
            shared.destroy()
        (several if is_part else whole).append(part)
    if several:
        both = several[0]
        for part in several[1:]:
            both = both.unionByName(part)
        merged = both.groupBy("tenant", "value").agg(F.bool_or("named").alias("named"), F.bool_or("spare").alias("spare"), F.flatten(F.collect_list("kept")).alias("kept"))
        whole.append(merged.mapInArrow(_decide_merged, "tenant string, value string, code string"))
    out = whole[0]
    for part in whole[1:]:
        out = out.unionByName(part)
    return out


_CANDIDATES_ARROW = pa.schema([
    ("tenant", pa.string()), ("value", pa.string()), ("named", pa.bool_()), ("spare", pa.bool_()),
    ("kept", pa.list_(pa.struct([("share", pa.float64()), ("code", pa.string()), ("sized", pa.bool_()), ("accepted", pa.bool_())]))),
])


def _decide_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = []
        for named, spare, kept in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            best = sorted(((c["share"], c["code"], c["sized"], c["accepted"]) for c in kept), key=lambda c: (-c[0], c[1]))
            codes.append(Matcher.decide(named, spare, best))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string())], names=["tenant", "value", "code"])


def items_of_lines(lines: DataFrame, labels: DataFrame, catalogue: DataFrame, by_code: DataFrame) -> DataFrame:
    """(line_id, item_code): the live item each unconfirmed line names, or UNMATCHED.

    by_code: line_id, item_code by the buyer's code, for lines whose text names
    nothing. Lines are counted once; of a line with several texts the first in
    order holds.
    """
    live = catalogue.where((F.col("disabled") == "0") & ~F.coalesce(F.col("item_group"), F.lit("")).rlike(r">\s*Misc\s*$"))
    entries = live.select("tenant", F.col("item_code").alias("code"), F.col("item_name").alias("name"), "brand", F.element_at(F.split("item_group", ">"), -1).alias("kind"))
    label = labels.where("line_id IS NOT NULL AND item_code IS NOT NULL").groupBy("line_id").agg(F.min("item_code").alias("code"))
    once = lines.where("line_id IS NOT NULL").groupBy("line_id").agg(F.min(F.struct("tenant", F.col("raw_text").alias("value"))).alias("v")).select("line_id", "v.tenant", "v.value")
    once = cut(once.join(label, "line_id", "left"), "lines")
    open_ = once.where("code IS NULL").drop("code")
    mapped = map_to_list(open_, entries, once.where("code IS NOT NULL"))
    blank = open_.where("tenant IS NULL OR value IS NULL OR trim(value) = ''").select("line_id", F.lit(NOTHING).alias("code"))
    read = open_.where("tenant IS NOT NULL AND trim(value) <> ''").join(mapped, ["tenant", "value"], "left").select("line_id", "code").unionByName(blank)
    second = by_code.select("line_id", F.col("item_code").alias("_by_code"))
    named = F.when(F.coalesce("code", F.lit(NOTHING)) != NOTHING, F.col("code")).otherwise(F.coalesce("_by_code", F.lit(UNMATCHED)))
    return read.join(second, "line_id", "left").select("line_id", named.alias("item_code")).distinct()
