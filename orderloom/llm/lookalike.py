"""Text that looks the same brought to one form.

Width and composition variants are folded, characters that can't be seen are
deleted, kinds of single space and of hyphen become one. Letters drawn alike in
Latin, Cyrillic and Greek then form a lattice for each token: a Viterbi search
under character bigrams of single-script words, with a cost for changing script
within a token, picks one reading. The lattice depends on how the token looks
alone, so all tokens that look the same get the same reading. Case, accents,
digits, raised or circled digits and other punctuation stay as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.session import cut

#: Latin letters and the Cyrillic and Greek letters drawn alike.
ALIKE = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ",
    "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ", "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο",
    "p": "р", "q": "ԛ", "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү", "Æ": "Ӕ", "æ": "ӕ", "Ə": "Ә", "ə": "ә",
}
#: Hyphens, and the characters besides format characters that can't be seen.
HYPHENS = "‐‑﹣－"
UNSEEN = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"
_JOINERS = "‌‍"
#: Overrides of direction change what is seen.
_VISIBLE_FORMAT = "‭‮"

_LATIN_OF = {ord(m): latin for latin, members in ALIKE.items() for m in members}
_OPTIONS = {latin: latin + members for latin, members in ALIKE.items()}
_JOINING = regex.compile(r"[\p{Arabic}\p{Syriac}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}\p{So}\p{Sk}️]")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]+")

SWITCH_COST = 6.0
START = "^"


class _Folding(dict):
    """Translation of single characters, worked out once each."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        kind = unicodedata.category(ch)
        to = ch
        if kind == "Zs":
            to = " "
        elif ch in HYPHENS:
            to = "-"
        elif ch in UNSEEN or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            to = ""
        elif kind == "Cf":
            to = ch if ch in _JOINERS or ch in _VISIBLE_FORMAT else ""
        elif kind == "Cc" and ch not in "\t\n\r":
            to = ""
        else:
            how = unicodedata.decomposition(ch)
            # ligatures, digraphs and numerals made of letters; not raised, circled, squared forms
            if how.startswith(("<wide>", "<narrow>")) or (how.startswith("<compat>") and kind in ("Ll", "Lu", "Lt", "Nl")):
                to = "".join(self[int(x, 16)] for x in how.split()[1:])
        self[code] = to
        return to


_FOLD = _Folding()


def fold(text: str) -> str:
    """Widths, compositions, spaces, hyphens and unseen characters to one form (decomposed)."""
    if text.isascii():
        # nothing to fold but characters that can't be seen
        return _CONTROL.sub("", text)
    if any(j in text for j in _JOINERS):
        # between joining letters or pictures a joiner changes what is seen
        def keep(m: regex.Match) -> str:
            at, end = m.start(), m.end()
            shapes = at > 0 and end < len(text) and _JOINING.match(text[at - 1]) and _JOINING.match(text[end])
            return m[0] if shapes else ""

        text = regex.sub(f"[{_JOINERS}]+", keep, text)
    return unicodedata.normalize("NFD", text.translate(_FOLD))


def looks(text: str) -> str:
    """A key that is equal for texts that look the same: folded, alike letters as Latin ones."""
    return fold(text).translate(_LATIN_OF)


@lru_cache(maxsize=4096)
def script_of(ch: str) -> str:
    """Script of a letter; '' for what belongs to any."""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "?").split()[0]
    return name if name in ("LATIN", "CYRILLIC", "GREEK") else "OTHER"


def bigrams(text: str) -> Counter:
    """Letter pairs of the tokens of one script, each with the token's start."""
    return pairs_of(Counter(_TOKEN.findall(fold(text))))


def pairs_of(tokens: Counter) -> Counter:
    """The same of counted tokens."""
    out: Counter = Counter()
    for token, n in tokens.items():
        letters = [c for c in token if c.isalpha()]
        scripts = {script_of(c) for c in letters}
        if len(scripts) == 1 and scripts <= {"LATIN", "CYRILLIC", "GREEK"}:
            for a, b in zip([START, *letters], letters, strict=False):
                out[a, b] += n
    return out


class Reader:
    """Chooses the reading of tokens under bigram counts of the whole corpus."""

    def __init__(self, counts: dict[tuple[str, str], int], memory: int = 200_000):
        self.counts, self.memory = counts, memory
        self.before: Counter = Counter()
        for (a, _), n in counts.items():
            self.before[a] += n
        self.known: dict[str, str] = {}

    def _score(self, a: str, b: str) -> float:
        return math.log((self.counts.get((a, b), 0) + 0.1) / (self.before.get(a, 0) + 60.0))

    def token(self, shape: str) -> str:
        """The best path through the lattice of a shape (letters as Latin where alike)."""
        if (found := self.known.get(shape)) is not None:
            return found
        # state: last letter -> (score, path); ties by path, so the result is fixed
        paths: dict[str, tuple[float, str]] = {START: (0.0, "")}
        for ch in shape:
            if not ch.isalpha():
                paths = {k: (s, p + ch) for k, (s, p) in paths.items()}
                continue
            now: dict[str, tuple[float, str]] = {}
            for option in _OPTIONS.get(ch, ch):
                best = None
                for last, (s, p) in paths.items():
                    changes = last != START and script_of(last) != script_of(option)
                    found = (s + self._score(last, option) - SWITCH_COST * changes, p + option)
                    if best is None or (-found[0], found[1]) < (-best[0], best[1]):
                        best = found
                now[option] = best
            paths = now
        out = min((-s, p) for s, p in paths.values())[1]
        if len(shape) <= 64:
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[shape] = out
        return out

    def text(self, text: str) -> str:
        read = _TOKEN.sub(lambda m: self.token(m[0]), looks(text))
        return unicodedata.normalize("NFC", read)


def corpus_bigrams(docs: DataFrame, text: str = "text") -> dict[tuple[str, str], int]:
    """Bigram counts over all documents: at most the pairs of letters of three scripts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            # a batch's tokens are counted before they are taken apart, so that each is taken apart once
            tokens: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    tokens.update(_TOKEN.findall(fold(t)))
            total.update(pairs_of(tokens))
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in total]), pa.array([k[1] for k in total]), pa.array(list(total.values()), pa.int64())], names=["a", "b", "n"]
            )

    per_task = docs.select(text).mapInArrow(count, "a string, b string, n long")
    return {(r["a"], r["b"]): r["n"] for r in per_task.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


_READERS: dict[int, Reader] = {}


def _reader(key: int, counts: dict) -> Reader:
    """One reader per worker process and model."""
    if key not in _READERS:
        _READERS.clear()
        _READERS[key] = Reader(counts)
    return _READERS[key]


def unified(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """(key, unified, look, same): the one form of each text and hashes of it and of the text as it is.

    Null texts have null in all three; a text without a visible character has an
    empty ``unified`` and a null ``look``. Texts are read whole. keep_text=False
    leaves ``unified`` null, where only the hashes are wanted.
    """
    counts = corpus_bigrams(docs, text)
    model = hash(frozenset(counts.items()))
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(model, shared.value)
        for batch in batches:
            forms, looks_, same = [], [], []
            for t in batch.column(1).to_pylist():
                form = None if t is None else reader.text(t)
                if form is not None and not form.strip():
                    form = ""
                forms.append(form if keep_text else None)
                looks_.append(hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest() if form else None)
                same.append(None if t is None else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string()), pa.array(looks_, pa.binary()), pa.array(same, pa.binary())], names=[key, "unified", "look", "same"])

    schema = docs.select(F.col(key), F.lit(None).cast("string").alias("unified"), F.lit(None).cast("binary").alias("look"), F.lit(None).cast("binary").alias("same")).schema
    return docs.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, schema)


def lookalike_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), a < b: documents of different text that look the same.

    Works on distinct texts: those that share a look are paired, then each is
    replaced by its documents. Exact copies are never paired with each other, so
    a text with very many copies costs what its links to other texts cost.
    """
    hashed = cut(unified(docs, key, text, keep_text=False).drop("unified").where("look IS NOT NULL"), "looks")
    texts = hashed.select("look", "same").distinct()
    several = texts.groupBy("look").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("look")
    texts = texts.join(several, "look", "left_semi")
    links = texts.join(texts.withColumnRenamed("same", "other"), "look").where("same < other")
    left = links.join(hashed.select("look", "same", F.col(key).alias("x")), ["look", "same"])
    right = hashed.select("look", F.col("same").alias("other"), F.col(key).alias("y"))
    pairs = left.join(right, ["look", "other"])
    return pairs.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).where(F.col(f"{key}_a") < F.col(f"{key}_b")).distinct()


def lookalike_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, links): each document with its class and how many documents of it have another text.

    class_id is the least key of the documents that look the same. Documents
    without a visible character have none and give no row. Counts are made per
    distinct text first, so a text of very many copies is one row of its class.
    """
    hashed = cut(unified(docs, key, text, keep_text=False).drop("unified").where(F.col("look").isNotNull() & F.col(key).isNotNull()), "looks")
    texts = hashed.groupBy("look", "same").agg(F.min(key).alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = texts.groupBy("look").agg(F.min("least").alias("class_id"), F.sum("copies").alias("members"), F.count(F.lit(1)).alias("texts"))
    # most looks have one text; only the others need to be joined twice
    several = texts.join(classes.where("texts > 1"), "look").select("look", "same", "class_id", (F.col("members") - F.col("copies")).alias("links"))
    alone = texts.join(classes.where("texts = 1").select("look", "class_id"), "look").select("look", "same", "class_id", F.lit(0).cast("long").alias("links"))
    return hashed.join(several.unionByName(alone), ["look", "same"]).select(key, "class_id", "links").distinct()


def one_form(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form): every text in its one form; null stays null, a text without a visible character is empty."""
    return unified(docs, key, text).select(key, F.col("unified").alias("form"))
