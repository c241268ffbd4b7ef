"""One consistent form for texts that look the same.

First what does not show goes: ignorable characters, the width of letters and blanks, ligatures and font
variants, the order of accents. Then every word, as it is written, becomes a lattice: for each letter the
letters of all scripts that are drawn like it. Viterbi search picks the path with the best script-consistent
character bigrams, which were counted over the whole corpus on words of one script; changing the script
inside a word is penalised, and the letters of a text that can only be of one script set the prior. In a
text without a letter that can only be foreign, the lattices hold Latin letters alone and each word has one
path.

Letters drawn alike have the same column of the lattice, whatever letter was written, and the prior counts
only letters that have no look-alike. Texts that look the same therefore get the same form, and texts that
differ visibly differ in some lattice; which of the look-alike spellings the form has is what the search
decides: a Russian text with Latin letters in it becomes Russian, an English one with Cyrillic letters
English. Case, digits, accents and the number of blanks are visible and stay.

Defined results: null texts have no form and come out with a null form. Empty texts and texts of ignorable
characters only look the same: their form is empty. A corpus without words gives a flat model; the form
then still depends on looks only. Repeated rows come out once for each id. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.forms import LOOK_ALIKES, compatible
from symweave.operators import skew
from symweave.runtime import cut

_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ][^\W\d_]*)*")
SWITCH = 9.0
PRIOR = 1.5


@functools.cache
def script(c: str) -> str:
    """The script of a letter, by the first word of its Unicode name; letters of phonetic use are Latin."""
    return (unicodedata.name(c, "") or "NONE").split(" ", 1)[0]


_ALIKE = {x: (latin, *others) for latin, others in LOOK_ALIKES.items() for x in (latin, *others)}
_IMITATES = {x for others in LOOK_ALIKES.values() for x in others}
#: Only scripts that have look-alikes need a model, which keeps it to pairs of some hundred letters.
_SCRIPTS = {script(c) for c in _IMITATES} | {"LATIN"}
#: Different words kept before their bigrams are added up.
_WORDS = 200_000


def bigrams(words: dict[str, int], out: Counter) -> None:
    """Adds the character bigrams of those of the counted words that can only be of one script.

    ``^`` and ``$`` stand for a word's ends. A word of another script made of look-alikes only tells nothing.
    """
    for word, n in words.items():
        if not word.isascii():
            kinds = {script(c) for c in word if not unicodedata.combining(c)}
            if len(kinds) != 1 or not kinds <= _SCRIPTS or all(c in _IMITATES for c in word):
                continue
        for pair in zip("^" + word, word + "$"):
            out[pair] += n


def count_bigrams(documents: DataFrame, text: str = "text") -> dict[tuple[str, str], int]:
    """Bigram counts over all documents. The result is bounded by pairs of letters, not by the corpus."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        words: Counter = Counter()
        for b in batches:
            for t in b["t"]:
                words.update(_WORD.findall(compatible(t).lower()))
                if len(words) > _WORDS:
                    bigrams(words, seen)
                    words.clear()
        bigrams(words, seen)
        yield pd.DataFrame([(a, b, n) for (a, b), n in seen.items()], columns=["a", "b", "n"])

    rows = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(run, "a string, b string, n bigint")
    return {(r.a, r.b): r.n for r in rows.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()}


@functools.cache
def _alone(c: str) -> str:
    """A character with its letter in Latin shape where it has one: the only path of a lattice without foreign letters."""
    return unicodedata.normalize("NFC", "".join(_ALIKE.get(x, (x,))[0] for x in unicodedata.normalize("NFD", c)))


@functools.cache
def _unmistakable(c: str) -> str:
    """The script of a character's letter where only that script draws it, else an empty text."""
    kinds = [script(x) for x in unicodedata.normalize("NFD", c) if x.isalpha() and x not in _ALIKE]
    return kinds[0] if kinds and kinds[0] not in ("NONE", "MODIFIER", "FEMININE", "MASCULINE") else ""


class Model:
    """Chooses among letters that look the same."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.pair: dict[tuple[str, str], float] = {}
        before: Counter = Counter()
        after: dict[str, set[str]] = {}
        for (a, b), n in counts.items():
            before[a] += n
            after.setdefault(script(b) if b != "$" else "$", set()).add(b)
        self.before = before
        self.size = {s: len(v) + 1 for s, v in after.items()}
        self.counts = counts
        self.known: dict[tuple[str, str, int], str] = {}

    def score(self, a: str, b: str) -> float:
        a, b = a.lower(), b.lower()
        got = self.pair.get((a, b))
        if got is None:
            kinds = self.size.get(script(b) if b != "$" else "$", 1)
            got = self.pair[a, b] = math.log((self.counts.get((a, b), 0) + 0.1) / (self.before[a] + 0.1 * (kinds + 1)))
        return got

    def word(self, written: str, other: str, weight: int) -> str:
        """The best spelling in the lattice of a word; ``other`` is the text's second script, ``weight`` its prior."""
        key = (written, other, weight)
        if key in self.known:
            return self.known[key]
        # each entry: best score and path of the spellings that end in a letter
        best: dict[str, tuple[float, str]] = {"^": (0.0, "")}
        for c in unicodedata.normalize("NFD", written):
            if unicodedata.combining(c):
                best = {a: (s, p + c) for a, (s, p) in best.items()}
                continue
            step: dict[str, tuple[float, str]] = {}
            for x in _ALIKE.get(c, (c,)):
                kind = script(x)
                start = 0.0 if kind == "LATIN" else PRIOR * weight if kind == other else -SWITCH
                options = []
                for a, (s, p) in best.items():
                    change = start if a == "^" else 0.0 if script(a) == kind else -SWITCH
                    options.append((s + self.score(a, x) + change, p + x))
                step[x] = max(options, key=lambda o: (o[0], [-ord(y) for y in o[1]]))
            best = step
        total = max(((s + self.score(a, "$"), p) for a, (s, p) in best.items()), key=lambda o: (o[0], [-ord(y) for y in o[1]]))
        out = unicodedata.normalize("NFC", total[1])
        if len(self.known) < _WORDS:
            self.known[key] = out
        return out

    def form(self, text: str) -> str:
        """The consistent form of a text."""
        text = compatible(text)
        if text.isascii():
            return text
        latin, foreign = 0, Counter()
        seen = Counter(text)
        for c, n in seen.items():
            kind = _unmistakable(c)
            if kind == "LATIN":
                latin += n
            elif kind:
                foreign[kind] += n
        if not foreign:  # one path for each word
            changed = {c: x for c in seen if c > "\x7f" and (x := _alone(c)) != c}
            for c, x in changed.items():
                text = text.replace(c, x)
            return unicodedata.normalize("NFC", text) if changed else text
        other, n = max(foreign.items(), key=lambda x: (x[1], x[0]))
        weight = max(-3, min(3, round(math.log((n + 1) / (latin + 1)))))
        return unicodedata.normalize("NFC", _WORD.sub(lambda m: self.word(m[0], other, weight), text))


def _digest(s: str) -> tuple[int, int]:
    d = hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def forms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, form`` for every document."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(Model(count_bigrams(documents, text)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "form": [None if t is None else model.value.form(t) for t in b["t"]]})

    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {dict(documents.dtypes)[key]}, form string").withColumnRenamed("k", key)


def digests(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, f1, f2, t1, t2``: 128-bit digests of the form and of the text itself; null texts are left out.

    Only digests are shuffled afterwards, never texts.
    """
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(Model(count_bigrams(documents, text)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [(*_digest(model.value.form(t)), *_digest(t)) for t in b["t"]]
            out = pd.DataFrame(data, columns=["f1", "f2", "t1", "t2"])
            out.insert(0, "k", b["k"].to_numpy())
            yield out

    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"k {dict(documents.dtypes)[key]}, f1 bigint, f2 bigint, t1 bigint, t2 bigint").withColumnRenamed("k", key)


def classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, f1, f2, t1, t2, variants, class_id`` of the documents whose look is written in several ways.

    ``class_id`` is the smallest id of the class, ``variants`` the number of different texts in it. The class
    table is made by map-side partial aggregation, and the documents of a frequent look are split over several
    tasks when they meet it.
    """
    marked = cut(digests(documents, key, text))
    texts = marked.groupBy("f1", "f2", "t1", "t2").agg(F.min(key).alias("least"))
    several = texts.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("variants"), F.min("least").alias("class_id")).where("variants > 1")
    return skew.joined(marked, several, ["f1", "f2"], key)


def look_alike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id_a, doc_id_b`` (a < b) for documents that look the same and are different character by character.

    The different texts of a look are paired first, then each text is replaced by its documents, so that copies
    of one text never meet each other: the work is in proportion to the documents and the pairs that come out.
    """
    rows = cut(classes(documents, key, text).select(F.col(key).alias("k"), "f1", "f2", "t1", "t2").where("k is not null"))
    one = rows.select("f1", "f2", "t1", "t2").distinct()
    x = one.select("f1", "f2", F.col("t1").alias("x1"), F.col("t2").alias("x2"))
    y = one.select("f1", "f2", F.col("t1").alias("y1"), F.col("t2").alias("y2"))
    two = x.join(y, ["f1", "f2"]).where((F.col("x1") < F.col("y1")) | ((F.col("x1") == F.col("y1")) & (F.col("x2") < F.col("y2")))).drop("f1", "f2")
    a = rows.select(F.col("t1").alias("x1"), F.col("t2").alias("x2"), F.col("k").alias("a"))
    b = rows.select(F.col("t1").alias("y1"), F.col("t2").alias("y2"), F.col("k").alias("b"))
    both = skew.joined(b, skew.joined(a, two, ["x1", "x2"], "a"), ["y1", "y2"], "b")
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct()
