"""Passages of held-out items inside corpus documents.

Every partition of the corpus builds an FM-index over its words ("training shard"); all short phrases of
all items are searched backwards in it at once and located by sampled suffix positions. The hits of a
document and an item are then merged to spans: the hits are extended over replaced words as long as at
most one word in eight differs, and two pieces that follow each other in both texts, with an insertion
between them, are added up. A pair is reported when the pieces cover ``min_words`` words of the item's own
wording. Words are those between blanks: ``muster_lot299`` is one, though the index holds its two parts.
A word is replaced by one word of any number of parts (``GLUED`` where no blank parts it from the words
beside it), or by as many parts as it has.

Why short phrases find everything: ``min_words`` = 24 words with 3 replaced and one insertion fall into at
most 5 runs of 21 words, so that one run has at least 5; phrases have ``phrase`` = 4.

With one block of items, only words that occur in some item get a symbol of their own; every run of other
words is one mark that no phrase contains. With more blocks, each shard is indexed once over all of its
words and written to the shared folder, and every block is searched in the stored indexes. Either way the
index covers every document in full.

A phrase may be common and many items may share it: hits are expanded for some documents at a time, and a
pair is aligned only if its exact runs can be parts of a passage at all (``_promising``).

Defined results: null and empty texts have no words and no hits. Letter case, punctuation, spacing,
markup, line layout and the forms of characters do not count. Sentences that ``shared`` or more items have
in common are standing instructions and belong to no item's own wording. Repeated documents each come out
under their own id; a null id comes out as null. An item of fewer than ``min_words`` own words is reported
nowhere. An item with several texts counts with each of them; pairs may then repeat. An empty corpus or item table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html
import pickle
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.fmindex import FMIndex
from symweave.llm.forms import skeleton
from symweave.runtime import cut

MIN_WORDS, ONE_IN, PHRASE, SHARED = 24, 8, 4, 5
#: Words of the shorter of two pieces with an insertion between.
LEAST = 3
#: Parts that a replacing word may have where no blanks set it apart from its neighbours; with blanks it may have any number.
GLUED = 8
#: Words of a shard: a partition is indexed in pieces of at most about this size (whole documents).
SHARD = 1_000_000
#: Items searched at once. More items are searched block after block in the stored indexes, so what is broadcast is bounded.
BLOCK, BLOCK_CHARACTERS = 5_000, 20_000_000
#: Hits times items that are expanded at once.
EXPANDED = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def plain(text: str | None) -> str:
    """A text in one form: looks folded, tags and entities undone, lower case."""
    if not text:
        return ""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return skeleton(text).lower()


def words(text: str | None) -> list[str]:
    """The words of a text in its one form, and the parts of those with punctuation inside."""
    return _WORD.findall(plain(text))


def sentences(text: str) -> list[str]:
    return _SENTENCE.split(text.strip())


class Items:
    """The own wording of a block of items, as numbers.

    ``standing`` are the sentences, in one form, of the standing instructions; without it the block holds all items.
    """

    def __init__(self, rows: list[tuple[int, str]], shared: int = SHARED, phrase: int = PHRASE, standing: set[str] | None = None):
        split = [(i, sentences(t)) for i, t in rows if t]
        if standing is None:
            seen = Counter(s for _, s in {(i, " ".join(words(x))) for i, ss in split for x in ss})
            standing = {s for s, n in seen.items() if n >= shared}
        self.ids: list[int] = []
        self.units: list[list[tuple[int, ...]]] = []
        self.begins: list[list[int]] = []
        self.vocabulary: dict[str, int] = {}
        starts, owners, phrases = [], [], []
        for i, given in split:
            symbols, units, begins = [], [], []
            for s in given:
                if " ".join(words(s)) in standing:
                    continue
                for written in s.split():
                    own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words(written)]
                    if own:
                        begins.append(len(symbols))
                        units.append(tuple(own))
                        symbols += own
            k = len(self.ids)
            self.ids.append(i)
            self.units.append(units)
            self.begins.append(begins)
            for j in range(len(symbols) - phrase + 1):
                starts.append(j)
                owners.append(k)
                phrases.append(symbols[j : j + phrase])
        self.starts, self.owners = np.array(starts, np.int64), np.array(owners, np.int64)
        self.phrases = np.array(phrases, np.int64).reshape(-1, phrase)
        self.size = phrase

    @property
    def sigma(self) -> int:
        return len(self.vocabulary) + 1


class Document:
    """The symbols of a document, where each of them stands, and to which word between blanks it belongs."""

    def __init__(self, symbols: np.ndarray, parts: list[int] | None = None):
        self.symbols = symbols.tolist()
        self.parts = list(range(len(symbols))) if parts is None else parts
        self.places: dict[int, list[int]] = defaultdict(list)
        for d in np.flatnonzero(symbols > 1).tolist():
            self.places[self.symbols[d]].append(d)


def _parts(text: str) -> list[int]:
    """The number of the word between blanks for each of ``_WORD.findall(text)``."""
    sizes = [n for x in text.split() if (n := len(_WORD.findall(x)))]
    return np.repeat(np.arange(len(sizes)), sizes).tolist()


class _Alignment:
    """Matches ``(word of the item, place in the document)`` and the steps between them over replaced words.

    A run of matches is only left in its last two words: before, the next words match and none is replaced.
    """

    def __init__(self, item: list[tuple[int, ...]], doc: Document, one_in: int):
        self.item, self.doc, self.most = item, doc, len(item) // one_in
        self.begin = np.concatenate(([0], np.cumsum([len(x) for x in item]))).tolist()
        self.steps: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def matches(self, u: int, d: int) -> bool:
        if not 0 <= u < len(self.item) or not 0 <= d < len(self.doc.symbols):
            return False
        word = self.item[u]
        return self.doc.symbols[d] == word[0] and (len(word) == 1 or tuple(self.doc.symbols[d : d + len(word)]) == word)

    def after(self, u: int, d: int) -> list[tuple[int, int, int]]:
        """The matches that may follow one, with the number of words replaced between."""
        known = self.steps.get((u, d))
        if known is not None:
            return known
        out = self.steps[u, d] = []
        end, parts = d + len(self.item[u]), self.doc.parts
        if self.matches(u + 1, end):
            out.append((u + 1, end, 0))
            if self.matches(u + 2, end + len(self.item[u + 1])):
                return out
        for n in range(1, min(self.most, len(self.item) - u - 2) + 1):
            v = u + 1 + n
            same = end + self.begin[v] - self.begin[u + 1]
            if end + n >= len(parts):
                break
            places = self.doc.places.get(self.item[v][0])
            if not places:
                continue
            stop = bisect_left(parts, parts[end] + n)  # the replacements lie before this place
            found = set(places[bisect_left(places, end + n) : bisect_right(places, min(stop, end + n * GLUED))])
            found.add(same)
            if stop > end + n * GLUED and parts[end - 1] < parts[end]:
                found.add(stop)
            out += [(v, e, n) for e in found if self.matches(v, e)]
        return out

    def before(self, u: int, d: int) -> Iterator[tuple[int, int]]:
        """The matches that one may follow."""
        parts = self.doc.parts
        if u and self.matches(u - 1, d - len(self.item[u - 1])):
            yield u - 1, d - len(self.item[u - 1])
            if u > 1 and self.matches(u - 2, d - len(self.item[u - 1]) - len(self.item[u - 2])):
                return
        for n in range(1, min(self.most, u - 1) + 1):
            v = u - 1 - n
            size = len(self.item[v])
            same = d - (self.begin[u] - self.begin[v])
            if d - n < size:
                return
            places = self.doc.places.get(self.item[v][0])
            if not places:
                continue
            start = bisect_left(parts, parts[d - 1] - n + 1)  # the replacements lie from this place on
            found = set(places[bisect_left(places, max(start, d - n * GLUED) - size) : bisect_right(places, d - n - size)])
            found.add(same)
            if start < d - n * GLUED and parts[d - 1] < parts[d]:
                found.add(start - size)
            for e in found:
                if self.matches(v, e):
                    yield v, e

    def reached(self, seeds: set[tuple[int, int]]) -> list[tuple[int, int]]:
        """The seeds and all matches before and after them, in order."""
        known = set(seeds)
        for steps in (self.before, self.after):
            seen, todo = set(seeds), list(seeds)
            while todo:
                for x in steps(*todo.pop()):
                    if x[:2] not in seen:
                        seen.add(x[:2])
                        todo.append(x[:2])
            known |= seen
        return sorted(known)


def covered(item: list[tuple[int, ...]], doc: Document, seeds: set[tuple[int, int]], one_in: int = ONE_IN) -> int:
    """Most words of the item in one piece or two that follow each other in both texts. ``seeds`` are pairs of a word and its place."""
    way = _Alignment(item, doc, one_in)
    cells = way.reached(seeds)
    at = {c: n for n, c in enumerate(cells)}
    steps = [[(at[v, e], n) for v, e, n in way.after(u, d) if (v, e) in at] for u, d in cells]
    # by words replaced: the first word of the longest piece that ends in a match, the last of the longest that begins there
    first = [{0: u} for u, _ in cells]
    last = [{0: u} for u, _ in cells]
    for c, (u, _) in enumerate(cells):
        for x, n in steps[c]:
            for r, v in first[c].items():
                if r + n <= way.most and v < first[x].get(r + n, len(item)):
                    first[x][r + n] = v
    for c in range(len(cells) - 1, -1, -1):
        for x, n in steps[c]:
            for r, v in last[x].items():
                if r + n <= way.most and v > last[c].get(r + n, -1):
                    last[c][r + n] = v
    ending = [max(u - v + 1 if r * one_in <= u - v + 1 else 0 for r, v in f.items()) for (u, _), f in zip(cells, first)]
    starting = [max(v - u + 1 if r * one_in <= v - u + 1 else 0 for r, v in f.items()) for (u, _), f in zip(cells, last)]
    best = max(ending, default=0)
    ends: list[int] = []  # places where pieces of ever more words end, all before the word looked at
    sizes: list[int] = []
    done = 0
    for c, (u, d) in enumerate(cells):
        while cells[done][0] < u:
            v, e = cells[done]
            e, n = e + len(item[v]), ending[done]
            k = bisect_right(ends, e)
            if n >= LEAST and (not k or sizes[k - 1] < n):
                last_k = bisect_right(sizes, n, k)
                ends[k:last_k], sizes[k:last_k] = [e], [n]
            done += 1
        k = bisect_right(ends, d)
        if k and starting[c] >= LEAST:
            best = max(best, sizes[k - 1] + starting[c])
    return best


def _promising(runs: list[tuple[int, int, int]], min_words: int, one_in: int, phrase: int) -> bool:
    """Whether exact runs ``(start in the item, place, symbols)`` can be parts of a passage.

    ``min_words`` words with one in ``one_in`` replaced and one insertion are at most ``min_words // one_in + 2``
    runs; those too short for a phrase have fewer words than it. The runs stand in the same order in both texts.
    A longer passage has runs that are no shorter on average.
    """
    parts, rest = min_words // one_in + 2, phrase - 1
    need = min_words - min_words // one_in - parts * rest  # what the runs must have beyond ``rest`` words each
    if sum(sorted((n - rest for _, _, n in runs), reverse=True)[:parts]) < need:
        return False
    runs = sorted(runs)
    best: list[list[int]] = []  # the most of a chain of 1, 2, ... runs that ends in a run
    for j, (u, d, n) in enumerate(runs):
        mine = [n - rest] + [0] * (parts - 1)
        for k in range(j):
            v, e, m = runs[k]
            if v < u and e < d and v + m < u + n and e + m < d + n:
                for c in range(parts - 1):
                    if best[k][c] and best[k][c] + n - rest > mine[c + 1]:
                        mine[c + 1] = best[k][c] + n - rest
        if max(mine) >= need:
            return True
        best.append(mine)
    return False


class Shard:
    """Documents with their words, and the index over them.

    With ``vocabulary`` its words are the only ones that have symbols, else all words of the documents have.
    """

    def __init__(self, texts: list[list[str]], vocabulary: dict[str, int] | None = None, forms: list[str] | None = None):
        self.foreign = vocabulary is not None
        if vocabulary is None:
            vocabulary = {}
            for t in texts:
                for w in t:
                    vocabulary.setdefault(w, len(vocabulary) + 2)
        get = vocabulary.get
        self.vocabulary, self.forms = vocabulary, forms
        self.docs = [np.array([get(w, 1) for w in t], np.int32) for t in texts]
        keep, start = [], []
        total = 0
        for d in self.docs:  # a mark before each document, and one for each run of words without a symbol
            x = np.concatenate((np.ones(1, np.int32), d))
            kept = np.flatnonzero((x != 1) | np.concatenate(([True], x[:-1] != 1)))
            keep.append(kept - 1)
            start.append(total)
            total += len(kept)
        self.begin = np.array(start, np.int64)
        self.keep = np.concatenate(keep) if keep else np.empty(0, np.int64)
        self.index = None
        if total:
            seq = np.concatenate([np.where(k >= 0, d[np.maximum(k, 0)], 1) if len(d) else np.ones(len(k), np.int64) for d, k in zip(self.docs, keep)])
            self.index = FMIndex(seq, len(vocabulary) + 1)

    def search(self, items: Items, min_words: int = MIN_WORDS, one_in: int = ONE_IN) -> list[tuple[int, int, int]]:
        """``(document number, item number, words)`` of the passages."""
        if self.index is None or not len(items.phrases):
            return []
        phrases, units = items.phrases, items.units
        if not self.foreign:  # the items' numbers of words as this shard's; absent words match nothing
            own = np.full(len(items.vocabulary) + 2, -1, np.int64)
            for w, n in items.vocabulary.items():
                own[n] = self.vocabulary.get(w, -1)
            phrases = own[phrases]
            units = [[tuple(own[list(x)].tolist()) for x in u] for u in units]
        usable = np.flatnonzero((phrases > 0).all(axis=1))
        if not len(usable):
            return []
        unique, back = np.unique(phrases[usable], axis=0, return_inverse=True)
        order = np.argsort(back.reshape(-1), kind="stable")
        users = usable[order]  # phrases of items, grouped by the distinct phrase
        first = np.searchsorted(back.reshape(-1)[order], np.arange(len(unique) + 1))
        lo, hi = self.index.search(unique)
        found = np.flatnonzero(hi > lo)
        count = (hi - lo)[found]
        if not len(found):
            return []
        rows = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        which = np.repeat(found, count)
        at = self.index.locate(rows)
        o = np.argsort(at, kind="stable")
        which, at = which[o], at[o]
        doc = np.searchsorted(self.begin, at, side="right") - 1
        place = self.keep[at]
        fan = (first[1:] - first[:-1])[which]
        out: list[tuple[int, int, int]] = []
        upto = np.concatenate(([0], np.cumsum(fan)))
        a = 0
        while a < len(at):  # whole documents, so that a pair is seen at once
            b = max(a + 1, int(np.searchsorted(upto, upto[a] + EXPANDED, side="right")) - 1)
            b = int(np.searchsorted(doc, doc[b - 1], side="right")) if b == a + 1 or doc[b - 1] == doc[a] else b if b >= len(at) else int(np.searchsorted(doc, doc[b], side="left"))
            n = fan[a:b]
            user = users[np.repeat(first[which[a:b]] - (upto[a:b] - upto[a]), n) + np.arange(n.sum())]
            out += self._pairs(np.repeat(doc[a:b], n), items.owners[user], items.starts[user], np.repeat(place[a:b], n), items, units, min_words, one_in)
            a = b
        return out

    def _pairs(self, doc, owner, start, place, items, units, min_words, one_in) -> list[tuple[int, int, int]]:
        """The passages among hits of phrases: ``start`` of an item's phrase at ``place`` of a document."""
        phrase = items.size
        o = np.lexsort((start, place - start, owner, doc))
        doc, owner, start, place = doc[o], owner[o], start[o], place[o]
        same = (doc[1:] == doc[:-1]) & (owner[1:] == owner[:-1])
        joined = same & (place[1:] - start[1:] == place[:-1] - start[:-1]) & (start[1:] == start[:-1] + 1)
        run = np.flatnonzero(np.concatenate(([True], ~joined)))
        size = np.diff(np.append(run, len(doc))) + phrase - 1
        d, i, j, at = doc[run], owner[run], start[run], place[run]
        pair = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (i[1:] != i[:-1]))))
        out = []
        whole: Document | None = None
        which = -1
        for a, b in zip(pair.tolist(), [*pair[1:].tolist(), len(run)]):
            runs = list(zip(j[a:b].tolist(), at[a:b].tolist(), size[a:b].tolist()))
            if not _promising(runs, min_words, one_in, phrase):
                continue
            k, x = int(i[a]), int(d[a])
            if which != x:
                which, whole = x, Document(self.docs[x], self.forms and _parts(self.forms[x]))
            begins, cells = items.begins[k], set()
            for s, p, n in runs:
                for u in range(bisect_left(begins, s), bisect_left(begins, s + n)):
                    e = p + begins[u] - s
                    if tuple(whole.symbols[e : e + len(units[k][u])]) == units[k][u]:
                        cells.add((u, e))
            n = covered(units[k], whole, cells, one_in)
            if n >= min_words:
                out.append((x, k, n))
        return out


def search_shard(texts: list[list[str]], items: Items, min_words: int = MIN_WORDS, one_in: int = ONE_IN, forms: list[str] | None = None) -> list[tuple[int, int, int]]:
    """``(document number, item number, words)`` for the documents of one shard. Without their ``forms`` each part counts as a word."""
    return Shard(texts, items.vocabulary, forms).search(items, min_words, one_in)


def _said(items: DataFrame) -> DataFrame:
    """``item_id, sentence``: the distinct sentences of each item in one form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, s) for i, t in zip(b["item_id"], b["item_text"]) if t for s in {" ".join(words(x)) for x in sentences(t)}]
            yield pd.DataFrame(rows, columns=["item_id", "sentence"])

    return items.mapInPandas(run, f"item_id {dict(items.dtypes)['item_id']}, sentence string").distinct()


def _shards(batches: Iterator[pd.DataFrame], vocabulary: dict[str, int] | None) -> Iterator[tuple[list, Shard]]:
    """The documents of a partition in shards of about ``SHARD`` words: their ids and the index."""
    ids: list = []
    texts: list[list[str]] = []
    forms: list[str] = []
    size = 0
    for batch in batches:
        for k, t in zip(batch["doc_id"], batch["text"]):
            forms.append(plain(t))
            texts.append(_WORD.findall(forms[-1]))
            ids.append(k)
            size += len(texts[-1])
            if size >= SHARD:
                yield ids, Shard(texts, vocabulary, forms)
                ids, texts, forms, size = [], [], [], 0
    if ids:
        yield ids, Shard(texts, vocabulary, forms)


def _hits(ids: list, shard: Shard, items: Items, min_words: int) -> pd.DataFrame:
    return pd.DataFrame([(ids[d], items.ids[i], n) for d, i, n in shard.search(items, min_words)], columns=["doc_id", "item_id", "words"])


def leaks(documents: DataFrame, items: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, item_id, words`` for every document that carries a passage of an item.

    The corpus is read, split to words and indexed once, whatever the number of items.
    """
    spark = documents.sparkSession
    rows = items.where(F.col("item_text").isNotNull()).select("item_id", "item_text").distinct()
    docs = documents.where(F.col(text).isNotNull()).select("doc_id", F.col(text).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_CHARACTERS))
    columns = "doc_id bigint, item_id bigint, words int"
    if blocks == 1:
        block = spark.sparkContext.broadcast(Items(sorted(((r[0], r[1]) for r in rows.collect()), key=str)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for ids, shard in _shards(batches, block.value.vocabulary):
                yield _hits(ids, shard, block.value, min_words)

        return docs.mapInPandas(run, columns)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, shard in _shards(batches, None):
            yield pd.DataFrame({"shard": [pickle.dumps((ids, shard), protocol=5)]})

    shards = cut(docs.mapInPandas(build, "shard binary"))
    said = cut(_said(rows))  # standing instructions are shared by items of any blocks
    standing = cut(said.groupBy("sentence").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED))
    out = None
    for b in range(blocks):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b
        known = {r[0] for r in said.where(mine).join(standing, "sentence", "left_semi").select("sentence").distinct().collect()}
        block = spark.sparkContext.broadcast(Items(sorted(((r[0], r[1]) for r in rows.where(mine).collect()), key=str), standing=known))

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for stored in batch["shard"]:
                    yield _hits(*pickle.loads(stored), block.value, min_words)

        hits = cut(shards.mapInPandas(run, columns))
        block.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out
