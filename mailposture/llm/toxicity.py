"""Toxicity of texts whose words may be disguised: a noisy channel restores words, then the restored text is scored.

Writers replace letters by look-alikes, put separators or blanks between letters, and repeat letters.  A disguised word is decoded by exact Viterbi search over a lattice: each
observed character may stand for some letters, or for nothing, at a cost, and a character trigram model prices the letters.  The trigram counts are
taken over all documents.  Learnt words are a second model beside the trigrams, an automaton that the search passes through at the same time.  Words that no writer
disguised have one path through the lattice and are taken as they are.

Toxic words and word stems (beginnings) are learnt from labelled rows: those whose rate in toxic texts exceeds that in other texts beyond chance.  A text counts
once for a word, by the context of its first place (the word before), and equal contexts count once, so neither repetition nor many copies of one text
count as evidence.  A logistic curve over the weight of a text's most telling word, and a part of those of its other toxic words, gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailposture.llm.blocks import pieces, tidy
from mailposture.llm.language import bucket_of, letter_table

#: What a look-alike may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¢": "c", "§": "s", "*": "aeiou", "#": "haeiou", "%": "x", "&": "a",
}
#: Costs in nats: a look-alike, a wildcard, a dropped separator, a dropped repetition, a dropped character of any other kind.
LOOK, WILD, GAP, REPEAT, DROP = 1.0, 2.5, 0.5, 0.5, 4.0
#: Look-alikes that may be mere punctuation at the ends of a token, and the cost of taking them so.
PUNCTUATION, EDGE = "!|+(<{§*#%&", 0.5
#: Letters of other scripts by the letter whose shape they have.
TWINS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "b",
}
#: A learnt word costs this many nats less than its letters, and not more than ``LEXICON``.
MARGIN, LEXICON = 6.0, 4.0

#: Letters of the trigram model: a boundary, a-z, and one for all others.
SIZE = 28

#: Labelled rows to learn from, at most about this many; all rows where there are fewer.
LABELLED = 20_000
#: How a word has to stand out in toxic texts: root of the log-likelihood ratio, log of the ratio of rates, contexts.
SURE, RATE, CONTEXTS = 5.0, 1.5, 5
#: Share at which words beside the most telling one count, and the bounds of a word's weight and of a text's.
REST, STRONGEST, TOP = 0.3, 10.0, 16.0
#: Lengths of stems.
STEMS = range(3, 9)

#: Score from which a text counts as toxic.
REJECT = 0.7

CACHE_ENTRIES = 100_000

_SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…–—¡¿"
#: Marks at the ends of a token that cannot be look-alikes, and look-alikes that can be marks.
_MARKS = "".join(c for c in _EDGES if c not in LOOKS)
_LOOK_MARKS = "".join(c for c in LOOKS if not c.isdigit())
_NUMBER = re.compile(r"[$€£¢§#+(<-]*\d[\d.,:/+-]*[%$€£¢+)!*]*")
_STRETCHED = re.compile(r"(.)\1\1")
_BREAK = re.compile("[^0-9" + re.escape(_LOOK_MARKS) + r"\w]|_")
_DOUBLED = re.compile(r"(.)\1\1|(.)\2.*(.)\3")


def symbol_of(points: np.ndarray) -> np.ndarray:
    """Number of each character in the trigram model."""
    low = letter_table()[points]
    out = np.full(len(low), SIZE - 1, np.int64)
    out[low == 32] = 0
    latin = (low >= 97) & (low <= 122)
    out[latin] = low[latin] - 96
    return out


@tidy
def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for block in pieces(batch.column(0)):
            if block.data:
                s = symbol_of(np.frombuffer(b" \n".join([block.data, b""]).decode().encode("utf-32-le"), np.uint32))
                s = np.concatenate([np.zeros(2, np.int64), s])
                cell = (s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:]
                total += np.bincount(cell[(s[1:-1] > 0) | (s[2:] > 0)], minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])


def trigram_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a letter after two others, [first, second, letter], from the texts of all rows."""
    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_trigrams, "cell bigint, n bigint")
    counts = np.zeros(SIZE**3)
    for r in counted.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most SIZE ** 3 rows
        counts[r.cell] = r.n
    counts = counts.reshape(SIZE, SIZE, SIZE)
    single = counts.sum((0, 1)) + 1
    pair = counts.sum(0) + 2 * SIZE * single / single.sum()
    pair /= pair.sum(1, keepdims=True)
    three = counts + SIZE * pair[None]
    return np.log(three / three.sum(2, keepdims=True))


@lru_cache(4096)
def twins(letter: str) -> str:
    """Letters a-z as which a letter outside of them may be read: without its accents, or by its shape."""
    base = unicodedata.normalize("NFKD", letter)[0].lower()
    return base if base.isascii() and base.isalpha() else TWINS.get(letter, "")


class Decoder:
    """Restores disguised words: exact Viterbi search over the lattice of an observed string.

    A state is the last two symbols of the trigram model and the place in the automaton of the learnt words, so paths that agree in what still matters are joined and the
    cheapest is kept.  The cost of a path is that of its characters, minus the log probabilities of its letters, minus ``MARGIN`` or more for each learnt word.
    """

    #: States of the automaton of learnt words: where a word begins, no learnt word can follow, a learnt stem stands at its beginning.
    START, NONE, STEM = 0, 1, 2

    def __init__(self, trigrams: np.ndarray, weights: dict[str, float] | None = None):
        self.trigrams, self.weights = trigrams.tolist(), weights or {}
        self.follow: list[dict[str, int]] = [{}, {}, {}]
        self.ends: dict[int, float] = {self.STEM: 0.0}  # what is deducted where a learnt word ends
        self.stems: dict[int, float] = {}  # and where a learnt stem goes on
        self.openings: set[str] = set()
        for form in self.weights:
            node, word = self.START, form.rstrip("*")
            for letter in word:
                if letter not in self.follow[node]:
                    self.follow[node][letter] = len(self.follow)
                    self.follow.append({})
                node = self.follow[node][letter]
            if form.endswith("*"):
                self.stems[node] = max(MARGIN, self.price(word) - LEXICON)
            else:
                self.ends[node] = max(MARGIN, self.price(word + " ") - LEXICON)
                self.openings.update(word[:k] for k in range(1, len(word)))
        self.moves: dict[tuple[str, bool, bool], list[tuple[str, float]]] = {}

    @staticmethod
    def _number(letter: str) -> int:
        return ord(letter) - 96 if "a" <= letter <= "z" else SIZE - 1

    def _next(self, node: int, letter: str) -> int:
        if node in self.stems or node == self.STEM:
            return self.STEM
        return self.follow[node].get(letter, self.NONE)

    @staticmethod
    def _moves(c: str, again: bool, edge: bool) -> list[tuple[str, float]]:
        """What a character may stand for, with costs; an empty string drops it, a blank ends a word.  ``again``: it repeats the one before."""
        if c.isalpha():
            return [(c, 0.0), *[(x, LOOK) for x in ("" if c.isascii() else twins(c))], *([("", REPEAT)] if again else [])]
        if c == " ":
            return [("", 0.0), (" ", 0.0)]
        if c in LOOKS:
            drop = EDGE if edge and c in PUNCTUATION else 2 * LOOK if edge else REPEAT if again else DROP if c.isdigit() else 2 * LOOK
            return [*[(x, WILD if c in "*#" else LOOK) for x in LOOKS[c]], ("", drop)]
        return [("", DROP)] if c.isdigit() else [("", GAP), (" ", GAP)]

    def lattice(self, observed: str) -> Iterator[list[tuple[str, float]]]:
        """The moves of each character.  Look-alikes at either end may be mere punctuation."""
        first, last = len(observed) - len(observed.lstrip(_LOOK_MARKS)), len(observed.rstrip(_LOOK_MARKS))
        before = ""
        for at, c in enumerate(observed):
            key = (c, c == before, at < first or at >= last)
            moves = self.moves.get(key)
            if moves is None:
                moves = self.moves[key] = self._moves(*key)
            yield moves
            before = before if c == " " else c

    def best(self, observed: str) -> tuple[float, str]:
        """(cost, letters with blanks between words) of the cheapest path that has a letter; infinity and no letters where there is none.

        What a path has read is a chain of steps, so time and memory grow with the length of ``observed``.
        """
        trigrams, ends, stems = self.trigrams, self.ends, self.stems
        chain: list[tuple[int, str]] = [(-1, "")]
        states: dict[tuple[int, int, int], tuple[float, int]] = {(0, 0, self.START): (0.0, 0)}
        for moves in self.lattice(observed):
            after: dict[tuple[int, int, int], tuple[float, int, str]] = {}
            for (a, b, node), (cost, step) in states.items():
                for letter, price in moves:
                    if not letter or (letter == " " and b == 0):
                        key, value, letter = (a, b, node), cost + price, ""
                    elif letter == " ":
                        key, value = (b, 0, self.START), cost + price - trigrams[a][b][0] - ends.get(node, 0.0)
                    else:
                        n = ord(letter) - 96 if "a" <= letter <= "z" else SIZE - 1
                        key, value = (b, n, self._next(node, letter)), cost + price - trigrams[a][b][n] - stems.get(node, 0.0)
                    if key not in after or value < after[key][0]:
                        after[key] = (value, step, letter)
            states = {}
            for key, (cost, step, letter) in after.items():
                if letter:
                    chain.append((step, letter))
                    step = len(chain) - 1
                states[key] = (cost, step)
        least, at = math.inf, 0
        for (a, b, node), (cost, step) in states.items():
            cost -= (trigrams[a][b][0] if b else 0.0) + ends.get(node, 0.0)
            if cost < least and (a, b) != (0, 0):
                least, at = cost, step
        letters = []
        while at > 0:
            at, letter = chain[at]
            letters.append(letter)
        return least, "".join(reversed(letters)).strip()

    def restore(self, observed: str) -> str:
        return self.best(observed)[1]

    def reaches(self, observed: str) -> bool:
        """Whether any path of the lattice, at any cost, holds a learnt word."""
        nodes = {self.START}
        begins = max((m.end() for m in _BREAK.finditer(observed)), default=0)
        for at, moves in enumerate(self.lattice(observed)):
            if not nodes and at >= begins:  # no word begins any more
                return False
            after: set[int] = set()
            for letter, _ in moves:
                if not letter:
                    after |= nodes
                elif letter == " ":
                    if not self.ends.keys().isdisjoint(nodes):
                        return True
                    after.add(self.START)
                else:
                    after.update(self._next(node, letter) for node in nodes)
            if self.STEM in after:
                return True
            after.discard(self.NONE)
            nodes = after
        return not self.ends.keys().isdisjoint(nodes)

    def price(self, text: str) -> float:
        """Cost of letters and blanks as they stand."""
        a = b = 0
        total = 0.0
        for letter in text:
            n = 0 if letter == " " else self._number(letter)
            total -= self.trigrams[a][b][n]
            a, b = b, n
        return total

    def joined(self, words: list[str]) -> Iterator[str]:
        """Learnt words written in pieces with blanks between, where the trigrams find the whole likelier than the pieces by ``LOOK`` for each blank.

        Single letters only are no pieces: the search through spaced letters reads the words around them as well.
        """
        for at, word in enumerate(words):
            end = at
            while word in self.openings and end + 1 < len(words):
                end += 1
                word += words[end]
                if word in self.weights and len(word) > end - at + 1 and self.price(word + " ") + LOOK * (end - at) < self.price(" ".join([*words[at : end + 1], ""])):
                    yield word

    def known(self, text: str) -> bool:
        return any(weight_of(word, self.weights) for word in text.split())


def disguised(token: str) -> bool:
    """Whether a token (lower case) is more than letters: look-alikes or separators inside, or letters stretched.  Plain numbers are not."""
    if token.isalpha():
        return _STRETCHED.search(token) is not None
    return _NUMBER.fullmatch(token) is None and any(c.isalpha() or (c in LOOKS and not c.isdigit()) for c in token)


def suspicious(token: str) -> bool:
    """Whether a token might be a learnt word in disguise: also by two doubled letters, or letters that look like a-z."""
    return bool(_DOUBLED.search(token)) or not token.isascii() if token.isalpha() else disguised(token)


def restored(token: str, decoder: Decoder) -> str:
    """The word that a token (lower case) stands for; words with a blank between them, where a token joins several.

    Doubled letters, accents and look-alikes at the ends belong to clean words as well, so they are read as a disguise only where that gives a learnt word.
    """
    if not token.isascii():
        token = unicodedata.normalize("NFKC", token).lower()
    whole = token.strip(_MARKS)
    if _NUMBER.fullmatch(whole):
        return whole
    if decoder.weights and suspicious(whole) and decoder.reaches(whole):
        text = decoder.restore(whole)
        if decoder.known(text):
            return text
    bare = whole.strip(_EDGES)
    return decoder.restore(bare) if disguised(bare) else bare


def _words(text: str, decoder: Decoder, cache: dict[str, str]) -> list[str]:
    low = text.lower()
    if len(cache) > CACHE_ENTRIES:
        cache.clear()
    out = []
    for token in low.split():
        word = cache.get(token)
        if word is None:
            word = cache[token] = restored(token, decoder)
        if " " in word:
            out += word.split()
        elif word:
            out.append(word)
    more = list(decoder.joined(out)) if decoder.weights else []
    for run in _SPACED.finditer(low):
        letters = run[0].split()
        if not all(map(str.isdigit, letters)):
            more += decoder.restore(" ".join(letters)).split()
    return out + more


def forms(word: str) -> list[str]:
    """What may be learnt of a word: itself and its stems."""
    return [word, *[word[:k] + "*" for k in STEMS if k < len(word)]]


def weight_of(word: str, weights: dict[str, float]) -> float:
    """Weight of the most telling form of a word, 0 if none was learnt."""
    return max((weights[f] for f in forms(word) if f in weights), default=0.0) if weights else 0.0


@dataclass
class ToxicityModel:
    trigrams: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    slope: float = 1.0


@tidy
def _contexts(batches: Iterator[pa.RecordBatch], trigrams: np.ndarray, wanted: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """(form, before) of every text's words, or of the ``wanted`` forms only: the word before the first place of the form."""
    decoder, cache, known = Decoder(trigrams), {}, {}
    for batch in batches:
        seen: dict[tuple[str, str], None] = {}
        for text in batch.column(0).to_pylist():
            first: dict[str, str] = {}
            before = ""
            for word in _words(text or "", decoder, cache):
                if word not in first:
                    here = known.get(word)
                    if here is None:
                        here = forms(word)
                        if wanted is not None:
                            if len(known) > CACHE_ENTRIES:
                                known.clear()
                            here = known[word] = [f for f in here if f in wanted]
                    for form in here:
                        first.setdefault(form, before)
                before = word
            seen.update(dict.fromkeys(first.items()))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.string()), pa.array([b for _, b in seen], pa.string())], ["form", "before"])


@tidy
def _sums(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    decoder, cache = Decoder(model.trigrams, model.weights), {}
    known: dict[str, float] = {}
    for batch in batches:
        sums = []
        for text in batch.column(1).to_pylist():
            total = most = 0.0
            for word in sorted(set(_words(text or "", decoder, cache))):
                weight = known.get(word)
                if weight is None:
                    if len(known) > CACHE_ENTRIES:
                        known.clear()
                    weight = known[word] = weight_of(word, model.weights)
                total, most = total + weight, max(most, weight)
            sums.append(min(TOP, most + REST * (total - most)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64())], ["id", "weight"])


def logistic(points: list[tuple[float, int, int]], rounds: int = 50) -> tuple[float, float]:
    """(bias, slope) of a logistic curve through (x, label, count), by Newton steps with a small ridge on the slope."""
    bias = slope = 0.0
    for _ in range(rounds):
        g0, g1, h00, h01, h11 = 0.0, 0.02 * slope, 1e-9, 0.0, 0.02
        for x, label, n in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + slope * x))))
            g0, g1 = g0 + n * (p - label), g1 + n * (p - label) * x
            w = n * p * (1 - p)
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        bias -= max(-2.0, min(2.0, (h11 * g0 - h01 * g1) / det))
        slope -= max(-2.0, min(2.0, (h00 * g1 - h01 * g0) / det))
    return bias, slope


def specific(counts: dict[str, int]) -> dict[str, int]:
    """Without stems that stand mostly for one longer form, which is then the one to learn."""
    longest: dict[str, int] = {}
    for form, n in counts.items():
        for stem in forms(form.rstrip("*"))[1:]:
            longest[stem] = max(longest.get(stem, 0), n)
    return {form: n for form, n in counts.items() if 10 * longest.get(form, 0) < 8 * n}


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> ToxicityModel:
    """Learn trigrams from all of ``df``, and toxic words from about ``labelled`` rows of ``labels`` (all where there are fewer).

    ``labelled`` bounds what is broadcast (ids of the sample) and what is learnt from labels; the trigrams come from every text.  Without toxic or
    without other labelled rows no word is toxic.
    """
    trigrams = trigram_model(df, text_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    n = known.count()
    share = min(1.0, labelled / max(1, n))
    sample = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(2 * labelled)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    size = {r.label: r.n for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = ToxicityModel(trigrams)
    if not size.get(0) or not size.get(1):
        return model

    def count(label: int, wanted: frozenset[str] | None) -> DataFrame:
        rows = texts.filter(F.col("label") == label).select("text")
        places = rows.mapInArrow(lambda b: _contexts(b, trigrams, wanted), "form string, before string").select("form", F.xxhash64("before").alias("before"))
        return places.distinct().groupBy("form").agg(F.count(F.lit(1)).alias("n"))

    found = specific({r.form: r.n for r in count(1, None).filter((F.col("n") >= CONTEXTS) & (F.length("form") > 1)).collect()})
    rare = {r.form: r.n for r in count(0, frozenset(found)).collect()}
    part = size[1] / (size[0] + size[1])
    for form, a in found.items():
        c = rare.get(form, 0)
        rate = math.log((a + 0.5) / size[1]) - math.log((c + 0.5) / size[0])
        ratio = 2 * (a * math.log(a / ((a + c) * part)) + (c * math.log(c / ((a + c) * (1 - part))) if c else 0.0))
        if rate > RATE and ratio > SURE**2:
            model.weights[form] = round(min(rate, STRONGEST), 3)
    summed = texts.select("label", "text").mapInArrow(lambda b: _sums(b, model), "id int, weight double")
    binned = summed.groupBy("id", (F.round(F.col("weight") * 4) / 4).alias("x")).count().collect()
    model.bias, model.slope = logistic([(r.x, r.id, r["count"]) for r in binned])
    return model


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, from the text alone; null and empty texts get the score of a text without toxic words."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    summed = rows.mapInArrow(lambda b: _sums(b, model), f"id {kind}, weight double")
    value = 1 / (1 + F.exp(-(F.lit(model.bias) + F.lit(model.slope) * F.col("weight"))))
    return summed.select(F.col("id").alias(id_col), value.alias("score"))


@tidy
def _kept(batches: Iterator[pa.RecordBatch], model: ToxicityModel, at: int, reject: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(at)
        scored = next(_sums(iter([pa.RecordBatch.from_arrays([text, text], ["id", "text"])]), model))
        odds = model.bias + model.slope * scored.column(1).to_numpy()
        yield batch.filter(pa.array(1 / (1 + np.exp(-odds)) < reject))


def keep_clean(df: DataFrame, model: ToxicityModel, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """Rows of ``df`` with a score below ``reject``, with all columns, filtered where they are read."""
    at = df.columns.index(text_col)
    return df.mapInArrow(lambda b: _kept(b, model, at, reject), df.schema)


def train_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learnt from: the remaining third is held out."""
    return labels.filter(bucket_of(id_col, 3) != 1)
