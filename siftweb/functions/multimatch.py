"""Many words looked for in one pass over a text, and the words without which an expression can't match."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from re import _constants as kinds
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

def _safe(word: str) -> str | None:
    """Lower case, if lower-casing a text is sure to leave this part of it findable."""
    return word.lower() if word and all(c.isascii() or c.lower() == c.upper() for c in word) else None


def _required(parts) -> set[str] | None:
    found: list[set[str]] = []
    run = ""

    def close():
        nonlocal run
        word = _safe(run)
        if word:
            found.append({word})
        run = ""

    for kind, value in parts:
        if kind is kinds.LITERAL:
            run += chr(value)
            continue
        close()
        inner: list = []
        if kind is kinds.BRANCH:
            each = [_required(branch) for branch in value[1]]
            if all(each):
                found.append(set().union(*each))
        elif kind is kinds.SUBPATTERN:
            inner = value[3]
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = value[2]
        elif kind is kinds.ATOMIC_GROUP:
            inner = value
        words = _required(inner) if inner else None
        if words:
            found.append(words)
    close()
    return max(found, key=lambda ws: (min(len(w.encode()) for w in ws), -len(ws))) if found else None


def required_words(pattern: str) -> set[str] | None:
    """Lower-case words of which the lower-cased text holds at least one wherever ``pattern`` matches; None if none are known."""
    try:
        return _required(parser.parse(pattern))
    except (re.error, OverflowError, RecursionError):
        return None  # a form that only the other engine knows


def _grams(codes: np.ndarray) -> np.ndarray:
    """A number for the three bytes that start at every place; places at the end take the bytes of the next text, which the comparison sorts out."""
    padded = np.concatenate([codes, np.zeros(2, np.uint8)]).astype(np.uint32)
    return padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16


class _Finder:
    """Words as bytes by length: which starts are possible, and the words' numbers."""

    def __init__(self, own: Mapping[str, list[int]]):
        self.words: dict[int, dict[bytes, list[int]]] = {}
        for word, numbers in own.items():
            data = word.encode()
            self.words.setdefault(len(data), {})[data] = numbers
        self.sizes = sorted(self.words.items())
        #: 2 where a word of less than six bytes may stand, 1 where a longer one may, whose next three bytes are in ``seconds``
        self.starts, self.seconds = np.zeros(1 << 24, np.uint8), np.zeros(1 << 24, np.bool_)
        for word in sorted((w.encode() for w in own), key=len, reverse=True):
            if len(word) >= 3:
                self.starts[word[0] | word[1] << 8 | word[2] << 16] = 1 if len(word) >= 6 else 2
            elif len(word) == 2:
                self.starts[word[0] | word[1] << 8 | np.arange(256) << 16] = 2
            else:
                self.starts[word[0] | np.arange(1 << 16) << 8] = 2
            if len(word) >= 6:
                self.seconds[word[3] | word[4] << 8 | word[5] << 16] = True

    def find(self, texts: pa.Array) -> list[list[int]]:
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        found: list[set] = [set() for _ in range(len(texts))]
        if len(texts) and ends[-1] > ends[0]:
            data = texts.buffers()[2].to_pybytes()[ends[0]:ends[-1]]
            ends = ends - ends[0]
            grams = _grams(np.frombuffer(data, np.uint8))
            kinds = self.starts[grams]
            at = np.flatnonzero(kinds)
            at = at[(kinds[at] == 2) | self.seconds[grams[np.minimum(at + 3, len(grams) - 1)]]]
            rows = np.searchsorted(ends, at, side="right") - 1
            for place, row, stop in zip(at.tolist(), rows.tolist(), ends[rows + 1].tolist()):
                for size, words in self.sizes:
                    if place + size > stop:
                        break
                    if (numbers := words.get(data[place:place + size])):
                        found[row].update(numbers)
        return [sorted(f) for f in found]


class WordIndex:
    """Inverted index from words to numbers, as plan-time data: ``proposed`` gives the numbers of all words a text holds.

    A batch's texts are one array of bytes: tables say at which places the first bytes of a word stand, and only there
    slices are looked up among the words. Neither step's cost depends on the number of words but for their different lengths.
    """

    def __init__(self, numbers: Mapping[str, Iterable[int]]):
        self._own = {w: sorted(set(ns)) for w, ns in numbers.items() if w}
        self.words = sorted(self._own)

    def proposed(self, low: Column) -> Column:
        """Sorted distinct numbers of the words in a lower-cased text; empty for null."""
        none = F.array().cast("array<int>")
        if not self.words:
            return none
        own = self._own

        @F.arrow_udf("array<int>")
        def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            finder = _Finder(own)
            for batch in batches:
                yield pa.array(finder.find(batch), pa.list_(pa.int32()))

        return F.coalesce(numbers(low), none)
