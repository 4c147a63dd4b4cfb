"""Token counts by finite-state machines compiled from a tokenizer's file: no text is encoded and no id is made.

Two deterministic transducers take the place of a byte-level BPE tokenizer.

* ``Splitter`` follows the splitting pattern over classes of characters; its transitions say where pieces start. A run of
  characters is a map from states to states. Texts are laid end to end and cut into chunks of equal width; the maps of all
  chunks are formed at once, a parallel prefix scan composes them, and that gives every chunk its true first state.
* ``Merger`` follows the bytes of a piece; a transition bears the change of the number of tokens. It is determinised while it
  is used: a state holds every place at which a token may still have to start, with the token that ends there.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.llm.common import text_of

#: characters of a chunk, characters of texts handled together, bytes of pieces followed together
WIDTH, TOGETHER, SLICE = 128, 1 << 20, 1 << 18
#: states of the merger kept between slices; beyond them it starts anew
STATES = 150_000
#: pieces that are followed side by side at least; fewer are followed one by one
FEWEST = 32

#: closes every text in the row of characters; no Arrow string holds a surrogate
_CLOSE = "\ud800"
_LETTER, _NUMBER, _OTHER, _BLANK, _SPACE, _QUOTE, _STMD, _E, _RV, _L, _END = range(11)
_CLASSES = 11
_LETTERS = (_LETTER, _STMD, _E, _RV, _L)
_FRESH, _IN_LETTERS, _IN_NUMBER, _IN_OTHER, _BLANK1, _SPACE1, _BLANK2, _SPACE2, _AT_QUOTE, _QUOTE_RV, _QUOTE_L = range(11)
_STATES = 11


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output per (state, class); output 1: a piece starts here, 2: one started a character ago.

    The pattern is that of byte-level tokenizers: contractions behind a quotation mark that starts a piece; letters, numbers or other
    marks, each with one blank before it at most; white space, whose last character is left to what follows.
    """
    first = {_NUMBER: _IN_NUMBER, _OTHER: _IN_OTHER, _QUOTE: _AT_QUOTE, _BLANK: _BLANK1, _SPACE: _SPACE1, _END: _FRESH} | dict.fromkeys(_LETTERS, _IN_LETTERS)
    behind_blank = first | {_QUOTE: _IN_OTHER}
    table, out = np.zeros((_STATES, _CLASSES), np.uint8), np.zeros((_STATES, _CLASSES), np.uint8)
    for c in range(_CLASSES):
        space, white = {_BLANK: (0, _BLANK2), _SPACE: (0, _SPACE2)}, c in (_BLANK, _SPACE)
        new = (1, first[c])
        same = {
            _FRESH: new,
            _IN_LETTERS: (0, _IN_LETTERS) if c in _LETTERS else new,
            _IN_NUMBER: (0, _IN_NUMBER) if c == _NUMBER else new,
            _IN_OTHER: (0, _IN_OTHER) if c in (_OTHER, _QUOTE) else new,
            _BLANK1: space[c] if white else new if c == _END else (0, behind_blank[c]),
            _SPACE1: space[c] if white else new,
            _BLANK2: space[c] if white else new if c == _END else (2, behind_blank[c]),
            _SPACE2: space[c] if white else new if c == _END else (3, first[c]),
            _AT_QUOTE: {_OTHER: (0, _IN_OTHER), _QUOTE: (0, _IN_OTHER), _STMD: (0, _FRESH), _RV: (0, _QUOTE_RV), _L: (0, _QUOTE_L)}.get(c, new),
        }
        late = (2, _IN_LETTERS) if c in _LETTERS else (3, first[c])  # the quotation mark was no contraction: its letter starts a piece
        same[_QUOTE_RV] = (0, _FRESH) if c == _E else late
        same[_QUOTE_L] = (0, _FRESH) if c == _L else late
        for state, (says, to) in same.items():
            table[state, c], out[state, c] = to, says
    return table.ravel(), out.ravel()


def compose(maps: np.ndarray) -> np.ndarray:
    """Prefix scan of state maps: row i becomes the map of the rows 0 to i one after the other, in logarithmically many steps."""
    step = 1
    while step < len(maps):
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)])
        step *= 2
    return maps


class Splitter:
    """Starts of the tokenizer's pieces in a row of characters; classes are learnt from the library, character by character."""

    def __init__(self, split):
        self._split = split  # text -> number of pieces
        self._next, self._out = _transitions()
        self._class = np.full(0x110000, 255, np.uint8)
        for text, c in ((" ", _BLANK), ("'", _QUOTE), ("stmd", _STMD), ("e", _E), ("rv", _RV), ("l", _L), (_CLOSE, _END)):
            for one in text:
                self._class[ord(one)] = c

    def _learn(self, points: np.ndarray) -> None:
        for point in points.tolist():
            c = chr(point)
            # letters join letters and numbers join numbers; two of a space's kind are split by what follows, other marks are not
            kind = (_LETTER if self._split("a" + c) == 1 else _NUMBER if self._split("1" + c) == 1
                    else _SPACE if self._split(c + c + "a") == 3 else _OTHER)
            self._class[point] = kind

    def classes(self, points: np.ndarray) -> np.ndarray:
        found = self._class[points]
        if (found == 255).any():
            self._learn(np.unique(points[found == 255]))
            found = self._class[points]
        return found

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Positions at which a piece starts; every end of a text is a piece of its own."""
        n = -(-len(classes) // WIDTH)
        padded = np.full(n * WIDTH, _END, np.intp)
        padded[:len(classes)] = classes
        columns = np.ascontiguousarray(padded.reshape(n, WIDTH).T)
        maps = np.tile(np.arange(_STATES, dtype=np.intp), (n, 1))
        wide = self._next.astype(np.intp)
        for column in columns:
            maps = wide.take(maps * _CLASSES + column[:, None])
        state = np.concatenate([[_FRESH], compose(maps)[:-1, _FRESH]])
        says = np.empty((WIDTH, n), np.uint8)
        for j, column in enumerate(columns):
            key = state * _CLASSES + column
            says[j] = self._out.take(key)
            state = wide.take(key)
        said = says.T.ravel()[:len(classes)]
        begins = (said & 1).astype(bool)
        begins[:-1] |= (said[1:] & 2).astype(bool)
        return np.flatnonzero(begins)


class Merger:
    """Number of tokens of a piece, byte by byte.

    The merges leave a row of tokens exactly if they leave each two neighbours alone, so the tokens of a prefix are those
    of a shorter prefix and one more: the only one that ends here and stands next to the other's last token. A state is the
    set of places where a token may yet start: (place in the tree of tokens, last token before it, tokens there less tokens here).
    Whether two tokens stay apart is asked of the library once. Transitions lie in an open-addressed table of three arrays,
    in which many pieces look up their next states together.
    """

    def __init__(self, tokens: dict[int, bytes], merged):
        self._merged, self._tokens = merged, tokens  # bytes -> ids
        self._child: dict[int, int] = {}
        self._ends = [-1]
        inner = {0}
        for token, spelled in tokens.items():
            if merged(spelled) != [token]:
                continue  # no text yields it
            at = 0
            for b in spelled:
                inner.add(at)
                key = at << 8 | b
                if key not in self._child:
                    self._child[key] = len(self._ends)
                    self._ends.append(-1)
                at = self._child[key]
            self._ends[at] = token
        self._inner = inner
        self.forget()

    def forget(self) -> None:
        self._apart: dict[int, bool] = {}
        self._configs: list[tuple] = [((0, -1, 0),)]
        self._numbers: dict[tuple, int] = {self._configs[0]: 0}
        self._moves: dict[int, tuple[int, int]] = {}
        self._room(1 << 12)

    def _room(self, slots: int) -> None:
        self._mask, self._shift = slots - 1, np.uint64(64 - (slots.bit_length() - 1))
        self._keys, self._to, self._more = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int16)
        if self._moves:
            self._store(list(self._moves))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _store(self, keys: list[int]) -> None:
        for key, at in zip(keys, self._slot(np.array(keys, np.int64)).tolist()):
            while self._keys[at] >= 0:
                at = (at + 1) & self._mask
            self._keys[at] = key
            self._to[at], self._more[at] = self._moves[key]

    def _stay(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        key = left << 32 | right
        found = self._apart.get(key)
        if found is None:
            found = self._apart[key] = self._merged(self._tokens[left] + self._tokens[right]) == [left, right]
        return found

    def _move(self, key: int) -> tuple[int, int]:
        """Compile one transition: state << 8 | byte -> (state, change of the number of tokens)."""
        found = self._moves.get(key)
        if found is not None:
            return found
        byte, gone, token, more = key & 255, [], None, 0
        for place, last, less in self._configs[key >> 8]:
            child = self._child.get(place << 8 | byte)
            if child is None:
                continue
            if child in self._inner:
                gone.append((child, last, less))
            if token is None and self._ends[child] >= 0 and self._stay(last, self._ends[child]):
                token, more = self._ends[child], less + 1
        config = (*[(child, last, less - more) for child, last, less in gone], (0, token, 0))
        self._moves[key] = self._number(config), more
        return self._moves[key]

    def _number(self, config: tuple) -> int:
        number = self._numbers.get(config)
        if number is None:
            number = self._numbers[config] = len(self._configs)
            self._configs.append(config)
        return number

    def _compile(self, keys: np.ndarray) -> None:
        new = np.unique(keys).tolist()  # some of them may have been compiled for a single piece
        for key in new:
            self._move(key)
        if 2 * len(self._moves) > self._mask:
            self._room(1 << (4 * len(self._moves)).bit_length())
        else:
            self._store(new)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the transitions, and the indexes of those that are not there."""
        slot = self._slot(keys)
        there = self._keys.take(slot)
        missing = []
        left = np.flatnonzero(there != keys)
        while len(left):
            empty = there[left] < 0
            missing.append(left[empty])
            left = left[~empty]
            slot[left] = (slot[left] + 1) & self._mask
            there[left] = self._keys.take(slot[left])
            left = left[there[left] != keys[left]]
        return slot, np.concatenate(missing) if missing else left

    def _together(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        longer = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) + 1), side="right")  # than j bytes
        j = 0
        while j < lengths[0] and longer[j] >= FEWEST:
            n = longer[j]
            keys = state[:n] << 8 | data.take(starts[:n] + j)
            slot, missing = self._find(keys)
            if len(missing):
                self._compile(keys[missing])
                slot, _ = self._find(keys)
            total[:n] += self._more.take(slot)
            state[:n] = self._to.take(slot)
            j += 1
        for i in range(int(longer[j]) if j < lengths[0] else 0):
            total[i] += self._alone(data[starts[i] + j:starts[i] + lengths[i]].tobytes(), int(state[i]))
        counts = np.empty_like(total)
        counts[order] = total
        return counts

    def _alone(self, rest: bytes, state: int) -> int:
        total, moves = 0, self._moves
        for byte in rest:
            key = state << 8 | byte
            found = moves.get(key)
            if found is None:
                if len(self._configs) > 2 * STATES:  # a very long piece: go on from the same configuration in a new machine
                    config = self._configs[state]
                    self.forget()
                    moves, state = self._moves, self._number(config)
                    key = state << 8 | byte
                found = self._move(key)
            state = found[0]
            total += found[1]
        return total

    def counts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of every piece, given by its first byte and its number of bytes."""
        out, at = np.empty(len(starts), np.int64), 0
        bounds = np.searchsorted(np.cumsum(lengths), np.arange(SLICE, int(lengths.sum()) + SLICE, SLICE), side="right")
        for end in np.unique(np.append(bounds, len(starts))).tolist():
            if end > at:
                if len(self._configs) > STATES:
                    self.forget()
                out[at:end] = self._together(data, starts[at:end], lengths[at:end])
                at = end
        return out


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order."""
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    return {b: chr(b) for b in range(256)} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Counter:
    """Token counts as ``tokenizers`` gives them with add_special_tokens=False; special strings inside a text are one token each."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        model, before = parts["model"], parts.get("pre_tokenizer") or {}
        if (model["type"], before.get("type"), before.get("use_regex"), before.get("add_prefix_space"), parts.get("normalizer")) != ("BPE", "ByteLevel", True, False, None) or (
                model.get("ignore_merges") or model.get("dropout")):
            raise ValueError(f"{path}: a byte-level BPE tokenizer without normalizer and prefix is needed")
        added = parts.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: special tokens that take white space are not supported")
        special = sorted((t["content"] for t in added), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        letters = byte_letters()
        spell, raw = letters.__getitem__, {v: k for k, v in letters.items()}
        skip = {t["id"] for t in added}
        tokens = {i: bytes(map(raw.__getitem__, s)) for s, i in model["vocab"].items() if i not in skip}
        self.splitter = Splitter(lambda text: len(tokenizer.pre_tokenizer.pre_tokenize_str(text)))
        self.merger = Merger(tokens, lambda piece: [t.id for t in tokenizer.model.tokenize("".join(map(spell, piece)))])

    def _group(self, texts: list[str]) -> np.ndarray:
        joined = _CLOSE.join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        classes = self.splitter.classes(points)
        starts = self.splitter.starts(classes)
        closes = np.flatnonzero(classes == _END)
        if len(data) == len(points) + 2 * len(closes):
            width = 1 + 2 * (classes == _END)
        else:
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        at = np.concatenate([[0], np.cumsum(width)])
        ends = np.append(starts[1:], len(points))
        true = classes[starts] != _END
        starts, ends = starts[true], ends[true]
        if not len(starts):
            return np.zeros(len(texts), np.int64)
        found = self.merger.counts(data, at[starts], at[ends] - at[starts])
        return np.bincount(np.searchsorted(closes, starts), found, len(texts)).astype(np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            cut = self._special.split(text) if self._special else [text]
            extra[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        found, at = [np.zeros(0, np.int64)], 0
        while at < len(parts):
            end, size = at, 0
            while end < len(parts) and (end == at or size + len(parts[end]) <= TOGETHER):
                size += len(parts[end])
                end += 1
            found.append(self._group(parts[at:end]))
            at = end
        return extra + np.bincount(np.array(owner, np.int64), np.concatenate(found), len(texts)).astype(np.int64)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One compiled counter per Python worker and file; workers are reused, and so are the compiled states."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row's whole text.

    A null or empty text has no tokens; repeated rows and rows without doc_id are counted each; an empty table gives an empty
    result; other columns are ignored. A text's time grows with its length, also where it has no blank; texts of any length are
    handled in chunks and slices of fixed size.
    """

    def run(batches):
        count = counter(tokenizer).count
        for batch in batches:
            found = count(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), text_of().alias("_text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from siftweb.llm.common import read

    return token_counts(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
