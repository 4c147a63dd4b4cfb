"""Whole-text encoding with a public tokenizer, remembering the ids of recurring pieces."""

from __future__ import annotations

import os
import re
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: pieces remembered per generation and Python worker (two generations at most), and the longest piece that is remembered
REMEMBERED = 500_000
LONGEST = 48
#: characters of text whose pieces are looked up together
TOGETHER = 2_000_000


_OTHER_SPACE = re.compile(r"[^\S \n]")
#: a word of western letters, with or without a mark behind it: two matches of either tokenizer's splitting pattern
_PLAIN = re.compile(r"(\n?)([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,]?)")
#: a mark that ends a word of such letters: it is cut off too, so that a word is remembered once with and without it
_MARK = re.compile(r"[.,](?=[ \n]|\Z)(?<=[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF][.,])")
_BEHIND = "\0"


def _byte_letters() -> dict[int, int]:
    """Byte-level alphabet: visible Latin-1 bytes stand for themselves, the others for the characters from 256 on, in order."""
    hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
    return {b: 256 + i for i, b in enumerate(hidden)}


_BYTES = _byte_letters()
_BLANK = " ".translate(_BYTES)
id_of = attrgetter("id")


class Encoder:
    """Encodes texts exactly as one call of the library for each would, piece by piece.

    A text may be cut where no match of the tokenizer's splitting pattern can span the place; no id changes then.
    ``keep_blank`` (byte-level BPE): matches hold a blank only as their first character, so a single blank between
    words starts a piece, and a single line end between words is a match of its own. Otherwise the tokenizer
    drops white space, and every blank or line end separates; where it also ignores case, ASCII texts are lower-cased first. New pieces are encoded in one call, with a mark between
    them whose id occurs nowhere else; plain words go straight to the library's merge model. Strings that look like special tokens are ordinary text.
    """

    def __init__(self, path: str, keep_blank: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._keep_blank = keep_blank
        self._mark = "\n" if keep_blank else " \0 "
        mark = self._ids(self._mark)
        self._merge = self._tokenizer.model.tokenize
        self._lower = str.lower if self._ids("A").tobytes() == self._ids("a").tobytes() else str
        self._mark_id = int(mark[0]) if len(mark) == 1 else None
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _ready(self, text: str) -> str | None:
        """The text with one blank between its pieces, or None where white space needs the library's own eye.

        With ``keep_blank`` the first piece of every line starts with a line end, marks behind a word with ``_BEHIND``, the others lack their blank.
        """
        if not self._keep_blank:
            return _MARK.sub(r" \g<0>", (self._lower(text) if text.isascii() else text).replace("\n", " "))
        odd = ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or not text or text[0] in " \n" or text[-1] in " \n"
               or _BEHIND in text or _OTHER_SPACE.search(text))
        return None if odd else "\n" + _MARK.sub(r" \0\g<0>", text).replace("\n", " \n")

    def _spelled(self, piece: str) -> str:
        """A piece as it stands behind a mark."""
        return piece if not self._keep_blank or piece[:1] == "\n" else " " + piece

    def _plain(self, word: str) -> list[int]:
        """Ids of one match of the splitting pattern that isn't plain ASCII letters."""
        return [t.id for t in self._merge(word.encode().decode("latin-1").translate(_BYTES))]

    def _encode_plain(self, pieces: list[str]) -> tuple[dict[str, bytes], list[str]]:
        """Ids of the plain words among the pieces, and the other pieces."""
        others, plain, ids, ends = [], [], [], [0]
        keep_blank, merge, match = self._keep_blank, self._merge, _PLAIN.fullmatch
        feed_ids = self._ids("\n").tolist() if keep_blank else []
        marks = {m: self._plain(m) for m in ".,"}
        lead, lower = _BLANK if keep_blank else "", self._lower
        for piece in pieces:
            if piece.isascii() and piece.isalpha():
                ids += map(id_of, merge(lead + lower(piece)))
                plain.append(piece)
                ends.append(len(ids))
                continue
            found = match(piece)
            if not found:
                others.append(piece)
                continue
            feed, word, mark = found.groups()
            word = lower(word)
            if feed:
                ids += feed_ids
            if word.isascii():
                ids += map(id_of, merge(word if feed else lead + word))
            else:
                ids += self._plain(" " + word if keep_blank and not feed else word)
            if mark:
                ids += marks[mark]
            plain.append(piece)
            ends.append(len(ids))
        raw = np.array(ids, "<u4").tobytes()
        return {p: raw[4 * a:4 * b] for p, a, b in zip(plain, ends, ends[1:])}, others

    def _encode_new(self, pieces: list[str]) -> dict[str, bytes]:
        behind = [p for p in pieces if p[:1] == _BEHIND] if self._keep_blank else []  # a handful at most
        found, pieces = self._encode_plain([p for p in pieces if p[:1] != _BEHIND] if behind else pieces)
        found |= {p: self._ids(p[1:]).tobytes() for p in behind}
        apart = [p for p in pieces if self._mark_id is None or len(p) > LONGEST or "\0" in p]
        found |= {p: self._alone(p) for p in apart}
        together = [p for p in pieces if p not in found] if apart else pieces
        if not together:
            return found
        if self._keep_blank:
            ids = self._ids("".join([p if p[:1] == "\n" else "\n " + p for p in together]))
            marks = np.flatnonzero(ids == self._mark_id)
            starts = marks + np.array([p[:1] != "\n" for p in together]) if len(marks) == len(together) else None
            ends = np.append(marks[1:], len(ids))
        else:
            ids = self._ids(self._mark.join(["", *together]))
            marks = np.flatnonzero(ids == self._mark_id)
            starts, ends = (marks + 1, np.append(marks[1:], len(ids))) if len(marks) == len(together) else (None, None)
        if starts is None:
            return found | {p: self._alone(p) for p in together}
        raw = ids.tobytes()
        for piece, start, end in zip(together, (starts * 4).tolist(), (ends * 4).tolist()):
            found[piece] = raw[start:end]
        return found

    def _alone(self, piece: str) -> bytes:
        return self._ids(self._spelled(piece)).tobytes()

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; those that aren't too long stay in the young generation."""
        if len(self._young) > REMEMBERED:
            self._old, self._young = self._young, {}
        found = list(map(self._young.get, pieces))
        new = [p for p, ids in zip(pieces, found) if ids is None]
        if not new:
            return found
        fresh = {p: ids for p in new if (ids := self._old.get(p)) is not None} if self._old else {}
        fresh |= self._encode_new([p for p in new if p not in fresh] if fresh else new)
        following = map(fresh.__getitem__, new)
        found = [next(following) if ids is None else ids for ids in found]
        for piece in [p for p in new if len(p) > LONGEST]:
            del fresh[piece]
        self._young.update(fresh)
        return found

    def _encode_together(self, texts: list[str]) -> list[bytes]:
        """Split in one go, each distinct piece looked up once, the ids laid out in text order by one gather."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        laid = pa.array(self._look_up(distinct), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1)[pieces.offsets.to_numpy()]
        skip = 4 if self._keep_blank else 0  # the line end put before the text
        raw = laid.buffers()[2].to_pybytes() if ends[-1] else b""
        bounds = ends.tolist()
        return [raw[a + skip:b] for a, b in zip(bounds, bounds[1:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            ready = [self._ready(t) for t in texts[at:end]]
            found = iter(self._encode_together([r for r in ready if r is not None]))
            out += [self._ids(t).tobytes() if r is None else next(found) for t, r in zip(texts[at:end], ready)]
            at = end
        return out


_encoders: dict = {}


def encoder(path: str, keep_blank: bool) -> Encoder:
    """One encoder per Python worker and file; workers are reused, and so are the remembered pieces."""
    if (path, keep_blank) not in _encoders:
        _encoders[path, keep_blank] = Encoder(path, keep_blank)
    return _encoders[path, keep_blank]
