"""Lines of HLS playlists, read by columns over whole Arrow batches: no loop over lines or rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: the characters that ``urls.trimmed`` strips and those that end a line (``html.LINE_BREAKS``)
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
BREAKS = "[\\n\\r\\x0B\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]+"
ODD_BREAKS = BREAKS.replace("\\n", "")
RANGE = r"^(?P<size>\d+)\s*(?:@\s*(?P<at>\d+)\s*)?$"
#: so many bytes of text are taken apart at once
BYTES = 16 << 20
LARGEST = (1 << 63) - 1

SEGMENT = T.StructType([T.StructField(name, kind) for name, kind in (
    ("line", T.StringType()), ("duration", T.StringType()), ("base", T.StringType()), ("passed", T.LongType()), ("range_offset", T.LongType()),
    ("range_length", T.LongType()))])
KIND = T.StructType([T.StructField(name, kind) for name, kind in (
    ("lines", T.LongType()), ("live", T.BooleanType()), ("is_master", T.BooleanType()), ("keys", T.ArrayType(T.StringType())), ("map", T.StringType()),
    ("segments", T.ArrayType(SEGMENT)))])


def _trimmed(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(texts, characters=BLANKS)


def _lines(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and stripped, non-empty lines."""
    odd = pc.any(pc.match_substring_regex(texts, ODD_BREAKS)).as_py()
    lists = pc.split_pattern_regex(texts, BREAKS) if odd else pc.split_pattern(texts, "\n")
    lines = _trimmed(lists.flatten())
    full = pc.greater(pc.binary_length(lines), 0)
    return pc.list_parent_indices(lists).filter(full).to_numpy(), lines.filter(full)


def _tags(lines: pa.Array) -> pa.Array:
    """Upper-case names in front of the first colon; few differ, so each one is changed once."""
    coded = pc.list_element(pc.split_pattern(lines, ":", max_splits=1), 0).dictionary_encode()
    return pa.array([t.upper() for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def _bodies(lines: pa.Array) -> pa.Array:
    """What stands behind the first colon, the whole line without one."""
    return _trimmed(pc.replace_substring_regex(lines, "^[^:]*:", "", max_replacements=1))


def _longs(digits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of runs of digits, and which of them are there and fit into 64 bits."""
    texts = digits.to_pylist() if pc.any(pc.greater(pc.utf8_length(digits), 18)).as_py() else None
    if texts is not None:
        digits = pa.array([t if t and int(t) <= LARGEST else None for t in texts], pa.string())
    there = pc.greater(pc.fill_null(pc.utf8_length(digits), 0), 0).to_numpy(zero_copy_only=False)
    return pc.if_else(pa.array(there), digits, "0").cast(pa.int64()).to_numpy(), there


def _ranges(rows: np.ndarray, bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offset and length of each byte range, and whether it can be read; one without offset continues the one before it in its row.

    A range that ends beyond 64 bits can't be read, nor can those that continue it.
    """
    parts = pc.extract_regex(bodies, RANGE)
    size, readable = _longs(pc.struct_field(parts, "size"))
    at, placed = _longs(pc.struct_field(parts, "at"))
    size = np.where(readable, size, 0)
    anew = ~readable | placed
    anew[:1] = True
    anew[1:] |= rows[1:] != rows[:-1]
    start = np.where(readable & placed, at, 0)
    head = np.maximum.accumulate(np.where(anew, np.arange(len(rows)), 0))
    before = np.cumsum(size) - size  # wraps in long batches, which differences undo
    begin = start[head] + (before - before[head])
    near = np.cumsum(size.astype(float)) - size
    beyond = (begin < 0) | (start[head].astype(float) + (near - near[head]) + size >= 2.0 ** 63)
    return begin, size, readable & ~beyond


def _lists(rows: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _read(texts: pa.Array) -> pa.Array:
    n = len(texts)
    rows, lines = _lines(texts)
    marked = pc.starts_with(lines, "#").to_numpy(zero_copy_only=False)
    places = np.flatnonzero(marked)
    tags = _tags(lines.take(pa.array(places)))

    def at(test) -> np.ndarray:
        return places[test.to_numpy(zero_copy_only=False)]

    def rows_with(found: np.ndarray) -> np.ndarray:
        return np.bincount(rows[found], minlength=n) > 0

    named = {name: at(pc.equal(tags, f"#EXT{name}")) for name in ("INF", "-X-BYTERANGE", "-X-MEDIA-SEQUENCE", "-X-KEY", "-X-MAP")}
    body = {name: _bodies(lines.take(pa.array(named[name]))) for name in ("INF", "-X-BYTERANGE", "-X-MEDIA-SEQUENCE")}
    segments = np.flatnonzero(~marked)
    row = rows[segments]
    # lines of a row before its first segment, or behind the segment before
    first = np.searchsorted(rows, row)
    since = first.copy()
    since[1:] = np.maximum(first[1:], segments[:-1])

    def latest(name: str, begin: np.ndarray) -> pa.Array:
        """Numbers of the latest line of that name at or behind ``begin``, null without."""
        number = np.searchsorted(named[name], segments) - 1
        held = number >= np.searchsorted(named[name], begin)
        return pa.array(number, mask=~held)

    seconds = _trimmed(pc.list_element(pc.split_pattern(body["INF"], ",", max_splits=1), 0))
    offset, length, readable = _ranges(rows[named["-X-BYTERANGE"]], body["-X-BYTERANGE"])
    ranged = latest("-X-BYTERANGE", since)
    items = pa.StructArray.from_arrays(
        [lines.take(pa.array(segments)), seconds.take(latest("INF", since)), body["-X-MEDIA-SEQUENCE"].take(latest("-X-MEDIA-SEQUENCE", first)),
         pa.array(np.arange(len(segments)) - np.searchsorted(row, row), pa.int64()),
         pa.array(offset, pa.int64(), mask=~readable).take(ranged), pa.array(length, pa.int64(), mask=~readable).take(ranged)],
        ["line", "duration", "base", "passed", "range_offset", "range_length"])
    keys, maps = named["-X-KEY"], named["-X-MAP"]
    last = np.searchsorted(rows[maps], np.arange(n), side="right") - 1
    own = (last >= 0) & (rows[maps][last] == np.arange(n)) if len(maps) else np.zeros(n, bool)
    starts = lambda name: rows_with(at(pc.starts_with(tags, name)))
    return pa.StructArray.from_arrays(
        [pa.array(np.bincount(rows, minlength=n), pa.int64()), pa.array(~starts("#EXT-X-ENDLIST")), pa.array(starts("#EXT-X-STREAM-INF")),
         _lists(rows[keys], lines.take(pa.array(keys)), n), lines.take(pa.array(maps)).take(pa.array(last, mask=~own)), _lists(row, items, n)],
        ["lines", "live", "is_master", "keys", "map", "segments"])


def _pieces(texts: pa.Array):
    """Runs of rows with about BYTES of text, at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES, side="right")))
        yield texts.slice(at, stop - at)
        at = stop


@F.arrow_udf(KIND)
def _read_playlists(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.string())
    done = [_read(piece) for piece in _pieces(texts)] or [_read(texts)]
    return pa.concat_arrays(done)


def read_playlist(text: Column) -> Column:
    """What a playlist's lines say: how many there are, its end mark, kind, key lines, last map line and its segments as written.

    Per segment: its line, the texts of its duration and of the sequence number last set (null: none), the segments before it, its byte range.
    Evaluated once and never copied into a filter.
    """
    return _read_playlists.asNondeterministic()(F.make_valid_utf8(text))
