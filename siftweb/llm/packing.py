"""Best-fit decreasing over all pieces: a segment tree finds the tightest open bin, equal pieces are placed together."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftweb.llm.common import keep, text_of
from siftweb.llm.word_cache import encoder

CAPACITY = 1024
#: bytes of shards' numbers that are broadcast at most; ranks of one length that stay together in the shuffle beyond that
BROADCAST_BYTES, RANKS = 128 << 20, 4096


class OpenBins:
    """Runs of equal open bins by remaining capacity, over a segment tree that counts them.

    A run is (first sequence number, number of bins). ``tightest`` walks the tree: logarithmic time.
    """

    def __init__(self, capacity: int):
        self._size = 1 << capacity.bit_length()
        self._counts = [0] * (2 * self._size)
        self._runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, first: int, n: int) -> None:
        if n and remaining:
            self._runs[remaining].append((first, n))
            self._change(remaining, n)

    def take(self, remaining: int, most: int) -> tuple[int, int]:
        """Up to ``most`` bins of one run with this remaining capacity."""
        first, n = self._runs[remaining].pop()
        taken = min(n, most)
        if taken < n:
            self._runs[remaining].append((first + taken, n - taken))
        self._change(remaining, -taken)
        return first, taken

    def _change(self, remaining: int, n: int) -> None:
        at = self._size + remaining
        while at:
            self._counts[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that holds ``length``."""
        at = self._size + length
        if self._counts[at]:
            return length
        while at > 1:
            if not at & 1 and self._counts[at + 1]:  # a right sibling holds greater capacities
                at += 1
                while at < self._size:
                    at = 2 * at if self._counts[2 * at] else 2 * at + 1
                return at - self._size
            at >>= 1
        return None


@dataclass(frozen=True)
class Plan:
    """For every length, in which bins and where its pieces go: pieces ``start[i]`` to ``start[i + 1] - 1`` of that length fill
    bins from ``sequence[i]`` on, ``each[i]`` to a bin, the first of them at ``offset[i]``."""

    start: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for one in np.unique(length).tolist():
            rows = length == one
            n = number[rows]
            i = np.searchsorted(self.start[one], n, side="right") - 1
            inside = n - self.start[one][i]
            sequence[rows] = self.sequence[one][i] + inside // self.each[one][i]
            offset[rows] = self.offset[one][i] + inside % self.each[one][i] * one
        return sequence, offset


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing for ``counts[length]`` pieces of every length.

    Pieces of one length are interchangeable, so what best-fit decreasing does with them one after the other is done
    for runs of equal bins at once: the tightest bin that holds the length keeps being the tightest until it no longer
    does, hence takes as many pieces as fit; a new bin is opened when none fits. Work and memory depend on the
    lengths, not on the number of pieces.
    """
    bins, used = OpenBins(capacity), 0
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    for length in sorted(counts, reverse=True):
        done, total, steps = 0, counts[length], plan.setdefault(length, [])
        while done < total:
            room = bins.tightest(length)
            free = capacity if room is None else room
            each = min(free // length, total - done)
            wanted = (total - done) // each
            if room is None:
                first, taken = used, wanted
                used += wanted
            else:
                first, taken = bins.take(room, wanted)
            steps.append((done, first, each, capacity - free))
            bins.add(free - each * length, first, taken)
            done += each * taken
    columns = {k: [np.array([s[i] for s in v], np.int64) for i in range(4)] for k, v in plan.items()}
    return Plan(*({k: c[i] for k, c in columns.items()} for i in range(4)), used)


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, rank long"


def _cut(path: str, end_id: int, keep_blank: bool, capacity: int, with_ids: bool):
    def run(batches):
        from pyspark import TaskContext

        encode, shard = encoder(path, keep_blank).encode_all, TaskContext.get().partitionId()
        end, ranks = np.array([end_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            ids: list[bytes] = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encode(batch.column("_text").to_pylist())):
                own += end
                n = len(own) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = own[4 * a:4 * b]
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(part), shard, int(ranks[b - a])))
                    ranks[b - a] += 1
                    if with_ids:
                        ids.append(part)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)]
            names = [c.split()[0] for c in _PIECES.split(", ")]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, keep_blank: bool = True, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """The encoded documents, each with ``end_id`` behind it, cut into pieces of at most ``capacity`` tokens; a written table.

    Only documents longer than ``capacity`` are cut; their first piece takes what is over, the others are full.
    ``rank`` numbers the pieces of one length within one task's output (``shard``). ``ids`` are little-endian unsigned 32-bit integers
    in one binary value, which Spark moves as a block; ``pack`` turns them into arrays.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    schema = _PIECES + (", ids binary" if with_ids else "")
    return keep(rows.mapInArrow(_cut(tokenizer, end_id, keep_blank, capacity, with_ids), schema), "pieces")


def _numbered(cut: DataFrame, capacity: int, most: int) -> DataFrame:
    """Add ``_number``, a piece's number among all of its length: the pieces of that length in earlier shards, and its rank in its own."""
    counts = cut.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = keep(counts.select("shard", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    if bases.select("shard").distinct().count() * capacity * 16 <= most:
        maps = bases.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("_bases"))  # at most ``capacity`` entries each
        return cut.join(F.broadcast(maps), "shard").withColumn("_number", F.element_at("_bases", F.col("length")) + F.col("rank")).drop("_bases")
    # the pieces move, dealt by blocks of ranks, so that a frequent length is no single key
    blocks = bases.select("shard", "length", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANKS))).alias("_block"))
    marked = cut.withColumn("_block", F.floor(F.col("rank") / RANKS))
    return marked.join(blocks, ["shard", "length", "_block"]).withColumn("_number", F.col("base") + F.col("rank")).drop("_block", "base")


def _as_lists(ids: pa.Array) -> pa.Array:
    """Binary values of 32-bit integers as lists of them, over the same memory."""
    if not len(ids):
        return pa.array([], pa.list_(pa.int32()))
    ids = ids.cast(pa.binary())
    ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset:ids.offset + len(ids) + 1]
    values = np.frombuffer(ids.buffers()[2] or b"", np.int32, (ends[-1] - ends[0]) // 4, ends[0])
    return pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 4, pa.int32()), pa.array(values))


def pack(cut: DataFrame, capacity: int = CAPACITY, most: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces, in as few sequences as best-fit decreasing needs.

    The driver sees one count per length (at most ``capacity`` numbers) and plans with them. Pieces of a length are numbered
    over all shards, and the plan turns length and number into a place. The pieces stay where they were written: a shard's numbers, at most ``capacity``
    of them, come to it by a broadcast of up to ``most`` bytes; with more shards than that holds, pieces and numbers meet in a shuffle.
    Every sequence is filled without gaps from 0.
    """
    plan = best_fit({r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    names = [c for c in cut.columns if c not in ("shard", "rank")]

    def run(batches):
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            number = columns.pop("_number")
            sequence, offset = plan.place(columns["length"].to_numpy(), number.to_numpy())
            if "ids" in columns:
                columns["ids"] = _as_lists(columns["ids"])
            yield pa.RecordBatch.from_pydict({**columns, "sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    kinds = [f"{c} {'array<int>' if c == 'ids' else kind}" for c, kind in cut.select(*names).dtypes]
    placed = _numbered(cut, capacity, most).select(*names, F.col("_number").cast("long").alias("_number"))
    return placed.mapInArrow(run, ", ".join([*kinds, "sequence_id long", "offset long"]))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id and the ids of its pieces in order (at most ``capacity`` of them)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, keep_blank: bool = True, capacity: int = CAPACITY,
                   with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their places: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    A null or empty text is the end token alone; repeated rows and null identifiers are packed like others; an empty
    table gives no pieces. Other columns are ignored, whatever their names. ``with_ids=False`` leaves the ids out once their checksum is taken.
    """
    return pack(pieces(docs, tokenizer, end_id, keep_blank, capacity, with_ids), capacity)


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from siftweb.llm.common import read

    return pack_documents(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
