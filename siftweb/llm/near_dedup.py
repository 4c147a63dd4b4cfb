"""Near duplicates on word shingles: SuperMinHash, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftweb.llm.common import free_names, keep, text_of
from siftweb.scale import lookup_by_key

#: words of a shingle and the least similarity of a link, in hundredths
WORDS, LINK = 5, 75
#: bands and ranks per band: a pair of similarity 0.75 shares no band with a probability of (1 - 0.75 ** 4) ** 32 = 5e-6
BANDS, ROWS = 32, 4
RANKS = BANDS * ROWS

#: members of a hub that meet in one block; sets of a component beyond which its answer is broadcast
BLOCK, HOT_SETS = 128, 10_000

_U = np.uint64
_GOLD, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: a rank is the level in the high bits and a random fraction in the low ones
_FRACTION = 25


def _mixed(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> _U(30))) * _MIX1
        z = (z ^ (z >> _U(27))) * _MIX2
        return z ^ (z >> _U(31))


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles of the whole text; of fewer words, of their sequence.

    Words are what lies between blanks, tabs and line ends; A-Z count as a-z.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    with np.errstate(over="ignore"):
        total = h[:n] * _PLACES[0]
        for i in range(1, WORDS):
            total = total + h[i:i + n] * _PLACES[i]
    return np.unique(_mixed(total))


def super_minhash(elements: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """SuperMinHash: every element draws a random permutation of the places and increasing ranks along it.

    Level j of an element is a fraction in [j, j + 1) at the j-th place of its permutation; a place keeps the
    least rank. All elements go through level after level together, and the levels end as soon as every
    place is below the next level, since no later rank can be less.
    """
    least = np.full(ranks, np.iinfo(np.uint64).max, np.uint64)
    order = np.tile(np.arange(ranks, dtype=np.int16), (len(elements), 1))
    row = np.arange(len(elements))
    for level in range(ranks if len(elements) else 0):
        with np.errstate(over="ignore"):
            drawn = _mixed(elements + _GOLD * _U(level + 1))
        other = level + ((drawn >> _U(32)) % _U(ranks - level)).astype(np.int64)
        place = order[row, other]  # a step of a Fisher-Yates shuffle
        order[row, other] = order[:, level]
        np.minimum.at(least, place, _U(level << _FRACTION) | (drawn & _U((1 << _FRACTION) - 1)))
        if least.max() < _U((level + 1) << _FRACTION):
            break
    return least.astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    with np.errstate(over="ignore"):
        parts = signature.reshape(BANDS, ROWS).astype(np.uint64)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD
        for i in range(ROWS):
            keys = _mixed(keys + parts[:, i] * _PLACES[i])
    return keys.view(np.int64)


def _sketch(batches):
    import xxhash

    for batch in batches:
        sizes, digests, signatures = [], [], []
        for text in batch.column("_text").to_pylist():
            found = shingles(text)
            sizes.append(len(found))
            digests.append(xxhash.xxh3_128_digest(found.tobytes()))
            signatures.append(super_minhash(found).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                          pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "set_id", "signature"])


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, set size, identifier of the shingle set and SuperMinHash signature of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text"))
    return rows.mapInArrow(_sketch, "doc_id long, n_shingles long, set_id binary, signature binary")


def _bands(batches):
    for batch in batches:
        keys = [band_keys(np.frombuffer(s, np.uint32)) for s in batch.column("signature").to_pylist()]
        if keys:
            ids = np.repeat(batch.column("rep").to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(ids)], ["bucket", "rep"])


def _with_sets(batches):
    import xxhash

    for batch in batches:
        sets = [shingles(t).tobytes() for t in batch.column("_text").to_pylist()]
        ids = [xxhash.xxh3_128_digest(s) for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "set_id", "elements"])


def _meet(batches):
    for batch in batches:
        sizes_a, sizes_b, common, added, lost = [], [], [], [], []
        for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            inside = a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b
            kept = b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a
            sizes_a.append(len(a))
            sizes_b.append(len(b))
            common.append(int(inside.sum()))
            added.append(b[~inside].tobytes())
            lost.append(a[~kept].tobytes())
        a, b, n = (np.array(x, np.int64) for x in (sizes_a, sizes_b, common))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(a), pa.array(b), pa.array(n), pa.array(100 * n >= LINK * (a + b - n)),
             pa.array(added, pa.binary()), pa.array(lost, pa.binary())], ["a", "b", "h", "n", "shared", "linked", "added", "lost"])


def compare(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes on their full shingle sets: sizes h and n, shared shingles, whether they are linked, and
    how b differs from a: the shingles it has ``added`` and those it has ``lost``.

    ``sets``: node, set_id and a document (rep) that has the set. Only texts of such documents are read again; a document id that several
    texts share yields several sets, of which the set's identifier takes the right one.
    """
    pairs = keep(pairs, "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = keep(sets.join(named, "node").select("node", "set_id", F.col("rep").alias("doc_id")), "paired")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_text")).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    # repeated rows go before the table is written, so that the joins below stand alone and their hot hubs can be split
    found = texts.mapInArrow(_with_sets, "doc_id long, set_id binary, elements binary").join(ids, ["doc_id", "set_id"]).dropDuplicates(["doc_id", "set_id"])
    elements = keep(found.select("node", "elements"), "elements")
    met = (pairs.join(elements.select(F.col("node").alias("b"), F.col("elements").alias("set_b")), "b")
           .join(elements.select(F.col("node").alias("a"), F.col("elements").alias("set_a")), "a"))
    return keep(met.select("a", "b", "set_a", "set_b").mapInArrow(
        _meet, "a long, b long, h long, n long, shared long, linked boolean, added binary, lost binary"), "met")


_MEMBER = ["x", "low", "h", "n", "shared", "added", "lost"]


def _block_links(batches):
    """Links between members of one hub, from how they differ from it; the rows of a pair of blocks come together."""
    key, rows = None, ([], [])

    def links():
        left, right = ([dict(zip(_MEMBER, r)) for r in side] for side in rows)
        found = _linked(left, right) if left and right else []
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for hub, i, j, side, *member in zip(*(batch.column(c).to_pylist() for c in ("hub", "i", "j", "side", *_MEMBER))):
            if (hub, i, j) != key:
                yield links()
                key, rows = (hub, i, j), ([], [])
            rows[side].append(member)
    yield links()


def _linked(left: list[dict], right: list[dict]) -> list[tuple[int, int]]:
    """Pairs in different components whose sets are similar enough.

    Members x and y share c + d - h of the hub's h shingles, where c and d are what each shares with it, and beyond that exactly
    the differences they have in common: both lost, which that sum counts as missing twice, or both added.
    """
    tokens = [[np.frombuffer(m["added"] + m["lost"], np.uint64) for m in side] for side in (left, right)]
    words = np.unique(np.concatenate(tokens[0]))
    both = np.zeros((len(left), len(right)), np.float32)
    place = []
    for side in tokens:
        row = np.repeat(np.arange(len(side)), [len(t) for t in side])
        flat = np.concatenate(side)
        column = np.minimum(np.searchsorted(words, flat), max(0, len(words) - 1))
        known = words[column] == flat if len(words) else np.zeros(0, bool)
        order = np.argsort(column[known], kind="stable")
        place.append((row[known][order], column[known][order]))
    for at in range(0, len(words), 4096):
        parts = []
        for (row, column), side in zip(place, (left, right)):
            first, last = np.searchsorted(column, (at, at + 4096))
            part = np.zeros((len(side), 4096), np.float32)
            part[row[first:last], column[first:last] - at] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    value = lambda side, name: np.array([m[name] for m in side], np.int64)
    shared = value(left, "shared")[:, None] + value(right, "shared")[None] - left[0]["h"] + both.astype(np.int64)
    size = value(left, "n")[:, None] + value(right, "n")[None]
    good = (100 * shared >= LINK * (size - shared)) & (value(left, "low")[:, None] != value(right, "low")[None])
    x, y = value(left, "x"), value(right, "x")
    return [(int(min(x[i], y[j])), int(max(x[i], y[j]))) for i, j in np.argwhere(good)]


def _across(met: DataFrame, label: DataFrame) -> DataFrame:
    """Links (a, b) between members of one hub that are in different components.

    Members linked to the hub are in one component, so one of the two isn't linked to it. Those members, a stated few, are held
    against all members of their hub, block by block of at most BLOCK rows or so; a task sees one pair of blocks and
    returns links only. What the members add to the hub and lose of it decides exactly, without their texts.
    """
    member = met.withColumnRenamed("a", "hub").withColumnRenamed("b", "x").join(
        label.select(F.col("u").alias("x"), F.col("v").alias("low")), "x", "left").withColumn("low", F.coalesce("low", "x"))
    mixed = member.groupBy("hub").agg(F.min("low").alias("p"), F.max("low").alias("q"), F.count(F.lit(1)).alias("all"), F.count_if(~F.col("linked")).alias("apart")) \
        .filter("p <> q").select("hub", F.ceil(F.col("all") / BLOCK).cast("int").alias("nj"), F.ceil(F.col("apart") / BLOCK).cast("int").alias("ni"))
    member = keep(member.join(mixed, "hub"), "members")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("x"), F.col(n)).cast("int")
    left = member.filter("NOT linked").select("hub", own("ni").alias("i"), upto("nj").alias("j"), F.lit(0).alias("side"), *_MEMBER)
    right = member.select("hub", upto("ni").alias("i"), own("nj").alias("j"), F.lit(1).alias("side"), *_MEMBER)
    together = left.unionByName(right).repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return together.mapInArrow(_block_links, "a long, b long").distinct()


def _forest(batches):
    """Union-find over the edges of a partition; a link from every node to the least node it reaches there."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    links = [(x, root(x)) for x in list(parent) if root(x) != x]
    for at in range(0, len(links), 50_000):
        part = links[at:at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u of a component but the least one, v: union-find inside partitions, stars across them.

    The star steps are those of Kiveris et al. (2014): neighbours of a node are linked to the least of them,
    first the greater ones, then the others. They end in a logarithmic number of rounds; every round is a written
    table, and nothing but counts reaches the driver.
    """
    oriented = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    links = keep(oriented.mapInArrow(_forest, "u long, v long").distinct(), "forest")
    while True:
        several = links.groupBy("u").count().filter("count > 1")
        deep = links.join(links.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if several.isEmpty() and deep.isEmpty():
            return links
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        links = keep(small.select("e.u", "e.v").filter("u <> v").distinct(), "stars")


def classes(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when the similarity of their shingle sets is 0.75 or more; component_id is the least doc_id
    reachable over links. Null and empty texts and texts without words have no shingles and no links. Repeated rows and
    equal sets fall together before anything else; rows that share a doc_id but not the text are told apart by their sets. A null doc_id can't be linked: it has a null component_id and stays.
    An empty table gives an empty result; other columns are ignored.

    1. One pass over the texts writes set identifiers and signatures; equal sets are represented by their least doc_id.
    2. In every bucket of a band, members are compared with one hub only, on full sets: with the member that meets most others
       over all its buckets, which is near the middle of a group of copies.
    3. Members of one hub that are in different components may be linked too. Those that aren't linked to their hub are held
       against its other members in blocks, by their differences from the hub, which give the exact similarity.
    """
    sketches = keep(sketch(docs), "sketches")
    filled = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = filled.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    reps = keep(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    bands = reps.select(F.col("node").alias("rep"), "signature").mapInArrow(_bands, "bucket long, rep long")
    sizes = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = keep(bands.join(sizes, "bucket"), "buckets")
    meets = members.groupBy("rep").agg(F.sum("members").alias("meets"))
    hubs = members.join(meets, "rep").groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("rep")).alias("low")))["low"].alias("low"))
    pairs = members.select("bucket", "rep").join(hubs.select("bucket", (-F.col("low")).alias("hub")), "bucket").filter("rep <> hub")
    met = compare(pairs.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), reps.select("node", "set_id", "rep"), docs)
    first = met.filter("linked").select("a", "b")
    second = keep(_across(met, components(first)), "across")
    final = components(first.unionByName(second)).select(F.col("u").alias("node"), F.col("v").alias("_of"))
    placed = keep(reps.select("set_id", "rep", "node").join(final, "node", "left").select("set_id", "rep", F.coalesce("_of", "node").alias("_of")), "placed")
    lows = placed.groupBy("_of").agg(F.min("rep").alias("_low"), F.count(F.lit(1)).alias("_n"))
    own = lookup_by_key(placed, lows, "_of", "_n", F.col("set_id"), HOT_SETS).select("set_id", "_low")
    linked = filled.join(own, "set_id").select("doc_id", "n_shingles", "_low")
    alone = sketches.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("_low"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", F.col("_low").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("_low")).alias("kept"))


def drop_near(docs: DataFrame) -> DataFrame:
    """One row of every group of linked documents, the one with the least doc_id, with the columns of ``docs``.

    Rows stay or go by doc_id: if several rows bear an id that stays, all of them stay, repeated rows too. Rows without doc_id, empty
    texts and texts without words stay; an empty table gives an empty result; no name of a further column matters.
    """
    own = free_names(docs, "_kept")[0]
    kept = classes(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").cast("long") == F.col(own), "left_semi").unionByName(docs.filter(F.col("doc_id").cast("long").isNull()))


def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from siftweb.llm.common import read

    return classes(read(spark, folder, "documents"))
