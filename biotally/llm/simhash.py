"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits share a value within half that radius of both. So every distinct fingerprint
emits its ball of half the radius (65 values for radius 2), the balls are shuffled on those values, and fingerprints
that meet are checked and deduplicated. A value can have no more than one ball of distinct fingerprints, whatever the
number of documents, so no group is large; exact copies share one fingerprint and take part once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from biotally.llm.components import components
from biotally.llm.words import chunks, id_column, mix, text_column
from biotally.session import cut_lineage, spread

BITS, SHINGLE, RADIUS, SEED = 64, 3, 2, 42


def _fingerprints(text: pa.Array, shingle: int, parts: int = 1) -> np.ndarray:
    """(texts, parts): part 0 from the shingles' hashes themselves, each other one from a scrambling of them."""
    out = np.zeros((len(text), parts), np.uint64)
    for t in chunks(text, lower=True):
        # One space between words, none elsewhere: every shingle is then a slice.
        lengths = t.end - t.start
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        from_bytes = np.flatnonzero(t.inside)
        packed = np.full(len(from_bytes) + len(lengths), 32, np.uint8)
        packed[from_bytes + np.repeat(starts - t.start, lengths)] = t.data[from_bytes]
        flat = packed.tobytes()
        words = t.per_doc()
        n = np.where(words > 0, np.maximum(words - shingle + 1, 1), 0)
        first = np.cumsum(words) - words
        base = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        last = np.minimum(base + shingle - 1, np.repeat(first + words - 1, n))
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts[base].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(base))
        at = np.flatnonzero(n)
        if not len(at):
            continue
        for k in range(parts):
            own = mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if k else h
            bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, (np.cumsum(n) - n)[at], axis=0, dtype=np.int32)
            out[t.first + at, k] = np.packbits(2 * ones > n[at, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each whole text as a signed long; 0 where it has no word."""
    base = docs.select(id_column(docs, id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_fingerprints(b.column("text"), shingle)[:, 0].view(np.int64))], names=["doc_id", "fp"])

    return base.mapInArrow(hashed, "doc_id long, fp long")


def ball(radius: int, bits: int = BITS) -> list[int]:
    """The xor masks of all values within ``radius`` bits, as signed longs."""
    masks = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Verified links (a, b) between distinct fingerprints, enough of them to connect all that lie within ``radius``.

    In each group of fingerprints that emitted the same value, neighbours in sorted order are linked: all of a
    group lie within ``radius`` of each other, so the path through it connects them without listing all its pairs.
    """
    if radius % 2:
        raise ValueError("the radius is halved: give an even one")
    masks = F.array(*(F.lit(m) for m in ball(radius // 2)))
    emitted = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"))
    met = emitted.withColumn("before", F.lag("fp").over(Window.partitionBy("value").orderBy("fp"))).where(F.col("before").isNotNull())
    return met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("before"))) <= radius).select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach, one row per input row.

    Texts are lower-cased in A-Z; fewer words than a shingle make one shingle; null or blank text has fingerprint
    zero, linked like any other. Rows with a null id belong to their component without naming it: its id is null only
    if all are. Repeated rows stay. Other columns of ``docs`` are not read.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(ball_links(distinct, radius))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select(F.col("fp").alias("k"), "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(of_fp, F.col("fp") == F.col("k")).select("doc_id", digits.alias("fingerprint"), "component_id")


# Narrow fingerprints of 28 bits have several chances to meet in each of which most strangers differ: strangers that do meet
# grow with the square of the texts, so they are told apart where they meet and become no rows.
SIMILAR, SIMILAR_SHINGLE, PARTS, NARROW = 0.8, 5, 5, 28
TILE = 1024  # members of a value in a block; two blocks meet in one task
GROUP = 8192  # members of a group that are compared with each other in one task


def similarity_bits(similarity: float, bits: int) -> int:
    """Differing bits of fingerprints at a Jaccard similarity of the shingles: the mean and one standard deviation."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + math.sqrt(bits * p * (1 - p)))


def _forest(tile: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Links between the roots of a tile (rows of value, lo, hi, block, root and fingerprints), enough to connect all its close pairs."""
    lo, hi = tile[0, 1], tile[0, 2]
    root, prints = tile[:, 4], tile[:, 5:].view(np.uint64)
    group, out = root.copy(), []
    split = int(np.searchsorted(tile[:, 3], hi)) if lo < hi else 0
    for i in range(split if lo < hi else len(tile)):
        rest = slice(split if lo < hi else i + 1, len(tile))
        close = np.bitwise_count(prints[rest] ^ prints[i]).sum(axis=1) <= limit
        other, at = np.unique(group[rest][close], return_index=True)
        if fresh := [(g, k) for g, k in zip(other.tolist(), at.tolist(), strict=True) if g != group[i]]:
            ends = root[rest][close]
            out.extend((int(root[i]), int(ends[k])) for _, k in fresh)
            group[np.isin(group, [g for g, _ in fresh])] = group[i]
    return out


def bits_left_out(count: int, bits: int = NARROW, radius: int = RADIUS, group: int = GROUP) -> list[int]:
    """Masks of which one covers any ``radius`` of ``bits`` bits: fingerprints that close are equal outside of one of them.

    The bits are cut into so many blocks that ``count`` random fingerprints, equal outside of ``radius`` blocks, come in
    groups of an eighth of ``group`` or less. More blocks mean smaller groups and more of them, never other meetings.
    """
    for parts in range(2 * radius, bits + 1):
        blocks = [sum(1 << int(i) for i in block) for block in np.array_split(np.arange(bits), parts)]
        masks = [sum(c) for c in combinations(blocks, radius)]
        if 8 * count <= group << bits - max(m.bit_count() for m in masks):
            break
    return masks


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Labels (the smallest row of each component, every row its own at first) after rows ``a`` and ``b`` are linked."""
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def _group_links(rows: np.ndarray, narrow: np.ndarray, limit: int, held: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Links between roots, enough to connect all close pairs of the groups (rows of key, node, root and fingerprints, by key and root).

    A pair counts if its narrow fingerprints are within ``RADIUS`` bits and all fingerprints within ``limit``. Each row is
    compared with the k-th one before it, of all groups at once, for k = 1, 2, ...; at most some ``held`` pairs are held.
    """
    key, root, prints = rows[:, 0], rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
    number = np.arange(len(rows))
    fresh = np.ones(len(rows), bool)
    fresh[1:] = key[1:] != key[:-1]
    place = number - np.maximum.accumulate(np.where(fresh, number, 0))
    fresh[1:] |= root[1:] != root[:-1]
    label = np.maximum.accumulate(np.where(fresh, number, 0))
    found, n, k, later = [], 0, 1, number[place >= 1]
    while len(later):
        at = later[np.bitwise_count(narrow[later] ^ narrow[later - k]) <= RADIUS]
        at = at[label[at] != label[at - k]]
        if len(at):
            at = at[np.bitwise_count(prints[at] ^ prints[at - k]).sum(axis=1) <= limit]
            found.append((at - k, at))
            n += len(at)
        k += 1
        later = later[place[later] >= k]
        if n > held or n and not len(later):
            _merge(label, *(np.concatenate(x) for x in zip(*found, strict=True)))
            found, n = [], 0
    moved = np.flatnonzero(fresh & (label != number))
    return root[moved], root[label[moved]]


def _group_meetings(placed: DataFrame, tables: Column, words: list[str], limit: int, masks: list[int], group: int) -> DataFrame:
    """(a, b, fp): links between the ``near`` roots of nodes with close narrow fingerprints, where fp is null.

    Nodes whose narrow fingerprints of a table are equal outside of a mask are a group; all pairs of up to ``group`` members
    are compared in the task that has them. Members of larger groups come back: a is the node, b its root, fp its fingerprint.
    """
    keys = placed.select("node", "near", *words, F.explode(tables).alias("fp"))
    keys = keys.select("node", "near", *words, "fp", F.posexplode(F.array(*(F.lit(~m).cast("long") for m in masks))).alias("c", "mask"))
    key = F.col("fp").bitwiseAND(F.col("mask")).bitwiseOR(F.shiftleft(F.col("c").cast("long"), NARROW + 12))
    members = spread(keys.select(key.alias("key"), "node", "near", *words), "key").sortWithinPartitions("key", "near")
    names, types = ["a", "b", "fp"], [pa.int64()] * 3

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, crowded = np.zeros((0, 3 + len(words)), np.int64), -1
        for b in chain(batches, (None,)):
            rows = left if b is None else np.concatenate((left, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)))
            if not len(rows):
                continue
            found, n = np.unique(rows[:, 0], return_counts=True)
            large = (n > group) | (found == crowded)
            crowded = int(found[-1]) if large[-1] else -1
            crowd = np.repeat(large, n)
            # The last group may go on in the next batch.
            ready = crowd | (b is None) | (rows[:, 0] != found[-1])
            table = rows[:, 0] >> NARROW & 0xFFF
            narrow = rows[np.arange(len(rows)), 3 + table // 2] >> NARROW * (table % 2) & (1 << NARROW) - 1
            if crowd.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[crowd, 1]), pa.array(rows[crowd, 2]), pa.array((table << NARROW | narrow)[crowd])], names=names)
            light = ready & ~crowd
            one, other = _group_links(rows[light], narrow[light], limit)
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(other), pa.nulls(len(one), types[2])], names=names)
            left = rows[~ready]

    return members.mapInArrow(compare, "a long, b long, fp long")


def _all_meetings(meetings: DataFrame, placed: DataFrame, words: list[str], limit: int) -> DataFrame:
    """Links (a, b) between the ``near`` roots of nodes that share a value and lie within ``limit`` bits.

    Values whose members have one root are done. The others are cut into blocks of ``TILE`` members, every two blocks
    (and each with itself) meet in one tile, and all pairs of a tile are compared in the task that has it.
    """
    # A node has 290 values at most: they travel to its root, and then to its fingerprints, as one row and not as a row of the join each.
    listed = meetings.groupBy("node").agg(F.collect_list(F.struct("value", "place")).alias("at"))
    held = cut_lineage(listed.join(placed.select(F.col("node").alias("k"), "near"), F.col("node") == F.col("k")).select(F.inline("at"), "node", "near"))
    mixed = held.groupBy("value").agg(F.min("near").alias("least_root"), F.max("near").alias("last_root"), F.max("place").alias("n")).where("least_root <> last_root")
    mixed = mixed.select(F.col("value").alias("v"), F.expr(f"(n - 1) div {TILE}").alias("last"))
    again = held.drop("near").join(mixed, F.col("value") == F.col("v")).groupBy("node").agg(F.collect_list(F.struct("value", "last", F.expr(f"(place - 1) div {TILE}").alias("block"))).alias("at"))
    rows = again.join(placed, "node").select(F.inline("at"), "near", *words).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    columns = ["value", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", F.col("near").alias("root"), *words]
    tiles = spread(rows.select(*columns), "value", "lo", "hi").sortWithinPartitions("value", "lo", "hi", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.zeros((0, 5 + len(words)), np.int64)
        for b in batches:
            left = np.concatenate((left, np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)))
            cuts = [0, *(np.flatnonzero((left[1:, :3] != left[:-1, :3]).any(axis=1)) + 1).tolist()]
            if out := [x for a, z in pairwise(cuts) for x in _forest(left[a:z], limit)]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])
            left = left[cuts[-1] :]
        if len(left) and (out := _forest(left, limit)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return tiles.mapInArrow(compare, "a long, b long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILAR, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """doc_id and component_id as of ``simhash_components``, for texts of a shingle similarity rather than a radius.

    At the similarity of 0.8 two 64-bit fingerprints differ in about ten bits, and the ball of half of that is out of
    reach. So ``PARTS`` fingerprints are taken and cut into narrow ones of ``NARROW`` bits; these are linked by ball
    hashing with radius 2, each for itself, and the links checked on all bits together. A true pair has several
    chances to meet, its recall is measured in the tests; texts with equal fingerprints take part once.

    Members of a narrow value need not be alike, so every two of them are compared unless they are of one component
    already: first each with the one before it of an equal narrow fingerprint, then all whose narrow fingerprints are
    equal outside of a mask, in the task where they meet. Chance meetings, which grow with the square of the texts, make
    no rows there. A group of more than ``GROUP`` members sends its members on to the values of their balls: in each value
    that has several components neighbours are compared, in values of up to three members all, then all in values of four
    members or more.
    Members of equal narrow fingerprints, which share all their values, meet where the value is that fingerprint.
    """
    base = docs.select(id_column(docs, id_col).alias("doc_id"), text_column(docs, text_col).alias("text"))
    words = [f"s{k}" for k in range(PARTS)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = _fingerprints(b.column("text"), shingle, PARTS).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(f[:, k]) for k in range(PARTS))], names=["doc_id", *words])

    marked = cut_lineage(base.mapInArrow(hashed, "doc_id long, " + ", ".join(f"{w} long" for w in words)).withColumn("node", F.xxhash64(*words)))
    distinct = cut_lineage(marked.groupBy("node").agg(F.min("doc_id").alias("least"), *(F.first(w).alias(w) for w in words)))
    narrow = [F.shiftrightunsigned(w, NARROW * half).bitwiseAND(F.lit((1 << NARROW) - 1)) for w in words for half in (0, 1)]
    tables = F.array(*(F.shiftleft(F.lit(k).cast("long"), NARROW).bitwiseOR(n) for k, n in enumerate(narrow)))
    limit = similarity_bits(similarity, BITS * PARTS)

    def close(met: DataFrame) -> DataFrame:
        of = lambda c, side: distinct.select(F.col("node").alias(c), *(F.col(x).alias(f"{side}{x}") for x in words))
        pairs = cut_lineage(met.where(F.col("before").isNotNull()).distinct()).join(of("node", "a"), "node").join(of("before", "b"), "before")
        apart = sum((F.bit_count(F.col(f"a{x}").bitwiseXOR(F.col(f"b{x}"))) for x in words[1:]), F.bit_count(F.col("as0").bitwiseXOR(F.col("bs0"))))
        return pairs.where(apart <= limit).select(F.col("before").alias("a"), F.col("node").alias("b"))

    # Equal narrow fingerprints come first: they join most of a family, whose values then bring no pair of one component.
    same = distinct.select("node", F.explode(tables).alias("fp")).select("node", F.lag("node").over(Window.partitionBy("fp").orderBy("node")).alias("before"))
    early = cut_lineage(components(close(same)).withColumnRenamed("node", "k"))
    rooted = cut_lineage(distinct.join(early, F.col("node") == F.col("k"), "left").select("node", F.coalesce("root", "node").alias("near"), *words))
    met = cut_lineage(_group_meetings(rooted, tables, words, limit, bits_left_out(rooted.count(), group=GROUP), GROUP))
    crowd = met.where("fp is not null").select(F.col("a").alias("node"), F.col("b").alias("root"), "fp").distinct()
    masks = F.array(*(F.lit(m).cast("long") for m in ball(RADIUS // 2, NARROW)))
    emitted = crowd.select("node", "root", F.posexplode(masks).alias("k", "mask"), "fp").select("node", "root", F.col("fp").bitwiseXOR(F.col("mask")).alias("value"), F.col("k").cast("byte").alias("k"))
    # A value that only members with one and the same narrow fingerprint emitted, other than itself, brings nothing: they
    # all meet at that fingerprint too. Nor does a value whose members are of one component.
    whole = Window.partitionBy("value")
    members = F.count("*").over(whole)
    useful = (F.min("k").over(whole) == 0) | (F.min("k").over(whole) != F.max("k").over(whole))
    mixed = F.min("root").over(whole) != F.max("root").over(whole)
    w = Window.partitionBy("value").orderBy("root", "node")
    other = lambda k: F.when(F.col("root") != F.lag("root", k).over(w), F.lag("node", k).over(w))
    around = emitted.select("node", "value", (useful & mixed & (members > 1)).alias("useful"), (members > 3).alias("many"), F.row_number().over(w).alias("place"), *(other(k).alias(f"b{k}") for k in (1, 2)))
    around = around.where("useful and (many or b1 is not null or b2 is not null)").select("node", "b1", "b2", "many", "value", "place")
    around = cut_lineage(around)
    # Where all members are compared later, a path through their components is enough here.
    links = close(around.select("node", F.explode(F.array("b1", F.when(~F.col("many"), F.col("b2")))).alias("before")))
    links = links.unionByName(met.where("fp is null").select("a", "b")).unionByName(early.where("k <> root").select(F.col("k").alias("a"), F.col("root").alias("b")))
    found = components(links).withColumnRenamed("node", "k")
    placed = cut_lineage(distinct.join(found, F.col("node") == F.col("k"), "left").select("node", "least", F.coalesce("root", "node").alias("near"), *words))
    merged = components(_all_meetings(around.where("many").select("value", "place", "node"), placed.drop("least"), words, limit)).withColumnRenamed("node", "k")
    rooted = placed.join(merged, F.col("near") == F.col("k"), "left").select("node", "least", F.coalesce("root", "near").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = rooted.join(named, "root").select(F.col("node").alias("k"), "component_id")
    return marked.join(of_node, F.col("node") == F.col("k")).select("doc_id", "component_id")
