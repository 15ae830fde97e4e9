"""Pairs inside a cluster and their substitution counts, balanced for clusters of any size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotally.functions.letters import passes
from biotally.functions.site_products import Sequences, fold_pairs
from biotally.session import spread

_SITES = 60


def encode_planes(seq: Column) -> Column:
    """Sites packed 60 to a long: ``hi`` is 1 for G/T, ``lo`` is 1 for C/T, ``ok`` is 1 for A, C, G, T.

    A<->G and C<->T differ in hi only (transitions); everything else differs in lo (transversions).
    """
    chunks = F.regexp_extract_all(seq, F.lit(f"(.{{1,{_SITES}}})"), F.lit(1))

    def bits(chunk: Column, ones: str) -> Column:
        marked = F.regexp_replace(F.regexp_replace(chunk, f"[^{ones}]", "0"), "[A-Z]", "1")
        return F.conv(F.rpad(marked, _SITES, "0"), 2, 10).cast("bigint")

    return F.transform(chunks, lambda c: F.struct(bits(c, "GT").alias("hi"), bits(c, "CT").alias("lo"), bits(c, "ACGT").alias("ok")))


def substitution_counts(a: Column, b: Column) -> dict[str, Column]:
    """valid, transitions and transversions of two encoded sequences over their common length."""
    n = F.least(F.size(a), F.size(b))

    def count(fn) -> Column:
        return F.aggregate(
            F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), fn), F.lit(0), lambda acc, x: acc + x
        )

    both = lambda x, y: x["ok"].bitwiseAND(y["ok"])
    hi = lambda x, y: x["hi"].bitwiseXOR(y["hi"])
    lo = lambda x, y: x["lo"].bitwiseXOR(y["lo"])
    return {
        "valid": count(lambda x, y: F.bit_count(both(x, y))),
        "transversions": count(lambda x, y: F.bit_count(both(x, y).bitwiseAND(lo(x, y)))),
        "transitions": count(lambda x, y: F.bit_count(both(x, y).bitwiseAND(hi(x, y)).bitwiseAND(F.bitwise_not(lo(x, y))))),
    }


def encode_letters(seq: Column) -> Column:
    """Sites packed 60 to a long: the five bits of a letter's place in the alphabet, and ``ok`` where there is one to compare.

    Gaps and X are no letters to compare; every other letter is one, so twenty residues and the ambiguous ones differ alike.
    """
    chunks = F.regexp_extract_all(F.upper(seq), F.lit(f"(.{{1,{_SITES}}})"), F.lit(1))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def bits(chunk: Column, ones: str) -> Column:
        marked = F.translate(chunk, letters + "-", "".join("1" if x in ones else "0" for x in letters) + "0")
        return F.conv(F.rpad(F.regexp_replace(marked, "[^01]", "0"), _SITES, "0"), 2, 10).cast("bigint")

    planes = ["".join(x for i, x in enumerate(letters, 1) if i >> k & 1) for k in range(5)]
    return F.transform(chunks, lambda c: F.struct(*[bits(c, ones).alias(f"p{k}") for k, ones in enumerate(planes)], bits(c, letters.replace("X", "")).alias("ok")))


def residue_counts(a: Column, b: Column) -> dict[str, Column]:
    """valid sites and mismatches of two sequences encoded by `encode_letters`, over their common length."""
    n = F.least(F.size(a), F.size(b))

    def count(fn) -> Column:
        return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), fn), F.lit(0), lambda acc, x: acc + x)

    both = lambda x, y: x["ok"].bitwiseAND(y["ok"])

    def differ(x: Column, y: Column) -> Column:
        out = x["p0"].bitwiseXOR(y["p0"])
        for k in range(1, 5):
            out = out.bitwiseOR(x[f"p{k}"].bitwiseXOR(y[f"p{k}"]))
        return out

    return {"valid": count(lambda x, y: F.bit_count(both(x, y))), "mismatches": count(lambda x, y: F.bit_count(both(x, y).bitwiseAND(differ(x, y))))}


def _blocked(rows: DataFrame, cluster: str, key: str, block_rows: int, letters: Column | None = None) -> DataFrame:
    """``rows`` with their ``block`` by a hash of the key, and the number of ``blocks`` of their cluster.

    A row is sent once for each block of its cluster. A large cluster has as many blocks as give every core several pairs of
    blocks, and not more: what is sent grows with the rows, not with their square. Where ``letters`` gives the size of a row,
    blocks of more than `_BLOCK_LETTERS` are divided further.
    """
    most = max(8, math.ceil(math.sqrt(8 * rows.sparkSession.sparkContext.defaultParallelism)))
    blocks = F.least(F.lit(most), F.ceil(F.count("*") / block_rows).cast("int"))
    if letters is not None:
        blocks = F.greatest(blocks, F.ceil(F.sum(letters) / _BLOCK_LETTERS).cast("int"))
    sizes = rows.groupBy(cluster).agg(blocks.alias("blocks"))
    return rows.join(sizes, cluster).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))


def cluster_pairs(rows: DataFrame, cluster: str, key: str, payload: list[str], block_rows: int = 256) -> DataFrame:
    """Every unordered pair inside a cluster, as columns ``a``, ``b`` (a < b) and ``a_<payload>``, ``b_<payload>``.

    A cluster is cut into blocks of about ``block_rows`` rows and joined block against block on
    (cluster, block pair), so a cluster holding a third of the table spreads over many tasks instead of one.
    Clusters that fit one block get one key and are not copied; see `_blocked` for the number of copies.
    """
    blocked = _blocked(rows, cluster, key, block_rows)

    def side(prefix: str, others: Column) -> DataFrame:
        mine = blocked.withColumn("other", F.explode(others))
        return mine.select(
            cluster,
            F.least("block", "other").alias("lo_block"),
            F.greatest("block", "other").alias("hi_block"),
            F.col(key).alias(prefix),
            *[F.col(p).alias(f"{prefix}_{p}") for p in payload],
        )

    # The left row sits in the lower block.
    sides = (("a", F.sequence(F.col("block"), F.col("blocks") - 1)), ("b", F.sequence(F.lit(0), F.col("block"))))
    # Blocks bound the work of a key, so the explicit count may stand in for runtime splitting.
    a, b = (spread(side(p, others), cluster, "lo_block", "hi_block") for p, others in sides)
    joined = a.join(b, [cluster, "lo_block", "hi_block"])
    # Within one block each pair once.
    pairs = joined.filter((F.col("lo_block") < F.col("hi_block")) | (F.col("a") < F.col("b")))
    swap = F.col("a") > F.col("b")
    first = lambda p: F.when(swap, F.col(f"b_{p}")).otherwise(F.col(f"a_{p}")).alias(f"a_{p}")
    second = lambda p: F.when(swap, F.col(f"a_{p}")).otherwise(F.col(f"b_{p}")).alias(f"b_{p}")
    return pairs.select(
        cluster, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[first(p) for p in payload], *[second(p) for p in payload]
    )


_CHUNK = 256  # rows compared with one row at a time
_OUT = 1 << 16  # pairs a batch


def _dna_counts(x: dict, y: dict) -> tuple:
    both = x["ok"] & y["ok"]
    tv = both & (x["lo"] ^ y["lo"])
    return both, tv, both & (x["hi"] ^ y["hi"]) & ~tv


def _cell_pairs(key: str, keep: dict[str, tuple[str, str]], counts: Callable[[dict, dict], tuple], schema: pa.Schema) -> Callable:
    """The pairs of two blocks (or of one with itself) with the bits counted in each mask of ``counts``.

    One row is compared with up to 256 of similar length at a time: words by rows, filled up with sites that do not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(batches).combine_chunks()
        cell = cell.take(pc.sort_indices(cell, [(key, "ascending")]))
        keys = cell.column(key).combine_chunks()
        rank = np.zeros(len(cell), np.int64)
        rank[1:] = np.cumsum(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False))
        planes = cell.column("planes").combine_chunks()
        ends, flat = planes.offsets.to_numpy(), planes.values
        words = {f.name: flat.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k, f in enumerate(flat.type)}
        size, block = np.diff(ends), cell.column("block").to_numpy()
        order = np.argsort(size, kind="stable")
        one = block.min() == block.max()
        left, right = (order, order) if one else (order[block[order] == block.min()], order[block[order] == block.max()])
        found, waiting = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            i, j, *n = (np.concatenate(c) for c in zip(*found, strict=True))
            fits = rank[i] != rank[j]
            i, j, n = i[fits], j[fits], [c[fits] for c in n]
            a, b = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
            at = {"a": pa.array(a), "b": pa.array(b)}
            columns = [cell.column(name).combine_chunks().take(at[side]) for side, name in keep.values()]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, pa.int32()) for c in n]], schema=schema)

        for start in range(0, len(right), _CHUNK):
            chunk = right[start : start + _CHUNK]
            matrix = {p: np.zeros((size[chunk[-1]], len(chunk)), np.uint64) for p in words}
            for p, m in matrix.items():
                for at, j in enumerate(chunk):
                    m[: size[j], at] = words[p][ends[j] : ends[j + 1]]
            for place, i in enumerate(left[: start + len(chunk)] if one else left):
                first = max(0, place + 1 - start) if one else 0
                if first == len(chunk):
                    continue
                length = min(size[i], len(matrix["ok"]))
                x = {p: w[ends[i] : ends[i] + length, None] for p, w in words.items()}
                masks = counts(x, {p: m[:length, first:] for p, m in matrix.items()})
                found.append((np.full(len(chunk) - first, i), chunk[first:], *[np.bitwise_count(m).sum(axis=0, dtype=np.int32) for m in masks]))
                waiting += len(chunk) - first
                if waiting >= _OUT:
                    yield from flush()
                    found, waiting = [], 0
        if waiting:
            yield from flush()

    return run


def _pair_columns(rows: DataFrame, cluster: str, key: str, names: list[str], carry: tuple[str, ...], each: tuple[str, ...]) -> tuple[dict[str, tuple[str, str]], list[str], pa.Schema]:
    """Columns of a pair that are taken from the row of one side, and the types of all of its columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    keep = {cluster: ("a", cluster), "a": ("a", key), "b": ("b", key), **{c: ("a", c) for c in carry}, **{f"{side}_{c}": (side, c) for c in each for side in "ab"}}
    kinds = [f"`{out}` {rows.schema[name].dataType.simpleString()}" for out, (_, name) in keep.items()] + [f"{n} int" for n in names]
    return keep, kinds, to_arrow_schema(StructType.fromDDL(", ".join(kinds)))


def _counted_pairs(rows: DataFrame, cluster: str, key: str, counts: Callable[[dict, dict], tuple], names: list[str], carry: tuple[str, ...] = (), each: tuple[str, ...] = (), block_rows: int = 256) -> DataFrame:
    """Every unordered pair in each cluster of rows with ``planes``: (cluster, a, b, ``names``, ``carry``, a_ and b_ ``each``).

    Two blocks meet in one group, which holds their rows and gives their pairs batch by batch.
    """
    blocked = _blocked(rows.filter(F.col(key).isNotNull()), cluster, key, block_rows)
    cells = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(cluster, F.least("block", "other").alias("lo_block"), F.greatest("block", "other").alias("hi_block"), "block", key, "planes", *carry, *each)
    keep, kinds, schema = _pair_columns(rows, cluster, key, names, carry, each)
    pairs_of = _cell_pairs(key, keep, counts, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pairs_of(batches)

    dealt = spread(cells, cluster, "lo_block", "hi_block")
    out = dealt.groupBy(cluster, "lo_block", "hi_block").applyInArrow(run, ", ".join(kinds))
    return out.select(cluster, "a", "b", *names, *carry, *[f"{side}_{c}" for c in each for side in "ab"])


_WORDS = 1 << 17  # words of a plane compared at a time
_DNA_SITES = {"hi": "GT", "lo": "CT", "ok": "ACGT"}
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RESIDUE_SITES = {**{f"p{k}": "".join(x + x.lower() for i, x in enumerate(_ALPHABET, 1) if i >> k & 1) for k in range(5)}, "ok": "".join(x + x.lower() for x in _ALPHABET if x != "X")}


def _residue_masks(x: dict, y: dict) -> tuple:
    both = x["ok"] & y["ok"]
    differ = x["p0"] ^ y["p0"]
    for k in range(1, 5):
        differ |= x[f"p{k}"] ^ y[f"p{k}"]
    return both, both & differ


def _packed(seq: pa.Array, sites: dict[str, str]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """First word and number of words of each text, and its planes: 64 sites a word, a site for each code point."""
    ends = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
    data = np.frombuffer(seq.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    begins = (data & 0xC0) != 0x80
    if not begins.all():
        ends = np.concatenate(([0], np.cumsum(begins)))[ends]
        data = data[begins]
    lengths = np.diff(ends)
    size = -(-lengths // 64)
    start = np.cumsum(size) - size
    codes = np.zeros(256, np.uint8)
    for k, ones in enumerate(sites.values()):
        codes[list(ones.encode())] |= 1 << k
    marked = np.zeros(64 * int(size.sum()), np.uint8)
    marked[np.arange(len(data)) + np.repeat(64 * start - ends[:-1], lengths)] = codes[data]
    return start, size, {p: np.packbits(marked >> k & 1, bitorder="little").view(np.uint64) for k, p in enumerate(sites)}


def _bits_of_pairs(i: np.ndarray, j: np.ndarray, start: np.ndarray, size: np.ndarray, planes: dict[str, np.ndarray], masks: Callable[[dict, dict], tuple], kinds: int) -> list[np.ndarray]:
    """Bits of each mask for the pairs (i, j), those of like common length at a time."""
    out = [np.zeros(len(i), np.int32) for _ in range(kinds)]
    common = np.minimum(size[i], size[j])
    order = np.argsort(common, kind="stable")
    common = common[order]
    at = int(np.searchsorted(common, 1))
    while at < len(order):
        least = int(common[at])
        end = min(at + max(1, _WORDS // least), int(np.searchsorted(common, 2 * least + 1)))
        some, step = order[at:end], np.arange(common[end - 1])
        inside = step < common[at:end, None]
        x, y = ({p: w[np.where(inside, start[k[some], None] + step, 0)] for p, w in planes.items()} for k in (i, j))
        x["ok"] = np.where(inside, x["ok"], np.uint64(0))
        for kept, mask in zip(out, masks(x, y), strict=True):
            kept[some] = np.bitwise_count(mask).sum(axis=1, dtype=np.int32)
        at = end
    return out


def _sequence_pairs(rows: DataFrame, cluster: str, key: str, sites: dict[str, str], masks: Callable[[dict, dict], tuple], names: list[str], carry: tuple[str, ...] = (), each: tuple[str, ...] = (), block_rows: int = 256) -> DataFrame:
    """Every unordered pair in each cluster of rows with ``seq``: (cluster, a, b, ``names``, ``carry``, a_ and b_ ``each``).

    Rows lie sorted by cluster, pair of blocks and key, so one pass over a task's batches packs and compares the rows of many
    small clusters together; the rows of one pair of blocks are the most that a task holds.
    """
    blocked = _blocked(rows.filter(F.col(key).isNotNull()), cluster, key, block_rows)
    cells = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(cluster, F.least("block", "other").alias("lo_block"), F.greatest("block", "other").alias("hi_block"), "block", key, *dict.fromkeys(("seq", *carry, *each)))
    keep, kinds, schema = _pair_columns(rows, cluster, key, names, carry, each)
    cell = [cluster, "lo_block", "hi_block"]

    def changes(table: pa.Table, columns: list[str]) -> np.ndarray:
        changed = np.zeros(max(len(table) - 1, 0), bool)
        for c in columns:
            values = table.column(c).combine_chunks()
            changed |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        return changed

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(changes(table, cell)) + 1
        end = np.repeat([*cuts, len(table)], np.diff([0, *cuts, len(table)]))
        rank = np.concatenate(([0], np.cumsum(changes(table, [key]))))
        block, crossed = table.column("block").to_numpy(), pc.less(table.column("lo_block"), table.column("hi_block")).to_numpy()
        start, size, planes = _packed(table.column("seq").cast(pa.large_binary()).combine_chunks(), sites)
        columns = {name: table.column(name).combine_chunks() for _, name in keep.values()}
        after = end - np.arange(len(table)) - 1
        total = np.concatenate(([0], np.cumsum(after)))
        row = 0
        while row < len(table):
            last = max(row + 1, int(np.searchsorted(total, total[row] + _OUT, side="right")) - 1)
            i = np.repeat(np.arange(row, last), after[row:last])
            j = i + 1 + np.arange(len(i)) - np.repeat(total[row:last] - total[row], after[row:last])
            fits = np.where(crossed[i], block[i] != block[j], rank[i] != rank[j])
            i, j, row = i[fits], j[fits], last
            if len(i):
                at = {"a": pa.array(i), "b": pa.array(j)}
                bits = _bits_of_pairs(i, j, start, size, planes, masks, len(names))
                yield pa.RecordBatch.from_arrays([*(columns[name].take(at[side]) for side, name in keep.values()), *map(pa.array, bits)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if all(held[0].column(c)[0] == b.column(c)[-1] for c in cell):
                continue
            table = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(changes(table, cell))[-1]) + 1
            yield from compared(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from compared(pa.Table.from_batches(held))

    out = spread(cells, *cell).sortWithinPartitions(*cell, key).mapInArrow(run, ", ".join(kinds))
    return out.select(cluster, "a", "b", *names, *carry, *[f"{side}_{c}" for c in each for side in "ab"])


_BLOCK_LETTERS = 1 << 27  # at most in a block of folded pairs: 32 MB at two bits a letter
_FOLDED_ROWS = 8192  # about as many in a block of folded pairs: the fewer rows, the more a pair costs
_FOLDED_SITES = {"lo": "CT", "hi": "GT", "ok": "ACGT"}
_CELLS_A_CORE = 8


def _with_sites(rows: DataFrame) -> DataFrame:
    """Rows with ``sites``, two bits a letter of ``seq``, its ``length`` and, where it has letters other than A, C, G, T, ``ok`` instead of ``seq``."""
    others = [c for c in rows.columns if c != "seq"]

    def of_words(words: np.ndarray, size: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int64) * words[:1].nbytes if len(words) else np.zeros(len(size) + 1, np.int64)
        valid = None if missing is None else pa.py_buffer(np.packbits(~missing, bitorder="little"))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [valid, pa.py_buffer(ends), pa.py_buffer(words)]).cast(pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in passes(batches, "seq"):
            seq = b.column("seq")
            start, size, planes = _packed(seq.cast(pa.large_binary()), _FOLDED_SITES)
            length = pc.utf8_length(seq).cast(pa.int64())
            marked = np.concatenate(([0], np.cumsum(np.bitwise_count(planes["ok"]), dtype=np.int64)))
            whole = marked[start + size] - marked[start] == length.to_numpy()
            sites = of_words(np.stack([planes["lo"], planes["hi"]], axis=1), size)
            ok = of_words(planes["ok"][np.repeat(~whole, size)], np.where(whole, 0, size), whole)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), length, sites, ok], names=[*others, "length", "sites", "ok"])

    return rows.select(*others, "seq").mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others) + ", length bigint, sites binary, ok binary")


def _words(binary: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all rows as words; rows without a value have none."""
    parts = []
    for x in binary.chunks:
        ends = np.frombuffer(x.buffers()[1], np.int32)
        parts.append(np.frombuffer(x.buffers()[2] or b"", np.uint8)[ends[x.offset] : ends[x.offset + len(x)]])
    return np.concatenate(parts).view(np.uint64)


def _folded_pairs(rows: DataFrame, cluster: str, key: str) -> DataFrame:
    """Distances of all pairs in each cluster of rows with ``seq``, folded where they are made: a row for each pair of blocks that has one.

    Sequences travel at two bits a letter. A pair of blocks is the most that a task holds: a cluster has more blocks where they
    would have over `_BLOCK_LETTERS` letters. No row is made for a pair.
    """
    packed = _with_sites(rows.filter(F.col(key).isNotNull()))
    blocked = _blocked(packed, cluster, key, _FOLDED_ROWS, F.col("length"))
    cells = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = [cluster, "lo_block", "hi_block"]
    cells = cells.select(cluster, F.least("block", "other").alias("lo_block"), F.greatest("block", "other").alias("hi_block"), "block", key, "length", "sites", "ok")
    counts = ("valid", "transversions", "transitions")
    kinds = ["pairs bigint", "equal bigint", "total double", *[f"{end}_{n} int" for end in ("closest", "farthest") for n in counts]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ok = table.column("ok")
        seqs = Sequences(table.column("length").to_numpy(), _words(table.column("sites")).reshape(-1, 2), _words(ok), ok.is_null().to_numpy())
        block = table.column("block").to_numpy()
        keys = table.column(key).combine_chunks().dictionary_encode()
        unlike = len(keys.dictionary) == len(keys)
        found = fold_pairs(seqs, block, None if unlike else keys.indices.to_numpy())
        if found.pairs:
            values = [found.pairs, found.equal, found.total / 1e9, *found.closest, *found.farthest]
            columns = [pa.array([v], kind) for v, kind in zip(values, [pa.int64(), pa.int64(), pa.float64(), *[pa.int32()] * 6], strict=True)]
            yield pa.RecordBatch.from_arrays([table.column(cluster).chunk(0)[:1], *columns], names=[cluster, *[k.split()[0] for k in kinds]])

    # Pairs of blocks are few and heavy: more tasks than cores, so that no core is left with several of them at the end.
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _CELLS_A_CORE * spark.sparkContext.defaultParallelism)
    dealt = cells.repartition(tasks, *cell)
    return dealt.groupBy(*cell).applyInArrow(run, ", ".join([f"`{cluster}` {rows.schema[cluster].dataType.simpleString()}", *kinds]))


def k2p_distance(valid: Column, transitions: Column, transversions: Column) -> Column:
    """Kimura two-parameter distance; plain mismatch share where the logarithms do not exist; 1 without valid sites."""
    p, q = transitions / F.nullif(valid, F.lit(0)), transversions / F.nullif(valid, F.lit(0))
    x, y = 1 - 2 * p - q, 1 - 2 * q
    return F.when(valid == 0, 1.0).when((x > 0) & (y > 0), -0.5 * F.ln(x) - 0.25 * F.ln(y)).otherwise(p + q)


def p_distance(valid: Column, transitions: Column, transversions: Column) -> Column:
    return F.when(valid == 0, 1.0).otherwise((transitions + transversions) / F.nullif(valid, F.lit(0)))


def protein_distances(proteins: DataFrame, cluster: str = "cluster", key: str = "protein_id", min_length: int = 0) -> DataFrame:
    """valid, matches, mismatches and the share of mismatches ``d`` of all pairs in each cluster; 1 without a valid site."""
    rows = proteins.filter(F.length("seq") >= min_length).select(cluster, key, "seq")
    out = _sequence_pairs(rows, cluster, key, _RESIDUE_SITES, _residue_masks, ["valid", "mismatches"])
    share = F.when(F.col("valid") == 0, 1.0).otherwise(F.col("mismatches") / F.nullif(F.col("valid"), F.lit(0)))
    return out.select("*", (F.col("valid") - F.col("mismatches")).alias("matches"), F.round(share, 9).alias("d"))


def pair_distances(
    isolates: DataFrame, cluster: str = "cluster", key: str = "isolate_id", min_length: int = 10, carry: tuple[str, ...] = (), each: tuple[str, ...] = (), in_cells: bool = False, folded: bool = False
) -> DataFrame:
    """Counts and distances of all pairs in each cluster.

    ``carry`` names columns that are the same for a whole cluster; they ride with the isolates, so that pairs need no
    join afterwards. ``each`` names columns of the isolates that a pair keeps of both, as a_<name> and b_<name>.
    ``in_cells``: for clusters that grow with the table. Sequences travel as packed bit planes (less than half their size), as
    they are sent once for each block, and a pair of blocks is counted in one group; else many small clusters are counted in one pass.
    ``folded``: the pairs of two blocks become one row where they are counted, with their number (``pairs``), that of those
    without a distance (``equal``), the sum of the distances (``total``), the ``closest`` and the ``farthest`` one.
    """
    long_enough = isolates.filter(F.length("seq") >= min_length).select(cluster, key, "seq", *carry, *each)
    if folded:
        if carry or each or not in_cells:
            raise ValueError("folded pairs are counted in cells and keep no other columns")
        out = _folded_pairs(long_enough, cluster, key)
        ends = {end: [F.col(f"{end}_{n}") for n in ("valid", "transitions", "transversions")] for end in ("closest", "farthest")}
        return out.select(cluster, "pairs", "equal", "total", *[F.round(k2p_distance(*n), 9).alias(end) for end, n in ends.items()])
    if in_cells:
        rows = spread(long_enough, key).select(cluster, key, encode_planes(F.col("seq")).alias("planes"), *carry, *each)
        out = _counted_pairs(rows, cluster, key, _dna_counts, ["valid", "transversions", "transitions"], carry, each)
    else:
        out = _sequence_pairs(long_enough, cluster, key, _DNA_SITES, _dna_counts, ["valid", "transversions", "transitions"], carry, each)
    v, ts, tv = F.col("valid"), F.col("transitions"), F.col("transversions")
    return out.select(
        "*", (v - ts - tv).alias("matches"), F.round(k2p_distance(v, ts, tv), 9).alias("d"), p_distance(v, ts, tv).alias("p")
    )
