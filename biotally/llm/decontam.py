"""Benchmark decontamination by latent semantic retrieval, with exact checks of what it finds.

Texts are cut into blocks of ``BLOCK`` words; a passage is as many neighbouring blocks as hold an item of the
benchmark at any offset. Passages and items are TF-IDF vectors over the benchmark's own terms, the only ones on which
a passage and an item can agree. A randomised SVD finds the latent space: every task adds its blocks, with random
signs, into a sketch of ``SKETCH`` rows (a product of the corpus matrix with a sparse random matrix), the sketches are
summed, and the small sketch, joined by the rows of the items, is factorised. One more pass projects all passages,
keeps item and passage pairs of high cosine, and checks these by longest common subsequence and by the item's answer.

The benchmark is taken in groups of ``ITEMS`` items, so all that the driver holds and sends is bounded by ITEMS, TERMS,
SKETCH and RANK. Documents are never compared with each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotally.llm.words import Hashes, Texts, chunks, collected, id_column, mix, separators_but, text_column
from biotally.session import cut_lineage

BLOCK = 24  # words
ITEMS, TERMS, SKETCH, RANK = 1024, 1 << 14, 128, 128
COSINE = 0.65
LEAK, PARAPHRASE, ANSWER = 0.8, 0.6, 0.8  # shares of an item's words in order; of its answer's
SHORTEST = 5  # words of an item: shorter ones are no evidence

_WORDS = separators_but(lambda b: chr(b).isalnum())
_SENTENCE = re.compile(r"[.!?\n]+")


def _hashes_of(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for t in chunks(pa.array(texts, pa.string()), _WORDS, lower="latin"):
        h = Hashes(t.data).of(t.start, t.end)
        cuts = np.searchsorted(t.doc, np.arange(t.n + 1))
        out.extend(h[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
    return out


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    answer: np.ndarray
    masks: dict[int, int]
    answer_masks: dict[int, int]


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, h in enumerate(words.tolist()):
        out[h] = out.get(h, 0) | 1 << k
    return out


def _items(rows: list[tuple[int, str]]) -> list[Item]:
    """Items with their words and answer: the last sentence of three words or more, else the last five words."""
    answers = []
    for _, text in rows:
        parts = [p for p in _SENTENCE.split(text) if len(p.split()) >= 3]
        answers.append(parts[-1] if parts else " ".join(text.split()[-5:]))
    words, short = _hashes_of([t for _, t in rows]), _hashes_of(answers)
    return [Item(i, w, a, _masks(w), _masks(a)) for (i, _), w, a in zip(rows, words, short, strict=True) if len(w) >= SHORTEST]


def common_subsequence(masks: dict[int, int], n: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a sequence of n words, given as bit masks, and ``words``."""
    full = (1 << n) - 1
    v = full
    for h in words:
        if m := masks.get(h):
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


class Terms:
    """The slot of every term of the items: its place among them, folded at TERMS."""

    def __init__(self, items: list[Item]):
        self.known = np.unique(np.concatenate([i.words for i in items])) if items else np.zeros(0, np.uint64)
        self.n = min(TERMS, max(1, len(self.known)))
        self._seen = np.zeros(1 << 22, bool)
        self._seen[(self.known >> np.uint64(42)).astype(np.int64)] = True

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """-1 for words that no item has."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self._seen[(hashes >> np.uint64(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.known, hashes[at]), max(len(self.known) - 1, 0))
        hit = self.known[place] == hashes[at] if len(self.known) else np.zeros(0, bool)
        out[at[hit]] = place[hit] % self.n
        return out


def _blocks(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block of each word, numbered over the chunk; the text and the first word of each block."""
    first_word = np.searchsorted(t.doc, np.arange(t.n))
    inside = (np.arange(len(t.doc)) - first_word[t.doc]) // BLOCK
    per = -(-t.per_doc() // BLOCK)
    base = np.cumsum(per) - per
    of_block = np.repeat(np.arange(t.n), per)
    return base[t.doc] + inside, of_block, first_word[of_block] + (np.arange(len(of_block)) - base[of_block]) * BLOCK


def _sketch(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks with each term, the signed sketch of term counts (SKETCH, terms), and the number of blocks."""
    n = terms.n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, blocks = np.zeros(n, np.int64), np.zeros(SKETCH * n, np.int64), 0
        for b in batches:
            for t in chunks(b.column("text"), _WORDS, lower="latin"):
                if not len(t.start):
                    continue
                hashes = Hashes(t.data).of(t.start, t.end)
                block, of_block, first = _blocks(t)
                blocks += len(of_block)
                slot = terms.slots(hashes)
                use = slot >= 0
                pair, times = np.unique(block[use] * n + slot[use], return_counts=True)
                random = mix(hashes[first] ^ mix(first.astype(np.uint64) - np.searchsorted(t.doc, of_block).astype(np.uint64)))
                row, sign = (random % np.uint64(SKETCH)).astype(np.int64), 1 - 2 * (random >> np.uint64(63)).astype(np.int64)
                held += np.bincount(pair % n, minlength=n)
                at = pair // n
                np.add.at(sums, row[at] * n + pair % n, sign[at] * times)
        at = np.flatnonzero(sums)
        key = np.concatenate(([-1], -2 - np.flatnonzero(held), at))
        value = np.concatenate(([blocks], held[held > 0], sums[at]))
        for lo in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + (1 << 16)]), pa.array(value[lo : lo + (1 << 16)])], names=["key", "value"])

    got = collected(docs.select("text").mapInArrow(work, "key long, value long").groupBy("key").agg(F.sum("value").alias("value")))
    key, value = got["key"], got["value"]
    held, sums = np.zeros(n, np.int64), np.zeros(SKETCH * n, np.int64)
    held[-2 - key[key < -1]] = value[key < -1]
    sums[key[key >= 0]] = value[key >= 0]
    return held, sums.reshape(SKETCH, n), int(value[key == -1].sum())


def latent_space(items: list[Item], terms: Terms, held: np.ndarray, sketch: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Term vectors (terms, RANK), scaled by IDF, and the items' unit vectors in the latent space."""
    idf = np.log((blocks + 1) / (held + 1)) + 0.1
    rows = np.zeros((len(items), terms.n), np.float32)
    for k, item in enumerate(items):
        np.add.at(rows[k], terms.slots(item.words), 1)
    rows *= idf
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    corpus = sketch * idf
    corpus *= np.linalg.norm(rows) / max(np.linalg.norm(corpus), 1e-9)  # items and corpus weigh alike
    stacked = np.concatenate((rows, corpus.astype(np.float32)))
    values, vectors = np.linalg.eigh((stacked @ stacked.T).astype(np.float64))
    top = np.argsort(-values)[:RANK]
    top = top[values[top] > 1e-9 * max(values[top].max(initial=0.0), 1e-9)]
    space = (stacked.T @ (vectors[:, top] / np.sqrt(values[top]))).astype(np.float32)
    query = rows @ space
    query /= np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-9)
    return space * idf[:, None].astype(np.float32), query.astype(np.float32)


def _search(t: Texts, items: list[Item], terms: Terms, space: np.ndarray, query: np.ndarray, by_reach: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple[float, float, float]]:
    """Leaks of a chunk: (text, item) to cosine, share of the item's words in order, share of its answer's."""
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(t.start):
        return found
    hashes = Hashes(t.data).of(t.start, t.end)
    block, of_block, first = _blocks(t)
    slot = terms.slots(hashes)
    use = np.flatnonzero(slot >= 0)
    running = np.zeros((len(of_block) + 1, space.shape[1]), np.float32)
    for lo in range(0, len(use), 1 << 14):
        u = use[lo : lo + (1 << 14)]
        edges = np.flatnonzero(np.concatenate(([True], block[u][1:] != block[u][:-1])))
        np.add.at(running, block[u][edges] + 1, np.add.reduceat(space[slot[u]], edges, axis=0))
    per_block = running[1:].copy()
    word_end = np.concatenate((np.searchsorted(t.doc, np.arange(t.n)), [len(t.doc)]))
    last_block = np.searchsorted(of_block, of_block, side="right")
    for reach, members in by_reach.items():
        passage = per_block.copy()
        for k in range(1, reach):
            same = of_block[k:] == of_block[:-k] if k < len(of_block) else np.zeros(0, bool)
            passage[: len(same)][same] += per_block[k:][same]
        passage /= np.maximum(np.linalg.norm(passage, axis=1, keepdims=True), 1e-9)
        cosine = passage @ query[members].T
        for p, m in zip(*np.nonzero(cosine >= COSINE), strict=True):
            c, text = cosine[p, m], of_block[p]
            # The words read reach one block further on either side, so of neighbours the likelier one will do.
            if (p > 0 and of_block[p - 1] == text and cosine[p - 1, m] > c) or (p + 1 < len(of_block) and of_block[p + 1] == text and cosine[p + 1, m] >= c):
                continue
            item, text = items[members[m]], int(text)
            a = max(int(first[p]) - BLOCK, int(word_end[text]))
            z = min(int(first[min(p + reach, last_block[p]) - 1]) + 2 * BLOCK, int(word_end[text + 1]))
            words = hashes[a:z][slot[a:z] >= 0].tolist()
            share = common_subsequence(item.masks, len(item.words), words) / len(item.words)
            if share < PARAPHRASE:
                continue
            answer = common_subsequence(item.answer_masks, len(item.answer), words) / max(len(item.answer), 1)
            if share >= LEAK or answer >= ANSWER:
                key = (text, int(members[m]))
                found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (float(share), float(answer), float(cosine[p, m])))
    return found


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share and cosine of every document that holds an item or its paraphrase.

    A leak has ``LEAK`` of the item's words in order in one passage, or ``PARAPHRASE`` of them and ``ANSWER`` of the
    answer's (the item's last sentence). Words are letters and digits, lower-cased in Latin-1. Items under ``SHORTEST``
    words and null texts leak nothing; an empty benchmark gives no row. Repeated documents and items give a row each
    time. Other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(id_column(docs, "doc_id").alias("doc_id"), text_column(docs, "text").alias("text"))
    asked = cut_lineage(benchmark.select(id_column(benchmark, "item_id").alias("item_id"), text_column(benchmark, "text").alias("text")).where(F.col("text").isNotNull()))
    groups = -(-asked.count() // ITEMS)
    schema = "doc_id long, item_id long, lcs_share double, answer_share double, cosine double"
    every = None
    for g in range(groups):
        members = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id", "text")
        items = _items([(r["item_id"], r["text"]) for r in members.collect()])  # about ITEMS rows
        if not items:
            continue
        terms = Terms(items)
        space, query = latent_space(items, terms, *_sketch(base, terms))
        reach = np.array([-(-(len(i.words) - 1) // BLOCK) + 1 for i in items])
        by_reach = {int(k): np.flatnonzero(reach == k) for k in np.unique(reach)}
        sent = spark.sparkContext.broadcast((items, terms, space, query, by_reach))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, terms, space, query, by_reach = sent.value
            for b in batches:
                ids, rows = b.column("doc_id"), []
                for t in chunks(b.column("text"), _WORDS, lower="latin", size=1 << 18):
                    for (text, k), (share, answer, cosine) in _search(t, items, terms, space, query, by_reach).items():
                        rows.append((ids[t.first + text].as_py(), items[k].item_id, share, answer, cosine))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "lcs_share", "answer_share", "cosine"])

        part = base.mapInArrow(work, schema)
        every = part if every is None else every.unionByName(part)
    return spark.createDataFrame([], schema) if every is None else every
