"""Toxicity: noisy-channel restoring of disguised words, then a linear model on original and restored text.

A token that may be disguised (leetspeak, letters set apart by spaces or marks, stretched letters) becomes a lattice
of the letters it can stand for. A Viterbi search with the last four bytes as state finds the likeliest reading under
a character language model, whose counts come from the words of the whole corpus. Words and word beginnings of the
text and of its restored tokens are scored by a logistic model that is learnt from labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotally.llm import text_model as M
from biotally.llm.words import _BASE, _LETTER, _LOWER, Hashes, Texts, chunks, collected, id_column, separators_but, text_column

ORDER = 5  # bytes to a gram of the language model
GRAMS = 1 << 20  # counters of the hashed grams
PREFIXES = (3, 4, 5, 6, 7)
RIDGE = 0.1
PLAUSIBLE = -3.4  # least mean log probability of a byte of a restored reading

# What marks and digits can stand for, and what each change of the channel costs (log probability).
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c"}
APART = " .-_*~'"
SWAP, DROP, BREAK, STRETCH, KEEP = -1.0, -0.4, -3.0, -0.5, -8.0

_MASK = (1 << 64) - 1
_IS_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_IS_LEET = np.array([chr(b) in LEET for b in range(256)])
_IS_APART = np.array([chr(b) in APART and b != 32 for b in range(256)])
_WORDS = separators_but(lambda b: 97 <= b <= 122 or 48 <= b <= 57)


def _gram_slot(gram: bytes) -> int:
    """The counter of a gram: the same value as ``Hashes`` gives."""
    x, power = 0, 1
    for b in gram:
        x = (x + int(_LETTER[b]) * power) & _MASK
        power = power * _BASE & _MASK
    x = (x + len(gram) * 0xD6E8FEB86659FD93) & _MASK
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & _MASK
    return (x ^ x >> 31) >> 44


def _packed(t: Texts, which: np.ndarray) -> np.ndarray:
    """The bytes of the given words with a space before each and after the last."""
    start, n = t.start[which], t.end[which] - t.start[which]
    to = np.cumsum(n + 1) - n
    out = np.full(int((n + 1).sum()) + 1, 32, np.uint8)
    shift = np.repeat(to - start, n)
    source = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    out[source + shift] = t.data[source]
    return out


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of the grams of up to ORDER bytes in the words of all texts; a word counts once in a chunk of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)
        for b in batches:
            for t in chunks(b.column("text"), _WORDS, lower="latin"):
                if not len(t.start):
                    continue
                _, first = np.unique(Hashes(t.data).of(t.start, t.end), return_index=True)
                data = _packed(t, np.sort(first))
                hashes, gap = Hashes(data), data == 32
                spaces = np.concatenate(([0], np.cumsum(gap)))
                for k in range(1, ORDER + 1):
                    s = np.arange(len(data) - k + 1)
                    if k > 2:  # no space but at the ends
                        s = s[spaces[s + k - 1] == spaces[s + 1]]
                    total += np.bincount((hashes.of(s, s + k) >> np.uint64(44)).astype(np.int64), minlength=GRAMS)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["slot", "n"])

    found = collected(docs.select(text_column(docs, "text").alias("text")).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")))
    out = np.zeros(GRAMS, np.int64)
    out[found["slot"]] = found["n"]
    return out


class Restorer:
    """Readings of disguised tokens under the language model."""

    def __init__(self, grams: np.ndarray):
        self._grams, self._total = grams, max(1, int(grams.sum()) // ORDER)
        self._slots: dict[bytes, int] = {}
        self._known: dict[bytes, bytes | None] = {}

    def _count(self, gram: bytes) -> int:
        n = self._slots.get(gram)
        if n is None:
            if len(self._slots) > 500_000:
                self._slots.clear()
            n = self._slots[gram] = int(self._grams[_gram_slot(gram)])
        return n

    def log_p(self, context: bytes, byte: bytes) -> float:
        """Backed-off log probability of a byte after up to four others; 0.4 for each order given up."""
        penalty = 0.0
        for k in range(min(len(context), ORDER - 1), 0, -1):
            c = context[-k:]
            below = self._count(c)
            n = self._count(c + byte) if below else 0
            if n:
                return penalty + math.log(min(1.0, n / below))
            penalty += math.log(0.4)
        return penalty + math.log((self._count(byte) + 0.5) / self._total)

    def _lattice(self, token: bytes) -> list[list[tuple[bytes, float]]]:
        units: list[list[tuple[bytes, float]]] = []
        i = 0
        while i < len(token):
            j = i + 1
            while j < len(token) and token[j] == token[i]:
                j += 1
            c, name = token[i : i + 1], chr(token[i])
            if _IS_LETTER[token[i]] and j - i > 2 and token[i] < 128:
                units.append([(c, STRETCH), (c * 2, STRETCH)])
            elif name in LEET:
                units.extend([[(x.encode(), SWAP) for x in LEET[name]] + [(c, KEEP)]] * (j - i))
            elif name in APART:
                units.append([(b"", DROP), (b" ", BREAK)])
            else:
                units.extend([[(c, 0.0)]] * (j - i))
            i = j
        return units

    def restore(self, token: bytes) -> bytes | None:
        """The likeliest reading of a token, or None where it has no plausible one or reads as it stands."""
        if token in self._known:
            return self._known[token]
        states: dict[bytes, tuple[float, int]] = {b" ": (0.0, 0)}
        back: list[tuple[int, bytes]] = [(0, b"")]
        for options in [*self._lattice(token), [(b" ", 0.0)]]:
            best: dict[bytes, tuple[float, int]] = {}
            made: dict[bytes, tuple[int, bytes]] = {}
            for state, (score, at) in states.items():
                for out, cost in options:
                    s, context = score + cost, state
                    for k in range(len(out)):
                        if context[-1:] == b" " and out[k : k + 1] == b" ":
                            continue
                        s += self.log_p(context, out[k : k + 1])
                        context = (context + out[k : k + 1])[-(ORDER - 1) :] if out[k : k + 1] != b" " else b" "
                    if context not in best or s > best[context][0]:
                        best[context], made[context] = (s, at), (at, out)
            states = {}
            for context, (s, _) in best.items():
                back.append(made[context])
                states[context] = (s, len(back) - 1)
        score, at = max(states.values())
        parts = []
        while at:
            at, out = back[at]
            parts.append(out)
        text = b"".join(reversed(parts)).strip()
        found = text if text != token and text and score / (len(text) + 1) >= PLAUSIBLE else None
        if len(self._known) > 200_000:
            self._known.clear()
        self._known[token] = found
        return found


def disguised(t: Texts) -> list[tuple[int, bytes]]:
    """(document of the chunk, token) of the tokens that may hide a word. ``t`` is lower-cased and split at white space."""
    d = t.data
    n = len(d)
    if not len(t.start):
        return []
    letter, inside = _IS_LETTER[d], t.inside
    at = lambda a, k: np.concatenate((a[k:], np.zeros(k, a.dtype)))
    first = np.zeros(n, bool)
    first[t.start] = True
    before = np.concatenate(([False], letter[:-1])) & ~first
    flag = _IS_LEET[d] & (before | first) & at(letter | _IS_LEET[d], 1) & at(inside & ~first, 1)
    same = at(d, 1) == d
    flag |= letter & (d < 128) & same & at(same, 1) & (at(inside & ~first, 1)) & at(inside & ~first, 2)
    flag |= letter & at(_IS_APART[d], 1) & at(letter, 2) & at(_IS_APART[d], 3)
    hits = np.unique(np.searchsorted(t.start, np.flatnonzero(flag), side="right") - 1)
    found = [(int(t.doc[w]), d[t.start[w] : t.end[w]].tobytes()) for w in hits[np.add.reduceat(letter, t.start)[hits] > 0]]
    # Runs of three or more one-letter words.
    single = (t.end - t.start == 1) & (d[t.start] < 128) & (letter[t.start] | _IS_LEET[d[t.start]])
    joined = single[1:] & single[:-1] & (t.doc[1:] == t.doc[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.astype(np.int8), [0]))))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a >= 2:
            found.append((int(t.doc[a]), b" ".join(d[t.start[w] : t.end[w]].tobytes() for w in range(a, b + 1))))
    return found


def _featuriser(restorer: Restorer) -> M.Featuriser:
    def featurise(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for white in chunks(text, lower="latin"):
            t = Texts(white.data, white.bounds, white.first, _WORDS)
            doc, found = M.word_features(t, Hashes(t.data), PREFIXES)
            read = [(k, r) for k, token in disguised(white) if (r := restorer.restore(token))]
            if read:
                owners = np.array([k for k, _ in read])
                flat = np.frombuffer(b"".join(r for _, r in read), np.uint8)
                bounds = np.concatenate(([0], np.cumsum([len(r) for _, r in read])))
                again = Texts(flat, bounds, 0, _WORDS)
                more_doc, more = M.word_features(again, Hashes(again.data), PREFIXES)
                doc, found = np.concatenate((doc, owners[more_doc])), np.concatenate((found, more))
            yield white.first, white.n, doc, found

    return featurise


def fit_logistic(y: np.ndarray, row: np.ndarray, col: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    n = len(y)
    share = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)

    def gradient(p: np.ndarray) -> np.ndarray:
        miss = M.sigmoid(np.bincount(row, p[1:][col], n) + p[0]) - y
        return np.concatenate(([miss.sum()], np.bincount(col, miss[row], n_features) + RIDGE * p[1:])) / max(n, 1)

    p = M.adam(gradient, np.concatenate(([math.log(share / (1 - share))], np.zeros(n_features))))
    return p[1:], float(p[0])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5), one row per input row.

    Learns from rows of ``labels`` (doc_id, toxic) with crc32(doc_id) mod 5 not 0; held_out marks the others. Texts
    are the only inputs of a score. Null and blank texts get the score of a text without features; without labels
    every score is 0.5. Repeated rows are scored alike; other columns are not read.
    """
    spark = docs.sparkSession
    base = docs.select(id_column(docs, "doc_id").alias("doc_id"), text_column(docs, "text").alias("text"))
    grams = spark.sparkContext.broadcast(gram_counts(docs))  # GRAMS counters, whatever the input
    per_task: dict[str, M.Featuriser] = {}

    def featurise(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        if "f" not in per_task:
            per_task["f"] = _featuriser(Restorer(grams.value))
        return per_task["f"](text)

    rows = M.labelled(base, labels, F.col("toxic"))
    counts, hits = M.presence(rows, featurise, 2)
    features = M.screen(counts, hits)
    y, row, col = M.design(rows, featurise, features)
    w, bias = fit_logistic(y, row, col, len(features)) if len(y) else (np.zeros(len(features)), 0.0)
    weights = np.zeros(M.BUCKETS, np.float32)
    weights[features] = w
    at = spark.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = M.sigmoid(M.linear_scores(b.column("text"), featurise, at.value) + bias)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    scored = base.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (~M.fit_row(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
