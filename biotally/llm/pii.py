"""Personal data: fixed patterns, then a skip-chain conditional random field over each document.

Nodes of the field are the spans that the patterns find, whose labels are given, and all other pieces of a text that
hold a digit or an @. Neighbouring nodes share a transition potential. Nodes that repeat a token or look alike (the
same last seven digits, the local part of an address) share a skip potential, wherever in the document they stand:
each is tied to the next of its key and to the first pattern span of its key, so links grow linearly. Loopy message
passing then carries the patterns' labels to the pieces that the patterns miss. Potentials are log ratios of counts
over the whole corpus; as the patterns say nothing against a piece, the node potentials of free pieces are clipped.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biotally.llm.words import id_column, text_column

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1  # 0: none
CLIP = 1.0  # most that a free piece's own shape can speak against a kind
SKIP_LEAST, SKIP_MOST = 3.0, 5.0
ROUNDS, DAMPING, SETTLED = 30, 0.3, 1e-4
TAIL = 7  # last digits that two numbers share to be alike
LONGEST = 19  # digits of a number written in groups
NEAR = 2  # most characters between neighbouring nodes

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_GAP = re.compile(r"[\x20\x09-\x0D]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NUMBER = re.compile(r"[+(]?[0-9][0-9().-]*+")
_EDGE = "()[]{}<>.,;:!?\"'`|#*$%&=~^/\\"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind, in order."""
    found: list[tuple[int, int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if _SIGN.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an @, without the marks at their edges; numbers parted by one space are one piece."""
    pos, held = 0, None
    while m := _SIGN.search(text, pos):
        start = m.start()
        while start > pos and not _GAP.match(text[start - 1]):
            start -= 1
        g = _GAP.search(text, m.end())
        pos = g.start() if g else len(text)
        a, b = start, pos
        while a < b and text[a] in _EDGE and not (text[a] == "(" and ")" in text[a:b]):
            a += 1
        while b > a and text[b - 1] in _EDGE and not (text[b - 1] == ")" and "(" in text[a:b]):
            b -= 1
        if a == b:
            continue
        number = _NUMBER.fullmatch(text, a, b) is not None
        if held and number and held[2] and a - held[1] == 1 and sum("0" <= c <= "9" for c in text[held[0] : b]) <= LONGEST:
            held = (held[0], b, True)
            continue
        if held:
            yield held[:2]
        held = (a, b, number)
    if held:
        yield held[:2]


def _shape(piece: str) -> str:
    """A signature out of a bounded set: digits, letters, marks and ends of a piece."""
    digits = sum("0" <= c <= "9" for c in piece)
    letters = sum(c.isalpha() for c in piece)
    end = lambda c: "d" if "0" <= c <= "9" else "a" if c.isalpha() else c if c in "+(@" else "."
    return f"{min(digits, 24)} {min(letters, 9)} {min(piece.count('@'), 2)} {min(piece.count('.'), 4)} {min(piece.count('-'), 4)} {min(piece.count(' '), 3)} {end(piece[0])}{end(piece[-1])}"


def _keys(piece: str, kind: int) -> list[str]:
    """What makes two nodes of a document alike."""
    keys = []
    if len(piece) >= 5:
        keys.append("t" + piece.lower())
    if kind == 1:  # an address of a machine: its parts matter, not its last digits
        return keys
    if kind == 0 or "@" in piece:
        local = piece.split("@")[0].lower()
        if len(local) >= 5:
            keys.append("t" + local)
    elif not any(c.isalpha() for c in piece) and piece.count(".") < 3:
        digits = _NOT_DIGIT.sub("", piece)
        if len(digits) >= TAIL:
            keys.append("n" + digits[-TAIL:])
    return keys


class Field:
    """The nodes and links of one text."""

    def __init__(self, text: str):
        self.base = base_spans(text)
        nodes = [(s, e, k + 1) for s, k, e in self.base]
        taken, i = sorted((s, e) for s, _, e in self.base), 0
        reach = 0
        for a, b in _pieces(text) if self.base or _SIGN.search(text) else ():
            while i < len(taken) and taken[i][0] < b:
                reach = max(reach, taken[i][1])
                i += 1
            if reach <= a:
                nodes.append((a, b, 0))
        self.nodes = sorted(nodes)
        self.shapes = [_shape(text[a:b]) for a, b, _ in self.nodes]
        self.near = [k for k in range(len(self.nodes) - 1) if 0 <= self.nodes[k + 1][0] - self.nodes[k][1] <= NEAR]
        self.skips: list[tuple[int, int]] = []
        groups: dict[str, list[int]] = {}
        for k, (a, b, label) in enumerate(self.nodes):
            for key in _keys(text[a:b], label - 1):
                groups.setdefault(key, []).append(k)
        for members in groups.values():
            if len(members) > 1:
                self.skips.extend(zip(members, members[1:], strict=False))
                hub = next((k for k in members if self.nodes[k][2]), None)
                if hub is not None:
                    self.skips.extend((hub, k) for k in members if not self.nodes[k][2])
        self.skips = sorted({(min(p), max(p)) for p in self.skips if p[0] != p[1]})

    def counts(self) -> Counter:
        """Node, transition and skip events under the patterns' labels."""
        c: Counter = Counter()
        for (_, _, label), shape in zip(self.nodes, self.shapes, strict=True):
            c["u", shape, label] += 1
        for k in self.near:
            c["t", str(self.nodes[k][2]), self.nodes[k + 1][2]] += 1
        for a, b in self.skips:
            c["s", "", int(self.nodes[a][2] == self.nodes[b][2])] += 1
        return c


class Potentials:
    def __init__(self, counts: dict[tuple[str, str, int], int]):
        self._unary: dict[str, np.ndarray] = {}
        trans = np.ones((LABELS, LABELS))
        agree = [1, 1]
        for (what, name, label), n in counts.items():
            if what == "u":
                self._unary.setdefault(name, np.full(LABELS, 0.5))[label] += n
            elif what == "t":
                trans[int(name), label] += n
            else:
                agree[label] += n
        expected = trans.sum(1, keepdims=True) * trans.sum(0, keepdims=True) / trans.sum()
        self.near = np.clip(np.log(trans / expected), -CLIP / 2, CLIP / 2)
        self.skip = np.eye(LABELS) * min(SKIP_MOST, max(SKIP_LEAST, math.log(agree[1] / agree[0])))

    def node(self, shape: str, label: int) -> np.ndarray:
        if label:
            return np.where(np.arange(LABELS) == label, 0.0, -50.0)
        u = np.log(self._unary.get(shape, np.full(LABELS, 0.5)))
        return np.clip(u - u[0], -CLIP, 0.0)


def marginals(field: Field, potentials: Potentials) -> np.ndarray:
    """Label probabilities of all nodes by loopy sum-product message passing."""
    unary = np.array([potentials.node(s, n[2]) for n, s in zip(field.nodes, field.shapes, strict=True)])
    links = [(k, k + 1, potentials.near) for k in field.near] + [(a, b, potentials.skip) for a, b in field.skips]
    source = np.array([a for a, _, _ in links] + [b for _, b, _ in links])
    target = np.array([b for _, b, _ in links] + [a for a, _, _ in links])
    pots = np.array([p for _, _, p in links] + [p.T for _, _, p in links])
    back = np.concatenate((np.arange(len(links)) + len(links), np.arange(len(links))))
    sent = np.zeros((len(source), LABELS))
    belief = unary.copy()
    for _ in range(ROUNDS):
        out = (belief[source] - sent[back])[:, :, None] + pots
        top = out.max(axis=1, keepdims=True)
        new = np.log(np.exp(out - top).sum(axis=1)) + top[:, 0]
        new -= new.max(axis=1, keepdims=True)
        new = (1 - DAMPING) * new + DAMPING * sent
        moved = np.abs(new - sent).max()
        sent = new
        belief = unary.copy()
        np.add.at(belief, target, sent)
        if moved < SETTLED:
            break
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def all_spans(text: str, potentials: Potentials) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The pattern spans of a text, and these with the spans that the field adds; (start, kind, end) in order."""
    if "@" not in text and not _SIGN.search(text):
        return [], []
    field = Field(text)
    added = []
    if field.base and field.skips and any(not n[2] for n in field.nodes):
        p = marginals(field, potentials)
        for (a, b, label), row in zip(field.nodes, p, strict=True):
            kind = int(row.argmax())
            if not label and kind and row[kind] > 0.5:
                added.append((a, kind - 1, b))
    return field.base, sorted(field.base + added)


def learn(docs: DataFrame, text_col: str = "text") -> Potentials:
    """Potentials from the counts of all texts; what reaches the driver is bounded by the number of shapes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for t in b.column("text"):
                if (text := t.as_py()) and _SIGN.search(text):
                    total.update(Field(text).counts())
        what, name, label = zip(*total, strict=True) if total else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(what, pa.string()), pa.array(name, pa.string()), pa.array(label, pa.int32()), pa.array(list(total.values()), pa.int64())], names=["what", "name", "label", "n"])

    rows = docs.select(text_column(docs, text_col).alias("text")).mapInArrow(count, "what string, name string, label int, n long").groupBy("what", "name", "label").agg(F.sum("n").alias("n")).collect()
    return Potentials({(r["what"], r["name"], r["label"]): r["n"] for r in sorted(rows)})


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(docs: DataFrame, potentials: Potentials | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the pattern spans, spans (all) and n_added, per row.

    Offsets are code points, ends exclusive. Null text is empty; repeated rows are marked alike; a span of the field
    never overlaps a pattern span. Other columns are not read.
    """
    base = docs.select(id_column(docs, "doc_id").alias("doc_id"), text_column(docs, "text").alias("text"))
    fitted = potentials or learn(base)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            shas, spans, added = [], [], []
            for t in b.column("text"):
                found, every = all_spans(t.as_py() or "", fitted)
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[1] == k for s in found))
                shas.append(hashlib.sha256(_joined(found).encode()).hexdigest())
                spans.append(_joined(every))
                added.append(len(every) - len(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return base.mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every maximal stretch of spans becomes the tag of its first kind."""
    out, at = [], 0
    k = 0
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in its text replaced by tags; other columns, null texts and repeated rows stay."""
    fitted = learn(docs, text_col)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if (t := x.as_py()) is None else redact_text(t, all_spans(t, fitted)[1]) for x in b.column(text_col)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names], names=names)

    return docs.mapInArrow(work, docs.schema)
