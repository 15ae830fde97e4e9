"""Column expressions over sequences: all JVM-side, none needs a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biotally.reference_tables import (
    AMINO_ACIDS,
    CODON_BASES,
    CODON_RESIDUES,
    COMPLEMENT_FROM,
    COMPLEMENT_TO,
    IUPAC_CLASSES,
    UNKNOWN_PAIR_SCORE,
    blosum62,
)

ALPHABETS = {"dna": "ACGT", "protein": AMINO_ACIDS, "iupac": "ACGTNRYKMSWBDHV", "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def number(text: Column) -> Column:
    """A decimal number of any length, with or without an exponent, as double; null for any other text."""
    return F.when(F.regexp_like(text, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), text.try_cast("double"))


def sanitize(seq: Column, alphabet: str) -> Column:
    """Keep the letters of the alphabet, upper-cased (dropped first: some letters change length under upper)."""
    letters = ALPHABETS[alphabet]
    return F.upper(F.regexp_replace(seq, f"[^{letters}{letters.lower()}]", ""))


def length_guard(seq: Column, low: int, high: int) -> Column:
    return F.length(seq).between(low, high)


def gc_content(seq: Column) -> Column:
    """Percent G and C, unrounded."""
    n = F.length(seq)
    return F.when(n > 0, F.length(F.regexp_replace(seq, "[^GC]", "")) * F.lit(100.0) / n).otherwise(F.lit(0.0))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def is_palindromic(seq: Column) -> Column:
    return seq == reverse_complement(seq)


def iupac_regex(pattern: str) -> str:
    """A recognition word as a regular expression of character classes."""
    return "".join(c if len(IUPAC_CLASSES[c]) == 1 and IUPAC_CLASSES[c] == c else f"[{IUPAC_CLASSES[c]}]" for c in pattern)


def iupac_regex_column(pattern: Column) -> Column:
    """The same for a column of recognition words."""
    out = pattern
    # First to private lower-case marks, so that letters inside a class are not replaced again.
    for code, letters in IUPAC_CLASSES.items():
        if letters != code:
            out = F.replace(out, F.lit(code), F.lit(f"[{letters.lower()}]"))
    return F.upper(out)


def overlapping_words(seq: Column, k: int) -> Column:
    """Every k-letter window in order, as an array: one linear regex pass (substr per position would be quadratic)."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


TILE = 1 << 16  # letters


def sequence_tiles(df: DataFrame, keep: tuple[str, ...], seq: Column, k: int, tile: int = TILE) -> DataFrame:
    """The columns ``keep`` with every tile of ``seq``, a row each: ``_tile`` and ``_text``, which has the first k - 1 letters of the next tile too."""
    pieces = df.select(*keep, F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{tile}}}"), F.lit(0)).alias("_pieces"))
    lapped = F.transform("_pieces", lambda t, i: F.concat(t, F.coalesce(F.substring(F.get("_pieces", i + 1), 1, k - 1), F.lit(""))))
    return pieces.select(*keep, F.posexplode(lapped).alias("_tile", "_text"))


def tile_words(tiles: DataFrame, keep: tuple[str, ...], k: int, pos: str = "i", word: str = "w", tile: int = TILE, ending: str = "") -> DataFrame:
    """The columns ``keep`` with every k-letter window of `sequence_tiles` and its 0-based position in the whole sequence."""
    found = F.regexp_extract_all("_text", F.lit(f"(?=(.{{{k - len(ending)}}}{ending}|.))"), F.lit(1)) if ending else overlapping_words(F.col("_text"), k)
    columns = [c for c in keep if c != "_tile"]
    rows = tiles.select(*columns, "_tile", F.posexplode(found).alias("_at", word))
    if ending:
        rows = rows.where(F.length(word) == k)
    return rows.select(*keep, (F.col("_tile") * tile + F.col("_at")).alias(pos), word)


def words_at(df: DataFrame, keep: tuple[str, ...], seq: Column, k: int, pos: str = "i", word: str = "w", tile: int = TILE, ending: str = "") -> DataFrame:
    """The columns ``keep`` with every k-letter window of ``seq`` and its 0-based position, a row each.

    A text is cut into tiles, each with the first k - 1 letters of the next, so that the windows of a tile are the
    longest array there is, however long the text. With an ``ending`` only windows that end with it are given; all
    other positions cost one letter.
    """
    return tile_words(sequence_tiles(df, keep, seq, k, tile), keep, k, pos, word, tile, ending)


def codons(seq: Column) -> Column:
    return F.regexp_extract_all(seq, F.lit("(...)"), F.lit(1))


def codon_residue(codon: Column) -> Column:
    """Codon to residue by position in the genetic-code string; unknown letters give X."""
    idx = [F.instr(F.lit(CODON_BASES), F.substring(codon, i, 1)) - 1 for i in (1, 2, 3)]
    known = (idx[0] >= 0) & (idx[1] >= 0) & (idx[2] >= 0)
    return F.when(known, F.substring(F.lit(CODON_RESIDUES), idx[0] * 16 + idx[1] * 4 + idx[2] + 1, F.lit(1))).otherwise(F.lit("X"))


def translate_codons(seq: Column) -> Column:
    return F.array_join(F.transform(codons(seq), codon_residue), "")


def letter_table(values: dict[str, float], default: float = 0.0) -> Column:
    """A 26-slot array literal, so that a residue lookup is one indexed read."""
    return F.array(*[F.lit(float(values.get(chr(65 + i), default))) for i in range(26)])


def letter_value(letter: Column, values: dict[str, float], default: float = 0.0) -> Column:
    return F.coalesce(F.get(letter_table(values, default), F.ascii(letter) - 65), F.lit(float(default)))


def substitution_score(a: Column, b: Column, alphabet: str = "protein") -> Column:
    """Substitution score of two residues: a flat 26x26 table read by index, default for unknown pairs."""
    if alphabet == "dna":
        return F.when(a == b, F.lit(2)).otherwise(F.lit(-1))
    scores = blosum62()
    flat = F.array(*[F.lit(scores.get((chr(65 + i), chr(65 + j)), UNKNOWN_PAIR_SCORE)) for i in range(26) for j in range(26)])
    ia, ib = F.ascii(a) - 65, F.ascii(b) - 65
    return F.when(ia.between(0, 25) & ib.between(0, 25), F.element_at(flat, ia * 26 + ib + 1)).otherwise(F.lit(UNKNOWN_PAIR_SCORE))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing positions of two equally long words."""
    left, right = F.split(a, ""), F.split(b, "")
    return F.aggregate(F.zip_with(left, right, lambda x, y: (x != y).cast("int")), F.lit(0), lambda acc, d: acc + d)


def round_half_up(x: Column) -> Column:
    """floor(x + 0.5): halves go up, also for negative numbers."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
