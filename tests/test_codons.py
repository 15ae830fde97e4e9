"""Codon swapping against a plain version."""

import random

from biotally.operators import codons
from biotally.reference_tables import CODON_BASES, CODON_RESIDUES


def plain_swap(seq, best):
    residues = dict(zip((a + b + c for a in CODON_BASES for b in CODON_BASES for c in CODON_BASES), CODON_RESIDUES, strict=True))
    return "".join(best.get(residues.get(seq[k : k + 3]), seq[k : k + 3]) for k in range(0, len(seq) // 3 * 3, 3))


def test_swap_is_that_of_a_codon_at_a_time(spark):
    r = random.Random(6)
    rows = [(k, "ab"[k % 2], "".join(r.choice("ACGT" if k % 5 else "ACGTNé") for _ in range(r.randint(0, 300)))) for k in range(40)]
    used = spark.createDataFrame([x for x in rows if x[0] % 5], "id long, species string, seq string")
    usage = codons.codon_usage(used)
    best = {}
    for x in codons.preferred_codon(usage).collect():
        best.setdefault(x.species, {})[x.aa] = x.codon
    more = [*rows, (90, "unknown", "ACGTTT"), (91, "a", None), (92, "b", ""), (93, None, "TTTT")]
    got = {x.id: x.adapted for x in codons.swap_codons(spark.createDataFrame(more, "id long, species string, seq string"), usage).collect()}
    for k, species, seq in more:
        want = None if seq is None else plain_swap(seq, best.get(species, {}))
        assert got[k] == (want if want is None else want.replace("é", "?"))
