"""Scales, rules, rates and profiles that results depend on, plus helpers that turn them into tables.

Every table here has a small, fixed size, so broadcasting it is bounded by construction.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- alphabets (fixed values)
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
COMPLEMENT_FROM = "ACGTUNRYKMSWBVDH"
COMPLEMENT_TO = "TGCAANYRMKSWVBHD"
IUPAC_CLASSES = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
# Standard genetic code, codons in TCAG order (first, second, third base).
CODON_BASES = "TCAG"
CODON_RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS = ("ATG", "GTG", "TTG")
STOPS = ("TAA", "TAG", "TGA")

# ---------------------------------------------------------------- residue scales (fixed values)
HOPP_WOODS = {
    "A": -0.5, "R": 3.0, "N": 0.2, "D": 3.0, "C": -1.0, "Q": 0.2, "E": 3.0, "G": 0.0, "H": -0.5, "I": -1.8,
    "L": -1.8, "K": 3.0, "M": -1.3, "F": -2.5, "P": 0.0, "S": 0.3, "T": -0.4, "W": -3.4, "Y": -2.3, "V": -1.5,
}
KARPLUS_SCHULZ = {
    "A": 0.984, "R": 1.008, "N": 1.048, "D": 1.068, "C": 0.906, "Q": 1.037, "E": 1.094, "G": 1.031, "H": 0.950, "I": 0.927,
    "L": 0.935, "K": 1.102, "M": 0.952, "F": 0.915, "P": 1.049, "S": 1.046, "T": 0.997, "W": 0.904, "Y": 0.929, "V": 0.931,
}
EMINI = {
    "A": 0.301, "R": 0.486, "N": 0.504, "D": 0.524, "C": 0.269, "Q": 0.353, "E": 0.475, "G": 0.349, "H": 0.322, "I": 0.238,
    "L": 0.236, "K": 0.518, "M": 0.221, "F": 0.214, "P": 0.525, "S": 0.409, "T": 0.373, "W": 0.213, "Y": 0.295, "V": 0.244,
}
CHOU_FASMAN_TURN = {
    "A": 0.066, "R": 0.095, "N": 0.463, "D": 0.466, "C": 0.295, "Q": 0.981, "E": 0.743, "G": 0.756, "H": 0.524, "I": 0.034,
    "L": 0.061, "K": 0.055, "M": 0.052, "F": 0.069, "P": 0.612, "S": 0.143, "T": 0.096, "W": 0.010, "Y": 0.114, "V": 0.005,
}
SCALES = {"hydro": HOPP_WOODS, "flex": KARPLUS_SCHULZ, "surf": EMINI, "turn": CHOU_FASMAN_TURN}
COMPOSITE_WEIGHTS = {"hydro": 0.30, "flex": 0.20, "surf": 0.30, "turn": 0.20}
ANTIGENIC_RESIDUES = "RKDESNQPY"
ANCHOR_P2 = {"L": 1.0, "M": 0.9, "I": 0.7, "V": 0.6, "A": 0.3}
ANCHOR_P9 = {"V": 1.0, "L": 0.9, "I": 0.8, "A": 0.5}
KNOWN_BINDERS = ("FLPSDFFPS", "YLQPRTFLL", "GILGFVFTL", "NLVPMVATV", "KVLEYVIKV", "RMFPNAPYL", "IMDQVPFSV", "SLLPAIVEL")

# BLOSUM62 (Henikoff & Henikoff 1992), lower triangle, residues in the published order.
BLOSUM_ORDER = "ARNDCQEGHILKMFPSTWYV"
BLOSUM_LOWER = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
"""
UNKNOWN_PAIR_SCORE = -4
DNA_MATCH, DNA_MISMATCH, GAP = 2, -1, -8


def blosum62() -> dict[tuple[str, str], int]:
    scores = {}
    for i, line in enumerate(BLOSUM_LOWER.strip().splitlines()):
        for j, v in enumerate(line.split()):
            scores[BLOSUM_ORDER[i], BLOSUM_ORDER[j]] = scores[BLOSUM_ORDER[j], BLOSUM_ORDER[i]] = int(v)
    return scores


# ---------------------------------------------------------------- nucleic-acid thermodynamics (SantaLucia 1998, fixed values)
STACK_DH = {
    "AA": -7.9, "AT": -7.2, "AC": -8.4, "AG": -7.8, "TA": -7.2, "TT": -7.9, "TC": -8.2, "TG": -8.5,
    "CA": -8.5, "CT": -7.8, "CC": -8.0, "CG": -10.6, "GA": -8.2, "GT": -8.4, "GC": -9.8, "GG": -8.0,
}
STACK_DS = {
    "AA": -22.2, "AT": -20.4, "AC": -22.4, "AG": -21.0, "TA": -21.3, "TT": -22.2, "TC": -22.2, "TG": -22.7,
    "CA": -22.7, "CT": -21.0, "CC": -19.9, "CG": -27.2, "GA": -22.2, "GT": -22.4, "GC": -24.4, "GG": -19.9,
}
INIT_GC_DH, INIT_AT_DH, INIT_GC_DS, INIT_AT_DS, SYMMETRY_DS = 0.1, 2.3, -2.8, 4.1, -1.4
GAS_CONSTANT, STRAND_CONC, SODIUM = 1.987, 250e-9, 0.05

# ---------------------------------------------------------------- guide scoring (fixed values)
GUIDE_WEIGHTS = (0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 1.0, 1.0, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.3, 0.2, 0.1, 0.1)
GUIDE_PREFERRED = {1: "G", 3: "AG", 19: "AT", 20: "AC"}

# ---------------------------------------------------------------- restriction enzymes (fixed values)
# name, recognition, cut on top strand, cut on bottom strand, cut type, palindromic
ENZYMES = (
    ("EcoRV", "GATATC", 3, 3, "blunt", True), ("SmaI", "CCCGGG", 3, 3, "blunt", True), ("HincII", "GTYRAC", 4, 4, "blunt", True),
    ("PvuII", "CAGCTG", 3, 3, "blunt", True), ("AluI", "AGCT", 2, 2, "blunt", True), ("HaeIII", "GGCC", 2, 2, "blunt", True),
    ("EcoRI", "GAATTC", 1, 5, "5-overhang", True), ("BamHI", "GGATCC", 1, 5, "5-overhang", True),
    ("BglII", "AGATCT", 1, 5, "5-overhang", True), ("HindIII", "AAGCTT", 1, 5, "5-overhang", True),
    ("NdeI", "CATATG", 2, 4, "5-overhang", True), ("XbaI", "TCTAGA", 1, 5, "5-overhang", True),
    ("SalI", "GTCGAC", 1, 5, "5-overhang", True), ("XhoI", "CTCGAG", 1, 5, "5-overhang", True),
    ("KpnI", "GGTACC", 5, 1, "3-overhang", True), ("PstI", "CTGCAG", 5, 1, "3-overhang", True),
    ("SphI", "GCATGC", 5, 1, "3-overhang", True), ("TaqI", "TCGA", 1, 3, "5-overhang", True),
    ("MboI", "GATC", 0, 4, "5-overhang", True), ("DpnI", "GATC", 0, 0, "blunt", True), ("HhaI", "GCGC", 3, 1, "3-overhang", True),
    ("HpaII", "CCGG", 1, 3, "5-overhang", True), ("NotI", "GCGGCCGC", 2, 6, "5-overhang", True),
    ("SfiI", "GGCCNNNNNGGCC", 4, 8, "3-overhang", False), ("AscI", "GGCGCGCC", 2, 6, "5-overhang", True),
    ("HinfI", "GANTC", 1, 4, "5-overhang", False), ("DdeI", "CTNAG", 1, 4, "5-overhang", False), ("RsaI", "GTAC", 2, 2, "blunt", False),
)
CLONING_SITES = ("GAATTC", "GGATCC", "AAGCTT", "GTCGAC", "CCCGGG", "CTGCAG", "CATATG", "GATATC", "TCTAGA")

# ---------------------------------------------------------------- codon species names (fixed values)
SPECIES_ALIASES = {
    "pig": "Sus scrofa", "swine": "Sus scrofa", "cattle": "Bos taurus", "cow": "Bos taurus", "chicken": "Gallus gallus",
    "ecoli": "E. coli", "E. coli": "E. coli", "sheep": "Ovis aries", "goat": "Capra hircus", "horse": "Equus caballus",
    "dog": "Canis familiaris", "salmon": "Salmo salar",
}
DEFAULT_SPECIES = "E. coli"
REVERSE_CODONS = {
    "A": "GCT", "R": "CGT", "N": "AAT", "D": "GAT", "C": "TGT", "Q": "CAG", "E": "GAG", "G": "GGT", "H": "CAT", "I": "ATC",
    "L": "CTT", "K": "AAA", "M": "ATG", "F": "TTT", "P": "CCT", "S": "TCT", "T": "ACT", "W": "TGG", "Y": "TAT", "V": "GTT", "*": "TAA",
}
UNKNOWN_CODON_FRACTION = 0.05
LINKER, SIGNAL_PEPTIDE, HIS_TAG = "GPGPG", "MDAMKRGLCCVLLLCGAVFVSPSAS", "HHHHHH"

# ---------------------------------------------------------------- resistance rules (fixed values)
# class, gene, reference position, wild type, mutants, residues before, residues after, confidence
CONTEXT_RULES = (
    ("Фторхинолоны", "gyrA", 83, "S", "LWAF", "VM", "DG", 90),
    ("Фторхинолоны", "gyrA", 87, "D", "NGYA", "IY", "AL", 85),
    ("Рифамицины", "rpoB", 526, "H", "YDLR", "KRP", "LDV", 95),
    ("Рифамицины", "rpoB", 531, "S", "LWF", "TSA", "FLE", 95),
    ("β-лактамы", "pbp2x", 338, "T", "AGS", "SNT", "FKG", 80),
    ("Макролиды", "23S rRNA", 2058, "A", "GCU", "GCG", "GCG", 88),
    ("Тетрациклины", "16S rRNA", 965, "G", "AU", "UACAC", "UGG", 75),
    ("Аминогликозиды", "16S rRNA", 1401, "C", "TAG", "GCGG", "ACAG", 85),
    ("Сульфаниламиды", "folP", 28, "P", "ASL", "IYR", "PVA", 78),
)
# pattern (IUPAC), gene, class, confidence
MOTIF_RULES = (
    ("RTGCAGYCTGAA", "blaTEM-1", "β-лактамы", 92), ("CGTACGGTTGGCGA", "blaSHV-1", "β-лактамы", 90),
    ("AAGCAACGCGTGGC", "blaCTX-M", "β-лактамы", 95), ("GGCACCGCCATC", "tetM", "Тетрациклины", 85),
    ("GACAAGCCGTACGA", "ermB", "Макролиды", 92), ("AACGACATCCGCGT", "aac(3)-IV", "Аминогликозиды", 88),
    ("TGGCGCGAACGCAT", "qnrA", "Фторхинолоны", 87),
)
# A short panel of our own that occurs in the driver tables, so hits, misses and repeated hits all appear.
SCREEN_MOTIFS = (
    ("RTGCAGY", "motif-R1", "class-a", 92), ("GGCACC", "motif-R2", "class-b", 85), ("TGGCGC", "motif-R3", "class-c", 87),
    ("CGTACGG", "motif-R4", "class-a", 90), ("AACGAC", "motif-R5", "class-d", 88),
)
GROUP_CLASSES = {
    "Фторхинолон": "Фторхинолоны", "Тетрациклин": "Тетрациклины", "Макролид": "Макролиды", "Макролид (15-чл)": "Макролиды",
    "Макролид (16-чл)": "Макролиды", "Аминогликозид": "Аминогликозиды", "Сульфаниламид": "Сульфаниламиды",
    "Антибиотик-пенициллин": "β-лактамы", "Антибиотик-цефалоспорин": "β-лактамы",
    "Антибиотик-цефалоспорин 3 пок.": "β-лактамы", "Антибиотик-цефалоспорин 4 пок.": "β-лактамы",
}

# ---------------------------------------------------------------- outbreak rules (fixed values)
PATHOGEN_RULES = (
    ("ASFV (African swine fever virus)", r"asfv|african.*swine|asf\s*p"),
    ("FMDV (Foot-and-mouth disease virus)", r"fmdv|foot.*mouth|fmd"),
    ("HPAI (Avian influenza)", r"hpai|avian.*flu|h5n1|h5n8|influenza.*a"),
    ("CSFV (Classical swine fever)", r"csfv|classical.*swine"),
    ("PPRV (Peste des petits ruminants)", r"ppr|peste.*petits"),
    ("Rabies virus", r"rabies|lyssavirus"),
    ("Brucella", r"brucella"),
    ("E. coli", r"e\.?\s*coli|escherichia"),
    ("Salmonella", r"salmonella"),
)
CLOCK_RATES = (
    ("ASFV p72", "African Swine Fever Virus", 1e-5), ("ASFV p54", "African Swine Fever Virus", 2e-5),
    ("Influenza HA", "Influenza A virus", 3e-3), ("Influenza NA", "Influenza A virus", 2.5e-3),
    ("Rabies N", "Rabies virus", 2e-4), ("Rabies G", "Rabies virus", 3e-4), ("FMDV VP1", "Foot-and-Mouth Disease Virus", 1.5e-3),
    ("BVDV E2", "Bovine Viral Diarrhea Virus", 1e-3), ("Brucella omp2b", "Brucella spp.", 1e-7), ("E. coli 16S rRNA", "E. coli", 1e-8),
    ("mtDNA cyt b", "Vertebrate mitochondria", 2e-8), ("mtDNA COI", "Vertebrate mitochondria", 1.5e-8),
)
DEFAULT_CLOCK_RATE = 1e-3
# ordered routing rules: priority, column, pattern, route
ROUTE_RULES = (
    (1, "title", "virus|viral", "Vaccine Designer"), (2, "organism", "virus", "Vaccine Designer"),
    (3, "title", "resistance|beta-lactamase|tem|ctx-m|ndm", "AMR Detector"), (4, "title", "plasmid|replicon|origin", "Plasmid Mapper"),
    (5, "organism", "bacter|escherichia|salmonella|streptococcus", "AMR + Phylogeny"),
)
DEFAULT_ROUTE, NO_HIT_ROUTE = "Epitope Prediction", "Alignment"

# ---------------------------------------------------------------- dose rates (fixed values)
# drug, species, mg/kg, route, interval hours, days
DOSE_RATES = (
    ("enrofloxacin", "Свинья", 2.5, "IM", 24, 3), ("oxytetracycline", "Свинья", 10.0, "IM", 24, 4), ("florfenicol", "Свинья", 15.0, "IM", 48, 7),
    ("ceftiofur", "Свинья", 3.0, "IM", 24, 3), ("tulathromycin", "Свинья", 2.5, "IM", 0, 1), ("trimethoprim", "Свинья", 5.0, "IM", 24, 5),
    ("amoxicillin", "Свинья", 10.0, "oral", 12, 5), ("enrofloxacin", "КРС", 5.0, "SC", 24, 3), ("oxytetracycline", "КРС", 10.0, "IV", 24, 4),
    ("florfenicol", "КРС", 40.0, "SC", 48, 2), ("ceftiofur", "КРС", 1.1, "SC", 24, 3), ("tulathromycin", "КРС", 2.5, "SC", 0, 1),
    ("penicillin G", "КРС", 10000.0, "IM", 24, 3), ("sulfadiazine", "КРС", 30.0, "IV", 24, 5), ("enrofloxacin", "Птица", 10.0, "oral", 24, 5),
    ("oxytetracycline", "Птица", 25.0, "oral", 24, 5), ("florfenicol", "Птица", 20.0, "oral", 24, 5), ("doxycycline", "Птица", 15.0, "oral", 24, 5),
    ("tylosin", "Птица", 25.0, "oral", 24, 5), ("sulfadimidine", "Птица", 100.0, "oral", 24, 5), ("enrofloxacin", "Собака", 5.0, "oral", 24, 7),
    ("amoxicillin", "Собака", 10.0, "oral", 12, 7), ("doxycycline", "Собака", 5.0, "oral", 12, 7), ("metronidazole", "Собака", 15.0, "oral", 12, 7),
    ("gentamicin", "Собака", 6.0, "IM", 24, 5), ("clindamycin", "Собака", 11.0, "oral", 12, 7), ("cefalexin", "Собака", 15.0, "oral", 12, 7),
    ("amoxicillin", "Кошка", 12.5, "oral", 12, 7), ("doxycycline", "Кошка", 5.0, "oral", 12, 7), ("clindamycin", "Кошка", 11.0, "oral", 24, 7),
    ("marbofloxacin", "Кошка", 4.0, "oral", 24, 7), ("metronidazole", "Кошка", 10.0, "oral", 12, 7), ("cefalexin", "Кошка", 15.0, "oral", 12, 7),
    ("penicillin G", "Лошадь", 22000.0, "IM", 12, 5), ("gentamicin", "Лошадь", 6.6, "IV", 24, 5), ("enrofloxacin", "Лошадь", 5.0, "oral", 24, 7),
    ("doxycycline", "Лошадь", 10.0, "oral", 12, 7), ("metronidazole", "Лошадь", 15.0, "oral", 8, 7), ("ceftiofur", "Лошадь", 2.2, "IM", 24, 5),
)

# Notes to the rates above, in their order (fixed values); the rates have no contraindications.
DOSE_NOTES = (
    "Не применять у свиней на откорме (период ожидания 10 дней)", "Развести в 2 точки введения при дозе >10 мл", "Период ожидания 14 дней",
    "Для лечения респираторных инфекций", "Однократно. Период ожидания 33 дня", "В комбинации с сульфадиазином 1:5", "Перорально через воду",
    "Период ожидания 14 дней (молоко 84 часа)", "Вводить медленно IV. Период ожидания 22 дня", "2 введения с интервалом 48ч. Период ожидания 38 дней",
    "Для лечения пневмонии. Не применять у жвачных < 8 недель", "Однократно. Период ожидания 49 дней", "Доза в IU/кг. Период ожидания 14 дней",
    "В комбинации с триметопримом", "Через воду. Период ожидания 12 дней", "Через воду. Не использовать у несушек", "Через воду",
    "Через воду. Период ожидания 7 дней", "Через воду", "Через воду", "Не применять щенкам < 8 мес (хрящевая ткань)", "Клавулановая кислота 2:1",
    "Давать с водой (эзофагит)", "Антианаэробный", "Контроль функции почек. Не > 7 дней", "Нефротоксичный у кошек", "Кожные инфекции",
    "С клавулановой кислотой", "Давать с водой (эзофагит)", "Ограничить курс (нефротоксичность)", "Не применять котятам < 8 мес",
    "Горький — давать в капсуле", None, "IU/кг. Не давать лошадям orally", "Контроль функции почек", "Не применять жеребятам < 12 мес",
    "Давать с водой", "Анаэробные инфекции", None,
)

# ---------------------------------------------------------------- kinetic profiles (fixed values)
# drug, species, bioavailability, volume, absorption rate, elimination rate, route, MIC, target type, target
PK_PROFILES = (
    ("Энрофлоксацин", "Собака", 1.0, 2.5, 1.5, 0.12, "oral", 0.5, "auc_mic", 125.0),
    ("Амоксициллин", "Собака", 0.85, 0.3, 1.2, 0.7, "oral", 0.5, "t_above_mic", 40.0),
    ("Гентамицин", "Собака", 1.0, 0.25, 0.0, 0.23, "IV", 2.0, "cmax_mic", 10.0),
    ("Доксициклин", "Собака", 0.9, 1.5, 0.8, 0.05, "oral", 1.0, "auc_mic", 40.0),
    ("Марбофлоксацин", "Кошка", 0.95, 1.5, 1.0, 0.08, "oral", 0.25, "auc_mic", 125.0),
    ("Цефтиофур", "КРС", 1.0, 0.4, 0.0, 0.25, "IV", 1.0, "t_above_mic", 40.0),
)

# ---------------------------------------------------------------- toxicity endpoints (fixed values)
TOX_ENDPOINTS = (
    (1, "Ames mutagenicity", "ChemBERTa-zinc-base-v1_Ames"), (2, "hERG blockade", "ChemBERTa-zinc-base-v1_hERG"),
    (3, "ClinTox (FDA failure)", "ChemBERTa-zinc-base-v1_ClinTox"), (4, "Hepatotoxicity (DILI)", "ChemBERTa-zinc-base-v1_DILI"),
    (5, "Skin sensitization", "ChemBERTa-zinc-base-v1_SkinSens"),
)

# ---------------------------------------------------------------- pathogen panel (fixed values)
# pathogen, kind, target, function keywords, pocket radius, pocket charge, pocket hydrophobicity, essential
POCKET_PANEL = (
    ("asfv", "virus", "asfv-p72", "структурный белок капсида", 12.0, -1, 0.6, True), ("asfv", "virus", "asfv-polx", "репарация днк", 8.0, -1, 0.3, True),
    ("fmdv", "virus", "fmdv-3c", "расщепляет вирусный полипротеин", 7.0, -1, 0.4, True), ("fmdv", "virus", "fmdv-vp1", "rgd-мотив", 10.0, 0, 0.5, True),
    ("brucella", "bacterium", "brucella-fabI", "фермент синтеза жирных кислот", 9.0, -1, 0.7, True),
    ("hpai", "virus", "hpai-na", "отщепляет сиаловую кислоту", 11.0, 1, 0.2, True), ("hpai", "virus", "hpai-m2", "протоный канал", 5.0, 0, 0.8, True),
    ("newcastle", "virus", "ndv-hn", "связывается с сиаловой кислотой и расщепляет её", 10.0, 1, 0.3, True),
    ("rabies", "virus", "rv-g", "связывается с nachr рецептором", 14.0, 1, 0.5, True),
    ("salmonella", "bacterium", "salmonella-gyra", "катализирует суперскручивание днк", 12.0, -1, 0.4, True),
    ("salmonella", "bacterium", "salmonella-flic", "структурный белок жгутика", 10.0, 0, 0.6, False),
    ("bvdv", "virus", "bvdv-ns3", "сериновая протеаза + хеликаза", 13.0, 0, 0.5, True), ("bvdv", "virus", "bvdv-erns", "рибонуклеаза", 9.0, 1, 0.3, False),
    ("leptospira", "bacterium", "leptospira-lip32", "поверхностный липопротеин", 8.0, 0, 0.7, False),
    ("leptospira", "bacterium", "leptospira-fab", "фермент синтеза жирных кислот", 11.0, 0, 0.5, True),
    ("pedv", "virus", "pedv-spike", "связывается с рецептором apn", 16.0, 0, 0.4, True),
    ("pedv", "virus", "pedv-3clpro", "цистеиновая протеаза, расщепляет polyprotein", 10.0, 0, 0.5, True),
    ("ecoli-vet", "bacterium", "ecoli-gyra", "катализирует суперскручивание днк", 12.0, -1, 0.4, True),
    ("ecoli-vet", "bacterium", "ecoli-ltab", "ab5-токсин", 11.0, 1, 0.3, False), ("anaplasma", "bacterium", "anaplasma-msp5", "поверхностный белок", 7.0, 0, 0.5, False),
    ("clostridium", "bacterium", "clostridium-cpa", "лецитиназа", 11.0, 1, 0.5, True),
    ("campylobacter", "bacterium", "campylobacter-gyra", "катализирует суперскручивание днк", 12.0, -1, 0.4, True),
    ("mycoplasma", "bacterium", "mycoplasma-p146", "белок-адгезин", 14.0, 0, 0.6, False),
    ("h5n1", "virus", "h5n1-ha", "связывается с сиаловой кислотой", 13.0, 0, 0.4, True), ("h5n1", "virus", "h5n1-na", "отщепляет сиаловую кислоту", 10.0, -1, 0.3, True),
    ("corynebacterium", "bacterium", "corynebacterium-pld", "фактор вирулентности", 9.0, 0, 0.5, False),
)
# target, its name, its structure's PDB id (fixed values)
TARGETS = (
    ("asfv-p72", "Капсидный белок p72", "6QU9"), ("asfv-polx", "ДНК-полимераза X", "3QZJ"), ("fmdv-3c", "3C-протеаза", "6QYL"),
    ("fmdv-vp1", "Капсидный белок VP1", "1FOD"), ("brucella-fabI", "Эноил-АЦП-редуктаза FabI", "4LSY"), ("hpai-na", "Нейраминидаза NA", "2HTY"),
    ("hpai-m2", "Ионный канал M2", "2LKF"), ("ndv-hn", "Гемагглютинин-нейраминидаза HN", "3T1E"), ("rv-g", "Гликопротеин G", "6LGW"),
    ("salmonella-gyra", "ДНК-гираза GyrA", "2XCT"), ("salmonella-flic", "Флагеллин FliC", "1UC1"), ("bvdv-ns3", "NS3 протеаза/хеликаза", "1S48"),
    ("bvdv-erns", "Eᴿⁿˢ гликопротеин", "2BTT"), ("leptospira-lip32", "Лipoprotein LipL32", "5DNG"), ("leptospira-fab", "β-кетоацил-ACP-синтаза", "2Q9B"),
    ("pedv-spike", "Спайковый гликопротеин S", "7XGX"), ("pedv-3clpro", "Основная протеаза 3CLpro", "7QEU"), ("ecoli-gyra", "ДНК-гираза GyrA", "6F87"),
    ("ecoli-ltab", "Термолабильный энтеротоксин LT", "1LTS"), ("anaplasma-msp5", "Major Surface Protein 5", "2VWM"), ("clostridium-cpa", "Альфа-токсин (фосфолипаза C)", "1QMY"),
    ("campylobacter-gyra", "ДНК-гираза GyrA", "5NVL"), ("mycoplasma-p146", "Адгезин P146", "2MTS"), ("h5n1-ha", "Гемагглютинин H5", "2FK0"),
    ("h5n1-na", "Нейраминидаза N1", "2HTY"), ("corynebacterium-pld", "Фосфолипаза D", "1V0O"),
)
# mechanism pattern, target-id pattern, function pattern, boost
MECHANISM_RULES = (
    ("гираз|dna gyrase|topoisomerase", "gyr", "гираз|суперскручив", 15),
    ("рибосом|30s|50s|peptidyltransferase", "16s|23s", "рибосом|трансляц", 15),
    ("пептидоглик|клеточн|transpeptidase|pbp", "pbp", "клеточн|синтез", 15),
    ("полимераз|polymerase|rdrp", None, "полимераз|репликац|транскрипц", 12),
    ("протеаз|protease|3cl", None, "протеаз|расщепл", 12),
    ("нейраминидаз", "na", "нейраминидаз", 15),
)

ENZYME_COLUMNS = ("name", "recognition", "cut_top", "cut_bottom", "cut_type", "palindromic")
PANEL_COLUMNS = ("pathogen_id", "kind", "target_id", "function", "pocket_radius", "pocket_charge", "pocket_hydrophobicity", "essential")
DOSE_COLUMNS = ("drug", "species", "dose_mg_kg", "route", "interval_hours", "duration_days")
TARGET_COLUMNS = ("target_id", "target_name", "pdb_id")
PK_COLUMNS = ("drug", "species", "bioavailability", "volume", "ka", "ke", "route", "mic", "target_type", "target")


def fixed_table(spark: SparkSession, columns: tuple[str, ...], rows, schema: str | None = None) -> DataFrame:
    """A fixed-value table as a local relation: Spark knows its size and broadcasts it by itself."""
    pdf = pd.DataFrame(list(rows), columns=list(columns))
    for c in pdf.columns:
        if str(pdf[c].dtype) == "int64":
            pdf[c] = pdf[c].astype("int32")
    return spark.createDataFrame(pdf, schema) if schema else spark.createDataFrame(pdf)


def sql_literal(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}::double"
    return "'" + str(v).replace("'", "''") + "'"


def sql_values(alias: str, columns: tuple[str, ...], rows) -> str:
    """The same fixed table as a DuckDB VALUES clause, for oracle texts."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in r) + ")" for r in rows)
    return f"(values {body}) as {alias}({', '.join(columns)})"
