"""Compound property expressions: rule violations, docking scores and the property panel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biotally.functions.sequence import clamp, round_half_up


def _c(name: str) -> Column:
    return F.col(name)


def _points(*terms: tuple[Column, object]) -> Column:
    """Sum of values of the conditions that hold."""
    total = F.lit(0.0)
    for cond, value in terms:
        total = total + F.when(cond, value if isinstance(value, Column) else F.lit(float(value))).otherwise(F.lit(0.0))
    return total


def _tidy(x: Column) -> Column:
    # Scores are sums of decimals: settle the last bits before a threshold or a rounding looks at them.
    return F.round(x, 9)


def lipinski_violations(strict: bool = False) -> Column:
    """Relaxed limits for veterinary compounds; ``strict`` takes the usual weight and rotatable-bond limits."""
    mw, rot = (500, 10) if strict else (600, 12)
    limits = [_c("mw") > mw, _c("logp") > 5, _c("hbd") > 5, _c("hba") > 10, F.coalesce(_c("rotatable_bonds") > rot, F.lit(False))]
    return sum((x.cast("int") for x in limits[1:]), limits[0].cast("int"))


def shape_score(radius: Column, pocket: Column) -> Column:
    r = radius / pocket
    return _tidy(
        F.when(r > 1.2, F.greatest(F.lit(0.0), 30 - (r - 1.2) * 50))
        .when(r < 0.3, F.greatest(F.lit(0.0), r * 100))
        .when(r.between(0.6, 0.9), 90 + (1 - F.abs(r - 0.75) / 0.15) * 10)
        .otherwise(50 + (1 - F.abs(r - 0.75) / 0.45) * 40)
    )


def electrostatic_score(charge: Column, pocket: Column) -> Column:
    return F.when(charge == 0, 70).when(charge == -pocket, 100).otherwise(F.greatest(F.lit(10), 40 - F.abs(charge - pocket) * 20)).cast("double")


def hydrophobic_score(hydro: Column, donors: Column, pocket: Column) -> Column:
    base = (1 - F.abs(hydro - pocket)) * 80
    bonus = _points((pocket < 0.4, F.least(F.lit(20.0), donors * 2.0)), ((pocket > 0.6) & (hydro > 0.6), 10))
    return F.least(F.lit(100.0), round_half_up(_tidy(base + bonus)).cast("double"))


def hbond_score(donors: Column, pocket: Column) -> Column:
    return (
        F.when((pocket > 0.7) & (donors <= 4), 90).when((pocket > 0.7) & (donors <= 8), 60).when(pocket > 0.7, 30)
        .when((pocket < 0.3) & donors.between(4, 12), 90).when((pocket < 0.3) & (donors >= 2), 70).when(pocket < 0.3, 40)
        .when(donors.between(3, 8), 80).otherwise(60)
    ).cast("double")


def tpsa() -> Column:
    return (_c("hbd") + _c("hba") * 0.4) * 12


def tpsa_score(t: Column) -> Column:
    return _tidy(F.when(t <= 60, 100.0).when(t <= 140, 80 - (t - 60) * 0.25).otherwise(F.greatest(F.lit(20.0), 60 - (t - 140) * 0.3)))


def binding_affinity(score: Column) -> Column:
    return round_half_up(_tidy((-2 - F.ln(1 + score * score / 10) * 0.6) * 10)) / 10


def compound_selectivity() -> Column:
    """What a compound adds to the selectivity: activity, mechanism, size and lipophilicity."""
    return _points(
        (_c("activity") == "antiviral", 10),
        ((_c("activity") == "antibacterial") & F.coalesce(F.contains(_c("mechanism"), F.lit("рибосом")), F.lit(False)), 10),
        (_c("mw") > 1000, -20), ((_c("mw") < 250) & (_c("logp") > 3), -10),
    )


def target_selectivity() -> Column:
    """What a target adds: essential, and the family."""
    t = _c("target_id")
    return _points((_c("essential"), 20), (F.contains(t, F.lit("fabI")) | F.contains(t, F.lit("3c")), 15))


def selectivity_index(compound: Column, target: Column) -> Column:
    """50 and both parts, from 0 to 100."""
    return clamp((F.lit(50) + compound + target).cast("int"), 0, 100)


def bin_level(value: Column, low: float, high: float) -> Column:
    return F.when(value < low, "low").when(value > high, "high").otherwise("moderate")


def _group(word: str) -> Column:
    return F.contains(F.lower(_c("pharm_group")), F.lit(word))


def admet_panel() -> dict[str, Column]:
    """Fourteen numeric endpoints of a compound row, unrounded, in a fixed order."""
    mw, logp, hbd, hba, rot, q = (_c(x) for x in ("mw", "logp", "hbd", "hba", "rotatable_bonds", "charge"))
    aq = F.abs(q)
    oral = 80 + _points(
        (mw > 500, (mw - 500) / -10), (logp > 5, (logp - 5) * -6), (logp < 0, logp * 4), (hbd > 5, (hbd - 5) * -4.0), (hba > 10, (hba - 10) * -2.0),
        (rot > 10, (rot - 10) * -3.0), (aq == 2, -15), (aq >= 3, -30), (mw > 1000, -20),
    )
    bbb = _points(
        (mw < 400, 1), (mw >= 400, (mw - 400) / -200), (logp.between(1, 3), 1), ((logp > 3) & (logp <= 5), 0.3), (logp < 1, -0.5), (logp > 5, -1),
        (q != 0, -1.5), (hbd > 3, -0.5),
    )
    caco2 = 8 - tpsa() * 0.04 + logp * 0.5 + _points((mw > 500, -1), (q != 0, -2))
    ppb = 30 + logp * 12 + _points((q < 0, 10), (q > 0, -5), (mw > 500, 5))
    vd = F.when(q < 0, 0.2 + logp * 0.02).when(q > 0, 2.0 + logp * 0.5).otherwise(0.5 + logp * 0.2)
    hepatic = 0.3 + logp * 0.1 + _points((q != 0, -0.1))
    renal = 0.7 - logp * 0.1 + _points((q != 0, 0.15))
    log_s = 0.5 - (mw - 20) * 0.01 - logp + _points((q != 0, 2))
    herg = _points((q > 0, 0.3), (logp > 3, 0.25), (logp > 5, 0.15), (mw > 400, 0.1), (hba > 4, 0.1))
    ames = 0.1 + _points((_group("нитро"), 0.4), (_group("алкил"), 0.3), (logp > 4, 0.1), ((q > 0) & (mw < 300), 0.15))
    hepatotox = 0.15 + _points((logp > 3, 0.2), (_group("сульфан"), 0.25), (_group("макролид"), 0.1), (mw > 500, 0.1))
    skin = 0.1 + _points((logp > 3, 0.15), (q > 0, 0.1), (_group("фенол"), 0.25))
    cyp_s = 0.2 + _points(((logp > 2) & (mw > 300), 0.4), (q > 0, 0.15))
    cyp_i = 0.1 + _points((logp > 4, 0.3), (_group("макролид"), 0.3), (_group("имидазол"), 0.4))
    bio = 0.05 + logp * 0.15 + _points((logp > 5, 0.2))
    herg, ames, hepatotox = (_tidy(clamp(x, 0.0, top)) for x, top in ((herg, 0.95), (ames, 0.9), (hepatotox, 0.9)))
    likeness = 100 + _points(
        (mw > 500, (mw - 500) / -20), (logp > 5, (logp - 5) * -8), (logp < -1, (logp + 1) * 8), (hbd > 5, (hbd - 5) * -5.0), (hba > 10, (hba - 10) * -3.0),
        (rot > 10, (rot - 10) * -3.0), (aq >= 2, -10),
    ) - (herg * 20 + hepatotox * 15 + ames * 15)
    whole = lambda x, low, high: clamp(round_half_up(_tidy(x)).cast("double"), float(low), float(high))
    part = lambda x, low, high: _tidy(clamp(x, low, high))
    return {
        "oral": whole(oral, 5, 95), "bbb": part(bbb, -2.0, 2.0), "caco2": part(caco2, 0.1, 30.0), "ppb": whole(ppb, 5, 99), "vd": part(vd, 0.1, 15.0),
        "hepatic": part(hepatic, 0.05, 0.9), "renal": part(renal, 0.05, 0.9), "log_s": _tidy(log_s), "herg": herg, "ames": ames, "hepatotox": hepatotox,
        "skin": part(skin, 0.0, 0.9), "cyp_substrate": part(cyp_s, 0.0, 0.95), "cyp_inhibitor": part(cyp_i, 0.0, 0.95),
        "bioaccumulation": part(bio, 0.0, 0.95), "drug_likeness": whole(likeness, 0, 100),
    }


# endpoint: low and high limit of the level (fixed values); solubility is read as -log_s
LEVEL_LIMITS = {
    "oral": (30, 70), "bbb": (-0.5, 0.5), "caco2": (5, 15), "ppb": (50, 85), "vd": (0.5, 3), "log_s": (2, 5), "herg": (0.25, 0.6), "ames": (0.2, 0.5),
    "hepatotox": (0.25, 0.55), "skin": (0.2, 0.5), "bioaccumulation": (0.3, 0.65),
}
PANEL_LABELS = {
    "oral": "oral bioavailability", "bbb": "blood-brain barrier", "caco2": "Caco-2 permeability", "ppb": "plasma protein binding", "vd": "volume of distribution",
    "log_s": "solubility", "herg": "hERG risk", "ames": "mutagenicity", "hepatotox": "hepatotoxicity", "skin": "skin sensitization", "bioaccumulation": "bioaccumulation",
}


def panel_level(name: str) -> Column:
    low, high = LEVEL_LIMITS[name]
    return bin_level(-_c(name) if name == "log_s" else _c(name), low, high)


def alerts() -> Column:
    """Messages for failed limits, over a row that has the panel columns."""
    tests = (
        (_c("mw") > 500, "MW > 500"), (_c("logp") > 5, "LogP > 5"), (_c("hbd") > 5, "HBD > 5"), (_c("rotatable_bonds") > 10, "rotatable bonds > 10"),
        (_c("herg") > 0.5, "hERG risk"), (_c("hepatotox") > 0.5, "hepatotoxicity"), (_c("cyp_inhibitor") > 0.5, "CYP3A4 inhibitor"), (_c("bioaccumulation") > 0.6, "bioaccumulation"),
    )
    return F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in tests]))
