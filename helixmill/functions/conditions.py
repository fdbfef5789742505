"""Reaction conditions: what a mix of additives does to melting, structure, enzyme and binding.

Conditions are a small record at the driver; what depends on the primer is a
``Column``, the rest are numbers that enter plans as literals.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixmill.functions import thermo
from helixmill.functions.seq import gc_content


@dataclass(frozen=True)
class Conditions:
    """Temperature in degrees, salts in mM, DMSO, formamide, ethanol, glycerol and PEG in percent, the others in mol/l."""

    polymerase: str = "phi29"
    celsius: float = 30.0
    na: float = 50.0
    mg: float = 0.0
    dmso: float = 0.0
    betaine: float = 0.0
    trehalose: float = 0.0
    formamide: float = 0.0
    ethanol: float = 0.0
    urea: float = 0.0
    tmac: float = 0.0
    glycerol: float = 0.0
    peg: float = 0.0
    ssb: float = 0.0

    def additives(self) -> dict[str, float]:
        return {k: getattr(self, k) for k in thermo.ADDITIVES}


# Pairs and triples of additives that act together: pathway, effect for each unit above the threshold,
# thresholds and caps of the additives, least GC share of the template, and the effect's slope by temperature above 30.
INTERACTIONS = (
    ("stability", 0.15, {"betaine": (0.5, 1.5), "trehalose": (0.1, 0.5)}, 0.0, 0.0),
    ("processivity", 0.05, {"betaine": (0.5, 1.5), "trehalose": (0.1, 0.5)}, 0.0, 0.0),
    ("stability", 0.015, {"dmso": (2.0, 8.0), "formamide": (1.0, 5.0)}, 0.0, 0.0),
    ("accessibility", 0.08, {"betaine": (0.5, 2.0), "dmso": (2.0, 8.0)}, 0.55, 0.0),
    ("tm", 0.02, {"betaine": (0.5, 2.0), "dmso": (2.0, 8.0)}, 0.55, 0.0),
    ("stability", 0.12, {"trehalose": (0.1, 0.5), "dmso": (3.0, 8.0)}, 0.0, 0.0),
    ("kon", 0.3, {"ssb": (1.0, math.inf), "betaine": (0.5, 2.0)}, 0.0, 0.0),
    ("speed", -0.02, {"peg": (2.0, 10.0), "betaine": (1.0, 2.0)}, 0.0, 0.0),
    ("stability", 0.05, {"betaine": (0.5, 2.0)}, 0.0, 0.02),
    ("processivity", 0.03, {"betaine": (1.0, 2.0), "dmso": (3.0, 6.0), "trehalose": (0.2, 0.5)}, 0.0, 0.0),
    ("accessibility", 0.04, {"betaine": (1.0, 2.0), "dmso": (3.0, 6.0), "trehalose": (0.2, 0.5)}, 0.50, 0.0),
)
# DMSO threshold of each polymerase, loss a percent up to it and beyond it.
DMSO_LOSS = {"phi29": (5.0, 0.02, 0.12), "equiphi29": (4.0, 0.025, 0.15), "bst": (3.0, 0.03, 0.18), "klenow": (5.0, 0.02, 0.10)}
# Bounds of the enzyme's factors, before and after interactions.
ENZYME_BOUNDS = {"processivity": (0.1, 1.2), "speed": (0.3, 1.1), "stability": (0.2, 1.3)}
# Saturating melting of template structure by additive: greatest effect and rate.
STRUCTURE = {"dmso": (0.6, 0.5), "betaine": (0.4, 0.3)}
# Gain of binding and of release for each unit of an additive, and the cap of the former.
KINETICS = {"betaine": (0.10, 2.0, 0.05), "dmso": (0.02, 5.0, 0.03)}
OPTIMAL_DELTA, DELTA_WIDTH = 7.0, 5.0


def interaction(c: Conditions, pathway: str, template_gc: float) -> float:
    """Product of the effects of all interactions that are active on a pathway."""

    def effect(base: float, needs: dict[str, tuple[float, float]], least_gc: float, slope: float) -> float:
        have = {k: getattr(c, k) for k in needs}
        if template_gc < least_gc or any(have[k] < lo for k, (lo, _) in needs.items()):
            return 1.0
        size = base * math.prod(min(have[k], hi) - lo for k, (lo, hi) in needs.items()) * max(0.0, 1 + slope * (c.celsius - 30.0))
        return max(0.1, 1 + size) if base < 0 else 1 + size

    return math.prod(effect(*rest) for p, *rest in INTERACTIONS if p == pathway)


def accessibility(c: Conditions, template_gc: float) -> float:
    """Share of the template that is open: what GC-rich structure hides, less what additives and heat melt."""
    hidden = min(0.7, max(0.0, template_gc - 0.5))
    melted = {k: most * (1 - math.exp(-rate * getattr(c, k))) for k, (most, rate) in STRUCTURE.items()}
    if c.dmso > 2 and c.formamide > 1:  # they compete for the same bonds
        melted["dmso"] *= 1 - min(0.5, 0.03 * (c.dmso - 2) * (c.formamide - 1))
    melted["heat"] = min(0.5, 0.02 * max(0.0, c.celsius - 25))
    open_ = 1 - hidden * math.prod(1 - m for m in melted.values())
    return min(1.0, max(0.1, open_ * interaction(c, "accessibility", template_gc)))


def enzyme(c: Conditions, template_gc: float = 0.5) -> dict[str, float]:
    """Factors of the polymerase's ``processivity``, ``speed`` and ``stability``."""
    limit, mild, steep = DMSO_LOSS[c.polymerase]
    loss = mild * min(c.dmso, limit) + steep * max(0.0, c.dmso - limit)
    if c.betaine <= 1.0:
        gain = 0.12 * c.betaine
        betaine = {"stability": 1 + gain, "processivity": 1 + gain / 2}
    elif c.betaine <= 1.5:
        betaine = {"stability": 1.12}
    else:
        betaine = {"stability": 1.06, "processivity": 1 - 0.15 * (c.betaine - 1.5)}
    mg = (c.mg if c.mg > 0 else 0.2) if c.mg < 1 else 1 - 0.1 * max(0.0, c.mg - 6)
    chelated = 0.08 * (c.dmso - 3) * (3 - c.mg) / 3 if c.dmso > 3 and c.mg < 3 else 0.0
    effects = [
        {"processivity": 1 - loss, "speed": 1 - loss / 2},
        betaine,
        {"processivity": 1 - 0.06 * c.formamide, "stability": 1 - 0.03 * c.formamide},
        {"processivity": max(0.2, mg) * (1 - chelated)},
        {"speed": 1 - min(0.5, 0.03 * abs(c.celsius - thermo.POLYMERASES[c.polymerase][2]))},
        {"stability": 1 + 0.02 * c.glycerol, "speed": 1 - 0.02 * c.glycerol},
    ]
    bound = lambda p, v: min(ENZYME_BOUNDS[p][1], max(ENZYME_BOUNDS[p][0], v))
    return {p: bound(p, bound(p, math.prod(e.get(p, 1.0) for e in effects)) * interaction(c, p, template_gc)) for p in ENZYME_BOUNDS}


def effective_tm(s: Column, c: Conditions, template_gc: float = 0.5) -> Column:
    """Tm under the conditions; the additives' shift is scaled by their interactions."""
    shift = thermo.additive_term(c.celsius, **c.additives()) + thermo.gc_equalisation(s, **c.additives())
    return thermo.tm_salt(s, c.na, c.mg) + shift * interaction(c, "tm", template_gc)


def effects(s: Column, c: Conditions, template_gc: float = 0.5) -> Column:
    """Struct of a primer's mechanistic effects, from effective Tm to the predicted amplification factor."""
    tm = effective_tm(s, c, template_gc)
    delta = tm - c.celsius
    bell = F.exp(-0.5 * F.pow((delta - OPTIMAL_DELTA) / DELTA_WIDTH, F.lit(2)))
    boost = math.prod(1 + up * min(getattr(c, k), most) for k, (up, most, _) in KINETICS.items()) * (2.0 if c.ssb else 1.0) * interaction(c, "kon", template_gc)
    release = math.prod(1 + down * getattr(c, k) for k, (_, _, down) in KINETICS.items()) * interaction(c, "koff", template_gc)
    open_, e = accessibility(c, template_gc), enzyme(c, template_gc)
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    binding = unit(bell * bell * boost * open_)
    extension = e["speed"] * e["processivity"]
    return F.struct(
        tm.alias("effective_tm"), F.lit(open_).alias("accessibility"), *[F.lit(e[p]).alias(p) for p in ("processivity", "speed", "stability")], (bell * boost).alias("kon"),
        (F.exp(F.when(delta > 0, -0.1).otherwise(-0.2) * delta) * release).alias("koff"), binding.alias("binding"), F.lit(extension).alias("extension"), unit(binding * extension * open_).alias("amplification"),
    )


def legacy_correction(s: Column, c: Conditions) -> Column:
    """Tm shift by fixed coefficients, free of temperature, and the GC equalisation."""
    fixed = sum(thermo.ADDITIVES[k][0] * v for k, v in c.additives().items())
    return fixed + thermo.gc_equalisation(s, **c.additives())


def max_length(c: Conditions, gc: float | None = None) -> int:
    """Longest primer that the conditions support, 6 to 18, by the GC share of the primer."""
    n = 12 + 2 * (c.betaine >= 0.5) + (c.betaine >= 1) + (c.dmso >= 3) + (c.dmso >= 5) + (c.polymerase == "equiphi29" and c.celsius >= 42)
    if gc is not None:
        n += -2 * (c.betaine < 2) if gc > 0.7 else -(c.betaine < 1.5) if gc > 0.6 else 1 if gc < 0.3 else (c.betaine >= 0.5 or c.dmso >= 3) if gc < 0.4 else 0
    # each of the longest sizes needs its own support
    for size, supported in ((16, c.betaine >= 1 or c.dmso >= 5), (17, c.betaine >= 1.5 and c.dmso >= 3), (18, c.betaine >= 2 and c.dmso >= 5)):
        if n >= size and not supported:
            n = size - 1
    return max(6, min(int(n), 18))


def length_is_safe(s: Column, c: Conditions) -> Column:
    """Whether a primer's length lies between 6 and what the conditions support at its GC share."""
    gc = gc_content(s)
    most = reduce(lambda w, x: w.when(x[0], x[1]), [(gc > 0.6, max_length(c, 0.65)), (gc < 0.3, max_length(c, 0.25)), (gc < 0.4, max_length(c, 0.35))], F.when(gc > 0.7, max_length(c, 0.75))).otherwise(max_length(c, 0.5))
    return F.length(s).between(F.lit(6), most)


def energy_to_tm(dg: Column, length: Column, na: float = 50.0, mg: float = 0.0, celsius: float = 37.0) -> Column:
    """Rough Tm from an energy at ``celsius``: entropy is taken as -22 cal/(mol K) a base."""
    ds = -22.0 * length
    return (1000 * dg + (celsius + thermo.KELVIN) * ds) / (ds + thermo.R * math.log(0.5e-6 / 4)) - thermo.KELVIN + thermo.salt_term(na, mg)


def tm_range(s: Column, na: float = 50.0, mg: float = 0.0, margin: float = 2.0) -> Column:
    tm = thermo.tm_salt(s, na, mg)
    return F.struct((tm - margin).alias("low"), (tm + margin).alias("high"))


def gc_range(genome_gc: float, tolerance: float = 0.15) -> tuple[float, float]:
    """GC bounds around a genome's own share, within 0.15 and 0.85."""
    return max(0.15, genome_gc - tolerance), min(0.85, genome_gc + tolerance)


def dimer_energy_limit(base: float, genome_gc: float) -> float:
    """Energy bound of dimers, 3 kcal/mol stricter for 0.35 more GC, within -15 and -5."""
    return max(-15.0, min(-5.0, base - (genome_gc - 0.5) * 3.0 / 0.35))


def criteria(c: Conditions, genome_gc: float, gc_min: float = 0.375, gc_max: float = 0.625, dimer: float = -9.0) -> dict[str, float]:
    """Filter bounds that follow from the conditions: Tm around the temperature, GC widened by betaine and by the genome, dimers by heat."""
    widened = min(c.betaine * 0.1, 0.15)
    lo, hi = (max(0.30, gc_min - widened), min(0.70, gc_max + widened)) if widened else (gc_min, gc_max)
    return {
        "min_tm": c.celsius - 5, "max_tm": c.celsius + 20, "gc_min": 0.30 if genome_gc < 0.35 else lo, "gc_max": 0.70 if genome_gc > 0.65 else hi,
        "max_dimer_energy": -10.0 if c.celsius >= 42 else dimer,
    }


# Applications: coverage wanted, least ratio of sites, sizes of sets, and what comes first.
PROFILES = {"discovery": (0.90, 2.0, (10, 15), "coverage"), "clinical": (0.70, 10.0, (6, 10), "specificity"), "enrichment": (0.80, 5.0, (8, 12), "balanced"), "metagenomics": (0.95, 1.5, (15, 20), "coverage")}


def base_set_size(length: int, k: int, coverage: float, reach: float, processivity: float, binding: float) -> int:
    """Primers that cover a random genome to a share, with 30 % for overlaps; 4 to 20."""
    each = 2.0 * length * 4.0**-k * reach * processivity * binding / length
    return 20 if each <= 0 else max(4, min(20, int(-math.log(1 - coverage) / each * 1.3 + 0.5)))


def set_size(application: str, length: int, k: int, processivity: float = 1.0, binding: float = 0.8, reach: int = 70000, coverage: float | None = None) -> dict:
    """Recommended number of primers for an application, and what it rests on."""
    wanted, ratio, (least, most), first = PROFILES.get(application, PROFILES["enrichment"])
    coverage = wanted if coverage is None else coverage
    base = base_set_size(length, k, coverage, reach, processivity, binding)
    plain = base_set_size(length, k, coverage, reach, 1.0, 0.8)
    size = {"specificity": max(4, int(base * 0.85)), "coverage": min(20, int(base * 1.1)), "balanced": base}[first]
    return {"recommended_size": max(least, min(most, size)), "base_estimate": base, "target_coverage": coverage, "min_fg_bg_ratio": ratio, "priority": first, "additive_adjustment": 100.0 * (plain - base) / plain}
