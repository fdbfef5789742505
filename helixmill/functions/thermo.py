"""Nearest-neighbour thermodynamics of short DNA as columns."""

from __future__ import annotations

import math
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixmill.functions.seq import gc_content, gc_count, is_palindrome

# Published nearest-neighbour stacks, enthalpy in kcal/mol and entropy in cal/(mol K).
ENTHALPY = {"AA": -7.9, "TT": -7.9, "AT": -7.2, "TA": -7.2, "CA": -8.5, "TG": -8.5, "GT": -8.4, "AC": -8.4, "CT": -7.8, "AG": -8.0, "GA": -8.2, "TC": -8.2, "CG": -10.6, "GC": -9.8, "GG": -8.0, "CC": -8.0}
ENTROPY = {"AA": -22.2, "TT": -22.2, "AT": -20.4, "TA": -21.3, "CA": -22.7, "TG": -22.7, "GT": -22.4, "AC": -22.4, "CT": -21.0, "AG": -19.9, "GA": -22.2, "TC": -22.2, "CG": -27.2, "GC": -24.4, "GG": -19.9, "CC": -19.9}
#: The stack AG as its reverse complement CT has it.
STRICT = {"AG": (-7.8, -21.0)}
INIT_H, INIT_S = 0.2, -5.7
TERMINAL_AT_H, TERMINAL_AT_S = 2.2, 6.9
SYMMETRY_S = -1.4
UNKNOWN_H, UNKNOWN_S = -8.0, -21.0
R = 1.987
KELVIN = 273.15

# Additive, Tm coefficient at 37 degrees (per percent or mol/l), activation energy in J/mol.
ADDITIVES = {"dmso": (-0.55, 2500), "betaine": (-1.2, 1800), "formamide": (-0.65, 3000), "trehalose": (-3.0, 1500), "urea": (-2.5, 2000), "tmac": (-0.5, 1000), "ethanol": (-0.4, 2200)}
# Concentration at which GC and AT pairs become equal, in mol/l.
EQUALISED = {"betaine": 5.2, "tmac": 3.0}
# Polymerase, processivity (bases), reach (bases), optimum (degrees), speed (bases a second).
POLYMERASES = {"phi29": (70000, 3000, 30, 150), "equiphi29": (80000, 4000, 42, 200), "bst": (2000, 1000, 63, 100), "klenow": (10000, 1500, 37, 50)}


def _stacks(s: Column, table: dict[str, float], unknown: float) -> Column:
    lookup = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))),
        F.lit(0.0),
        lambda acc, i: acc + F.coalesce(F.element_at(lookup, F.substring(s, i, F.lit(2))), F.lit(unknown)),
    )


def _ends_at(s: Column) -> Column:
    return F.substring(s, 1, 1).isin("A", "T").cast("int") + F.right(s, F.lit(1)).isin("A", "T").cast("int")


def enthalpy(s: Column, strict: bool = False) -> Column:
    table = ENTHALPY | ({k: v[0] for k, v in STRICT.items()} if strict else {})
    return F.when(F.length(s) < 2, 0.0).otherwise(INIT_H + _stacks(s, table, UNKNOWN_H) + TERMINAL_AT_H * _ends_at(s))


def entropy(s: Column, strict: bool = False) -> Column:
    table = ENTROPY | ({k: v[1] for k, v in STRICT.items()} if strict else {})
    return F.when(F.length(s) < 2, 0.0).otherwise(INIT_S + _stacks(s, table, UNKNOWN_S) + TERMINAL_AT_S * _ends_at(s) + F.when(is_palindrome(s), SYMMETRY_S).otherwise(0.0))


def _concentration(s: Column, primer: float) -> Column:
    return F.when(is_palindrome(s), F.lit(R * math.log(primer / 4))).otherwise(F.lit(R * math.log(primer / 2)))


def tm_basic(s: Column, primer: float = 0.5e-6, strict: bool = False) -> Column:
    return 1000 * enthalpy(s, strict) / (entropy(s, strict) + _concentration(s, primer)) - KELVIN


def monovalent(na: float = 50.0, mg: float = 0.0) -> float:
    """Monovalent equivalent in mol/l of millimolar Na and Mg."""
    return na / 1000 + (3.3 * math.sqrt(mg / 1000) if mg > 0 else 0.0)


def salt_term(na: float = 50.0, mg: float = 0.0) -> float:
    m = monovalent(na, mg)
    return 12.5 * math.log10(m) if m > 0 else 0.0


def tm_salt(s: Column, na: float = 50.0, mg: float = 0.0, primer: float = 0.5e-6, strict: bool = False) -> Column:
    """Tm with the entropy salt correction 0.368 (n - 1) ln Na."""
    corrected = entropy(s, strict) + 0.368 * (F.length(s) - 1) * math.log(monovalent(na, mg))
    return 1000 * enthalpy(s, strict) / (corrected + _concentration(s, primer)) - KELVIN


def free_energy(s: Column, celsius: float = 37.0, strict: bool = False) -> Column:
    return enthalpy(s, strict) - (celsius + KELVIN) * entropy(s, strict) / 1000


def binding_probability(dg: Column, celsius: float = 37.0) -> Column:
    return 1 / (1 + F.exp(dg / (R * (celsius + KELVIN) / 1000)))


def wallace_tm(s: Column) -> Column:
    gc = gc_count(s)
    return 2 * (F.length(s) - gc) + 4 * gc


def additive_term(celsius: float = 30.0, **amounts: float) -> float:
    """Sum of the additives' effects on Tm at a temperature, by Arrhenius factors."""
    t = celsius + KELVIN
    return sum(ADDITIVES[k][0] * v * math.exp(-ADDITIVES[k][1] / 8.314 * (1 / t - 1 / 310.15)) for k, v in amounts.items())


def gc_equalisation(s: Column, **amounts: float) -> Column:
    """What betaine and TMAC take from GC-rich and give to AT-rich strings."""
    share = sum(1 / (1 + math.exp(-1.5 * (v - EQUALISED[k] / 3))) for k, v in amounts.items() if k in EQUALISED and v > 0)
    return -2.0 * F.length(s) * (gc_content(s) - 0.5) * share


def effective_tm(s: Column, na: float = 50.0, mg: float = 0.0, celsius: float = 30.0, **amounts: float) -> Column:
    return tm_salt(s, na, mg) + additive_term(celsius, **amounts) + gc_equalisation(s, **amounts)


# The older melting formula: stacks; enthalpy and entropy of a G or C and of an A or T at an end.
_VENDOR_H = ENTHALPY | {"AG": -7.8}
_VENDOR_S = ENTROPY | {"AG": -21.0}
VENDOR_ENDS = {"GC": (0.1, -2.8), "AT": (2.3, 4.1)}
# Published salt correction of 1/Tm (units of 1e-5 per kelvin): monovalent terms, divalent terms a to g,
# the monovalent modulation of a, d and g, the regimes of sqrt([Mg])/[Na], and the binding constant of Mg and dNTP.
MONOVALENT_TERMS = (4.29, -3.95, 0.94)
DIVALENT_TERMS = {"a": 3.92, "b": -0.911, "c": 6.26, "d": 1.42, "e": -48.2, "f": 52.5, "g": 8.31}
MODULATION = {"a": lambda na, x: 0.843 - 0.352 * na**0.5 * x, "d": lambda na, x: 1.279 - 4.03e-3 * x - 8.03e-3 * x**2, "g": lambda na, x: 0.486 - 0.258 * x + 5.25e-3 * x**3}
REGIMES = (0.22, 6.0)
MG_DNTP = 3e4


def salt_polynomial(na: float, mg: float, dntp: float) -> tuple[float, float, float]:
    """Coefficients of ``1``, the GC share and ``1 / (2 (n - 1))`` in the correction of 1/Tm, for molar concentrations."""
    # free Mg solves ka x^2 + (ka (dntp - mg) + 1) x - mg = 0
    half = (MG_DNTP * (dntp - mg) + 1) / (2 * MG_DNTP)
    free = math.sqrt(half * half + mg / MG_DNTP) - half
    share = math.sqrt(free) / na if na > 0 else math.inf
    if share < REGIMES[0]:
        x = math.log(na)
        per_gc, fixed, square = MONOVALENT_TERMS
        return fixed * x + square * x * x, per_gc * x, 0.0
    t = dict(DIVALENT_TERMS)
    if share < REGIMES[1]:
        t |= {k: t[k] * f(na, math.log(na)) for k, f in MODULATION.items()}
    y = math.log(mg)
    return t["a"] + t["b"] * y, t["c"] + t["d"] * y, t["e"] + t["f"] * y + t["g"] * y * y


def vendored_tm(s: Column, dna: float = 5000.0, na: float = 10.0, mg: float = 20.0, dntp: float = 10.0) -> Column:
    """Melting point with divalent salt as older feature tables have it (nM of DNA, mM of salts).

    These tables take the GC share as ``1 / n``; values below 0 become 0.
    """
    ends = [F.substring(s, 1, 1), F.right(s, F.lit(1))]
    end = lambda i: sum((F.when(e.isin("G", "C"), VENDOR_ENDS["GC"][i]).otherwise(VENDOR_ENDS["AT"][i]) for e in ends), F.lit(0.0))
    dh = end(0) + _stacks(s, _VENDOR_H, 0.0)
    ds = end(1) + _stacks(s, _VENDOR_S, 0.0) + F.when(is_palindrome(s), SYMMETRY_S).otherwise(0.0)
    inverse = (ds + R * math.log(dna / 1e9)) / (1000 * dh)
    one, gc, ends_apart = salt_polynomial(na / 1000, mg / 1000, dntp / 1000)
    shift = 1e-5 * (one + gc / F.length(s) + ends_apart / (2 * (F.length(s) - 1)))
    return F.greatest(F.lit(0.0), 1 / (inverse + shift) - KELVIN)
