"""Secondary structure of pairs by dynamic programming, in Arrow batches."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.functions.thermo import ENTHALPY, ENTROPY

# Penalties of a bulge of one base and of one mismatch inside a helix, in kcal/mol.
BULGE, MISMATCH = 3.3, 1.0
_PAIR = {"A": "T", "C": "G", "G": "C", "T": "A"}


def heterodimer(a: str, b: str, celsius: float = 37.0) -> tuple[float, float, int]:
    """Energy, melting point and paired bases of the best duplex of ``a`` with ``b`` read backwards.

    A helix grows by a stacked pair, across one mismatch, or across a bulge of
    one base on either strand.
    """
    back = b[::-1]
    n, m = len(a), len(back)
    t = celsius + 273.15
    best = (0.0, 0.0, 0.0, 0)  # energy, enthalpy, entropy, pairs
    cells: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for i in range(n):
        for j in range(m):
            if _PAIR.get(a[i]) != back[j]:
                continue
            here = (0.0, 0.0, 0.0, 1)
            for di, dj, cost in ((1, 1, 0.0), (2, 2, MISMATCH), (2, 1, BULGE), (1, 2, BULGE)):
                old = cells.get((i - di, j - dj))
                if old is None:
                    continue
                key = a[i - di] + a[i]
                h, s = (ENTHALPY[key], ENTROPY[key]) if cost == 0 else (ENTHALPY[key] / 2 + cost, ENTROPY[key] / 2)
                dh, ds = old[1] + h, old[2] + s
                new = (dh - t * ds / 1000, dh, ds, old[3] + 1)
                if new[0] < here[0]:
                    here = new
            cells[i, j] = here
            if here[0] < best[0]:
                best = here
    if not best[3]:
        return 0.0, 0.0, 0
    tm = 1000 * (best[1] + 0.2) / (best[2] - 5.7 + 1.987 * np.log(0.25e-6)) - 273.15
    return best[0], float(tm), best[3]


def severity(energy: float, tm: float, pairs: int, celsius: float) -> float:
    if energy >= -9:
        return 0.0
    clip = lambda x: min(1.0, max(0.0, x))
    return 0.4 * clip((-energy - 9) / 15) + 0.4 * clip((tm - celsius) / 20) + 0.2 * min(1.0, pairs / 10)


def heterodimers(pairs: DataFrame, celsius: float = 30.0) -> DataFrame:
    """``a, b, energy, tm, paired, severity`` of a table of pairs."""

    @F.pandas_udf("energy double, tm double, paired int, severity double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [heterodimer(x, y) for x, y in zip(a, b)]
        return pd.DataFrame([(e, t, p, severity(e, t, p, celsius)) for e, t, p in rows], columns=["energy", "tm", "paired", "severity"])

    return pairs.select("a", "b", run("a", "b").alias("x")).select("a", "b", "x.*")


def stable(primers: DataFrame, worst: float = 0.3) -> DataFrame:
    """Primers whose duplex with themselves stays below a severity."""
    own = heterodimers(primers.select(F.col("primer").alias("a"), F.col("primer").alias("b")))
    return own.where(F.col("severity") <= worst).select(F.col("a").alias("primer"))
