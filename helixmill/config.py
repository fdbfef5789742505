"""Parameters of the design pipeline: a frozen record with checks, no module state."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, fields, replace

# Default range of k by polymerase.
K_RANGE = {"phi29": (6, 12), "equiphi29": (10, 18), "bst": (15, 25), "klenow": (8, 15)}


@dataclass(frozen=True)
class Config:
    polymerase: str = "phi29"
    min_k: int = 6
    max_k: int = 12
    min_fg_freq: float = 1e-5
    max_bg_freq: float = 5e-6
    min_tm: float = 15.0
    max_tm: float = 45.0
    max_gini: float = 0.6
    max_primer: int = 500
    gc_min: float = 0.375
    gc_max: float = 0.625
    max_dimer_bp: int = 3
    max_self_dimer_bp: int = 4
    na_conc: float = 50.0
    mg_conc: float = 0.0
    temperature: float = 30.0
    bin_size: int = 10_000
    target_set_size: int = 6
    seed: int = 42

    def __post_init__(self):
        problems = []
        if self.polymerase not in K_RANGE:
            problems.append(f"polymerase must be one of {', '.join(K_RANGE)}")
        if not 1 <= self.min_k <= self.max_k <= 31:
            problems.append("1 <= min_k <= max_k <= 31")
        if not 0 <= self.gc_min <= self.gc_max <= 1:
            problems.append("0 <= gc_min <= gc_max <= 1")
        if self.min_tm > self.max_tm:
            problems.append("min_tm <= max_tm")
        if self.max_primer < 1 or self.bin_size < 1 or self.target_set_size < 1:
            problems.append("max_primer, bin_size and target_set_size are positive")
        if self.na_conc <= 0 or self.mg_conc < 0:
            problems.append("na_conc is positive, mg_conc not negative")
        if problems:
            raise ValueError("; ".join(problems))

    @classmethod
    def for_polymerase(cls, name: str, **more) -> Config:
        lo, hi = K_RANGE[name]
        return cls(polymerase=name, **({"min_k": lo, "max_k": hi, "max_dimer_bp": max(3, hi // 4), "max_self_dimer_bp": max(4, int(0.28 * hi))} | more))

    @classmethod
    def read(cls, path: str) -> Config:
        """From JSON; keys that are not parameters here are named in a warning, so that a misspelt one is seen."""
        with open(path) as f:
            given = json.load(f)
        known = {f.name for f in fields(cls)}
        if other := sorted(set(given) - known):
            warnings.warn(f"not used: {', '.join(other)}", stacklevel=2)
        return cls(**{k: v for k, v in given.items() if k in known})

    def with_(self, **changes) -> Config:
        return replace(self, **changes)
