"""Parameters of the change-history operators, all overridable."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Thresholds and half-life; times are in days, shares between 0 and 1."""

    max_commit_files: int = 50
    half_life_days: float = 365.0
    min_cochange_n: int = 3
    min_lift: float = 1.5
    ghost_min_lifetime_days: int = 90
    ghost_min_cochanges_since: int = 2
    ghost_min_conf_since: float = 0.25
    rename_threshold: float = 0.5
    import_only_ratio: float = 0.9
    exclude_merges: bool = False


#: What the synthetic star schema needs for every gate to let something through.
TESTDATA = Params(max_commit_files=8, ghost_min_lifetime_days=1, ghost_min_conf_since=0.002)
