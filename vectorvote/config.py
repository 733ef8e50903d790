"""Parameters, checked when they are made."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields

#: Fixed values of the data format: dimensions of a feature vector, quantisation scale, range of a quantised value, block width.
DIMENSIONS, SCALE, BLOCK_LANES = 14, 10_000, 8
QUANTISED_MIN, QUANTISED_MAX = -32_768, 32_767
FRAUD, LEGIT = "fraud", "legit"


class ConfigError(ValueError):
    """Parameters that can't be used."""


@dataclass(frozen=True)
class NormalizationConfig:
    """Upper ends of the features' ranges.  Only amount_vs_avg_ratio divides without a guard, so it must be positive."""

    max_amount: float
    max_installments: float
    amount_vs_avg_ratio: float
    max_minutes: float
    max_km: float
    max_tx_count_24h: float
    max_merchant_avg_amount: float

    def __post_init__(self):
        for f in fields(self):
            if not isinstance(getattr(self, f.name), (int, float)):
                raise ConfigError(f"{f.name} must be a number")
        if not self.amount_vs_avg_ratio > 0:
            raise ConfigError("amount_vs_avg_ratio must be positive")

    @classmethod
    def load(cls, path: str) -> NormalizationConfig:
        """From a JSON object with all seven numbers; other keys are ignored."""
        raw = load_json(path)
        try:
            return cls(**{f.name: raw[f.name] for f in fields(cls)})
        except (KeyError, TypeError) as e:
            raise ConfigError(f"{path}: missing {e}") from e


UNKNOWN_MCC_RISK = 0.5


@dataclass(frozen=True)
class SearchConfig:
    """Lists probed for every query, and in all for undecided ones; k neighbours; approved below `threshold`."""

    nprobe: int = 32
    fast_nprobe: int = 8
    k: int = 5
    threshold: float = 0.6
    probe_until_k: bool = False
    compat_bound: bool = False

    def __post_init__(self):
        if min(self.nprobe, self.fast_nprobe, self.k) < 1:
            raise ConfigError("nprobe, fast_nprobe and k must be at least 1")

    def full(self, clusters: int) -> int:
        return max(1, min(self.nprobe, clusters))

    def fast(self, clusters: int) -> int:
        return max(1, min(self.fast_nprobe, self.full(clusters)))

    def undecided(self) -> tuple[int, int]:
        """The two vote counts on either side of the threshold."""
        import math

        high = math.ceil(self.threshold * self.k)
        return high - 1, high

    @classmethod
    def from_env(cls, env=None, **other) -> SearchConfig:
        """NPROBE and FAST_NPROBE: trimmed, empty is unset; other values than positive integers are errors."""
        env = os.environ if env is None else env
        found = {}
        for name in ("nprobe", "fast_nprobe"):
            raw = (env.get(name.upper()) or "").strip()
            if raw:
                if not raw.isdecimal() or int(raw) == 0:
                    raise ConfigError(f"{name.upper()} must be a positive integer, not {raw!r}")
                found[name] = int(raw)
        return cls(**found, **other)


@dataclass(frozen=True)
class TrainConfig:
    """k-means: clusters, size of the seeding sample, rounds, and when changes are few enough: max(n / 10,000, min_changes) from round `stop_from` on."""

    clusters: int = 2_048
    sample: int = 50_000
    rounds: int = 25
    min_changes: int = 8
    stop_from: int = 1
    #: Fixed value: the sample's seed.
    seed: int = 0x51F1_2026_D15C_A11E
    require_enough: bool = False

    @classmethod
    def offline(cls, **other) -> TrainConfig:
        """The preset of the offline builder."""
        return cls(**{"clusters": 4_096, "min_changes": 128, "stop_from": 2, "require_enough": True} | other)


def load_json(path: str):
    try:
        with open(path) as f:
            return json.load(f)
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
