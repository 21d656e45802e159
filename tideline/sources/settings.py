"""Settings of the plans: one table of defaults, YAML files over it."""

from __future__ import annotations

import copy
from collections.abc import Iterator, Mapping
from typing import Any

import yaml

# Names and defaults of the settings that a plan reads.
DEFAULTS: dict[str, Any] = {
    # command line: what is trained if it isn't said
    "data.symbols": ["SPY"],
    "data.start_date": "2020-01-01",
    "data.end_date": "2023-12-31",
    # plans.ensemble.training_table
    "labeling.pt_sl": [1.0, 1.0],
    "labeling.min_ret": 0.01,
    "labeling.vertical_barrier_days": 5,
    "regime.adx_period": 14,
    "regime.adx_threshold": 25.0,
    "regime.volume_window": 20,
    # plans.ensemble.train
    "model.n_estimators": 100,
    "model.max_depth": 5,
    "model.cv_folds": 5,
    "model.test_size": 0.2,
    "strategy.momentum_lookback": 20,
    "strategy.mean_reversion_zscore": 2.0,
    "strategy.volatility_threshold": 0.02,
    # plans.ensemble.sized
    "allocation.max_position_size": 0.1,
    "allocation.kelly_fraction": 0.25,
    "allocation.volatility_target": 0.15,
    "allocation.leverage_limit": 2.0,
}


def _flat(values: Mapping, before: str = "") -> Iterator[tuple[str, Any]]:
    for key, value in values.items():
        if isinstance(value, Mapping):
            yield from _flat(value, f"{before}{key}.")
        else:
            yield f"{before}{key}", value


class Config:
    """Settings by dotted name: what a file or update() says, else the default.

    A file's other settings are kept, and written again by save(), though no plan
    reads them; unread() names them.
    """

    def __init__(self, values: Mapping | None = None) -> None:
        self.said: dict[str, Any] = dict(_flat(values or {}))

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path) as f:
            return cls(yaml.safe_load(f))

    def save(self, path: str) -> None:
        nested: dict[str, Any] = {}
        for name, value in {**copy.deepcopy(DEFAULTS), **self.said}.items():
            *sections, key = name.split(".")
            at = nested
            for section in sections:
                at = at.setdefault(section, {})
            at[key] = value
        with open(path, "w") as f:
            yaml.safe_dump(nested, f, sort_keys=False)

    def update(self, values: Mapping) -> None:
        self.said.update(_flat(values))

    def get(self, name: str, default: Any = None) -> Any:
        return self.said.get(name, copy.deepcopy(DEFAULTS.get(name, default)))

    def __getitem__(self, name: str) -> Any:
        if name not in self.said and name not in DEFAULTS:
            raise KeyError(name)
        return self.get(name)

    def chosen(self, name: str, default: Any) -> Any:
        """What was said, else a plan's own default, which is another than the table's."""
        return self.said.get(name, default)

    def unread(self) -> list[str]:
        return sorted(set(self.said) - set(DEFAULTS))
