"""Settings of a workspace: YAML files, each value judged by a rule of one line.

A rule says what kind of value a setting takes and from which interval. What has
no rule, lacks, or breaks its rule is an error, and all errors of a file are
told at once. Costs may be overstated but never understated, fills are at the
next open, accounts are long-only and hold cash."""

from __future__ import annotations

import hashlib
import json
import logging
import math
import os
import re
import subprocess
import sys
import time
from collections.abc import Iterator, Mapping
from pathlib import Path
from typing import Any

import yaml

from barloom.operators import ledger

HOME = "BARLOOM_HOME"
LOGGER = "barloom"

#: The settings of each file, by their rules. `else` names what holds where a setting is left out.
RULES: dict[str, dict[str, str]] = {
    "general": {
        "timezone": "one of UTC",
        "log_level": "text else INFO",
        "root_seed": "whole",
    },
    "data": {
        "frequency": "one of daily",
        "benchmark_symbol": "text",
        "universe": "texts",
        "validation.max_consecutive_gap_days": "whole in [1, inf)",
        "validation.spike_zscore": "number in (0, inf)",
        "validation.min_avg_volume": "number in [0, inf)",
        "validation.min_bars": "whole in [50, inf)",
    },
    "backtest": {
        "initial_capital": "number in (0, inf)",
        "fill_policy": "one of next_bar_open",
        "cash_account": "one of true",
        "allow_short": "one of false",
        "costs.commission_per_share": "number in [0, inf)",
        "costs.min_commission": "number in [0, inf)",
        "costs.half_spread_bps": "number in [0, inf)",
        "costs.impact_coeff": "number in [0, inf)",
        "costs.pessimism_multiplier": "number in [1, inf)",
        "sizing.risk_per_trade_pct": "number in (0, 2]",
        "sizing.atr_period": "whole in [2, inf)",
        "sizing.atr_stop_mult": "number in (0, inf)",
        "sizing.max_position_pct": "number in (0, 25]",
    },
    "validation": {
        "walkforward.scheme": "one of rolling",
        "walkforward.train_bars": "whole in [100, inf)",
        "walkforward.test_bars": "whole in [20, inf)",
        "walkforward.embargo_bars": "whole or auto else auto",
        "montecarlo.n_paths": "whole in [100, inf)",
        "montecarlo.block_len": "whole or auto else auto",
        "montecarlo.ruin_drawdown_pct": "number in (0, 100)",
        "montecarlo.cost_stress_multipliers": "rising numbers in [1, inf)",
        "montecarlo.delay_stress_bars": "wholes",
        "montecarlo.perturbation_samples": "whole in [1, inf)",
        "gates.min_oos_trades": "whole in [1, inf)",
        "gates.min_wf_efficiency": "number",
        "gates.dsr_min": "number",
        "gates.cost_breakeven_min": "number in [1, inf)",
        "gates.require_delay_survival": "flag",
        "gates.min_positive_regimes": "whole in [0, 3]",
        "gates.max_single_regime_pnl_share": "number in (0, 1]",
        "gates.min_neighbor_sharpe_ratio": "number in [0, inf)",
    },
    "strategy": {
        "name": "text",
        "version": "whole in [1, inf)",
        "universe": "texts",
        "params": "table",
    },
}
_RULE = re.compile(
    r"(?P<kind>one of \w+|rising numbers|[a-z]+)( in (?P<open>[\[(])(?P<low>[^,]+), (?P<high>[^\])]+)(?P<close>[\])]))?( or (?P<word>\w+))?( else (?P<default>\w+))?"
)


class Settings(Mapping):
    """Values by name, also as attributes; they don't change."""

    def __init__(self, values: dict[str, Any]):
        object.__setattr__(self, "_values", {k: Settings(v) if isinstance(v, dict) else v for k, v in values.items()})

    def __getitem__(self, name: str) -> Any:
        return self._values[name]

    def __getattr__(self, name: str) -> Any:
        try:
            return self._values[name]
        except KeyError:
            raise AttributeError(name) from None

    def __setattr__(self, name: str, value: Any) -> None:
        raise TypeError(f"settings don't change: {name}")

    def __iter__(self) -> Iterator[str]:
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)

    def plain(self) -> dict[str, Any]:
        return {k: v.plain() if isinstance(v, Settings) else v for k, v in self._values.items()}

    def digest(self) -> str:
        return hashlib.sha256(canonical(self.plain()).encode()).hexdigest()


def _judge(rule: re.Match, value: Any) -> tuple[Any, str | None]:
    """(the value as it is used, what is wrong with it)."""
    kind, word = rule["kind"], rule["word"]
    if word is not None and value == word:
        return value, None
    number = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    whole = number and float(value).is_integer()
    if kind.startswith("one of "):
        return value, None if str(value).lower() == kind[7:].lower() else f"can only be {kind[7:]}"
    if kind == "text":
        return value, None if isinstance(value, str) else "is to be a text"
    if kind == "flag":
        return value, None if isinstance(value, bool) else "is to be true or false"
    if kind == "table":
        return value, None if isinstance(value, dict) else "is to be a table"
    if kind in ("texts", "wholes", "rising numbers"):
        if not isinstance(value, list) or not value:
            return value, "is to be a list that isn't empty"
        one = _RULE.fullmatch({"texts": "text", "wholes": "whole"}.get(kind) or rule[0].replace("rising numbers", "number"))
        judged = [_judge(one, v) for v in value]
        wrong = next((w for _, w in judged if w), None)
        return (sorted(v for v, _ in judged) if kind.startswith("rising") and not wrong else [v for v, _ in judged]), wrong and f"holds what {wrong}"
    if not (whole if kind == "whole" else number):
        return value, f"is to be a {'whole number' if kind == 'whole' else 'number'}"
    if rule["low"] is not None:
        low, high = float(rule["low"]), float(rule["high"])
        if value < low or value > high or (value == low and rule["open"] == "(") or (value == high and rule["close"] == ")"):
            return value, f"is outside {rule['open']}{rule['low']}, {rule['high']}{rule['close']}"
    return int(value) if kind == "whole" else float(value), None


def judged(section: str, given: Any) -> Settings:
    """The settings of a section; ValueError with all that is wrong."""
    flat: dict[str, Any] = {}

    def walk(table: Any, at: str) -> None:
        for name, value in table.items():
            key = f"{at}{name}"
            if isinstance(value, dict) and key not in RULES[section]:
                walk(value, f"{key}.")
            else:
                flat[key] = value

    if not isinstance(given, dict):
        raise ValueError(f"{section}: the file holds no table of settings")
    walk(given, "")
    wrong = [f"{key} is unknown" for key in flat if key not in RULES[section]]
    out: dict[str, Any] = {}
    for key, text in RULES[section].items():
        rule = _RULE.fullmatch(text)
        if key not in flat and rule["default"] is None:
            wrong.append(f"{key} is missing")
            continue
        value, error = _judge(rule, flat[key]) if key in flat else (rule["default"], None)
        if error:
            wrong.append(f"{key} {error}: {value!r}")
        *tables, name = key.split(".")
        at = out
        for t in tables:
            at = at.setdefault(t, {})
        at[name] = value
    if wrong:
        raise ValueError(f"{section}: " + "; ".join(wrong))
    return Settings(out)


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def section(folder: Path, name: str, file: str | None = None) -> Settings:
    """One section from its file in `folder`."""
    at = folder / (file or {"general": "global.yaml"}.get(name, f"{name}.yaml"))
    try:
        text = at.read_text("utf-8")
    except FileNotFoundError:
        raise FileNotFoundError(f"no settings at {at}") from None
    return judged(name, yaml.safe_load(text))


def load(folder: Path, name: str, version: int) -> Settings:
    """Everything that an experiment with this strategy is set to."""
    files = {"strategy": f"strategies/{name}@{version}.yaml"}
    return Settings({k: section(folder, k, files.get(k)).plain() for k in RULES})


def account(backtest: Settings) -> ledger.Account:
    return ledger.Account(backtest.initial_capital, ledger.Costs(**backtest.costs), ledger.Sizing(**backtest.sizing))


class Workspace:
    """Folders of a research workspace."""

    def __init__(self, root: str | Path | None = None):
        self.root = Path(root or os.environ.get(HOME) or ".").resolve()
        self.configs, self.catalog, self.artifacts = self.root / "configs", self.root / "catalog", self.root / "artifacts"
        self.raw, self.curated, self.snapshots = (self.root / "datastore" / k for k in ("raw", "curated", "snapshots"))

    def create(self) -> Workspace:
        for folder in (self.configs / "strategies", self.catalog, self.artifacts, self.raw, self.curated, self.snapshots):
            folder.mkdir(parents=True, exist_ok=True)
        for name, text in DEFAULTS.items():
            if not (self.configs / name).exists():
                (self.configs / name).write_text(text, "utf-8")
        return self


def git_state(root: Path) -> tuple[str, bool]:
    """(commit, whether anything is uncommitted); without git: nogit, dirty."""
    try:
        head, state = (subprocess.run(["git", *a], cwd=root, capture_output=True, text=True, timeout=10) for a in (("rev-parse", "HEAD"), ("status", "--porcelain")))
    except (OSError, subprocess.TimeoutExpired):
        return "nogit", True
    return (head.stdout.strip(), bool(state.stdout.strip())) if head.returncode == 0 else ("nogit", True)


def _is_tracked(root: Path, name: str) -> bool:
    """Whether git keeps the file; without git it doesn't."""
    try:
        listed = subprocess.run(["git", "ls-files", "--", name], cwd=root, capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return False
    return listed.returncode == 0 and bool(listed.stdout.strip())


def load_secrets(root: Path) -> list[str]:
    """NAME=value lines of the workspace's .env go into the environment, where it hasn't that name yet; gives the names set.

    A file under version control is refused: what it holds is no secret any more."""
    file, names = root / ".env", []
    if not file.is_file():
        return names
    if _is_tracked(root, ".env"):
        raise RuntimeError("secrets under version control: untrack .env, and change what it holds")
    for line in file.read_text("utf-8").splitlines():
        m = re.fullmatch(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*", line)
        if m and not line.lstrip().startswith("#") and m[1] not in os.environ:
            value = m[2]
            os.environ[m[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value.split(" #")[0].rstrip()
            names.append(m[1])
    return names


def logger(name: str = "", level: str | None = None) -> logging.Logger:
    """A logger below the package's own, which writes to stderr in UTC; `level` sets how much it says."""
    own = logging.getLogger(LOGGER)
    if not any(getattr(h, "barloom", False) for h in own.handlers):
        handler = logging.StreamHandler(sys.stderr)
        handler.barloom = True
        line = logging.Formatter("{asctime}Z {levelname:7} {name}: {message}", "%Y-%m-%dT%H:%M:%S", style="{")
        line.converter = time.gmtime
        handler.setFormatter(line)
        own.addHandler(handler)
    if level is not None:
        own.setLevel(level.upper())
    return own.getChild(name) if name else own


#: The shipped settings, fixed values.
DEFAULTS = {
    "global.yaml": "timezone: UTC\nlog_level: INFO\nroot_seed: 20260610\n",
    "data.yaml": "frequency: daily\nbenchmark_symbol: SPY\nuniverse: [SPY, AAPL, MSFT, JNJ, XOM]\nvalidation:\n  max_consecutive_gap_days: 5\n  spike_zscore: 8.0\n  min_avg_volume: 10000\n  min_bars: 300\n",
    "backtest.yaml": "initial_capital: 100000.0\nfill_policy: next_bar_open\ncash_account: true\nallow_short: false\ncosts:\n  commission_per_share: 0.005\n  min_commission: 1.0\n  half_spread_bps: 2.5\n  impact_coeff: 0.1\n  pessimism_multiplier: 1.5\nsizing:\n  risk_per_trade_pct: 0.5\n  atr_period: 14\n  atr_stop_mult: 3.0\n  max_position_pct: 10.0\n",
    "validation.yaml": "walkforward:\n  scheme: rolling\n  train_bars: 756\n  test_bars: 126\n  embargo_bars: auto\nmontecarlo:\n  n_paths: 2000\n  block_len: auto\n  ruin_drawdown_pct: 15.0\n  cost_stress_multipliers: [1.0, 1.5, 2.0, 3.0]\n  delay_stress_bars: [1]\n  perturbation_samples: 8\ngates:\n  min_oos_trades: 30\n  min_wf_efficiency: 0.5\n  dsr_min: 0.0\n  cost_breakeven_min: 1.5\n  require_delay_survival: true\n  min_positive_regimes: 2\n  max_single_regime_pnl_share: 0.8\n  min_neighbor_sharpe_ratio: 0.25\n",
    "strategies/sma_cross@1.yaml": "name: sma_cross\nversion: 1\nuniverse: [AAPL, MSFT, JNJ, XOM]\nparams: {fast: 20, slow: 100}\n",
    "strategies/rsi_meanrev@1.yaml": "name: rsi_meanrev\nversion: 1\nuniverse: [AAPL, MSFT, JNJ, XOM]\nparams: {rsi_n: 2, buy_below: 10, exit_above: 60, trend_sma: 200}\n",
    "strategies/tsmom@1.yaml": "name: tsmom\nversion: 1\nuniverse: [AAPL, MSFT, JNJ, XOM]\nparams: {lookback: 252, skip: 21}\n",
}
