"""Configuration and agents: driver-side control, no data."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field
from pathlib import Path

MOST_DEPTH = 64


class ConfigError(ValueError):
    def __init__(self, code: str, **details):
        super().__init__(code)
        self.payload = {"ok": False, "error": code, **details}


def merged(base: dict, over: dict) -> dict:
    """base with over laid on it, object by object."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def _deep(value, most: int) -> bool:
    level, rest = 0, [value]
    while rest:
        level += 1
        if level > most:
            return True
        rest = [c for v in rest if isinstance(v, (dict, list)) for c in (v.values() if isinstance(v, dict) else v) if isinstance(c, (dict, list))]
    return False


def read_config(path: str | Path, source: str) -> dict:
    try:
        value = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise ConfigError(f"{source}_missing", path=str(path)) from None
    except UnicodeDecodeError:
        raise ConfigError(f"{source}_not_utf8", path=str(path)) from None
    except json.JSONDecodeError as e:
        raise ConfigError(f"{source}_invalid_json", path=str(path), line=e.lineno, column=e.colno) from None
    except RecursionError:
        raise ConfigError(f"{source}_too_deep", path=str(path)) from None
    if not isinstance(value, dict):
        raise ConfigError(f"{source}_not_an_object", path=str(path))
    if _deep(value, MOST_DEPTH):
        raise ConfigError(f"{source}_too_deep", path=str(path))
    return value


def load_config(default: str | Path, local: str | Path | None = None, overrides: dict | None = None) -> dict:
    """The default file, a local one on it, and given values on both."""
    out = read_config(default, "config")
    if local is not None:
        out = merged(out, read_config(local, "local_override"))
    return merged(out, overrides or {})


@dataclass(frozen=True)
class Agent:
    name: str
    lanes: frozenset[str]
    cap: int
    available: bool = True

    def __post_init__(self):
        if isinstance(self.cap, bool) or not isinstance(self.cap, int) or self.cap < 1:
            raise ConfigError("agent_cap_invalid", agent=self.name)


@dataclass
class Agents:
    """Registered agents in order; `rows` makes them a table for the dispatch operators."""

    agents: list[Agent] = field(default_factory=list)

    def register(self, agent: Agent) -> None:
        if any(a.name == agent.name for a in self.agents):
            raise ConfigError("agent_registered_twice", agent=agent.name)
        self.agents.append(agent)

    def resolve(self, lane: str, preferred: list[str] | None = None, forced: str | None = None) -> Agent | None:
        """The forced agent, else the first preferred that is there, else the first registered."""
        fit = [a for a in self.agents if lane in a.lanes and a.available]
        if forced is not None:
            return next((a for a in fit if a.name == forced), None)
        return next((a for p in preferred or [] for a in fit if a.name == p), fit[0] if fit else None)

    def rows(self, spark):
        return spark.createDataFrame([(a.name, lane, a.available, i, a.cap) for i, a in enumerate(self.agents) for lane in sorted(a.lanes)], "agent string, lane_id string, available boolean, registered int, cap int")
