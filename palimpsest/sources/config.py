"""Settings from TOML, with silent defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, is_dataclass

from ..functions.scoring import Weights


@dataclass
class Ephemeral:
    max_entries: int = 5


@dataclass
class Pipeline:
    docs_dir: str = ""
    auto_sync: bool = False


@dataclass
class Llm:
    provider: str = ""
    model: str = ""
    api_base: str = ""


@dataclass
class Graph:
    similarity: float = Weights.similarity
    hotness: float = Weights.hotness
    utility: float = Weights.utility

    def weights(self) -> Weights:
        return Weights(self.similarity, self.hotness, self.utility)


@dataclass
class Config:
    ephemeral: Ephemeral = field(default_factory=Ephemeral)
    llm: Llm = field(default_factory=Llm)
    pipeline: Pipeline = field(default_factory=Pipeline)
    graph: Graph = field(default_factory=Graph)


def _fill(into, values: dict):
    for f in fields(into):
        value, now = values.get(f.name), getattr(into, f.name)
        if is_dataclass(now):
            nested = value if isinstance(value, dict) else {}
            _fill(now, {**nested, **nested.get("scoring", {})} if f.name == "graph" else nested)
        elif isinstance(value, bool) == isinstance(now, bool) and isinstance(value, (type(now), int) if isinstance(now, float) else type(now)):
            setattr(into, f.name, type(now)(value))
    return into


def validated(config: Config) -> Config:
    if not 1 <= config.ephemeral.max_entries <= 50:
        config.ephemeral.max_entries = Ephemeral.max_entries
    return config


def loads(text: str) -> Config:
    """The settings of a TOML text; unreadable text and wrong values give defaults."""
    try:
        values = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        values = {}
    return validated(_fill(Config(), values))


def load(path: str) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            return loads(f.read())
    except OSError:
        return Config()


def set_key(config: Config, key: str, value: str) -> Config:
    """`section.name` set from text; an unknown key or a value of another type is an error."""
    section, _, name = key.partition(".")
    part = getattr(config, section, None)
    if part is None or name not in {f.name for f in fields(part)}:
        raise KeyError(key)
    now = getattr(part, name)
    if isinstance(now, bool):
        if value not in ("true", "false"):
            raise ValueError(value)
        setattr(part, name, value == "true")
    else:
        setattr(part, name, type(now)(value))
    if key == "ephemeral.max_entries" and not 1 <= part.max_entries <= 50:
        part.max_entries = now
        raise ValueError(value)
    return config


def dumps(config: Config) -> str:
    out = []
    for f in fields(config):
        out.append(f"[{f.name}]")
        part = getattr(config, f.name)
        for g in fields(part):
            v = getattr(part, g.name)
            out.append(f"{g.name} = " + (str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else repr(v)))
        out.append("")
    return "\n".join(out)
