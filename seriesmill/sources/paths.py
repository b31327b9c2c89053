"""Where a run finds its inputs: an argument, then the environment, then a configuration, then a preset."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Found:
    """A name's path, which of the four gave it (argument, environment, config, preset or none), and whether it is there."""

    name: str
    path: str | None
    origin: str
    exists: bool


def resolve(names: Sequence[str], arguments: Mapping, environment: Mapping, config: Mapping, preset: Mapping, exists: Callable[[str], bool], prefix: str = "SERIESMILL_") -> dict[str, Found]:
    """The first path that is given for each name. Empty texts give none; a path that is not there hides no later one,
    for what was asked for is not replaced silently."""
    out = {}
    for n in names:
        given = (("argument", arguments.get(n)), ("environment", environment.get(prefix + n.upper())), ("config", config.get(n)), ("preset", preset.get(n)))
        origin, path = next(((o, p) for o, p in given if p), ("none", None))
        out[n] = Found(n, path, origin, bool(path) and exists(path))
    return out


def path_report(found: Mapping[str, Found]) -> str:
    """One line per name: its path, where it came from, and whether it is missing."""
    return "\n".join(f"{f.name:<16} {f.path or '-'} ({f.origin}{'' if f.exists else ', missing'})" for f in found.values())
