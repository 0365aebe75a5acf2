"""Parameters in YAML files: includes, presets, references between values, and overrides by dotted names.

A tree of parameters is kept flat, as {path: value} with the path a tuple of names. Files, presets and overrides are layers of such maps,
the later over the earlier; references are then put in, each after those that it needs.
"""

from __future__ import annotations

import re
from graphlib import CycleError, TopologicalSorter
from pathlib import Path

_REF = re.compile(r"\$\{([\w.]+)\}")


def flat(tree: dict, at: tuple = ()) -> dict[tuple, object]:
    """Leaves of a tree by path; a list or an empty map is a leaf."""
    out: dict[tuple, object] = {}
    for name, value in tree.items():
        out |= flat(value, (*at, name)) if isinstance(value, dict) and value else {(*at, name): value}
    return out


def tree_of(leaves: dict[tuple, object]) -> dict:
    root: dict = {}
    for path, value in leaves.items():
        node = root
        for name in path[:-1]:
            node = node.setdefault(name, {})
        node[path[-1]] = value
    return root


def layered(layers: list[dict[tuple, object]]) -> dict[tuple, object]:
    """Maps into maps, anything else in place of what was there; an empty map changes no map."""
    out: dict[tuple, object] = {}
    for layer in layers:
        for path, value in layer.items():
            under = [p for p in out if p[: len(path)] == path and p != path]
            if value == {} and under:
                continue
            for p in [*under, *(path[:k] for k in range(1, len(path)))]:
                out.pop(p, None)
            out[path] = value
    return out


def part(leaves: dict[tuple, object], name: str):
    """The value or the map at a dotted name."""
    path = tuple(name.split("."))
    below = {p[len(path) :]: v for p, v in leaves.items() if tuple(map(str, p[: len(path)])) == path}
    if not below:
        raise KeyError(f"no parameter {name}")
    return below[()] if () in below else tree_of(below)


def _names(value) -> list[str]:
    return [n for v in value for n in _names(v)] if isinstance(value, list) else _REF.findall(value) if isinstance(value, str) else []


def resolved(leaves: dict[tuple, object]) -> dict[tuple, object]:
    """References ${a.b} replaced, in lists too; one that is the whole value keeps its type, and may be a map."""
    leaves = dict(leaves)
    needs: dict[tuple, list[tuple]] = {}
    for path, value in leaves.items():
        for name in _names(value):
            at = tuple(name.split("."))
            needs.setdefault(path, []).extend(p for p in leaves if tuple(map(str, p[: len(at)])) == at)
    try:
        order = list(TopologicalSorter(needs).static_order())
    except CycleError as e:
        raise ValueError("references go in a circle") from e

    def put(value):
        if isinstance(value, list):
            return [put(v) for v in value]
        whole = _REF.fullmatch(value) if isinstance(value, str) else None
        if whole:
            return part(leaves, whole[1])
        return _REF.sub(lambda m: str(part(leaves, m[1])), value) if isinstance(value, str) else value

    for path in [*(p for p in order if p in needs), *(p for p, v in leaves.items() if p not in needs and _names(v))]:
        leaves[path] = put(leaves[path])
    return leaves


def _layers(path: Path) -> list[dict[tuple, object]]:
    """The files that a file includes, in their order, and the file itself."""
    import yaml

    tree = yaml.safe_load(path.read_text()) or {}
    included = tree.pop("include", [])
    return [layer for name in included for layer in _layers(path.parent / name)] + [flat(tree)]


def load(path: str, overrides: list[str] = (), preset: str | None = None) -> dict:
    """File with its includes, then a preset of its `presets`, then `a.b=value` overrides (values as YAML), then references."""
    import yaml

    layers = [layered(_layers(Path(path)))]
    if preset:
        layers.append(flat(part(layers[0], f"presets.{preset}")))
    for name, value in (o.split("=", 1) for o in overrides):
        layers.append(flat(tree_of({tuple(name.split(".")): yaml.safe_load(value)})))
    return tree_of(resolved(layered(layers)))
