"""Configuration trees: a file names the one it inherits from, and its own values win."""

from __future__ import annotations

from collections.abc import Callable


def merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def inherited(name: str, load: Callable[[str], dict]) -> dict:
    """The tree `name`, on top of all it inherits from; raises on a circle."""
    chain, seen = [], set()
    while name:
        if name in seen:
            raise ValueError(f"{name} inherits from itself")
        seen.add(name)
        tree = dict(load(name))
        name = tree.pop("inherits", None)
        chain.append(tree)
    out: dict = {}
    for tree in reversed(chain):
        out = merged(out, tree)
    return out
