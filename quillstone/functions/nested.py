"""Nested Python values: leaves taken out and put back, settings overridden by dotted names."""

from __future__ import annotations

from copy import deepcopy
from typing import Any


def take_leaves(value: Any) -> tuple[list[str], Any]:
    """The non-empty texts of nested lists and dicts in order, and the same shape with their places in the list."""
    leaves: list[str] = []

    def walk(x: Any) -> Any:
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        if isinstance(x, str) and x:
            leaves.append(x)
            return len(leaves) - 1
        return None

    return leaves, walk(value)


def put_leaves(leaves: list[str], shape: Any) -> Any:
    if isinstance(shape, dict):
        return {k: put_leaves(leaves, v) for k, v in shape.items()}
    if isinstance(shape, list):
        return [put_leaves(leaves, v) for v in shape]
    return None if shape is None else leaves[shape]


def override(settings: dict, changes: dict[str, str]) -> dict:
    """Settings with values named like "a.b.c" replaced, brought to the type of the old value; unknown names are errors."""
    out = deepcopy(settings)
    for name, text in changes.items():
        *path, last = name.split(".")
        at = out
        for key in path:
            at = at[key]
        old = at[last]
        if isinstance(old, bool):
            if text.lower() not in ("true", "false"):
                raise ValueError(f"{name} is true or false")
            at[last] = text.lower() == "true"
        else:
            at[last] = text if old is None else type(old)(text)
    return out
