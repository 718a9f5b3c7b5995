"""Names of columns that are made for a while."""

from __future__ import annotations


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like `names` that no column has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
