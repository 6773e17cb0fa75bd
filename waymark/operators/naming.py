"""Names for helper columns that no column of the user's has."""

from __future__ import annotations


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores in front where a column is called so already (letter case does not tell columns apart)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
