"""Plain versions that the operators are held against."""

from __future__ import annotations


def components(links: dict[int, set[int]]) -> dict[int, int]:
    """The smallest name reachable from each name."""
    label: dict[int, int] = {}
    for start in sorted(links):
        stack = [start] if start not in label else []
        while stack:
            name = stack.pop()
            if name not in label:
                label[name] = start
                stack += links[name]
    return label
