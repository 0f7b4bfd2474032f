"""Suffix order of a short sequence by linear grouping.

Suffixes are grouped by what is known of their longest Lyndon prefix, at first their first symbol. Groups are taken in
descending order. Each member of the taken group points to the nearest suffix to its left that is in a group not yet taken,
its previous smaller one; such a suffix is followed by as many copies of the taken group's prefix as members point to it,
so it leaves its group for a higher one with the longer prefix. When all groups are taken, each holds the suffixes of one
Lyndon prefix, and groups are in order. A second pass places each suffix as soon as the one behind its prefix is placed,
which is always a smaller one. No symbol is renamed and nothing recurs.
"""

from __future__ import annotations


class _Group:
    __slots__ = ("members", "length", "below", "above", "start")

    def __init__(self, members: list[int], length: int):
        self.members, self.length = members, length
        self.below = self.above = None
        self.start = 0


def suffix_order(s: list[int]) -> list[int]:
    """Starts of the suffixes of s in order. s ends with a symbol smaller than all others."""
    n = len(s)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by_symbol.setdefault(c, []).append(i)
    group: list[_Group] = [None] * n  # type: ignore[list-item]
    lowest = below = None
    for c in sorted(by_symbol):
        g = _Group(by_symbol[c], 1)
        for i in g.members:
            group[i] = g
        g.below = below
        if below is None:
            lowest = g
        else:
            below.above = g
        below = g

    previous = [-1] * n
    taken = bytearray(n)
    current = below
    while current is not lowest:
        members = current.members
        members.sort()
        for i in members:
            taken[i] = 1
        counts: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and taken[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        moved: dict[_Group, dict[int, list[int]]] = {}
        for j, k in counts.items():
            moved.setdefault(group[j], {}).setdefault(k, []).append(j)
        for source, by_count in moved.items():
            leaving = sum(map(len, by_count.values()))
            if leaving == len(source.members) and len(by_count) == 1:
                source.length += next(iter(by_count)) * current.length
                continue
            if leaving == len(source.members):
                source.members = []
            else:
                source.members = [j for j in source.members if j not in counts]
            under = source
            for k in sorted(by_count):
                g = _Group(by_count[k], source.length + k * current.length)
                for j in g.members:
                    group[j] = g
                g.below, g.above = under, under.above
                under.above.below = g
                under.above = g
                under = g
        current = current.below

    at, g = 0, lowest
    while g is not None:
        g.start = at
        at += len(g.members)
        g = g.above
    waiting: list[list[int]] = [[] for _ in range(n)]
    order = [-1] * n
    for i in range(n - 1):
        waiting[i + group[i].length if i + group[i].length < n else n - 1].append(i)
    order[0] = n - 1
    for r in range(n):
        for i in waiting[order[r]]:
            g = group[i]
            order[g.start] = i
            g.start += 1
    return order
