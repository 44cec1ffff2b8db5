"""Suffix arrays in linear time by grouping, without recursion and without renaming.

First, suffixes are grouped by their longest Lyndon prefix. Groups start as equal symbols and are taken in
descending order; for each suffix of a group, its previous-smaller pointer names the nearest suffix before it
that lies in a lower group, and suffixes named equally often move together into a new group right above
their old one. Then one pass emits the order: each emitted suffix places the suffix before it, and that
one's chain of previous-smaller pointers, at the next free places of their groups.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of `text` in ascending order."""
    n = len(text)
    symbols = {s: g for g, s in enumerate(sorted(set(text)))}
    group = [symbols[s] for s in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    below, above = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))  # neighbours in order
    done = [False] * len(symbols)
    previous = [-1] * n
    order = []
    now = len(symbols) - 1
    while now >= 0:
        done[now] = True
        order.append(now)
        named: dict[int, int] = {}
        for i in members[now]:
            if group[i] == now:
                p = i - 1
                while p >= 0 and done[group[p]]:
                    p = previous[p]
                previous[i] = p
                if p >= 0:
                    named[p] = named.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, times in named.items():
            moved.setdefault((-times, group[p]), []).append(p)
        for times, old in sorted(moved):  # the more often named ones first, so they end up higher
            new, who = len(done), sorted(moved[times, old])
            done.append(False)
            members.append(who)
            below.append(old)
            above.append(above[old])
            below[above[old]] = new
            above[old] = new
            for p in who:
                group[p] = new
        now = below[now]
    start, free = {}, 1
    size = [0] * len(done)
    for g in group:
        size[g] += 1
    for g in reversed(order):
        start[g] = free
        free += size[g]
    out = [n] + [-1] * n
    placed = [False] * n
    for k in range(n + 1):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            out[start[group[j]]] = j
            start[group[j]] += 1
            j = previous[j]
    return out[1:]


def common_prefixes(text: Sequence[int], order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in `order` with the one before it (0 for the first)."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out, h = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out
