"""Suffix arrays by linear grouping construction (kernel of operator 1, no Spark).

First phase: suffixes start in groups of equal first symbols.  Groups are taken
in descending order; each suffix of a group looks up its previous smaller
position (the nearest one to the left whose group is lower), and those positions
move to a new group right above the rest of theirs, as the text they stand for now
ends with the group's prefix.  At the end a group holds the suffixes with one
longest Lyndon prefix, and groups are in that prefix's order.

Second phase: from the least suffix on, the position before each and the chain of
its previous smaller pointers are next in their groups, which emits every group
in order.  No suffix is renamed and nothing recurses."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Start positions of all suffixes in ascending order; a suffix is less than its extensions."""
    n = len(text)
    if n == 0:
        return []
    # A least symbol ends the text; its suffix is dropped in the end.
    order = sorted(range(n), key=text.__getitem__)
    slots = [n, *order]                         # positions, group after group
    slot = [0] * (n + 1)
    for k, s in enumerate(slots):
        slot[s] = k
    group = [0] * (n + 1)                       # of a position: the first slot of its group
    size = [0] * (n + 1)                        # of a group, by its first slot
    begin, last = 0, None
    size[0] = 1
    for k in range(1, n + 1):
        s = slots[k]
        if text[s] != last:
            begin, last = k, text[s]
        group[s] = begin
        size[begin] += 1
    prev = [-1] * (n + 1)                       # previous smaller position

    end = n + 1
    while end > 0:
        begin = group[slots[end - 1]]
        members = sorted(slots[begin:end])
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = prev[p]                     # same group: taken before s, as members are in text order
            prev[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            by: dict[int, list[int]] = {}
            for p, k in times.items():
                by.setdefault(k, []).append(p)
            # Positions followed by more copies of the prefix are greater, so they move to the upper end first.
            for k in sorted(by, reverse=True):
                olds = []
                for p in by[k]:
                    g = group[p]
                    size[g] -= 1
                    to, here = g + size[g], slot[p]
                    other = slots[to]
                    slots[here], slots[to] = other, p
                    slot[other], slot[p] = here, to
                    olds.append(g)
                for p, g in zip(by[k], olds):
                    new = g + size[g]
                    group[p] = new
                for p in by[k]:
                    size[group[p]] += 1
        end = begin

    out = [-1] * (n + 1)
    out[0] = n
    placed = [False] * (n + 1)
    placed[n] = True
    front = list(range(n + 1))                  # next free slot of a group, by its first slot
    for k in range(n + 1):
        p = out[k] - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[front[g]] = p
            front[g] += 1
            placed[p] = True
            p = prev[p]
    return out[1:]


def longest_common(text: list[int], order: list[int], weight: list[int]) -> list[int]:
    """Summed weight of the symbols that order[k] and order[k - 1] have in common, for each k (0 for the first)."""
    n = len(text)
    rank = [0] * n
    for k, s in enumerate(order):
        rank[s] = k
    before = [0] * (n + 1)
    for i, w in enumerate(weight):
        before[i + 1] = before[i] + w
    out = [0] * n
    h = 0
    for s in range(n):
        k = rank[s]
        if k == 0:
            h = 0
            continue
        t = order[k - 1]
        while s + h < n and t + h < n and text[s + h] == text[t + h]:
            h += 1
        out[k] = before[s + h] - before[s]
        if h:
            h -= 1
    return out
