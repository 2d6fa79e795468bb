"""Suffix arrays by linear grouping.

Suffixes start out grouped by their first symbol. Groups are processed in descending order. Every suffix of a group
gets its previous-smaller pointer: the nearest suffix before it that lies in a lower group, found by following
pointers of suffixes in between. The suffixes so pointed at extend their own prefix by the group's: those with more
pointers from the group are the greater, and each set that shares a group is split off as a new group right above the
rest. In the end a group holds the suffixes that share a Lyndon prefix. One sweep then emits the order: the suffix
before each placed one, and on along its pointers, goes to the next free place of its group. Nothing is renamed or
solved recursively.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes in order. text: integers of at least 1; the end counts as smaller than any of them."""
    n = len(text) + 1
    order: list[int] = []  # suffixes by group
    by_symbol: dict[int, list[int]] = {0: [n - 1]}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    group = [0] * n  # of a suffix: its group, named by its first place
    size = [0] * n  # of a group
    for c in sorted(by_symbol):
        held, first = by_symbol[c], len(order)
        size[first] = len(held)
        for i in held:
            group[i] = first
        order += held
    place = [0] * n
    for k, i in enumerate(order):
        place[i] = k
    before = [-1] * n  # previous-smaller pointers
    end = n
    while end > 1:
        # The highest group not processed yet ends here.
        g = group[order[end - 1]]
        held = order[g:end]
        end = g
        if len(held) == 1:
            i = held[0]
            p = i - 1
            while p >= 0 and group[p] > g:
                p = before[p]
            before[i] = p
            if p >= 0:
                h = group[p]
                last = size[h] - 1
                if last:
                    # Swap p to its group's last place, which becomes a group of its own.
                    size[h] = last
                    last += h
                    q, k = order[last], place[p]
                    order[k], order[last] = q, p
                    place[q], place[p] = k, last
                    group[p], size[last] = last, 1
            continue
        held.sort()
        pointed: dict[int, int] = {}
        for i in held:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        sets: dict[int, list[int]] = {}
        for p, times in pointed.items():
            sets.setdefault(times, []).append(p)
        for times in sorted(sets, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in sets[times]:
                moved.setdefault(group[p], []).append(p)
            for h, ps in moved.items():
                left = size[h] - len(ps)
                if not left:
                    continue  # all of it moves: it stays the group that it is
                size[h] = left
                fresh = h + left
                last = fresh + len(ps)
                for p in ps:
                    last -= 1
                    q, k = order[last], place[p]
                    if q != p:
                        order[k], order[last] = q, p
                        place[q], place[p] = k, last
                    group[p] = fresh
                size[fresh] = len(ps)
    del order, place, size, by_symbol
    free = list(range(n))  # of a group: its next free place
    out = [-1] * n
    out[0] = n - 1
    free[0] = 1
    done = [False] * n
    done[n - 1] = True
    for k in range(n):
        p = out[k] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            at = free[g]
            out[at] = p
            done[p] = True
            free[g] = at + 1
            p = before[p]
    return out[1:]
