"""Suffix array of bytes by linear grouping.

First each suffix is put into the group of its Lyndon prefix, the groups standing in the order of these words. Groups are taken in descending
order: a suffix of the group points to the nearest suffix before it that is in a smaller group, and the suffixes pointed to move to new groups
right behind their old ones, by how often they are pointed to, as their Lyndon prefixes grow by the group's word. Then the order is emitted
from the smallest suffix up: each emitted suffix releases the one before it in the text and, along the pointers, those that must come
first in their groups. No suffix is ranked anew by recursion.
"""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of text in their order; an empty text has none."""
    n = len(text)
    if not n:
        return []
    # groups as intervals of `sa`: first[s] is where the group of suffix s begins, place[s] where s stands, size[begin] how many it has
    counts = [0] * 256
    for c in text:
        counts[c] += 1
    begins, at = [0] * 256, 0
    size = [0] * n
    for c in range(256):
        begins[c] = at
        if counts[c]:
            size[at] = counts[c]
        at += counts[c]
    sa, first, place, fill = [0] * n, [0] * n, [0] * n, begins[:]
    for s, c in enumerate(text):
        k = fill[c]
        fill[c] = k + 1
        sa[k], place[s], first[s] = s, k, begins[c]
    smaller = [-1] * n
    top = n - 1
    while top >= 0:
        begin = first[sa[top]]
        members = sa[begin : top + 1]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and first[p] >= begin:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, times in pointed.items():
            by_times.setdefault(times, []).append(p)
        for times in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}
            for p in by_times[times]:  # to the end of its group
                home = first[p]
                k = home + size[home] - 1 - moved.get(home, 0)
                other, here = sa[k], place[p]
                sa[k], sa[here], place[p], place[other] = p, other, k, here
                moved[home] = moved.get(home, 0) + 1
            for home, m in moved.items():
                end = home + size[home]
                size[home] -= m
                size[end - m] = m
            for p in by_times[times]:
                home = first[p]
                first[p] = home + size[home] if moved[home] and size[home] and place[p] >= home + size[home] else home
        top = begin - 1
    out, released = [-1] * n, [False] * n
    slot = list(range(n))
    for k in range(-1, n):
        p = (n if k < 0 else out[k]) - 1
        while p >= 0 and not released[p]:
            released[p] = True
            begin = first[p]
            out[slot[begin]] = p
            slot[begin] += 1
            p = smaller[p]
    return out
