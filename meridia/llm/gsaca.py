"""Linear grouping suffix sorting: Lyndon-prefix groups in descending order, then each group's order, no renaming."""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """The starts of text's suffixes in lexicographic order (a suffix sorts before those that it is a prefix of).

    First part. Suffixes are grouped by their first byte. Groups are taken from the greatest down; when one is taken,
    its members' common context is their Lyndon prefix. Each member's previous-smaller pointer goes to the nearest
    suffix before it that isn't yet in a taken group; that suffix's context grows by one context of this group per
    member that points to it, so it moves to a new group right above its old one (more contexts: higher).
    Second part. A suffix is its Lyndon prefix and then its next smaller suffix. So when a suffix is emitted, those for
    which it is the next smaller (the one just before it, and on along pointers until one is emitted) take the next
    free place of their groups.
    """
    n = len(text)
    if not n:
        return []
    present = sorted(set(text))
    place = {c: g for g, c in enumerate(present)}
    group = [place[c] for c in text]
    members: list[list[int]] = [[] for _ in present]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(present) - 1))
    above = list(range(1, len(present) + 1))
    above[-1] = -1
    taken, prev = bytearray(n), [-1] * n
    ascending = []
    g = len(present) - 1
    while g >= 0:
        own = members[g]
        if size[g] != len(own):
            own = members[g] = [i for i in own if group[i] == g]
        ascending.append(g)
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and taken[p]:
                p = prev[p]
            prev[i] = p
            taken[i] = 1
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in times.items():
            key = (group[p], -k)
            if key in moved:
                moved[key].append(p)
            else:
                moved[key] = [p]
        for key in moved if len(moved) < 2 else sorted(moved):
            old, who = key[0], moved[key]
            if size[old] == len(who):
                continue  # the whole rest of the group grows alike and keeps its place
            new = len(members)
            members.append(who)
            size.append(len(who))
            size[old] -= len(who)
            for p in who:
                group[p] = new
            over = above[old]
            above[old], below[over] = new, new
            below.append(old)
            above.append(over)
        g = below[g]
    free, at = [0] * len(members), 0
    for g in reversed(ascending):
        free[g] = at
        at += size[g]
    order, out = [-1] * n, bytearray(n)
    s = n - 1
    while s >= 0:  # the empty suffix comes first
        out[s] = 1
        f = free[group[s]]
        order[f] = s
        free[group[s]] = f + 1
        s = prev[s]
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not out[s]:
            out[s] = 1
            f = free[group[s]]
            order[f] = s
            free[group[s]] = f + 1
            s = prev[s]
    return order
