"""Choices among a few dozen planned pairs; they run on the driver, as a plan has at most some hundred rows."""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterable


def quota_pick(pairs: Iterable[tuple[str, str, float]], want: int, per_gold: int, per_other: int) -> list[tuple[str, str, float]]:
    """Round-robin over gold items, each by ascending difference, under caps for both sides."""
    queues: dict[str, deque] = {}
    for p in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        queues.setdefault(p[0], deque()).append(p)
    out: list[tuple[str, str, float]] = []
    used_g: dict[str, int] = {}
    used_o: dict[str, int] = {}
    while len(out) < want and queues:
        for g in sorted(queues):
            while queues[g] and used_o.get(queues[g][0][1], 0) >= per_other:
                queues[g].popleft()
            if not queues[g] or used_g.get(g, 0) >= per_gold:
                del queues[g]
                continue
            p = queues[g].popleft()
            out.append(p)
            used_g[g] = used_g.get(g, 0) + 1
            used_o[p[1]] = used_o.get(p[1], 0) + 1
            if len(out) == want:
                break
    return out


def independent_set(nodes: Iterable[str], conflicts: Iterable[tuple[str, str]], exact: int = 24, restarts: int = 3000, seed: int = 1) -> list[str]:
    """A largest set without conflicts: exact up to ``exact`` nodes, else the best of seeded restarts."""
    names = sorted(set(nodes))
    near: dict[str, set[str]] = {n: set() for n in names}
    for a, b in conflicts:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)

    def search(left: list[str]) -> list[str]:
        if not left:
            return []
        n = max(left, key=lambda x: (len(near[x] & set(left)), x))
        if not near[n] & set(left):
            return left
        without = search([x for x in left if x != n])
        with_ = [n, *search([x for x in left if x != n and x not in near[n]])]
        return max(with_, without, key=len)

    if len(names) <= exact:
        return sorted(search(names))
    rng, best = random.Random(seed), []
    for _ in range(restarts):
        taken: list[str] = []
        blocked: set[str] = set()
        for n in rng.sample(names, len(names)):
            if n not in blocked:
                taken.append(n)
                blocked |= near[n]
        if len(taken) > len(best):
            best = taken
    return sorted(best)


def seat_ceiling(items: Iterable[tuple[str, str, int]], family_cap: int, segment_cap: int) -> int:
    """Most items (item, family, segment) that fit both caps: a maximum flow by augmenting paths."""
    room: dict[tuple, dict[tuple, int]] = {}

    def edge(a: tuple, b: tuple, n: int) -> None:
        room.setdefault(a, {})[b] = n
        room.setdefault(b, {}).setdefault(a, 0)

    for i, f, s in items:
        edge(("source",), ("f", f), family_cap)
        edge(("f", f), ("i", i), 1)
        edge(("i", i), ("s", s), 1)
        edge(("s", s), ("sink",), segment_cap)
    flow = 0
    while True:
        back: dict[tuple, tuple] = {("source",): ()}
        queue = deque([("source",)])
        while queue and ("sink",) not in back:
            a = queue.popleft()
            for b, n in room.get(a, {}).items():
                if n > 0 and b not in back:
                    back[b] = a
                    queue.append(b)
        if ("sink",) not in back:
            return flow
        b = ("sink",)
        while back[b]:
            room[back[b]][b] -= 1
            room[b][back[b]] += 1
            b = back[b]
        flow += 1


def describe_pairs(rows: Iterable[tuple[list[str], str, str]]) -> str:
    """Examples as text: names, verdict and reason, numbered."""
    return "\n".join(f"{i}. {' vs '.join(names)}: {verdict}" + (f" ({reason})" if reason else "") for i, (names, verdict, reason) in enumerate(rows, 1))
