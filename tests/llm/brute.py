"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingle_set(text: str | None) -> set[tuple[str, ...]]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near_duplicates(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    """doc_id to n_shingles, component_id, kept; doc_ids are distinct."""
    sets = [shingle_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    postings = defaultdict(list)
    for i, s in enumerate(sets):
        common: dict[int, int] = defaultdict(int)
        for x in s:
            for j in postings[x]:
                common[j] += 1
            postings[x].append(i)
        for j, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[j]) - c):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return {d: (len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows)}
