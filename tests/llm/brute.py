"""Brute-force versions that several tests share."""

import random
import re

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potions in old copper kettles near quiet rivers".split()


def prose(seed: int, n: int) -> str:
    """Random words, mostly distinct."""
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.7 else "") for _ in range(n))


def plain_words(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def brute_classes(rows, threshold=0.8):
    """(doc_id, class_id, n_links, n_copies) of every row, by comparing all pairs of distinct sets."""
    sets = {}
    for i, text in rows:
        w = plain_words(text)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    first, copies = {}, {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
        copies[sets[i]] = copies.get(sets[i], 0) + 1
    parent, links, nodes = {i: i for i in sets}, dict.fromkeys(sets, 0), [s for s in first if s]

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(nodes):
        for b in nodes[:n]:
            if len(a & b) >= threshold * len(a | b) - 1e-9:
                x, y = first[a], first[b]
                links[x] += 1
                links[y] += 1
                x, y = find(x), find(y)
                parent[max(x, y)] = min(x, y)
    return sorted((i, find(first[s]) if s else i, links[first[s]] if s else 0, copies[s] if s else 1) for i, s in sets.items())
