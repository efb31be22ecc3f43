"""Plain versions of the operators, shared by the tests."""

import re

from test_sharding import brute as ring_brute  # noqa: F401
from test_simhash import slow_components, slow_fingerprint  # noqa: F401


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def best_overlap(text, item, window=13):
    """Most agreeing words of a window along any diagonal that has a seed in it."""
    w, t = tokens(text), tokens(item)
    size, best = min(window, len(t)), 0
    masks = ((0, 1, 2, 3, 4, 5), (0, 1, 4, 6, 9, 10))
    for p in range(len(w)):
        for q in range(len(t)):
            if any(p + m[-1] < len(w) and q + m[-1] < len(t) and all(w[p + o] == t[q + o] for o in m) for m in masks):
                for j in range(max(0, q - p, q + 1 - size), min(q, len(t) - size, len(w) - size + q - p) + 1):
                    best = max(best, sum(t[j + k] == w[j + k + p - q] for k in range(size)))
    return best, size


def contaminated(text, bench, share=0.8):
    return any(n and n >= share * size for n, size in (best_overlap(text, b) for b in bench))
