"""Plain forms of what the library computes in columns."""

RANKS = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda f: (-RANKS[f[3]], f[0] - f[1], f[0], f[2])):
        if all(k[1] <= s[0] or s[1] <= k[0] for k in kept):
            kept.append(s)
    return sorted(kept)
