"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

import xxhash

SPACE = "[\x20\x09-\x0D]"


def digest(spans):
    return hashlib.sha256(shown(spans).encode()).hexdigest()


def shown(spans):
    return ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans))


def secret_spans(text):
    found = []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text or ""):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end(), "assign"))
    for rank, kind, pattern, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[0]) >= least]
    return found


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal_spans(text):
    found = []
    for rank, kind, pattern in (
        (0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        (1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        (2, "card", r"[0-9]([\x20-]?[0-9])+"), (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15):
                found.append((m.start(), rank, m.end(), kind))
    return found


def fingerprint(text, k=4):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in combinations(sorted(nodes), 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {n: find(n) for n in nodes}


def targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    """Source -> target, resharing until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, total, fixed = set(order), share * sum(sizes.values()), {}
    while left:
        level = (total - sum(fixed.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > limit * sizes[s]}
        if not over:
            break
        fixed |= {s: float(limit * sizes[s]) for s in over}
        left -= over
    return fixed | {s: weight[s] * level for s in left}


def passage(pattern, text, k):
    """Whether some part of the text is within k edits of the pattern."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row) <= k
