"""SimHash groups, computed plainly."""

import xxhash

from steadymap.llm.common import words_of


def plain_fingerprint(text):
    tokens = [w.decode() for w in words_of(text)]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[k : k + 3]) for k in range(max(1, len(tokens) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute(rows):
    fps = [(d, plain_fingerprint(t)) for d, t in rows]
    got = roots_of([d for d, _ in fps], [(a, b) for a, x in fps for b, y in fps if (x ^ y).bit_count() <= 2])
    return sorted((d, f"{f:016x}", got[d]) for d, f in fps)
