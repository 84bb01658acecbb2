"""Brute-force versions of the operators' contracts, in plain Python over lists of (doc_id, text, ...)."""

import hashlib
import re
import zlib
from collections import defaultdict
from fractions import Fraction

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return s.encode("utf-8").lower().decode("utf-8")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def line_dedup(docs):
    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            k = lower(line.strip(WS))
            if len(k) >= 20 and d is not None:
                holders[k].add(d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(lower(x.strip(WS))) < 20 or len(h := holders[lower(x.strip(WS))]) < 3 or d == max(h)]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def shingle_set(text, n):
    w = [lower(x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(docs, n, percent):
    """{doc_id: (shingles, component)}; inverted lists only skip pairs without a common shingle."""
    sets = {d: shingle_set(t, n) for d, t in docs}
    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for pair in {(a, b) for held in where.values() for i, a in enumerate(held) for b in held[i + 1 :]}:
        a, b = sets[pair[0]], sets[pair[1]]
        if 100 * len(a & b) >= percent * len(a | b):
            x, y = find(pair[0]), find(pair[1])
            up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def mix_targets(sizes):
    """{source: target}, exactly, by sharing the excess again until no target is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        left = [s for s in order if s not in full]
        rest, w = total - sum(full.values()), sum(weight[s] for s in left)
        out = {s: Fraction(rest * weight[s], w) for s in left}
        over = [s for s in left if out[s] > 3 * sizes[s]]
        if not over:
            return {s: float(x) for s, x in (full | out).items()}
        full |= {s: 3 * sizes[s] for s in over}


def edited(docs):
    docs = sorted(docs, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0))
    out = {}
    for k, (d, t) in enumerate(docs):
        t, nxt = t or "", docs[(k + 1) % len(docs)][1] or ""
        q = len(t) // 4
        out[d] = (len(t), sha(t[: len(t) - q] + nxt[:q]))
    return out
