"""The operators' results, said as plainly as possible, over lists of rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def shingles(text, k=5):
    w = [x.lower() for x in words(text)]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near(docs, percent):
    """docs: (id, text) → id → (set size, smallest id reachable)."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if i is not None)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return {i: (len(s), i if i is None else root(i)) for i, s in sets.items()}


def near_sets(docs, k, percent):
    """docs: (id, text) → rows (id, set size, smallest id reachable); every row is a
    set of its own, null ids have no links."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if x and y and i is not None and j is not None and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    up[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return [(i, len(x), None if i is None else least[root(a)]) for a, (i, x) in enumerate(sets)]


def variants(docs, damage=97, least_length=5, least_count=3):
    """docs: (id, text) → rows (word, form, root, n, n_near, form_n)."""
    counts = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}
    letters = {c for w in n for c in w}
    near, form = {}, {}
    for w in n:
        edits = {w[:i] + w[i + 1:] for i in range(len(w))} | {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        near[w] = [v for v in edits if v in n and v != w]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return [(w, form[w], root(w), c, len(near[w]), n.get(form[w])) for w, c in n.items()]


def trie(turns, borrowed=lambda c: (None, 0)):
    """turns: (conv, turn, role, text) → rows of `prefix_trie.trie`; borrowed: conv →
    (conversation, how many turns)."""
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), role, text))
    own = {c: [x[1:] for x in sorted(s)] for c, s in own.items()}
    whole = {c: own.get(borrowed(c)[0], [])[:borrowed(c)[1]] + s[borrowed(c)[1]:] for c, s in own.items()}
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += children[p] == 0
    ends = {p: ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))) for p, m in members.items()}
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest())
            for p, m in members.items()]


def windows_removed(docs, window):
    """docs: (id, text) → rows (id, words, removed, sha of the kept words)."""
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            if i is not None:
                first[tuple(w[k:k + window])] = min(i, first.get(tuple(w[k:k + window]), i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    three = list(zip(w, w[1:], w[2:]))
    often = Counter(three)
    covered = {j for i, x in enumerate(three) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def targets(sizes, weights=(1, 2, 3), limit=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed = {}
    while True:
        rest = [s for s in order if s not in fixed]
        left, total = sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > limit * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in rest}
        fixed |= {s: limit * sizes[s] for s in over}


def nearest(rows, k):
    """rows: (id, vector or None) → query → [(id, score)], for ids divisible by 20."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v) and any(v)]
    out = defaultdict(list)
    for q, v in ok:
        if q % 20 == 0:
            out[q] = sorted(((i, float(v @ w)) for i, w in ok if i != q), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
