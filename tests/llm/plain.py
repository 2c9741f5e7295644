"""Plain-Python twins of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def quality(text):
    text = text or ""
    w = SPACED.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def fingerprint(text):
    import xxhash

    w = SPACED.findall(low(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(prints):
    """{key: smallest key reachable} over all pairs; prints: {key: fingerprint}."""
    up = {k: k for k in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def contamination(text, items):
    """(n_words, n_hit, ids) by looking at every window."""
    w = ALNUM.findall(low(text))
    hit, ids = set(), set()
    for item, t in items:
        v = ALNUM.findall(low(t))
        size = min(10, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                ids.add(str(item))
    return len(w), len(hit), sorted(ids)


def base_spans(text):
    text = text or ""
    out = []
    for kind, pattern, group, least in (
        (0, r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        (1, r"AKIA[A-Z0-9]+", 0, 20),
        (2, r"[0-9a-f]+", 0, 24),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, words=5):
    w = SPACED.findall(low(text))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def near_copies(texts, least=0.8):
    """Label of each text: the first text reachable over pairs with a Jaccard similarity of `least` or more."""
    sets = [shingles(t) for t in texts]
    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            by_shingle.setdefault(x, []).append(i)
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s or {None} for j in by_shingle[x] if j < i)
        for j, n in shared.items():
            if not s or n >= least * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]
