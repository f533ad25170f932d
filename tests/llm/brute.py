"""Plain-Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    return WORD.findall((text or "").translate(FOLD) if lower else text or "")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def line_key(line):
    return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(FOLD)


def line_dedup(docs):
    """doc_id -> (n_lines, n_dropped, sha256)."""
    holders = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(line_key(x)) >= 10:
                holders[line_key(x)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(line_key(x)) >= 10 and len(holders[line_key(x)]) > 1 and min(holders[line_key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def passages(docs, width=20):
    """doc_id -> (n_words, n_removed, sha256)."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if x in seen:
                gone[k : k + width] = [True] * width
            seen.add(x)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, width):
    w = words(text, True)
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(docs, width, percent):
    """doc_id -> (set size, smallest doc_id reachable)."""
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                m = len(x & y)
                if 100 * m >= percent * (len(x) + len(y) - m):
                    p, q = sorted((find(a), find(b)))
                    parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def base_scores(docs):
    """doc_id -> (n_tokens, n_known, N, base score)."""
    tokens = {i: [*words(t, True), None] for i, t in docs}
    c = collections.Counter(x for i, w in tokens.items() if fold(i) != 1 for x in w)
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in tokens.items()}


def base_quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w, seen, dup = words(text), set(), 0
    for x in (text or "").split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def leaks(docs, items):
    """(doc_id, item_id) with four fifths of an item's five-word shingles."""
    tok = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate(FOLD))
    grams = lambda w, k: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    out, own = set(), [(i, tok(t)) for i, t in items]
    for d, t in docs:
        w = tok(t)
        for i, x in own:
            k = min(5, len(x))
            if x and len(grams(x, k) & grams(w, k)) >= 0.8 * len(grams(x, k)):
                out.add((d, i))
    return out
