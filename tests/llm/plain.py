"""Plain versions of the operators' rules, for comparison."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = SPACE.findall(lower(text))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """{id: (n, least id reached)} of (id, text) rows with distinct ids, by all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    least = defaultdict(lambda: None)
    for i in ids:
        r = find(i)
        least[r] = i if least[r] is None else min(least[r], i)
    return {i: (len(sets[i]), least[find(i)]) for i in ids}


def contamination(text, items):
    """(n_words, n_hit, items, contaminated) of one text."""
    windows = defaultdict(set)
    for name, said in items:
        w = ALNUM.findall(lower(said))
        n = min(13, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows[tuple(w[j : j + n])].add(str(name))
    w = ALNUM.findall(lower(text))
    hit, found = set(), set()
    for n in {len(x) for x in windows}:
        for j in range(len(w) - n + 1):
            if names := windows.get(tuple(w[j : j + n])):
                hit.update(range(j, j + n))
                found |= names
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def measures(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of one text."""
    text = text or ""
    w = SPACE.findall(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    n, r = len(w), len(covered)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n
