"""Plain-Python versions of what the text operators return."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring(docs, length=13):
    """{row number: (n_words, n_removed, kept_sha256)} for (doc_id, text) rows."""
    first = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - length + 1):
            if doc is not None and first[tuple(w[i : i + length])] < doc:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def stats(text):
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    marked = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def padded(text):
    body = (text or "").encode()
    size = max(-(-len(body) // 192), 1) * 192
    return len(body), body + b" " * (size - len(body))


def payload(text):
    n, full = padded(text)
    return n, len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 3 else frozenset(zip(w, w[1:], w[2:]))


def components(docs):
    """[(doc_id, n_shingles, component_id)] by comparing every pair that shares a shingle."""
    sets = [(d, shingles(t)) for d, t in docs]
    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(i)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (_, s) in enumerate(sets):
        common = Counter(j for g in s for j in where[g] if j < i)
        for j, n in common.items():
            if 100 * n >= 90 * (len(s) + len(sets[j][1]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)]
