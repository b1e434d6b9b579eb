"""Plain re-implementations that the operators' results are held against."""

from __future__ import annotations

import hashlib
import re
import zlib

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(docs, items, span=10):
    """[(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)] by looking up every window."""
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        w = words(text)
        k = min(span, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    sizes = sorted({len(k) for k in windows})
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                ids = windows.get(tuple(w[i : i + k]))
                if ids:
                    hit.update(range(i, i + k))
                    found |= ids
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def exact(docs):
    keep, size = {}, {}
    for doc, text in docs:
        t = text or ""
        keep[t] = max(keep.get(t, doc), doc)
        size[t] = size.get(t, 0) + 1
    return [(d, keep[t or ""], size[t or ""], keep[t or ""] == d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs]


def token_rows(docs, tokenizer, end_id=2):
    import numpy as np

    out, start = [], 0
    for doc, text in sorted(docs, key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def pieces(text):
    """Runs of letters, of digits and of other signs, between white space."""
    return re.findall("[A-Za-z\x80-\U0010ffff]+|[0-9]+|[^ \t\n\r\f0-9A-Za-z\x80-\U0010ffff]+", text or "")


def links(docs):
    """(links by id, class by id) of all pairs at 0.8 or more."""
    sets, count, parent = {d: shingles(t) for d, t in docs}, {d: 0 for d, _ in docs}, {d: d for d, _ in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8:
                count[a] += 1
                count[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return count, {d: root(d) for d in sets}


def shingles(text, k=5):
    w = words(text)
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 0.0
