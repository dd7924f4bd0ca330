"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def blank_words(text, lower=False):
    return BLANK.findall((text or "").translate(LOWER) if lower else text or "")


def plain_words(text):
    return PLAIN.findall((text or "").translate(LOWER))


def shingles(text, size):
    words = blank_words(text, True)
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_duplicates(rows, size):
    """{(doc_id, n, component, kept)} counted, from (doc_id, text)."""
    sets = [shingles(text, size) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        group = least[root(i)]
        component = (min(group) if group else None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id is not None and doc_id == component))
    return Counter(out)


def contamination(rows, items, window):
    phrases = defaultdict(set)
    for item_id, text in items:
        words = plain_words(text)
        if words:
            size = min(window, len(words))
            for i in range(len(words) - size + 1):
                phrases[tuple(words[i : i + size])].add("" if item_id is None else str(item_id))
    sizes = {len(p) for p in phrases}
    out = []
    for doc_id, text in rows:
        words = plain_words(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                own = phrases.get(tuple(words[i : i + size]))
                if own:
                    hit.update(range(i, i + size))
                    found |= own
        out.append((doc_id, len(words), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return Counter(out)


def repeats(rows, window):
    last = 1 << 63
    first = {}
    texts = [(last if d is None else d, blank_words(t)) for d, t in rows]
    for doc, words in texts:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, last), doc)
    out = []
    for (doc_id, _), (doc, words) in zip(rows, texts):
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < doc:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def tokens(rows, tokenizer):
    """(doc_id, start, n, crc) of rows sorted by doc_id."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        data = b"".join(i.to_bytes(4, "little") for i in ids)
        out.append((doc_id, start, len(ids), zlib.crc32(data)))
        start += len(ids)
    return out


def targets(sizes, weights, share, most):
    """{source: target} by cutting and sharing out again, from {source: size}."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(sizes, 0.0)
    free, left = set(sizes), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > most * sizes[s]}
        if not over:
            for s in free:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target
