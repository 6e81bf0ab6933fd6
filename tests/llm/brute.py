"""Plain versions of the corpus operators for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


class Groups:
    """Union-find."""

    def __init__(self):
        self.above = {}

    def find(self, x):
        self.above.setdefault(x, x)
        while self.above[x] != x:
            x = self.above[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.above[max(a, b)] = min(a, b)


def shingles(text):
    lowered = re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())
    words = WORD.findall(lowered)
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def near_components(docs):
    """{doc_id: (set size, component)} by comparing all pairs of (doc_id, text)."""
    sets, groups = {d: shingles(t) for d, t in docs}, Groups()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                groups.link(a, b)
    return {d: (len(sets[d]), groups.find(d)) for d in ids}


def without_repeats(docs, length=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} by remembering every string of `length` bytes."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            string = data[i : i + length]
            if string in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(string)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def hash64(data):
    value = xxhash.xxh64(data, seed=42).intdigest()
    return value - (1 << 64) if value >> 63 else value


def simhash(words):
    hashes = [hash64(w.encode()) for w in words]
    return sum(1 << b for b in range(63) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last = [i]
        for j, y in enumerate(b, 1):
            last.append(min(row[j] + 1, last[-1] + 1, row[j - 1] + (x != y)))
        row = last
    return row[-1]


def within(a, b, limit):
    """Whether at most `limit` edits lead from a to b: the cells of the table near its diagonal, until all are beyond."""
    row = {j: j for j in range(min(limit, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - limit), min(len(b), i + limit) + 1):
            best = min(row.get(j, limit) + 1, new.get(j - 1, limit) + 1)
            if j:
                best = min(best, row.get(j - 1, limit + 1) + (x != b[j - 1]))
            if best <= limit:
                new[j] = best
        if not new:
            return False
        row = new
    return len(b) in row


MIN_CHARS = 24


def normalised(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip(" ")


def similar_pairs(norms):
    """Pairs of lines whose edit distance is at most a tenth of the longer one, by trying all whose letters allow it."""
    sizes = np.array([len(n) for n in norms])
    letters = sorted(set("".join(norms)))
    place = {c: i for i, c in enumerate(letters)}
    counts = np.zeros((len(norms), len(letters)), dtype=np.int32)
    for i, norm in enumerate(norms):
        np.add.at(counts[i], [place[c] for c in norm], 1)
    for i, norm in enumerate(norms):
        rest = slice(i + 1, None)
        differ = counts[rest] - counts[i]
        least = np.maximum(np.maximum(differ, 0).sum(axis=1), np.maximum(-differ, 0).sum(axis=1))  # no edit distance is below
        for j in np.flatnonzero(least <= np.maximum(sizes[rest], sizes[i]) // 10) + i + 1:
            if within(norm, norms[j], max(len(norm), len(norms[j])) // 10):
                yield norm, norms[j]


def without_repeated_lines(docs, radius=None):
    """{doc_id: text} without lines of which an equal or similar one comes first; similar by edits alone, or within `radius` too."""
    places, groups = [], Groups()
    for doc_id, text in docs:
        for number, line in enumerate((text or "").split("\n")):
            norm = normalised(line)
            if len(norm) >= MIN_CHARS:
                places.append((doc_id, hash64(text.encode()), number, norm))
    for a, b in similar_pairs(sorted({p[-1] for p in places})):
        if radius is None or (simhash(a.split(" ")) ^ simhash(b.split(" "))).bit_count() <= radius:
            groups.link(a, b)
    first = {}
    for *place, norm in places:
        group = groups.find(norm)
        first[group] = min(first.get(group, tuple(place)), tuple(place))
    gone = defaultdict(set)
    for *place, norm in places:
        if first[groups.find(norm)] != tuple(place):
            gone[place[0]].add(place[2])
    return {d: t and "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in docs}


def without_copies(docs):
    """`without_repeated_lines` less the documents that lost lines and keep only short ones which others have."""
    before, after = dict(docs), without_repeated_lines(docs)

    def short(text):
        return {n for n in map(normalised, text.split("\n")) if 0 < len(n) < MIN_CHARS}

    left = {d: t for d, t in after.items() if t != before[d] and all(len(normalised(x)) < MIN_CHARS for x in t.split("\n"))}
    others = {n for d, t in before.items() if d not in left and t for n in short(t)}
    first = {}
    for d in sorted(left, key=lambda d: (d, hash64(before[d].encode()))):
        for norm in short(left[d]) - others:
            first.setdefault(norm, d)
    return {d: t for d, t in after.items() if d not in left or d in first.values()}


def benchmark_matches(docs, items):
    """{(doc_id, item_id): similarity} of the best item-sized window, by trying all of them."""
    out = {}
    for item_id, item in items:
        words = re.findall(r"\w+", (item or "").lower())
        want = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        size = sum(want.values())
        for doc_id, text in docs if size else []:
            own = re.findall(r"\w+", (text or "").lower())
            have = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
            width = min(size, len(have))
            for start in range(len(have) - width + 1 if width else 0):
                window = Counter(have[start : start + width])
                shared = sum((window & want).values())
                found = shared / (size + width - shared)
                if found >= 0.75 and found > out.get((doc_id, item_id), 0):
                    out[doc_id, item_id] = found
    return out
