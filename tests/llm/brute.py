"""The contracts of the operators in plain Python, row by row."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def simhash(text, width=4):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows, threshold=4, width=4):
    """``(doc_id, fingerprint, component)`` of ``(doc_id, text)``: all pairs of distinct fingerprints."""
    prints = [simhash(t, width) for _, t in rows]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= threshold:
                parent[root(a)] = root(b)
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[root(p)] = min(doc, least.get(root(p), doc))
    return [(doc, f"{p:016x}", least.get(root(p))) for (doc, _), p in zip(rows, prints)]


def shingles(text, width=5):
    words = WORD.findall(lower(text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def alike(rows, part=4, whole=5):
    """Per row of ``(doc_id, text)``, in order, the smallest doc_id reached over texts of a Jaccard similarity of 0.8 or more."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    distinct = list(set(sets))
    root = {s: s for s in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            shared = len(a & b) if part * max(len(a), len(b)) <= whole * min(len(a), len(b)) else 0
            if whole * shared >= part * (len(a) + len(b) - shared) and root[a] != root[b]:
                old = root[a]
                root = {s: root[b] if r == old else r for s, r in root.items()}
    least = {}
    for (doc, _), s in zip(rows, sets):
        if doc is not None:
            least[root[s]] = min(doc, least.get(root[s], doc))
    return [least.get(root[s]) for s in sets]


def water_fill(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by source; ``sizes`` is source to words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > epochs * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: float(epochs * sizes[s]) for s in over}
        left -= sum(epochs * sizes[s] for s in over)
        open_ -= over
    return target


def quality(text, ns=(5, 6, 7, 8, 9, 10)):
    text = text or ""
    words = WORD.findall(text)
    in_windows = {}
    for n in ns:
        count = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        marked = set()
        for i in range(len(words) - n + 1):
            if count[tuple(words[i : i + n])] > 1:
                marked.update(range(i, i + n))
        in_windows[n] = marked
    lines = [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    later = [x for i, x in enumerate(lines) if x in lines[:i]]
    row = {
        "n_words": len(words), "word_chars": chars, "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(later), "n_repeat_words": len(in_windows[8]),
    }
    row["base_failed"] = len(words) < 20 or 100 * len(in_windows[8]) > 30 * len(words)
    limits = {5: 150, 6: 140, 7: 130, 8: 120, 9: 110, 10: 100}
    inside = all(1000 * sum(len(words[i]) for i in in_windows[n]) <= limits[n] * chars for n in ns)
    dup = sum(len(w) for x in later for w in WORD.findall(x))
    row["kept"] = not row["base_failed"] and inside and 1000 * dup <= 200 * chars
    return row


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_spans(text):
    """``(start, kind number, end)`` in order."""
    out = []
    for number, (kind, pattern) in enumerate(PII):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), number, m.end()))
    return sorted(out)


def murmur3(data: bytes, seed=42):
    """Spark's ``hash`` of a text: the bytes behind the last whole word are mixed in one by one, as signed."""
    def rotl(x, r):
        return (x << r | x >> (32 - r)) & 0xFFFFFFFF

    def mix(h, k):
        k = rotl(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
        return (rotl(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF

    h, whole = seed, len(data) & ~3
    for i in range(0, whole, 4):
        h = mix(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[whole:]:
        h = mix(h, (b - 256 if b > 127 else b) & 0xFFFFFFFF)
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def winnow(text, k=3, w=4, longest=8):
    """``(hash, position)`` chosen by winnowing, by position."""
    prime, base = (1 << 31) - 1, 1_000_003
    codes = [murmur3(t.encode()) % prime for t in re.findall(rf"[^\x20\x09-\x0D]{{1,{longest}}}", text or "")]
    if not codes:
        return []
    codes += [0] * (k - len(codes))
    grams = []
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i : i + k]:
            h = (h * base + c) % prime
        grams.append(h)
    chosen = []
    for i in range(max(1, len(grams) - w + 1)):
        window = grams[i : i + w]
        least = min(window)
        at = i + max(j for j, h in enumerate(window) if h == least)
        if not chosen or chosen[-1] != (least, at):
            chosen.append((least, at))
    return chosen


def likeness(one, two):
    one, two = {h for h, _ in one}, {h for h, _ in two}
    return len(one & two) / len(one | two) if one | two else 1.0


def edited(rows):
    """``doc_id -> (edited text, next text)`` for ``(doc_id, text)`` of distinct ids."""
    order = sorted(rows, reverse=True)
    out = {}
    for i, (doc, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        out[doc] = text[: len(text) - third] + following[:third], following
    return out


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sequences(pieces):
    """Pieces by sequence, each checked to be gapless from 0."""
    by = defaultdict(list)
    for p in pieces:
        by[p["sequence_id"]].append(p)
    for some in by.values():
        at = 0
        for p in sorted(some, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
    return by


def crc32_ids(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
