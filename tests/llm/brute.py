"""Plain second opinions on the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def simhash(text, n=4):
    own = [w.lower() for w in words(text)]
    if not own:
        return 0
    n = min(n, len(own))
    hashes = [xxhash.xxh64_intdigest(b" ".join(own[i : i + n]), 42) for i in range(len(own) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows, bits=4):
    """(id, fingerprint, component) of (id, text) rows."""
    prints = [simhash(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(key, f"{prints[i]:016x}", least.get(find(i))) for i, (key, _) in enumerate(rows)]


def without_repeats(rows, n=13):
    """(id, words, removed, digest) of (id, text) rows."""
    first = {}
    for key, text in rows:
        own = words(text)
        for i in range(len(own) - n + 1):
            if key is not None:
                first[tuple(own[i : i + n])] = min(key, first.get(tuple(own[i : i + n]), key))
    out = []
    for key, text in rows:
        own, gone = words(text), set()
        for i in range(len(own) - n + 1):
            if key is not None and first[tuple(own[i : i + n])] < key:
                gone.update(range(i, i + n))
        kept = b" ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((key, len(own), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    """Base spans as written in the result."""

    def fits(kind, match):
        digits = re.sub("[^0-9]", "", match)
        if kind == "ip":
            return all(int(p) <= 255 for p in match.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return kind != "phone" or 8 <= len(digits) <= 15

    return [
        f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fits(k, m.group())
    ]


def quality_counts(text):
    own = words(text)
    windows = Counter(zip(own, own[1:], own[2:], strict=False))
    covered = {i + k for i in range(len(own) - 2) if windows[tuple(own[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(own),
        sum(len(w.decode()) for w in own),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def unigram_base(rows, held):
    """(id, tokens, known, N, base) of (id, text) rows by add-one unigrams of the rows that are not held out."""
    tokens = [[w.lower() for w in words(t)] + [None] for _, t in rows]
    counts = Counter(t for (key, _), own in zip(rows, tokens, strict=True) if not held(key) for t in own)
    total, types = sum(counts.values()), len(counts)
    return [
        (key, len(own), sum(counts[t] > 0 for t in own), total, sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in own))
        for (key, _), own in zip(rows, tokens, strict=True)
    ]


def spelling(rows, spoil=199, min_length=6, min_count=5, ratio=5):
    """(word, form, root, n, n_near, form_n) of (id, text) rows."""
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if spoil and h % spoil == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    shapes = {}
    for w in words:
        for i in range(len(w)):
            shapes.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
    near = {w: set() for w in words}
    for same in shapes.values():
        for a in same:
            near[a].update(b for b in same if b != a)
    for w in words:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in words:
                near[w].add(short)
                near[short].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def phrases(rows, min_count=100, top=2000, longest=5):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            ws = re.findall("[^ \t]+", piece)
            total[lang] += len(ws)
            for k in range(1, longest + 1):
                own.update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, own in counts.items():
        often = {g: a for g, a in own.items() if len(g) > 1 and a >= min_count}
        kept, longer = [], Counter()
        for h, b in often.items():
            for i in range(len(h)):
                for j in range(i + 2, len(h) + 1):
                    if j - i < len(h):
                        longer[h[i:j]] = max(longer[h[i:j]], b)
        for g, a in often.items():
            if longer[g] >= a:
                continue
            cut = min((1000 * a * total[lang] // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-cut[0], -a, " ".join(g).encode(), own[g[: cut[1]]], own[g[cut[1] :]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out
