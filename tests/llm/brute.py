"""Plain versions of the contracts, one document at a time or all against all."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text: str | None) -> tuple[int, int, int, str]:
    t = text or ""
    found = []
    n = [0, 0, 0]
    patterns = (
        (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    )
    for k, (pattern, good) in enumerate(patterns):
        for m in re.finditer(pattern, t):
            if good(m):
                n[k] += 1
                found.append((m.start(), k, m.end()))
    return (*n, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))))


def near(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    sets = {}
    for doc, text in docs:
        w = words(lower(text or ""))
        sets[doc] = frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    owners = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            owners[g].append(d)
    for d, s in sets.items():
        shared = Counter(o for g in s for o in owners[g] if o < d)
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def contaminated(docs, items, width: int = 10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text or ""))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    sizes = {len(g) for g in windows}
    out = {}
    for doc, text in docs:
        w = word.findall(lower(text or ""))
        hit, who = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                if g in windows:
                    who |= windows[g]
                    hit |= set(range(i, i + n))
        out[doc] = (len(w), len(hit), len(who), sha(",".join(sorted(map(str, who)))), bool(hit))
    return out


def quality(text: str | None):
    t = text or ""
    w = words(t)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def substring(docs, width: int = 20):
    """doc -> (n_words, n_removed, sha256 of what is kept), with distinct doc_ids."""
    split = {d: words(t) for d, t in docs}
    seen = set()
    out = {}
    for d in sorted(split):
        w = split[d]
        gone = set()
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if g in seen:
                gone |= set(range(i, i + width))
            seen.add(g)
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def links(messages):
    """(conv, turn) -> (parent, kind) of conversations without null or repeated turns, by comparing every message with all before it."""
    mark = re.compile(r"[ \t]*((?:>[ \t]?)+)")
    said = re.compile(r".{1,200}\bwrote:\s*$")

    def plain(lines):
        return " ".join(" ".join(lines).split()).lower()

    def pieces(lines):
        """(kind, normalised text) of a passage, its paragraphs and its lines."""
        out, held = [(0, plain(lines))], []
        for x in [*lines, ""]:
            if x.strip():
                held.append(x)
            elif held:
                out.append((1, plain(held)))
                held = []
        return [p for p in [*out, *((2, plain([x])) for x in lines)] if p[1]]

    out, wrote = {}, defaultdict(list)
    for conv, turn, text in sorted(messages, key=lambda m: m[:2]):
        rows = []
        for line in (text or "").split("\n"):
            m = mark.match(line)
            rows.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
        own = [x for k, (n, x) in enumerate(rows) if n == 0 and not (said.match(x.strip()) and any(a for a, _ in rows[k + 1 : k + 3]))]
        best = None
        passage, before = [], 0
        passages = []
        for n, x in [*rows, (0, "")]:
            if n != before and passage:
                passages.append((before, passage))
                passage = []
            if n:
                passage.append(x)
            before = n
        for level, lines in passages:
            for kind, p in pieces(lines):
                for earlier, had in wrote[conv]:
                    if p in had:
                        key = (level, kind, -len(p), -earlier)
                        best = key if best is None else min(best, key)
        parent = -best[3] if best else max((t for t, _ in wrote[conv]), default=None)
        out[conv, turn] = (parent, "quote" if best else "root" if parent is None else "previous")
        wrote[conv].append((turn, {p for _, p in pieces(own)}))
    return out
