"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

BLANKS = " \t\n\x0b\x0c\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats(rows, window=50):
    """op1: {index: (n_bytes, n_removed, n_spans, kept)}; rows are (doc_id, text)."""
    key = lambda d: -(2**63) if d is None else d
    first = {}
    coded = [(key(d), (t or "").encode()) for d, t in rows]
    for d, b in coded:
        for i in range(len(b) - window + 1):
            w = b[i: i + window]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in coded:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if first[b[i: i + window]] < d:
                gone[i: i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def secrets(text):
    """op3 base spans as (start, kind, end)."""
    text = text or ""
    rules = [
        (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
        (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    return sorted((m.start(), k, m.end()) for k, (rule, ok) in enumerate(rules) for m in rule.finditer(text) if ok(m))


def lines_kept(rows, min_chars=20, min_docs=3):
    """op4: [(n_lines, n_dropped, kept)] for rows (doc_id, text) with distinct ids."""
    order = lambda d: -(2**63) if d is None else d
    key = lambda line: line.strip(BLANKS).translate(_LOWER)
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add((order(d), t))
    out = []
    for d, t in rows:
        own, kept = (t or "").split("\n"), []
        for line in own:
            k = key(line)
            if len(k) >= min_chars and len(holders[k]) >= min_docs and order(d) < max(holders[k])[0]:
                continue
            kept.append(line)
        out.append((len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def shingles(text):
    w = words((text or "").translate(_LOWER))
    if not w:
        return set()
    return {tuple(w[i: i + 5]) for i in range(max(len(w) - 4, 1))}


def jaccard_components(rows):
    """op7: {doc_id: component} of rows (doc_id, text); rows of one id are one document."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, r in sets[:i]:
            if s and r and 100 * len(s & r) >= 80 * len(s | r):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d in root}


def measures(text):
    """op8: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    grams = [tuple(w[i: i + 3]) for i in range(len(w) - 2)]
    times = {g: grams.count(g) for g in set(grams)} if len(grams) < 3000 else {}
    hit = {p for i, g in enumerate(grams) if times.get(g, 1) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
