"""Plain versions of the operators' rules, for comparison on small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words(text):
    return WORD.findall(lower(text or ""))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def shingle_set(text):
    found = words(text)
    if not found:
        return frozenset()
    if len(found) < 5:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def components(rows):
    """Smallest id reachable by links of at least 75 % for every (id, text); ids are distinct."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = {}
    for i, own in sets.items():
        for x in own:
            held.setdefault(x, []).append(i)
    for i, own in sets.items():
        met = Counter(j for x in own for j in held[x] if j < i)
        for j, n in met.items():
            if 100 * n >= 75 * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def drop_lines(rows):
    """(kept text, lines, dropped) by id of (id, text) with distinct ids."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def base_figures(text):
    text = text or ""
    found = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    return (
        len(found),
        sum(map(len, found)),
        sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )
