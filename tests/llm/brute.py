"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def repeats(units, width):
    """units: (doc_id, sequence) rows. Whether each place of each row is covered by a window that starts in a smaller doc_id, too."""
    first = {}
    for doc, seq in units:
        for i in range(len(seq) - width + 1):
            if doc is not None:
                key = tuple(seq[i : i + width]) if isinstance(seq, list) else seq[i : i + width]
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, seq in units:
        gone = [False] * len(seq)
        for i in range(len(seq) - width + 1):
            key = tuple(seq[i : i + width]) if isinstance(seq, list) else seq[i : i + width]
            if doc is not None and first[key] < doc:
                gone[i : i + width] = [True] * width
        out.append(gone)
    return out


def shingles(text, width=5):
    found = words(lower(text))
    if not found:
        return frozenset()
    if len(found) < width:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1))


def components(sets):
    """sets: (doc_id, set) rows. The smallest linked doc_id of each."""
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    for rows in by.values():
        for j in rows[1:]:
            a, b = sets[rows[0]][1], sets[j][1]
            del a, b
    pairs = {(i, j) for rows in by.values() for n, i in enumerate(rows) for j in rows[n + 1 :]}
    for i, j in pairs:
        a, b = sets[i][1], sets[j][1]
        common = len(a & b)
        if 100 * common >= 80 * (len(a) + len(b) - common):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(sets):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return [least[find(i)] for i in range(len(sets))]
