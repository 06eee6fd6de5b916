"""The operators' answers once more, by plain Python over small tables."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def groups(n, linked):
    """The group of each of ``n`` things; linked: pairs."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def shingles(text, width):
    words = WORD.findall(lowered(text))
    n = min(width, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def near_components(rows, width, percent):
    """rows: (doc_id, text). (doc_id, set size, component) of each."""
    sets = [shingles(t, width) for _, t in rows]
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    of = groups(len(rows), links)
    named = defaultdict(list)
    for (doc_id, _), g in zip(rows, of, strict=True):
        named[g].append(doc_id)
    least = {g: min((x for x in v if x is not None), default=None) for g, v in named.items()}
    return [(d, len(s), least[g] if s else d) for (d, _), s, g in zip(rows, sets, of, strict=True)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def line_classes(rows, edits, shortest):
    """rows: (doc_id, text) with distinct ids. {(doc_id, line_no): (links, head)}."""
    places = defaultdict(list)
    for doc_id, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\r\x0b\x0c").encode()
            if len(line) >= shortest:
                places[line].append((doc_id, k))
    lines = list(places)

    def near(a, b):
        if abs(len(a) - len(b)) > edits:
            return False
        while a and b and a[0] == b[0]:
            a, b = a[1:], b[1:]
        while a and b and a[-1] == b[-1]:
            a, b = a[:-1], b[:-1]
        return max(len(a), len(b)) < 200 and distance(a, b) <= edits

    links = [(i, j) for i in range(len(lines)) for j in range(i) if near(lines[i], lines[j])]
    of, n, heads = groups(len(lines), links), defaultdict(int), {}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for g, line in zip(of, lines, strict=True):
        heads[g] = min([heads[g], *places[line]] if g in heads else places[line])
    return {p: (n[i], heads[of[i]]) for i, line in enumerate(lines) for p in places[line]}


def without_repeats(rows, edits, shortest):
    """rows: (doc_id, text) with distinct ids. The texts by id without lines that repeat an
    earlier one; those that are line for line what another keeps stay."""
    heads = {k: h for k, (_, h) in line_classes(rows, edits, shortest).items()}
    blank, seen = " \t\r\x0b\x0c", {}
    parts = {d: (t or "").split("\n") for d, t in rows}
    for d in sorted(parts):  # short lines repeat those they equal
        for k, line in enumerate(parts[d]):
            if line.strip(blank) and (d, k) not in heads:
                heads[d, k] = seen.setdefault(line.strip(blank), (d, k))
    signs, kept, out = {}, {}, {}
    for d, own in parts.items():
        real = [k for k, p in enumerate(own) if p.strip(blank)]
        signs[d] = [own[k].strip(blank) for k in real]
        kept[d] = [own[k].strip(blank) for k in real if heads[d, k] == (d, k)]
    for d, t in rows:
        gone = {k for k in range(len(parts[d])) if heads.get((d, k), (d, k)) != (d, k)}
        whole = gone and len(gone) == len(signs[d]) and signs[d] == kept[heads[d, min(gone)][0]]
        out[d] = t if whole or not gone else "\n".join(p for k, p in enumerate(parts[d]) if k not in gone)
    return out
