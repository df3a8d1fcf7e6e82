"""Plain definitions of the results, for small tables."""

from __future__ import annotations

import base64
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def groups(docs):
    """Shingle set size and component of each (doc_id, text); identifiers are distinct."""
    sets = {}
    for d, t in docs:
        w = words(t, True)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def repeated_windows(docs, size=20):
    """Kept words of each (doc_id, text) in ascending order of distinct identifiers (None first)."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if (x := tuple(w[i : i + size])) in seen:
                gone[i : i + size] = [True] * size
            seen.add(x)
        out[d] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def unigrams(docs, held_out):
    import math

    tokens = {d: [*words(t, True), None] for d, t in docs}
    count = Counter(x for d, w in tokens.items() if not held_out[d] for x in w)
    n, v = sum(count.values()), len(count)
    return {d: (len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d, w in tokens.items()}


def ranks(path):
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def plain_bytes(text):
    return re.sub(rb"[\x00-\x7f]+", lambda m: re.sub(rb"[^a-z0-9]+", b" ", m[0]), (text or "").lower().encode())


def fewest_edits(item, text):
    """Between an item and any part of a text: the whole table of edit distances, row by row."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def close_items(docs, items, share):
    """Edits of all items within their budget of some part of a document."""
    out = {}
    for d, t in docs:
        text = plain_bytes(t)
        for k, x in items:
            body = plain_bytes(x).strip()
            if body and (n := fewest_edits(body, text)) <= int(len(body) * share):
                out[d, k] = n
    return out


def pitman_yor(docs, held_out, values, sweeps, samples):
    """log10 scores by a sampler in which every customer leaves and sits down again, at tables with sizes of their own."""
    import math
    import random

    rng = random.Random(0)
    tokens = {d: [*words(t, True), None] for d, t in docs}
    pairs = [(u, w) for d, x in tokens.items() if not held_out[d] for u, w in zip([None, *x], x, strict=False)]
    known = {w for _, w in pairs}
    base = 1 / (len(known) + 1)
    d, theta, pd, ptheta = (values[k] for k in ("d", "theta", "parent_d", "parent_theta"))
    rooms = defaultdict(lambda: defaultdict(list))  # context, dish: sizes of tables
    parent = defaultdict(list)
    count = lambda room: (sum(map(sum, room.values())), sum(map(len, room.values())))

    def p_of(w):
        c, t = count(parent)
        own = parent.get(w, [])
        return (sum(own) - pd * len(own) + (ptheta + pd * t) * base) / (ptheta + c)

    def sit(tables, weight_new, discount):
        x = rng.random() * (sum(tables) - discount * len(tables) + weight_new)
        for k, size in enumerate(tables):
            x -= size - discount
            if x < 0:
                tables[k] += 1
                return False
        tables.append(1)
        return True

    def leave(tables):
        x = rng.randrange(sum(tables))
        for k, size in enumerate(tables):
            x -= size
            if x < 0:
                tables[k] -= 1
                if not tables[k]:
                    del tables[k]
                    return True
                return False

    def arrive(u, w):
        if sit(rooms[u][w], (theta + d * count(rooms[u])[1]) * p_of(w), d):
            sit(parent[w], (ptheta + pd * count(parent)[1]) * base, pd)

    for u, w in pairs:
        arrive(u, w)
    total = defaultdict(float)
    asked = {(u, w) for x in tokens.values() for u, w in zip([None, *x], x, strict=False)}
    for sweep in range(sweeps):
        for u, w in pairs:
            if leave(rooms[u][w]):
                leave(parent[w])
            arrive(u, w)
        if sweep >= sweeps - samples:
            for u, w in asked:
                c, t = count(rooms[u]) if u in rooms else (0, 0)
                own = rooms[u].get(w, []) if u in rooms else []
                total[u, w] += (sum(own) - d * len(own) + (theta + d * t) * p_of(w)) / (theta + c)
    return {k: sum(math.log10(total[u, w] / samples) for u, w in zip([None, *x], x, strict=False)) for k, x in tokens.items()}
