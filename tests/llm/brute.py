"""Plain versions of the text operators."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Forest(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def shingles(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def jaccard(rows, percent=80):
    """doc_id -> (size, component)."""
    sets, forest = {d: shingles(t) for d, t in rows}, Forest()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                forest.join(a, b)
    return {d: (len(sets[d]), forest.root(d)) for d in ids}


def repeated_bytes(rows, length):
    """doc_id -> (n_bytes, n_removed, n_spans, kept)."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                mark[p : p + length] = b"\1" * length
            else:
                seen.add(b[p : p + length])
        spans = sum(1 for p in range(len(b)) if mark[p] and not (p and mark[p - 1]))
        out[d] = (len(b), sum(mark), spans, bytes(x for x, m in zip(b, mark) if not m))
    return out


def repeated_words(rows, length):
    """doc_id -> (n_words, n_removed, kept)."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        mark, own = [0] * len(w), set()
        for p in range(len(w) - length + 1):
            window = tuple(w[p : p + length])
            own.add(window)
            if window in seen:
                mark[p : p + length] = [1] * length
        seen |= own
        out[d] = (len(w), sum(mark), " ".join(x for x, m in zip(w, mark) if not m))
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """source -> target, by sharing out again until no source is above its limit."""
    names = sorted(n for n in sizes if n is not None) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        rest = budget - sum(repeats * sizes[n] for n in full)
        open_weight = sum(weight[n] for n in names if n not in full)
        new = {n for n in names if n not in full and rest * weight[n] / open_weight > repeats * sizes[n]}
        if not new:
            return {n: repeats * sizes[n] if n in full else rest * weight[n] / open_weight for n in names}
        full |= new
