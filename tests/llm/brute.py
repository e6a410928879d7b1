"""Plain Python versions of what the operators return."""

import re
from collections import defaultdict
from hashlib import sha256


def words(text):
    return text.encode().lower().split() if text else []


def shingle_set(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def near_duplicates(rows, k, percent):
    """(n_shingles, component_id) of each (doc_id, text)."""
    sets = [shingle_set(t, k) for _, t in rows]
    tree = list(range(len(rows)))

    def root(i):
        while tree[i] != i:
            i = tree[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and root(i) != root(j) and 100 * len(a & b) >= percent * len(a | b):
                tree[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[root(i)].append(doc_id)
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [(len(sets[i]), least[root(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(text, items, width=10):
    """(n_words, n_hit, n_items, items_sha256) of a text against [(item_id, text)]."""
    found, hit, names = bench_words(text), set(), set()
    for item, other in items:
        theirs = bench_words(other)
        for i in range(max(len(theirs) - width + 1, 1) if theirs else 0):
            window = theirs[i:i + width]
            for at in range(len(found) - len(window) + 1):
                if found[at:at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    if item is not None:
                        names.add(str(item))
    return len(found), len(hit), len(names), sha256(",".join(sorted(names)).encode()).hexdigest()


def dedup_lines(rows, width=3):
    """{(doc_id, text): new text}; the first occurrence of a window is by id (null last), text, position."""
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            continue
        lines = text.split("\n")
        worded = [i for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        covered = set()
        for p in range(max(len(worded) - width + 1, 1) if worded else 0):
            window = tuple(lines[i] for i in worded[p:p + width])
            if window in seen:
                covered.update(worded[p:p + width])
            seen.add(window)
        out[doc_id, text] = "\n".join(x for i, x in enumerate(lines) if i not in covered)
    return out


def targets(totals, weights=(3, 1, 2), share=1.5, cap=2):
    """{source: target} by clipping and resharing until none is above its limit."""
    names = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, share * sum(totals.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        now = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = [s for s in free if now[s] > cap * totals[s]]
        if not above:
            return fixed | now
        fixed |= {s: cap * totals[s] for s in above}
