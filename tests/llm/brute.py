"""Plain versions of what the queries compute, written apart from the operators."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

GAPS = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return GAPS.findall(text or "")


def folded(text):
    return FOLDED.findall((text or "").translate(UPPER))


def contamination(text, items):
    own = folded(text)
    hit, ids = set(), set()
    for item, body in items:
        w = folded(body)
        windows = {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
        for window in windows:
            for i in range(len(own) - len(window) + 1):
                if tuple(own[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    ids.add(item)
    listed = ",".join(sorted(map(str, ids)))
    return len(own), len(hit), len(ids), sha(listed), bool(hit) and 20 * len(hit) >= len(own)


def repeats(texts, size=35):
    """Per text: words, removed words, digest of the kept ones."""
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    found.sort()
    counts = Counter(k for _, _, k, _ in found)
    return counts["assign"], counts["access"], counts["hex"], sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in found))


def fingerprint(text):
    w = words((text or "").translate(UPPER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for i in range(64):
            counts[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * counts[i] > len(shingles))


def components(rows):
    """rows: (doc_id, text); the fingerprint and component id of each, all pairs compared."""
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for (doc, _), p in zip(rows, prints):
        least[root(p)].append(doc)
    best = {r: min((d for d in ids if d is not None), default=None) for r, ids in least.items()}
    return [(f"{p:016x}", best[root(p)]) for p in prints]


def quality(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    duplicates = len(lines) - len(set(lines))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, duplicates, len(covered), failed


def targets(sizes):
    """sizes: source -> words. Shares by weight; the excess over twice a size goes round again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out = 1.5 * sum(sizes.values()), {}
    open_ = list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ = [s for s in open_ if s not in out]
    return out


TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranking(documents, items, top=10):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    bags = [(d, Counter(TERMS.findall((t or "").translate(UPPER)))) for d, t in documents]
    bags = [(d, bag, sum(bag.values())) for d, bag in bags if bag]
    count, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for d, bag, n in bags:
            m, score = 25 + (75 * n * count) // length, 0
            for term, times in Counter(TERMS.findall((text or "").translate(UPPER))).items():
                if tf := bag[term]:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * df[term] + 1)))
                    score += times * w * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        scores.sort(key=lambda s: (*s[:2], s[2] or 0))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(scores[:top])]
    return sorted(out, key=repr)


LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def spellings(documents):
    """(word, form, root, n, n_near, form_n), near words by the texts that one left-out character gives."""
    counts = Counter()
    for d, text in documents:
        for run in LETTERS.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    own = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near, replaced = defaultdict(set), defaultdict(set)
    for w in own:
        for i in range(len(w)):
            replaced[w[:i], w[i + 1 :]].add(w)
            if (x := w[:i] + w[i + 1 :]) in own:
                near[x].add(w)
                near[w].add(x)
    for group in replaced.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in own.items():
        best = min(((-own[x], x) for x in near[w]), default=None)
        form[w] = best[1] if best and -best[0] >= 2 * n else None
    out = []
    for w, n in own.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), own[form[w]] if form[w] else None))
    return sorted(out)
