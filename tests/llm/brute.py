"""Plain versions of the operators for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

SPACE = r"[\x20\x09-\x0D]+"


def word_list(text):
    return [w for w in re.split(SPACE, text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def component_ids(docs, n, percent):
    sets = []
    for _, t in docs:
        w = word_list(lower(t))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for a, (d, _) in enumerate(docs):
        ids = [docs[b][0] for b in range(len(docs)) if find(b) == find(a) and docs[b][0] is not None]
        out.append((d, len(sets[a]), min(ids, default=None) if sets[a] else d))
    return out


def without_repeats(docs, width=400, least_words=0):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(b[s : s + width] for b in texts for s in range(len(b) - width + 1))
    out = []
    for (d, _), b in zip(docs, texts, strict=True):
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if seen[b[s : s + width]] > 1:
                gone[s : s + width] = [True] * width
        starts = [i for i, g in enumerate(gone) if g and not (i and gone[i - 1])]
        runs = 0
        for s in starts:
            e = next((i for i in range(s, len(b)) if not gone[i]), len(b))
            if len(b[s:e].split()) < least_words:
                gone[s:e] = [False] * (e - s)
            else:
                runs += 1
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def base_scores(docs):
    tokens = [[*word_list(lower(t)), None] for _, t in docs]
    c = Counter(w for (d, _), ws in zip(docs, tokens, strict=True) if not held_out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(held_out(d), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (d, _), ws in zip(docs, tokens, strict=True)]


def ppm_scores(docs, order):
    mark = 256
    streams = [[mark] * order + list((t or "").encode()) + [mark] for _, t in docs]
    after = {}
    for (d, _), s in zip(docs, streams, strict=True):
        if not held_out(d):
            for p in range(order, len(s)):
                for k in range(order + 1):
                    after.setdefault(tuple(s[p - k : p]), Counter())[s[p]] += 1
    out = []
    for s in streams:
        total = 0.0
        for p in range(order, len(s)):
            ruled_out = set()
            for k in range(order, -1, -1):
                left = {a: c for a, c in after.get(tuple(s[p - k : p]), {}).items() if a not in ruled_out}
                if not left:
                    continue
                t = sum(left.values())
                if s[p] in left:
                    total += math.log10((2 * left[s[p]] - 1) / (2 * t))
                    break
                total += math.log10(len(left) / (2 * t))
                ruled_out |= set(left)
            else:
                total -= math.log10(257 - len(ruled_out))
        out.append(total)
    return out


def cotrained(rows, prior, rounds, share, bins=1 << 16, steps=256, per_unit=2):
    """What each view learned from by round (bad, good), and both views' calibrated log odds of rows ((text bins, meta bins), y, held)."""
    centre = math.log(prior / (1 - prior))
    views, taught = None, []

    def step(bag, v, weights):
        total = 0.0
        for b in bag[v]:
            total += weights.get(b, 0.0)
        odds = total / math.sqrt(max(len(bag[v]), 1)) if v == 0 else total
        return min(max(math.floor(odds * per_unit) + steps // 2, 0), steps - 1)

    def says(bag, v):
        weights, _, good_from, bad_to = views[v]
        s = step(bag, v, weights)
        return 1 if s >= good_from else 0 if s <= bad_to else None

    for turn in range(rounds):
        models, counts = [], []
        for v in range(2):
            label = [(None if held else y) if y is not None else says(bag, 1 - v) if views else None for bag, y, held in rows]
            n = [sum(c == k for c in label) for k in (0, 1)]
            seen = [Counter(b for (bag, _, _), c in zip(rows, label, strict=True) if c == k for b in bag[v]) for k in (0, 1)]
            weights = {b: math.log((seen[1][b] + 0.5) / (n[1] + 1)) - math.log((seen[0][b] + 0.5) / (n[0] + 1)) for b in seen[0] | seen[1]}
            counts.append(tuple(n))
            at = [step(bag, v, weights) for bag, _, _ in rows]
            pools = []
            for s in range(steps):
                ys = [y for a, (_, y, held) in zip(at, rows, strict=True) if a == s and held and y is not None]
                pools.append([sum(ys) + 0.05 * prior, len(ys) + 0.05, [s]])
                while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
                    good, n_, own = pools.pop()
                    pools[-1] = [pools[-1][0] + good, pools[-1][1] + n_, pools[-1][2] + own]
            calibrated = {s: math.log(p / (1 - p)) for good, n_, own in pools for p in [min(max(good / n_, 1e-4), 1 - 1e-4)] for s in own}
            open_ = Counter(a for a, (_, y, _) in zip(at, rows, strict=True) if y is None)
            budget = share * (turn + 1) * sum(open_.values())
            good_from, bad_to, left = steps, -1, budget * prior
            while left > 0 and good_from > 0 and calibrated[good_from - 1] > centre:
                good_from -= 1
                left -= open_[good_from]
            left = budget * (1 - prior)
            while left > 0 and bad_to + 1 < good_from and calibrated[bad_to + 1] < 0:
                bad_to += 1
                left -= open_[bad_to]
            models.append((weights, calibrated, good_from, bad_to))
        views = models
        taught.append(counts)
    return taught, [tuple(views[v][1][step(bag, v, views[v][0])] for v in range(2)) for bag, _, _ in rows]
