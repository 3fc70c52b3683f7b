"""Plain versions of operators, one document or pair at a time, that share no code with the library."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GRIDS = {
    "symbols": (0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
    "upper": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3),
    "lines": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3),
    "repeats": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
}


def words(text):
    return WORD.findall(text or "")


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letters)."""
    text = text or ""
    ws = words(text)
    triples = list(zip(ws, ws[1:], ws[2:]))
    grams = Counter(triples)
    covered = {i + k for i, g in enumerate(triples) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
        len(lines), sum(map(str.isupper, text)), sum(map(str.isalpha, text)),
    )


def base_failed(counts):
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def ratios(c):
    share = lambda a, b: a / b if b else 0.0
    return share(c[2], c[1]), share(c[6], c[7]), share(c[3], c[5]), share(c[4], c[0])


def tail(k, n, p):
    """The probability of k or fewer among n, summed exactly."""
    p = Fraction(p).limit_denominator(10**6)
    return float(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def quality_cutoffs(docs, labels, epsilon=0.02, delta=0.05):
    """{stratum: {rule number: cutoff}} of docs (id, text, stratum) and {id: quality}."""
    good, bad = defaultdict(list), defaultdict(list)
    for i, text, stratum in docs:
        c = quality_counts(text)
        if labels.get(i) in (0, 1) and not base_failed(c):
            (good if labels[i] else bad)[stratum].append(ratios(c))
    grids, out = list(GRIDS.values()), {}
    alpha = delta / max(1, len(good)) / 5
    for stratum, rows in good.items():
        best = (0, 0, (0, 0, 0, 0))
        for absent in (None, 0, 1, 2, 3):
            point, going = [0] * 4, True
            for level in range(1, 7):
                for rule in range(4):
                    if rule == absent or not going:
                        continue
                    point[rule] = level
                    hit = lambda rs: sum(any(c and r[k] > grids[k][c - 1] for k, c in enumerate(point)) for r in rs)  # noqa: B023, E731
                    if tail(hit(rows), len(rows), epsilon) > alpha:
                        going = False
                    else:
                        best = max(best, (hit(bad[stratum]), sum(point), tuple(point)))
        out[stratum] = {k: grids[k][c - 1] for k, c in enumerate(best[2]) if c}
    return out


def quality_kept(text, rules):
    c = quality_counts(text)
    return not base_failed(c) and not any(ratios(c)[k] > cut for k, cut in rules.items())


def five_word_set(text):
    ws = (text or "").translate({i: i + 32 for i in range(65, 91)})
    ws = words(ws)
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def components(items, linked):
    """{item: smallest item it reaches}, by all pairs."""
    up = {i: i for i in items}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    items = sorted(items)
    for n, a in enumerate(items):
        for b in items[n + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in items}


def resemblance_components(texts):
    sets = {i: five_word_set(t) for i, t in texts.items()}
    return components(sets, lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))


def targets(size):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, Fraction(0)), set(order), Fraction(3, 2) * sum(size.values())
    while left > 0 and open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > 2 * size[s]]
        if not over:
            for s in open_:
                target[s] = left * w[s] / total
            break
        for s in over:
            target[s] = Fraction(2 * size[s])
            left -= target[s]
            open_.remove(s)
    return {s: float(t) for s, t in target.items()}


def class_copies(docs):
    """{(source, size): copies of all its documents} of docs (source, size): rates by bisection, then rounding."""
    n = Counter(docs)
    size = Counter()
    for (s, z), m in n.items():
        size[s] += z * m
    goal, out = targets(size), {}
    for s in size:
        classes = sorted((z for t, z in n if t == s), reverse=True)
        mean = size[s] / sum(n[s, z] for z in classes)
        rate = lambda z, x: 1.0 if not z else 2 / (1 + math.exp(-max(-700, min(700, x * z / mean))))  # noqa: B023, E731
        lo, hi = -1e4, 1e4
        if goal[s] >= 2 * size[s]:
            lo = hi
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n[s, z] * z * rate(z, mid) for z in classes) < goal[s] else (lo, mid)
        total, done, rest = 0.0, 0, 0
        for z in classes:
            total += n[s, z] * rate(z, hi)
            out[s, z] = max(0, min(2 * n[s, z], math.floor(total + 0.5) - done))
            done = math.floor(total + 0.5)
        rest = round(goal[s] - sum(z * out[s, z] for z in classes))
        sized = [z for z in classes if z]
        for z in sized:
            near = 0.5 if z == sized[-1] else 0.0
            more = min(math.floor(rest / z + near), 2 * n[s, z] - out[s, z]) if rest > 0 else -min(math.floor(-rest / z + near), out[s, z])
            out[s, z] += more
            rest -= more * z
    return out


def language(text, model):
    """(language, cosine, rejected) from a model's numbers, with counts kept in dicts."""
    letters = [c if c.isalpha() else " " for c in (text or "").lower()]
    if not any(c != " " for c in letters):
        return "und", 0.0, True
    line = " " + " ".join("".join(letters).split()) + " "
    dims, big, odd = len(model.idf), 1 << 64, 0x9E3779B1
    counts = Counter()
    for size in (1, 2, 3):
        for i in range(len(line) - size + 1):
            gram = line[i : i + size]
            if size == 1 and gram == " ":
                continue
            value = 0
            for c in gram:
                value = (value * odd + ord(c)) % big
            counts[((value + size) * 0x9E3779B97F4A7C15 % big >> 40) % dims] += 1
    weight = {k: (1 + math.log(v)) * model.idf[k] for k, v in counts.items()}
    norm = math.sqrt(sum(w * w for w in weight.values()))
    cosines = [sum(c[k] * w for k, w in weight.items()) / norm for c in model.centroids.tolist()]
    best = max(range(len(cosines)), key=lambda i: cosines[i])
    owner = int(model.owner[best])
    return model.languages[owner], cosines[best], cosines[best] < model.floor[owner]
