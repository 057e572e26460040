"""Plain single-process versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def held_out(doc_id, modulus: int, remainder: int) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def base_quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def shingles(text: str | None) -> frozenset:
    w = words(lower(text or ""))
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def components(rows: list[tuple]) -> list[tuple]:
    """rows: (id, text). Per row: set size and the least id that is not null of its component."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            root = find(i)
            least[root] = min(least.get(root, doc), doc)
    return [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def repeated_words(rows: list[tuple], length: int = 50) -> dict:
    """rows: (id, text), ids distinct. Word numbers of each id that lie in windows with an earlier occurrence elsewhere."""
    first: dict = {}
    texts = {doc: words(t) for doc, t in rows}
    for doc in sorted(texts):
        for i in range(len(texts[doc]) - length + 1):
            first.setdefault(tuple(texts[doc][i : i + length]), (doc, i))
    out = defaultdict(set)
    for doc, w in texts.items():
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] != (doc, i):
                out[doc].update(range(i, i + length))
    return out


def good_turing(counts: list[int], k: int) -> list[float]:
    """Katz's factors for counts 1 to k from the numbers of types seen 1 to k + 1 times; absolute discounting
    (all but a thousandth of n1 / (n1 + 2 n2)) where those do not give factors between 0 and 1."""
    n = dict(enumerate(counts, 1))
    b = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    other = [1 - 0.999 * b / r for r in range(1, k + 1)]
    if not all(n[r] > 0 for r in range(1, k + 2)) or (common := (k + 1) * n[k + 1] / n[1]) >= 1:
        return other
    out = [((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) for r in range(1, k + 1)]
    return out if min(out) > 0 and max(out) < 1 else other


def katz(rows: list[tuple], k: int = 5) -> list[tuple]:
    """rows: (id, text). Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts = [[*words(lower(t or "")), None] for _, t in rows]
    out_of = [held_out(doc, 7, 2) for doc, _ in rows]
    one, two, history = Counter(), Counter(), Counter()
    for t, out in zip(texts, out_of, strict=True):
        if not out:
            s = ["<s>", *t]
            one.update(t)
            two.update(zip(s, t, strict=False))
            history.update(s[:-1])
    total, types = sum(one.values()), len(one)
    d1, d2 = (good_turing([Counter(c.values())[r] for r in range(1, k + 2)], k) for c in (one, two))
    cut = lambda n, d: n * (d[n - 1] if n <= k else 1)
    unknown = 1 - sum(cut(n, d1) for n in one.values()) / total if total else 1.0
    p = lambda w: cut(one[w], d1) / total if one[w] else unknown
    mass, lower_mass = defaultdict(float), defaultdict(float)
    for (h, w), n in two.items():
        mass[h] += cut(n, d2)
        lower_mass[h] += p(w)

    def log(h, w):
        if two[(h, w)]:
            return math.log10(cut(two[(h, w)], d2) / (history[h] + 1))
        return math.log10((1 - mass[h] / (history[h] + 1)) / (1 - lower_mass[h]) * p(w))

    return [(doc, out, len(t), sum(one[w] > 0 for w in t), total, sum(math.log10((one[w] + 1) / (total + types + 1)) for w in t), sum(log(h, w) for h, w in zip(["<s>", *t], t, strict=False))) for (doc, _), t, out in zip(rows, texts, out_of, strict=True)]


def mcd_distances(groups: list, vectors: list, floors: tuple, share: float, prior: int, factor: float) -> list[float]:
    """Squared distance of each vector to its group's estimate mixed with that over all; see the operator's docstring."""
    import numpy as np

    x, n_all, extra = np.array(vectors, dtype=float), len(vectors), np.diag(np.square(floors))

    def middle(v):
        cells = np.sort(np.floor(np.abs(v) * 1000 + 0.5) * np.sign(v))
        return cells[(len(cells) + 1) // 2 - 1] / 1000

    def distances(rows, centre, cov):
        off = rows - centre
        return np.einsum("ij,ij->i", off, np.linalg.solve(cov + extra, off.T).T)

    def step(rows, centre, cov):
        cells = np.floor(np.log2(distances(rows, centre, cov) + 1) * 64)
        last = np.sort(cells)[int(np.ceil(share * len(rows))) - 1]
        near = rows[cells <= last]
        return near.mean(axis=0), np.cov(near.T, bias=True) * factor

    def estimate(rows):
        centre = np.array([middle(c) for c in rows.T])
        spread = np.array([middle(np.abs(c - m)) for c, m in zip(rows.T, centre, strict=True)])
        ends = []
        for start in ((centre, np.diag((1.4826 * spread) ** 2)), (centre, np.zeros_like(extra)), (rows.mean(axis=0), np.cov(rows.T, bias=True))):
            now = step(rows, *start)
            det = lambda e: np.linalg.slogdet(e[1] + extra)[1]
            while det(new := step(rows, *now)) < det(now) - 1e-6:
                now = new
            ends.append((round(det(now), 6), len(ends), now))
        return min(ends, key=lambda e: e[:2])[2]

    every = estimate(x)
    out = [0.0] * n_all
    for g in set(groups):
        own = [i for i, other in enumerate(groups) if other == g]
        m, s = estimate(x[own])
        w = len(own) / (len(own) + prior)
        gap = (m - every[0])[:, None]
        d = distances(x[own], w * m + (1 - w) * every[0], w * s + (1 - w) * every[1] + w * (1 - w) * gap @ gap.T)
        for i, v in zip(own, d.tolist(), strict=True):
            out[i] = v
    return out


def toxicity(learned: list[tuple], texts: list, rules, steps: int, most: int = 4096, least_docs: int = 4, l2: float = 1.0, counterfactual: float = 4.0) -> list[float]:
    """Scores of texts by a fit on (text, label), weight by weight. rules: the module with the fixed identity terms."""
    successor = {t: kind[(i + 1) % len(kind)] for kind in rules.IDENTITY_TERMS for i, t in enumerate(kind)}
    kind_of = {t: kind for kind in rules.IDENTITY_TERMS for t in kind}

    def features(words):
        return {f for w in words for f in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)]}

    def tokens(text):
        return re.findall(r"[^\W\d_]+", (text or "").lower())

    def other(words):
        first: dict = {}
        return [first.setdefault(kind_of[w], successor[w]) if w in kind_of else w for w in words]

    plain = [features(tokens(t)) for t, _ in learned]
    swapped = [features(other(tokens(t))) if set(other(tokens(t))) != set(tokens(t)) else None for t, _ in learned]
    y = [label for _, label in learned]
    n, share = len(y), sum(y) / len(y)
    score = {}
    for f in set().union(*plain):
        with_f = sum(f in p for p in plain)
        toxic = sum(label for p, label in zip(plain, y, strict=True) if f in p)
        chi = ((toxic - with_f * share) ** 2 / max(with_f * share, 1e-9) + ((with_f - toxic) - with_f * (1 - share)) ** 2 / max(with_f * (1 - share), 1e-9)) * n / max(n - with_f, 1)
        if with_f >= least_docs and chi > 4:
            score[f] = chi
    chosen = sorted(score)
    assert len(chosen) <= most
    w, b = dict.fromkeys(chosen, 0.0), math.log(share / (1 - share))
    m, v = dict.fromkeys([*chosen, None], 0.0), dict.fromkeys([*chosen, None], 0.0)
    pairs = [(p, s) for p, s in zip(plain, swapped, strict=True) if s is not None]
    for t in range(1, steps + 1):
        grad = {f: l2 * w[f] / n for f in chosen} | {None: 0.0}
        for p, label in zip(plain, y, strict=True):
            error = (1 / (1 + math.exp(-(b + sum(w[f] for f in p if f in w)))) - label) / n
            grad[None] += error
            for f in p:
                if f in w:
                    grad[f] += error
        for p, s in pairs:
            gap = (sum(w[f] for f in p if f in w) - sum(w[f] for f in s if f in w)) * 2 * counterfactual / len(pairs)
            for f in p - s:
                if f in w:
                    grad[f] += gap
            for f in s - p:
                if f in w:
                    grad[f] -= gap
        for f in [*chosen, None]:
            m[f], v[f] = 0.9 * m[f] + 0.1 * grad[f], 0.999 * v[f] + 0.001 * grad[f] ** 2
            step = 0.05 * (m[f] / (1 - 0.9**t)) / (math.sqrt(v[f] / (1 - 0.999**t)) + 1e-9)
            if f is None:
                b -= step
            else:
                w[f] -= step
    return [1 / (1 + math.exp(-min(30.0, max(-30.0, b + sum(w[f] for f in features(tokens(t)) if f in w))))) for t in texts]
