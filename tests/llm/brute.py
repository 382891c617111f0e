"""Plain Python forms of what the operators compute."""

from __future__ import annotations

import math
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def repeated(w, n):
    """Positions covered by repeats of n words or more, and the longest repeat, by comparing all suffixes."""
    covered, longest = set(), 0
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            if i != j:
                k = 0
                while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
        if best >= n:
            covered.update(range(i, i + best))
        longest = max(longest, best)
    return len(covered), longest


def repeated_spans(w, n):
    """The same for long texts: suffixes in order, each compared with its neighbours."""
    order = sorted(range(len(w)), key=lambda i: w[i : i + 200])
    best = [0] * len(w)
    for i, j in zip(order, order[1:]):
        k = 0
        while max(i, j) + k < len(w) and w[i + k] == w[j + k]:
            k += 1
        best[i], best[j] = max(best[i], k), max(best[j], k)
    return len({p for i, k in enumerate(best) if k >= n for p in range(i, i + k)}), max(best, default=0)


def repeat_words(w):
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})


def dup_lines(text):
    seen, n = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            n += line in seen
            seen.add(line)
    return n


def jaccard(rows, n, percent):
    """doc_id, set size, smallest linked doc_id."""
    sets = {}
    for i, text in rows:
        w = words((text or "")) and (text or "").encode().lower().split()
        k = min(n, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    inverted, parent = defaultdict(set), {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in sets.items():
        shared = Counter()
        for g in x:
            shared.update(inverted[g])
            inverted[g].add(i)
        for j, c in shared.items():
            if 100 * c >= percent * (len(x) + len(sets[j]) - c):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(sets[i]), top(i)) for i in sets}


def line_dedup(rows, least):
    """doc_id to text without later copies and number of deleted lines: every run that is just long enough is looked up."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        at = [p for p, line in enumerate(lines) if words(line)]
        n = [len(words(lines[p])) for p in at]
        gone = set()
        for a in range(len(at)):
            total = 0
            for b in range(a, len(at)):
                total += n[b]
                if total >= least and (total - n[b] < least or total - n[a] < least):
                    key = tuple(lines[p] for p in at[a : b + 1])
                    if key in seen:
                        gone.update(at[a : b + 1])
                    seen.add(key)
                if total - n[a] >= least and total - n[b] >= least:
                    break
        out[i] = "\n".join(line for p, line in enumerate(lines) if p not in gone), len(gone)
    return out


def lm(rows, held_out, strengths):
    """doc_id to tokens, known, training tokens, base, score by the smoothing formula and score by an automaton of states,
    arcs and failure arcs."""
    order = len(strengths) + 1
    counts = [Counter() for _ in range(order)]
    token = lambda t: (b"\n", *(t or "").encode().lower().split(), b"\n")
    for i, text in rows:
        if not held_out(i):
            w = token(text)
            for k in range(order):
                counts[k].update(w[j - k : j + 1] for j in range(max(k, 1), len(w)))
    total, distinct = sum(counts[0].values()), len(counts[0])

    def p(gram):
        if len(gram) == 1:
            return (counts[0][gram] + 1) / (total + distinct + 1)
        seen, strength = counts[len(gram) - 2][gram[:-1]], strengths[len(gram) - 2]
        return (counts[len(gram) - 1][gram] + strength * p(gram[1:])) / (seen + strength) if seen else p(gram[1:])

    states = {()} | {g for k in range(order - 1) for g in counts[k]}
    longest = lambda g: next(g[i:] for i in range(len(g) + 1) if g[i:] in states)
    arcs = defaultdict(dict)
    for k in range(order):
        for g in counts[k]:
            arcs[g[:-1]][g[-1]] = math.log10(p(g)), longest(g[-(order - 1) :] if order > 1 else ())
    out = {}
    for i, text in rows:
        w = token(text)
        known = base = score = walked = 0
        state = longest(w[:1] if order > 1 else ())
        for j in range(1, len(w)):
            known += w[j : j + 1] in counts[0]
            base += math.log10(p(w[j : j + 1]))
            score += math.log10(p(w[max(0, j - order + 1) : j + 1]))
            while state and w[j] not in arcs[state]:
                strength = strengths[len(state) - 1]
                walked += math.log10(strength / (counts[len(state) - 1][state] + strength))
                state = longest(state[1:])
            log, state = arcs[state].get(w[j], (math.log10(p(w[j : j + 1])), ()))
            walked += log
        out[i] = len(w) - 1, known, total, base, score, walked
    return out
