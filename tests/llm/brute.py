"""Plain versions of the operators, written apart from them."""

import re

import numpy as np
import xxhash


def simhash(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    rows = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in rows]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, near):
    """Least id reachable, for each position; near(i, j): whether two positions are linked."""
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if near(i, j):
                root[find(i)] = find(j)
    least = {}
    for k in range(len(ids)):
        if ids[k] is not None:
            least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [least.get(find(k)) for k in range(len(ids))]


def tokens(text):
    import regex

    return regex.findall(r"[\p{L}\p{M}\p{Nd}]+", (text or "").lower())


def leak(words, item, span=13, slack=2, least=5):
    """The best overlap and where it begins first; None if there is none."""
    span = min(span, len(item))
    if len(item) < least or len(words) < span:
        return None
    slack = slack if span == 13 else 1 if span >= 7 else 0
    best, first = 0, None
    for i in range(len(words) - span + 1):
        for j in range(len(item) - span + 1):
            same = sum(a == b for a, b in zip(words[i : i + span], item[j : j + span]))
            if same >= span - slack:
                best, first = max(best, same), i if first is None else first
    return (best, first) if best else None


def nearest(ids, x, query, k):
    """The k nearest of different ids to the query's vector."""
    own = ids.index(query)
    score = [(-float(np.dot(np.array(x[own], float), np.array(v, float))), i) for i, v in zip(ids, x) if i != query]
    return [i for _, i in sorted(score)[:k]]


def shingles(text, shingle=5):
    """A text's set of word shingles."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def jaccard(a, b, shingle=5):
    """The similarity of two texts' sets of word shingles, as a fraction."""
    from fractions import Fraction

    a, b = shingles(a, shingle), shingles(b, shingle)
    return Fraction(len(a & b), len(a | b)) if a | b else Fraction(1)
