"""Similarities of two names by their definition, to hold the batch forms against."""

from difflib import SequenceMatcher


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def sequence_ratio(a, b):
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def word_score(q, c):
    if min(len(q), len(c)) < 3:
        return 0.0
    if q == c:
        return 1.0
    if q in c or c in q:
        return 0.8
    r = SequenceMatcher(None, q, c).ratio()
    return 0.6 * r if r >= 0.75 else 0.0


def confidence(query, candidate):
    if not query or not candidate:
        return 0.0
    if query == candidate:
        return 1.0
    q, c = query.split(), candidate.split()
    if not q or not c:
        return 0.0
    both = len(set(q) & set(c))
    jaccard, coverage = both / len(set(q) | set(c)), (both / len(set(q)) + both / len(set(c))) / 2
    near = [s for x in q for y in c if (s := word_score(x, y))]
    sequence = SequenceMatcher(None, query, candidate).ratio()
    score = 0.35 * sequence + 0.25 * jaccard + 0.15 * (sum(near) / len(near) if near else 0) + 0.15 * coverage + 0.1 * min(len(q), len(c)) / max(len(q), len(c))
    if sequence >= 0.75 and jaccard >= 0.7:
        score = min(1.0, 1.05 * score)
    long = [w for w in q if len(w) >= 4]
    hits = sum(w in c for w in long)
    return min(1.0, score + (0.2 * hits / len(long) if hits >= 2 else 0))
