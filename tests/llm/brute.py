"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def lower(text: str) -> str:
    return text.encode().lower().decode()


def counts(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(5)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def kept_lines(docs: list[tuple]) -> list[tuple]:
    """(doc_id, n_lines, n_dropped, sha256) for (doc_id, text); a null id is smaller than all."""
    key = lambda line: lower(line.strip(SPACES))
    rank = lambda d: -1 if d is None else d
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(rank(doc))
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        gone = lambda line: len(holders.get(key(line), ())) >= 5 and rank(doc) != max(holders[key(line)])  # noqa: B023, E731
        stay = [x for x in lines if not gone(x)]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return out


def shingles(text: str | None, size: int) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(docs: list[tuple], size: int, percent: int = 80) -> list[tuple]:
    """(doc_id, n_shingles, component_id, kept) for (doc_id, text)."""
    sets = [shingles(t, size) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [
        (doc, len(sets[i]), least.get(find(i)) if sets[i] else doc, doc == (least.get(find(i)) if sets[i] else doc))
        for i, (doc, _) in enumerate(docs)
    ]


def smallest_capacity(sizes: list[int], shards: int) -> int:
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        middle, used, left = (low + high) // 2, 1, (low + high) // 2
        for s in sizes:
            if s > left:
                used, left = used + 1, middle
            left -= s
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low
