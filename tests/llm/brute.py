"""Plain versions of the operators, one text at a time."""

import hashlib
import re
from collections import Counter, defaultdict

FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def folded(text):
    return FOLDED.findall((text or "").translate(_LOWER))


def plain(text):
    return PLAIN.findall(text or "")


def contamination(texts, items, span=10):
    """(n_words, n_hit, item ids) per text; items are (id, text)."""
    windows = defaultdict(set)
    for name, text in items:
        w = folded(text)
        n = min(len(w), span)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(name)
    sizes = {len(k) for k in windows}
    out = []
    for text in texts:
        w, hit, names = folded(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= {x for x in found if x is not None}
        out.append((len(w), len(hit), names))
    return out


def substring(texts, size=35):
    """(n_words, n_removed, kept) per text."""
    words = [plain(t) for t in texts]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def shingles(text, n=5):
    w = folded(text)
    if len(w) < n:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def similar(texts, least=0.8, n=5):
    """(links, group) per text; the group is the least place of the connected texts, None without words."""
    sets = [shingles(t, n) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    links, parent = [0] * len(texts), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in holders[x] if j > i)
        for j, k in shared.items():
            if k >= least * (len(s) + len(sets[j]) - k) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(links[i], root(i) if s else None) for i, s in enumerate(sets)]


def repeat_words(words, size=5):
    count = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return len({j for i in range(len(words) - size + 1) if count[tuple(words[i : i + size])] > 1 for j in range(i, i + size)})


def phrases(text, table):
    """(n_words, places, labels) of word phrases."""
    w = folded(text)
    at, labels = [], set()
    for phrase, label in table.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), sorted(at), labels


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
