"""Plain versions of the corpus operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spaced(text):
    return SPACED.findall(text or "")


def lowered(text):
    return ALNUM.findall((text or "").translate(LOWER))


def quality(text):
    words = spaced(text)
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def licenses(text):
    words = lowered(text)
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def windows(text, width=10):
    words = lowered(text)
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def leaks(text, items):
    words = lowered(text)
    hit, found = set(), set()
    for item, body in items:
        for w in windows(body):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def repeats(docs, width=20):
    """docs: (doc_id, text) without repeated ids -> {doc_id: (n_words, n_removed, sha)}."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        words = spaced(text)
        gone = set()
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            gone |= set(range(i, i + width)) if w in seen else set()
            seen.add(w)
        out[doc] = len(words), len(gone), sha(" ".join(x for i, x in enumerate(words) if i not in gone))
    return out


def shingles(text, width=4):
    words = spaced((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def classes(docs, width=4, percent=85):
    """docs: (doc_id, text) -> {doc_id: (size, component)}; rows that repeat an id must repeat its text."""
    sets = {d: shingles(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    known = [d for d in sets if sets[d]]
    for i, a in enumerate(known):
        for b in known[:i]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def license_shares(text, templates, least=5, gap=8):
    """(label, largest share of the template that a chain of matches covers) of each (label, template)."""
    words, out = lowered(text), []
    for label, body in templates:
        want = lowered(body)
        longest = [max((n for n in range(k + 2) if any(want[i : i + n] == words[k + 1 - n : k + 1] for i in range(len(want) - n + 1))), default=0) for k in range(len(words))]
        found = []
        for k, n in enumerate(longest):
            if n >= min(least, len(want)) and (k + 1 == len(words) or longest[k + 1] != n + 1):
                found += [(k + 1, i + n, n) for i in range(len(want) - n + 1) if want[i : i + n] == words[k + 1 - n : k + 1]]
        best = {}
        for end, stop, n in sorted(found):
            best[end, stop] = n
            for (e, s), c in list(best.items()):
                new = min(n, end - e, stop - s)
                if new > 0 and end - new - e <= gap and stop - new - s <= gap:
                    best[end, stop] = max(best[end, stop], c + new)
        out.append((label, max(best.values(), default=0) / len(want)))
    return out
