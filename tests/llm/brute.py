"""Plain versions of the operators, to hold their results against."""
import collections
import hashlib
import math
import re
import zlib

WORDS = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SECRETS = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def secrets(text):
    found = sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(SECRETS) for m in p.finditer(text or "") if ok(m))
    return [(name, a, b) for a, _, name, b in found]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def near(docs, words, percent=80):
    """Component of each id, over all pairs."""
    sets = {}
    for i, text in docs:
        w = WORDS.findall(lower(text))
        sets[i] = {tuple(w[a : a + words]) for a in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in sorted(sets.items()):
        shared = collections.Counter(j for g in s for j in holders[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return {i: root(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def contamination(docs, items, width=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for a in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[a : a + width])].add(str(item))
    sizes = sorted({len(k) for k in windows})
    out = {}
    for i, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if key := windows.get(tuple(w[a : a + n])):
                    found |= key
                    hit[a : a + n] = [True] * n
        out[i] = (len(w), sum(hit), len(found), sha(",".join(sorted(found))), any(hit))
    return out


def base_scores(docs):
    tokens = {i: [*WORDS.findall(lower(t)), None] for i, t in docs}
    c = collections.Counter(x for i, w in tokens.items() if fold(i, 7) != 2 for x in w)
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, w in tokens.items()}
