"""Plain Python versions of the operators, straight from their contracts."""

import hashlib
import math
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=SPACED):
    return pattern.findall((text or "").translate(UP))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(docs, percent=85):
    """docs: (doc_id, text) -> {doc_id: (n_shingles, component)}"""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    tried = set()
    for group in where.values():
        for x in range(len(group)):
            for y in range(x):
                tried.add((group[y], group[x]))
    for a, b in tried:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def leaks(docs, bench, n=10):
    """{doc_id: (n_words, n_hit, n_items, sha)}"""
    windows = {}
    for item, text in bench:
        w = words(text, PLAIN)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for i, text in docs:
        w, hit, items = words(text, PLAIN), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    items |= own
        names = sorted(str(x) for x in items if x is not None)
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest())
    return out


def longest_matches(docs, bench, n=10):
    """{doc_id: (words, first word, item)} of the longest verbatim match that holds a window"""
    items = [(None if i is None else str(i), words(t, PLAIN)) for i, t in bench]
    begins = {}
    for k, (_, w) in enumerate(items):
        for j in range(max(1, len(w) - n + 1) if w else 0):
            begins.setdefault(tuple(w[j : j + n]), []).append((k, j))
    sizes = {len(w) for w in begins}
    out = {}
    for i, text in docs:
        w, found = words(text, PLAIN), []
        for p in range(len(w)):
            for k, j in [x for s in sizes if p + s <= len(w) for x in begins.get(tuple(w[p : p + s]), ())]:
                own, size = items[k][1], 0
                while p + size < len(w) and j + size < len(own) and w[p + size] == own[j + size]:
                    size += 1
                found.append((-size, p, items[k][0] is None, items[k][0] or ""))
        best = min(found, default=None)
        out[i] = (0, None, None) if best is None else (-best[0], best[1], None if best[2] else best[3])
    return out


def url_odds(pages, ruled, longest=24):
    """pages: (host, path, html), ruled: verdict or None of each -> log odds of block of each page"""
    text = re.compile(r"<(script|style)\b.*?</\1>", re.I | re.S)
    lexicon = {}
    for _, _, html in pages:
        for w in re.findall("[a-z]+", re.sub("<[^>]*>", " ", text.sub(" ", html or "")).translate(UP)):
            if len(w) <= longest:
                lexicon[w] = lexicon.get(w, 0) + 1
    total = sum(lexicon.values())

    def split(name):
        best = [(0.0, ())] + [None] * len(name)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - longest), end):
                w = name[start:end]
                cost = best[start][0] + (-math.log(lexicon[w] / total) if w in lexicon else math.log(total / 10) + len(w) * math.log(10))
                if best[end] is None or cost < best[end][0]:
                    best[end] = cost, (*best[start][1], w)
        return best[-1][1]

    def tokens(kind, x):
        for run in re.findall(r"[a-z]+|[0-9]+|[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", x.translate(UP)):
            for w in split(run) if "a" <= run[0] <= "z" else ("#" * len(run) if "0" <= run[0] <= "9" else run,):
                yield kind, w

    made = [[*tokens("h", host), *tokens("p", path)] for host, path, _ in pages]
    n = {"block": {}, "allow": {}}
    for ts, verdict in zip(made, ruled, strict=True):
        for t in ts if verdict else ():
            n[verdict][t] = n[verdict].get(t, 0) + 1
    known = n["block"].keys() | n["allow"].keys()
    size = {v: sum(n[v].values()) + len(known) for v in n}
    prior = math.log(ruled.count("block") / ruled.count("allow"))
    log = lambda t, v: math.log((n[v].get(t, 0) + 1) / size[v])
    return [prior + sum(log(t, "block") - log(t, "allow") for t in ts if t in known) for ts in made]


def licenses(files, templates, speaks, license_file, least):
    """files: (path, text) -> (license, score) of each by whole TF-IDF vectors, None without one"""
    split = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    forms = [(name, split(f)) for name in sorted(templates) for f in templates[name].split("|")]
    vocabulary = {w for _, f in forms for w in f}
    df = {w: sum(w in set(split(t or "")) for _, t in files) for w in vocabulary}
    idf = lambda w: math.log((len(files) + 1) / (df.get(w, 0) + 1)) + 1
    vector = lambda ws: {w: ws.count(w) * idf(w) for w in set(ws)}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(name, vector(f)) for name, f in forms]
    out = []
    for path, text in files:
        found = [x for x in re.split(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]|(?<=[.!?;])[ \t\n\x0b\f\r]+", text or "") + re.split(r"\n[ \t]*\n", text or "") if re.search(speaks, x)]
        if re.search(license_file, (path or "").split("/")[-1]) and re.search(speaks, text or ""):
            found.append(text)
        best = None
        for v in (vector(split(x)) for x in found):
            for order, (name, t) in enumerate(known):
                score = round(sum(v[w] * t[w] for w in v.keys() & t.keys()) / (size(v) * size(t)), 6)
                if score >= least and (best is None or (score, -order) > best[:2]):
                    best = (score, -order, name)
        out.append(best and (best[2], best[0]))
    return out
