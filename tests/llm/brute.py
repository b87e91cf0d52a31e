"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def line_dedup(rows, min_chars=40, min_docs=5):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc_id, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= min_chars and doc_id is not None:
                holders[key(x)].add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def suffix_dedup(rows, length=400):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[i:i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((d, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g))))
    return out


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(rows, percent=75):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for g in s:
            post[g].append(i)
    both = Counter()
    for p in post.values():
        for a in range(len(p)):
            for b in range(a):
                both[p[b], p[a]] += 1
    for (i, j), n in both.items():
        if 100 * n >= percent * (len(sets[i][1]) + len(sets[j][1]) - n):
            a, b = sorted((root(sets[i][0]), root(sets[j][0])))
            parent[b] = a
    return [(d, len(s), root(d)) for d, s in sets]


def decontaminate(rows, bench, size=13):
    windows = defaultdict(set)
    for item, text in bench:
        w = BENCH_WORD.findall(lower(text or ""))
        for i in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[i:i + size])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for d, text in rows:
        w = BENCH_WORD.findall(lower(text or ""))
        hit, items = [False] * len(w), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i:i + n])) in windows:
                    hit[i:i + n] = [True] * n
                    items |= windows[x]
        items.discard(None)
        k = sum(hit)
        out.append((d, len(w), k, len(items), sha(",".join(sorted(map(str, items))).encode()), k > 0 and 20 * k >= len(w)))
    return out


def quality(rows):
    out = []
    for d, text in rows:
        t = text or ""
        w = WORD.findall(t)
        tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        rep = set()
        for i in range(len(w) - 2):
            if tri[tuple(w[i:i + 3])] > 1:
                rep |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep),
                    len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    return out


def url_tree(pages, rules, labels=None, max_children=8, z=2.0, k=10.0, max_purity=0.8, min_labelled=5):
    """{page_id: (host, path, rule, verdict, template, purity)} of (page_id, url) pages, by dictionaries and lists.
    ``rules`` are (verdict, host, path); ``labels`` (page_id -> bad), else a rule's verdict is the label."""
    seen = {}
    for page_id, url in pages:
        rest = (url or "").partition("://")[2]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = lower(rest[:cut])
        path = re.split("[?#]", rest[cut:])[0]
        fits = [(v, h, p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        leaf = re.sub("[0-9]+", "#", path).split("/")
        seen[page_id] = (host, path, rule, tuple(leaf[1:] if path.startswith("/") else leaf))
    bad_of = labels if labels is not None else {i: r[0] == "block" for i, (_, _, r, _) in seen.items() if r}
    template = {(h, leaf): list(leaf) for h, _, _, leaf in seen.values()}
    d = 0
    while True:
        below = defaultdict(list)
        for (h, _), t in template.items():
            if len(t) > d:
                below[h, tuple(t[:d])].append(t)
        if all(len(ts) <= max_children for ts in below.values()):
            break
        for ts in below.values():
            if len({t[d] for t in ts}) > max_children:
                for t in ts:
                    t[d] = "*"
        d += 1
    count = {(h, tuple(t)): [0, 0] for (h, _), t in template.items()}
    for i, (h, _, _, leaf) in seen.items():
        if i in bad_of:
            count[h, tuple(template[h, leaf])][bool(bad_of[i])] += 1
    good, bad = (sum(c[j] for c in count.values()) for j in (0, 1))
    prior = (bad + 0.5) / (good + bad + 1)
    smooth = lambda g, b, to: (b + k * to) / (g + b + k)
    judged, shapes = {}, defaultdict(list)
    for (h, t), (g, b) in count.items():
        if g + b >= min_labelled:
            shapes[h, "/".join(s if "#" in s or s in ("*", "") else "@" for s in t)].append(((b + 1) / (g + b + 2), t, g, b))
            continue
        purity, inner = None, False
        for level in range(max(len(t) - 1, 0), -1, -1):
            pg, pb = (sum(c[j] for (h2, t2), c in count.items() if h2 == h and t2[:level] == t[:level] and len(t2) > level) for j in (0, 1))
            if pg + pb >= min_labelled:
                purity, inner = smooth(g, b, smooth(pg, pb, prior)), level > 0
                break
        purity = smooth(g, b, prior) if purity is None else purity
        judged[h, t] = (purity, inner and purity >= max_purity)
    for (h, _), members in shapes.items():
        groups = []
        for rate, t, g, b in sorted(members):
            if groups:
                bg, bb = (sum(m[j] for m in groups[-1]) for j in (1, 2))
                pooled = (bb + 1) / (bg + bb + 2)
                error = (pooled * (1 - pooled) / (bg + bb + 2) + rate * (1 - rate) / (g + b + 2)) ** 0.5
            if groups and abs(rate - pooled) <= z * error:
                groups[-1].append((t, g, b))
            else:
                groups.append([(t, g, b)])
        for group in groups:
            purity = smooth(sum(m[1] for m in group), sum(m[2] for m in group), prior)
            judged.update({(h, t): (purity, purity >= max_purity) for t, _, _ in group})
    out = {}
    for i, (h, path, rule, leaf) in seen.items():
        t = tuple(template[h, leaf])
        purity, reject = judged[h, t]
        verdict = rule[0] if rule else "block" if reject else "allow"
        out[i] = (h, path, rule and rule[1] + rule[2], verdict, "/".join(t), purity)
    return out
