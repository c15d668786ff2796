"""The contracts as plain loops over one text."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def secrets(t):
    rules = (
        ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    out = []
    for k, (name, p, group, least) in enumerate(rules):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(p, t or "") if len(m[group]) >= least]
    return [sum(k == i for _, k, _ in out) for i in range(3)], sha(x for _, _, x in sorted(out))


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    """Smallest doc_id reachable, for ``[(doc_id, fingerprint)]``; null ids never name."""
    group = list(range(len(prints)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                group[top(i)] = top(j)
    names = {}
    for i, (d, _) in enumerate(prints):
        names.setdefault(top(i), []).append(d)
    return [min((x for x in names[top(i)] if x is not None), default=None) for i in range(len(prints))]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        c = int(c) * (1 + i % 2)
        total += c - 9 if c > 9 else c
    return total % 10 == 0


def private(t):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")),
                "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()

    out, n = [], []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        found = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(kind, m[0])]
        out += found
        n.append(len(found))
    return n, sha(out)


def bench_words(t):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def contamination(docs, items, n=13):
    windows = {}
    for item, t in items:
        w = bench_words(t)
        if w:
            m = min(n, len(w))
            for i in range(len(w) - m + 1):
                windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for t in docs:
        w = bench_words(t)
        hit, found = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                got = windows.get(tuple(w[i : i + m]))
                if got:
                    found |= got
                    hit |= set(range(i, i + m))
        out.append((len(w), len(hit), len(found), sha(sorted(map(str, found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    again = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again),
            len(w) < 10 or 100 * len(again) > 20 * len(w))


def base_scores(docs):
    """``[(doc_id, text)]`` to ``(held_out, n_tokens, n_known, N, base)``."""
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for _, t in docs]
    held = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs]
    c = Counter(x for w, h in zip(tokens, held, strict=True) if not h for x in w)
    n, v = sum(c.values()), len(c)
    return [(h, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
            for w, h in zip(tokens, held, strict=True)]


RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))


def url(u):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]
