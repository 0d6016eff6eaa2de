"""Plain versions of the contracts, over Python lists."""

import hashlib
import re
from collections import Counter, defaultdict

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, k=4):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, sa in sets:
        for b, sb in sets:
            if sa and sb and 100 * len(sa & sb) >= 85 * len(sa | sb):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def repeats(docs, width=400):
    data = [(i, (t or "").encode()) for i, t in docs]
    count = Counter(d[p : p + width] for _, d in data for p in range(len(d) - width + 1))
    out = {}
    for i, d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - width + 1):
            if count[d[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def passages(docs, size=51):
    """Words in strings of size words that stand twice or more."""
    texts = [(i, re.split(r"[\x20\x09-\x0D]+", (t or "").strip(" \t\n\x0b\x0c\r"))) for i, t in docs]
    count = Counter(tuple(w[p : p + size]) for _, w in texts for p in range(len(w) - size + 1))
    return {i: len({q for p in range(len(w) - size + 1) if count[tuple(w[p : p + size])] > 1 for q in range(p, p + size)}) for i, w in texts}


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            rep |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def spans_sha(spans, order):
    return sha(",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order.index(s[0])))))


def secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return out


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return out


def contamination(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = tuple(word.findall(lower(text or "")))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows[w[i : i + window]].add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for i, text in docs:
        w = tuple(word.findall(lower(text or "")))
        hit, found = set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if w[p : p + n] in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[w[p : p + n]]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out
