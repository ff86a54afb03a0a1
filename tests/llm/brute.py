"""Plain versions of the corpus operators and a small awkward corpus."""
from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size int, part int, node string"


def sha(s) -> str:
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def corpus(seed: int = 1, with_nulls: bool = True) -> list[tuple]:
    """Copies, near copies, shared passages and lines, long and empty texts, odd characters, nulls,
    a repeated row and columns whose names operators use inside."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7)))
    para = lambda n: " ".join(word() for _ in range(n))
    line, passage, base = para(14), para(60), [word() for _ in range(80)]
    texts = ["", " ", "\n\n", "x", "word", "a b c", "日本語 テキスト 😀" * 3, "z" * 3000, "ab " * 2000, "mail a.b@c.org ip 10.0.0.1 card 4111111111111111 tel +1 (212) 555-0100"]
    texts += [para(40) + "\n" + ("  " + line.title() if k % 2 else line + "\t") + "\n" + para(20) for k in range(8)]
    texts += [para(30) + " " + passage + " " + para(30) for _ in range(6)]
    for k in range(9):
        near = list(base)
        near[r.randrange(80)] = word()
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 5 + [para(r.randint(1, 200)) for _ in range(25)] + [para(4000)]
    rows = [(i, t) for i, t in enumerate(texts)]
    if with_nulls:
        rows += [(900, None), (901, None), rows[12], (None, para(70))]
    r.shuffle(rows)
    return [(i, t, None, "s", len(t or ""), 7, 1, 2, "n") for i, t in rows]


def as_id(i):
    return -1 if i is None else i


def lines(rows):
    held = defaultdict(set)
    for i, t in rows:
        for k in {x.strip(" \t\n\x0b\f\r").translate(UPPER) for x in (t or "").split("\n")}:
            held[k].add(as_id(i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = []
        for x in own:
            k = x.strip(" \t\n\x0b\f\r").translate(UPPER)
            if len(k) < 40 or len(held[k]) < 5 or as_id(i) == max(held[k]):
                kept.append(x)
        out.append((i, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def shingles(t) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows, percent: int = 85):
    """doc_id -> smallest id reachable; rows of one id are one document."""
    up = {as_id(i): as_id(i) for i, _ in rows}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    sets = [(as_id(i), shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [(i, len(s), top(as_id(i))) for (i, _), (_, s) in zip(rows, sets)]


def repeats(rows, depth: int = 50):
    first: dict[bytes, int] = {}
    coded = sorted(((as_id(i), (t or "").encode()) for i, t in rows))
    for i, b in coded:
        for p in range(len(b) - depth + 1):
            first.setdefault(b[p:p + depth], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - depth + 1):
            if first[b[p:p + depth]] < as_id(i):
                gone[p:p + depth] = [True] * depth
        out.append((i, len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


PATTERNS = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "email"), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "ip"),
            (r"[0-9]([\x20-]?[0-9])+", "card"), (r"\+[0-9][\x20().0-9-]+[0-9]", "phone"))


def personal(t) -> list[tuple]:
    out = []
    for pattern, kind in PATTERNS:
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "phone": 8 <= len(d) <= 15,
                  "card": 16 <= len(d) <= 19 and sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(d[::-1])) % 10 == 0}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


