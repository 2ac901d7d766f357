"""Plain Python counterparts of the operators, and a table of awkward rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, r long, score double, root int, size string"


def awkward() -> list[tuple]:
    """Rows with nulls, empty, short and very long texts, ties, repeats; some columns clash with results."""
    base = " ".join(f"word{i * i % 97} and{i}" for i in range(300))
    shared = "The same long passage stands here in several texts, word by word. " * 9
    texts: list[tuple[int | None, str | None, str | None]] = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "ONE", "b"), (6, "one two three four", "b"),
        (7, base, "a"), (8, base, "a"), (8, base, "a"), (9, base.upper(), "c"), (10, base.replace("and7", "xxx"), "c"),
        (11, base.replace("and7", "xxx").replace("and250", "yyy"), None), (12, "x" + shared + "tail one", "c"),
        (13, "other start " + shared, "é"), (14, "a" * 1500, "\U0001f600"), (15, "a" * 399 + "b", "ﬁ"), (16, "ab " * 700, "a"),
        (17, "é日本 \U0001f642 naïve " * 60, "a"), (18, "\x00\x1c\x85  mixed\r\nlines\n\nend\n", "a"),
        (None, base, "a"), (None, None, None), (None, "alone with a null id here today", "a"), (19, "line\n" * 40 + "last", "b"),
        (20, (base + "\n") * 40, "a"), (21, "don't 's 're it's <|endoftext|> ok<|endoftext|>", "a"), (22, "tok " * 9 + "end", "b"),
    ]
    return [(i, t, "en", s, None, i, 0.5, 1, "x") for i, t, s in texts]


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def crc(value: int | None) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def least(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


class Groups:
    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.top(a)] = self.top(b)

    def least(self, ids: list) -> list:
        groups = defaultdict(list)
        for i, x in enumerate(ids):
            groups[self.top(i)].append(x)
        return [least(groups[self.top(i)]) for i in range(len(ids))]


def ngram_rows(rows: list[tuple], n: int = 5, num: int = 75, den: int = 100) -> list[tuple]:
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    groups, shared = Groups(len(rows)), Counter()
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for h in holders.values():
        shared.update(combinations(h, 2))
    for (a, b), o in shared.items():
        if den * o >= num * (len(sets[a]) + len(sets[b]) - o):
            groups.join(a, b)
    return [(i, len(s), c) for (i, _), s, c in zip(rows, sets, groups.least([i for i, _ in rows]), strict=True)]


def repeat_rows(rows: list[tuple], depth: int = 400) -> list[tuple]:
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i:i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for (key, _), d in zip(rows, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - depth + 1):
            if seen[d[i:i + depth]] > 1:
                gone[i:i + depth] = b"\1" * depth
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((key, len(d), len(d) - len(kept), runs, sha(kept)))
    return out


def shared_words(rows: list[tuple], n: int = 50) -> list[int]:
    """Words of each text in windows of ``n`` words that another row (of another id or text) has too."""
    texts = [words(t) for _, t in rows]
    holders = defaultdict(set)
    for row, w in zip(rows, texts, strict=True):
        for i in range(len(w) - n + 1):
            holders[tuple(w[i:i + n])].add(row)
    out = []
    for w in texts:
        hit = set()
        for i in range(len(w) - n + 1):
            if len(holders[tuple(w[i:i + n])]) > 1:
                hit.update(range(i, i + n))
        out.append(len(hit))
    return out


def rule_measures(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    count, hit = Counter(windows), set()
    for i, x in enumerate(windows):
        if count[x] > 1:
            hit.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def secret_base(text: str | None) -> dict[str, list[tuple[int, int]]]:
    text = text or ""
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    return {"assign": [m.span() for m in assign.finditer(text) if len(m[2]) >= 6],
            "access": [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
            "hex": [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]}


def secret_weak(text: str | None, reach: int = 400) -> list[tuple[str, int, int]]:
    """Weak candidates beside the parts they need: every pair of a scope is looked at."""
    text = text or ""
    tokens = [m for m in re.finditer("[A-Za-z0-9+/_-]{16,}", text)]
    some = lambda p, s: re.search(p, s) is not None
    ident = [m.span() for m in tokens if re.fullmatch("[A-Z0-9]{16,32}", m[0]) and some("[0-9]", m[0]) and some("[A-Z]", m[0]) and not m[0].startswith("AKIA")]
    key = [m.span() for m in tokens if 32 <= len(m[0]) <= 64 and all(some(p, m[0]) for p in ("[0-9]", "[A-Z]", "[a-z]"))]
    end = [m.span() for m in re.finditer(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\x20\x09-\x0D\"'<>]*", text)]
    breaks = [m.span() for m in re.finditer(r"\n[\x20\x09]*\n", text)]
    scope = lambda s: sum(b[0] <= s[0] for b in breaks)
    near = lambda a, b: scope(a) == scope(b) and a[0] - b[1] <= reach and b[0] - a[1] <= reach
    ids = ident + secret_base(text)["access"]
    out = [("ident", *a) for a in ident if any(near(a, b) for b in key)]
    out += [("key", *a) for a in key if any(near(a, b) for b in ids + end)]
    return out + [("endpoint", *a) for a in end if any(near(a, b) for b in key)]


def url_verdict(url: str | None) -> tuple[str, str, str | None, str]:
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    at = (url or "").find("://")
    rest = url[at + 3:] if url and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(LOWER)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def base_scores(rows: list[tuple]) -> list[tuple]:
    """held_out, n_tokens, n_known, N and the unigram score of each row."""
    import math

    tokens = lambda t: [*words((t or "").translate(LOWER)), None]
    count = Counter(w for i, t in rows if crc(i) % 10 for w in tokens(t))
    n, v = sum(count.values()), len(count)
    out = []
    for i, t in rows:
        w = tokens(t)
        score = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, crc(i) % 10 == 0, len(w), sum(count[x] > 0 for x in w), n, score))
    return out


def tree_log10(train: list[bytes], texts: list[bytes], depth: int, resolution: float) -> list[float]:
    """Context-tree weighting by its definition, one bit at a time, with exact fractions of counts."""
    import math

    counts: dict[tuple[int, bytes], Counter] = defaultdict(Counter)
    total = 0
    for t in train:
        s = bytes(depth) + t + b"\xff"
        for i in range(depth, len(s)):
            total += 1
            for d in range(depth + 1):
                counts[d, s[i - d:i]][s[i]] += 1
    nodes = {k: c for k, c in counts.items() if sum(c.values()) >= total * resolution} or {(0, b""): Counter()}

    def bits(c: Counter, level: int, prefix: int) -> tuple[int, int]:
        pair = [0, 0]
        for byte, n in c.items():
            if byte >> (8 - level) == prefix:
                pair[byte >> (7 - level) & 1] += n
        return pair[0], pair[1]

    def log_pe(z: int, o: int) -> float:
        return math.lgamma(z + .5) + math.lgamma(o + .5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def rest(k: tuple[int, bytes]) -> Counter:
        left = Counter(nodes[k])
        for (d, c), n in nodes.items():
            if d == k[0] + 1 and c[1:] == k[1]:
                left.subtract(n)
        return left

    def plus(a: float, b: float) -> float:
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    memo: dict = {}

    def weighted(k: tuple[int, bytes], at: tuple[int, int]) -> tuple[float, float]:
        if (k, at) not in memo:
            own = log_pe(*bits(nodes[k], *at))
            if k[0] == depth:
                memo[k, at] = own, 1.0
            else:
                below = log_pe(*bits(rest(k), *at)) + sum(weighted(c, at)[0] for c in nodes if c[0] == k[0] + 1 and c[1][1:] == k[1])
                both = plus(own, below)
                memo[k, at] = both + math.log(.5), math.exp(own - both)
        return memo[k, at]

    kt = lambda pair: (pair[1] + .5) / (sum(pair) + 1)
    out = []
    for t in texts:
        s, logs = bytes(depth) + t + b"\xff", 0.0
        for i in range(depth, len(s)):
            path = [(0, b"")]
            while path[-1][0] < depth and (d := path[-1][0] + 1, s[i - d:i]) in nodes:
                path.append((d, s[i - d:i]))
            for level in range(8):
                at = level, s[i] >> (8 - level)
                p = kt(bits(nodes[path[-1]], *at)) if path[-1][0] == depth else kt(bits(rest(path[-1]), *at))
                for k in reversed(path if path[-1][0] < depth else path[:-1]):
                    w = weighted(k, at)[1]
                    p = w * kt(bits(nodes[k], *at)) + (1 - w) * p
                logs += math.log10(p if s[i] >> (7 - level) & 1 else 1 - p)
        out.append(logs)
    return out


def mix(rows: list[tuple], seed: int = 0) -> dict:
    """Source sizes, targets by the rule as told, and the words taken of each row."""
    size = [len(words(t)) for _, _, t in rows]
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)}
    whole = {s: sum(n for n, (_, x, _) in zip(size, rows, strict=True) if x == s) for s in sources}
    target, free, left = dict.fromkeys(sources, 0.0), set(sources), float(sum(size))
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        for s in free:
            target[s] += share * weight[s]
        left = sum(max(target[s] - 3 * whole[s], 0) for s in free)
        for s in list(free):
            if target[s] >= 3 * whole[s]:
                target[s] = 3.0 * whole[s]
                free.discard(s)
    return {"size": size, "whole": whole, "target": target}
