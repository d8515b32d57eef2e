"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> bytes:
    return (text or "").encode().lower()


def words(text: str | None) -> list[bytes]:
    return WORD.findall(lower(text))


def shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    ws = words(text)
    if not ws:
        return set()
    return {tuple(ws[i : i + size]) for i in range(max(len(ws) - size + 1, 1))}


def components(docs: list[tuple], size: int) -> dict[int, tuple[int, int]]:
    """id: (set size, least id reachable), of documents with an id."""
    known = [(i, shingles(t, size)) for i, t in docs if i is not None]
    up = {i: i for i, _ in known}

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(a), root(i)) for i, a in known}


def repeated(texts: list[bytes], length: int = 200) -> list[list[bool]]:
    """Which bytes lie in a string of that length that starts elsewhere too."""
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = [False] * len(t)
        until = 0
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                until = k + length
            if k < until:
                cover[k] = True
        for k in range(max(len(t) - length + 1, 0), len(t)):
            cover[k] = k < until
        out.append(cover)
    return out


def quantised(count: int) -> int:
    """Counts of pairs as the model keeps them: exact to 32, then rounded down to one of twelve steps to the doubling."""
    if count <= 32:
        return count
    return math.floor(max(v for v in (2 ** (5 + k / 12) for k in range(224)) if v <= count + 1e-9) + 1e-9)


def bigram_scores(docs: list[tuple], mu: float) -> dict:
    """id: (held_out, n_tokens, n_known, train_tokens, base, score)."""
    tokens = {i: [*words(t), None] for i, t in docs}
    out = {i for i in tokens if zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2}
    one, two, before = Counter(), Counter(), Counter()
    for i, ts in tokens.items():
        if i not in out:
            one.update(ts)
            for v, w in zip(["start", *ts[:-1]], ts, strict=True):
                two[v, w] += 1
                before[v] += 1
    n, kinds = sum(one.values()), len(one)
    p = lambda w: (one[w] + 1) / (n + kinds + 1)
    result = {}
    for i, ts in tokens.items():
        base = sum(math.log10(p(w)) for w in ts)
        score = sum(math.log10((quantised(two[v, w]) + mu * p(w)) / (before[v] + mu)) for v, w in zip(["start", *ts[:-1]], ts, strict=True))
        result[i] = (i in out, len(ts), sum(one[w] > 0 for w in ts), n, base, score)
    return result


def kneser_ney(train: list[bytes], order: int):
    """log probability of a byte after others, by interpolated modified Kneser-Ney; texts start after line ends."""
    counts: list[Counter] = [Counter() for _ in range(order + 1)]
    for t in train:
        s = b"\n" * (order - 1) + t
        for k in range(order - 1, len(s)):
            counts[order][s[k - order + 1 : k + 1]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    tables = []
    for n in range(1, order + 1):
        of = Counter(counts[n].values())
        n1, n2, n3, n4 = (max(of.get(k, 0), 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        tables.append([min(max(x, 0.1), k + 0.9) for k, x in enumerate(raw)])
    totals = [defaultdict(lambda: [0, 0.0]) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            both = totals[n][g[:-1]]
            both[0] += c
            both[1] += tables[n - 1][min(c, 3) - 1]

    def p(gram: bytes) -> float:
        n = len(gram)
        if n == 0:
            return 1 / 256
        low = p(gram[1:])
        if gram[:-1] not in totals[n]:
            return low
        total, back = totals[n][gram[:-1]]
        c = counts[n][gram]
        return (c - tables[n - 1][min(c, 3) - 1] if c else 0) / total + back / total * low

    return p


def perplexity(p, text: bytes, order: int) -> float:
    s = b"\n" * (order - 1) + text
    return math.exp(-sum(math.log(p(s[k - order + 1 : k + 1])) for k in range(order - 1, len(s))) / len(text))


def best_fit(lengths: list[int], capacity: int) -> int:
    """How many sequences best-fit decreasing opens."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            g = min(fit)
            gaps.remove(g)
            gaps.append(g - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def documents() -> list[tuple]:
    """(doc_id, text, lang, source): prose, copies, near copies, shared passages, short, empty, null, odd and long texts."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstuéß") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))
    texts: list[str | None] = [prose(rng.randint(30, 160)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[7].upper(), texts[8] + " extra"]
    for k in (10, 11, 12):
        parts = texts[k].split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        texts.append(" ".join(parts))
    passage = prose(60)
    texts += [f"{prose(20)} {passage} {prose(15)}" for _ in range(4)]
    texts += ["abc " * 90, passage + passage, "", None, "   \n\t ", "one", "one two", "one two", "a b c d", "x" * 450]
    texts += ["Ünïcode 中文 テキスト 🙂 mixed — “quotes” it's we're 12.5% $x_y²\u00a0z", "under the MIT License\nand CC-BY NC, Apache License, version 2.0", "# * $ % & | < >\n# * $\n# * $"]
    texts += [prose(4000), "<|endoftext|> and more", "the same line\nthe same line\nother line of it\nthe same line"]
    langs = ["en", "de", None, "fr"]
    rows = [(k, t, langs[k % 4], f"src{k % 3}") for k, t in enumerate(texts)]
    return [*rows, rows[5], (None, prose(40), "en", None), (900, prose(50), None, None)]
