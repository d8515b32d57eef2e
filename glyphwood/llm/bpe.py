"""Byte-level BPE by speculation: longest matches proposed, adjacent pairs verified, failing words merged exactly.

A text is cut into pieces by the tokenizer's pattern. For each piece, the longest vocabulary entry at each place is
proposed. A proposal equals the exact encoding if every adjacent pair of its tokens is compatible, that is, if no merge
across the pair's border would have come before the merges that made the two tokens; the check undoes the two tokens'
merges step by step and runs vectorised over all distinct pairs of a batch. Pieces with a failing pair are merged
exactly. Pieces never cross white space, so encodings are kept per white-space chunk in a bounded table.

Defined results: a null text is an empty one and has no tokens; the special token's string in a text is that token, as
in the library; texts with rare characters are cut into pieces by the library's own pattern; repeated rows are encoded
alike; texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table

#: Chunks whose encodings a worker keeps.
MOST_KEPT = 250_000
#: Bytes of a piece beyond which it is merged by itself.
LONG = 64

CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters whose classes Python's patterns and the library's agree on beyond doubt.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary in the JSON form of the tokenizers library, whose merges rank in the order of ids."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items()}
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in self.ids.items():
            self.bytes[i] = t
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        self.order = np.full(size, -1, np.int64)  # a token's merge rank; bytes have none
        merged: list[tuple[int, int, int]] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (self.ids[raw(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            c = self.ids[self.bytes[a] + self.bytes[b]]
            self.rank[a, b] = (r, c)
            merged.append((a << 32 | b, r, c))
            if self.order[c] < 0:
                self.left[c], self.right[c], self.order[c] = a, b, r
        merged.sort()
        self.keys, self.ranks = np.array([m[0] for m in merged], np.int64), np.array([m[1] for m in merged], np.int64)
        self.made = np.zeros(len(merged), np.int64)
        self.made[[m[1] for m in merged]] = [m[2] for m in merged]
        self.longest = max(map(len, self.ids))
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.byte_table = np.array(self.byte_ids, np.int64)
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        import ahocorasick

        self.search = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.search.add_word(t.decode("latin-1"), i)
        self.search.make_automaton()
        self.border = self.ids[b"\xff"]  # a byte that no UTF-8 text has: stands between pieces
        self.sizes = np.array([len(t) for t in self.bytes], np.int64)
        tokens = list(self.ids)
        flat, counts = self.merge_many(tokens)
        #: Tokens that their own bytes don't merge into; a proposal that has one fails.
        self.stray = np.zeros(size, bool)
        first = np.cumsum(counts) - counts
        self.stray[[self.ids[t] for t, n, k in zip(tokens, counts.tolist(), first.tolist(), strict=True) if n != 1 or flat[k] != self.ids[t]]] = True
        self.cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.letters = letters
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}
        self.counts = {"pieces": 0, "merged": 0}

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a, b next to each other would both survive the merging of their joint bytes."""
        a, b, good = a.copy(), b.copy(), np.ones(len(a), bool)
        limit = np.full(len(a), len(self.keys), np.int64)  # ranks below it would have merged across the border first
        live = np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            keys = x << 32 | y
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            clash = (self.keys[at] == keys) & (self.ranks[at] < most)
            good[live[clash]] = False
            ox, oy = self.order[x], self.order[y]
            undo_left = ox > oy  # the later merge is undone first; equal ranks: the right one came later
            end = (ox < 0) & (oy < 0)
            rank = np.where(undo_left, ox, oy)
            # a merge on the border at the same rank runs left to right, so it beats the right token's own
            limit[live] = np.where(undo_left, rank, rank + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            live = live[~clash & ~end]
        return good

    def merge(self, piece: bytes) -> list[int]:
        """Exact merging: the lowest rank first, from the left. Tokens are linked and pairs wait in a heap, so a piece of n
        bytes takes n log n steps, however long it is."""
        out, rank, n = [self.byte_ids[c] for c in piece], self.rank, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p][0], k) for k, p in enumerate(zip(out, out[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            gone = after[k]
            if out[k] < 0 or gone >= n:
                continue
            found = rank.get((out[k], out[gone]))
            if found is None or found[0] != r:  # the pair that waited isn't there any more
                continue
            out[k], out[gone] = found[1], -1
            follow = after[k] = after[gone]
            if follow < n:
                before[follow] = k
                if (fresh := rank.get((out[k], out[follow]))) is not None:
                    heapq.heappush(heap, (fresh[0], k))
            if (back := before[k]) >= 0 and (fresh := rank.get((out[back], out[k]))) is not None:
                heapq.heappush(heap, (fresh[0], back))
        return [x for x in out if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of each piece: all tokens, and how many each piece has. A merge of every piece at a time; tokens are linked, so nothing is moved."""
        flat = self.byte_table[np.frombuffer(b"".join(pieces), np.uint8)]
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        starts, n = ends - sizes, len(flat)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n
        before[starts] = -1
        alive, none, low = np.ones(n, bool), np.int64(1) << 62, (np.int64(1) << 40) - 1

        def keys_at(i: np.ndarray) -> np.ndarray:
            """rank << 40 | place of the pair that starts at i."""
            out = np.full(len(i), none)
            has = np.flatnonzero(after[i] < n)
            x = i[has]
            pair = flat[x] << 32 | flat[after[x]]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            hit = self.keys[at] == pair
            out[has[hit]] = self.ranks[at[hit]] << 40 | x[hit]
            return out

        key, live = keys_at(np.arange(n)), np.arange(len(pieces))
        segment = key
        cuts = starts
        while len(live):
            least = np.minimum.reduceat(segment, cuts)
            found = np.flatnonzero(least < none)
            if len(found) < 0.7 * len(live):
                live = live[found]
                if not len(live):
                    break
                take = np.repeat(starts[live] - np.concatenate([[0], np.cumsum(sizes[live])[:-1]]), sizes[live]) + np.arange(int(sizes[live].sum()))
                key_part = key[take]
                segment, cuts = key_part, np.cumsum(sizes[live]) - sizes[live]
                offset = starts[live] - cuts
                least = least[found]
                found = np.arange(len(live))
            elif segment is key:
                offset = np.zeros(len(live), np.int64)
            hit = least[found]
            at = hit & low
            gone = after[at]
            flat[at] = self.made[hit >> 40]
            alive[gone] = False
            follow = after[gone]
            after[at] = follow
            inner = follow < n
            before[follow[inner]] = at[inner]
            back = before[at]
            has_back = back >= 0
            touched = np.concatenate([at, gone, back[has_back]])
            shift = offset[found]
            shifts = np.concatenate([shift, shift, shift[has_back]])
            fresh = np.concatenate([keys_at(at), np.full(len(gone), none), keys_at(back[has_back])])
            key[touched] = fresh
            if segment is not key:
                segment[touched - shifts] = fresh
        return flat[alive], np.add.reduceat(alive.astype(np.int64), starts)

    def propose(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left of all pieces: all tokens, and how many each piece has."""
        raw = "\udcff".join(pieces).encode("utf-8", "surrogateescape")
        flat = np.array([i for _, i in self.search.iter_long(raw.decode("latin-1"))], np.int64)
        if int(self.sizes[flat].sum()) != len(raw):
            raise RuntimeError("a proposal leaves bytes out")
        edges = np.flatnonzero(flat == self.border)
        return np.delete(flat, edges), np.diff(np.concatenate([[-1], edges, [len(flat)]])) - 1

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact tokens of all pieces, and how many each piece has."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        flat, sizes = self.propose(pieces)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failing = np.unique(np.concatenate([owner[inner[~good[back]]], owner[self.stray[flat]]]))
        self.counts["pieces"] += len(pieces)
        self.counts["merged"] += len(failing)
        if not len(failing):
            return flat, sizes
        raw = [pieces[k].encode() for k in failing.tolist()]
        long = [k for k, r in enumerate(raw) if len(r) > LONG]
        alone = {k: self.merge(raw[k]) for k in long}
        short, counts = self.merge_many([r if k not in alone else b" " for k, r in enumerate(raw)])
        if alone:
            parts = np.split(short, np.cumsum(counts)[:-1])
            parts = [np.array(alone[k]) if k in alone else x for k, x in enumerate(parts)]
            short, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        bad = np.zeros(len(pieces), bool)
        bad[failing] = True
        final = sizes.copy()
        final[failing] = counts
        out, at = np.empty(int(final.sum()), np.int64), np.repeat(bad, final)
        out[at] = short
        out[~at] = flat[~bad[owner]]
        return out, final

    def learn(self, chunks: list[str]) -> None:
        """Adds the encodings of chunks to those kept."""
        words = [c for c in chunks if not c.isspace()]
        blank = [c for c in chunks if c.isspace()]
        pieces = self.pieces("\n".join(words))  # no word holds a line end, and it never joins a piece of its neighbours
        flat, sizes = self.encode_pieces(pieces)
        data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        start, cuts = 0, [j for j, p in enumerate(pieces) if p == "\n"]
        for k, w in enumerate(words):
            edge = cuts[k] if k < len(cuts) else len(pieces)
            self.kept[w] = data[start : ends[edge - 1]]
            start = ends[edge] if edge < len(pieces) else len(data)
        if blank:
            flat, sizes = self.encode_pieces(blank)
            data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
            for c, end, n in zip(blank, ends, (4 * sizes).tolist(), strict=True):
                self.kept[c] = data[end - n : end]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[list[str]] = []

        def finish() -> None:
            missing = [c for c in {c for cs in group for c in cs} if c not in kept] if group else []
            while missing and len(kept) + len(missing) > MOST_KEPT and kept:
                kept.clear()
                missing = list({c for cs in group for c in cs})
            if missing:
                self.learn(missing)
            get = kept.__getitem__
            out.extend(b"".join(map(get, cs)) for cs in group)
            group.clear()
            if len(kept) > MOST_KEPT:
                kept.clear()

        kept, held = self.kept, 0
        for text in texts:
            if PLAIN.search(text) or any(s in text for s in self.special):
                finish()
                out.append(self.encode_rare(text))
                held = 0
                continue
            group.append(CHUNKS.findall(text))
            held += len(text)
            if held > 500_000:
                finish()
                held = 0
        finish()
        return out

    def encode_rare(self, text: str) -> bytes:
        ids: list[int] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                pieces = [bytes(self.letters[c] for c in p).decode() for p, _ in self.cut(part)]
                ids += self.encode_pieces(pieces)[0].tolist()
        return np.array(ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def load(name: str) -> Bpe:
    """The vocabulary of that path, or of that name among the public tokenizers; kept per worker."""
    if name not in _loaded:
        import os

        import public_tokenizers

        _loaded[name] = Bpe(name if os.sep in name else public_tokenizers.path(name))
    return _loaded[name]


def encode(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", key: str = "doc_id") -> DataFrame:
    """key and ids (array of int) of each text."""

    def make(cols: dict[str, list]) -> dict[str, list]:
        ids = load(vocabulary).encode_batch([t or "" for t in cols["text"]])
        return {key: cols[key], "ids": [np.frombuffer(i, "<u4").astype(np.int32).tolist() for i in ids]}

    return map_arrow(docs.select(key, "text"), make, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(rows: DataFrame, vocabulary: str = "byte_bpe_50k.json", key: str = "doc_id") -> DataFrame:
    """key and text of each row of ids."""

    def make(cols: dict[str, list]) -> dict[str, list]:
        bpe = load(vocabulary)
        return {key: cols[key], "text": [bpe.decode(np.array(i or [], np.int64)) for i in cols["ids"]]}

    return map_arrow(rows.select(key, "ids"), make, f"{key} {rows.schema[key].dataType.simpleString()}, text string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""

    def make(cols: dict[str, list]) -> dict[str, list]:
        bpe = load("byte_bpe_50k.json")
        ids = bpe.encode_batch([t or "" for t in cols["text"]])
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {"doc_id": cols["doc_id"], "n_tokens": [len(i) // 4 for i in ids], "ids_sha256": [sha(i) for i in ids], "decoded_sha256": [sha(bpe.decode(np.frombuffer(i, "<u4")).encode()) for i in ids]}

    return map_arrow(table(spark, sf_dir, "documents").select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
