"""Every opN query against SQL or plain Python, on a small table with all odd cases."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from glyphwood.llm import bpe, license_scan, lm_score, media, near_dup, packing, quality_lm, quality_rules, queries, suffix_dedup, url_filter

from . import brute

DOCS = brute.documents()
DDL = "doc_id long, text string, lang string, source string"
URLS = [
    "http://www.Example.COM/en/7?x", "https://example.com/en/71", "http://a.com/en/", "http://com/de/", "http://x.net/de/8", "http://example.net/de/89#f", "http://notexample.net/de/8",
    "ftp://q.org/es/1", "no scheme", None, "", "http://", "http://h.com", "http://H.com?en/", "http://a.com/en/7", "x://y://z.com/en/", "http://b.example.com/en/7",
]


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Tables of documents, pages and labels, with further columns of clashing names."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(DOCS, DDL).selectExpr("*", "length(text) AS n_chars", "1 AS n", "'x' AS node", "2 AS kept", "'y' AS _m", "3 AS a", "4 AS b")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, u, "<html>") for k, u in enumerate(URLS)], "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS rule").write.parquet(f"{at}/pages.parquet")
    ids = [r[0] for r in DOCS if r[0] is not None]
    spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in ids] + [(0, 1, 0), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DDL).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def by_key(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, folder, name):
    made = queries.QUERIES[name](spark, empty)
    assert made.collect() == []
    assert made.dtypes == queries.QUERIES[name](spark, folder).dtypes


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT {'doc_id, text, lang, source' if t == 'documents' else '*'} FROM '{folder}/{t}.parquet/*.parquet'")
    if name == "op1_near_dedup":  # the SQL names documents by their ids, so these must be there and be one each
        con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT DISTINCT doc_id, text FROM '{folder}/documents.parquet/*.parquet' WHERE doc_id IS NOT NULL")
    due = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in due.description]
    df = queries.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    clean = lambda rows: Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    got = df.select(*names).distinct().filter("doc_id IS NOT NULL") if name == "op1_near_dedup" else df.select(*names)
    assert clean(got.collect()) == clean(due.fetchall())


def test_near_dup(spark, folder):
    for size, make in ((2, lambda: near_dup.op1_near_dedup(spark, folder)), (5, lambda: near_dup.near_duplicates(spark.read.parquet(f"{folder}/documents.parquet")))):
        due = brute.components([(i, t) for i, t, *_ in DOCS], size)
        got = make().collect()
        assert len(got) == len(DOCS)
        for r in got:
            if r.doc_id is not None:
                assert (r.n_shingles, r.component_id) == due[r.doc_id] and r.kept == (r.doc_id == r.component_id)
            else:
                assert r.component_id is None and r.kept is False


def test_near_dup_large_groups(spark):
    """A group of near copies that is hot in the trees, chained links, and copies of one text."""
    import random

    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):
        own = list(base)
        own[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, "all the very same words again and again here") for k in range(300)]
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):
        rows.append((2000 + k, " ".join(chain)))
        chain = chain[:k] + [f"n{k}"] + chain[k + 1 :]
    rows += [(3000 + k, " ".join(f"r{rng.randrange(5000)}" for _ in range(60))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size in (2, 5):
        due = brute.components(rows, size)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, size).collect()} == due


def paired_pages(pairs, common, own, mine):
    """Pages of one boilerplate that come in pairs; within one they share `own` words more."""
    base = [f"b{k}" for k in range(common)]
    return [(2 * p + c, " ".join(base + [f"p{p}x{k}" for k in range(own)] + [f"q{p}c{c}x{k}" for k in range(mine)])) for p in range(pairs) for c in range(2)]


def test_near_dup_trees_branch_apart_in_executors(spark, monkeypatch):
    """Nodes of 1500 that no pivot looks at: every tree must part them by its own tokens."""
    monkeypatch.setattr(near_dup, "LEAST_HOT", 100_000)
    rows = paired_pages(750, 160, 36, 12)
    due = brute.components(rows[:40], 2)
    assert all(due[2 * p][1] == due[2 * p + 1][1] == 2 * p for p in range(20))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert sum(got[2 * p] == got[2 * p + 1] for p in range(750)) >= 0.99 * 750


def test_near_dup_compares_small_nodes_in_full(spark):
    """250 sets with a common first token under a tree's order are one node of at most SMALL: all its links are candidates."""
    import numpy as np

    rng = np.random.default_rng(3)
    n = 250
    sketch = rng.integers(0, 256, (n, near_dup.TOKENS)).astype(np.uint8)
    sketch[1::2] = sketch[::2]  # pairs
    for k in range(1, n, 2):
        sketch[k, near_dup._CHOSEN[0, 1 : near_dup.LEVELS + 1]] ^= 255  # which the levels of branching would part
    heads = rng.integers(0, 1 << 32, (n, near_dup.TREES)).astype("<u4")
    heads[:, 0] = 7
    rows = [(k, 100, heads[k].tobytes(), sketch[k].tobytes()) for k in range(n)]
    reps = spark.createDataFrame(rows, "a long, n long, heads binary, sketch binary")
    got = {(r.a, r.b) for r in near_dup.Nodes(reps, n, 80).first().filter("uid IS NULL").collect()}
    assert {(k, k + 1) for k in range(0, n, 2)} <= got


def test_near_dup_splits_hot_nodes(spark, monkeypatch):
    """Near copies are 30 % of all sets: no task gathers a node of more than the limit, and all links are found."""
    import random

    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(450):
        own = list(base)
        for j in rng.sample(range(150), 3):
            own[j] = f"x{k}y{j}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(f"r{rng.randrange(9000)}" for _ in range(40))) for k in range(1050)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(near_dup, "SMALL", 32)
    monkeypatch.setattr(near_dup, "LEAST_HOT", 64)
    docs = near_dup.sketches(df, 2)
    reps = docs.select(docs.doc_id.alias("a"), "n", "heads", "sketch").filter("n > 0").cache()
    nodes = near_dup.Nodes(reps, 1500, 80)
    assert nodes.least == 64 and near_dup.LEVELS < len(nodes.hot) < near_dup.DEPTH
    heads, sketch = ((near_dup.matrix(x, k)) for x, k in zip(zip(*[(r.heads, r.sketch) for r in reps.collect()], strict=True), ("<u4", "u1"), strict=True))
    node, _ = near_dup.branch(heads, sketch, nodes.hot, len(nodes.hot))
    assert max(Counter(node.reshape(-1).tolist()).values()) <= 64
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, 2).collect()}
    assert {k: c for k, c in got.items() if k < 1000} == dict.fromkeys(range(450), 0)
    assert all(got[k] == k for k in got if k >= 1000)


@pytest.mark.parametrize("held", [60_000, 100])
def test_near_dup_of_nodes_that_never_split(spark, monkeypatch, held):
    """Sets that differ so little that sketches agree throughout, in one piece and in many."""
    import random

    rng = random.Random(9)
    base = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(f"x{k}" if j == at else w for j, w in enumerate(base))) for k, at in enumerate(rng.sample(range(3000), 300))]
    rows += [(900 + k, " ".join(f"r{rng.randrange(9000)}" for _ in range(30))) for k in range(100)]
    monkeypatch.setattr(near_dup, "SMALL", 16)
    monkeypatch.setattr(near_dup, "LEAST_HOT", 32)
    monkeypatch.setattr(near_dup, "MOST_HELD", held)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {k: 0 if k < 900 else k for k, _ in rows}


def test_near_dup_tries_other_pairs_where_a_forest_fails(spark):
    """Two candidates agree most and aren't similar; the third pair of their node is what links them."""
    import numpy as np

    texts = {0: [f"a{k}" for k in range(100)], 1: [f"a{k}" for k in range(100)] + [f"b{k}" for k in range(22)], 2: [f"a{k}" for k in range(100)] + [f"c{k}" for k in range(22)]}
    rng = np.random.default_rng(5)
    sketch = np.tile(rng.integers(0, 256, near_dup.TOKENS).astype(np.uint8), (3, 1))
    sketch[0, :30] ^= 1  # 0 agrees least with both, though it alone is similar to both
    heads = np.tile(rng.integers(0, 1 << 32, near_dup.TREES).astype("<u4"), (3, 1))
    reps = spark.createDataFrame([(k, len(texts[k]), heads[k].tobytes(), sketch[k].tobytes()) for k in range(3)], "a long, n long, heads binary, sketch binary")
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    nodes = near_dup.Nodes(reps, 3, 80)
    assert {(r.a, r.b) for r in nodes.first().filter("uid IS NULL").collect()} in ({(1, 2), (0, 1)}, {(1, 2), (0, 2)})
    assert {r.v: r.c for r in near_dup.linked(docs, nodes, 2, 80).collect()} == {0: 0, 1: 0, 2: 0}


def test_near_dup_trees_reach_the_recall():
    pairs = 1 - (1 - (near_dup.PERCENT / 100) ** (1 + near_dup.LEVELS)) ** near_dup.TREES
    assert pairs >= near_dup.RECALL >= 0.99 and near_dup.trees_for(0.9, 0.5, 1) == 4


@pytest.mark.parametrize("at_once", [0, 20, 10_000])
def test_components(spark, monkeypatch, at_once):
    import random

    monkeypatch.setattr(near_dup, "MOST_AT_ONCE", at_once)

    rng = random.Random(4)
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(120)]
    up = {v: v for link in links for v in link}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.v: r.c for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: root(v) for a, b in links if a != b for v in (a, b)}


def test_lm_score(spark, folder):
    rows = lm_score.op2_lm_score(spark, folder).collect()
    assert len(rows) == len(DOCS)
    once = list(dict.fromkeys((i, t) for i, t, *_ in DOCS))
    doubled = spark.createDataFrame(once, "doc_id long, text string")
    due = brute.bigram_scores(once, lm_score.MU)
    for r in lm_score.scores(doubled).collect():
        held, n, known, total, base, score = due[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_elias_fano_round_trip():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (50, 60), (3000, 1 << 40), (500, 1 << 20)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        coded = lm_score.EliasFano(values, top)
        coded.mapped(coded.parts)
        assert np.array_equal(coded.get(np.arange(n)), values)
        asked = rng.integers(0, top, 200).astype(np.uint64)
        zero = np.zeros(200, np.int64)
        assert np.array_equal(coded.next_geq(asked, zero, zero + n), np.searchsorted(values, asked))


def test_trie_finds_every_pair_and_no_other():
    import numpy as np

    rng = np.random.default_rng(2)
    bits = lm_score.CONTEXT + lm_score.NEXT
    keys = np.unique(rng.integers(0, 1 << min(bits, 62), 4000).astype(np.uint64) >> np.uint64(3) << np.uint64(3))
    counts = rng.integers(1, 32, len(keys))
    trie = lm_score.Trie(keys, counts)
    assert np.array_equal(lm_score.GRID[trie.look_up(keys)], counts)
    assert not trie.look_up(keys + np.uint64(1)).any()
    assert not lm_score.Trie(keys[:0], counts[:0]).look_up(keys).any()
    large = np.array([33, 89, 1000, 10**6])
    assert [int(x) for x in lm_score.GRID[lm_score.code(large)]] == [brute.quantised(int(c)) for c in large]


def test_pairs_after_a_frequent_word_are_told_apart():
    """A context with 300,000 successors, asked for 300,000 others: none is found."""
    import numpy as np

    rng = np.random.default_rng(4)
    words = np.unique(rng.integers(0, 1 << 63, 600_000).astype(np.uint64))
    ids = np.empty(2 * len(words), np.uint64)
    ids[::2], ids[1::2] = np.uint64(12345), words
    keys = lm_score.pair_keys(ids, np.array([len(ids)]))[1::2]
    seen = np.unique(keys[::2])
    trie = lm_score.Trie(seen, np.full(len(seen), 3))
    assert trie.look_up(keys[::2]).all() and np.count_nonzero(trie.look_up(keys[1::2])) <= 5


def test_counts_have_no_end():
    import numpy as np

    large = np.array([12_568_710, 14_000_000, 10**9, 10**12])
    kept = lm_score.GRID[lm_score.code(large)]
    assert (kept <= large).all() and (kept * 2 ** (1 / 12) > large - 2).all()
    keys = np.array([5, 6], np.uint64)
    assert lm_score.GRID[lm_score.Trie(keys, large[1:3]).look_up(keys)].tolist() == kept[1:3].tolist()


def test_packing(spark, folder):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    import numpy as np

    library = Tokenizer.from_file(path("word_bpe_49k.json"))
    due = Counter()
    for i, t, *_ in DOCS:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            due[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = packing.op3_packing(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == due
    held = by_key(rows, "sequence_id")
    for pieces in held.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(held) == brute.best_fit([r.length for r in rows], 2048)


def test_packing_equals_best_fit_decreasing():
    import random

    rng = random.Random(8)
    for capacity in (10, 64):
        lengths = [rng.choice([1, 2, 3, capacity // 2, capacity, capacity - 1, rng.randint(1, capacity)]) for _ in range(500)]
        assert packing.plan(Counter(lengths), capacity)[1] == brute.best_fit(lengths, capacity)


def test_word_tokenizer_equals_the_library():
    own = packing.load("word_bpe_49k.json")
    texts = [t or "" for _, t, *_ in DOCS] + ["it's don't WE'RE !'s 'tis a_b x2y 12.5%%% a'! b's! c!' d!\'s f... g.. 4%\n5$\tk$", "ÀÉ ß ŉ ǅ ª º µ ÷", "'", "''s", "a\u0301e", "x\x0by\x1cz", "²x ¼"]
    assert own.encode_batch(texts) == own.whole(texts)


def test_word_tokenizer_when_full(monkeypatch):
    """All plain characters at all places of words; words met again and again are asked for once, though many others come."""
    from public_tokenizers import path

    own = packing.ChunkTokenizer(path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "MOST_KEPT", 20)
    texts = [f"{c} a{c} {c}b A{c}B {c}{c}" for c in map(chr, range(0x21, 0x250)) if packing.is_plain(c)]
    assert len(texts) > 500 and [own.encode_batch([t])[0] for t in texts] == own.whole(texts)
    asked, learn = Counter(), own._learn_words
    monkeypatch.setattr(own, "_learn_words", lambda new: (asked.update(new), learn(new)))
    for k in range(100):
        own.encode_batch([f"  common word\t{chr(97 + k % 26) * (2 + k // 26)}zq"])
    assert asked["common"] == asked["word"] == 1 and len(asked) == 102


def test_media(spark, folder):
    rows = by_key(media.op4_media_columns(spark, folder).collect(), "doc_id")
    for i, t, *_ in DOCS:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = next(x for x in rows[i] if x.n_bytes == len(raw))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        stored = media.text_image(raw)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert media.decode_netpbm(stored).tobytes() == payload
    assert len({x.feature for x in rows[3] + rows[40] + rows[41]}) == 1


def test_images():
    import numpy as np

    rng = np.random.default_rng(3)
    for shape in ((1, 1, 3), (5, 7, 3), (40, 3, 3)):
        pixels = rng.integers(0, 256, shape, np.uint8)
        assert np.array_equal(media.decode(media.encode_ppm(pixels)), pixels)
        assert np.array_equal(media.decode(media.encode_bmp(pixels)), pixels)
        same = media.area_resize(pixels, *shape[:2])
        assert np.allclose(same, pixels, atol=0.51)
        small = media.area_resize(pixels, 1, 1)
        assert np.allclose(small.reshape(-1), pixels.reshape(-1, 3).mean(axis=0), atol=0.51)
    assert np.array_equal(media.decode(b"P2 # c\n2 1\n255\n7 9\n").reshape(-1)[:2], [7, 9])
    assert media.decode(None) is None and media.decode(b"") is None and media.decode(b"P6 9 9 255\n") is None and media.decode(b"junk") is None


def test_broken_images_are_none():
    bmp = media.encode_bmp(__import__("numpy").zeros((2, 2, 3), "u1"))
    broken = [b"P5 99999999999 99999999999 255\n", b"P5 99999999 99999999 255\nab", b"P2 1 1 255 300", b"P2 1 1 255 -3", b"P2 1 1 255 x", b"P5 1 1 0\n\0", b"P5 1 1 9\n\xff", b"P2 1 1 9 10", b"P1 3 1 10", b"P4 99 99\n\0",
              b"P6", b"P7 1 1 255\n\0", b"P5 0 1 255\n", b"P5 # no end", b"BM", bmp[:40], bmp[:-9], bmp[:18] + b"\xff\xff\xff\x7f" + bmp[22:], bmp[:18] + b"\xff\xff\xff\xff" + bmp[22:], bmp[:10] + b"\xff\xff\xff\xff" + bmp[14:]]
    for data in broken:
        assert media.decode(data) is None, data
    flat = lambda data: media.decode(data).reshape(-1).tolist()
    assert flat(b"P5 2 1 1\n\0\1") == flat(b"P2 2 1 1 0 1") == flat(b"P1 2 1 10") == flat(b"P4 2 1\n\x80") == [0, 255]
    assert flat(b"P2 2 1 15 0 15") == [0, 255] and flat(b"P3 1 1 255 1 2 3") == [1, 2, 3]


def test_pattern_rules(spark):
    urls = ["http://spam-farm.com/", "http://a.spam-farm.org/x", "http://spam.farm.org/", "http://notspam-farm.net/", "http://h.de/casino?x", "http://h.de/casinos", "http://casino-x.ru/", "http://h.de/?session=" + "0af1" * 8,
            "http://h.de/?session=1", "HTTP://ADS.h.de/pixel?1", "http://xxx-y.z/", None, ""]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(rows, hosts=[]).collect()}
    import re

    for k, u in enumerate(urls):
        first = next((r.verdict for r in url_filter.PATTERN_RULES if u and re.search(r.pattern, u.lower())), "allow")
        assert got[k] == first, u
    with pytest.raises(ValueError):
        url_filter.filter_urls(rows, hosts=[url_filter.HOST_RULES[0]] * (url_filter.MOST_RULES + 1))


def test_host_rules(spark):
    """The contract's verdicts, word by word, also against what a pattern rule says."""
    due = {"http://a.com/en/": "block", "http://example.com/en/7": "allow", "http://x.net/de/7": "allow", "http://casino-x.net/de/7": "allow", "http://example.net/de/8": "block", "http://a.org/es/": "block", "http://a.org/de/": "allow"}
    rows = spark.createDataFrame([(u,) for u in due], "url string").selectExpr("url AS page_id", "url")
    assert {r.page_id: r.verdict for r in url_filter.filter_urls(rows).collect()} == due


def test_quality_lm(spark, folder):
    rows = by_key(quality_lm.op7_quality_lm(spark, folder).collect(), "doc_id")
    labels = [(i, int(i % 3 != 0)) for i, *_ in DOCS if i is not None]
    good = {i for i, q in labels if q} - {i for i, q in labels if not q} | set()
    good -= {0}  # two labels that differ
    train = [t.encode() for i, t, *_ in DOCS if i in good and t]
    p = brute.kneser_ney(train, quality_lm.ORDER)
    for i, t, *_ in DOCS[:48] + DOCS[-3:]:
        for r in rows[i]:
            if t:
                assert math.isclose(r.perplexity, brute.perplexity(p, t.encode(), quality_lm.ORDER), rel_tol=1e-6)
            else:
                assert r.perplexity is None and r.kept is False


@pytest.mark.parametrize(("held", "bits"), [(1_000_000, 1 << 28), (300, 1)])
def test_quality_fit_takes_all_trusted_text(spark, tmp_path, monkeypatch, held, bits):
    """More trusted documents than a sample would hold; counts sent many times, and a bitmap so small that others pass it."""
    import random

    monkeypatch.setattr(quality_lm, "HELD", held)
    monkeypatch.setattr(quality_lm, "MOST_BITS", bits)
    monkeypatch.setattr(quality_lm, "SLICE", 2_000)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcde é") for _ in range(rng.randint(1, 9))) for _ in range(9000)]
    docs = spark.createDataFrame([(k * k, t, "en") for k, t in enumerate(texts)] + [(0, texts[0], "de"), (None, "zzz", "en"), (4, None, "en"), (9, "", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k * k, int(k % 2 == 0)) for k in range(9000)] + [(None, 1)], "doc_id long, quality int")
    p = brute.kneser_ney([t.encode() for t in [*texts[::2], texts[0]]], quality_lm.ORDER)
    docs.repartition(3).write.parquet(f"{tmp_path}/docs")
    rows = by_key(quality_lm.classify(spark.read.parquet(f"{tmp_path}/docs"), labels).collect(), "doc_id")
    for k in range(0, 9000, 7):
        assert any(r.perplexity and math.isclose(r.perplexity, brute.perplexity(p, texts[k].encode(), quality_lm.ORDER), rel_tol=1e-6) for r in rows[k * k])


def quantile(values: list[float], q: float) -> float:
    return sorted(values)[max(math.ceil(q * len(values)) - 1, 0)]


@pytest.mark.parametrize("block", [6_000_000, 3_000])
def test_quality_verdicts(spark, folder, monkeypatch, block):
    """Thresholds by language and verdicts, from the perplexities, by hand; in blocks of all rows and of a few."""
    monkeypatch.setattr(quality_lm, "FEWEST", 9)
    monkeypatch.setattr(quality_lm, "SPREADS", 0.6)
    monkeypatch.setattr(quality_lm, "BLOCK", block)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality_lm.classify(docs, labels).collect()
    marks = {}
    for r in labels.collect():
        marks.setdefault(r.doc_id, set()).add(r.quality)
    good = {i for i, q in marks.items() if i is not None and q - {None} == {1}}
    trusted = [r for r in rows if r.doc_id in good and r.perplexity is not None]
    limit = lambda xs: quantile(xs, 0.5) + 0.6 * (quantile(xs, quality_lm.UPPER) - quantile(xs, 0.5))
    by = {g: xs for g in ("en", "de", "fr") if len(xs := [r.perplexity for r in trusted if r.lang == g]) >= 9}
    every = limit([r.perplexity for r in trusted])
    assert by and len(rows) == docs.count()
    for r in rows:
        most = limit(by[r.lang]) if r.lang in by else every
        assert math.isclose(r.most, most, rel_tol=1e-9) and r.kept == (r.perplexity is not None and r.perplexity <= most)
    assert {r.kept for r in rows if r.perplexity} == {True, False}
    kept = quality_lm.quality_filter(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_quality_of_shards_in_parts(spark, folder, monkeypatch):
    """Questions in many parts, of which each has a copy of its shard, and extra columns with clashing names."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    due = Counter((r.doc_id, r.perplexity) for r in quality_lm.classify(docs, labels).collect())
    monkeypatch.setattr(quality_lm, "PER_GROUP", 20_000)
    monkeypatch.setattr(quality_lm, "SLICE", 500)
    more = docs.selectExpr("*", "1 AS perplexity", "'x' AS block", "lang AS most", "array(doc_id) AS _row")
    assert Counter((r.doc_id, r.perplexity) for r in quality_lm.classify(more, labels).collect()) == due
    assert quality_lm.quality_filter(more, labels).columns == more.columns


def test_quality_filter_of_many_languages(spark, folder, monkeypatch):
    """Beyond MOST_LANGUAGES the filter joins its limits by a shuffle, and keeps the same rows."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    monkeypatch.setattr(quality_lm, "FEWEST", 2)
    due = quality_lm.quality_filter(docs, labels)
    rows = Counter(due.collect())
    monkeypatch.setattr(quality_lm, "MOST_LANGUAGES", 1)
    got = quality_lm.quality_filter(docs, labels)
    assert got.columns == due.columns and rows and Counter(got.collect()) == rows


def test_kneser_ney_sums_to_one():
    p = brute.kneser_ney([b"abracadabra", b"banana bandana"], 3)
    for context in (b"", b"a", b"an", b"zz"):
        assert math.isclose(sum(p(context + bytes([b])) for b in range(256)), 1.0, rel_tol=1e-9)


def test_suffix_dedup(spark, folder):
    rows = by_key(suffix_dedup.op8_suffix_dedup(spark, folder).collect(), "doc_id")
    texts = [(t or "").encode() for _, t, *_ in DOCS]
    for (i, *_), raw, cover in zip(DOCS, texts, brute.repeated(texts), strict=True):
        kept = bytes(b for b, c in zip(raw, cover, strict=True) if not c)
        spans = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        due = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
        assert due in {(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows[i]}
    assert sum(map(len, rows.values())) == len(DOCS)


def test_covered_bytes():
    """By hand, and in a few bytes of memory for each byte of text."""
    import random
    import tracemalloc

    import numpy as np

    rng = random.Random(3)
    for _ in range(200):
        n, length = rng.randint(9, 60), rng.choice([1, 3, 8])
        cuts = sorted(rng.sample(range(n - length + 1), rng.randint(0, (n - length + 1) // 2) * 2))
        pairs = list(zip(cuts[::2], cuts[1::2], strict=True)) if rng.random() < 0.5 else [(c, c) for c in cuts]
        due = [int(any(a <= k < b + length for a, b in pairs)) for k in range(n)]
        assert suffix_dedup.covering(n, np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64), length).tolist() == due
    tracemalloc.start()
    assert suffix_dedup.covering(1_000_000, np.array([5, 90]), np.array([7, 90]), 200).sum() == 285
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()


def test_suffix_dedup_of_dense_repeats(spark):
    """Few letters, so that anchors differ and windows are refined; and passages that start at any offset."""
    import random

    rng = random.Random(6)
    alphabet = "ab"
    passages = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (30, 45, 61)]
    texts = ["".join(rng.choice(passages + ["a", "b", "ba"]) for _ in range(rng.randint(1, 30))) for _ in range(150)] + ["a" * 61, "a" * 40, "é" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    raw = [t.encode() for t in texts]
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.repeated_spans(df, 40).collect()}
    for k, cover in enumerate(brute.repeated(raw, 40)):
        assert got[k] == bytes(b for b, c in zip(raw[k], cover, strict=True) if not c)


def test_bpe(spark, folder):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    import numpy as np

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = by_key(bpe.op9_bpe(spark, folder).collect(), "doc_id")
    for i, t, *_ in DOCS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        due = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert due in {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows[i]}


def test_bpe_of_very_long_pieces():
    """A run of a million letters takes seconds, and merges as short ones do."""
    import time

    own = bpe.load("byte_bpe_50k.json")
    for piece in (b"a" * 700, b"abcab" * 90, "ßaé".encode() * 70, bytes(range(97, 123)) * 9):
        flat, sizes = own.merge_many([piece])
        assert own.merge(piece) == flat.tolist() and sizes.tolist() == [len(flat)]
    began = time.perf_counter()
    ids = own.encode_batch(["qz" * 500_000])[0]
    assert time.perf_counter() - began < 60 and len(ids) > 0


def test_native_plans(spark, folder):
    for make in (quality_rules.op6_quality_rules, license_scan.op10_license_scan):
        plan = make(spark, folder)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Exchange"))
