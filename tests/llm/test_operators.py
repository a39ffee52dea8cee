"""Corpus operators against plain code, round trips, held-out accuracy and odd input."""

import bisect
import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from taglog.llm import common, html_text, jaccard, langid, licenses, media, packing, pii, quality, sharding
from taglog.llm.common import table
from taglog.llm.components import connected_components
from taglog.llm.decontaminate import contamination_report

DATA = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, shard string, keep string, seqnum long"
LONG = "word salad " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing column names."""
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (4, "A B"), (None, "one two three four five six"), (5, LONG), (6, LONG + "x"), (7, "\u0000   é\n\n"), (8, "!!! 1")]
    return spark.createDataFrame([(i, t, "en", None, 0, "s", "k", 0) for i, t in rows], ODD)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def words(t, pattern):
    return re.findall(pattern, (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_classes(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = words(t, "[^\x20\x09-\x0d]+")
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for t in s for j in lists[t])
        for j, o in shared.items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                parent[find(i)] = find(j)
        for t in s:
            lists[t].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def classes(df, n, num):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df, n, num, 100).collect()), key=repr)


def test_jaccard_against_brute_force(spark, odd, none, monkeypatch):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(90):  # one crowded group around the threshold, with blocks smaller than the group
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w[: rng.randint(100, 120)]))
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(r.doc_id, r.text) for r in table(spark, DATA, "documents").where("doc_id >= 150").collect()]
    for block in (1500, 20):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        for n, num in ((4, 85), (5, 80)):
            assert classes(spark.createDataFrame(rows, "doc_id long, text string"), n, num) == brute_classes(rows, n, num, 100)
    assert classes(odd, 4, 85) == brute_classes([(r.doc_id, r.text) for r in odd.collect()], 4, 85, 100)
    assert classes(none, 4, 85) == []


def test_equal_names_do_not_link(spark, monkeypatch):
    """Tokens that differ only in the bits below the highest 40 are different n-grams."""
    texts = [f"pair{k} left{k} right{k} side{k}" for k in range(40)]
    real = jaccard.shingles

    def close(words, n):
        tokens, first = real(words, n)
        order = np.argsort(np.argsort(tokens))
        return np.uint64(7 << 60) + (order // 2).astype(np.uint64) * np.uint64(1 << 40) + tokens % np.uint64(1 << 20), first

    token, _ = close(jaccard.Words(np.cumsum([0, *map(len, texts)]), np.frombuffer("".join(texts).encode(), np.uint8), jaccard.SPACE_WORDS), 4)
    assert len(set(token.tolist())) == 40 and len(set((token >> np.uint64(24)).tolist())) == 20
    for t in (np.sort(token), np.sort(np.r_[token, token]), token[:1], np.array([0, 2**64 - 1], np.uint64)):
        assert np.array_equal(jaccard._unpacked(jaccard._packed(t)), t)
    rows = jaccard._chunks(4, 3)
    monkeypatch.setattr(jaccard, "shingles", close)

    class Context:
        @staticmethod
        def get():
            return Context

        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(jaccard, "TaskContext", Context)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    wire = pa.Table.from_batches(rows([batch]))
    back = pa.concat_tables([jaccard._count_range((pa.scalar(r),), wire.filter(pc.equal(wire["r"], r))) for r in range(3)])
    found = jaccard._gather_chunk(85, 100)((pa.scalar(0),), back)
    assert found.column("tokens").null_count == len(found) == 40  # no set shares a token


def test_word_scanner_in_pieces(monkeypatch):
    rng = random.Random(5)
    for _ in range(60):
        texts = ["".join(rng.choice("aB c") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        data = "".join(texts).encode()
        args = np.cumsum([0, *(len(t) for t in texts)]), np.frombuffer(data, np.uint8), common.SPACE_WORDS
        want = common.Words(*args)
        monkeypatch.setattr(common, "PIECE", rng.randint(1, 9))
        monkeypatch.setattr(common, "_POW", [])
        got = common.Words(*args)
        monkeypatch.undo()
        assert all(np.array_equal(getattr(got, k), getattr(want, k)) for k in ("start", "end", "hash", "first"))
        assert [data[a:z].decode() for a, z in zip(got.start, got.end)] == [w for t in texts for w in t.split()]


def test_block_join_against_all_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(np.r_[rng.choice(60, rng.integers(20, 50), replace=False), rng.integers(100, 140, 5)]) for _ in range(200)]
    size = np.array([len(s) for s in sets])
    prefix = np.array([jaccard._prefix(int(n), int(n), 70, 100) for n in size])
    join = jaccard.BlockJoin(sets, size, np.full(200, 2), np.arange(200), 70, 100, prefix)
    for a, b in join.links():
        o = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * o >= 70 * (size[a] + size[b] - o)
    place = {int(o): k for k, o in enumerate(join.order)}
    for a in range(200):
        for b in range(a):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 70 * (size[a] + size[b] - o):
                assert join.root(place[a]) == join.root(place[b])


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_contamination(docs, items):
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t, pattern)
        n = min(8, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows[tuple(w[s : s + n])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t, pattern), set(), set()
        for n in {len(g) for g in windows}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[g]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [8 << 20, 900])
def test_contamination_against_brute_force(spark, odd, none, block_bytes):
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()] + [("short", "Word salad"), ("none", "!"), ("null", None), ("twin", "word SALAD word")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for docs in (table(spark, DATA, "documents"), odd):
        got = contamination_report(docs, bench, block_bytes=block_bytes).select(*cols).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_contamination([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], items)
    assert contamination_report(none, bench).count() == 0
    assert contamination_report(odd, bench.where("false")).where("n_items > 0").count() == 0


def test_media_round_trip(spark, odd, none):
    for n in (0, 1, 575, 576, 577, 60_000):
        raw = bytes(random.Random(n).randrange(256) for _ in range(n))
        payload = raw + b"\xff" * (-n % 576 or 576 * (not n))
        stored = media.encode_payload(payload, n)
        assert b"".join(x["thumb"].tobytes() for x in media.read_images(stored)) == payload
    saved, media.MAX_ROWS = media.MAX_ROWS, 2
    try:
        many = list(media.read_images(media.encode_payload(bytes(range(64)) * 45, 2880)))
    finally:
        media.MAX_ROWS = saved
    assert len(many) == 3
    got = media.media_features(media.encode_media(odd)).collect()
    want = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    for r, (d, raw) in zip(got, want, strict=True):
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.tail_crc32) == (d, len(raw), len(payload), zlib.crc32(payload[-32:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
    assert media.media_features(media.encode_media(none)).count() == 0


def test_jpeg_reader_paths_agree(monkeypatch):
    payload = bytes(random.Random(1).choices([0, 1, 127, 128, 255], k=576 * 10))
    stored = media.encode_payload(payload, len(payload))
    fast = [x["thumb"] for x in media.read_images(stored)]
    monkeypatch.setattr(media, "_fast_scan", lambda *a: None)
    slow = [x["thumb"] for x in media.read_images(stored)]
    assert np.array_equal(fast[0], slow[0])
    for damaged in (stored[:-2], b"\x00" + stored, stored.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(ValueError):
            list(media.read_images(damaged))


def test_jpeg_reader_decodes_interleaved_colour():
    """A 16 x 16 picture with 2x2 luminance sampling, AC terms and other code lengths, written bit by bit."""
    import struct

    bits = ""
    pred = [0, 0, 0]
    dc, ac = {0: "00", 3: "01", 5: "100"}, {0x00: "0", 0x12: "10"}

    def block(c, value):
        nonlocal bits
        d = value - pred[c]
        pred[c] = value
        size = next(k for k in (0, 3, 5) if abs(d) >> k == 0) if d else 0
        size = abs(d).bit_length()
        size = {0: 0, 3: 3, 5: 5}[size]
        bits += dc[size] + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "")
        bits += ac[0x12] + "11" + ac[0x00]

    for v in (5, 0, 20, 24):
        block(0, v)
    block(1, 0), block(2, 4)
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    table_ = lambda kind, codes: bytes([kind]) + bytes(sum(len(c) == n for c in codes.values()) for n in range(1, 17)) + bytes(s for s, c in sorted(codes.items(), key=lambda x: (len(x[1]), x[1])))
    seg = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    jpeg = b"\xff\xd8" + seg(0xDB, bytes([0] + [16] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, 16, 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    jpeg += seg(0xC4, table_(0x00, dc) + table_(0x10, ac)) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (image,) = media.read_images(jpeg)
    assert image["thumb"].tolist() == [[128 + 10, 128], [128 + 40, 128 + 48]]


def test_packing(spark, odd, none):
    for docs in (table(spark, DATA, "documents"), odd, none):
        rows = packing.pack_documents(docs, with_ids=True).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.sequence_id].append(r)
        for part in by.values():
            at = 0
            for r in sorted(part, key=lambda r: r.offset):
                assert r.offset == at and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
                at += r.length
            assert at <= 2048
        total = sum(r.length for r in rows)
        assert len(by) <= -(-total // 2048) * 1.05 + 1
        encode = packing._encoder(packing.default_tokenizer())
        want = sorted(tuple(encode.exact.encode(r.text or "", add_special_tokens=False).ids) + (0,) for r in docs.collect())
        whole = collections.defaultdict(list)
        if docs is not odd:
            for r in rows:
                whole[r.doc_id].append((r.start, r.ids))
            assert sorted(tuple(x for _, ids in sorted(v) for x in ids) for v in whole.values()) == want
        else:
            assert total == sum(map(len, want))
        if docs is not none:
            assert packing.assemble(spark.createDataFrame(rows, packing.pack_documents(docs, with_ids=True).schema)).count() == len(by)


def best_fit(lengths, capacity):
    """Gaps of plain best fit, longest first, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        bisect.insort(gaps, (gaps.pop(i) if i < len(gaps) else capacity) - n)
    return gaps


def test_best_fit_supersteps(spark):
    """Many ranges, crowded lengths and repeated ids: every piece placed once, gapless, in as few sequences as plain best fit."""
    rng = random.Random(3)
    tables = [
        [rng.randint(1, 64) for _ in range(900)] + [64] * 7 + [1] * 300,
        [rng.randint(16, 30) for _ in range(400)],
        [22] * 500,
        [min(64, 1 + int(rng.expovariate(1 / 12))) for _ in range(1500)],
        [3],
    ]
    for lengths in tables:
        rows = [(k % 40, k, 0, n, 0) for k, n in enumerate(lengths)]
        parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
        got = packing.pack(parts, 64).collect()
        assert sorted(tuple(r)[:5] for r in got) == sorted(rows)
        by = collections.defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for part in by.values():
            part.sort()
            assert [o for o, _ in part] == [sum(n for _, n in part[:k]) for k in range(len(part))] and sum(n for _, n in part) <= 64
        assert len(by) <= len(best_fit(lengths, 64)) * 1.01 + 1


def test_tokens_of_long_runs():
    encode = packing._encoder(packing.default_tokenizer())
    for text in (" " * 1_000_000, "a" * 300_000, "x " * 50_000, "\n" * 5000 + "é" * 5000, " \t" * 40_000 + "end", "<|endoftext|> a"):
        assert encode(text).tolist() == [*encode.exact.encode(text, add_special_tokens=False).ids, 0]


def test_sharding(spark, odd, none):
    for docs, most in ((table(spark, DATA, "documents"), 1 << 26), (odd, 1 << 10), (none, 1 << 26)):
        rows = sharding.shard_report(docs, bucket_bytes=most).collect()
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
        for s in range(8):
            own = sorted(r.slot for r in rows if r.shard == s)
            assert own == list(range(len(own)))
        assert all(r.grown_shard in (r.shard, 8) for r in rows)
    full = sharding.shuffle_into_shards(odd)
    assert {"lang", "keep", "slot"} <= set(full.columns) and full.columns.count("shard") == 1
    first, again = (sorted(map(tuple, sharding.shard_report(table(spark, DATA, "documents")).collect())) for _ in range(2))
    assert first == again and first != sorted(map(tuple, sharding.shard_report(table(spark, DATA, "documents"), seed=2).collect()))


def test_shards_as_written(spark, tmp_path):
    """Copies of one row spread over buckets, and the files hold every row in its shard."""
    docs = spark.createDataFrame([(7, "the same row " * 20)] * 400 + [(k, "other") for k in range(100)], "doc_id long, text string").repartition(8)
    back = sharding.shuffle_into_shards(docs, str(tmp_path / "out"), bucket_bytes=4000)
    files = [str(p) for p in (tmp_path / "out").rglob("*.parquet")]
    hot = [n for n in (spark.read.parquet(f).where("doc_id = 7").count() for f in files) if n]
    assert sum(hot) >= 400 and len(hot) >= 3 and max(hot) <= 250
    rows = back.collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in docs.collect())
    for s in range(8):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows))


def test_language(spark, odd, none):
    docs = table(spark, DATA, "documents")
    model = langid.train(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in langid.identify(docs, model).collect())
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 8)] == ["und"] * 3 and got[3].lang_pred in model.langs and 0 <= got[3].score <= 1
    assert langid.identify(none, model).count() == 0 and {r.lang_pred for r in langid.identify(odd, langid.train(none)).collect()} == {"und"}


def test_licenses(spark, odd, none):
    texts = ["x\nReleased under the MIT License.\ny", "licensed UNDER cc by-nc 4.0!\n\nLicensed under the Apache License, Version 2.0.", "licensed to thrill", None, licenses.TEMPLATES["ISC"][0] + " extra words here"]
    crlf = "A line of words.\n\n" + "\n".join(licenses.TEMPLATES["ISC"][0].split(", ")) + "\n\nMore words."
    twice = "Released under the MIT License.\nMIT License, the released under the MIT."
    same = spark.createDataFrame([(1, crlf), (2, crlf.replace("\n", "\r\n")), (3, twice + "\n" + twice[:31] + " ")], "doc_id int, text string")
    a, b, c = (tuple(r)[1:] for r in licenses.scan_licenses(same).orderBy("doc_id").collect())
    assert a == b and a[0] >= 1 and c[0] >= 1
    start = time.time()
    assert licenses.scan_licenses(spark.createDataFrame([(1, "\n".join(f"license number {k} of this work is free" for k in range(30_000)))], "doc_id int, text string")).count() == 1
    assert time.time() - start < 60
    words_, pairs = licenses.telling_words(licenses.template_bigrams(licenses.ALL)), set(licenses.telling_bigrams(licenses.template_bigrams(licenses.ALL)))
    for _, g in licenses.template_bigrams(licenses.ALL):
        need = -(-len(g) * 2 // 3)
        assert sum(any(w in x.split(" ") for w in words_) for x in g) > len(g) - need and sum(x in pairs for x in g) > len(g) - need
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.licenses for r in rows] == ["MIT", "Apache-2.0,CC-BY-NC-4.0", "", "", "ISC"] and rows[0].best_dice == 1.0 and rows[3].n_matches == 0
    assert licenses.scan_licenses(odd).where("n_matches > 0").count() == 0 and licenses.scan_licenses(none).count() == 0
    plan = licenses.scan_licenses(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_html_beside_the_best_container(spark):
    """Everything of the article stays, and low-link parts beside the best container, however short."""
    paragraphs = [f"{k} " + "word, " * 4 + "text " * 56 + "end." for k in range(5)]
    story = "<div class=content>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div>"
    beside = "<ul><li>item one<li>item two</ul><table><tr><td>a cell</td></tr></table><pre>x = 1</pre><blockquote>a quote</blockquote><h4>A heading</h4>"
    want = [*paragraphs, "item one", "item two", "a cell", "x = 1", "a quote", "A heading"]
    furniture = "<nav><a href=/>home</a></nav><div class=sidebar>aside text</div><div><a href=/a>a link</a> <a href=/b>another link</a></div><article class=comment>a comment</article>"
    for page in ("<article>{}{}</article>", "<main>{}{}</main>", "<main><article><section>{}</section>{}</article></main>", "{}{}"):
        assert html_text.main_text("<html><body>" + page.format(story, beside) + furniture + "</body></html>") == "\n\n".join(want), page
    two = "<section><p>First part, of some words, here.</p></section><section><p>Second part.</p></section>"
    assert html_text.main_text(f"<body>{two}{furniture}</body>") == "First part, of some words, here.\n\nSecond part."


def test_html_names_and_odd_pages(spark, none):
    body = "".join(f"<p>Paragraph {k}, with some words, and more of them, to be read.</p>" for k in range(4))
    want = "\n\n".join(f"Paragraph {k}, with some words, and more of them, to be read." for k in range(4))
    post = '<div class="post-12 post type-post status-publish format-standard tag-news category-social-media hentry">'
    for box in (post, '<div class="story tag-comments has-sidebar">', "<div>", '<div id="widget">'):
        assert html_text.main_text(f"<body><nav>x</nav>{box}{body}</div></body>") == want, box
    beside = '<div class="comment-list"><p>A comment, first, of all.</p></div><div class=siteFooter>foot, er</div><div class="post-tags">a, b</div><div id="cookie_banner">We use, cookies.</div>'
    assert html_text.main_text(f"<body>{post}{body}</div>{beside}</body>") == want
    long = "".join(f"<div class=c><p>I think, dear all, that this one, number {k}, is fine.</p></div>" for k in range(12))
    assert html_text.main_text(f"<body><div><h1>Title</h1>{body}</div><section class=comments>{long}</section></body>") == "Title\n\n" + want
    for page in ("<a '" * 30_000, "<a '>' " * 30_000 + "end", "<div>" * 60_000 + "deep", "<p>" * 60_000 + "x", "<div><p>" * 30_000 + "x", "</div>" * 60_000, "<" * 60_000, "<b" * 40_000, "<table><tr><td>" * 20_000 + "y", "word " * 200_000):
        start = time.time()
        html_text.main_text(page)
        assert time.time() - start < 20
    assert html_text.main_text("a <a title='it>s' href=x>link</a> b") == "a link b" and html_text.main_text("x < y & z <b>w</b> 3<4") == "x < y & z w 3<4"
    schema = "page_id long, url string, html string, text string, n_chars string"
    page = spark.createDataFrame([(1, None, f"<p>{LONG}", "t", "n")], schema)
    assert [tuple(r) for r in html_text.extract_text(page).collect()] == [(1, None, LONG.strip(), len(LONG.strip()))]
    assert html_text.extract_text(page.where("false")).count() == 0


def test_html_against_a_second_reading(spark):
    """Pages written from known articles by a plain generator, with furniture around them."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(6, 20))).capitalize() + rng.choice([".", ", too.", "!"])
    for k in range(120):
        parts = [("h1", " ".join(word() for _ in range(4)))]
        for _ in range(rng.randint(3, 9)):
            parts.append(("p", " ".join(sentence() for _ in range(rng.randint(2, 5)))))
            if rng.random() < 0.3:
                parts.append(("h2", word()))
            if rng.random() < 0.2:
                parts += [("li", sentence())] * 2
        box = rng.choice(["article", "main", "div class=content", 'div class="post tag-news hentry"', "div id=story"])
        inner = "".join(f"<{t}>{x.replace('too', 't&#111;o')}</{t}>" if t != "li" else f"<ul><li>{x}</ul>" for t, x in parts)
        links = "".join(f"<li><a href=/{word()}>{word()} {word()}</a>" for _ in range(rng.randint(3, 20)))
        around = [f"<nav><ul>{links}</ul></nav>", f"<div class=sidebar><p>{sentence()}</p><ul>{links}</ul></div>", f"<div class=ad>{sentence()}</div>", f"<form><p>{sentence()}</form>", f"<section class=comments><p>{sentence()}</p><p>{sentence()}</p></section>", f"<footer>{sentence()}</footer>", "<script>var x = '<p>no</p>';</script>"]
        rng.shuffle(around)
        cut = rng.randint(0, len(around))
        page = f"<html><head><title>{word()}</title></head><body>{''.join(around[:cut])}<{box}>{inner}</{box.split()[0]}>{''.join(around[cut:])}</body></html>"
        assert html_text.main_text(page) == "\n\n".join(x for _, x in parts), (k, box)


def slow_best_window(text, name):
    """The best coefficient of any run of words of the text with a template of the licence."""
    w = re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")
    pairs, best = [f"{a} {b}" for a, b in zip(w, w[1:])], 0.0
    for n, t in licenses.template_bigrams(licenses.ALL):
        for i in range(len(pairs)) if n == name else ():
            for j in range(i + 1, min(len(pairs), i + int(1.5 * len(t))) + 1):
                best = max(best, 2 * len(set(pairs[i:j]) & set(t)) / (len(set(pairs[i:j])) + len(t)))
    return round(best, 6)


def test_license_windows(spark):
    """Notices with neighbours in their unit, each below the threshold as a unit."""
    code = "".join(f"int f{i}(int x{i}) {{ return {i} * x{i} + {i * i}; }}\n" for i in range(40))
    comment = lambda t: "/*\n * Copyright (c) 2020 A. Author\n *\n * " + re.sub("((?:\\S+ ){8})", "\\1\n * ", t) + "\n */\n" + code
    texts = {
        comment(licenses.TEMPLATES["MIT"][1]): "MIT",
        comment(licenses.TEMPLATES["GPL-3.0"][1]): "GPL-3.0",
        comment(licenses.ADDED["GPL-2.0"][0]): "GPL-2.0",
        comment(licenses.ADDED["LGPL-2.1"][0]): "LGPL-2.1",
        comment(licenses.ADDED["AGPL-3.0"][0]): "AGPL-3.0",
        comment(licenses.ADDED["BSD-2-Clause"][1]): "BSD-2-Clause",
        comment(licenses.ADDED["BSD-3-Clause"][1]): "BSD-3-Clause",
        comment(licenses.ADDED["CC0-1.0"][1]): "CC0-1.0",
        "Copyright 2020 Acme Corporation. All rights reserved. Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "We wrote this tool in 2019. Released under the MIT License. Please send patches to the list.": "MIT",
        "As said before: " + licenses.TEMPLATES["CC-BY-NC-4.0"][1] + " And so on, with a few more words that follow.": "CC-BY-NC-4.0",
        code + "under the terms of the work, to the public, free of charge, to any person": "",
    }
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r.licenses, r.n_matches) for r in rows] == [(x, int(x != "")) for x in texts.values()]
    for r, (text, name) in zip(rows, texts.items(), strict=True):
        assert not name or r.best_dice == slow_best_window(text, name)
    two = "see here and there released under the mit license or else licensed under cc by 4 0 as you like it best"
    assert licenses.scan_licenses(spark.createDataFrame([(1, two)], "doc_id int, text string")).first()[1:] == (2, 1.0, "CC-BY-4.0,MIT")


def test_quality(spark, odd, none):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    evidence = quality.train(docs, labels)
    rows = quality.judge(docs, evidence).join(labels, "doc_id").collect()
    assert np.mean([r.keep == (r.quality == 1 and r.toxic == 0) for r in rows]) >= 0.9
    paths = docs.withColumn("source", F.concat(F.lit("https://"), "source", F.lit("/p"), F.col("doc_id") % 3, F.lit("/x")))
    judged = quality.judge(paths, evidence)
    assert judged.count() == docs.count() and judged.where("path_posterior is null or posterior is null").count() == 0
    out = quality.judge(odd, evidence)
    assert out.count() == odd.count() and out.columns.count("keep") == 1 and out.where("keep is null").count() == 0
    assert quality.judge(none, evidence).count() == 0
    assert quality.judge(odd, quality.train(docs, labels.where("false"))).count() == odd.count()


def slow_base(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, m.start(), m.end()))
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.findall("[0-9]", m.group())) <= 15]


def test_pii(spark, odd, none):
    rng = random.Random(7)
    noise = ["".join(rng.choice("a1.@-+ ()9") for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    assert all(pii.base_spans(t) == slow_base(t) for t in noise)
    assert all(pii.base_spans(t) == slow_base(t) for t in ("0" * 4000 + ".1.1.1", "1.0002.03.255", "1.2.3.256", "0.0.0.0"))
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(1, 0, 5006)] and pii.base_spans("9" * 5000 + ".1.1.1") == []
    net = pii.train()
    x, y = pii.make_examples(150, 321)
    got = net.viterbi(net.scores(x), np.full(150, pii.WINDOW))
    assert (got == y).mean() >= 0.95 and (got == y)[y > 0].mean() >= 0.85
    text = "é call (521) 555-2373 now or a.b@c.example.com, 10.0.0.1"
    (base, spans), (_, far) = pii.spans_of(net, [text, "x " * 5000 + text])
    assert [text[a:z] for _, a, z in base] == ["a.b@c.example.com", "10.0.0.1"]
    assert {text[a:z] for _, a, z in spans} == {"a.b@c.example.com", "10.0.0.1", "(521) 555-2373"}
    assert [(k, a - 10_000, z - 10_000) for k, a, z in far] == spans
    found = pii.find_pii(odd, net).collect()
    assert len(found) == odd.count() and all(r.spans == "" for r in found) and found[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(none, net).count() == 0
    clean = pii.redact(spark.createDataFrame([(1, text, "k"), (2, None, "k")], "doc_id int, text string, keep string"), net).orderBy("doc_id").collect()
    assert clean[0].text == "é call <phone> now or <email>, <ip>" and clean[1].text is None


def written_forms(rng):
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    card = d(16)
    while not pii.luhn(card):
        card = d(16)
    a, b, c = d(3), d(3), d(4)
    yield 3, f"{a}-{b}-{c}"
    yield 3, f"{a}.{b}.{c}"
    yield 3, f"{a} {b} {c}"
    yield 3, f"({a}) {b}-{c}"
    yield 2, ".".join(card[k : k + 4] for k in range(0, 16, 4))


def test_pii_recall_of_written_forms():
    """Spans found in sentences that training has not seen, for each form that the base patterns leave out."""
    rng, net = random.Random(41), pii.train()
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    texts, want = [], []
    for _ in range(150):
        for form, (kind, s) in enumerate(written_forms(rng)):
            before = "".join(word() + " " for _ in range(rng.randint(0, 12)))
            texts.append(before + s + rng.choice([" ", ". ", ", "]) + " ".join(word() for _ in range(rng.randint(1, 12))))
            want.append((form, (kind, len(before), len(before) + len(s))))
    found = collections.Counter()
    for (form, span), (_, spans) in zip(want, pii.spans_of(net, texts), strict=True):
        found[form] += span in spans
    assert min(found[k] / 150 for k in range(5)) >= 0.9, found


def test_pii_long_stretches(monkeypatch):
    """A stretch decoded in parts gives what it gives whole, and dense long texts take bounded time."""
    rng, net = random.Random(6), pii.train()
    text = " ".join(rng.choice([s for _, s in written_forms(rng)] + ["call 7", "12:30"]) for _ in range(800))
    whole = pii.spans_of(net, [text])
    monkeypatch.setattr(pii, "CORE", 16)
    assert pii.spans_of(net, [text]) == whole and len(whole[0][1]) > 100
    monkeypatch.undo()
    start = time.time()
    assert len(pii.spans_of(net, ["12 345 " * 60_000])) == 1
    assert time.time() - start < 120


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <div id=menu><ul><li><a href=/a>Home</a><li><a href=/b>News, more</a></ul></div><div class="ad">Buy, now, cheap!</div>
    <div class="story"><h1>The &amp; title</h1><p>One   two,<br>three&nbsp;&#8212; <b>four <p>Five <a href=x>six</a>, seven. %s<ul><li>item one<li>item two</ul>
    <form><p>Sign up, please, now</form><div class="comments"><p>First, comment, here</div></div><footer>&copy; x</footer></body></html>"""
    body = "Longer text, with commas, and more. " * 10
    want = ["The & title", "One two, three — four", f"Five six, seven. {body.strip()}", "item one", "item two"]
    assert html_text.main_text(page % body) == "\n\n".join(want)
    assert [html_text.main_text(x) for x in (None, "", "<p>", "plain  text", "<p>cut of")] == ["", "", "", "plain text", "cut of"]
    assert html_text.main_text((page % body).replace('"story"', '"layout with-sidebar no-comments"')) == "\n\n".join(want)
    rows = [(1, "u", None), (2, None, page % body), (2, None, page % body), (None, "u", "<div>" * 3000 + "deep")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.n_chars for r in got] == [0, len("\n\n".join(want)), len("\n\n".join(want)), 4]
