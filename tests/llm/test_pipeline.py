"""The pipeline's stages on small tables."""

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taglog.llm import packing, pii, quality
from taglog.llm.common import table
from taglog.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _kept string"


def test_stages_keep_columns_and_take_effect(spark):
    docs = table(spark, DATA, "documents")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, DATA).localCheckpoint()
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes), name
        assert after.select("doc_id").subtract(at.select("doc_id")).count() == 0 and after.count() <= at.count()
        at = after
    assert 0 < at.count() < docs.count() and at.where(F.length("text") != F.col("n_chars")).count() == 0
    assert corpus_pipeline.run(spark, DATA).select("doc_id").distinct().count() == at.count()


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "A b c"), (None, "a b c d e f"), (9, "a b c")]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], SCHEMA)
    for d in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, d, DATA).count() <= d.count(), name
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, DATA)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3]


def test_one_id_with_several_texts(spark):
    """Rows are decided by their own class and their own hits, whatever else their id names."""
    item = table(spark, DATA, "benchmark").select("text").first()[0]
    a, b, c = ("alpha beta gamma delta epsilon", "one two three four five six", "red green blue black white grey")
    rows = [(1, a), (1, b), (2, a), (2, c), (2, c), (3, b), (4, c), (None, a), (None, "north south east west up down"), (None, "left right fore aft in out"), (5, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, DATA).collect()]
    want = [(1, a), (1, b), (2, c), (None, "north south east west up down"), (None, "left right fore aft in out"), (5, None), (5, "")]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    rows = [(1, a), (1, "see: " + item), (None, b), (None, item), (2, c)]
    docs = spark.createDataFrame([(i, t, None, None, None, "x") for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.decontamination_stage(spark, docs, DATA).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, a), (None, b), (2, c)]))


def plain_words(text, pattern):
    return re.findall(pattern, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_quality(spark, docs, rows):
    """Host posteriors by moments over each text's own evidence; sources have no path here."""
    evidence = quality.train(docs, table(spark, DATA, "labels"))
    e = [evidence.good(pa.array([r.text], pa.string()))[0] for r in rows]
    hosts = collections.defaultdict(list)
    for r, x in zip(rows, e, strict=True):
        assert "/" not in r.source
        hosts[r.source].append(x)
    prior = min(max(sum(e) / len(e), 1e-3), 1 - 1e-3)
    groups = [np.array(x) for x in hosts.values() if len(x) > 1]
    n, k, nn = sum(map(len, groups)), len(groups), sum(len(x) ** 2 for x in groups)
    between_sum = sum(x.sum() ** 2 / len(x) for x in groups)
    within = max(0.0, (sum((x * x).sum() for x in groups) - between_sum) / (n - k))
    between = ((between_sum - sum(x.sum() for x in groups) ** 2 / n) / (k - 1) - within) / ((n - nn / n) / (k - 1))
    strength = min(max(within / max(between, 1e-9), 1.0), 1e6)
    odds = lambda p: min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6))
    out = []
    for r, x in zip(rows, e, strict=True):
        host = (strength * prior + sum(hosts[r.source]) - x) / (strength + len(hosts[r.source]) - 1)
        total = odds(x) * odds(host) / (prior / (1 - prior))
        if total / (1 + total) >= 0.5:
            out.append(r)
    return out


def plain_near_duplicates(rows):
    sets = []
    for r in rows:
        w = plain_words(r.text, "[^\x20\x09-\x0d]+")
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and of[i] != of[j]:
                old, new = of[i], of[j]
                of = [new if x == old else x for x in of]
    least = {}
    for r, c in zip(rows, of, strict=True):
        least[c] = min(r.doc_id, least.get(c, r.doc_id))
    return [r for r, c in zip(rows, of, strict=True) if r.doc_id == least[c]]


def plain_clean(rows, items):
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    windows = set()
    for t in items:
        w = plain_words(t, pattern)
        n = min(8, len(w))
        windows |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in windows}
    texts = [plain_words(r.text, pattern) for r in rows]
    return [r for r, w in zip(rows, texts, strict=True) if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))]


def plain_redacted(net, text):
    """Spans of this text alone, cut out one after the other."""
    spans = pii.spans_of(net, [text])[0][1]
    out, at = "", 0
    for k, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if z > at:
            out, at = out + text[at:a] + f"<{pii.KINDS[k]}>", z
    return out + text[at:]


def plain_sequences(lengths):
    """Gaps of best fit, longest first, one piece at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        gap = min(fits) if fits else packing.CAPACITY
        if fits:
            gaps.remove(gap)
        gaps.append(gap - n)
    return sorted(gaps)


def test_every_stage_against_plain_code(spark):
    docs = table(spark, DATA, "documents")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda rows: sorted((r.doc_id, r.text, r.n_chars) for r in rows)

    def next_of(name, at):
        after = stages[name](spark, at, DATA).localCheckpoint()
        return after, after.collect()

    at, rows = docs, docs.collect()
    want = plain_quality(spark, at, rows)
    at, got = next_of("quality_classifier", at)
    assert key(got) == key(want) and 0 < len(got) < len(rows)
    want, rows = plain_near_duplicates(got), got
    at, got = next_of("ngram_jaccard_join", at)
    assert key(got) == key(want) and 0 < len(got) < len(rows)
    want, rows = plain_clean(got, [r.text for r in table(spark, DATA, "benchmark").collect()]), got
    at, got = next_of("benchmark_decontamination", at)
    assert key(got) == key(want) and 0 < len(got) < len(rows)
    net, rows = pii.train(), got
    want = [(r.doc_id, t, len(t)) for r in rows for t in [plain_redacted(net, r.text)]]
    at, got = next_of("pii", at)
    assert key(got) == sorted(want) and key(got) != key(rows)
    exact = packing._encoder(packing.default_tokenizer()).exact
    want = []
    for r in got:
        ids, a, piece = [*exact.encode(r.text, add_special_tokens=False).ids, packing.TERMINATOR], 0, 0
        while a < len(ids):
            n = (len(ids) - a) % packing.CAPACITY or packing.CAPACITY
            want.append((r.doc_id, piece, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())))
            a, piece = a + n, piece + 1
    packed = stages["best_fit_packing"](spark, at, DATA).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    by = collections.defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for part in by.values():
        assert all(o == sum(n for _, n in sorted(part)[:k]) for k, (o, _) in enumerate(sorted(part)))
    assert len(by) <= len(plain_sequences([w[3] for w in want])) + 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    want = con.execute(ORACLES[name])
    cols = [d[0] for d in want.description]
    got = [tuple(r[c] for c in cols) for r in QUERIES[name](spark, DATA).collect()]
    assert sorted(got) == sorted(want.fetchall())
