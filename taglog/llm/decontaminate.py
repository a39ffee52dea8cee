"""Benchmark decontamination: a prefix-filtered set join between documents and benchmark items.

An item is the set of its windows of ``window`` consecutive words (an item of fewer words, but not none, is one
window). Containment of a window needs all its words, so one token is a sufficient prefix: the window's rarest word,
by counts over the whole corpus. Each place where a document has a prefix token proposes the windows that hold it;
a place is dropped by position and length (the window must lie inside the document), and what is left is verified
word by word over the window. A document word inside any occurring window is hit.

The benchmark is the stated query set. It is read in blocks of at most ``BLOCK_BYTES`` of text (a longer item is a block
of its own), each sent to the executors as one broadcast of its distinct windows; every block is one narrow pass over the
documents, which carries the hit words along and is cut before the next block is built. One block at a time is held, so
neither the number of documents nor the size of the benchmark is bounded, and documents are never shuffled.

Defined results: null or word-free texts have no words and no hits; an empty benchmark hits nothing; repeated rows
give repeated rows; a null item_id is never counted; equal item_ids count once; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taglog.llm.common import ALNUM_WORDS, STEP_BYTES, Words, buffers, cut, ids_of, shingles, steps

BLOCK_BYTES = 8 << 20
#: (place, window) candidates that are verified at once.
AT_ONCE = 1 << 20


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of at most ``most`` bytes (a longer item is a block of its own)."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    for r in rows.toLocalIterator():
        n = len(r.t.encode())
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    if block:
        yield block


class WindowIndex:
    """The distinct windows of one block of items, listed under their rarest word, each with the items that hold it."""

    def __init__(self, items: list[tuple[str, str]], window: int, counts: dict[int, int], least: int = 1) -> None:
        off, data = buffers(pa.array([t for _, t in items], pa.string()))
        words = Words(off, data, ALNUM_WORDS)
        names, number = np.unique(np.array([i for i, _ in items], object), return_inverse=True) if items else ([], np.zeros(0, np.int64))
        self.items = list(names)
        self.words = words.hash
        of, begin = shingles(words, window)
        text = np.repeat(np.arange(len(items)), np.diff(begin))
        start = words.first[:-1][text] + np.arange(len(of)) - begin[:-1][text]
        size = np.minimum(window, np.diff(words.first))[text]
        ok = size >= least
        of, text, start, size = of[ok], text[ok], start[ok], size[ok]
        _, first, same = np.unique(of, return_index=True, return_inverse=True)
        pair = np.unique(same * max(1, len(names)) + number[text])  # (window, item), once each
        self.item = pair % max(1, len(names))
        self.item_edge = np.searchsorted(pair // max(1, len(names)), np.arange(len(first) + 1))
        self.start, self.size = start[first], size[first]
        vocabulary, at = np.unique(words.hash, return_inverse=True)
        rarity = np.argsort(np.argsort(np.array([counts.get(h, 0) for h in vocabulary.tolist()], np.int64), kind="stable"))[at]  # ties by hash
        self.place = np.zeros(len(first), np.int64)
        for n in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == n)
            self.place[own] = rarity[self.start[own][:, None] + np.arange(n)].argmin(axis=1)
        key = self.words[self.start + self.place]
        order = np.argsort(key, kind="stable")
        self.listed = order
        self.token, begin = np.unique(key[order], return_index=True)
        self.begin = np.r_[begin, len(order)]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.token & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every verified occurrence."""
        empty = np.zeros(0, np.int64)
        if not len(self.token) or not len(words.hash):
            return empty, empty, empty
        p = np.flatnonzero(self.maybe[(words.hash & np.uint64(0xFFFF)).astype(np.int64)])
        t = np.minimum(np.searchsorted(self.token, words.hash[p]), len(self.token) - 1)
        ok = self.token[t] == words.hash[p]
        p, t = p[ok], t[ok]
        n = self.begin[t + 1] - self.begin[t]
        found = [(empty, empty, empty)]
        a = 0
        while a < len(p):  # places whose words head many windows are taken a bounded number at a time
            z = a + max(1, int(np.searchsorted(np.cumsum(n[a:]), AT_ONCE, "right")))
            found.append(self._verify(words, p[a:z], t[a:z], n[a:z]))
            a = z
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _verify(self, words: Words, p: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = self.listed[np.repeat(self.begin[t], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        p = np.repeat(p, n)
        doc = np.searchsorted(words.first, p, "right") - 1
        first = p - self.place[w]
        ok = (first >= words.first[doc]) & (first + self.size[w] <= words.first[doc + 1])  # positional and length bounds
        doc, first, w = doc[ok], first[ok], w[ok]
        for k in range(int(self.size.max(initial=0))):  # exact containment over the window, narrowing as words differ
            inside = self.size[w] > k
            same = ~inside
            same[inside] = words.hash[first[inside] + k] == self.words[self.start[w[inside]] + k]
            doc, first, w = doc[same], first[same], w[same]
        return doc, first, w

    def items_of(self, doc: np.ndarray, window: np.ndarray) -> dict[int, set[str]]:
        """Items with a window in each document."""
        by: dict[int, set[str]] = {}
        pair = np.unique(doc * max(1, len(self.start)) + window)
        for d, w in zip((pair // max(1, len(self.start))).tolist(), (pair % max(1, len(self.start))).tolist(), strict=True):
            by.setdefault(d, set()).update(self.items[x] for x in self.item[self.item_edge[w] : self.item_edge[w + 1]])
        return by


def word_counts(docs: DataFrame, text_col: str, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word of a block's vocabulary occurs in the whole corpus."""
    if not len(vocabulary):
        return {}
    sc = docs.sparkSession.sparkContext
    vocab = sc.broadcast(np.unique(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        maybe = np.zeros(1 << 16, bool)
        maybe[(v & np.uint64(0xFFFF)).astype(np.int64)] = True
        total = np.zeros(len(v), np.int64)
        for b in batches:
            off, data = buffers(b.column(0))
            for i, j in steps(off):
                h = Words(off[i : j + 1], data[off[i] : off[j]], ALNUM_WORDS).hash
                h = h[maybe[(h & np.uint64(0xFFFF)).astype(np.int64)]]
                k = np.minimum(np.searchsorted(v, h), len(v) - 1)
                total += np.bincount(k[v[k] == h], minlength=len(v))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(total[k], pa.int64())], names=["k", "n"])

    got = docs.select(text_col).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most one row for each word of the block
    out = {int(vocab.value[r.k]): r.n for r in got}
    vocab.unpersist()
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, least: int = 1
) -> DataFrame:
    """(id, n_words, n_hit, items array of sorted distinct item ids) for each document. Windows of fewer than ``least`` words do not count."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, text string, n_words long, hit binary, items array<string>"
    source = docs.select(id_col, F.col(text_col).alias("text"))
    out = source.select(id_col, "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items"))
    sc = docs.sparkSession.sparkContext

    def one_pass(index, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                off, data = buffers(b.column(1))
                n_words, hits, items, n_hit = [], [], [], []
                for i, j in steps(off, STEP_BYTES):
                    words = Words(off[i : j + 1], data[off[i] : off[j]], ALNUM_WORDS)
                    doc, first, w = ix.find(words)
                    edge = np.bincount(first, minlength=len(words.hash) + 1) - np.bincount(first + ix.size[w], minlength=len(words.hash) + 1)
                    hit = np.cumsum(edge)[:-1] > 0
                    by = ix.items_of(doc, w)
                    for d in range(j - i):
                        a, z = words.first[d], words.first[d + 1]
                        own, seen = hit[a:z], b.column(3)[i + d].as_py()
                        if seen is not None:
                            own = own | np.unpackbits(np.frombuffer(seen, np.uint8), count=z - a).astype(bool)
                        n_words.append(int(z - a))
                        n_hit.append(int(own.sum()))
                        hits.append(None if last or not own.any() else np.packbits(own).tobytes())
                        items.append(sorted(by.get(d, set()).union(b.column(4)[i + d].as_py())))
                head = [ids_of(b, id_col)] if last else [ids_of(b, id_col), b.column(1)]
                tail = pa.array(n_hit, pa.int64()) if last else pa.array(hits, pa.binary())
                names = [id_col, "n_words", "n_hit", "items"] if last else [id_col, "text", "n_words", "hit", "items"]
                yield pa.RecordBatch.from_arrays([*head, pa.array(n_words, pa.int64()), tail, pa.array(items, pa.list_(pa.string()))], names=names)

        return run

    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    block = next(blocks, [])
    while True:
        after = next(blocks, None)
        off, data = buffers(pa.array([t for _, t in block], pa.string()))
        index = sc.broadcast(WindowIndex(block, window, word_counts(source, "text", Words(off, data, ALNUM_WORDS).hash), least))
        if after is None:
            return out.mapInArrow(one_pass(index, True), f"{id_col} {kind}, n_words long, n_hit long, items array<string>")
        out = cut(out.mapInArrow(one_pass(index, False), schema))  # the block is done with before the next one is built
        index.unpersist()
        block = after


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest form of ``decontaminate``: counts, a digest of the item ids and the verdict (two items or more)."""
    found = decontaminate(docs, benchmark, **options)
    return found.withColumn("n_items", F.size("items").cast("long")).withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)).withColumn("contaminated", F.col("n_items") >= 2).drop("items")
