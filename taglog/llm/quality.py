"""Quality classification by hierarchical empirical Bayes.

Evidence: two classifiers learned from the labels give each document the probability that it is good. One is a logistic
regression on how the text is written (shares of character classes, word lengths, repetition); the other is naive Bayes
over the presence of telling words of unwanted content, whose sum is calibrated by a logistic fit of its own, so that the
odds of a text without any such word are estimated too. Both are fitted on a bounded sample of labelled rows
(``max_rows``, drawn by a seeded hash: a documented bound); all words that tell are kept, and each needs a fiftieth of
the sample's unwanted texts, so their number is at most fifty times such a text's distinct words. The evidence is
computed once for every document.

Sites: the host's posterior is the mean evidence of its documents shrunk toward the global mean, the path's is that of
its documents shrunk toward its host's. The shrinkage strengths are estimated from all sites by moments, so sparse sites
follow the level above them; a document's own evidence is left out of its sites' means. The document's posterior odds are
its evidence's odds times its site's odds over the global odds. A document is kept when the posterior is 0.5 or more.

Sites are aggregated with map-side partial sums, so a host with a third of all rows is one row a task. The site tables
are joined back by broadcast while they have at most ``BROADCAST_SITES`` rows, else by a shuffled join under adaptive
skew handling.

The host is the part of ``source`` before the first slash after any scheme, the path its first segment; without a path
only the host counts. Defined results: null or empty text has the evidence of an empty text; null source is a site of
its own; without labelled rows of both classes a classifier gives its prior; repeated rows are judged alike; an empty
table gives no rows. Columns of the input ride along; names starting with ``_q_`` are reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taglog.llm.common import ALNUM_WORDS, Words, buffers, cut, steps

MAX_ROWS = 20_000
BROADCAST_SITES = 200_000
KEEP = 0.5

_CLASS = np.full(256, 7, np.int64)  # bytes of other scripts
_CLASS[[b for b in range(97, 123)]] = 0
_CLASS[[b for b in range(65, 91)]] = 1
_CLASS[[b for b in range(48, 58)]] = 2
_CLASS[[32, 9, 13]] = 3
_CLASS[10] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 5
_CLASS[[b for b in range(33, 127) if chr(b) in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
_CLASS[ord("!")] = 8
N_FEATURES = 9 + 5


def features(col: pa.Array) -> np.ndarray:
    """How each text is written, a row of N_FEATURES numbers."""
    off, data = buffers(col)
    out = np.zeros((len(off) - 1, N_FEATURES))
    for i, j in steps(off):
        raw = data[off[i] : off[j]]
        n = j - i
        text = np.repeat(np.arange(n), np.diff(off[i : j + 1]))
        count = np.bincount(text * 9 + _CLASS[raw], minlength=9 * n).reshape(n, 9)
        words = Words(off[i : j + 1], raw, ALNUM_WORDS)
        own = np.repeat(np.arange(n), np.diff(words.first))
        n_words = np.diff(words.first)
        order = np.lexsort((words.hash, own))
        h, o = words.hash[order], own[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.zeros(0, bool)
        distinct = np.bincount(o[new], minlength=n)
        size = np.maximum(1, np.diff(off[i : j + 1]))
        part = out[i:j]
        part[:, :9] = count / size[:, None]
        part[:, 9] = np.log1p(size)
        part[:, 10] = np.log1p(n_words)
        part[:, 11] = distinct / np.maximum(1, n_words)
        part[:, 12] = size / np.maximum(1, n_words)
        part[:, 13] = np.log1p(count[:, 4])
    return out


def _word_sets(col: pa.Array):
    """(row, distinct word hashes) of each text."""
    off, data = buffers(col)
    for i, j in steps(off):
        words = Words(off[i : j + 1], data[off[i] : off[j]], ALNUM_WORDS)
        for k in range(j - i):
            yield i + k, np.unique(words.hash[words.first[k] : words.first[k + 1]])


class Evidence:
    """Probability that a text is good, from its form and from its words."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, words: np.ndarray, word_weight: np.ndarray, word_prior: float) -> None:
        self.mean, self.scale, self.weight, self.words, self.word_weight, self.word_prior = mean, scale, weight, words, word_weight, word_prior

    def _expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([z, np.minimum(z * z, 16), np.ones((len(z), 1))], axis=1)

    def lexical(self, col: pa.Array) -> np.ndarray:
        """Sum of the weights of the telling words that each text holds."""
        out = np.zeros(len(col))
        if len(self.words):
            off, data = buffers(col)
            for i, j in steps(off):
                w = Words(off[i : j + 1], data[off[i] : off[j]], ALNUM_WORDS)
                k = np.minimum(np.searchsorted(self.words, w.hash), len(self.words) - 1)
                hit = np.flatnonzero(self.words[k] == w.hash)
                own = np.searchsorted(w.first, hit, "right") - 1
                pair = np.unique(own * len(self.words) + k[hit])
                out[i:j] += np.bincount(pair // len(self.words), weights=self.word_weight[pair % len(self.words)], minlength=j - i)
        return out

    def good(self, col: pa.Array) -> np.ndarray:
        form = self._expand(features(col)) @ self.weight
        lexical = self.word_prior + self.lexical(col)
        return 1 / (1 + np.exp(-np.clip(form, -30, 30))) / (1 + np.exp(np.clip(lexical, -30, 30)))


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for ridge logistic regression; the last column is the constant."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge * len(y))
    keep[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + keep * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _fit_weighted(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Constant and slope of a logistic fit to counted points."""
    design, w, keep = np.stack([np.ones(len(x)), x], axis=1), np.zeros(2), np.full(2, ridge)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = (design * (n * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(keep)
        step = np.linalg.solve(h, design.T @ (n * (p - y)) + keep * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", unwanted_col: str = "toxic") -> Evidence:
    """Fit the evidence on at most about ``max_rows`` labelled documents."""
    rows = labels.select(F.col(id_col).alias("i"), F.col(quality_col).cast("int").alias("q"), F.coalesce(F.col(unwanted_col).cast("int"), F.lit(0)).alias("u")).where("i is not null and q is not null")
    rows = rows.groupBy("i").agg(F.min("q").alias("q"), F.max("u").alias("u"))
    total = rows.count()
    draw = F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_rows / max(1, total)))
    chosen = F.broadcast(rows.where(draw))  # bounded by max_rows
    sample = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(chosen, "i").select("i", "t", "q", "u")

    def dense(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in features(b.column(1))], pa.binary()), b.column(2), b.column(3), b.column(0).cast(pa.string())], names=["f", "q", "u", "i"])

    got = sample.mapInArrow(dense, "f binary, q int, u int, i string").dropDuplicates().limit(4 * max_rows).collect()  # an id may name several texts
    got.sort(key=lambda r: (r.i, bytes(r.f)))
    x = np.stack([np.frombuffer(r.f) for r in got]) if got else np.zeros((0, N_FEATURES))
    y = np.array([r.q > 0 for r in got], float)
    u = np.array([r.u > 0 for r in got], bool)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    out = Evidence(mean, scale, np.r_[np.zeros(2 * N_FEATURES), 4.0], np.zeros(0, np.uint64), np.zeros(0), -4.0)
    if 0 < y.sum() < len(y):
        out.weight = _fit_logistic(out._expand(x), y)
    if 0 < u.sum() < len(u):
        bad, fine = int(u.sum()), int(len(u) - u.sum())

        def vocabulary(batches):
            for b in batches:
                flag = b.column(3).to_numpy()
                parts = [(s, flag[i] > 0) for i, s in _word_sets(b.column(1))]
                w = np.concatenate([s for s, _ in parts])
                k = np.concatenate([np.full(len(s), v) for s, v in parts])
                v, at = np.unique(w, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(np.bincount(at, weights=k, minlength=len(v)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(v)))], names=["w", "b", "n"])

        count = sample.mapInArrow(vocabulary, "w long, b long, n long").groupBy("w").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        # words at least twenty times as frequent among unwanted documents, in two of a hundred of them or more
        telling = count.where((F.col("b") >= max(5, bad // 50)) & (F.col("b") * fine >= 20 * (F.col("n") - F.col("b")) * bad))
        top = telling.collect()
        words = np.array([r.w for r in top], np.int64).view(np.uint64)
        weight = np.array([np.log((r.b + 0.5) / (bad + 1)) - np.log((r.n - r.b + 0.5) / (fine + 1)) for r in top])
        order = np.argsort(words)
        out.words, out.word_weight = words[order], weight[order]
        held = docs.sparkSession.sparkContext.broadcast(out)

        def sums(batches):
            for b in batches:
                s, at = np.unique(np.stack([held.value.lexical(b.column(1)), b.column(3).to_numpy() > 0], axis=1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(at)], names=["s", "u", "n"])

        got = sample.mapInArrow(sums, "s double, u double, n long").groupBy(F.round("s", 3).alias("s"), "u").agg(F.sum("n").alias("n")).orderBy("s", "u").collect()  # rounded sums
        s, u, n = (np.array([r[k] for r in got], float) for k in range(3))
        scale = max(1.0, float(np.abs(s).max(initial=0)))
        a, b = _fit_weighted(s / scale, u, n)
        out.word_prior, out.word_weight = a, out.word_weight * b / scale
    return out


def site_of(source: Column) -> tuple[Column, Column]:
    """(host, path) of a source; path is null where the source has none."""
    rest = F.regexp_replace(F.coalesce(source.cast("string"), F.lit("\x00null")), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    part = F.split(rest, "/")
    path = F.try_element_at(part, F.lit(2))
    return F.element_at(part, 1), F.when(F.length(path) > 0, path)


def _strength(groups: DataFrame) -> float:
    """Pseudo-count of the prior by moments: within-site variance over between-site variance; rows (n, s, ss)."""
    m = groups.where("n > 1").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn")).first()
    if not m.k or m.k < 2 or m.n <= m.k:
        return 10.0
    within = max(0.0, (m.ss - m.b) / (m.n - m.k))
    average = (m.n - m.nn / m.n) / (m.k - 1)
    between = ((m.b - m.s * m.s / m.n) / (m.k - 1) - within) / average
    return float(np.clip(within / max(between, 1e-9), 1.0, 1e6))


def _sites(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES else df


def judge(docs: DataFrame, evidence: Evidence, text_col: str = "text", source_col: str = "source", keep: float = KEEP, with_text: bool = True) -> DataFrame:
    """``docs`` with evidence, host_posterior, path_posterior, posterior and keep; on request without the text, which is then read once and not carried on."""
    shared = docs.sparkSession.sparkContext.broadcast(evidence)

    @F.arrow_udf("double")
    def good(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.good(text), pa.float64())

    docs = docs.drop("evidence", "host_posterior", "path_posterior", "posterior", "keep")
    host, path = site_of(F.col(source_col))
    seen = docs.withColumn("_q_host", host).withColumn("_q_path", F.coalesce(path, F.lit(""))).withColumn("evidence", good(text_col))
    e = F.col("evidence")
    seen = cut(seen if with_text else seen.drop(text_col))
    paths = seen.select("_q_host", "_q_path", "evidence").groupBy("_q_host", "_q_path").agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("s"), F.sum(e * e).alias("ss"))
    paths = cut(paths)
    hosts = paths.groupBy("_q_host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = float(np.clip((all_.s or 0) / max(1, all_.n or 1), 1e-3, 1 - 1e-3))
    k1, k2 = _strength(hosts), _strength(paths.where("_q_path <> ''"))
    out = seen.join(_sites(hosts.select("_q_host", F.col("n").alias("_q_hn"), F.col("s").alias("_q_hs"))), "_q_host")
    out = out.join(_sites(paths.select("_q_host", "_q_path", F.col("n").alias("_q_pn"), F.col("s").alias("_q_ps"))), ["_q_host", "_q_path"])
    out = out.withColumn("host_posterior", (F.lit(k1 * prior) + F.col("_q_hs") - e) / (F.lit(k1) + F.col("_q_hn") - 1))
    shrunk = (F.lit(k2) * F.col("host_posterior") + F.col("_q_ps") - e) / (F.lit(k2) + F.col("_q_pn") - 1)
    out = out.withColumn("path_posterior", F.when(F.col("_q_path") == "", F.col("host_posterior")).otherwise(shrunk))

    def odds(x: Column) -> Column:
        x = F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
        return x / (1 - x)

    total = odds(e) * odds(F.col("path_posterior")) / (prior / (1 - prior))
    out = out.withColumn("posterior", total / (1 + total))
    return out.withColumn("keep", F.col("posterior") >= keep).drop("_q_host", "_q_path", "_q_hn", "_q_hs", "_q_pn", "_q_ps")
