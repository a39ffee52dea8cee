"""Language identification by a string kernel.

Kernel: presence of n-grams of 2, 3 and 4 bytes (blended spectrum) of the lower-cased text with runs of non-letters as
spaces, ``k(x, y) = |S_x & S_y| / sqrt(|S_x| |S_y|)``; grams are hashed to 16 bits for each length. Nystroem landmarks
are drawn from the training sample, and one-versus-rest kernel ridge regression is solved on their features. Scoring is
a batched matrix product: the presence matrix of a batch times the landmarks' grams folded with the dual weights (the
kernel is linear in presence, so this is the product with the landmark matrix regrouped), divided by the text's norm.

Training reads only text and non-null lang of documents outside the held-out fold (crc32 of the id's digits modulo 4
is 2). Every language is learned; it is fitted on about ``per_lang`` of its texts, or fewer where there are many
languages (``MAX_ROWS`` over all languages, but at least ``LEAST`` each), drawn by a seeded hash: documented bounds.
Texts become sorted gram numbers on the executors before anything is drawn together, equal texts of a language once, so
the driver holds a few thousand rows of some kilobytes, whatever the texts' length.

Defined results: null text or text without a letter is ``und`` with score 0; ties go to the first language in order;
with no training rows every document is ``und``; repeated rows give repeated rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taglog.llm.common import ids_of

PER_LANG = 240
LANDMARKS_PER_LANG = 40
MAX_ROWS, LEAST, MAX_LANDMARKS = 6000, 6, 1200
RIDGE = 1e-3
DIMS = 3 << 16
BATCH = 64

_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[b for b in range(128) if not chr(b).isalpha()]] = 32
_LETTER = re.compile(r"[^\W\d_]")


def presence(text: str, out: np.ndarray) -> None:
    """Set out[g] for every gram g of the text (``out`` has DIMS zeros)."""
    b = _SPACE[np.frombuffer(text.lower().encode(), np.uint8)]
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]] if len(b) else b
    x = np.full(len(b) + 2, 32, np.uint32)
    x[1:-1] = b
    two = (x[:-1] << np.uint32(8)) | x[1:]
    out[two] = 1
    three = (two[:-1] << np.uint32(8)) | x[2:]
    out[((three * np.uint32(0x9E3779B1)) >> np.uint32(16)) + np.uint32(1 << 16)] = 1
    four = (three[:-1] << np.uint32(8)) | x[3:]
    out[((four * np.uint32(0x85EBCA6B)) >> np.uint32(16)) + np.uint32(2 << 16)] = 1


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


class Model:
    """Languages, landmark grams in use and their folded weights."""

    def __init__(self, langs: list[str], dims: np.ndarray, weight: np.ndarray) -> None:
        self.langs, self.dims, self.weight = langs, dims, weight

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        flags = np.zeros(DIMS, np.uint8)
        for a in range(0, len(texts), BATCH):
            part = texts[a : a + BATCH]
            m, norm = np.zeros((len(part), len(self.dims)), np.float32), np.ones(len(part))
            real = [bool(t) and _LETTER.search(t) is not None for t in part]
            for i, t in enumerate(part):
                if real[i]:
                    flags[:] = 0
                    presence(t, flags)
                    m[i] = flags[self.dims]
                    norm[i] = np.sqrt(flags.sum(dtype=np.int64))
            f = (m @ self.weight) / norm[:, None]
            best = f.argmax(axis=1) if self.langs else np.zeros(len(part), int)
            for i in range(len(part)):
                ok = real[i] and bool(self.langs)
                names.append(self.langs[best[i]] if ok else "und")
                scores.append(float(np.clip((f[i, best[i]] + 1) / 2, 0, 1)) if ok else 0.0)
        return names, scores


def train(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS_PER_LANG, ridge: float = RIDGE, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & ~F.coalesce(held_out("i"), F.lit(True)))
    counts = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}  # a row a language
    if not counts:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    each = max(min(LEAST, per_lang), min(per_lang, MAX_ROWS // len(counts)))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "l string, share double")
    draw = F.pmod(F.xxhash64("i", "t", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = []
            for t in b.column(1):
                flags = np.zeros(DIMS, np.uint8)
                presence(t.as_py(), flags)
                grams.append(np.flatnonzero(flags).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grams, pa.binary())], names=["l", "g"])

    chosen = rows.join(F.broadcast(shares), "l").where(draw < F.col("share")).select("l", "t")
    sample = chosen.mapInArrow(run, "l string, g binary").groupBy("l", F.xxhash64("g").alias("h")).agg(F.min("g").alias("g")).collect()
    sample.sort(key=lambda r: (r.l, bytes(r.g)))
    if not sample:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    langs = sorted({r.l for r in sample})
    y = np.array([langs.index(r.l) for r in sample])
    held = [np.frombuffer(r.g, "<u4").astype(np.int64) for r in sample]
    size = np.sqrt(np.maximum(1, np.array([len(g) for g in held], np.float64)))
    rng = np.random.default_rng(seed)
    few = max(1, min(landmarks, MAX_LANDMARKS // len(langs)))
    mark = np.concatenate([rng.permutation(np.flatnonzero(y == c))[:few] for c in range(len(langs))])
    dims = np.unique(np.concatenate([held[i] for i in mark]))
    place = np.full(DIMS, -1, np.int64)
    place[dims] = np.arange(len(dims))
    own = np.zeros((len(mark), len(dims)), np.float32)  # at most MAX_LANDMARKS rows, or one a language
    for r, i in enumerate(mark.tolist()):
        own[r, place[held[i]]] = 1
    k = np.empty((len(held), len(mark)))
    for i, g in enumerate(held):
        at = place[g]
        k[i] = own[:, at[at >= 0]].sum(axis=1)
    k = k / size[:, None] / size[mark][None, :]
    value, vector = np.linalg.eigh(k[mark])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    z = k @ root
    target = np.where(y[:, None] == np.arange(len(langs))[None, :], 1.0, -1.0)
    weigh = (len(y) / len(langs) / np.bincount(y, minlength=len(langs)))[y][:, None]
    dual = root @ np.linalg.solve(z.T @ (weigh * z) + ridge * len(y) * np.eye(z.shape[1]), z.T @ (weigh * target))
    weight = own.T @ (dual / size[mark][:, None]).astype(np.float32)
    return Model(langs, dims, weight.astype(np.float32))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([ids_of(b, id_col), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")
    return out.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "lang_pred", "score")
