"""Best-fit packing of documents into fixed-size token sequences, in bulk-synchronous supersteps.

Documents are tokenised once and cut into pieces where they are longer than a sequence. A superstep takes the pieces of
one class of lengths, longest class first, and places them all:

1. Range sort. Pieces and the gaps of open sequences are sorted together by size, largest first, over all executors.
2. Successor sweep. Each task walks its range with a stack of the gaps seen so far, whose top is always the smallest gap
   that still fits: a piece takes it, and the rest of the gap stays on top while the next pieces fit.
3. Conflicts. Pieces that found no gap in their range, and gaps that found no piece, are ranked inside their (range,
   size). The driver sees only how many there are (a number for each range and size, bounded by the capacity, not by
   the rows) and hands rank intervals of pieces to rank intervals of gaps, the longest pieces and the smallest gaps that
   fit first, or to new sequences where none fits. Executors look up their own ranks.
4. Gaps are updated, and the next class follows.

Tests hold the number of sequences against plain best fit with the longest pieces first.

Tokens: byte-level BPE from a ``tokenizers`` file. The file's vocabulary is run by tiktoken's matcher, which gives the
same ids several times faster; a text that holds the string of an added token, or a run of ``LONG_RUN`` characters with
or without white space (the matcher's stack is not made for it), goes through ``tokenizers`` itself.

Defined results: null or empty text is the terminator alone; repeated rows are packed each; an empty table gives no
rows; a null id is kept; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from taglog.llm.common import cut, ids_of

CAPACITY = 2048
TERMINATOR = 0
LONG_RUN = 2000
#: A class of lengths is above the capacity divided by one of these, and at most the class before.
CLASSES = (2, 3, 6, 24)
#: New sequences that one row stands for at most, between supersteps.
FRESH = 50_000
#: Pieces or gaps that a range or a file between supersteps is reckoned to hold; it moves their number, nothing else.
RANGE_ROWS = 50_000

#: Fixed value: how byte-level BPE files of this family split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of a text as ``tokenizers`` gives them with add_special_tokens=False."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.long = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in set(self.added)}
        self.fast = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        probe = "The quick brown fox's 1234 ünïcode…  \n\n\ttabs, don't 'stop'!   "
        if self.fast.encode_ordinary(probe) != self.exact.encode(probe, add_special_tokens=False).ids:
            self.fast = None

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or self.long.search(text) or any(t in text for t in self.added):
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array([*ids, TERMINATOR], "<u4")


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's tokens and terminator, cut only where longer than a sequence.

    The first piece takes the remainder, so all later ones are full.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for b in batches:
            row, num, start, size, crc, ids = [], [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                x = encode(t.as_py() or "")
                at, k = 0, 0
                while at < len(x):
                    n = (len(x) - at) % capacity or capacity
                    part = x[at : at + n]
                    row.append(i)
                    num.append(k)
                    start.append(at)
                    size.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
                    at, k = at + n, k + 1
            cols = [ids_of(b, id_col).take(pa.array(row, pa.int64())), pa.array(num, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _key(part, size, rank):
    """Order of (range, size, rank): sizes are at most 2**20, ranks below 2**32."""
    return np.asarray(part, np.uint64) << np.uint64(52) | np.asarray(size, np.uint64) << np.uint64(32) | np.asarray(rank, np.uint64)


def _sweep(capacity: int, fields: list[pa.Field]):
    """Step 2 over one range, whose rows come largest first and gaps before pieces of their size."""
    names = ["p", "kind", "rank", "gap", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, stack, done, left = TaskContext.get().partitionId(), [], [], {}
        for b in batches:
            sequence, offset, rank = [], [], []
            kind = b.column(b.schema.get_field_index("kind"))
            for size, is_piece, q in zip(b.column(b.schema.get_field_index("size")).to_pylist(), kind.to_pylist(), b.column(b.schema.get_field_index("sequence_id")).to_pylist(), strict=True):
                if not is_piece:
                    stack.append([size, q])
                    continue
                while stack and stack[-1][0] < size:
                    done.append(stack.pop())
                if stack:
                    top = stack[-1]
                    sequence.append(top[1])
                    offset.append(capacity - top[0])
                    rank.append(-1)
                    top[0] -= size
                else:
                    sequence.append(None)
                    offset.append(None)
                    rank.append(left.get(size, 0))
                    left[size] = rank[-1] + 1
            pieces = b.filter(pc.equal(kind, 1))
            m = len(rank)
            own = [pa.array(np.full(m, p, np.int32)), pa.array(np.ones(m, np.int32)), pa.array(rank, pa.int64()), pa.nulls(m, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *(pieces.column(pieces.schema.get_field_index(f.name)) for f in fields)], names=[*names, *(f.name for f in fields)])
        rank, seen = [-1] * len(done), {}
        for size, _ in stack:
            rank.append(seen.get(size, 0))
            seen[size] = rank[-1] + 1
        done += stack
        m = len(done)
        own = [pa.array(np.full(m, p, np.int32)), pa.array(np.zeros(m, np.int32)), pa.array(rank, pa.int64()), pa.array([g for g, _ in done], pa.int64()), pa.array([q for _, q in done], pa.int64()), pa.nulls(m, pa.int64())]
        yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(m, f.type) for f in fields)], names=[*names, *(f.name for f in fields)])

    return run


def resolve(found: list[tuple[int, int, int, int]], capacity: int, sequences: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]], int]:
    """Step 3: ``found`` holds (range, kind, size, how many) of unplaced pieces (kind 1) and unused gaps (kind 0).

    Returns intervals of pieces (range, length, first rank, pieces a gap, how many, offset, gap's range or -1 for a new
    sequence, gap, first rank or new sequence), of gaps (range, gap, first rank, how many, gap now), of new sequences
    (first, how many, gap), and the number of sequences.
    """
    pieces, gaps, fresh = [], [], []
    sizes: list[int] = []  # sorted gaps
    held: dict[int, list[tuple[int, int, int, int]]] = {}  # gap now -> (range or -1, gap before, first, how many)

    def put(now: int, q: int, before: int, first: int, n: int) -> None:
        if not n:
            return
        if not now:
            if q >= 0:
                gaps.append((q, before, first, n, 0))
            return
        if now not in held:
            bisect.insort(sizes, now)
            held[now] = []
        held[now].append((q, before, first, n))

    for p, kind, size, n in found:
        if not kind:
            put(size, p, size, 0, n)
    for p, _, length, n in sorted((x for x in found if x[1]), key=lambda x: (x[0], -x[2])):
        rank = 0
        while rank < n:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):
                more = -(-(n - rank) // (capacity // length))
                put(capacity, -1, capacity, sequences, more)
                sequences += more
                continue
            now = sizes[k]
            q, before, first, have = held[now].pop()
            if not held[now]:
                del held[now]
                sizes.pop(k)
            each = now // length
            use = min(have, -(-(n - rank) // each))
            take = min(n - rank, use * each)
            pieces.append((p, length, rank, each, take, capacity - now, q, before, first))
            put(now, q, before, first + use, have - use)
            put(now - each * length, q, before, first, take // each)
            put(now - take % each * length, q, before, first + use - 1, int(take % each > 0))
            rank += take
    for now, rows in held.items():
        for q, before, first, n in rows:
            if q < 0:
                fresh += [(a, min(FRESH, first + n - a), now) for a in range(first, first + n, FRESH)]
            else:
                gaps.append((q, before, first, n, now))
    sort = lambda rows, k: np.array(sorted(rows), np.int64).reshape(-1, k)
    return sort(pieces, 9), sort(gaps, 5), fresh, sequences


def _settle(shared, names: list[str]):
    """Step 3 on the executors: unplaced pieces find their sequence, or the (range, gap, rank) that names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value[0]
        key = _key(table[:, 0], table[:, 1], table[:, 2])
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            rank, length = col("rank").to_numpy(), col("length").to_numpy()
            loose = rank >= 0
            sequence, offset, want = col("sequence_id").fill_null(-1).to_numpy().copy(), col("offset").fill_null(0).to_numpy().copy(), np.full((len(rank), 3), -1, np.int64)
            if loose.any():
                row = table[np.searchsorted(key, _key(col("p").to_numpy()[loose], length[loose], rank[loose]), "right") - 1]
                place = rank[loose] - row[:, 2]
                nth, slot = place // row[:, 3], place % row[:, 3]
                is_new = row[:, 6] < 0
                sequence[loose] = np.where(is_new, row[:, 8] + nth, -1)
                offset[loose] = row[:, 5] + slot * row[:, 1]
                want[loose] = np.where(is_new[:, None], -1, np.stack([row[:, 6], row[:, 7], row[:, 8] + nth], axis=1))
            cols = [pa.array(sequence), pa.array(offset), *(pa.array(want[:, k]) for k in range(3))]
            yield pa.RecordBatch.from_arrays([*cols, *(col(c) for c in names)], names=["sequence_id", "offset", "at_p", "at_gap", "at_rank", *names])

    return run


def _shrink(shared):
    """Step 4: what step 3 left of the gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value[1]
        key = _key(table[:, 0], table[:, 1], table[:, 2])
        for b in batches:
            p, gap, rank = (b.column(k).to_numpy() for k in range(3))
            gap = gap.copy()
            loose = rank >= 0  # every unused gap is in an interval
            if loose.any():
                gap[loose] = table[np.searchsorted(key, _key(p[loose], gap[loose], rank[loose]), "right") - 1, 4]
            yield pa.RecordBatch.from_arrays([b.column(3), pa.array(gap)], names=["sequence_id", "gap"])

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with sequence_id and offset: best fit, gapless sequences of at most ``capacity`` tokens."""
    parts = cut(parts)  # tokenising happens once; the range sorts sample their input
    spark = parts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted({capacity // k + 1 for k in CLASSES} | {1}, reverse=True)
    which = sum((F.when(F.col("length") < b, 1).otherwise(0) for b in bounds), F.lit(0))
    present = {r.k: r.n for r in parts.groupBy(which.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    names = parts.columns
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in parts.schema.fields]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    gaps = spark.createDataFrame([], "sequence_id long, gap long")
    out, sequences = None, 0
    for k, low in enumerate(bounds):
        if k not in present:
            continue
        some = parts.where((F.col("length") >= low) & (F.col("length") < (bounds[k - 1] if k else capacity + 1)))
        items = some.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("sequence_id"), *names)
        usable = gaps.where(F.col("gap") >= low)
        items = items.unionByName(usable.select(F.col("gap").alias("size"), F.lit(0).alias("kind"), "sequence_id"), allowMissingColumns=True)
        order = [F.col("size").desc(), F.col("kind"), F.col("sequence_id"), F.col(id_col), F.col("piece")]
        ranged = items.repartitionByRange(min(n, (present[k] + sequences) // RANGE_ROWS + 1), *order).sortWithinPartitions(*order)
        swept = cut(ranged.mapInArrow(_sweep(capacity, fields), f"p int, kind int, rank long, gap long, sequence_id long, offset long, {schema}"))
        found = swept.where("rank >= 0").groupBy("p", "kind", F.coalesce("gap", "length").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()
        *tables, fresh, sequences = resolve([tuple(r) for r in found], capacity, sequences)
        shared = spark.sparkContext.broadcast(tables)
        settled = swept.where("kind = 1").mapInArrow(_settle(shared, names), f"sequence_id long, offset long, at_p long, at_gap long, at_rank long, {schema}")
        done = settled.where("sequence_id >= 0").select(*names, "sequence_id", "offset")
        if (tables[0][:, 6] >= 0).any():
            free = swept.where("kind = 0 and rank >= 0").select(F.col("p").cast("long").alias("at_p"), F.col("gap").alias("at_gap"), F.col("rank").alias("at_rank"), F.col("sequence_id").alias("of"))
            late = settled.where("sequence_id < 0").drop("sequence_id").join(free, ["at_p", "at_gap", "at_rank"]).select(*names, F.col("of").alias("sequence_id"), "offset")
            done = done.unionByName(late)
        out = done if out is None else out.unionByName(done)
        if k < max(present):
            used = swept.where("kind = 0").select(F.col("p").cast("long").alias("p"), "gap", "rank", "sequence_id").mapInArrow(_shrink(shared), "sequence_id long, gap long")
            opened = spark.createDataFrame(fresh, "first long, n long, gap long").select(F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("sequence_id"), "gap")
            gaps = cut(gaps.where(F.col("gap") < low).unionByName(used).unionByName(opened).where("gap > 0").coalesce(min(n, sequences // RANGE_ROWS + 1)))
    if out is None:
        out = parts.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    return out


def assemble(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences of ``pack`` over pieces that carry their ids; a group has at most one capacity of tokens."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, capacity, tokenizer, id_col, text_col, with_ids), capacity, id_col)
