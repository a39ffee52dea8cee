"""Exact n-gram Jaccard join with set-relation skipping, returned as classes of linked documents.

A document's set holds the 64-bit hashes of its distinct word n-grams. Documents with equal sets are one node. Two nodes
link when ``den * |x & y| >= num * |x | y|``; a document's component is what links reach.

1. Shared tokens. Each chunk of documents pre-aggregates its tokens (one entry a token and chunk) and sends them, packed
   without loss, to token ranges, which return to the chunk those tokens that more than one set holds, with their
   frequency. A set whose shared tokens are too few for any partner drops out; it has no links. All counts cover all
   documents, whose texts are read once.
2. Index lists. Tokens are ordered by rarity; the necessary prefix of each remaining set enters the index lists. Each
   list names its most central set (highest mean token frequency) as leader, and the lists of one leader form a group, so
   every pair that shares a prefix token meets in some group.
3. Star links. Every set is compared with its most central leader only, which contracts groups of copies linearly.
4. Group joins. What is left is joined inside groups, in bounded blocks: sets not linked to the leader against all sets
   of the group. In a block pair, lists are walked in blocks of entries that are skipped by size and by position, pairs
   already connected are skipped, and a set's overlaps with all others are derived from those of the most similar
   set computed before by adding and subtracting the index lists of the differing tokens only. Only a spanning forest
   of the links leaves a task.
5. Components by star contraction.

Lists and groups that hold many of the rows (a frequent n-gram, a large family of copies) are joined by broadcast of the
few names that can be that frequent, so that no task takes a whole group.

No pair is dropped, capped or sampled: blocks bound what a task holds, not what is compared. Two different n-grams are
told apart by 64 bits: among N distinct n-grams N * N / 2**65 pairs are expected to be equal by chance (about two pairs in
all of 30 GB of text), and such a pair can move a link only where an overlap is one n-gram below the threshold.

Defined results: null text or text without words has the empty set, links with nothing and is its own component; fewer
than n words make one token of the whole sequence; equal sets are always linked; repeated rows are linked to each other;
a row with a null id takes part, but is never a component's name; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taglog.llm.common import SPACE_WORDS, Words, buffers, cut, join_counted, mix64, shingles, steps
from taglog.llm.components import connected_components

#: Tokens and documents of a chunk at most (one longer document is a chunk of its own); sets and tokens of a block, about.
CHUNK_TOKENS, CHUNK_DOCS, BLOCK, BLOCK_TOKENS = 1_000_000, 60_000, 1500, 400_000
#: Index entries that are skipped together, and computed answers that a task keeps to derive others from.
SKIP, KEPT = 64, 16
DOCS_A_GROUP = 512
#: Bytes of text that a token is reckoned to take where ranges are counted out; it moves their size, nothing else.
BYTES_A_TOKEN = 4
_SHARED = 0xFFFF
_ZSTD = pa.Codec("zstd", compression_level=1)


def _planes(v: np.ndarray, width: int) -> list[np.ndarray]:
    """The lowest ``width`` bytes of little-endian numbers, byte by byte."""
    raw = v.view(np.uint8).reshape(len(v), v.itemsize)
    return [np.ascontiguousarray(raw[:, k]) for k in range(width)]


def _packed(token: np.ndarray) -> bytes:
    """Ascending 64-bit tokens without loss: the first one, then differences of as few bytes as the widest needs.

    The highest byte of the differences is the one with little in it, and is compressed.
    """
    if not len(token):
        return b""
    step = np.diff(token).astype("<u8")
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    planes = _planes(step, width)
    top = _ZSTD.compress(planes[-1].tobytes(), asbytes=True)
    head = np.array([len(token), int(token[0]), width, len(top)], "<u8").tobytes()
    return head + top + b"".join(p.tobytes() for p in planes[:-1])


def _unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    n, first, width, top = np.frombuffer(raw, "<u8", 4).tolist()
    v = np.zeros((n - 1, 8), np.uint8)
    v[:, width - 1] = np.frombuffer(_ZSTD.decompress(raw[32 : 32 + top], n - 1, asbytes=True), np.uint8) if n > 1 else 0
    for k in range(width - 1):
        v[:, k] = np.frombuffer(raw, np.uint8, n - 1, 32 + top + k * (n - 1))
    out = np.empty(n, np.uint64)
    out[0] = first
    out[1:] = v.reshape(-1).view("<u8")
    return np.cumsum(out, dtype=np.uint64)


def _packed_owner(own: np.ndarray) -> bytes:
    """16-bit document numbers; their high bytes are compressed."""
    low, high = _planes(own.astype("<u2"), 2)
    return low.tobytes() + _ZSTD.compress(high.tobytes(), asbytes=True)


def _unpacked_owner(raw: bytes, n: int) -> np.ndarray:
    v = np.zeros((n, 2), np.uint8)
    if n:
        v[:, 0] = np.frombuffer(raw, np.uint8, n)
        v[:, 1] = np.frombuffer(_ZSTD.decompress(raw[n:], n, asbytes=True), np.uint8)
    return v.reshape(-1).view("<u2")


def _sets(batch_text: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct tokens) of each text."""
    off, data = buffers(batch_text)
    for i, j in steps(off):
        tokens, first = shingles(Words(off[i : j + 1], data[off[i] : off[j]], SPACE_WORDS), n)
        for k in range(j - i):
            yield i + k, np.unique(tokens[first[k] : first[k + 1]])


def _signature(tokens: np.ndarray) -> bytes:
    """128 bits of a set, whatever the order of its tokens."""
    x = mix64(tokens ^ np.uint64(0x9E6C63D0876A9A47))
    return np.array([len(tokens), int(x.sum()), int(mix64(x + np.uint64(1)).sum())], ">u8").tobytes()[4:]


def _need(size: np.ndarray | int, num: int, den: int):
    """Tokens that a set of ``size`` must share with any partner: ceil(num * size / den)."""
    return -(-num * size // den)


_PARTS = [("r", pa.int32()), ("p", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
_WIRE = pa.schema(_PARTS)
_WIRE_SQL = "r int, p long, kind int, a binary, b binary, c binary"
_TOKENS, _LOCAL, _SETS, _FOUND, _DOCS = range(5)


def _wire(rows: list[tuple], kind: pa.DataType) -> pa.Table:
    """Rows of the wire schema, without documents' ids."""
    cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _WIRE.types, strict=True)]
    return pa.Table.from_arrays([*cols, pa.nulls(len(rows), kind)], names=[*_WIRE.names, "id"])


def _chunks(n: int, ranges: int):
    """Mapper of step 1: packed tokens by range, and what the chunk keeps to itself, as rows of the wire schema."""

    def flush(p: int, sets: list[np.ndarray], sigs: list[bytes], docs: list[tuple], ids: list[pa.Array]) -> pa.Table:
        ids_ = pa.concat_arrays(ids)
        m = len(docs)
        size = pa.array([np.array([len_], "<u4").tobytes() for len_, _ in docs], pa.binary())
        # documents need no chunk to come back to: they travel in small groups under numbers below zero
        group = np.arange(m) // DOCS_A_GROUP
        cols = [pa.array((p + group) % ranges, pa.int32()), pa.array(-1 - (p + (group << 20))), pa.array(np.full(m, _DOCS), pa.int32()), pa.array([s for _, s in docs], pa.binary()), size, pa.nulls(m, pa.binary())]
        out = pa.Table.from_arrays([*cols, ids_], names=[*_WIRE.names, "id"])
        if not sets:
            return out
        size = np.array([len(s) for s in sets], np.int64)
        token = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets), dtype=np.uint16), size)
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        count = np.diff(np.r_[first, len(token)])
        # range of a token: its share of the 64-bit line
        low_of = np.array([-(-(k << 64) // ranges) for k in range(1, ranges)], np.uint64)
        ours, several = token[first], np.repeat(count > 1, count)
        own = doc[first].copy()
        own[count > 1] = _SHARED
        again, mine = token[several], doc[several]
        edge = np.r_[0, np.searchsorted(ours, low_of), len(ours)]
        some = np.r_[0, np.searchsorted(again, low_of), len(again)]
        rows: list[tuple] = []
        for k in range(ranges):
            a, z = edge[k], edge[k + 1]
            if a < z:
                c = count[a:z]
                rows.append((k, p, _TOKENS, _packed(ours[a:z]), _packed_owner(own[a:z]), c[c > 1].astype("<u4").tobytes()))
            a, z = some[k], some[k + 1]
            if a < z:
                rows.append((k, p, _LOCAL, _packed(again[a:z]), _packed_owner(mine[a:z]), b""))
        rows.append((p % ranges, p, _SETS, b"".join(sigs), size.astype("<u4").tobytes(), b""))
        return pa.concat_tables([out, _wire(rows, ids_.type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, sets, sigs, tokens, seen, docs, ids = TaskContext.get().partitionId() << 32, [], [], 0, set(), [], []
        for b in batches:
            at = 0
            for i, s in _sets(b.column(1), n):
                sig = _signature(s) if len(s) else None
                is_new = sig is not None and sig not in seen
                if docs and (is_new and sets and tokens + len(s) > CHUNK_TOKENS or len(docs) >= CHUNK_DOCS):
                    ids.append(b.column(0).slice(at, i - at))
                    yield from flush(p, sets, sigs, docs, ids).combine_chunks().to_batches()
                    p, sets, sigs, tokens, seen, docs, ids, at = p + 1, [], [], 0, set(), [], [], i
                    is_new = sig is not None
                docs.append((len(s), sig))
                if is_new:
                    sets.append(s)
                    sigs.append(sig)
                    seen.add(sig)
                    tokens += len(s)
            ids.append(b.column(0).slice(at))
        if docs:
            yield from flush(p, sets, sigs, docs, ids).combine_chunks().to_batches()

    return run


def _count_range(key: tuple, rows: pa.Table) -> pa.Table:
    """Step 1 at a token range: tell every chunk its tokens that more than one set holds, and their frequency."""
    kind = rows.column("kind").to_numpy()
    names = [*_WIRE.names, "id"]
    keep = rows.filter(pa.array(kind != _TOKENS)).select(names)
    sent = rows.filter(pa.array(kind == _TOKENS))
    if not len(sent):
        return keep
    r, chunk = key[0].as_py(), sent.column("p").to_numpy()
    low, own, count = [], [], []
    for a, b, c in zip(*(sent.column(x).to_pylist() for x in "abc"), strict=True):
        t = _unpacked(a)
        o, k = _unpacked_owner(b, len(t)), np.ones(len(t), np.int64)
        k[o == _SHARED] = np.frombuffer(c, "<u4")
        low.append(t)
        own.append(o)
        count.append(k)
    length = [len(x) for x in low]
    low, own, count, at = np.concatenate(low), np.concatenate(own), np.concatenate(count), np.repeat(np.arange(len(length), dtype=np.int32), length)
    order = np.argsort(low, kind="stable")
    low, own, count, at = low[order], own[order], count[order], at[order]
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    total = np.add.reduceat(count, first)
    total = np.repeat(total, np.diff(np.r_[first, len(low)]))
    keep_it = total > 1
    low, own, total, at = low[keep_it], own[keep_it], total[keep_it], at[keep_it]
    order = np.argsort(at, kind="stable")
    low, own, total = low[order], own[order], total[order]
    edge = np.searchsorted(at[order], np.arange(len(length) + 1))
    out = [(r, int(chunk[i]), _FOUND, _packed(low[a:z]), _packed_owner(own[a:z]), np.minimum(total[a:z], 0xFFFF).astype("<u2").tobytes()) for i, (a, z) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if a < z]
    if not out:
        return keep
    return pa.concat_tables([keep, _wire(out, rows.schema.field("id").type).cast(keep.schema)])


def _gather_chunk(num: int, den: int):
    """Step 1 back at a chunk: its documents, and its sets that may have partners, with their shared tokens, rarest first."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        token, doc, freq, flagged, flagged_freq = [], [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        sigs, size = b"", np.zeros(0, np.int64)
        local, local_doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint16)]
        is_doc = pa.array(rows.column("kind").to_numpy() == _DOCS)
        docs, rows = rows.filter(is_doc), rows.filter(pc.invert(is_doc))
        for kind, a, b, c in zip(*(rows.column(x).to_pylist() for x in ("kind", "a", "b", "c")), strict=True):
            if kind == _SETS:
                sigs, size = a, np.frombuffer(b, "<u4").astype(np.int64)
                continue
            t = _unpacked(a)
            o = _unpacked_owner(b, len(t))
            if kind == _LOCAL:
                local.append(t)
                local_doc.append(o)
            else:  # frequencies above 65535 only order tokens, and tie
                f = np.frombuffer(c, "<u2").astype(np.int64)
                many = o == _SHARED
                flagged.append(t[many])
                flagged_freq.append(f[many])
                token.append(t[~many])
                doc.append(o[~many])
                freq.append(f[~many])
        flag, flag_freq = np.concatenate(flagged), np.concatenate(flagged_freq)
        order = np.argsort(flag)
        flag, flag_freq = flag[order], flag_freq[order]
        token.append(np.concatenate(local))
        doc.append(np.concatenate(local_doc))
        freq.append(flag_freq[np.searchsorted(flag, token[-1])] if len(token[-1]) else np.zeros(0, np.int64))
        token, doc, freq = np.concatenate(token), np.concatenate(doc).astype(np.int64), np.concatenate(freq)
        order = np.lexsort((token, freq, doc))
        token, doc, freq = token[order], doc[order], freq[order]
        edge = np.searchsorted(doc, np.arange(len(size) + 1))
        alive = np.flatnonzero(np.diff(edge) >= _need(size, num, den))
        id_type = rows.schema.field("id").type
        n, m = len(docs), len(alive)
        doc_size = np.frombuffer(b"".join(docs.column("b").to_pylist()), "<u4").astype(np.int64)
        out = {
            "p": pa.array([key[0].as_py()] * (n + m), pa.int64()),
            "sig": pa.chunked_array([docs.column("a").combine_chunks(), pa.array([sigs[20 * i : 20 * i + 20] for i in alive], pa.binary())], pa.binary()),
            "size": pa.array(np.r_[doc_size, size[alive]], pa.int64()),
            "tokens": pa.array([None] * n + [token[edge[i] : edge[i + 1]].tobytes() for i in alive], pa.binary()),
            "central": pa.array([None] * n + [float(freq[edge[i] : edge[i + 1]].sum()) / float(size[i]) for i in alive], pa.float64()),
            "id": pa.chunked_array([docs.column("id").combine_chunks(), pa.nulls(m, id_type)], id_type),
        }
        return pa.table(out)

    return run


def _prefixes(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, row = [], []
            for i, (size, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2), strict=True)):
                t = np.frombuffer(t.as_buffer(), np.int64)
                token.append(t[: _prefix(size, len(t), num, den)])
                row.append(np.full(len(token[-1]), i))
            row = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token)), b.column(0).take(row), b.column(1).take(row), b.column(3).take(row)], names=["token", "sig", "size", "central"])

    return run


def _prefix(size: int, shared: int, num: int, den: int) -> int:
    """Shared tokens in the necessary prefix; the set's unshared tokens are rarer still and come before them."""
    return size - _need(size, num, den) + 1 - (size - shared)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class BlockJoin:
    """Links inside one block pair. Sets come as token arrays in global order of rarity."""

    def __init__(self, sets: list[np.ndarray], size: np.ndarray, side: np.ndarray, group: np.ndarray, num: int, den: int, prefix: np.ndarray) -> None:
        order = np.argsort(size, kind="stable")
        self.order, self.size, self.side, self.num, self.den = order, size[order], side[order], num, den
        self.m = m = len(order)
        sets = [sets[i] for i in order]
        self.held = np.array([len(s) for s in sets], np.int64)
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        edge = np.r_[0, np.cumsum(self.held)]
        self.ids = [ids[a:z] for a, z in zip(edge[:-1], edge[1:], strict=True)]
        own = np.repeat(np.arange(m), self.held)
        self.posting = np.sort(ids * m + own)  # all tokens: list by list, by size inside a list
        place = np.arange(len(ids)) - edge[own]
        self.prefix = prefix[order]
        inside = place < self.prefix[own]
        key = ids[inside] * m + own[inside]
        by = np.argsort(key)
        self.list_key, self.list_left = key[by], (self.held[own] - place)[inside][by]
        self.block_left = np.maximum.reduceat(self.list_left, np.arange(0, len(by), SKIP)) if len(by) else np.zeros(0, np.int64)
        self.parent = np.arange(m)
        for g in np.unique(group[group >= 0]):
            at = np.flatnonzero(group[order] == g)
            self.parent[at] = at[0]
        self.answers: list[tuple[int, np.ndarray]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def candidates(self, x: int, low: int) -> np.ndarray:
        """Smaller sets that share a prefix token of x at places where enough tokens can still follow."""
        t = self.ids[x][: self.prefix[x]]
        start, end = np.searchsorted(self.list_key, t * self.m + low), np.searchsorted(self.list_key, t * self.m + x)
        left = self.held[x] - np.arange(len(t))
        ok = start < end
        start, end, left = start[ok], end[ok], left[ok]
        least = -(-self.num * (self.size[x] + self.size[low]) // (self.num + self.den))  # overlap with the smallest partner
        n = (end - 1) // SKIP - start // SKIP + 1
        block = _spread(start // SKIP, n)
        of = np.repeat(np.arange(len(start)), n)
        ok = np.minimum(self.block_left[block], left[of]) >= least
        block, of = block[ok], of[ok]
        a, z = np.maximum(block * SKIP, start[of]), np.minimum(block * SKIP + SKIP, end[of])
        entry = _spread(a, z - a)
        of = np.repeat(of, z - a)
        y = self.list_key[entry] % self.m
        ok = np.minimum(self.list_left[entry], left[of]) * (self.num + self.den) >= self.num * (self.size[x] + self.size[y])
        return np.unique(y[ok])

    def _add(self, tokens: np.ndarray) -> np.ndarray:
        start, end = np.searchsorted(self.posting, tokens * self.m), np.searchsorted(self.posting, (tokens + 1) * self.m)
        return np.bincount(self.posting[_spread(start, end - start)] % self.m, minlength=self.m)

    def overlaps(self, x: int) -> np.ndarray:
        """|x & y| for every y of the block, derived from the answers of the most similar set computed before."""
        change = [self.held[x] + self.held[r] - 2 * a[x] for r, a in self.answers]
        if change and min(change) < self.held[x]:
            r, known = self.answers[int(np.argmin(change))]
            out = known + self._add(np.setdiff1d(self.ids[x], self.ids[r])) - self._add(np.setdiff1d(self.ids[r], self.ids[x]))
        else:
            out = self._add(self.ids[x])
            self.answers = [(x, out), *self.answers][:KEPT]
        return out

    def links(self) -> list[tuple[int, int]]:
        """A spanning forest of the links that connect sets not connected yet."""
        out = []
        for x in range(self.m):
            low = int(np.searchsorted(self.size * self.den, self.size[x] * self.num))
            if low >= x:
                continue
            y = self.candidates(x, low)
            y = y[(self.side[y] != self.side[x]) | (self.side[x] == 2)]
            mine = self.root(x)
            y = y[np.array([self.root(k) != mine for k in y.tolist()], bool)]
            if not len(y):
                continue
            o = self.overlaps(x)
            for k in y[o[y] * (self.num + self.den) >= self.num * (self.size[x] + self.size[y])].tolist():
                if self.root(k) != self.root(x):
                    self.parent[self.root(k)] = self.root(x)
                    out.append((int(self.order[x]), int(self.order[k])))
        return out


def _tokens(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(t, np.int64) for t in rows.column("tokens").to_pylist()]


def _star_links(num: int, den: int):
    """Step 3: members of (leader, block) that link to the leader."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sigs, size, sets = rows.column("sig").to_pylist(), rows.column("size").to_numpy(), _tokens(rows)
        lead = key[0].as_py()
        k = sigs.index(lead)
        mine = np.sort(sets[k])
        good = []
        for i in range(len(sigs)):
            if sigs[i] != lead:
                at = np.minimum(np.searchsorted(mine, sets[i]), len(mine) - 1)
                if int((mine[at] == sets[i]).sum()) * (num + den) >= num * (size[i] + size[k]):
                    good.append(sigs[i])
        return pa.table({"a": pa.array(good, pa.binary()), "b": pa.array([lead] * len(good), pa.binary())})

    return run


def _group_links(num: int, den: int):
    """Step 4: links inside a block pair of a group."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        sigs, size, sets = rows.column("sig").to_pylist(), rows.column("size").to_numpy(), _tokens(rows)
        side, roots = rows.column("side").to_numpy(), rows.column("root").to_pylist()
        number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        prefix = np.array([_prefix(int(n), len(s), num, den) for n, s in zip(size, sets, strict=True)], np.int64)
        found = BlockJoin(sets, size.astype(np.int64), side, np.array([number[r] for r in roots]), num, den, prefix).links() if len(sigs) > 1 else []
        return pa.table({"a": pa.array([sigs[x] for x, _ in found], pa.binary()), "b": pa.array([sigs[y] for _, y in found], pa.binary())})

    return run


def _blocks(chosen: Column) -> Column:
    """Blocks for the chosen rows of a group: by sets and by tokens, so that neither many nor very long texts fill a task."""
    return F.ceil(F.greatest(F.sum(chosen.cast("long")) / BLOCK, F.sum(F.when(chosen, F.col("size")).otherwise(0)) / BLOCK_TOKENS)).cast("int")


def _set_tables(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: (id, size, sig) of every document, and the distinct sets that may have partners."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (BYTES_A_TOKEN * CHUNK_TOKENS)), 1)
    kind = docs.schema[id_col].dataType.simpleString()
    wire = docs.select(id_col, text_col).mapInArrow(_chunks(n, ranges), f"{_WIRE_SQL}, id {kind}")
    found = wire.groupBy("r").applyInArrow(_count_range, f"{_WIRE_SQL}, id {kind}")
    out = cut(found.groupBy("p").applyInArrow(_gather_chunk(num, den), f"p long, sig binary, size long, tokens binary, central double, id {kind}"))
    sets = out.where("tokens is not null").drop("id")
    once = sets.groupBy("sig").agg(F.min("p").alias("p"))  # equal sets of different chunks
    return out.where("tokens is null").select("id", "size", "sig"), cut(sets.join(once, ["sig", "p"], "left_semi").drop("p"))


def jaccard_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links between different sets, by signature, enough to connect every class."""
    entries = sets.select("sig", "size", "tokens", "central").mapInArrow(_prefixes(num, den), "token long, sig binary, size long, central double")
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("central", "sig")).alias("lead")).where("n > 1")
    lists = cut(lists.select("token", "n", F.col("lead.sig").alias("lead"), F.col("lead.central").alias("lead_central")))
    total = lists.agg(F.sum("n")).first()[0] or 0
    member = cut(join_counted(entries, lists, "token", "n", total).select("sig", "size", "lead", "lead_central").distinct())

    best = cut(member.where("sig <> lead").groupBy("sig", "size").agg(F.max(F.struct("lead_central", "lead")).alias("b")).select("sig", "size", F.col("b.lead").alias("lead")))
    width = cut(best.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), _blocks(F.lit(True)).alias("blocks")))
    total = width.agg(F.sum("n")).first()[0] or 0
    starred = join_counted(best, width, "lead", "n", total).select("lead", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("block"), "sig")
    centre = width.select("lead", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("lead").alias("sig"))
    star_rows = starred.unionByName(centre).join(sets.select("sig", "size", "tokens"), "sig")
    stars = cut(star_rows.groupBy("lead", "block").applyInArrow(_star_links(num, den), "a binary, b binary"))

    rooted = member.select("sig", "size", "lead").join(stars.select(F.col("a").alias("sig"), F.col("b").alias("star")), "sig", "left")
    rooted = cut(rooted.select("sig", "size", "lead", F.coalesce("star", "sig").alias("root")).withColumn("free", F.col("root") != F.col("lead")))
    wide = cut(rooted.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), _blocks(F.col("free")).alias("u"), _blocks(~F.col("free")).alias("v")).where("u > 0"))
    total = wide.agg(F.sum("n")).first()[0] or 0
    placed = join_counted(rooted, wide, "lead", "n", total).withColumn("at", F.pmod(F.xxhash64("sig"), F.when(F.col("free"), F.col("u")).otherwise(F.col("v"))).cast("int"))
    # block pairs: free against free (i <= j), and free (i) against what is linked to the leader (j)
    place = "array<struct<i:int,j:int,with_linked:int,side:int>>"
    to_u = F.when(F.col("free"), F.transform(F.sequence(F.lit(0), F.col("u") - 1), lambda k: F.struct(F.least(k, F.col("at")).alias("i"), F.greatest(k, F.col("at")).alias("j"), F.lit(0).alias("with_linked"), F.when(F.col("u") == 1, 2).when(k == F.col("at"), 2).when(k > F.col("at"), 0).otherwise(1).alias("side"))))
    to_v = F.when(F.col("free") & (F.col("v") > 0), F.transform(F.sequence(F.lit(0), F.greatest(F.col("v") - 1, F.lit(0))), lambda k: F.struct(F.col("at").alias("i"), k.alias("j"), F.lit(1).alias("with_linked"), F.lit(0).alias("side"))))
    from_v = F.when(~F.col("free"), F.transform(F.sequence(F.lit(0), F.col("u") - 1), lambda k: F.struct(k.alias("i"), F.col("at").alias("j"), F.lit(1).alias("with_linked"), F.lit(1).alias("side"))))
    none = F.array().cast(place)
    tasks = placed.select("sig", "lead", "root", F.explode(F.concat(*(F.coalesce(x.cast(place), none) for x in (to_u, to_v, from_v)))).alias("t"))
    tasks = tasks.select("sig", "lead", "root", "t.*").join(sets.select("sig", "size", "tokens"), "sig")
    pairs = tasks.groupBy("lead", "i", "j", "with_linked").applyInArrow(_group_links(num, den), "a binary, b binary")
    return stars.unionByName(pairs)


def jaccard_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_members): each document's set size, its class and how many documents are in it.

    component_id is the smallest id that links reach (links between documents of Jaccard similarity num / den or more).
    """
    table, sets = _set_tables(docs, n, num, den, id_col, text_col)
    nodes = connected_components(jaccard_links(sets, num, den), "a", "b")
    named = table.where("sig is not null").groupBy("sig").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = named.join(nodes.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "least", "copies", F.coalesce("component", "sig").alias("component"))
    name = named.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members"))
    of = named.join(name, "component").select("sig", "component_id", "members")
    out = table.join(of, "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("members", F.lit(1)).alias("n_members"))
