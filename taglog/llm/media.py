"""Media columns: baseline JPEG written and read in numpy.

Writing (``encode_media``): a text's UTF-8 bytes, padded with 255 to a positive multiple of 576, become the 8-bit
samples of DC-only blocks of a greyscale baseline JPEG, 576 blocks a row. The quantiser of the DC term is 8, so a
block's DC coefficient is exactly ``sample - 128`` and the eighth-size thumbnail of the image *is* the payload.
The DC Huffman table gives category ``c`` a code of ``9 - c`` bits, so code and extra bits are 9 bits for every
difference, and end-of-block is 1 bit: 10 bits a block, 720 bytes a row, no padding bits. Every row ends a restart
interval. An image has at most 8191 rows (the format's height limit); longer payloads are several images in sequence.
The unpadded length is kept in a comment segment.

Reading (``read_images``) takes any baseline JPEG: markers are parsed, scans Huffman-decoded and the DC terms of the
luminance component dequantised to the thumbnail. Restart intervals of DC-only greyscale scans are decoded all at once
by trying every block at the stride of the first one and checking that each block really has that length and that all
intervals are whole; by induction that equals decoding in sequence. Any other scan is decoded symbol by symbol.

Defined results: null and empty text are a payload of 576 bytes of 255; equal texts give equal values; repeated rows
give repeated rows; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taglog.llm.common import ids_of

UNIT = 576
MAX_ROWS = 8191

#: Fixed values of the JPEG standard: the zigzag-ordered quantiser holds 8 for DC; AC terms never occur.
_DQT = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] + [1] * 63)
_DC_COUNTS = bytes([1] * 9 + [0] * 7)
_DC_SYMBOLS = bytes(range(8, -1, -1))
_DHT = b"\xff\xc4" + struct.pack(">HB", 19 + 9, 0x00) + _DC_COUNTS + _DC_SYMBOLS + b"\xff\xc4" + struct.pack(">HB", 19 + 1, 0x10) + bytes([1] + [0] * 15) + b"\x00"
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 0, 63, 0)


@functools.lru_cache(maxsize=1)
def _encode_table() -> np.ndarray:
    """The 10 bits of a block by its DC difference + 255."""
    diff = np.arange(-255, 256)
    size = np.zeros(511, np.int64)
    for k in range(8):
        size[np.abs(diff) >> k > 0] = k + 1
    length = 9 - size
    code = (1 << length) - 2  # 0, 10, 110, ... as category 8 has the shortest code
    extra = np.where(diff >= 0, diff, diff + (1 << size) - 1)
    return (((code << size) | extra) << 1).astype(np.uint64)  # end-of-block is the bit 0


def _scan(rows: np.ndarray) -> bytes:
    """Entropy-coded data of a (rows, 576) block of samples, with a restart marker after each row but the last."""
    level = rows.astype(np.int16) - 128
    diff = level.copy()
    diff[:, 1:] -= level[:, :-1]
    bits = _encode_table()[diff + 255].reshape(-1, 4)
    word = (bits[:, 0] << np.uint64(30)) | (bits[:, 1] << np.uint64(20)) | (bits[:, 2] << np.uint64(10)) | bits[:, 3]
    raw = word.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(len(rows), -1)
    n = len(rows)
    mark = np.empty((n, 2), np.uint8)
    mark[:, 0] = 0xFF
    mark[:, 1] = 0xD0 + np.arange(n) % 8
    body = np.concatenate([raw, mark], axis=1).reshape(-1)[:-2]
    stuffed = np.zeros((n, raw.shape[1] + 2), bool)
    stuffed[:, :-2] = raw == 0xFF
    at = np.flatnonzero(stuffed.reshape(-1)[:-2])
    return (np.insert(body, at + 1, 0) if len(at) else body).tobytes()


def encode_payload(payload: bytes, n_bytes: int) -> bytes:
    """A padded payload as one or more JPEG images in sequence."""
    assert payload and len(payload) % UNIT == 0
    rows, out = np.frombuffer(payload, np.uint8).reshape(-1, UNIT), []
    for a in range(0, len(rows), MAX_ROWS):
        part = rows[a : a + MAX_ROWS]
        note = str(n_bytes).encode()
        out += [
            b"\xff\xd8\xff\xfe" + struct.pack(">H", 2 + len(note)) + note,
            _DQT,
            b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, len(part) * 8, UNIT * 8, 1, 1, 0x11, 0),
            _DHT,
            b"\xff\xdd" + struct.pack(">HH", 4, UNIT),
            _SOS,
            _scan(part),
            b"\xff\xd9",
        ]
    return b"".join(out)


class _Huffman:
    """Canonical Huffman table: code length and symbol by the next 16 bits; length 0 where no code fits."""

    def __init__(self, counts: bytes, symbols: bytes) -> None:
        self.length, self.symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        code = k = 0
        for n in range(1, 17):
            for _ in range(counts[n - 1]):
                a = code << (16 - n)
                self.length[a : a + (1 << (16 - n))] = n
                self.symbol[a : a + (1 << (16 - n))] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1


@functools.lru_cache(maxsize=64)
def _huffman(counts: bytes, symbols: bytes) -> _Huffman:
    return _Huffman(counts, symbols)


@functools.lru_cache(maxsize=16)
def _block_table(dc: tuple[bytes, bytes], ac: tuple[bytes, bytes], stride: int) -> np.ndarray:
    """DC difference by the ``stride`` bits of a block; 1 << 20 where they are not exactly one DC-only block."""
    t, e = _huffman(*dc), _huffman(*ac)
    out = np.full(1 << stride, 1 << 20, np.int32)
    for v in range(1 << stride):
        peek = (v << 16 >> stride) if stride <= 16 else v >> (stride - 16)
        n, size = int(t.length[peek & 0xFFFF]), int(t.symbol[peek & 0xFFFF])
        left = stride - n - size
        if not n or left <= 0 or left > 16:
            continue
        extra = (v >> left) & ((1 << size) - 1)
        tail = (v & ((1 << left) - 1)) << (16 - left)
        if e.length[tail] == left and e.symbol[tail] == 0:
            out[v] = extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
    return out


def _fast_scan(body: np.ndarray, restart: int, blocks: int, dc: tuple, ac: tuple) -> np.ndarray | None:
    """DC terms of a greyscale scan whose blocks all have 10 bits; None if they do not."""
    if restart % 4 or not restart:
        return None
    ff = np.flatnonzero(body == 0xFF)
    if len(ff) and ff[-1] + 1 >= len(body):
        return None
    nxt = body[ff + 1]
    if not np.all((nxt == 0) | ((nxt >= 0xD0) & (nxt <= 0xD7))):
        return None
    drop = np.ones(len(body), bool)
    drop[ff + 1] = False
    rst = ff[nxt != 0]
    drop[rst] = False
    raw = body[drop]
    per = restart * 10 // 8
    n = -(-blocks // restart)
    if blocks % restart or len(raw) != n * per or len(rst) != n - 1:
        return None
    if not np.array_equal(body[rst + 1], 0xD0 + np.arange(n - 1) % 8):
        return None
    if not np.array_equal(np.searchsorted(np.flatnonzero(drop), rst), per * np.arange(1, n)):
        return None
    q = np.zeros((len(raw) // 5, 8), np.uint8)
    q[:, 3:] = raw.reshape(-1, 5)
    word = q.reshape(-1).view(">u8").astype(np.uint64)
    bits = np.empty((len(word), 4), np.int64)
    for k, s in enumerate((30, 20, 10, 0)):
        bits[:, k] = (word >> np.uint64(s)) & np.uint64(0x3FF)
    diff = _block_table(dc, ac, 10)[bits]
    if diff.max(initial=0) >= 1 << 20:
        return None
    return np.cumsum(diff.reshape(n, restart), axis=1, dtype=np.int32).reshape(-1)


class _Bits:
    """Bit reader over one restart interval without stuffed zeros; ones follow the end."""

    def __init__(self, data: bytes) -> None:
        self.n = len(data) * 8
        self.v = int.from_bytes(data + b"\xff" * 4, "big")
        self.total, self.at = self.n + 32, 0

    def peek16(self) -> int:
        if self.at > self.n:
            raise ValueError("scan data ends too early")
        return (self.v >> (self.total - self.at - 16)) & 0xFFFF

    def take(self, k: int) -> int:
        out = (self.v >> (self.total - self.at - k)) & ((1 << k) - 1) if k else 0
        self.at += k
        if self.at > self.n:
            raise ValueError("scan data ends too early")
        return out

    def symbol(self, t: _Huffman) -> int:
        p = self.peek16()
        if not t.length[p]:
            raise ValueError("no such Huffman code")
        self.at += int(t.length[p])
        return int(t.symbol[p])


def _slow_scan(body: bytes, restart: int, comps: list, frame: dict, tables: dict) -> np.ndarray:
    """DC terms of the first component, block by block, for any interleaving and any tables."""
    hmax, vmax = max(c["h"] for c in frame["comps"]), max(c["v"] for c in frame["comps"])
    y = frame["comps"][0]
    if len(comps) == 1:
        wide, high = -(-frame["w"] * y["h"] // (8 * hmax)), -(-frame["h"] * y["v"] // (8 * vmax))
        mcus, plan = wide * high, [(0, comps[0], 1, 1)]
    else:
        mw, mh = -(-frame["w"] // (8 * hmax)), -(-frame["h"] // (8 * vmax))
        wide, high = mw * y["h"], mh * y["v"]
        mcus, plan = mw * mh, [(i, c, frame["comps"][i]["h"], frame["comps"][i]["v"]) for i, c in enumerate(comps)]
    out = np.zeros((high, wide), np.int32)
    parts, at = [], 0
    start = 0
    while (k := body.find(b"\xff", at)) >= 0:  # cut at restart markers
        if 0xD0 <= body[k + 1] <= 0xD7:
            parts.append(body[start:k])
            start = k + 2
        at = k + 2
    parts.append(body[start:])
    step = restart or mcus
    for first in range(0, mcus, step):
        bits, pred = _Bits(parts[first // step].replace(b"\xff\x00", b"\xff")), [0] * len(plan)
        for m in range(first, min(mcus, first + step)):
            for j, (i, c, h, v) in enumerate(plan):
                for b in range(h * v):
                    size = bits.symbol(tables[0, c["dc"]])
                    extra = bits.take(size)
                    pred[j] += extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
                    k = 1
                    while k < 64:
                        s = bits.symbol(tables[1, c["ac"]])
                        if s == 0:
                            break
                        bits.take(s & 15)
                        k += 16 if s == 0xF0 else (s >> 4) + 1
                    if i == 0:
                        if len(plan) == 1:
                            out[m // wide, m % wide] = pred[j]
                        else:
                            out[(m // (wide // y["h"])) * y["v"] + b // h, (m % (wide // y["h"])) * y["h"] + b % h] = pred[j]
    return out


def read_images(data: bytes) -> Iterator[dict]:
    """Images of a baseline JPEG stream: width, height, comment and DC-only luminance thumbnail (uint8 array).

    A text that is no baseline JPEG raises ValueError.
    """
    at, n = 0, len(data)
    while at < n:
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        quant, tables, raw, frame, restart, note = {}, {}, {}, {}, 0, b""
        while True:
            if at + 2 > n or data[at] != 0xFF:
                raise ValueError("no marker where one must be")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            if kind == 0xD9:
                raise ValueError("image without a scan")
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            seg = data[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xDB:
                while seg:
                    wide = 1 + (seg[0] >> 4)
                    quant[seg[0] & 15] = seg[1] if wide == 1 else struct.unpack(">H", seg[1:3])[0]
                    seg = seg[1 + 64 * wide :]
            elif kind == 0xC4:
                while seg:
                    counts = seg[1:17]
                    k = sum(counts)
                    key = seg[0] >> 4, seg[0] & 15
                    raw[key] = counts, seg[17 : 17 + k]
                    tables[key] = _huffman(*raw[key])
                    seg = seg[17 + k :]
            elif kind == 0xC0:
                depth, h, w, k = struct.unpack(">BHHB", seg[:6])
                if depth != 8:
                    raise ValueError("samples are not of 8 bits")
                frame = {"w": w, "h": h, "comps": [{"id": seg[6 + 3 * i], "h": seg[7 + 3 * i] >> 4, "v": seg[7 + 3 * i] & 15, "q": seg[8 + 3 * i]} for i in range(k)]}
            elif 0xC1 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
                raise ValueError("only baseline images are read")
            elif kind == 0xDD:
                restart = struct.unpack(">H", seg[:2])[0]
            elif kind == 0xFE:
                note = seg
            elif kind == 0xDA:
                comps = [{"dc": seg[2 + 2 * i] >> 4, "ac": seg[2 + 2 * i] & 15} for i in range(seg[0])]
                break
        end = data.find(b"\xff\xd9", at)  # stuffed zeros keep this pair out of scan data
        if end < 0:
            raise ValueError("no end of image")
        y = frame["comps"][0]
        wide, high, dc = -(-frame["w"] // 8), -(-frame["h"] // 8), None
        if len(frame["comps"]) == 1:
            dc = _fast_scan(np.frombuffer(data, np.uint8, end - at, at), restart, wide * high, raw[0, comps[0]["dc"]], raw[1, comps[0]["ac"]])
        dc = dc.reshape(high, wide) if dc is not None else _slow_scan(data[at:end], restart, comps, frame, tables)
        thumb = np.clip((dc * quant[y["q"]] + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        yield {"width": frame["w"], "height": frame["h"], "note": note, "thumb": thumb}
        at = end + 2


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Difference and mean hash of an 8 x 9 shrunken thumbnail, as 32 hex digits."""
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(thumb, axis=0, dtype=np.int64), axis=1, out=sums[1:, 1:])
    ya, xa = np.arange(9) * thumb.shape[0] // 8, np.arange(10) * thumb.shape[1] // 9
    y0, y1, x0, x1 = ya[:-1], np.maximum(ya[1:], ya[:-1] + 1), xa[:-1], np.maximum(xa[1:], xa[:-1] + 1)
    cell = (sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]) // ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    d = np.packbits(cell[:, 1:] > cell[:, :-1]).tobytes().hex()
    m = np.packbits(cell[:, :8] * 64 > cell[:, :8].sum()).tobytes().hex()
    return d + m


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media binary): each text stored losslessly as baseline JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                out.append(encode_payload(raw + b"\xff" * (-len(raw) % UNIT or UNIT * (not raw)), len(raw)))
            yield pa.RecordBatch.from_arrays([ids_of(b, id_col), pa.array(out, pa.binary())], names=[id_col, "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, media binary")


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read stored media back and describe each row: payload digests, stored form's digest, size and thumbnail hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for m in b.column(1):
                data = m.as_buffer().to_pybytes()
                images = list(read_images(data))
                payload = b"".join(x["thumb"].tobytes() for x in images)
                feature = ";".join(f"{x['width']}x{x['height']}:{thumbnail_hash(x['thumb'])}" for x in images)
                for k, v in enumerate((int(images[0]["note"] or len(payload)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature)):
                    rows[k].append(v)
            names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([ids_of(b, id_col), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], names=names)

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(id_col, "media").mapInArrow(run, f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
