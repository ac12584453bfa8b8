"""Operator 7: media columns as baseline JPEG. Payload bytes are the quantised coefficients, so that the files hold them without loss."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import ship, text_slices

#: Bytes of a minimum coded unit: one 8 x 8 block of each of three components.
UNIT = 192
#: A JPEG's height is below 65536.
MOST_ROWS = 8191


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int, cols: int, payload: int) -> bytes:
    """Everything up to the scan. Huffman codes: 0 for a value of eight bits, 10 for none (category 0, end of block)."""
    table = bytes([1, 1, *[0] * 14])
    return b"".join(
        [
            b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xFE, b"payload %d" % payload), _segment(0xDB, bytes([0, *[1] * 64])),
            _segment(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * cols, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))),
            _segment(0xC4, bytes([0x00]) + table + bytes([8, 0])), _segment(0xC4, bytes([0x10]) + table + bytes([8, 0])),
            _segment(0xDD, b"\0\1"), _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
        ]
    )


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """A JPEG for each payload, a positive multiple of UNIT bytes.

    Byte b stands for the coefficient b, or b - 255 if that would be below 128: those are the values of eight bits,
    whose appended bits are b itself. Each unit is a restart interval, so that a first coefficient is a difference from 0.
    """
    if not payloads:
        return []
    units = np.array([len(p) // UNIT for p in payloads])
    eight = np.concatenate(payloads).reshape(-1, 8)
    scan = np.zeros((len(eight), 9), np.uint8)
    for i in range(8):
        scan[:, i] |= eight[:, i] >> np.uint8(i + 1)
        scan[:, i + 1] |= eight[:, i] << np.uint8(7 - i)
    scan = scan.reshape(-1)
    width = UNIT * 9 // 8
    # room for a stuffed 0 after each 255, and for a restart marker after each unit but an image's last
    extra = (scan == 255).astype(np.int64)
    last = np.cumsum(units) - 1
    ends = np.arange(1, len(scan) // width + 1) * width - 1
    marked = np.ones(len(ends), bool)
    marked[last] = False
    shift = np.cumsum(extra) - extra
    unit_extra = np.cumsum(np.concatenate([[0], 2 * marked[:-1]]))
    at = np.arange(len(scan)) + shift + np.repeat(unit_extra, width)
    out = np.zeros(len(scan) + int(extra.sum()) + 2 * int(marked.sum()), np.uint8)
    out[at] = scan
    place = at[ends[marked]] + 1 + extra[ends[marked]]
    number = np.arange(len(ends)) - np.repeat(np.cumsum(units) - units, units)
    out[place] = 0xFF
    out[place + 1] = 0xD0 + number[marked] % 8
    stop = at[ends[last]] + 1 + extra[ends[last]]
    start = np.concatenate([[0], stop[:-1]])
    files = []
    for i, u in enumerate(units):
        cols = -(-int(u) // MOST_ROWS)
        rows = -(-int(u) // cols)
        blank = b"".join(bytes([0xFF, 0xD0 + (j - 1) % 8]) + b"\xaa\xaf" for j in range(int(u), rows * cols))
        files.append(_head(rows, cols, int(u) * UNIT) + out[start[i] : stop[i]].tobytes() + blank + b"\xff\xd9")
    return files


def parse(data: bytes) -> dict:
    """Markers of a baseline JPEG: size, components, quantisation and Huffman tables, restart interval, comment, and where the scan begins."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    found: dict = {"quant": {}, "huff": {}, "interval": 0, "comment": b""}
    at = 2
    while True:
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                found["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                n = sum(counts)
                found["huff"][body[0]] = (tuple(counts), bytes(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0:
            _, found["height"], found["width"], n = struct.unpack_from(">BHHB", body)
            found["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            found["interval"] = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            found["comment"] = body
        elif marker == 0xDA:
            found["tables"] = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            found["scan"] = at
            return found


def _lookup(counts: tuple[int, ...], symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For 16 bits ahead: the code's length (0: none) and its symbol."""
    length, symbol = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
    code = k = 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            first = code << (16 - n)
            length[first : first + (1 << (16 - n))] = n
            symbol[first : first + (1 << (16 - n))] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def _segments(scan: np.ndarray) -> list[np.ndarray]:
    """Entropy-coded segments between restart markers, without stuffed bytes."""
    full = np.flatnonzero(scan[:-1] == 255)
    after = scan[full + 1]
    cut = full[(after >= 0xD0) & (after <= 0xD7)]
    end = full[after == 0xD9]
    stop = int(end[0]) if len(end) else len(scan)
    keep = np.ones(len(scan), bool)
    keep[full[after == 0] + 1] = False
    edges = [0, *(cut[cut < stop] + 2).tolist()]
    return [scan[a:b][keep[a:b]] for a, b in zip(edges, [*cut[cut < stop].tolist(), stop], strict=True)]


def decode(files: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """Headers, and coefficients in zigzag order as [unit, block, 64], of baseline JPEGs.

    Restart intervals of all files with the same tables are read side by side, one code of each at a time.
    """
    heads = [parse(f) for f in files]
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault((tuple(h["parts"]), h["interval"], tuple(sorted(h["tables"].items())), tuple(sorted(h["huff"].items()))), []).append(i)
    out: list = [None] * len(files)
    for (parts, interval, tables, huff), members in groups.items():
        tables, codes = dict(tables), {k: _lookup(*v) for k, v in huff}
        wide, high = max(p[1] for p in parts), max(p[2] for p in parts)
        if len(parts) == 1:
            wide = high = 1
        blocks = [j for j, p in enumerate(parts) for _ in range(1 if len(parts) == 1 else p[1] * p[2])]
        lanes, owner, count = [], [], []
        for i in members:
            h = heads[i]
            units = -(-h["width"] // (8 * wide)) * -(-h["height"] // (8 * high))
            parts_of = _segments(np.frombuffer(files[i], np.uint8)[h["scan"] :])
            each = interval or units
            lanes += parts_of
            owner.append(len(parts_of))
            count += [min(each, units - each * s) for s in range(len(parts_of))]
        count = np.array(count)
        size = np.array([len(x) for x in lanes])
        data = np.concatenate([np.concatenate([x, np.full(4, 255, np.uint8)]) for x in lanes]).astype(np.int64)
        pos = (np.cumsum(size + 4) - size - 4) * 8
        coef = np.zeros((int(count.sum()), len(blocks), 64), np.int16)
        first = np.cumsum(count) - count
        previous = np.zeros((len(lanes), len(parts)), np.int64)

        def ahead(p: np.ndarray, data: np.ndarray = data) -> np.ndarray:
            q = p >> 3
            return ((data[q] << 16 | data[q + 1] << 8 | data[q + 2]) >> (8 - (p & 7))) & 0xFFFF

        def value(p: np.ndarray, n: np.ndarray, ahead=ahead) -> np.ndarray:
            bits = ahead(p) >> (16 - n)
            return np.where(bits < (1 << n) >> 1, bits - (1 << n) + 1, bits)

        for unit in range(int(count.max(initial=0))):
            on = np.flatnonzero(count > unit)
            for block, j in enumerate(blocks):
                t = tables[parts[j][0]]
                length, symbol = codes[t >> 4]
                p = pos[on]
                bits = ahead(p)
                p = p + length[bits]
                n = symbol[bits]
                previous[on, j] += value(p, n)
                p = p + n
                coef[first[on] + unit, block, 0] = previous[on, j]
                length, symbol = codes[0x10 | t & 15]
                k = np.ones(len(on), np.int64)
                live = np.arange(len(on))
                while len(live):
                    q = p[live]
                    bits = ahead(q)
                    if not (step := length[bits]).all():
                        raise ValueError("no such code")
                    q = q + step
                    s = symbol[bits]
                    n = s & 15
                    k[live] += s >> 4
                    has = n > 0
                    if has.all():
                        coef[first[on[live]] + unit, block, k[live]] = value(q, n)
                    else:
                        x = live[has]
                        coef[first[on[x]] + unit, block, k[x]] = value(q[has], n[has])
                    p[live] = q + n
                    k[live] = np.where(has | (s == 0xF0), k[live] + 1, 64)
                    live = live[k[live] < 64]
                pos[on] = p
        ends = np.cumsum(owner)
        for i, a, b in zip(members, ends - owner, ends, strict=True):
            out[i] = (heads[i], coef[first[a] : first[a] + count[a:b].sum()])
    return out


def thumbnail(head: dict, coef: np.ndarray) -> np.ndarray:
    """Luminance of each block from its first coefficient alone: the mean of the block's samples."""
    _, wide, high, quant = head["parts"][0]
    if len(head["parts"]) == 1:
        wide = high = 1
    cols = -(-head["width"] // (8 * max(p[1] for p in head["parts"]))) if len(head["parts"]) > 1 else -(-head["width"] // 8)
    dc = coef[:, : wide * high, 0].astype(np.int32) * int(head["quant"][quant][0])
    grid = dc.reshape(-1, cols, high, wide).transpose(0, 2, 1, 3).reshape(-1, cols * wide)
    return np.clip((grid + 4) // 8 + 128, 0, 255).astype(np.uint8)[: -(-head["height"] // 8), : -(-head["width"] // 8)]


MEDIA = "doc_id long, n_bytes long, media binary"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, raw, off in text_slices(b.column(1)):
            payloads, sizes = [], np.diff(off)
            for i, n in enumerate(sizes):
                padded = np.full(max(1, -(-int(n) // UNIT)) * UNIT, 32, np.uint8)
                padded[:n] = raw[off[i] : off[i + 1]]
                payloads.append(padded)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(encode(payloads), pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    for b in batches:
        files = b.column(2).to_pylist()
        ids, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
        at = 0
        while at < len(files):
            to, held = at, 0
            while to < len(files) and (to == at or held + len(files[to]) <= 1 << 20):
                held += len(files[to])
                to += 1
            rows = []
            for i, (head, coef) in enumerate(decode(files[at:to]), at):
                n = int(head["comment"].split()[1])
                flat = coef.reshape(-1)[:n]
                payload = np.where(flat < 0, flat + 255, flat).astype(np.uint8).tobytes()
                small = thumbnail(head, coef)
                feature = f"{head['width']}x{head['height']}:{hashlib.sha256(small.tobytes()).hexdigest()[:32]}"
                rows.append((ids[i], sizes[i], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(files[i]), hashlib.sha256(files[i]).hexdigest(), feature, head["width"], head["height"]))
            yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c[0], str) else pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
            at = to


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the JPEG of each row's whole text as UTF-8, filled up with blanks to a positive multiple of UNIT.

    Null counts as empty: one unit of blanks. Equal texts give equal files; rows with null or repeated doc_ids stay. An empty table gives none.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_stored, MEDIA)


def media_features(media: DataFrame) -> DataFrame:
    """What media_columns() stored, read back: payload digests, file digests, dimensions and the thumbnail's hash."""
    ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, DIGESTS)
