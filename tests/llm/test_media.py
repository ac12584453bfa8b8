"""The JPEG decoder against files of a second encoder: subsampled chroma, runs of zeros, several tables, with and without restarts."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from gaugeworks.llm import jpeg
from gaugeworks.llm.queries import QUERIES

# place of each zigzag index in a block
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, n):
        self.text += format(value, f"0{n}b") if n else ""

    def closed(self):
        text = self.text + "1" * (-len(self.text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")


def codes_of(symbols):
    """A code of one bit, two of four and all others of ten, by how often symbols come; the table's counts and its symbols."""
    order = sorted(set(symbols), key=lambda s: (-symbols.count(s), s))
    lengths = [1, 4, 4, *[10] * len(order)][: len(order)]
    code, at, found = 0, 1, {}
    for s, n in zip(order, lengths):
        code <<= n - at
        at = n
        found[s] = (code, n)
        code += 1
    counts = [lengths.count(n) for n in range(1, 17)]
    return found, bytes(counts) + bytes(order)


def split(v):
    n = int(abs(v)).bit_length()
    return n, (v if v >= 0 else v + (1 << n) - 1)


def symbols_of(block, before):
    """(table class, symbol, extra bits, their number) of one block in zigzag order."""
    n, extra = split(block[0] - before)
    out, run = [(0, n, extra, n)], 0
    for v in block[1:]:
        if v == 0:
            run += 1
            continue
        while run > 15:
            out.append((1, 0xF0, 0, 0))
            run -= 16
        n, extra = split(v)
        out.append((1, run << 4 | n, extra, n))
        run = 0
    return out + ([(1, 0, 0, 0)] if run else [])


def written(units, parts, width, height, quants, interval):
    """A file of units of blocks; parts: (id, wide, high, quantisation and Huffman table)."""
    owner = [j for j, (_, w, h, _) in enumerate(parts) for _ in range(w * h)]
    stream, before = [], [0] * len(parts)
    for u, unit in enumerate(units):
        if interval and u % interval == 0:
            before = [0] * len(parts)
            stream.append(None)
        for j, block in zip(owner, unit):
            stream += [(parts[j][3], *s) for s in symbols_of(block.tolist(), before[j])]
            before[j] = int(block[0])
    tables = {(c, t): codes_of([s[2] for s in stream if s and s[:2] == (t, c)]) for t in {p[3] for p in parts} for c in (0, 1)}
    segment = lambda m, body: bytes([0xFF, m]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    out += segment(0xDB, b"".join(bytes([t]) + bytes(q) for t, q in quants.items()))
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([i, w << 4 | h, t]) for i, w, h, t in parts))
    for (c, t), (_, table) in tables.items():
        out += segment(0xC4, bytes([c << 4 | t]) + table)
    if interval:
        out += segment(0xDD, struct.pack(">H", interval))
    out += segment(0xFE, b"made for a test") + segment(0xDA, bytes([len(parts)]) + b"".join(bytes([i, t << 4 | t]) for i, _, _, t in parts) + b"\0\x3f\0")
    pieces, bits = [], Bits()
    for s in stream:
        if s is None:
            if bits.text or pieces:
                pieces.append(bits.closed())
            bits = Bits() if bits.text or pieces else bits
            continue
        t, c, symbol, extra, n = s
        bits.put(*tables[c, t][0][symbol])
        bits.put(extra, n)
    pieces.append(bits.closed())
    return out + b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i < len(pieces) - 1 else b"") for i, p in enumerate(pieces)) + b"\xff\xd9"


def blocks(rng, n):
    """Blocks with long runs of zeros, empty ones, full ones, and large values."""
    out = np.zeros((n, 64), np.int64)
    for b in out:
        b[0] = rng.integers(-900, 900)
        k = rng.choice([0, 1, 3, 63])
        at = rng.choice(np.arange(1, 64), k, replace=False)
        b[at] = rng.integers(-1000, 1000, k)
        if rng.random() < 0.3:
            b[40:63] = 0
    return out


def luminance(unit_blocks, quant, cols, rows, wide, high):
    """Mean of the samples of each block, after the whole inverse transform."""
    basis = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
    out = np.zeros((rows * high, cols * wide))
    for i, unit in enumerate(unit_blocks):
        for k in range(wide * high):
            square = np.zeros(64)
            square[ZIGZAG] = unit[k] * np.array(quant)
            mean = (basis @ square.reshape(8, 8) @ basis.T).mean() + 128
            out[i // cols * high + k // wide, i % cols * wide + k % wide] = np.clip(np.floor(mean + 0.5 + 1e-6), 0, 255)
    return out.astype(np.uint8)


@pytest.mark.parametrize("interval", [0, 1, 3])
@pytest.mark.parametrize("shape", [("gray", 41, 19), ("420", 50, 33), ("422", 16, 8), ("444", 24, 24)])
def test_files_of_another_encoder(shape, interval):
    kind, width, height = shape
    rng = np.random.default_rng(width * 10 + interval)
    wide, high = {"gray": (1, 1), "420": (2, 2), "422": (2, 1), "444": (1, 1)}[kind]
    cols, rows = -(-width // (8 * wide)), -(-height // (8 * high))
    quants = {0: rng.integers(1, 40, 64).tolist(), 1: rng.integers(1, 90, 64).tolist()}
    parts = [(1, wide, high, 0)] if kind == "gray" else [(1, wide, high, 0), (2, 1, 1, 1), (3, 1, 1, 1)]
    each = wide * high + (0 if kind == "gray" else 2)
    files, units = [], []
    for _ in range(3):
        found = blocks(rng, cols * rows * each).reshape(cols * rows, each, 64)
        units.append(found)
        files.append(written(found, parts, width, height, quants, interval))
    for (head, coef), found in zip(jpeg.decode(files), units, strict=True):
        assert (head["width"], head["height"], head["comment"]) == (width, height, b"made for a test")
        assert (coef == found).all()
        want = luminance(found[:, : wide * high], quants[0], cols, rows, wide, high)[: -(-height // 8), : -(-width // 8)]
        assert (jpeg.thumbnail(head, coef) == want).all()


def test_no_baseline():
    good = written(np.zeros((1, 1, 64), np.int64), [(1, 1, 1, 0)], 8, 8, {0: [1] * 64}, 0)
    assert jpeg.decode([good])[0][1].shape == (1, 1, 64)
    for bad in (b"no file", good.replace(b"\xff\xc0", b"\xff\xc2", 1)):
        with pytest.raises(ValueError, match="no start|not baseline"):
            jpeg.decode([bad])


def test_features_of_texts(spark, tmp_path):
    """Every column of the query, worked out from the payload without the operator's code for it."""
    texts = [None, "", "a", "é" * 300, "x" * 192, "word " * 5000, "a"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op7_media_columns"](spark, str(tmp_path)).collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in jpeg.media_columns(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        head = jpeg.parse(media[i])
        # a coefficient is its byte, or 255 less
        stored = jpeg.decode([media[i]])[0][1].reshape(-1)[: len(payload)].astype(np.int64)
        assert bytes(np.where(stored < 0, stored + 255, stored).tolist()) == payload
        assert (r["width"], r["height"]) == (head["width"], head["height"]) and r["feature"].startswith(f"{head['width']}x{head['height']}:")
    assert got[2]["feature"] == got[6]["feature"] and got[0]["media_sha256"] == got[1]["media_sha256"]
