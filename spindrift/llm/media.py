"""Operator 3, media columns: baseline JPEG in numpy.

`encode_media` stores a payload as the 8-bit samples of a grey baseline JPEG: a sample is the constant value of one
8x8 block, that is its DC coefficient, so nothing is lost. Each row of blocks is a restart interval, which lets a
reader decode all rows at once. `decode_luminance` reads any Huffman-coded baseline JPEG: it parses the markers,
decodes the scan's intervals side by side in numpy, skips AC coefficients and returns the DC-only luminance
thumbnail (one sample a block).

Defined results: a null or empty text is a payload of 192 spaces; payloads over `FRAME` bytes become several images
one after another, whose heights add up and whose thumbnails all go into the hash; repeated rows get equal values,
whatever their doc_id, which may be null; an empty table gives an empty result; other columns are ignored.
A task holds one group of texts of some `GROUP` bytes, or one longer text. The registered query writes the media column
and reads it back before it computes features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import text_groups
from .common import stored, table

UNIT = 192
#: Blocks a row of the image; a wider image is used where more than 8191 rows would be needed.
WIDE, MOST_ROWS = 192, 8191
FRAME = WIDE * 42 * MOST_ROWS
GROUP = 4 << 20
#: Fixed values of the format: code lengths and symbols of the usual luminance DC table.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
#: Only the end-of-block symbol is needed: one code of one bit.
AC_COUNTS, AC_SYMBOLS = bytes([1] + [0] * 15), bytes([0])


def huffman_codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical table."""
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def diff_table() -> tuple[np.ndarray, np.ndarray]:
    """For a difference of -255..255, at index 255 + difference: the bits of a DC-only block and their number."""
    dc, (end, end_len) = huffman_codes(DC_COUNTS, DC_SYMBOLS), huffman_codes(AC_COUNTS, AC_SYMBOLS)[0]
    bits, lens = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        amplitude = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255] = (((code << size) | amplitude) << end_len) | end
        lens[d + 255] = n + size + end_len
    return bits, lens


BITS, LENS = diff_table()


def scan_bytes(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row starts) of the entropy-coded rows, each ending on a byte, stuffed, and followed by a gap of two
    bytes for its restart marker. samples: uint8 (rows, blocks)."""
    rows = len(samples)
    values = samples.astype(np.int16) - 128
    index = np.diff(values, axis=1, prepend=np.zeros((rows, 1), np.int16)) + np.int16(255)
    lens = LENS[index]
    ends = np.cumsum(lens, axis=1)
    row_bytes = (ends[:, -1] + 7) // 8
    starts = np.cumsum(row_bytes) - row_bytes
    at = (starts[:, None] * 8 + ends - lens).ravel()
    lens, word = lens.ravel(), BITS[index.ravel()]
    total = int(row_bytes.sum())
    # A code of at most 16 bits touches three bytes; codes don't overlap, so sums are unions.
    word = word << (24 - lens - (at & 7)).astype(np.uint32)
    byte = at >> 3
    out = np.bincount(byte, word >> 16, total + 3)
    out[1:] += np.bincount(byte, (word >> 8) & 255, total + 2)
    out[2:] += np.bincount(byte, word & 255, total + 1)
    data = out[:total].astype(np.uint8)
    last = starts + row_bytes - 1
    data[last] |= ((1 << (-ends[:, -1] & 7)) - 1).astype(np.uint8)
    # Stuffing: a zero after each 0xFF; then two bytes a row for the marker.
    full = data == 255
    moved = np.arange(total) + np.cumsum(full) - full
    moved += 2 * np.repeat(np.arange(rows), row_bytes)
    size = total + int(full.sum()) + 2 * rows
    stuffed = np.zeros(size, np.uint8)
    stuffed[moved] = data
    begins = np.append(moved[starts], size)
    return stuffed, begins


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def jpeg_head(rows: int, blocks: int, length: int) -> bytes:
    table = lambda kind, counts, symbols: segment(0xC4, bytes([kind]) + counts + symbols)
    return b"".join([
        b"\xff\xd8", segment(0xFE, struct.pack(">Q", length)), segment(0xDB, bytes([0]) + bytes([8] * 64)),
        segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, blocks * 8, 1, 1, 0x11, 0)),
        table(0x00, DC_COUNTS, DC_SYMBOLS), table(0x10, AC_COUNTS, AC_SYMBOLS),
        segment(0xDD, struct.pack(">H", blocks)), segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def encode_images(payloads: list[bytes], blocks: int = WIDE) -> list[bytes]:
    """A JPEG for each payload; payloads of a multiple of UNIT bytes, the last row of blocks is filled up with spaces."""
    rows = [-(-len(p) // blocks) for p in payloads]
    filled = b"".join(p.ljust(r * blocks) for p, r in zip(payloads, rows, strict=True))
    data, begins = scan_bytes(np.frombuffer(filled, np.uint8).reshape(-1, blocks))
    first = np.cumsum([0, *rows])
    for i in range(len(payloads)):  # restart markers count from 0 to 7 within an image; the last row has none
        marks = begins[first[i] + 1 : first[i + 1] + 1] - 2
        data[marks], data[marks + 1] = 255, 0xD0 + np.arange(len(marks)) % 8
    out = []
    for i, p in enumerate(payloads):
        body = data[begins[first[i]] : begins[first[i + 1]] - 2]
        out.append(jpeg_head(rows[i], blocks, len(p)) + body.tobytes() + b"\xff\xd9")
    return out


def encode_payload(payload: bytes) -> bytes:
    """One payload of any length."""
    out = []
    for at in range(0, len(payload), FRAME):
        part = payload[at : at + FRAME]
        blocks = WIDE * -(-len(part) // (WIDE * MOST_ROWS))
        out += encode_images([part], blocks)
    return b"".join(out)


class Image:
    """The markers of one JPEG: size, components, tables, and the intervals of its scan."""

    def __init__(self, data: bytes, at: int):
        self.quant, self.tables, self.restart, self.length = {}, {}, 0, None
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        while True:
            marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4])
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide])  # of the DC coefficient
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    k = sum(body[1:17])
                    self.tables[body[0]] = (body[1:17], body[17 : 17 + k])
                    body = body[17 + k :]
            elif marker == 0xC0 or marker == 0xC1:
                self.height, self.width, count = int.from_bytes(body[1:3]), int.from_bytes(body[3:5]), body[5]
                self.parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)}
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body)
            elif marker == 0xFE and len(body) == 8:
                self.length = struct.unpack(">Q", body)[0]
            elif marker == 0xDA:
                self.order = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                break
        raw = np.frombuffer(data, np.uint8, offset=at)
        mark = np.flatnonzero((raw[:-1] == 255) & (raw[1:] != 0) & ((raw[1:] < 0xD0) | (raw[1:] > 0xD7)))
        stop = int(mark[0]) if len(mark) else len(raw)
        self.scan = raw[:stop]
        self.end = at + stop + 2
        h, v = max(p[0] for p in self.parts.values()), max(p[1] for p in self.parts.values())
        if len(self.order) == 1:
            h = v = 1
        self.across, self.down = -(-self.width // (8 * h)), -(-self.height // (8 * v))
        #: The blocks of a coded unit: (component, DC table, AC table, column, row).
        self.unit = [
            (c, dc, 16 + ac, x, y) for c, dc, ac in self.order
            for y in range(1 if len(self.order) == 1 else self.parts[c][1]) for x in range(1 if len(self.order) == 1 else self.parts[c][0])
        ]

    def intervals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes without stuffing and markers, start of each interval in them, units of each interval)."""
        raw, units = self.scan, self.across * self.down
        after = np.flatnonzero(raw[:-1] == 255) + 1
        marks = after[raw[after] != 0]
        gone = np.zeros(len(raw), bool)
        gone[after] = True
        gone[marks - 1] = True
        kept = raw[~gone]
        cuts = np.append(0, marks + 1)
        starts = cuts - np.append(0, np.cumsum(gone))[cuts]
        step = self.restart or units
        counts = np.full(-(-units // step), step)
        counts[-1] = units - step * (len(counts) - 1)
        if len(starts) < len(counts):
            raise ValueError("restart markers are missing")
        return kept, starts[: len(counts)], counts


def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: length and symbol of the code they begin with (length 0: none)."""
    lens, syms = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
    for symbol, (code, n) in huffman_codes(counts, symbols).items():
        lens[code << (16 - n) : (code + 1) << (16 - n)] = n
        syms[code << (16 - n) : (code + 1) << (16 - n)] = symbol
    return lens, syms


def decode_luminance(images: list[Image]) -> list[np.ndarray]:
    """The uint8 thumbnails (rows, columns of blocks) of images that share tables and layout; all their intervals are
    lanes that advance together by one symbol."""
    lead = images[0]
    buffers, starts, counts, owner, begin = [], [], [], [], 0
    for i, image in enumerate(images):
        kept, first, n = image.intervals()
        buffers.append(kept)
        starts.append(first + begin)
        counts.append(n)
        owner.append(np.full(len(n), i))
        begin += len(kept)
    stream = np.concatenate([*buffers, np.full(8, 255, np.uint8)]).astype(np.uint32)
    window = stream[:-3] << 24 | stream[1:-2] << 16 | stream[2:-1] << 8 | stream[3:]  # 32 bits from each byte on
    last = len(window) - 1
    at, count = np.concatenate(starts).astype(np.int64) * 8, np.concatenate(counts)
    luts = {k: lookup(*t) for k, t in lead.tables.items()}
    luma = lead.order[0][0]
    predicted = {c: np.zeros(len(at), np.int32) for c, _, _ in lead.order}
    per_unit = sum(u[0] == luma for u in lead.unit)
    most = int(count.max())
    values = np.zeros((most * per_unit, len(at)), np.int16)
    everyone = np.arange(len(at))

    def peek(p: np.ndarray) -> np.ndarray:
        return (window[np.minimum(p >> 3, last)] << (p & 7).astype(np.uint32)) >> np.uint32(16)

    def symbol(p: np.ndarray, lut) -> tuple[np.ndarray, np.ndarray]:
        bits = peek(p)
        length = lut[0][bits]
        if not length.all():
            raise ValueError("no such Huffman code")
        return p + length, lut[1][bits]

    uniform, k = bool((count == most).all()), 0
    for unit in range(most):
        live = everyone if uniform else np.flatnonzero(count > unit)
        for c, dc, ac, _, _ in lead.unit:
            p, size = symbol(at[live], luts[dc])
            size = size.astype(np.int32)
            raw = (peek(p) >> (16 - size).astype(np.uint32)).astype(np.int32)
            diff = np.where(raw < (1 << size >> 1), raw - (1 << size) + 1, raw)
            predicted[c][live] += np.where(size > 0, diff, 0)
            p += size
            index, todo = np.ones(len(live), np.int32), np.arange(len(live))
            while len(todo):  # AC symbols are read over until each lane's block ends
                q, s = symbol(p[todo], luts[ac])
                p[todo] = q + (s & 15)
                index[todo] = np.where(s == 0, 64, index[todo] + (s >> 4) + 1)
                todo = todo[index[todo] < 64]
            at[live] = p
            if c == luma:
                values[k, live] = predicted[c][live]
                k += 1
    quant = lead.quant[lead.parts[luma][2]]
    samples = np.clip((values.T.astype(np.int32) * quant + 4) // 8 + 128, 0, 255).astype(np.uint8)
    out, lane, owner = [], 0, np.concatenate(owner)
    lanes = np.bincount(owner, minlength=len(images))
    place = [(x, y) for c, _, _, x, y in lead.unit if c == luma]
    wide, high = max(x for x, _ in place) + 1, max(y for _, y in place) + 1
    for i, image in enumerate(images):
        units = samples[lane : lane + lanes[i]].reshape(-1, per_unit)[: image.across * image.down]
        lane += lanes[i]
        grid = units.reshape(image.down, image.across, high, wide).transpose(0, 2, 1, 3).reshape(image.down * high, image.across * wide)
        out.append(grid[: -(-image.height // 8), : -(-image.width // 8)])
    return out


def decode_all(media: list[bytes]) -> list[list[tuple[Image, np.ndarray]]]:
    """For each value, the images in it and their thumbnails; images with the same tables are decoded together."""
    found, groups = [], {}
    for k, data in enumerate(media):
        at, mine = 0, []
        while at < len(data):
            image = Image(data, at)
            at = image.end
            key = (tuple(sorted(image.tables.items())), tuple(image.unit), image.restart, tuple(sorted(image.quant.items())))
            groups.setdefault(key, []).append((k, len(mine), image))
            mine.append(image)
        found.append([(image, None) for image in mine])
    for members in groups.values():
        for (k, j, image), grid in zip(members, decode_luminance([m[2] for m in members]), strict=True):
            found[k][j] = (image, grid)
    return found


def thumbnail_hash(grid: np.ndarray) -> str:
    """64-bit difference hash of the thumbnail, reduced to 8 x 9 means."""
    rows = np.linspace(0, len(grid), 8, endpoint=False).astype(int)
    columns = np.linspace(0, grid.shape[1], 9, endpoint=False).astype(int)
    sums = np.add.reduceat(np.add.reduceat(grid.astype(np.int64), columns, axis=1), rows, axis=0)
    areas = np.maximum(1, np.diff(np.append(rows, len(grid))))[:, None] * np.maximum(1, np.diff(np.append(columns, grid.shape[1])))
    means = sums / areas
    return np.packbits(means[:, 1:] > means[:, :-1]).tobytes().hex()


def thumbnails_hash(grids: list[np.ndarray]) -> str:
    """The hash of an image; of several images that hold one payload a digest of all their hashes."""
    hashes = [thumbnail_hash(g) for g in grids]
    return hashes[0] if len(hashes) == 1 else hashlib.sha256("".join(hashes).encode()).hexdigest()[:16]


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("thumbnail_hash", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
    ("media_sha256", pa.string()), ("feature", pa.string()),
])


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text of docs as a JPEG column."""

    def encode(batches):
        for batch in batches:
            ids = batch.column(0)
            for a, b, raw in text_groups(batch.column(1), GROUP):
                padded = [t.ljust(max(1, -(-len(t) // UNIT)) * UNIT) for t in raw]
                small = [i for i, p in enumerate(padded) if len(p) <= WIDE * MOST_ROWS]
                media = dict(zip(small, encode_images([padded[i] for i in small]), strict=True)) if small else {}
                media |= {i: encode_payload(p) for i, p in enumerate(padded) if i not in media}
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(t) for t in raw], pa.int64()), pa.array([media[i] for i in range(len(raw))], pa.binary())],
                    schema=MEDIA,
                )

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """FEATURES of a media column: dimensions, thumbnail hash, and digests of the stored bytes and of the payload in them."""

    def features(batches):
        for batch in batches:
            ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, _, values in text_groups(batch.column(2), GROUP):
                rows = []
                for k, found in enumerate(decode_all(values)):
                    payload = b"".join(grid.tobytes()[: image.length] for image, grid in found)
                    width, height = max(image.width for image, _ in found), sum(image.height for image, _ in found)
                    dhash, tail = thumbnails_hash([grid for _, grid in found]), zlib.crc32(payload[-16:])
                    rows.append((
                        ids[a + k], lengths[a + k], width, height, dhash, len(payload), hashlib.sha256(payload).hexdigest(), tail,
                        len(values[k]), hashlib.sha256(values[k]).hexdigest(), f"{width}x{height}:{dhash}",
                    ))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FEATURES, strict=True)], schema=FEATURES)

    kinds = {"int64": "long", "string": "string"}
    return media.select("doc_id", "n_bytes", "media").mapInArrow(features, ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in FEATURES))


def op3_media(spark, sf_dir) -> DataFrame:
    media = stored(encode_media(table(spark, sf_dir, "documents")), "media", compression="zstd")
    features = media_features(media)
    return features.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
