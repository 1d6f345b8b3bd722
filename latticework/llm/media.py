"""Media columns: progressive JPEG, decoded in numpy.

`decode` accumulates the spectral-selection and successive-approximation scans
of a progressive file into coefficient arrays, inverse-transforms them, upsamples
chroma and returns the full-resolution RGB tensor. `encode` writes a byte payload
losslessly as coefficients (the format's unit): a byte b is the coefficient 256 + b
of the next place in zigzag order, places 1 to 63 of each block, in a 4:2:0 image.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, large

UNIT = 576
#: Bytes of texts, or of media, that are coded in one step.
STEP_BYTES = 2 << 20
AC = 63
BLOCKS_PER_MCU = 6
#: Spectral bands of the AC scans.
BANDS = ((1, 5), (6, 63))
#: Huffman tables of the encoder as (codes per length 1..16, symbols): DC, AC first pass, AC refinement.
DC_TABLE = ((1,), (0,))
FIRST_TABLE = ((1, 1), (8, 0))
REFINE_TABLE = ((0, 0, 0, 15), tuple(n << 4 for n in range(15)))


@cache
def zigzag() -> np.ndarray:
    """Natural place of each zigzag place: antidiagonals, turning at each end."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


@cache
def basis() -> np.ndarray:
    """Rows: coefficients in zigzag order; columns: the 64 samples of a block."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.einsum("ux,vy->uvxy", one, one).reshape(64, 64)[zigzag()].astype(np.float32)


def codes_of(table) -> dict[tuple[int, int], int]:
    """{(length, code): symbol} by the canonical rule."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[length, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def stuffed(bits: np.ndarray) -> bytes:
    """Bits, padded by ones, as entropy-coded bytes with a zero after each 255."""
    data = np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8)))).tobytes()
    return data.replace(b"\xff", b"\xff\x00")


def number_bits(value: int, n: int) -> list[int]:
    return [value >> k & 1 for k in range(n - 1, -1, -1)]


def shape_for(blocks: int) -> tuple[int, int]:
    """MCU columns and rows that hold so many blocks, about a square."""
    mcus = -(-blocks // BLOCKS_PER_MCU)
    wide = min(4095, max(1, int(np.ceil(np.sqrt(mcus)))))
    return wide, -(-mcus // wide)


@cache
def tables() -> bytes:
    out = segment(0xDB, b"\0" + bytes([1] * 64))
    for kind, table in ((0x00, DC_TABLE), (0x10, FIRST_TABLE), (0x11, REFINE_TABLE)):
        out += segment(0xC4, bytes([kind, *table[0], *[0] * (16 - len(table[0])), *table[1]]))
    return out


@cache
def scan_head(components: tuple[int, ...], ac: int, start: int, end: int, high: int, low: int) -> bytes:
    return segment(0xDA, bytes([len(components), *[x for c in components for x in (c, ac)], start, end, high << 4 | low]))


def refinement(blocks: np.ndarray) -> np.ndarray:
    """Bits of a refinement scan in which no coefficient is new: runs of whole blocks with their correction bits."""
    out, at, n = [], 0, len(blocks)
    while at < n:
        run = min(n - at, 32767)
        power = run.bit_length() - 1
        out += [np.array(number_bits(power, 4) + number_bits(run - (1 << power), power), np.uint8), (blocks[at : at + run] & 1).astype(np.uint8).ravel()]
        at += run
    return np.concatenate(out)


def encode(payload: np.ndarray) -> bytes:
    """A progressive JPEG that holds the payload; its length stands in a comment."""
    wide, high = shape_for(-(-len(payload) // AC))
    mcus = wide * high
    values = np.zeros(mcus * BLOCKS_PER_MCU * AC, np.uint16)
    values[: len(payload)] = payload
    values += 256
    values = values.reshape(-1, AC)
    head = b"\xff\xd8" + segment(0xFE, b"payload %d" % len(payload)) + tables()
    head += segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    out = [head, scan_head((1, 2, 3), 0, 0, 0, 0, 0), stuffed(np.zeros(mcus * BLOCKS_PER_MCU, np.uint8))]
    parts = {1: values[: 4 * mcus], 2: values[4 * mcus : 5 * mcus], 3: values[5 * mcus :]}
    for start, end in BANDS:
        for c, blocks in parts.items():
            own = blocks[:, start - 1 : end]
            # Each coefficient: symbol 0x08 by its code 0, then 8 bits.
            bits = np.zeros((own.size, 9), np.uint8)
            bits[:, 1:] = np.unpackbits((own >> 1).astype(np.uint8).reshape(-1, 1), axis=1)
            out += [scan_head((c,), 0, start, end, 0, 1), stuffed(bits.ravel())]
    for start, end in BANDS:
        for c, blocks in parts.items():
            out += [scan_head((c,), 1, start, end, 1, 0), stuffed(refinement(blocks[:, start - 1 : end]))]
    return b"".join(out) + b"\xff\xd9"


class Bits:
    """Entropy-coded bits of one scan, read one by one or in runs."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)
        self.bits, self.at = np.unpackbits(raw), 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.bits[self.at]) if self.at < len(self.bits) else code << 1 | 1
            self.at += 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


@dataclass
class Image:
    """Coefficients of each component, (blocks, 64) in zigzag order, and what the headers say."""

    width: int = 0
    height: int = 0
    sampling: dict[int, tuple[int, int]] = field(default_factory=dict)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    use: dict[int, int] = field(default_factory=dict)
    coefficients: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""

    def grid(self, c: int) -> tuple[int, int, int, int]:
        """Block columns and rows of a component: stored, and in scans of its own."""
        h, v = self.sampling[c]
        top_h, top_v = (max(s[k] for s in self.sampling.values()) for k in (0, 1))
        across, down = -(-self.width // (8 * top_h)), -(-self.height // (8 * top_v))
        return across * h, down * v, -(-self.width * h // (8 * top_h)), -(-self.height * v // (8 * top_v))


class Damaged(ValueError):
    """A file that cannot be read: not a JPEG, another kind of JPEG, or one that breaks off."""


def read(data: bytes) -> Image:
    """Parse a progressive file and accumulate all its scans. Raises Damaged where that fails."""
    try:
        return parse(data)
    except Damaged:
        raise
    except (IndexError, KeyError, ValueError, struct.error) as e:
        raise Damaged(f"broken file: {type(e).__name__}") from e


def segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded data from `at` on, cut at restart markers, and where it ends."""
    out, start = [], at
    while True:
        stop = data.index(b"\xff", at)
        after = stop + 1
        while data[after] == 0xFF:  # fill bytes
            after += 1
        if data[after] == 0:
            at = after + 1
        elif 0xD0 <= data[after] <= 0xD7:
            out.append(data[start:stop])
            start = at = after + 1
        else:
            return [*out, data[start:stop]], stop


def parse(data: bytes) -> Image:
    image, huffman, at, interval = Image(), {}, 2, 0
    if data[:2] != b"\xff\xd8":
        raise Damaged("not a JPEG")
    while True:
        if data[at] != 0xFF:
            raise Damaged("no marker where one must be")
        while data[at + 1] == 0xFF:  # fill bytes
            at += 1
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0] if data[at + 1] != 0xD9 else 0
        if marker == 0xD9:
            if not image.coefficients:
                raise Damaged("no image")
            return image
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                huffman[body[0]] = codes_of((counts, body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xC2:
            _, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            for k in range(n):
                c, hv, q = body[6 + 3 * k : 9 + 3 * k]
                image.sampling[c], image.use[c] = (hv >> 4, hv & 15), q
            for c in image.sampling:
                across, down, _, _ = image.grid(c)
                image.coefficients[c] = np.zeros((across * down, 64), np.int32)
        elif marker == 0xDA:
            n = body[0]
            chosen = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(n)]
            start, end, hl = body[1 + 2 * n : 4 + 2 * n]
            parts, at = segments(data, at)
            for k, part in enumerate(parts):
                scan(image, huffman, chosen, start, end, hl >> 4, hl & 15, Bits(part), (k * interval, (k + 1) * interval) if interval else None)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Damaged("only progressive Huffman files are read")


def scan(image: Image, huffman: dict, chosen: list, start: int, end: int, high: int, low: int, bits: Bits, span: tuple[int, int] | None = None) -> None:
    """Accumulate a scan, or its MCUs span[0] .. span[1] - 1 between two restarts."""
    if start == 0:
        return dc_scan(image, huffman, chosen, high, low, bits, span)
    c, table = chosen[0]
    across, _, own_across, own_down = image.grid(c)
    order = (np.arange(own_down)[:, None] * across + np.arange(own_across)).ravel()
    order = order[slice(*span)] if span else order
    codes, stored = huffman[0x10 | table & 15], image.coefficients[c]
    if high:
        return ac_refine(stored, order, codes, start, end, low, bits)
    done = first_run(stored, order, codes, start, end, low, bits)
    skip = 0
    for b in order[done:].tolist():
        if skip:
            skip -= 1
            continue
        k = start
        while k <= end:
            s = bits.symbol(codes)
            run, n = s >> 4, s & 15
            if n:
                k += run
                stored[b, k] = bits.signed(n) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) - 1 + bits.take(run)
                break


def first_run(stored: np.ndarray, order: np.ndarray, codes: dict, start: int, end: int, low: int, bits: Bits) -> int:
    """Blocks at the scan's beginning whose coefficients all come by one code without a
    run: they stand at equal distances in the bits and are read at once."""
    for (length, code), s in codes.items():
        n = s & 15
        here = bits.bits[bits.at : bits.at + length]
        if s >> 4 or not n or len(here) < length or int("".join(map(str, here.tolist())), 2) != code:
            continue
        stride, band = length + n, end - start + 1
        rows = bits.bits[bits.at : bits.at + len(order) * band * stride]
        rows = rows[: len(rows) // stride * stride].reshape(-1, stride)
        same = (rows[:, :length] == np.array(number_bits(code, length), np.uint8)).all(axis=1)
        blocks = (len(same) if same.all() else int(np.argmin(same))) // band
        wide = np.zeros((blocks * band, 16), np.uint8)
        wide[:, 16 - n :] = rows[: blocks * band, length:]
        v = np.packbits(wide, axis=1).view(">u2")[:, 0].astype(np.int32)
        v = np.where(v >> (n - 1) & 1, v, v - (1 << n) + 1) << low
        stored[order[:blocks], start : end + 1] = v.reshape(-1, band)
        bits.at += blocks * band * stride
        return blocks
    return 0


def ac_refine(stored: np.ndarray, order: np.ndarray, codes: dict, start: int, end: int, low: int, bits: Bits) -> None:
    bit, at = 1 << low, 0
    while at < len(order):
        k, skip = start, 0
        row = stored[order[at]]
        while k <= end:
            s = bits.symbol(codes)
            run, n = s >> 4, s & 15
            new = 0
            if n:
                new = bit if bits.take(1) else -bit
            elif run < 15:
                skip = (1 << run) + bits.take(run)
                break
            while k <= end:
                if row[k]:
                    if bits.take(1) and not abs(row[k]) & bit:
                        row[k] += bit if row[k] > 0 else -bit
                elif run == 0:
                    row[k] = new
                    k += 1
                    break
                else:
                    run -= 1
                k += 1
        if not skip:
            at += 1
            continue
        # A run of blocks without new coefficients: one correction bit for each that is not zero.
        first = row[k : end + 1]
        places = np.flatnonzero(first)
        first[places] += correction(first[places], bits, bit)
        rest = order[at + 1 : at + skip]
        part = stored[rest, start : end + 1]
        there = part != 0
        part[there] += correction(part[there], bits, bit)
        stored[rest, start : end + 1] = part
        at += skip


def correction(values: np.ndarray, bits: Bits, bit: int) -> np.ndarray:
    own = bits.bits[bits.at : bits.at + len(values)].astype(np.int32)
    bits.at += len(values)
    return np.sign(values) * np.where(np.abs(values) & bit, 0, own * bit)


def dc_scan(image: Image, huffman: dict, chosen: list, high: int, low: int, bits: Bits, span: tuple[int, int] | None = None) -> None:
    mcus = []
    if len(chosen) == 1:
        c, table = chosen[0]
        across, _, own_across, own_down = image.grid(c)
        mcus = [[(c, table, y * across + x)] for y in range(own_down) for x in range(own_across)]
    elif high == 0 and span is None and plain_zero(huffman, chosen, bits, sum(len(image.coefficients[c]) for c, _ in chosen)):
        return
    else:
        c0 = chosen[0][0]
        across, down = image.grid(c0)[0] // image.sampling[c0][0], image.grid(c0)[1] // image.sampling[c0][1]
        for my in range(down):
            for mx in range(across):
                own = []
                for c, table in chosen:
                    h, v = image.sampling[c]
                    own += [(c, table, (my * v + y) * across * h + mx * h + x) for y in range(v) for x in range(h)]
                mcus.append(own)
    last = dict.fromkeys(image.sampling, 0)
    for c, table, b in (place for own in (mcus[slice(*span)] if span else mcus) for place in own):
        if high:
            image.coefficients[c][b, 0] |= bits.take(1) << low
        else:
            last[c] += bits.signed(bits.symbol(huffman[table >> 4]))
            image.coefficients[c][b, 0] = last[c] * (1 << low)


def plain_zero(huffman: dict, chosen: list, bits: Bits, blocks: int) -> bool:
    """Whether every difference of an interleaved scan is the one-bit code of zero, so that nothing changes."""
    return all(huffman[t >> 4].get((1, 0)) == 0 for _, t in chosen) and not bits.bits[:blocks].any()


def samples(image: Image, c: int) -> np.ndarray:
    """The component's samples, blocks put in place."""
    across, down, _, _ = image.grid(c)
    # One product per text, so that equal texts give equal samples whatever they come with.
    flat = (image.coefficients[c] * image.quant[image.use[c]]).astype(np.float32) @ basis()
    flat = np.clip(np.rint(flat + np.float32(128)), 0, 255).astype(np.uint8)
    return flat.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(8 * down, 8 * across)


def rgb(image: Image) -> np.ndarray:
    """(height, width, 3) bytes; chroma is repeated to full resolution."""
    top_h, top_v = (max(s[k] for s in image.sampling.values()) for k in (0, 1))
    planes = []
    for c, (h, v) in image.sampling.items():
        plane = samples(image, c)
        if (h, v) != (top_h, top_v):
            plane = plane.repeat(top_v // v, axis=0).repeat(top_h // h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.stack(planes * 3, axis=-1)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    y += 1 << 15
    out = np.empty((*planes[0].shape, 3), np.uint8)
    # Factors 1.402, 0.344136, 0.714136 and 1.772 in 16-bit fixed point.
    for k, plane in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        out[..., k] = np.clip(plane >> 16, 0, 255)
    return out


def payload_of(image: Image) -> bytes | None:
    """The bytes that `encode` took, from the coefficients; None for a file that it did not write."""
    words = image.comment.split()
    if len(words) != 2 or words[0] != b"payload" or not words[1].isdigit():
        return None
    values = np.concatenate([image.coefficients[c][:, 1:] for c in image.sampling])
    return (values.ravel()[: int(words[1])] - 256).astype(np.uint8).tobytes()


def padded(text: bytes) -> np.ndarray:
    """A text's bytes, then 255 up to a positive multiple of UNIT."""
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    out = np.full(size, 255, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def store_texts(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text, of any length, as a progressive JPEG. Null counts as
    empty. Repeated rows and null ids stay; an empty table gives no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = large(batch.column("text"))
            for a, b in chunks(texts, STEP_BYTES):
                own = [x.as_buffer().to_pybytes() for x in texts.slice(a, b - a)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([len(t) for t in own], pa.int64()), pa.array([encode(padded(t)) for t in own], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def load_media(stored: DataFrame, tensors: bool = False) -> DataFrame:
    """Decode the `media` column of any progressive JPEGs: (doc_id, n_bytes, payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature, status[, height, width, rgb]), one row per input row.

    feature is the image's size, the mean of each colour and the crc32 of the RGB tensor. status is 'ok',
    'null' for a null, or says what is wrong with a file that cannot be decoded (truncated, another kind);
    then, and for media without a payload of `store_texts`, the figures that are missing are null.
    Repeated rows and null ids stay; an empty table gives no rows; other columns are ignored. One image
    and its tensor are decoded at a time, and batches of them are bounded by the size of the media.
    """
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "status": pa.string()}
    if tensors:
        kinds |= {"height": pa.int32(), "width": pa.int32(), "rgb": pa.binary()}

    def decoded(media: bytes | None) -> dict:
        if media is None:
            return {"status": "null"}
        out = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "status": "ok"}
        try:
            image = read(media)
            tensor = rgb(image)
        except Damaged as e:
            return out | {"status": str(e)}
        means = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64) / max(1, tensor.size // 3)
        out["feature"] = f"{image.height}x{image.width}:{':'.join(f'{m:.4f}' for m in means)}:{zlib.crc32(tensor.tobytes()):08x}"
        if (payload := payload_of(image)) is not None:
            out |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:])}
        return out | ({"height": image.height, "width": image.width, "rgb": tensor.tobytes()} if tensors else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in chunks(batch.column("media").cast(pa.large_binary()), STEP_BYTES):
                own = batch.slice(a, b - a)
                rows = [decoded(x.as_py()) for x in own.column("media")]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("n_bytes"), *[pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()]], names=["doc_id", "n_bytes", *kinds])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, status string" + ", height int, width int, rgb binary" * tensors
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
