"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames, histograms.

``encode_gif`` stores any byte payload losslessly as the 8-bit samples of GIF frames; ``read_gif``
decodes any GIF87a/89a stream (local palettes, interlace, transparency, all disposal rules,
deferred clear codes). ``media_columns`` applies both to a text column, reading the payload back
from the stored bytes.

Defined cases: a null text counts as empty, an empty text stores 64 zero bytes, repeated rows and
equal texts give equal values, a text of any length is stored whole, in as many frames as it takes,
an empty table gives an empty result; only the two named input
columns are read, so extra columns cannot clash. A damaged stream raises ValueError.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

WIDTH = 64
ROWS_PER_FRAME = 1024
DELAY_CS = 4
FULL = 4096  # LZW codes have 12 bits at most


# --- LZW -----------------------------------------------------------------------------------


def _widths(count: int, base: int, first: int = 1) -> np.ndarray:
    """Bits of codes number ``first``.. after a clear; ``base`` is the first free code."""
    size = base + np.maximum(np.arange(first, first + count) - 2, 0)
    lowest = (base - 2).bit_length()
    return np.minimum(12, np.maximum(lowest, np.floor(np.log2(size)).astype(np.int64) + 1))


_OWN_WIDTHS = _widths(FULL, 258)
_FIRST = np.zeros(1 << 16, np.int64)
SEGMENT = 3584  # samples between clears: even if no pair repeats, the table can't fill


def lzw_encode(data: bytes) -> bytes:
    """A GIF LZW stream of 8-bit samples, an even number of them.

    Any parse into known entries is a valid stream. This one takes samples in aligned pairs, so
    numpy can lay out a whole segment: a pair's first occurrence is sent as two roots, which makes
    the decoder enter it, and its later ones as that entry's code. A clear starts each segment
    before its table can fill."""
    pairs, table, codes = np.frombuffer(data, "<u2"), _FIRST, []
    for at in range(0, len(pairs), SEGMENT // 2):
        pair = pairs[at : at + SEGMENT // 2]
        place = np.arange(len(pair))
        table[pair[::-1]] = place[::-1]
        first = table[pair]
        new = first == place
        ends = np.cumsum(new + 1)
        step = ends - new - 1
        own = np.empty(int(ends[-1]) + 1, np.uint64)
        own[0] = 256
        own[1:][step] = np.where(new, pair & 255, 258 + step[first])
        own[1:][step[new] + 1] = pair[new] >> 8
        codes.append(own)
    codes.append(np.array([257], np.uint64))
    return _pack(np.concatenate(codes))


def _pack(codes: np.ndarray) -> bytes:
    """Codes to bits, lowest first; a code's width follows from its place after the last clear."""
    place = np.arange(len(codes))
    last_clear = np.maximum.accumulate(np.where(codes == 256, place, 0))
    last_clear = np.concatenate([[0], last_clear[:-1]])
    width = np.where(place == 0, 9, _OWN_WIDTHS[np.maximum(place - last_clear, 1) - 1])
    end = np.cumsum(width)
    at = end - width
    word, shift = at >> 5, (at & 31).astype(np.uint64)
    shifted = codes << shift
    starts = np.flatnonzero(np.diff(word, prepend=-1))  # a code begins in every 32-bit word
    words = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
    words[word[starts]] = np.add.reduceat(shifted, starts)
    words[1:] += words[:-1] >> np.uint64(32)
    return words.astype(np.uint32).astype("<u4").tobytes()[: (int(end[-1]) + 7) // 8]


def lzw_decode(stream: bytes, bits: int, expected: int) -> bytes:
    """Samples of an LZW stream with ``bits``-bit samples; stops at its end code or ``expected``."""
    clear, base = 1 << bits, (1 << bits) + 2
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    schedule = _OWN_WIDTHS if bits == 8 else _widths(FULL, base)
    out, segment, made = [], [], 0
    at, number, total, ended = 0, 1, 8 * len(stream), False

    while not ended and made < expected:
        width = schedule[number - 1 :] if number < FULL - 63 else np.full(FULL, 12)
        ends = at + np.cumsum(width)
        if int(ends[-1]) > total:
            ends = ends[: int(np.searchsorted(ends, total, side="right"))]
            width = width[: len(ends)]
        begin = ends - width
        byte = begin >> 3
        window = raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)
        codes = (window >> (begin & 7).astype(np.uint32)).astype(np.int64) & ((1 << width) - 1)
        special = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(special[0]) if len(special) else len(codes)
        segment.append(codes[:stop])
        if len(special):
            ended = int(codes[stop]) == clear + 1
            at, number = int(ends[stop]), 1
        elif not len(codes):
            ended = True
        else:
            at, number = int(ends[-1]), number + stop
            continue
        out.append(_expanded(np.concatenate(segment), clear))
        made, segment = made + len(out[-1]), []
    return b"".join(out)[:expected]


def _expanded(codes: np.ndarray, clear: int) -> bytes:
    """Samples of the codes between two clears.

    Entry number j is code j's string and the first sample of code j + 1, so a code that names it
    links to code j, one sample shorter, down to a root; links are followed for all codes at once."""
    if not len(codes):
        return b""
    place = np.arange(len(codes))
    link = codes - (clear + 2)
    linked = link >= 0
    if linked[0] or (link >= np.minimum(place, FULL - clear - 2)).any():
        raise ValueError("damaged LZW stream: code before its entry")
    root, length = np.where(linked, link, place), linked.astype(np.int64) + 1
    while not np.array_equal(up := root[root], root):
        length += length[root] - 1
        root = up
    first = codes[root]
    last = np.where(linked, first[np.clip(link + 1, 0, len(codes) - 1)], codes).astype(np.uint8)
    link = np.where(linked, link, 0)
    end = np.cumsum(length)
    out = np.empty(int(end[-1]), np.uint8)
    now, at, left = place, end - 1, length
    while len(now):
        out[at] = last[now]
        more = np.flatnonzero(left > 1)
        now, at, left = link[now[more]], at[more] - 1, left[more] - 1
    return out.tobytes()


# --- container -----------------------------------------------------------------------------


def sample_palette() -> np.ndarray:
    """The colour of each sample value, by rule: 3, 3 and 2 bits spread over red, green, blue."""
    v = np.arange(256)
    return np.stack([(v >> 5) * 255 // 7, (v >> 2 & 7) * 255 // 7, (v & 3) * 85], 1).astype(np.uint8)


def _blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    body = np.empty((whole, 256), np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS_PER_FRAME, delay: int = DELAY_CS) -> bytes:
    """A GIF89a whose frames' samples are ``payload``, a positive multiple of ``width`` bytes."""
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    step = width * rows
    height = min(len(payload) // width, rows)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), sample_palette().tobytes()]
    for at in range(0, len(payload), step):
        part = payload[at : at + step]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0))
        out.append(b"\x08" + _blocks(lzw_encode(part)))
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    start_cs: int
    delay_cs: int
    disposal: int
    transparent: int | None
    samples: bytes
    palette: np.ndarray


@dataclass
class Gif:
    width: int
    height: int
    background: int
    frames: list[Frame]

    def samples(self) -> bytes:
        return b"".join(f.samples for f in self.frames)


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _interlaced(height: int) -> list[int]:
    return [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)]


def read_gif(data: bytes) -> Gif:
    """Every frame of a GIF, its samples in display order, with timing and drawing rules."""
    try:
        return _read_gif(data)
    except (IndexError, struct.error) as error:
        raise ValueError("damaged GIF: it ends early") from error


def _read_gif(data: bytes) -> Gif:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def colours(flags: int, at: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n

    common = np.zeros((2, 3), np.uint8)
    if flags & 0x80:
        common, at = colours(flags, at)
    gif, clock = Gif(width, height, background, []), 0
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("damaged GIF: unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if packed & 0x80:
            palette, at = colours(packed, at)
        bits = data[at]
        stream, at = _sub_blocks(data, at + 1)
        samples = lzw_decode(stream, bits, w * h).ljust(w * h, b"\0")
        if packed & 0x40:
            rows = np.empty((h, w), np.uint8)
            rows[_interlaced(h)] = np.frombuffer(samples, np.uint8).reshape(h, w)
            samples = rows.tobytes()
        gif.frames.append(Frame(left, top, w, h, clock, delay, disposal, transparent, samples, palette))
        clock += delay
        delay, disposal, transparent = 0, 0, None
    return gif


def rendered(gif: Gif):
    """Yield the canvas (height, width, RGBA) as each frame shows it, by the disposal rules."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        ys = slice(f.top, min(f.top + f.height, gif.height))
        xs = slice(f.left, min(f.left + f.width, gif.width))
        index = np.frombuffer(f.samples, np.uint8).reshape(f.height, f.width)
        index = index[: max(0, gif.height - f.top), : max(0, gif.width - f.left)]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3], colours[: len(f.palette), 3] = f.palette, 255
        if f.transparent is None:
            canvas[ys, xs] = colours[index]
        else:
            seen = index != f.transparent
            canvas[ys, xs][seen] = colours[index[seen]]
        yield canvas
        if f.disposal == 2:
            canvas[ys, xs] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(canvas: np.ndarray) -> list[int]:
    """Opaque pixels by 2 bits each of red, green and blue: 64 counts."""
    pixels = canvas.reshape(-1, 4)
    bins = (pixels[:, 0] >> 6).astype(np.intp) << 4 | (pixels[:, 1] >> 6) << 2 | pixels[:, 2] >> 6
    return np.bincount(bins[pixels[:, 3] > 0], minlength=64).tolist()


# --- the operator --------------------------------------------------------------------------

_FRAME = pa.struct([("start_cs", pa.int64()), ("delay_cs", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("histogram", pa.list_(pa.int64()))])


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a text: ``media`` (the GIF), ``payload`` read back from it, ``frames`` with times
    and colour histograms, and ``n_bytes`` of the text before padding. Map only, no shuffle."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            ids, n_bytes, media, payload, frames = batch.column(0), [], [], [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                n_bytes.append(len(raw))
                stored = encode_gif(raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0"))
                gif = read_gif(stored)
                media.append(stored)
                payload.append(gif.samples())
                frames.append([{"start_cs": f.start_cs, "delay_cs": f.delay_cs, "width": f.width, "height": f.height, "histogram": histogram(c)} for f, c in zip(gif.frames, rendered(gif), strict=True)])
            return {"id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "media": pa.array(media, pa.binary()), "payload": pa.array(payload, pa.binary()), "frames": pa.array(frames, pa.list_(_FRAME))}

        return step

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, media binary, payload binary, frames array<struct<start_cs:bigint,delay_cs:bigint,width:bigint,height:bigint,histogram:array<bigint>>>"
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_slices(picked, "text", make, schema).withColumnRenamed("id", id_col)


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digest columns of ``media_columns``: sizes, hashes and a feature string of the frames'
    count, duration and summed colour histogram."""
    total = F.aggregate("frames", F.array_repeat(F.lit(0).cast("bigint"), 64), lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    duration = F.aggregate("frames", F.lit(0).cast("bigint"), lambda a, f: a + f["delay_cs"])
    return media_columns(df, id_col, text_col).select(
        id_col,
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("frames="), F.size("frames")), F.concat(F.lit("cs="), duration), F.concat(F.lit("hist="), F.array_join(total, ","))).alias("feature"),
    )
