"""Media columns: GIF89a images written and read in Spark tasks, with timed frames and colour histograms.

``encode_gifs`` stores a byte string per row as 8-bit samples of a GIF; ``decode_gifs`` reads any GIF column:
it decodes the LZW code streams, applies palettes, transparency and disposal, and gives an array of timed
frames: palette indices and palette as stored, the RGBA picture of the whole screen as shown, and histograms of the
drawn pixels by brightness and of the shown picture by colour. Both are row-wise Arrow jobs: no shuffle, memory bounded by a batch.

Defined cases: null or empty content of ``decode_gifs`` has no frames; malformed content has a null frame
array; null text is the empty text; repeated rows are stored and read alike, and rows without doc_id as others; a text of
any length is one file of as many frames as it fills; an empty table gives no rows; of the input only doc_id and text are
read, so clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
WIDTH = 64
FRAME_ROWS = 1024
DELAY_MS = 100
HISTOGRAM_BINS = 16
COLOR_BITS = 2  # of each of red, green and blue in the bins of a colour histogram
MAX_CODES = 4096
PLACES = np.arange(16)
MASKS = (1 << np.arange(13, dtype=np.uint32)) - 1  # by width

FRAME = "array<struct<frame_no:int,start_ms:long,delay_ms:int,left:int,top:int,width:int,height:int,disposal:int,transparent:int,indices:binary,histogram:array<long>,palette:binary,screen_width:int,screen_height:int,canvas:binary,colors:array<long>>>"


# --- LZW ---------------------------------------------------------------------------------------


PHRASES = [0] * (MAX_CODES << 8)  # a worker's table of known phrases by (code, next sample), all 0 between calls


def lzw_codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their widths for 8-bit samples: a clear code first, an end code last."""
    table, keys, cleared = PHRASES, [], []
    put, n, full, dirty = keys.append, 258 << 8, MAX_CODES << 8, 0
    samples = iter(data)
    cur = next(samples, -1) << 8  # a code, shifted to make room for a sample
    for b in samples:
        key = cur | b
        if found := table[key]:
            cur = found
            continue
        put(key)
        if n < full:
            table[key] = n
            n += 256
        else:
            for k in keys[dirty:]:
                table[k] = 0
            put(256 << 8)
            dirty = len(keys)
            cleared.append(dirty + 1)
            n = 258 << 8
        cur = b << 8
    for k in keys[dirty:]:
        table[k] = 0
    out = np.empty(len(keys) + 2 + (cur >= 0), dtype=np.uint32)
    out[0], out[-1] = 256, 257
    out[1 : len(keys) + 1] = np.array(keys, dtype=np.uint32) >> 8
    if cur >= 0:
        out[-2] = cur >> 8
    widths = np.empty(len(out), dtype=np.int64)
    widths[0] = 9
    for start, stop in zip([1, *cleared], [*cleared, len(out)], strict=True):
        widths[start:stop] = width_schedule(stop - start)
    return out, widths


@lru_cache(maxsize=16)
def full_schedule(bits: int, count: int) -> np.ndarray:
    size = (1 << bits) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.clip(np.ceil(np.log2(size + 1)).astype(np.int64), bits + 1, 12)


def width_schedule(count: int, bits: int = 8) -> np.ndarray:
    """Widths of the first ``count`` codes after a clear code: the k-th one is read with k-1 phrases known (k from 0)."""
    return full_schedule(bits, max(8192, 1 << max(count - 1, 0).bit_length()))[:count]


def pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Least significant bit first."""
    bits = np.unpackbits(codes.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[PLACES < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, expected: int) -> bytes:
    """The samples of a code stream. Widths depend on the count of codes since a clear code alone, so the codes
    of a whole run are cut out of the bits at once, up to the next clear or end code."""
    clear, end = 1 << bits, (1 << bits) + 1
    padded_ = np.frombuffer(stream + bytes(3), dtype=np.uint8).astype(np.uint32)
    words, n_bits = padded_[:-2] | padded_[1:-1] << 8 | padded_[2:] << 16, 8 * len(stream)  # 24 bits from each byte on
    at, out, size = 0, [], 0
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    while at + bits + 1 <= n_bits and size < expected:
        ahead = 4096 + 512
        while True:
            widths = width_schedule(min(ahead, (n_bits - at) // (bits + 1)), bits)
            ends = at + np.cumsum(widths)
            keep = int(np.searchsorted(ends, n_bits, side="right"))
            widths, ends = widths[:keep], ends[:keep]
            starts = ends - widths
            codes = words[starts >> 3] >> (starts & 7).astype(np.uint32) & MASKS[widths]
            stops = np.flatnonzero((codes == clear) | (codes == end))
            if len(stops) or ends[-1] + 13 > n_bits or keep < ahead:
                break
            ahead *= 2  # an encoder may go on with a full table
        stop = int(stops[0]) if len(stops) else keep
        found = codes[:stop].tolist()
        if found:
            # each code but the first adds a phrase: the last one and the first sample of its own
            table, last, known = singles.copy(), singles[found[0]], len(singles)
            add = table.append
            for code in found[1 : MAX_CODES - known + 1]:
                if code < known:
                    phrase = table[code]
                    add(last + phrase[:1])
                elif code == known:
                    phrase = last + last[:1]
                    add(phrase)
                else:
                    raise ValueError("bad code stream")
                last = phrase
                known += 1
            phrases = [table[code] for code in found]
            out += phrases
            size += sum(map(len, phrases))
        if not len(stops) or codes[stop] == end:
            break
        at = int(ends[stop])
    return b"".join(out)[:expected]


# --- container ---------------------------------------------------------------------------------

GREY = bytes(v for i in range(256) for v in (i, i, i))


def sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def write_gif(samples: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay_ms: int = DELAY_MS) -> bytes:
    """A GIF89a file of frames of at most ``rows`` lines of ``width`` samples (a multiple of ``width`` in all).

    The palette is grey, so a sample is its own colour; no index is transparent; frames are left in place.
    """
    per_frame = width * rows
    height = min(rows, len(samples) // width)
    parts = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", GREY]
    for at in range(0, len(samples), per_frame):
        frame = samples[at : at + per_frame]
        parts += [b"!\xf9\x04\x04", (delay_ms // 10).to_bytes(2, "little"), b"\0\0", b",\0\0\0\0", width.to_bytes(2, "little")]
        parts += [(len(frame) // width).to_bytes(2, "little"), b"\0\x08", sub_blocks(pack_codes(*lzw_codes(frame)))]
    return b"".join([*parts, b";"])


def interlaced(height: int) -> list[int]:
    return [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]


def color_histogram(canvas: np.ndarray) -> list[int]:
    """Opaque pixels of an RGBA picture by the upper bits of red, green and blue."""
    r, g, b = (canvas[..., k] >> (8 - COLOR_BITS) for k in range(3))
    bins, opaque = (r << 2 * COLOR_BITS) | (g << COLOR_BITS) | b, canvas[..., 3] > 0
    return np.bincount(bins.ravel() if opaque.all() else bins[opaque], minlength=1 << 3 * COLOR_BITS).tolist()


def shown_samples(frame: dict) -> bytes:
    """The red values that the shown picture has where the frame was drawn: with a grey palette, its samples."""
    canvas = np.frombuffer(frame["canvas"], np.uint8).reshape(frame["screen_height"], frame["screen_width"], 4)
    top, left = frame["top"], frame["left"]
    return canvas[top : top + frame["height"], left : left + frame["width"], 0].tobytes()


def read_gif(data: bytes, canvases: bool = False) -> Iterator[dict]:
    """The frames of a GIF file: descriptor, timing, palette indices, and with ``canvases`` palette and shown RGBA picture."""
    if data[:3] != b"GIF" or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at, common = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        common, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    canvas, kept = np.zeros((height, width, 4), np.uint8) if canvases else None, None
    delay, disposal, transparent, clock, no = 0, 0, -1, 0, 0

    def blocks(i: int) -> tuple[bytes, int]:
        found = []
        while i < len(data) and data[i]:
            found.append(data[i + 1 : i + 1 + data[i]])
            i += data[i] + 1
        return b"".join(found), i + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = blocks(at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little") * 10
                transparent = body[3] if body[0] & 1 else -1
            at = after
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (1, 3, 5, 7))
        local, at, palette = data[at + 9], at + 10, common
        if local & 0x80:
            n = 3 << ((local & 7) + 1)
            palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        stream, after = blocks(at + 1)
        indices = lzw_decode(stream, data[at], w * h)
        if len(indices) < w * h:
            raise ValueError("short frame")
        if local & 0x40:
            lines = np.empty((h, w), np.uint8)
            lines[interlaced(h)] = np.frombuffer(indices, np.uint8).reshape(h, w)
            indices = lines.tobytes()
        frame = {"frame_no": no, "start_ms": clock, "delay_ms": delay, "left": left, "top": top, "width": w, "height": h, "disposal": disposal, "transparent": transparent, "indices": indices}
        pixels = np.frombuffer(indices, np.uint8)
        seen = pixels if transparent < 0 else pixels[pixels != transparent]
        counts = np.bincount(seen, minlength=256)[:256]
        if palette is None:
            palette = np.frombuffer(GREY, np.uint8).reshape(-1, 3)
        luma = (palette.astype(np.int64) @ np.array([299, 587, 114])) // 1000 * HISTOGRAM_BINS // 256
        used = min(len(luma), 256)
        frame["histogram"] = np.bincount(luma[:used], weights=counts[:used], minlength=HISTOGRAM_BINS).astype(np.int64).tolist()
        if canvas is not None:
            if disposal == 3:
                kept = canvas.copy()
            area = canvas[top : top + h, left : left + w]
            colors = np.full((256, 4), 255, np.uint8)
            colors[:, :3] = palette[np.minimum(np.arange(256), len(palette) - 1)]
            drawn = colors.view(np.uint32)[:, 0][pixels].view(np.uint8).reshape(h, w, 4)[: area.shape[0], : area.shape[1]]
            if transparent < 0:
                area[:] = drawn
            else:
                shown = (pixels != transparent).reshape(h, w)[: area.shape[0], : area.shape[1]]
                area[shown] = drawn[shown]
            frame |= {"palette": palette.tobytes(), "screen_width": width, "screen_height": height, "canvas": canvas.tobytes(), "colors": color_histogram(canvas)}
            if disposal == 2:
                canvas[top : top + h, left : left + w] = 0
            elif disposal == 3:
                canvas = kept
        yield frame
        clock, no, at = clock + delay, no + 1, after
        delay, disposal, transparent = 0, 0, -1


# --- Spark operators ---------------------------------------------------------------------------


def padded(payload: bytes, block: int = BLOCK) -> bytes:
    """The payload with zero bytes up to a positive multiple of ``block``."""
    return payload + b"\0" * (max(block, -(-len(payload) // block) * block) - len(payload))


def encode_gifs(df: DataFrame, text: str = "text", out: str = "gif") -> DataFrame:
    """``df`` with ``out``: the UTF-8 bytes of ``text``, padded to a multiple of 64, as a GIF file."""

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: write_gif(padded((t or "").encode("utf-8", "replace"))))

    return df.withColumn(out, encode(F.col(text)))


def frames_of(content: bytes | None) -> list[dict] | None:
    try:
        return list(read_gif(content, canvases=True)) if content else []
    except (ValueError, IndexError):
        return None


def decode_gifs(df: DataFrame, content: str = "gif", out: str = "frames") -> DataFrame:
    """``df`` with ``out``: the timed frames of a GIF column, each with its palette indices and the picture shown."""
    @F.pandas_udf(FRAME)
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for files in batches:
            yield pd.Series([frames_of(c) for c in files], index=files.index)

    return df.withColumn(out, decode(F.col(content)))


def gif_frames(df: DataFrame, content: str = "gif") -> DataFrame:
    """One row per frame: the other columns of ``df`` and the fields of the frame."""
    rest = [c for c in df.columns if c != content]
    return decode_gifs(df, content, "_f").select(*rest, F.explode("_f").alias("_f")).select(*rest, "_f.*")


DIGEST = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int32())]
)


def store_and_digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stores each text as a GIF, reads the file's frames, and describes what was read."""
    import hashlib

    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            payload = (text or "").encode("utf-8", "replace")
            media = write_gif(padded(payload))
            frames = list(read_gif(media, canvases=True))  # as in decode_gifs
            back = b"".join(map(shown_samples, frames))
            histogram = np.sum([f["histogram"] for f in frames], axis=0)
            feature = f"{HISTOGRAM_BINS}:" + ",".join(map(str, histogram.tolist()))
            rows.append((doc_id, len(payload), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DIGEST.types, strict=True)] if rows else [pa.array([], t) for t in DIGEST.types], schema=DIGEST)


def op1_gif(docs: DataFrame) -> DataFrame:
    """Round trip of every document through its GIF file, fused into one Arrow pass."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int"
    return docs.select("doc_id", "text").mapInArrow(store_and_digest, schema)
