"""Media columns: GIF. Files are decoded from their LZW code streams, palettes, disposal and transparency are applied, and timed frames
are stored with colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, small_batches, table, text_or_empty

WIDTH, ROWS = 64, 65_535
_TABLE = 4096


def ramp() -> np.ndarray:
    """The palette of stored payloads: three bits of red, three of green and two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], 1).astype(np.uint8)


def _code_widths(first: int, n: int, clear: int) -> np.ndarray:
    """Bits of the codes first, first + 1, ... after a clear code (from 1): the table grows by one entry a code until it is full."""
    top = clear + np.arange(first, first + n)
    bits = np.full(n, 12)
    for w in range(11, 2, -1):
        bits[top < 1 << w] = w
    return bits


def lzw_encode(data: bytes, depth: int = 8) -> bytes:
    """The code stream of samples under 2**depth: a clear code first and whenever the table is full, an end code last."""
    clear, known, codes = 1 << depth, {}, [1 << depth]
    free, prefix = clear + 2, None
    get, add = known.get, codes.append
    for c in data:
        if prefix is None:
            prefix = c
            continue
        key = prefix << 8 | c
        code = get(key)
        if code is not None:
            prefix = code
            continue
        add(prefix)
        prefix = c
        if free < _TABLE:
            known[key] = free
            free += 1
        else:
            add(clear)
            known.clear()
            free = clear + 2
    if prefix is not None:
        add(prefix)
    add(clear + 1)
    code = np.array(codes, np.uint32)
    resets = np.flatnonzero(code == clear)
    # The first clear code has the first width; after it, a code's width follows from its count since the last clear code.
    count = np.arange(len(code)) - np.repeat(resets, np.diff([*resets, len(code)]))
    count[resets[1:]] = np.diff(resets)
    count[0] = 1
    longest = int(count.max()) + 1
    bits = _code_widths(0, longest + 1, clear)[count]
    at = np.cumsum(bits) - bits
    out = np.zeros((int(at[-1] + bits[-1]) + 7) // 8 + 3, np.uint8)
    value, byte = code << (at & 7).astype(np.uint32), at >> 3
    for k in range(3):
        part = (value >> np.uint32(8 * k) & np.uint32(255)).astype(np.uint8)
        if depth >= 8:  # codes of 9 bits and more start in bytes of their own, so no place comes twice
            out[byte + k] |= part
        else:
            np.bitwise_or.at(out, byte + k, part)
    return out[: (int(at[-1] + bits[-1]) + 7) // 8].tobytes()


def _strings(code: np.ndarray, clear: int) -> np.ndarray:
    """The samples that the codes between two clear codes stand for.

    The entry that a code made is the code's string and the next string's first sample, so it is a stretch of the output itself: each
    sample points to an earlier one, and the pointers are followed in doubling steps to the literal codes.
    """
    entry = code.astype(np.int64) - (clear + 2)
    parent = np.where(entry >= 0, entry, np.arange(len(code)))
    if (parent > np.arange(len(code))).any() or ((entry < 0) & (code >= clear)).any() or (entry == np.arange(len(code))).any():
        raise ValueError("a code stands for no entry")
    depth, up = (entry >= 0).astype(np.int64), parent
    while True:
        more = depth[up]
        if not more.any():
            break
        depth, up = depth + more, up[up]
    size = depth + 1
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(code)), size)
    source = start[parent[of]] + np.arange(len(of)) - start[of]
    while True:
        then = source[source]
        if (then == source).all():
            return code[of[source]].astype(np.uint8)
        source = then


def lzw_decode(stream: bytes, depth: int, samples: int) -> np.ndarray:
    """At most `samples` samples of a code stream; a stream that ends early gives what it has."""
    clear = 1 << depth
    b = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    total, at, got, parts = 8 * len(stream), 0, 0, []
    while got < samples:
        n = min(_TABLE, max(1, (total - at) // (depth + 1)))
        while True:
            bits = _code_widths(1, n, clear)
            place = at + np.cumsum(bits) - bits
            whole = place + bits <= total
            place, used = place[whole], bits[whole]
            byte = place >> 3
            code = (b[byte] | b[byte + 1] << np.uint32(8) | b[byte + 2] << np.uint32(16)) >> (place & 7).astype(np.uint32) & ((1 << used) - 1).astype(np.uint32)
            stop = np.flatnonzero((code == clear) | (code == clear + 1))
            if len(stop) or not whole.all() or len(place) == 0:
                break
            if at + int(bits.sum()) >= total:
                break
            n *= 4  # a full table that is kept
        end = int(stop[0]) if len(stop) else len(code)
        if end:
            parts.append(_strings(code[:end], clear))
            got += len(parts[-1])
        if not len(stop) or code[end] == clear + 1:
            break
        at = int(place[end] + used[end])
    return np.concatenate([*parts, np.zeros(0, np.uint8)])[:samples].astype(np.uint8)


def encode_gif(payload: bytes, delay: int = 10) -> bytes:
    """The payload, a multiple of WIDTH bytes, as the samples of frames of at most ROWS rows."""
    frames = [payload[k : k + WIDTH * ROWS] for k in range(0, len(payload), WIDTH * ROWS)]
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, len(frames[0]) // WIDTH, 0xF7, 0, 0), ramp().tobytes()]
    for f in frames:
        stream = lzw_encode(f)
        out += [b"\x21\xf9\x04\x04", struct.pack("<HB", delay, 0), b"\x00\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, len(f) // WIDTH, 0), b"\x08"]
        out += [bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)]
        out.append(b"\x00")
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    delay_ms: int
    samples: np.ndarray
    canvas: np.ndarray  # rows, columns, (red, green, blue, alpha), as shown

    def histogram(self) -> list[int]:
        """Counts of the shown pixels by two bits of each colour."""
        seen = self.canvas[self.canvas[..., 3] > 0]
        return np.bincount((seen[:, 0] >> 6).astype(int) * 16 + (seen[:, 1] >> 6) * 4 + (seen[:, 2] >> 6), minlength=64).tolist()


def decode_gif(raw: bytes) -> Iterator[Frame]:
    """The frames as a viewer shows them, one at a time. A file that ends early gives its whole frames."""
    if raw[:3] != b"GIF" or len(raw) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", raw[6:13])
    at = 13

    def colours(flag: int) -> np.ndarray:
        nonlocal at
        n = 2 << (flag & 7)
        p = np.zeros((256, 4), np.uint8)
        p[:, 3] = 255
        p[:n, :3] = np.frombuffer(raw[at : at + 3 * n], np.uint8).reshape(-1, 3)
        at += 3 * n
        return p

    def blocks() -> bytes:
        nonlocal at
        out = []
        while at < len(raw) and raw[at]:
            out.append(raw[at + 1 : at + 1 + raw[at]])
            at += 1 + raw[at]
        at += 1
        return b"".join(out)

    shared = colours(flags) if flags & 0x80 else np.zeros((256, 4), np.uint8)
    canvas = np.zeros((height, width, 4), np.uint8)
    disposal, delay, clear = 0, 0, None
    while at < len(raw) and raw[at] != 0x3B:
        kind = raw[at]
        at += 1
        if kind == 0x21:
            label = raw[at]
            at += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay, clear = body[0] >> 2 & 7, 10 * (body[1] | body[2] << 8), body[3] if body[0] & 1 else None
        elif kind == 0x2C:
            if at + 9 >= len(raw):
                return
            x, y, w, h, f = struct.unpack("<HHHHB", raw[at : at + 9])
            at += 9
            palette = colours(f) if f & 0x80 else shared
            depth = raw[at]
            at += 1
            samples = lzw_decode(blocks(), depth, w * h)
            if len(samples) < w * h:
                return
            rows = samples.reshape(h, w)
            if f & 0x40:
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(rows)
                straight[order] = rows
                rows = straight
            before = canvas.copy() if disposal == 3 else None
            part = canvas[y : y + h, x : x + w]
            inside = rows[: part.shape[0], : part.shape[1]]
            if clear is None:
                part[...] = palette[inside]
            else:
                shown = inside != clear
                part[shown] = palette[inside[shown]]
            yield Frame(delay, rows.ravel(), canvas.copy() if disposal in (2, 3) else canvas)
            if disposal == 2:
                part[...] = 0
            elif before is not None:
                canvas = before
            else:
                canvas = canvas.copy() if raw[at : at + 1] != b"\x3b" else canvas
            disposal, delay, clear = 0, 0, None
        else:
            return


def frame_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame: doc_id, frame (from 0), delay_ms, width, height, pixels (shown, RGBA), histogram. A null or broken file has none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, raw in zip(b["doc_id"], b["media"]):
                try:
                    for k, f in enumerate(decode_gif(raw or b"")):
                        yield pd.DataFrame([(doc, k, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), f.histogram())], columns=["doc_id", "frame", "delay_ms", "width", "height", "pixels", "histogram"])
                except (ValueError, IndexError, struct.error):
                    continue

    return small_batches(media).select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInPandas(rows, "doc_id long, frame int, delay_ms int, width int, height int, pixels binary, histogram array<long>")


def _store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, text in zip(b["doc_id"], b["text"]):
            raw = text.encode("utf-8", "surrogatepass")
            rows.append((doc, len(raw), encode_gif(raw + bytes(-len(raw) % WIDTH if raw else WIDTH))))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "media"]).astype({"doc_id": "Int64"})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, n, media in zip(b["doc_id"], b["n_bytes"], b["media"]):
            whole, size, tail, count, ms, hist, tall = hashlib.sha256(), 0, b"", 0, 0, np.zeros(64, np.int64), 0
            for f in decode_gif(media):
                part = f.samples.tobytes()
                whole.update(part)
                size, tail, count, ms, tall = size + len(part), part[-WIDTH:], count + 1, ms + f.delay_ms, max(tall, f.canvas.shape[0])
                hist += f.histogram()
            seen = ",".join(f"{k}:{v}" for k, v in enumerate(hist.tolist()) if v)
            rows.append((doc, n, size, whole.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), f"frames={count};size={WIDTH}x{tall};ms={ms};hist={seen}"))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({"doc_id": "Int64"})


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes, padded by 0 to a positive multiple of 64, as a GIF in a stored table."""
    own = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return cut(own.mapInPandas(_store, "doc_id long, n_bytes long, media binary"), "media")


def gif_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Null and empty texts are 64 bytes 0. Equal texts have equal values. Texts over 4 MB take several frames. Repeated rows get a row
    each; null ids are kept. Empty tables give empty results. Other columns are neither read nor returned.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media_table(docs, id_col, text_col).mapInPandas(_read, schema)


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media(table(spark, sf_dir, "documents"))
