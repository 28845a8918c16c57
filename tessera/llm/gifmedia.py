"""GIF media columns: an LZW encoder and decoder, and timed frames with colour histograms.

Both directions are full LZW: a string table that grows from each clear code on, with code
widths that follow from the number of codes. The decoder reads any GIF: local palettes,
interlacing, transparency and the disposal rules, composed on the screen. Pictures of one
size whose tables never fill are coded in lock-step, one step for all of them; any other
picture goes through the plain coder, which gives the same.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.linear import by_block

SIDE = 24
PIXELS = SIDE * SIDE
#: Entries of a full string table, and the largest screen that is composed: 256 MB. A larger one is an error.
TABLE, MAX_PIXELS = 4096, 1 << 26
CLEAR, END = 256, 257
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3)
DELAY = 4  # hundredths of a second
#: What a broken stream raises.
BROKEN = (ValueError, struct.error, IndexError, OverflowError, MemoryError)
#: Bytes of composed frames that are handed on together, and pixels that are coded together.
BATCH_BYTES, BATCH_PIXELS = 1 << 24, 1 << 20


@dataclass
class Frame:
    """A composed picture of the whole screen (height, width, RGBA), its delay, and the indices that were stored."""

    rgba: np.ndarray
    delay_ms: int
    indices: np.ndarray


@cache
def widths(first_width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the codes after a clear code, by their number, until the table is full; and the bit at which each starts."""
    if not 1 <= first_width <= 11:
        raise ValueError(f"LZW code size {first_width}")
    clear = 1 << first_width
    known = clear + 2 + np.maximum(np.arange(TABLE - clear) - 1, 0)  # entries when the code is read or written
    width = np.clip(np.floor(np.log2(known)).astype(np.int64) + 1, first_width + 1, 12)
    return width, np.concatenate([[0], np.cumsum(width)])


def lzw_encode(pixels: bytes, first_width: int = 8) -> list[list[int]]:
    """Codes in runs that each begin after a clear code; all but the last fill the table."""
    most = TABLE - (1 << first_width) - 2
    runs, codes, table = [], [], {}
    at, fresh = -1, (1 << first_width) + 2
    for b in pixels:
        if at < 0:
            at = b
            continue
        key = at << 8 | b
        if (found := table.get(key)) is not None:
            at = found
            continue
        codes.append(at)
        table[key] = fresh
        fresh += 1
        at = b
        if len(codes) == most:
            runs.append(codes)
            codes, table, fresh = [], {}, (1 << first_width) + 2
    if at >= 0:
        codes.append(at)
    return [*runs, codes]


def pack_codes(streams: list[list[list[int]]], first_width: int = 8) -> list[bytes]:
    """The bytes of many pictures' codes: a clear code before each run, an end code after the last."""
    clear = 1 << first_width
    width, start = widths(first_width)
    codes, places, ends, at = [], [], [], 0
    for runs in streams:
        for run in runs:
            # The clear code is written in the width that the codes before it had reached.
            wide = first_width + 1 if run is runs[0] else int(width[min(len(before), len(width) - 1)])
            codes.append(np.array([clear, *run], np.int64))
            places.append(np.concatenate([[at], at + wide + start[: len(run)]]))
            at += wide + int(start[len(run)])
            before = run
        codes.append(np.array([clear + 1]))
        places.append(np.array([at]))
        at += int(width[min(len(before), len(width) - 1)])
        at = -(-at // 8) * 8
        ends.append(at // 8)
    code, place = np.concatenate(codes), np.concatenate(places)
    word, byte = code << (place & 7), place >> 3
    out = sum(np.bincount(byte + i, weights=(word >> 8 * i) & 255, minlength=at // 8 + 2) for i in range(3)).astype(np.uint8)
    return [out[x:y].tobytes() for x, y in zip([0, *ends[:-1]], ends, strict=True)]


def lzw_codes(data: np.ndarray, at: int, first_width: int, full: bool = False) -> tuple[np.ndarray, int]:
    """Codes from bit `at` as far as a clear code, an end code, a full table or the end of the data (three zero bytes follow it);
    and the bit after them. They begin just after a clear code, so their number alone tells their width, or with a full table."""
    clear, left = 1 << first_width, (len(data) - 3) * 8 - at
    width, start = (np.full(left // 12, 12), 12 * np.arange(left // 12 + 1)) if full else widths(first_width)
    fits = int(np.searchsorted(start[1:], left, side="right"))
    bit = start[:fits] + at
    byte = bit >> 3
    word = data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16
    code = (word >> (bit & 7)) & ((1 << width[:fits]) - 1)
    stop = np.flatnonzero((code == clear) | (code == clear + 1))
    n = int(stop[0]) + 1 if len(stop) else fits
    return code[:n], at + int(start[n])


def lzw_decode(data: bytes, first_width: int, pixels: int) -> np.ndarray:
    """Indices of one picture. A stream that ends early leaves zeros; one that goes on is cut at the picture's size."""
    most, clear = len(widths(first_width)[0]), 1 << first_width
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    roots = [bytes([i & 255]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    size, at, bits, full = 0, 0, len(data) * 8, False
    table, prev = roots, b""
    while size < pixels and at < bits:
        codes, at = lzw_codes(raw, at, first_width, full)
        if not len(codes):
            break
        last = int(codes[-1])
        stopped = last in (clear, clear + 1)
        if not full:
            table, prev = roots.copy(), b""
        for c in codes[: len(codes) - stopped].tolist():
            if c < len(table):
                s = table[c]
            elif c == len(table) and prev:
                s = prev + prev[:1]
            else:
                raise ValueError("LZW code out of range")
            if prev and len(table) < TABLE:
                table.append(prev + s[:1])
            out.append(s)
            size += len(s)
            prev = s
        if last == clear + 1:
            break
        full = not stopped and (full or len(codes) == most)
    got = np.frombuffer(b"".join(out)[:pixels], np.uint8)
    return got if len(got) == pixels else np.concatenate([got, np.zeros(pixels - len(got), np.uint8)])


def encode_pictures(pixels: np.ndarray) -> list[bytes]:
    """LZW streams of many pictures (pictures, bytes each), byte by byte in lock-step. Code size 8; a picture must not fill the table."""
    count, size = pixels.shape
    if size > TABLE - CLEAR - 2:
        return pack_codes([lzw_encode(x.tobytes()) for x in pixels])
    slots = 1 << int(2 * size).bit_length()
    keys, known = np.full(count * slots, -1, np.int32), np.zeros(count * slots, np.int32)
    base, codes, n = np.arange(count) * slots, np.zeros((count, size), np.int64), np.zeros(count, np.int64)
    columns = np.ascontiguousarray(pixels.T).astype(np.int32)
    at = columns[0]
    for byte in columns[1:]:
        key = at << 8 | byte
        slot = (key * 40503 >> 7) & (slots - 1)
        held = keys[base + slot]
        hit = held == key
        lost = np.flatnonzero(~hit & (held >= 0))
        while len(lost):
            slot[lost] = (slot[lost] + 1) & (slots - 1)
            held = keys[base[lost] + slot[lost]]
            hit[lost] = held == key[lost]
            lost = lost[(held >= 0) & (held != key[lost])]
        new = np.flatnonzero(~hit)
        place = base[new] + slot[new]
        codes[new, n[new]] = at[new]
        keys[place], known[place] = key[new], CLEAR + 2 + n[new]
        n[new] += 1
        at = np.where(hit, known[base + slot], byte)
    codes[np.arange(count), n] = at
    n += 1
    width, start = widths(8)
    sizes = -(-(9 + start[n] + width[n]) // 8)
    first = 8 * np.concatenate([[0], np.cumsum(sizes)])
    used = np.arange(size) < n[:, None]
    place = np.concatenate([first[:-1], (first[:-1, None] + 9 + start[:size])[used], first[:-1] + 9 + start[n]])
    word = np.concatenate([np.full(count, CLEAR), codes[used], np.full(count, END)]) << (place & 7)
    out = sum(np.bincount((place >> 3) + i, weights=(word >> 8 * i) & 255, minlength=first[-1] // 8 + 2) for i in range(3)).astype(np.uint8).tobytes()
    return [out[x // 8 : y // 8] for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def decode_pictures(streams: list[bytes], pixels: int, first_width: int = 8) -> list[np.ndarray]:
    """Indices of many pictures of one size. The string of a table entry is what its code wrote and one byte more, so a
    code above the roots copies from where that stands: lengths come in lock-step, then all copies are followed at once."""
    count = len(streams)
    size = np.array([len(x) for x in streams])
    width, start = widths(first_width)
    clear, head = 1 << first_width, first_width + 1
    most = int(np.searchsorted(start[1:], max(size.max() * 8 - head, 0), side="right")) if count else 0
    good = np.zeros(count, bool)
    if most and pixels <= TABLE - clear - 2:
        data = np.zeros((count, size.max() + 3), np.int32)
        data[np.arange(data.shape[1]) < size[:, None]] = np.frombuffer(b"".join(streams), np.uint8)
        bit = np.concatenate([[0], head + start[:most]])
        word = data[:, bit >> 3] | data[:, (bit >> 3) + 1] << 8 | data[:, (bit >> 3) + 2] << 16
        codes = (word >> (bit & 7)) & ((1 << np.concatenate([[head], width[:most]])) - 1)
        first, codes = codes[:, 0], codes[:, 1:]
        stop = (codes == clear) | (codes == clear + 1)
        n = stop.argmax(axis=1)
        good = (first == clear) & (codes[np.arange(count), n] == clear + 1)
        used = (np.arange(most) < n[:, None]) & good[:, None]
        entry = np.where(used, codes - clear - 2, -3)
        good &= ~((entry >= np.arange(most)) | (entry == -2) | (entry == -1)).any(axis=1)
        entry[~good] = -3
        lengths, each, back = np.zeros((most, count), np.int32), np.arange(count), np.ascontiguousarray(entry.T)
        for i in range(int(n[good].max()) if good.any() else 0):
            lengths[i] = np.where(back[i] < 0, 1, lengths[np.maximum(back[i], 0), each] + 1)
        lengths = lengths.T * (used & good[:, None])
        good &= lengths.sum(axis=1) == pixels
        lengths[~good] = 0
        place = np.cumsum(lengths, axis=1) - lengths + (np.cumsum(good) - good)[:, None] * pixels
        source = np.where(entry >= 0, np.take_along_axis(place, np.maximum(entry, 0), axis=1), place)
        live = lengths > 0
        per = lengths[live]
        far = np.arange(int(good.sum()) * pixels) - np.repeat((place - source)[live], per)
        byte = np.repeat(codes[live].astype(np.uint8), per)
        while True:
            further = far[far]
            if np.array_equal(further, far):
                break
            far = further
        found = iter(byte[far].reshape(-1, pixels))
    return [next(found) if ok else lzw_decode(x, first_width, pixels) for x, ok in zip(streams, good, strict=True)]


def encode(payload: np.ndarray) -> bytes:
    """An animated GIF of 24 x 24 pictures of 256 greys: one stored index for each byte. len(payload) is a multiple of 576."""
    return assemble(encode_pictures(payload.reshape(-1, PIXELS)))


def assemble(streams: list[bytes]) -> bytes:
    head = b"\x21\xf9\x04" + struct.pack("<BHB", 4, DELAY, 0) + b"\x00" + b"\x2c" + struct.pack("<HHHHB", 0, 0, SIDE, SIDE, 0) + b"\x08"
    out = [b"GIF89a" + struct.pack("<HHBBB", SIDE, SIDE, 0xF7, 0, 0) + GREY.tobytes()]
    for stream in streams:
        out.append(head)
        for j in range(0, len(stream), 255):
            part = stream[j : j + 255]
            out += (bytes([len(part)]), part)
        out.append(b"\x00")
    return b"".join(out) + b"\x3b"


@dataclass
class _Stored:
    left: int
    top: int
    width: int
    height: int
    palette: np.ndarray
    interlaced: bool
    first_width: int
    data: bytes
    disposal: int
    transparent: int | None
    delay: int

    def colours(self) -> np.ndarray:
        """RGBA of all 256 indices; those beyond the palette are black."""
        out = np.zeros((256, 4), np.uint8)
        out[: len(self.palette), :3] = self.palette
        out[:, 3] = 255
        return out


def _sub_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(raw) and raw[at]:
        parts.append(raw[at + 1 : at + 1 + raw[at]])
        at += 1 + raw[at]
    return b"".join(parts), at + 1


def parse(raw: bytes) -> tuple[int, int, list[_Stored]]:
    """Screen width and height, and the stored pictures."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    if len(raw) < 13:
        raise ValueError("the GIF's header is cut")
    width, height, flags = struct.unpack_from("<HHB", raw, 6)
    at, shared = 13, np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    found: list[_Stored] = []
    control: tuple[int, int | None, int] = (0, None, 0)
    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            label, (body, at) = raw[at + 1], _sub_blocks(raw, at + 2)
            if label == 0xF9 and len(body) >= 4:
                f, delay, t = struct.unpack_from("<BHB", body)
                control = (f >> 2 & 7, t if f & 1 else None, delay)
        elif raw[at] == 0x2C:
            left, top, w, h, f = struct.unpack_from("<HHHHB", raw, at + 1)
            at += 10
            palette = shared
            if f & 0x80:
                n = 2 << (f & 7)
                palette = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            first, (data, at) = raw[at], _sub_blocks(raw, at + 1)
            found.append(_Stored(left, top, w, h, palette, bool(f & 0x40), first, data, *control))
            control = (0, None, 0)
        else:
            raise ValueError(f"unknown block {raw[at]:#x}")
    return width, height, found


def stored_indices(pictures: list[_Stored]) -> Iterator[np.ndarray]:
    """Indices (height, width) of stored pictures, rows in order; neighbours of one size are decoded together."""
    for (first, w, h), group in groupby(pictures, lambda p: (p.first_width, p.width, p.height)):
        group = list(group)
        step = max(1, BATCH_PIXELS // max(w * h, 1))
        for i in range(0, len(group), step):
            part = group[i : i + step]
            for p, x in zip(part, decode_pictures([p.data for p in part], w * h, first), strict=True):
                x = x.reshape(h, w)
                if p.interlaced:
                    order = [r for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, h, b)]
                    rows = np.empty_like(x)
                    rows[order] = x
                    x = rows
                yield x


def decode(raw: bytes) -> Iterator[Frame]:
    """Composed frames in order: transparent indices keep what is below; disposal 2 clears the picture's
    place after it was shown, 3 brings back what was there before."""
    width, height, pictures = parse(raw)
    yield from compose(width, height, pictures, stored_indices(checked(width, height, pictures)))


def checked(width: int, height: int, pictures: list[_Stored]) -> list[_Stored]:
    if max([width * height, *(p.width * p.height for p in pictures)]) > MAX_PIXELS:
        raise ValueError(f"a screen or picture of more than {MAX_PIXELS} pixels")
    return pictures


def compose(width: int, height: int, pictures: list[_Stored], indices: Iterator[np.ndarray]) -> Iterator[Frame]:
    screen = np.zeros((height, width, 4), np.uint8)
    for p, x in zip(pictures, indices, strict=False):
        before = screen.copy() if p.disposal == 3 else None
        ys, xs = slice(p.top, min(p.top + p.height, height)), slice(p.left, min(p.left + p.width, width))
        part = x[: ys.stop - ys.start, : xs.stop - xs.start]
        drawn = p.colours()[part]
        if p.transparent is not None:
            see = part == p.transparent
            drawn[see] = screen[ys, xs][see]
        screen[ys, xs] = drawn
        yield Frame(screen.copy(), p.delay * 10, x)
        if p.disposal == 2:
            screen[ys, xs] = 0
        elif before is not None:
            screen = before


def histogram(rgba: np.ndarray) -> np.ndarray:
    """64 counts of the visible pixels, by the two high bits of red, green and blue."""
    word = np.ascontiguousarray(rgba).view("<u4").ravel()
    word = word[word >> 24 > 0]
    return np.bincount((word >> 2 & 0x30) | (word >> 12 & 0x0C) | (word >> 22 & 0x03), minlength=64)


def gif_frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """Timed frames of every GIF: key, frame, start_ms, delay_ms, width, height, rgba, histogram (64 counts), error.

    A null or empty medium has no frames; one that can't be decoded gives one row with an error.
    """
    kind = media.schema[key].dataType.simpleString()
    names = [key, "frame", "start_ms", "delay_ms", "width", "height", "rgba", "histogram", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw, rows, clock, held = m.as_py() or b"", [], 0, 0
                try:
                    for i, f in enumerate(decode(raw) if raw else ()):
                        rows.append((k, i, clock, f.delay_ms, f.rgba.shape[1], f.rgba.shape[0], f.rgba.tobytes(), histogram(f.rgba).tolist(), None))
                        clock += f.delay_ms
                        held += f.rgba.nbytes
                        if held > BATCH_BYTES or len(rows) == 256:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types(b), strict=True)], names=names)
                            rows, held = [], 0
                except BROKEN as e:
                    rows.append((k, None, None, None, None, None, None, None, str(e)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types(b), strict=True)], names=names)

    def types(b: pa.RecordBatch) -> list[pa.DataType]:
        i = pa.int32()
        return [b.schema.field(0).type, i, pa.int64(), i, i, i, pa.binary(), pa.list_(pa.int64()), pa.string()]

    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, frame int, start_ms long, delay_ms int, width int, height int, rgba binary, histogram array<long>, error string")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media of every row: the text's bytes, filled with 255 up to a positive multiple of 576, as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in by_block(b.column(1), BATCH_PIXELS):
                size = np.diff(offsets)
                pictures = np.maximum(-(-size // PIXELS), 1)
                last = np.cumsum(pictures)
                payload = np.full(int(last[-1]) * PIXELS, 255, np.uint8)
                at = np.repeat((last - pictures) * PIXELS - offsets[:-1], size) + np.arange(len(data))
                payload[at] = data
                step = BATCH_PIXELS // PIXELS
                rows = payload.reshape(-1, PIXELS)
                streams = list(chain.from_iterable(encode_pictures(rows[x : x + step]) for x in range(0, len(rows), step)))
                media = [assemble(streams[y - n : y]) for n, y in zip(pictures.tolist(), last.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _together(media: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[Frame]]]:
    """Each GIF and its frames, which must be taken in order; the pictures of several GIFs are decoded together."""

    def part(held: list[tuple[bytes, int, int, list[_Stored]]]) -> Iterator[tuple[bytes, Iterator[Frame]]]:
        indices = stored_indices([p for *_, pictures in held for p in pictures])
        for raw, width, height, pictures in held:
            yield raw, compose(width, height, pictures, islice(indices, len(pictures)))

    held, size = [], 0
    for raw in media:
        width, height, pictures = parse(raw)
        held.append((raw, width, height, checked(width, height, pictures)))
        size += sum(p.width * p.height for p in pictures)
        if size >= BATCH_PIXELS:
            yield from part(held)
            held, size = [], 0
    yield from part(held)


def _digest(raw: bytes, frames: Iterator[Frame]) -> tuple:
    parts, ms, bins = [], 0, np.zeros(64, np.int64)
    for f in frames:
        parts.append(f.rgba[..., 0].tobytes())
        ms += f.delay_ms
        bins += histogram(f.rgba)
    payload = b"".join(parts)
    feature = f"frames={len(parts)};ms={ms};hist=" + ",".join(f"{i}:{bins[i]}" for i in np.flatnonzero(bins))
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, None


def media_digest(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and error of every stored GIF.

    Payload and feature come from the decoded frames: a grey pixel's red is the byte that was
    stored. feature: number of frames, their whole time in ms, and the count of each bin of
    the colour histogram that has any. Equal texts give equal values; null and empty texts are
    one frame of 255. A null medium gives nulls, one that can't be decoded its size, its hash and an error.
    """

    def alone(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 7
        try:
            return _digest(raw, decode(raw))
        except BROKEN as e:
            return None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = b.column(2).to_pylist()
            try:
                rows = [_digest(raw, frames) for raw, frames in _together(iter(media))] if None not in media else [alone(m) for m in media]
            except BROKEN:
                rows = [alone(m) for m in media]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"],
            )

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
