"""TIFF: reading image directories with PackBits, LZW and deflate strips and tiles, and writing plain grey pages.

read_pages gives one row per page of a column of files. Inside a task a file is walked from directory to directory;
strips and tiles are decoded, predictors undone, and samples put in order. A part that is broken gives a row with an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, free_names, in_batches

#: Field types and tags of the TIFF 6.0 specification, fixed values.
TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANES, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
PAGE = "page long, width long, height long, bits long, samples long, compression long, predictor long, pixels binary, feature string, error string"
#: Bytes of a decoded page that a task makes room for; a page that says it has more gets a row with an error.
MOST_BYTES = 1 << 30


def unpack_bits(data: bytes, most: int = MOST_BYTES) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, plain = bytearray(), 0, 0

    def literal(upto: int) -> None:
        for k in range(plain, upto, 128):
            part = data[k : min(k + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    while i < len(data):
        n = 1
        while n < 128 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        if n >= 3:
            literal(i)
            out.append(257 - n)
            out.append(data[i])
            plain = i + n
        i += n
    literal(len(data))
    return bytes(out)


def lzw_decode(data: bytes, most: int = MOST_BYTES) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears, 257 ends; widths grow one code early."""
    out, table, last, size = [], [], b"", 0
    width, have, held = 9, 0, 0
    for byte in data:
        held, have = held << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            table = [bytes([k]) for k in range(256)] + [b"", b""]
        if code > len(table) or code == len(table) and not last:
            raise ValueError("LZW code out of range")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        size += len(entry)
        if size >= most:
            break
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    held, have, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, have
        held, have = held << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(held >> have & 255)
        held &= (1 << have) - 1

    table, width, last = {bytes([k]): k for k in range(256)}, 9, b""
    following = 258
    put(256, 9)
    for k in range(len(data)):
        more = last + data[k : k + 1]
        if more in table:
            last = more
            continue
        put(table[last], width)
        table[more] = following
        following += 1
        if following == 4094:
            put(256, width)
            table, following, width = {bytes([k]): k for k in range(256)}, 258, 9
        else:
            width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        last = data[k : k + 1]
    if last:
        put(table[last], width)
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257, width)
    if have:
        out.append(held << (8 - have) & 255)
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


#: Decoders of (bytes, most): each stops when it has as much as the part can hold.
_DECODE = {NONE: lambda data, most: data[:most], LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if kind in TYPES:
            size, letters = TYPES[kind]
            where = at + 10 + 12 * k
            if size * count > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            tags[tag] = list(struct.unpack_from(f"{order}{count * len(letters)}{letters[0]}", data, where))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _pixels(data: bytes, tags: dict[int, list], order: str) -> tuple[np.ndarray, int, int]:
    """Rows x columns x samples of one page."""
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    coding, predictor, planes = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANES, 1)
    if coding not in _DECODE:
        raise ValueError(f"compression {coding}")
    if bits not in (1, 2, 4, 8, 16, 32) or predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise ValueError(f"{bits} bits with predictor {predictor}")
    tiled = TILES in tags
    w, h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(height, one(STRIP_ROWS, height)))
    at, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    if not width or not height or not w or not h:
        raise ValueError("no width or height")
    across, down = -(-width // w), -(-height // h)
    each, sets = (samples, 1) if planes == 1 else (1, samples)
    if len(at) < across * down * sets or len(sizes) < len(at):
        raise ValueError("strips or tiles are missing")
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    if min(width, height, w, h, samples) < 1 or max(width * height, w * h) * samples * kind.itemsize > MOST_BYTES:
        raise ValueError(f"{width} x {height} of {samples} samples")
    page = np.zeros((height, width, samples), kind)
    for k in range(across * down * sets):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * h, cell % across * w
        rows = h if tiled else min(h, height - y)
        line = -(-w * each * bits // 8)
        raw = _DECODE[coding](data[at[k] : at[k] + sizes[k]], rows * line)
        if len(raw) < rows * line:
            raise ValueError("a strip or tile is too short")
        part = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line)
        if bits < 8:
            part = np.unpackbits(part, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))
            part = part[:, : w * each].astype(np.uint8)
        else:
            part = part.reshape(-1).view(kind)
        part = part.reshape(rows, w, each)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("=")).astype(kind)
        into = page[y : y + rows, x : x + w, plane * each : plane * each + each]
        into[:] = part[: into.shape[0], : into.shape[1]]
    return page, bits, samples


def feature(image: np.ndarray) -> str:
    """64 bits as hexadecimal digits: whether each of 8 x 8 cells is brighter than all cells' mean, rows first."""
    grey = image.mean(axis=2) if image.shape[2] > 1 else image[:, :, 0]
    cells = grey
    for axis in (0, 1):
        edges = np.arange(8) * cells.shape[axis] // 8
        ends = np.maximum(np.append(edges[1:], cells.shape[axis]), edges + 1)
        sums = np.concatenate((np.zeros_like(cells.take([0], axis), dtype=np.float64), np.cumsum(cells, axis=axis, dtype=np.float64)), axis=axis)
        cells = (sums.take(ends, axis) - sums.take(edges, axis)) / np.expand_dims(ends - edges, 1 - axis)
    return np.packbits((cells > cells.mean()).ravel()).tobytes().hex()


def pages(data: bytes) -> Iterator[dict]:
    """A dict with PAGE's fields for each image directory; a file that is none gives one with an error.

    Pixels come row by row, samples side by side, of 1, 2 or 4 bits as a byte each, wider ones in the file's byte order. A
    part is decoded up to what it can hold, so a small file can't fill a worker; numbers beyond 63 bits are cut to them.
    """
    empty = dict.fromkeys(("width", "height", "bits", "samples", "compression", "predictor", "pixels", "feature"))
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4] if data else b"")
    if order is None:
        yield empty | {"page": 0, "error": "not a TIFF file"}
        return
    seen, page, at = set(), 0, struct.unpack_from(order + "I", data, 4)[0] if len(data) >= 8 else 0
    while at and at not in seen:
        seen.add(at)
        row = empty | {"page": page, "error": None}
        try:
            tags, at = _directory(data, at, order)
        except struct.error as e:
            yield row | {"error": f"directory: {e}"}
            return
        row |= {k: min(max((tags.get(t) or [d])[0], -1 << 63), (1 << 63) - 1) for k, t, d in (("width", WIDTH, 0), ("height", HEIGHT, 0), ("bits", BITS, 1), ("samples", SAMPLES, 1), ("compression", COMPRESSION, NONE), ("predictor", PREDICTOR, 1))}
        try:
            image = _pixels(data, tags, order)[0]
            row |= {"pixels": image.tobytes(), "feature": feature(image)}
        except (ValueError, KeyError, IndexError, zlib.error, MemoryError) as e:
            row["error"] = f"{type(e).__name__}: {e}"
        yield row
        page += 1


def write_page(pixels: bytes, width: int, compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 4096) -> bytes:
    """A little-endian file with one page of 8-bit grey samples, in strips."""
    image = np.frombuffer(pixels, np.uint8).reshape(-1, width)
    if predictor == 2:
        image = np.diff(image, axis=1, prepend=np.zeros((len(image), 1), np.uint8))
    code = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: lambda x: b"".join(pack_bits(x[k : k + width]) for k in range(0, len(x), width))}[compression]
    strips = [code(image[k : k + strip_rows].tobytes()) for k in range(0, len(image), strip_rows)]
    fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [len(image)]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (STRIPS, 4, [0] * len(strips)), (SAMPLES, 3, [1]), (STRIP_ROWS, 4, [strip_rows]), (STRIP_BYTES, 4, [len(s) for s in strips]), (PREDICTOR, 3, [predictor])]
    base = 8 + 2 + 12 * len(fields) + 4
    extra = sum(4 * len(v) for _, _, v in fields if len(v) > 1)
    places = base + extra + np.concatenate(([0], np.cumsum([len(s) for s in strips])[:-1])).astype(int)
    fields[5] = (STRIPS, 4, places.tolist())
    head, tail = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(fields)), b""
    for tag, kind, values in fields:
        packed = struct.pack(f"<{len(values)}{TYPES[kind][1]}", *values)
        if len(packed) > 4:
            head += struct.pack("<HHII", tag, kind, len(values), base + len(tail))
            tail += packed
        else:
            head += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return b"".join([head, struct.pack("<I", 0), tail, *strips])


def read_pages(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, PAGE...) for each page of each file in the binary column content.

    A null or empty content and a file that isn't a TIFF give one row with page 0, no pixels and an error; so does each
    page that can't be decoded. Repeated keys are kept apart only by their order. Other columns are ignored; an empty table
    gives an empty result.
    """
    kind = dict(files.dtypes)[key]
    names = [x.split()[0] for x in PAGE.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.binary(), pa.string(), pa.string()]
    (held,) = free_names(names, "key")

    def flushed(batch, at, rows):
        columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=[held, *names])

    def run(batches):
        for batch in batches:
            at, rows, size = [], [], 0
            for k, data in enumerate(batch.column(1)):
                for row in pages(data.as_py() or b""):
                    at.append(k)
                    rows.append(row)
                    size += len(row["pixels"] or b"")
                    if size >= BATCH_BYTES or len(rows) >= 1024:
                        yield flushed(batch, at, rows)
                        at, rows, size = [], [], 0
            if rows:
                yield flushed(batch, at, rows)

    found = in_batches(files.select(F.col(key).alias(held), content), run, f"{held} {kind}, {PAGE}")
    return found.select(F.col(held).alias(key), *names)


def stored_texts(docs: DataFrame, width: int = 64) -> DataFrame:
    """(doc_id, n_bytes, media): the UTF-8 bytes of every whole text, padded with 0 to whole rows of width, as a TIFF file.

    A null text is empty; an empty one is a row of zeros. Texts of any length are stored whole; repeated rows each get a row,
    alike for equal texts; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                texts = [(t or "").encode() for t in batch.column(1).slice(at, 512).to_pylist()]
                media = [write_page(t.ljust(max(1, -(-len(t) // width)) * width, b"\0"), width) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return in_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_bytes long, media binary")
