"""TIFF pages as columns: a baseline writer and a reader of strips and tiles.

Layout: little- or big-endian classic TIFF, 8-bit chunky samples; compressions none (1), LZW (5),
deflate (8 and 32946) and PackBits (32773); predictors none (1) and horizontal differencing (2).
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BATCH_BYTES, arrow_schema, bounded_batches, ddl, map_columns

# Fixed values of the TIFF 6.0 format.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I"}
#: Bytes to which one stored byte can grow: 128 of two, 1032 by the deflate format, at most 4096 of nine bits.
EXPANDS = {NONE: 1, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032, LZW: 3641}

PAGE_SCHEMA = [
    ("doc_id", "long"), ("page", "int"), ("width", "int"), ("height", "int"), ("samples", "int"),
    ("compression", "int"), ("predictor", "int"), ("pixels", "binary"), ("error", "string"),
]


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more equal bytes become repeats; what lies between becomes literals."""
    a = np.frombuffer(data, np.uint8)
    if not a.size:
        return b""
    edges = np.flatnonzero(np.diff(a)) + 1
    starts, ends = np.r_[0, edges], np.r_[edges, a.size]
    long_runs = np.flatnonzero(ends - starts >= 3)
    out, at = bytearray(), 0

    def literals(until: int) -> None:
        for i in range(at, until, 128):
            out.append(min(128, until - i) - 1)
            out.extend(data[i : min(i + 128, until)])

    for k in long_runs:
        literals(int(starts[k]))
        left = int(ends[k] - starts[k])
        while left:
            n = min(left, 128)
            out += bytes((0, data[starts[k]])) if n == 1 else bytes((257 - n, data[starts[k]]))
            left -= n
        at = int(ends[k])
    literals(a.size)
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out[:size])


def lzw_width(codes: int) -> int:
    """Bits of the next code when the writer's table has so many entries; the reader's is one entry behind."""
    return 9 if codes < 512 else 10 if codes < 1024 else 11 if codes < 2048 else 12


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, code width grows one code early, as TIFF asks."""
    table, out, held, bits, width = {bytes((i,)): i for i in range(256)}, bytearray(), 0, 0, 9
    next_code, word = 258, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(256)
    for value in data:
        grown = word + bytes((value,))
        if grown in table:
            word = grown
            continue
        put(table[word])
        table[grown] = next_code
        next_code += 1
        width = lzw_width(next_code)
        if next_code == 4094:
            put(256)
            table, next_code, width = {bytes((i,)): i for i in range(256)}, 258, 9
        word = bytes((value,))
    if word:
        put(table[word])
        width = lzw_width(next_code + 1)
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, table, width, held, bits, last = bytearray(), list(base), 9, 0, 0, None
    for value in data:
        held, bits = held << 8 | value, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out += entry
        last = entry
        width = lzw_width(len(table) + 1)
    return bytes(out[:size])


def squeeze(data: bytes, compression: int) -> bytes:
    if compression == LZW:
        return lzw_encode(data)
    if compression == PACKBITS:
        return packbits_encode(data)
    return zlib.compress(data, 1) if compression == DEFLATE else data


def unsqueeze(data: bytes, compression: int, size: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return packbits_decode(data, size)
    if compression == NONE:
        return data[:size]
    raise ValueError(f"compression {compression}")


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 1024, tile: int = 0) -> bytes:
    """One image directory per page of uint8 samples, (rows, columns) or (rows, columns, samples)."""
    out, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), 4
    for page in pages:
        cube = page.reshape(page.shape[0], page.shape[1], -1)
        rows, columns, samples = cube.shape
        high, wide = (tile, tile) if tile else (rows_per_strip, columns)
        offsets, counts = [], []
        for top in range(0, rows, high):
            for left in range(0, columns, wide):
                part = cube[top : top + high, left : left + wide]
                if tile:
                    part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate((part[:, :1], np.diff(part, axis=1)), axis=1)
                data = squeeze(part.tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        fields = [
            (WIDTH, 4, [columns]), (LENGTH, 4, [rows]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]),
            (PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]),
        ]
        if tile:
            fields += [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)]
        else:
            fields += [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [high]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, kind, values in sorted(fields):
            data = struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(data) > 4:
                out += b"\0" * (len(out) % 2)
                data, at = struct.pack("<I", len(out)), data
                out += at
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


def decode(data: bytes):
    """Yield (array of rows x columns x samples, compression, predictor) for each directory; cycles end the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        tags = {}
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in FIELD:
                size = struct.calcsize(FIELD[kind]) * count
                where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{FIELD[kind]}", data, where)
        rows, columns, samples = tags[LENGTH][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0]
        compression, predictor = tags.get(COMPRESSION, (NONE,))[0], tags.get(PREDICTOR, (1,))[0]
        if any(b != 8 for b in tags.get(BITS, (1,))) or tags.get(PLANAR, (1,))[0] != 1 or predictor not in (1, 2):
            raise ValueError("only 8-bit chunky samples with predictor 1 or 2")
        if not rows or not columns or not samples:
            raise ValueError("an image without pixels")
        tiled = TILE_OFFSETS in tags
        high = tags[TILE_LENGTH][0] if tiled else min(rows, tags.get(ROWS_PER_STRIP, (rows,))[0])
        wide = tags[TILE_WIDTH][0] if tiled else columns
        offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
        if not high or not wide:
            raise ValueError("strips or tiles without pixels")
        across = -(-columns // wide)
        if min(len(offsets), len(counts)) < across * -(-rows // high):
            raise ValueError("strips or tiles are missing")
        # No data can decode to more than this, so a forged size is found before room is made for it.
        if max(rows * columns, high * wide) * samples > EXPANDS.get(compression, 1) * sum(min(c, len(data)) for c in counts):
            raise ValueError("more pixels than the data can hold")
        cube = np.zeros((rows, columns, samples), np.uint8)
        for k, (offset, count) in enumerate(zip(offsets, counts)):
            top, left = k // across * high, k % across * wide
            tall = high if tiled else min(high, rows - top)
            raw = unsqueeze(data[offset : offset + count], compression, tall * wide * samples)
            part = np.frombuffer(raw, np.uint8).reshape(tall, wide, samples)
            if predictor == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            cube[top : top + tall, left : left + wide] = part[: rows - top, : columns - left]
        yield cube, compression, predictor
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def tiff_pages(df: DataFrame, id_col: str = "doc_id", data_col: str = "data") -> DataFrame:
    """One row per page of every TIFF in `data_col`.

    A null, empty or broken file gives one row with page -1 and its `error`, after the pages before the damage; an
    image of many pages gives as many rows, in directory order; repeated ids give repeated pages. An empty table gives
    none. Rows leave a task as soon as they hold BATCH_BYTES, so a file of very many pages needs no more room.
    """
    schema = arrow_schema(PAGE_SCHEMA)

    def rows(batches):
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    for page, (cube, compression, predictor) in enumerate(decode(data or b"")):
                        yield key, page, cube.shape[1], cube.shape[0], cube.shape[2], compression, predictor, cube.tobytes(), None
                except (ValueError, KeyError, IndexError, OverflowError, struct.error, zlib.error) as e:
                    yield key, -1, None, None, None, None, None, None, str(e)

    def run(batches):
        held, size = [], 0

        def full():
            return pa.RecordBatch.from_pydict({name: list(c) for (name, _), c in zip(PAGE_SCHEMA, zip(*held))}, schema=schema)

        for row in rows(batches):
            held.append(row)
            size += len(row[7] or b"") + 64
            if size > BATCH_BYTES:
                yield full()
                held, size = [], 0
        if held:
            yield full()

    bounded_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("k"), df[data_col].cast("binary").alias("d")).mapInArrow(run, ddl(PAGE_SCHEMA))


MEDIA_SCHEMA = [
    ("doc_id", "long"), ("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"),
    ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("pages", "int"), ("compression", "int"), ("tiled", "boolean"),
]
#: Payload columns of a page, of which the payload of a text is a multiple; rows of a page at most.
COLUMNS, PAGE_ROWS = 64, 4096
#: The forms a text is stored in, one of them by its digest: compression, predictor and tile size (0: strips).
FORMS = [(DEFLATE, 2, 0), (DEFLATE, 1, 64), (LZW, 2, 0), (PACKBITS, 1, 64)]


def page_feature(pixels: np.ndarray) -> str:
    """Whole-number statistics of an image: mean and variance (both x 1000), edges, and a 64-bit column hash."""
    flat, n = pixels.astype(np.int64), pixels.size
    total = int(flat.sum())
    columns = flat.sum(axis=0)
    bits = int("".join("1" if x * columns.size > total else "0" for x in columns.tolist()), 2)
    edges = int((np.abs(np.diff(flat, axis=1)) > 32).sum())
    return f"{1000 * total // n}:{1000 * (n * int((flat * flat).sum()) - total * total) // (n * n)}:{edges}:{bits:016x}"


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a TIFF of pages of 64 columns, read all its pages back, and describe them.

    The digest of the text decides its form: deflate, LZW or PackBits, strips or tiles, with or without predictor. A
    null text counts as empty and is stored as 64 zero bytes. Equal texts give equal values. A text of any length has
    as many pages as it needs; repeated rows give repeated results, an empty table none.
    """
    def rows(batch):
        out = {name: [] for name, _ in MEDIA_SCHEMA}
        for key, text in zip(batch["k"], batch["t"]):
            data = (text or "").encode()
            payload = data + b"\0" * (COLUMNS - len(data) if not data else -len(data) % COLUMNS)
            compression, predictor, tile = FORMS[zlib.crc32(payload) % len(FORMS)]
            image = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
            media = encode([image[i : i + PAGE_ROWS] for i in range(0, len(image), PAGE_ROWS)], compression, predictor, tile=tile)
            pages = [cube[:, :, 0] for cube, _, _ in decode(media)]
            pixels = np.concatenate(pages)
            back = pixels.tobytes()
            row = (
                key, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media),
                hashlib.sha256(media).hexdigest(), page_feature(pixels), len(pages), compression, tile > 0,
            )
            for (name, _), value in zip(MEDIA_SCHEMA, row):
                out[name].append(value)
        return out

    return map_columns(df, [df[id_col].cast("long").alias("k"), df[text_col].cast("string").alias("t")], rows, MEDIA_SCHEMA)
