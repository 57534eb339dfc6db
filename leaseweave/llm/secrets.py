"""Secret scans: patterns over a text and, by a worklist, over every layer encoded inside it.

A layer is text. URL escapes, backslash-u escapes, base64 runs and the gzip or zlib streams in them give new
layers until no new one appears; a layer already seen at the same place of the document ends its branch (cycles).
Spans found in a layer are mapped back to the code points of the document that carry them, at each place it occurs.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_columns

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Compressed content of more bytes is read in windows of about this size, and reported as `oversize` besides. Windows end
#: at bytes that no pattern can hold, so nothing overlaps.
LAYER_BYTES, OVERLAP = 16 << 20, 0
#: ASCII that is in no match of the patterns below: neither in words, paddings and quotes nor in escapes or line ends.
BREAKS = [bytes([c]) for c in range(128) if not (chr(c).isalnum() or chr(c) in "+/_.=-:\"' \t\r\n%\\")]

ASSIGN_HEAD = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", re.I | re.A)
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
#: Starts of gzip and zlib streams, and the shortest text that can hold a secret or a further layer.
STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
STRETCH = re.compile(rb"[\t\n\r\x20-\x7e]{12}")

SCHEMA = [
    ("doc_id", "long"), ("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"),
    ("spans", "string"), ("n_layers", "long"), ("span_starts", "array<long>"), ("span_ends", "array<long>"),
]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def as_layer(data: bytes) -> tuple[str, np.ndarray] | None:
    """The text of `data` and the byte offset of each character and of the end; None if no stretch can hold a secret.

    A byte that is not UTF-8 is a character of its own, which like a control character only separates.
    """
    if not STRETCH.search(data):
        return None
    text = data.decode("utf-8", "surrogateescape")
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    wide[(code >= 0xD800) & (code < 0xE000)] = 1
    return text, np.r_[0, np.cumsum(wide)]


def undamaged(tool, piece: bytes):
    """Yield what `tool` makes of a damaged piece before it fails."""
    for i in range(len(piece)):
        rest = piece[i : i + 1]
        while rest:
            try:
                out = tool.decompress(rest, 1 << 20)
            except zlib.error:
                return
            if out:
                yield out
            rest = tool.unconsumed_tail


def inflated(data: bytes, at: int):
    """Yield the content of the gzip or zlib stream at `at` in pieces, then the place after it (None if it has no end).

    A truncated or damaged stream gives what comes before the damage.
    """
    tool = zlib.decompressobj(47)
    for i in range(at, len(data), 1024):
        piece = data[i : i + 1024]
        while piece:
            before = tool.copy()
            try:
                out = tool.decompress(piece, 1 << 20)
            except zlib.error:  # what the piece holds before the damage comes byte by byte
                yield from undamaged(before, piece)
                yield None
                return
            if out:
                yield out
            if tool.eof:
                yield min(i + 1024, len(data)) - len(tool.unused_data)
                return
            piece = tool.unconsumed_tail
    yield None


def last_break(data: bytearray, start: int) -> int:
    """The place after the last byte from `start` on that no pattern can hold; 0 if there is none."""
    return max(data.rfind(c, start) for c in BREAKS) + 1


def streams(data: bytes):
    """Yield (content, whether it is a window of one larger than a layer) for the streams in `data`; members that
    follow each other are one content. A window ends at a byte that no pattern can hold, so none is cut; where there is
    none, it grows."""
    at, end, held, large, seen = 0, None, bytearray(), False, 0
    first = bool(data) and data[0] & 15 == 8 and int.from_bytes(data[:2], "big") % 31 == 0
    while True:
        if end is None or data[end : end + 3] != b"\x1f\x8b\x08":
            if held:
                yield bytes(held), large
            held, large, seen = bytearray(), False, 0
            found = None if first and at == 0 else STREAM.search(data, at)
            if not (first and at == 0) and not found:
                return
            at = found.start() if found else 0
        else:
            at = end
        end = None
        for piece in inflated(data, at):
            if isinstance(piece, bytes):
                held += piece
                if len(held) > LAYER_BYTES:
                    if cut := last_break(held, seen):
                        yield bytes(held[:cut]), True
                        held, large = held[cut:], True
                    seen = len(held)
            else:
                end = piece
        at = at + 1 if end is None else end


def all_streams(data: bytes):
    """`streams` of `data`, of their contents and so on, with their path; a content that was met before ends its branch."""
    work, known = deque([(data, "compressed")]), set()
    while work:
        source, how = work.popleft()
        for content, large in streams(source):
            yield how, content, large
            mark = hashlib.sha256(content).digest()
            if mark not in known:
                known.add(mark)
                work.append((content, f"{how}/compressed"))


def in_place(text: str, pattern: re.Pattern, decode):
    """`text` with every match of `pattern` replaced by its decoded characters, and the place of each character."""
    out, starts, ends, kept = [], [], [], 0
    for m in pattern.finditer(text):
        layer, offsets, wide = decode(m[0])
        out += [text[kept : m.start()], layer]
        starts += [np.arange(kept, m.start()), m.start() + wide * offsets[:-1]]
        ends += [np.arange(kept, m.start()) + 1, m.start() + wide * offsets[1:]]
        kept = m.end()
    if not kept:
        return None
    rest = np.arange(kept, len(text))
    return "".join([*out, text[kept:]]), np.concatenate([*starts, rest]), np.concatenate([*ends, rest + 1])


def url_run(run: str):
    data = bytes.fromhex(run.replace("%", ""))
    layer = data.decode("utf-8", "surrogateescape")
    return layer, np.r_[0, np.cumsum([1 if 0xD800 <= ord(c) < 0xE000 else len(c.encode()) for c in layer])], 3


def unicode_run(run: str):
    layer = b"".join(int(run[i + 2 : i + 6], 16).to_bytes(2, "little") for i in range(0, len(run), 6)).decode("utf-16-le", "replace")
    return layer, np.r_[0, np.cumsum([1 + (ord(c) > 0xFFFF) for c in layer])], 6


def unwrapped(text: str):
    """Yield (how, layer text, first and last source character of each layer character): escapes are decoded in place
    in the whole text. Compressed content has one place for all; a layer None says that it is larger than a layer."""
    if "%" in text and (got := in_place(text, URL, url_run)):
        yield "url", *got
    if "\\u" in text and (got := in_place(text, ESCAPES, unicode_run)):
        yield "unicode", *got
    for m in BASE64.finditer(text):
        body = m[0].rstrip("=")
        at = np.arange(m.start(), m.start() + len(body))
        if "\n" in body:  # wrapped over lines
            keep = [i for i, c in enumerate(body) if c not in "\r\n\t "]
            at, body = at[keep], "".join(body[i] for i in keep)
        body = body.replace("-", "+").replace("_", "/")
        for shift in range(4):  # other characters of a run may precede what is encoded
            part = body[shift:]
            if len(part) < 2:
                continue
            part = part[:-1] if len(part) % 4 == 1 else part
            data = base64.b64decode(part + "=" * (-len(part) % 4))
            if got := as_layer(data):
                layer, offsets = got
                place = at[shift:]
                yield "base64", layer, place[offsets[:-1] * 4 // 3], place[np.minimum(-(-offsets[1:] * 4 // 3), len(place)) - 1] + 1
            told = set()
            for how, content, large in all_streams(data):
                if large and how not in told:
                    told.add(how)
                    yield how, None, m.start(), m.end()
                if got := as_layer(content):
                    yield how, got[0], m.start(), m.end()


def scan(text: str) -> tuple:
    base = base_spans(text)
    spans = [(s, k, f"{KINDS[k]}:{s}:{e}", e) for s, k, e in base]
    visited, texts, read = set(), {text}, {}

    def parts(layer):
        """What a layer holds, read once however often it occurs; large ones are not remembered."""
        if layer in read:
            return read[layer]
        if len(layer) > 1 << 20:
            return base_spans(layer), unwrapped(layer)
        read[layer] = base_spans(layer), list(unwrapped(layer))
        return read[layer]

    def walk(layer, path, first, last, known):
        work = deque([(layer, path, first, last, known)])
        while work:
            source, path, first, last, known = work.popleft()
            one = isinstance(first, int)  # all characters have one place
            found, inner = parts(source)
            if path:
                mapped = [(k, first, last) if one else (k, int(first[s]), int(last[e - 1])) for s, k, e in found]
                spans.extend((s, 3 + k, f"{path}{KINDS[k]}:{s}:{e}", e) for k, s, e in mapped if (k, s, e) not in known)
                known = known | set(mapped)
            for how, layer, starts, ends in inner:
                if one:
                    starts, ends = first, last
                elif first is not None:
                    starts, ends = (int(first[starts]), int(last[ends - 1])) if isinstance(starts, int) else (first[starts], last[ends - 1])
                name = f"{path}{how}/"
                if layer is None:
                    spans.append((starts, 3, f"{name}oversize:{starts}:{ends}", ends))
                    continue
                mark = layer if len(layer) <= 1 << 20 else hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest()
                place = (mark, starts, ends) if isinstance(starts, int) else (mark, int(starts[0]), int(ends[-1]))
                if place in visited:  # the same by another route, or a cycle
                    continue
                visited.add(place)
                texts.add(mark)
                inside = known if how in ("url", "unicode") else frozenset()
                if len(layer) > 1 << 20:
                    walk(layer, name, starts, ends, inside)
                else:
                    work.append((layer, name, starts, ends, inside))

    walk(text, "", None, None, frozenset((k, s, e) for s, k, e in base))
    spans = sorted(set(spans))
    joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
    kinds = [k for _, k, _ in base]
    return (
        kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined.encode()).hexdigest(),
        ",".join(x[2] for x in spans), len(texts) - 1, [x[0] for x in spans], [x[3] for x in spans],
    )


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and digest of the base spans, all spans with those of decoded layers, layers read.

    A null text counts as empty: no spans, the digest of the empty string. Repeated rows give repeated results.
    """
    def rows(batch):
        out = [(k, *scan(t or "")) for k, t in zip(batch["k"], batch["t"])]
        return {name: list(c) for (name, _), c in zip(SCHEMA, zip(*out))}

    return map_columns(df, [df[id_col].cast("long").alias("k"), df[text_col].cast("string").alias("t")], rows, SCHEMA)


def mask_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", chars_col: str = "n_chars") -> DataFrame:
    """`df` with every secret span of `text_col`, decoded layers included, replaced by `mark`; all rows and columns stay.

    Overlapping spans are replaced once. Null texts stay null. A column `chars_col` gets the new length.
    """
    at = df.columns.index(text_col)

    def mask(text):
        if not text:
            return text
        *_, starts, ends = scan(text)
        out, kept = [], 0
        for s, e in zip(starts, ends):
            if e <= kept:
                continue
            if s >= kept:
                out += [text[kept:s], mark]
            kept = e
        return "".join([*out, text[kept:]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = pa.array([mask(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), column)

    bounded_batches(df.sparkSession)
    out = df.mapInArrow(run, df.schema)
    if chars_col not in df.columns:
        return out
    return out.withColumn(chars_col, F.when(F.col(text_col).isNotNull(), F.char_length(text_col)).otherwise(F.col(chars_col)).cast(df.schema[chars_col].dataType))
