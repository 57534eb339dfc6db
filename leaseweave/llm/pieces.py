"""Merge-type subword encoding by backtracking, exactly as the public library encodes, and decoding.

A chunk is a run of spaces (as U+2581) and the word after it: no piece of the vocabulary reaches over a chunk's
start, which is checked when a model is read. In a chunk an Aho-Corasick automaton gives all pieces that start at
each character; the longest is tried first, and two neighbours are compatible if merging their joined text again
gives just these two. A bitfield marks positions from which no encoding was found. Equal chunks are encoded once.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_columns

SPACE = "▁"
#: Chunks and pairs that a worker remembers in each of two generations; older ones are worked out again.
REMEMBERED = 300_000
#: Spaces and the word after them, or spaces at the end; the text has a dummy space before it.
CHUNK = re.compile(" *[^ ▁]+|[ ▁]+[^ ▁]*")
NEVER = float("-inf")

SCHEMA = [("doc_id", "long"), ("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]


class Memory:
    """A bounded map: what was not asked for since the last change of generation is forgotten."""

    def __init__(self):
        self.young, self.old = {}, {}

    def keep(self, key, value):
        if len(self.young) >= REMEMBERED:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class PieceModel:
    """A merge-type model with byte fallback, identity normaliser and dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: lib.get_score(i) for i in plain}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.control = {i for i in range(n) if lib.is_control(i)}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece reaches over the start of a word")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece) - 1))
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.pieces]
        self.shorter = [-1] * n  # the longest piece that is a true prefix
        for piece, i in self.ids.items():
            self.shorter[i] = next((self.ids[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.ids), -1)
        self.text = {i: p.replace(SPACE, " ") for p, i in self.ids.items()}
        self.shown = [f",{i}" for i in range(n)]
        self.pairs, self.chunks = Memory(), Memory()

    def merge(self, parts: list[str]) -> list[str]:
        """Merge the best-scored neighbours, the leftmost first, until none is left."""
        score = self.score.get
        best = [score(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while best and (s := max(best)) > NEVER:
            i = best.index(s)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del best[i]
            if i:
                best[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(best):
                best[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two ids stay neighbours when their joined text is merged again; left -1: at a start."""
        key = left << 20 | right
        known = self.pairs.young.get(key)
        if known is None:
            known = self.pairs.old.get(key)
            if known is None:
                b = self.pieces[right]
                if left < 0:
                    known = self.merge(list(b)) == [b]
                else:
                    a = self.pieces[left]
                    known = self.merge(list(a + b)) == [a, b]
            self.pairs.keep(key, known)
        return known

    def encode_known(self, text: str) -> list[int] | None:
        """Backtracking over pieces; None if a character of `text` isn't in the vocabulary."""
        n = len(text)
        longest = [-1] * n
        for end, (i, back) in self.automaton.iter(text):
            longest[end - back] = i
        if -1 in longest:
            return None
        size, shorter, known = self.size, self.shorter, self.pairs.young
        failed = bytearray(n + 1)  # the bitfield of positions from which nothing fits
        out: list[int] = []
        at, last, i = 0, -1, longest[0]
        while at < n:
            while i >= 0:
                end = at + size[i]
                if not failed[end]:
                    fits = known.get(last << 20 | i)
                    if fits is None:
                        fits = self.compatible(last, i)
                        known = self.pairs.young
                    if fits:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at, last = end, i
                i = longest[at] if at < n else -1
            elif out:
                failed[at] = 1
                i = out.pop()
                at -= size[i]
                last, i = out[-1] if out else -1, shorter[i]
            else:
                raise ValueError("no encoding")
        return out

    def encode_chunk(self, chunk: str) -> list[int]:
        """The ids of a chunk; characters outside the vocabulary become bytes, and no merge reaches over them."""
        chunk = chunk.replace(" ", SPACE)
        whole = self.encode_known(chunk)
        if whole is not None:
            return whole
        out, known = [], []

        def flush():
            if known:
                out.extend(self.encode_known("".join(known)))
                known.clear()

        for c in chunk:
            if c in self.ids:
                known.append(c)
            else:
                flush()
                out.extend([self.bytes[b] for b in c.encode()])
        flush()
        return out

    def chunk(self, chunk: str) -> str | tuple[str, str]:
        """The ids in decimal with a comma before each; with the text that they decode to where it isn't the chunk."""
        known = self.chunks.young.get(chunk)
        if known is None:
            known = self.chunks.old.get(chunk)
            if known is None:
                ids = self.encode_chunk(chunk)
                back = self.decode(ids, first=False)
                known = "".join([self.shown[i] for i in ids])
                if back != chunk:
                    known = (known, back)
            if len(chunk) <= 64:
                self.chunks.keep(chunk, known)
        return known

    def split(self, text: str) -> list[str]:
        return CHUNK.findall(" " + text) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for c in self.split(text) for i in self.encode_chunk(c)]

    def decode(self, ids: list[int], first: bool = True) -> str:
        """Pieces joined, U+2581 as space, bytes as UTF-8 (broken ones as U+FFFD); at a text's start a space is dropped."""
        try:
            if not first:
                return "".join([self.text[i] for i in ids])
        except KeyError:  # bytes
            pass
        out, held = [], bytearray()

        def flush():
            while held:
                try:
                    out.append(held.decode())
                    held.clear()
                except UnicodeDecodeError as e:
                    out.append(held[: e.start].decode() + "�")
                    del held[: e.start + 1]

        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                first = False
            elif i not in self.control:
                flush()
                piece = self.pieces[i]
                out.append((piece[1:] if first and piece[:1] == SPACE else piece).replace(SPACE, " "))
                first = False
        flush()
        return "".join(out)


@lru_cache(2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and digest of each text's ids, and the digest of the text decoded from them.

    `path` names the model file, which every worker can read. A null text counts as empty: no ids, and the
    digests of the empty string. Equal texts give equal rows; very long texts are taken whole.
    """
    def rows(batch):
        m = model(path)
        out = {name: [] for name, _ in SCHEMA}
        for key, text in zip(batch["k"], batch["t"]):
            chunks = m.split(text or "")
            done = [m.chunk(c) for c in chunks]
            # A character's bytes stay in one chunk, so chunks decode one by one; the dummy prefix is the first space.
            back = "".join([c if type(x) is str else x[1] for c, x in zip(chunks, done)])[1:]
            ids = "".join([x if type(x) is str else x[0] for x in done])[1:]
            out["doc_id"].append(key)
            out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
        return out

    return map_columns(df, [df[id_col].cast("long").alias("k"), df[text_col].cast("string").alias("t")], rows, SCHEMA)
