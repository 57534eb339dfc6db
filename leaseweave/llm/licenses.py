"""License scans: one Aho-Corasick pass over normalised words finds notices and identifier tags; tags are evaluated.

Every phrase is a sequence of words that must stand consecutively. A tag such as
`SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0` is parsed by a
shunting-yard parser; its licences become labels.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_columns

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices of the method.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge to any person": "mit",
    "apache license": "apache-2", "gnu general public license version 3": "gpl-3", "gnu general public license version 2": "gpl-2",
    "gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd",
    "eclipse public license": "epl", "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa", "cc by": "cc-by",
    "cc by nc": "cc-by-nc", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc by nd": "cc-by-nd",
    "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa", "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noderivatives": "cc-by-nd", "gpl version 2": "gpl-2", "gpl version 3": "gpl-3",
    "cc0": "cc0", "public domain": "public-domain", "all rights reserved": "proprietary", "isc license": "isc", "the unlicense": "unlicense",
}
TAG = "spdx license identifier"
TAG_TEXT = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
RANK = {"or": 1, "and": 2, "with": 3}
#: Bytes of words stay (upper case lowered), all others become one separator.
KEEP = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

SCHEMA = [
    ("doc_id", "long"), ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"),
    ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("expressions", "string"),
]


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE, TAG: ""}:
        found.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    found.make_automaton()
    return found


def parse(expression: str):
    """The expression in postfix order by a shunting-yard; None where it isn't well formed."""
    out, waiting, operand = [], [], False
    for token in TOKEN.findall(expression):
        low = token.lower()
        if token == "(":
            if operand:
                return None
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting or not operand:
                return None
            waiting.pop()
        elif low in RANK:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = False
        else:
            if operand:  # trailing prose after a whole expression
                break
            out.append(low)
            operand = True
    while waiting:
        if waiting[-1] == "(":
            return None
        out.append(waiting.pop())
    return out if operand else None


def rating(licence: str) -> float:
    """How freely one licence lets text be used: 1 permissive, 0.5 weak copyleft, 0.2 strong copyleft, 0 unknown."""
    for value, heads in ((0.5, ("lgpl", "mpl", "epl", "cc-by-sa")), (0.2, ("gpl", "agpl")), (0.0, ("cc-by-n",)), (1.0, ("mit", "apache", "bsd", "isc", "cc0", "cc-by", "unlicense", "zlib", "public-domain"))):
        if licence.startswith(heads):
            return value
    return 0.0


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """The licences an expression names and how freely it lets text be used; None where it isn't well formed.

    `or` takes the freer side, `and` the stricter one, `with` ties an exception to the licences before it.
    """
    stack: list[tuple[set[str], float]] = []
    for token in parse(expression) or []:
        if token not in RANK:
            stack.append(({token}, rating(token)))
            continue
        (right, r), (left, l) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(({f"{x} with {'+'.join(sorted(right))}" for x in left}, l))
        else:
            stack.append((left | right, max(l, r) if token == "or" else min(l, r)))
    return stack[0] if stack else None


def tag_words(raw: bytes, plain: bytes) -> list[tuple[int, int]]:
    """First word and end of the words of each tag's expression."""
    at, inside, n = 0, False, 0
    out = []
    for m in TAG_TEXT.finditer(raw):
        edges = []
        for until in (m.start(1), m.end(1)):
            part = plain[at:until]
            n += len(part.split()) - (inside and part[:1] not in (b"", b" "))
            inside, at = part[-1:] != b" " if part else inside, until
            edges.append(n)
        out.append(tuple(edges))
    return out


def notices(places: list[tuple[int, int, str]], tags: list[tuple[int, int]]) -> set[str]:
    """Labels of the notices (first word, end, phrase) that no longer one holds and that aren't part of a tag."""
    labels, reach, k = set(), -1, 0
    for first, end, phrase in sorted(places, key=lambda x: (x[0], -x[1])):
        while k < len(tags) and tags[k][1] <= first:
            k += 1
        if end > reach and not (k < len(tags) and tags[k][0] <= first):
            labels.add(NOTICES.get(phrase) or BASE[phrase])
        reach = max(reach, end)
    return labels


def scan(text: str) -> tuple:
    raw = text.encode()
    plain = raw.translate(KEEP)
    words = plain.split()
    line = (b" " + b" ".join(words) + b" ").decode()
    base, starts, places, tagged, at, n = set(), [], [], False, 0, -1
    for end, (phrase, size) in automaton().iter(line):
        n, at = n + line.count(" ", at, end + 1), end + 1  # words so far
        if phrase == TAG:
            tagged = True
            continue
        places.append((n - size, n, phrase))
        if phrase in BASE:
            starts.append(n - size)
            base.add(BASE[phrase])
    labels = notices(places, tag_words(raw, plain) if tagged else [])
    expressions, values = [], []
    if tagged:
        for m in TAG_TEXT.finditer(raw):
            if value := evaluate(m[1].decode()):
                expressions.append(f"{'+'.join(sorted(value[0]))}={value[1]:g}")
                values.append(value[1])
                labels |= value[0]
    labels |= base
    score = min(values or map(rating, labels), default=0.0)
    return (
        len(words), len(starts), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score, "; ".join(expressions),
    )


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base phrase places, labels, licence expressions, and `score`.

    score says how freely the text may be used by what it states: the least value of its tags' expressions, else of
    its labels; 0 where nothing is stated. Of notices of which one holds the other the longer counts. A null text
    counts as empty (no words, null places, empty labels). A malformed expression adds no label. Repeated rows give
    repeated results, an empty table none; time goes by the length of the text.
    """
    def rows(batch):
        out = [(k, *scan(t or "")) for k, t in zip(batch["k"], batch["t"])]
        return {name: list(c) for (name, _), c in zip(SCHEMA, zip(*out))}

    return map_columns(df, [df[id_col].cast("long").alias("k"), df[text_col].cast("string").alias("t")], rows, SCHEMA)
