"""License scan: an Aho-Corasick automaton finds notice phrases and identifier
tags, a shunting-yard parser evaluates the licence expressions after the tags.

Defined results: a null text counts as empty; an empty text has no words, null
positions, empty labels and score 0.  Whole texts are read, however long.  Each
row is judged on its own, so repeated rows get equal results; columns other
than the two named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import ASCII_LOWER, WORD_BYTES, chunks, map_arrow

# The phrases of the contract.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# The method's own notice phrases.
NOTICE_PHRASES = {
    "affero general public license": "agpl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "cc by": "cc",
    "creative commons": "cc",
    "eclipse public license": "epl",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "zlib license": "zlib",
}

# Words of an identifier tag as they stand after splitting "SPDX-License-Identifier:".
TAG_PHRASES = ("spdx license identifier", "spdx license expression")
TAG = re.compile(rb"spdx-license-(?:identifier|expression):[ \t]*")
TOKEN = re.compile(rb"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")

# Licence families by the start of an identifier, and how much they restrict:
# 0 permissive, 1 weak copyleft, 2 strong copyleft, 3 unknown.
FAMILIES = (
    ("agpl-", "agpl", 2), ("apache-", "apache", 0), ("bsd-", "bsd", 0), ("bsl-", "bsl", 0),
    ("cc-by-sa", "cc", 2), ("cc-by-nc", "cc", 3), ("cc", "cc", 0), ("epl-", "epl", 1),
    ("gpl-", "gpl", 2), ("isc", "isc", 0), ("lgpl-", "lgpl", 1), ("mit", "mit", 0),
    ("mpl-", "mpl", 1), ("unlicense", "unlicense", 0), ("zlib", "zlib", 0),
)
LEVELS = ("permissive", "weak copyleft", "strong copyleft", "unknown")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
          "base_labels string, labels string, score double, expressions array<string>, restriction string")
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("expressions", pa.list_(pa.string())), ("restriction", pa.string()),
])


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES), ("tag", dict.fromkeys(TAG_PHRASES, ""))):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase)))
    found.make_automaton()
    return found


def family(identifier: str) -> tuple[str, int]:
    name = identifier.lower()
    return next(((label, level) for start, label, level in FAMILIES if name.startswith(start)), (name, 3))


def expression_tokens(data: bytes, start: int) -> Iterator[str]:
    """Tokens from ``start`` for as long as they can continue an expression:
    operands and operators alternate, brackets match, the line goes on."""
    operand_next, depth = True, 0
    while match := TOKEN.match(data, start):
        token = match[1].decode("ascii")
        word = token.lower()
        if operand_next:
            if token == ")" or word in PRECEDENCE:
                return
            operand_next, depth = token == "(", depth + (token == "(")
        elif word in PRECEDENCE:
            operand_next = True
        elif token == ")" and depth:
            depth -= 1
        else:
            return
        yield token
        start = match.end()


def postfix(tokens: list[str]) -> list[str]:
    """Shunting yard: WITH binds before AND before OR.  Trailing operators and
    open brackets are dropped."""
    while tokens and (tokens[-1] == "(" or tokens[-1].lower() in PRECEDENCE):
        tokens = tokens[:-1]
    out: list[str] = []
    yard: list[str] = []
    for token in tokens:
        word = token.lower()
        if token == "(":
            yard.append(token)
        elif token == ")":
            while yard and yard[-1] != "(":
                out.append(yard.pop())
            if yard:
                yard.pop()
        elif word in PRECEDENCE:
            while yard and yard[-1] != "(" and PRECEDENCE[yard[-1]] >= PRECEDENCE[word]:
                out.append(yard.pop())
            yard.append(word)
        else:
            out.append(token)
    out.extend(x for x in reversed(yard) if x != "(")
    return out


def evaluate(tokens: list[str]) -> tuple[str, list[str], int] | None:
    """Canonical text, labels and level of an expression: AND takes the more
    restrictive side, OR the less, an exception lifts strong copyleft to weak."""
    stack: list[tuple[str, list[str], int]] = []
    for token in postfix(tokens):
        if token not in PRECEDENCE:
            label, level = family(token)
            stack.append((token, [label], level))
            continue
        if len(stack) < 2:
            return None
        (text_b, labels_b, b), (text_a, labels_a, a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((f"{text_a} WITH {text_b}", labels_a, 1 if a == 2 else a))
        else:
            level = max(a, b) if token == "and" else min(a, b)
            stack.append((f"({text_a} {token.upper()} {text_b})", labels_a + labels_b, level))
    return stack[-1] if len(stack) == 1 else None


def scan_text(data: bytes) -> tuple:
    """All result columns but the id, for one text."""
    tokens = data.translate(WORD_BYTES).split()
    line = b" " + b" ".join(tokens) + b" "
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    notices = tags = at = word = 0
    for end, (kind, label, size) in automaton().iter(line.decode("latin-1")):
        start = end - size - 1
        if kind == "base":
            # Matches come by their ends, so a start may lie before the last one.
            word = word + line.count(b" ", at, start) if start >= at else word - line.count(b" ", start, at)
            at = start
            base.append(word)
            base_labels.add(label)
        elif kind == "notice":
            notices += 1
            labels.add(label)
        else:
            tags += 1
    expressions: list[str] = []
    level = -1
    if tags:
        for match in TAG.finditer(data.translate(ASCII_LOWER)):
            result = evaluate(list(expression_tokens(data, match.end())))
            if result:
                expressions.append(result[0])
                labels.update(result[1])
                level = max(level, result[2])
    labels |= base_labels
    score = 1.0 - 0.4 ** len(base) * 0.5 ** notices * 0.1 ** len(expressions)
    return (len(tokens), len(base), min(base, default=None), max(base, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, expressions,
            LEVELS[level] if level >= 0 else None)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        rows = [scan_text(x or b"") for x in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id"), *map(list, zip(*rows))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) if isinstance(c, list) else c for c, t in zip(columns, ARROW.types)], schema=ARROW)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: places of the base phrases, labels, expressions
    found after identifier tags, and a score from 0 to 1 that grows with the
    evidence.  One map-only pass."""
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(narrow, _scan, SCHEMA)
