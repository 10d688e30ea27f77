"""Line dedup by pairwise alignment: documents that share a run of lines are
aligned by patience diff, and aligned runs go from the later document.

Lines are compared after trimming; blank lines do not count.  A run is a shortest
sequence of neighbouring lines with ``min_words`` words, counted from its first
line or from its last; together the runs cover every longer common block.  A run
that more than one document holds, whatever their number, belongs to the document
of the smallest id, its owner.  A later document is aligned with every owner of
its runs, never with all holders, so a run that n documents hold gives n - 1
pairs.

Alignment of a pair: runs that both documents hold once must stand in the same
order in both, the longest such sequence is taken.  Runs that either document
holds several times have no place of their own and always go.

Words are separated by white space; in scripts that are written without spaces
(Chinese, Japanese, Thai and others) two characters count as a word.

Defined results: null texts stay null, texts without a repeated block stay as
they are, byte for byte.  Documents with equal ids are never aligned with each
other, so repeated rows get equal results; rows of one id with different texts
are told apart by a hash of the text.  Rows with a null id are left alone.  All
other columns pass through, whatever their names.  A tie between runs of equal
hashes does not arise within an owner: its first copy counts; of equally long
sequences in the same order the one that ends first in the owner is taken.  A very
long text is read whole; the memory of a task is that of its longest text and a
bounded number of runs.  A lone common line of ``min_words`` words is a block like
any other: every copy but the owner's goes, in however many documents it stands.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import chunks, free_name, map_arrow, place, plain, stored, written
from postlake.session import delete

MIN_WORDS = 5

RUNS = "doc_id bigint, th bigint, pos int, size int, copies int, h1 bigint, h2 bigint"

# Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han.
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
                      "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def words_of(line: bytes) -> int:
    if line.isascii():
        return len(line.split())
    spaced, n = UNSPACED.subn(" ", line.decode("utf-8", "replace"))
    return max(1, len(spaced.split()) + (n + 1) // 2)


def runs_of(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first line, lines) of the shortest runs of ``min_words`` words that start
    or end at each line."""
    found, end, held = [], 0, 0
    for start in range(len(words)):  # words[start:end] is the run from start
        while end < len(words) and held < min_words:
            held += words[end]
            end += 1
        if held < min_words:
            break
        found.append((start, end - start))
        held -= words[start]
    known, start, held = set(found), 0, 0
    for end, n in enumerate(words):
        held += n
        while held - words[start] >= min_words:
            held -= words[start]
            start += 1
        if held >= min_words and (start, end + 1 - start) not in known:
            found.append((start, end + 1 - start))
    return found


#: Runs in one record batch.  Texts of a batch are held once, runs never with them: a
#: long document has as many runs as lines.
RUN_ROWS = 20_000


def _runs(min_words: int):
    def records(rows: pa.RecordBatch, row: list[int], pos, sizes, copies, digests) -> pa.RecordBatch:
        both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        taken = rows.take(pa.array(row, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [*taken.columns, pa.array(pos, pa.int32()), pa.array(sizes, pa.int32()), pa.array(copies, pa.int32()),
             pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "th", "pos", "size", "copies", "h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every run: its first line among those that are not blank, its number of
        lines, how often the document holds it, hashes."""
        for batch in chunks(batches, "text"):
            ids, texts = batch.select(["doc_id", "th"]), batch.column("text")
            held: tuple[list, ...] = ([], [], [], [], [])
            for i in range(len(ids)):
                lines = [x for x in (line.strip() for line in (texts[i].as_py() or b"").split(b"\n")) if x]
                found = runs_of([words_of(x) for x in lines], min_words)
                own = [xxhash.xxh3_128_digest(b"\n".join(lines[at:at + n])) for at, n in found]
                times = Counter(own)
                for start in range(0, len(found), RUN_ROWS):
                    part = found[start:start + RUN_ROWS]
                    digests = own[start:start + RUN_ROWS]
                    for column, values in zip(held, ([i] * len(part), [at for at, _ in part], [n for _, n in part],
                                                     [times[x] for x in digests], digests)):
                        column += values
                    if len(held[0]) >= RUN_ROWS:
                        yield records(ids, *held)
                        held = ([], [], [], [], [])
            if held[0]:
                yield records(ids, *held)
    return run


def longest_increasing(values: list) -> list[int]:
    """Indexes of a longest strictly increasing subsequence."""
    tails: list = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(rows: list[tuple[int, int, int, bool]]) -> list[int]:
    """Line numbers of the later document that go.  ``rows``: (first line, lines,
    first line in the owner, held once by both) of the shared runs, in order."""
    once = [r for r in rows if r[3]]
    if any(a[2] > b[2] for a, b in zip(once, once[1:])):
        once = [once[i] for i in longest_increasing([(r[2], r[1]) for r in once])]
    return sorted({line for r in [*once, *(r for r in rows if not r[3])] for line in range(r[0], r[0] + r[1])})


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = [patience([(x["pos"], x["size"], x["owner_pos"], x["once"]) for x in rows])
                for rows in batch.column("rows").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), pa.array(gone, pa.list_(pa.int32()))],
            names=["doc_id", "th", "gone"])


def repeated_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, gone): for documents with blocks to delete, the sorted
    numbers of those lines, counted from 0 among the lines that are not blank.  The
    tables of runs are deleted before it returns."""
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("th"),
                         F.col(text_col).cast("binary").alias("text")).where("doc_id is not null and text is not null")
    runs, runs_at = written(map_arrow(narrow, _runs(min_words), RUNS), "runs")
    # The owner of every shared run.
    shared = (runs.groupBy("h1", "h2")
              .agg(F.min(F.struct("doc_id", "th", "pos", "copies")).alias("own"), F.max("doc_id").alias("last"))
              .where("last > own.doc_id")
              .select("h1", "h2", F.col("own.doc_id").alias("owner"), F.col("own.th").alias("owner_th"),
                      F.col("own.pos").alias("owner_pos"), F.col("own.copies").alias("owner_copies")))
    # Stored, so that the join deals both sides itself and can split a common run.
    shared, shared_at = written(shared, "shared")
    later = runs.join(shared, ["h1", "h2"]).where("doc_id > owner")
    once = ((F.col("copies") == 1) & (F.col("owner_copies") == 1)).alias("once")
    rows = F.array_sort(F.collect_set(F.struct("pos", "size", "owner_pos", once)))
    pairs = later.groupBy("doc_id", "th", "owner", "owner_th").agg(rows.alias("rows"))
    gone = map_arrow(pairs, _align, "doc_id bigint, th bigint, gone array<int>")
    lines = stored(gone.groupBy("doc_id", "th").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")), "gone")
    for path in (runs_at, shared_at):
        delete(docs.sparkSession, path)
    return lines


def without_lines(text: bytes, gone: set[int]) -> bytes:
    """The text without the numbered lines; other lines, blank ones included, stay."""
    kept, n = [], 0
    for line in text.split(b"\n"):
        if not line.strip():
            kept.append(line)
            continue
        if n not in gone:
            kept.append(line)
        n += 1
    return b"\n".join(kept)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with repeated blocks deleted from ``text_col``, and a
    column ``lines_gone`` (bigint; ``lines_gone_2`` and so on if the table has one
    of that name) with the number of deleted lines."""
    own, names = plain(docs)
    id_at, text_at = place(names, id_col), place(names, text_col)
    gone = repeated_blocks(own, id_at, text_at, **options).withColumnsRenamed({"doc_id": "gone_id", "th": "gone_th"})
    joined = own.join(gone.hint("shuffle_hash"), (F.col(id_at).cast("bigint") == F.col("gone_id"))
                      & (F.xxhash64(text_at) == F.col("gone_th")), "left")
    rest = [c for c in own.columns if c != text_at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "body"):
            texts = [without_lines(t, set(g)) if g else t
                     for t, g in zip(batch.column("body").to_pylist(), batch.column("gone").to_pylist())]
            sizes = pc.fill_null(pc.list_value_length(batch.column("gone")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.binary()), sizes],
                                             names=[*rest, "body", "lines"])

    schema = T.StructType([*(own.schema[c] for c in rest), T.StructField("body", T.BinaryType()),
                           T.StructField("lines", T.LongType())])
    done = map_arrow(joined.select(*rest, F.col(text_at).cast("binary").alias("body"), "gone"), run, schema)
    return done.select(*[F.col("body").cast("string") if c == text_at else F.col(c) for c in own.columns], "lines") \
        .toDF(*names, free_name(names, "lines_gone"))
