"""SimHash near-dedup by a self-join of a binary trie of fingerprints.

Fingerprints are 64 bits over word shingles.  Two fingerprints link when at most
``max_bits`` bits differ.  The trie of the distinct fingerprints is joined with
itself level by level: pairs of nodes descend together, the bits in which their
paths differ add up, and a pair is pruned as soon as its sum is beyond the
budget.  Of two halves of linked fingerprints one differs in at most half of the
budget, so two tries (one of the bits as they stand, one with the halves
swapped) are walked with the smaller budget through the upper half and the whole
budget below; every link shows in one of them.  A node paired with itself that
holds a single fingerprint is pruned too.  All levels are joins on node keys:
no group of fingerprints is ever gathered in one task, and no key has more rows
than one digit has values times the neighbours of a node.

Defined results: a null or empty text has no words and fingerprint zero, and
links like any other.  Repeated rows share a fingerprint and a component.  A row
whose id is null gets its fingerprint and the component of its group (null if
no member has an id).  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import ASCII_LOWER, chunks, map_arrow, place, plain, stored, written
from postlake.session import delete
from postlake.llm.components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
UPPER = (16, 32)  # depths walked with the half budget
LOWER = (40, 48, 56, 64)
BLOCK = 1 << 15  # hashes summed at a time


def fingerprint(data: bytes, k: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a text's k-word shingles, repeats included."""
    tokens = data.translate(ASCII_LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= k:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(k)))))
    total = np.zeros(64, np.int64)
    for start in range(0, len(shingles), BLOCK):
        part = shingles[start:start + BLOCK]
        hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in part], ">u8")
        total += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(shingles)).tobytes(), "big")


def add_fingerprints(docs: DataFrame, text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, th, fp): the id, a hash of the text and the signed fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            prints = [fingerprint(x or b"", shingle_words) for x in batch.column("text").to_pylist()]
            signed = np.array(prints, np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(signed)], names=["doc_id", "th", "fp"])

    narrow = docs.select("doc_id", F.xxhash64(text_col).alias("th"), F.col(text_col).cast("binary").alias("text"))
    return map_arrow(narrow, run, "doc_id bigint, th bigint, fp bigint")


def _prefix(key: Column, depth: int) -> Column:
    return key if depth == 64 else F.shiftrightunsigned(key, 64 - depth)


def _masks(width: int, most: int) -> list[int]:
    """All values of ``width`` bits with at most ``most`` bits set."""
    return [sum(1 << i for i in bits) for n in range(most + 1) for bits in combinations(range(width), n)]


def trie_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct links (a, b), a < b, between the distinct values of column fp."""
    half = max_bits // 2
    swapped = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    keys = prints.select(F.explode(F.array(F.struct(F.lit(0).alias("t"), F.col("fp").alias("key")),
                                           F.struct(F.lit(1).alias("t"), swapped.alias("key")))).alias("x")).select("x.*")
    depth, pairs = 0, None
    for level in UPPER + LOWER:
        width = level - depth
        nodes = keys.groupBy("t", _prefix(F.col("key"), level).alias("node")).agg(F.count("*").alias("held"))
        child = nodes.select(
            "t", (F.shiftrightunsigned("node", width) if depth else F.lit(0)).cast("bigint").alias("up"),
            "node", "held")
        budget = half if level in UPPER else max_bits
        left = child.select("t", F.col("up").alias("a"), F.col("node").alias("na"))
        right = child.select("t", F.col("up").alias("b"), F.col("node").alias("nb"), F.col("held").alias("hb"))
        if pairs is None:
            begun = left.withColumn("b", F.lit(0).cast("bigint")).withColumn("bits", F.lit(0))
        else:
            begun = pairs.join(left, ["t", "a"])
        if level in UPPER:
            # Few bits may differ here: name the other digit instead of trying all.
            masks = F.array(*[F.struct(F.lit(m).cast("bigint").alias("mask"), F.lit(m.bit_count()).alias("n"))
                              for m in _masks(width, budget)])
            digit = F.col("na").bitwiseAND(F.lit((1 << width) - 1))
            named = (begun.select("t", "a", "b", "na", "bits", F.explode(masks).alias("m"))
                     .where(F.col("bits") + F.col("m.n") <= budget)
                     .select("t", "na", F.shiftleft("b", width).bitwiseOR(digit.bitwiseXOR(F.col("m.mask"))).alias("nb"),
                             (F.col("bits") + F.col("m.n")).alias("bits"))
                     .where(F.col("na") <= F.col("nb")))
            met = named.join(right.drop("b"), ["t", "nb"])
        else:
            low = F.lit((1 << width) - 1)
            bits = F.bit_count(F.col("na").bitwiseXOR(F.col("nb")).bitwiseAND(low))
            met = (begun.join(right, ["t", "b"])
                   .where((F.col("bits") + bits <= budget) & ((F.col("a") != F.col("b")) | (F.col("na") <= F.col("nb"))))
                   .withColumn("bits", F.col("bits") + bits))
        pairs = (met.where((F.col("na") != F.col("nb")) | (F.col("hb") > 1))
                 .select("t", F.col("na").alias("a"), F.col("nb").alias("b"), "bits"))
        depth = level
    back = [F.when(F.col("t") == 0, F.col(c)).otherwise(
        F.shiftleft(c, 32).bitwiseOR(F.shiftrightunsigned(c, 32))) for c in ("a", "b")]
    return (pairs.where(F.col("a") != F.col("b"))
            .select(F.least(*back).alias("a"), F.greatest(*back).alias("b")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: (doc_id, th, fp, component_id).  ``component_id``
    is the smallest id reachable over links; ``th`` is xxhash64 of the text."""
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(add_fingerprints(own, "text", shingle_words), "prints")
    classes, classes_at = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    links, links_at = written(trie_links(classes.select("fp"), max_bits), "links")
    roots = connected_components(links).select(F.col("node").alias("fp"), "root")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.join(least, "root").select("fp", "component_id"), "components")
    for path in (classes_at, links_at):
        delete(docs.sparkSession, path)
    return prints.join(named, "fp").select("doc_id", "th", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of every component the row
    with the smallest id stays (then the smallest text hash; rows that agree in
    both are repeats, of which one stays)."""
    own, names = plain(docs)
    id_at, text_at = place(names, id_col), place(names, text_col)
    found = near_duplicates(own, id_at, text_at, shingle_words, max_bits)
    # Rows without any id have no component of their own: their print stands in.
    group = F.coalesce(F.col("component_id"), F.col("fp"))
    first = found.groupBy(group.alias("g"), F.col("component_id").isNull().alias("none")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th")).alias("first"))
    kept = first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.th").alias("kept_th"))
    marked = own.withColumns({"th": F.xxhash64(text_at), "id": F.col(id_at).cast("bigint")})
    once = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.lit(0)))
    joined = marked.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th")), "left_semi")
    return joined.withColumn("n", once).where("n = 1").select(*own.columns).toDF(*names)
