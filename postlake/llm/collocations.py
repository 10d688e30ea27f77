"""Phrase collocations by best-first branch-and-bound growth of prefixes.

Texts are cut into pieces and words; a phrase is two or three neighbouring words
of a piece, and everything is counted per language.  Cutting a phrase of count a
into parts of counts l and r gives floor(10^6 a^2 / (l r)); the lowest cut is its
score.  A phrase that grows from the prefix p has a <= f(p), and its first cut has
l = f(first word) and r >= a, so its score is at most f(p) / f(first word): the
bound of the node p.  Nodes are expanded best first, in waves.  A wave goes down
to a threshold per language: every node whose bound reaches it is expanded to the
right, and every phrase whose score reaches it to the left too, so that for each
phrase at or above the threshold all longer phrases that could drop it are known.
A language is settled once the threshold has at least ``top`` survivors at or
above it, ties included, or there is nothing below it; the others go on with a
threshold that admits ``STEP`` times as many pairs.

Counting is a scan of the corpus for each length and wave: tasks count in packed
numpy keys, and only distinct phrases of a task are shuffled.  A scan leaves out
what cannot count, by Bloom filters of bounded size over the words and pairs that
reached ``least``, and over the frontier: whatever they let through too much
is counted exactly and falls to the exact conditions afterwards.  Words, pairs,
frontier and thresholds are tables; the driver sees filters of bounded size and a
number per wave.

Defined results: null and empty texts have no words; a null language is ``und``
(so is the label "und").  Rows are not identified: a repeated row counts again.
Equal scores are ordered by a, then by the phrase's bytes.  Texts of any length
are counted whole, in blocks of words.  An empty table gives no phrases.
Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import chunks, map_arrow, stored

TOP, LEAST, DROP_SHARE, MOST_WORDS = 2000, 10, 50, 3
FIRST, STEP = 4, 8  # pairs admitted by the first threshold, in multiples of ``top``, and the growth from wave to wave
TOKENS = 1 << 17  # counted at a time
# That a task holds before it hands them on: smaller tables keep an executor's memory
# down, and cost more rows to combine after the shuffle.
WORDS, KEYS = 200_000, 400_000
OUT_ROWS = 50_000
BITS_AN_ITEM, MOST_BITS = 16, 1 << 27  # of a filter: 16 MB at most
NAMED_LANGUAGES = 1000  # that a scan is told to skip to; with more it reads all

# A-Z are lower-cased, a tab is a space, and separators of pieces are line feeds.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
_ID_BITS = 21
_MASK = np.int64((1 << _ID_BITS) - 1)
_GAP = b""


def blocks_of(texts: Iterator[bytes], size: int) -> Iterator[list[bytes]]:
    """Words of the texts with a gap (an empty word) behind every piece, in blocks
    of about TOKENS words that end with a piece.  Only a piece longer than a block
    is cut; its parts overlap by ``size`` - 1 words, so that each phrase of
    ``size`` words lies in exactly one block."""
    held: list[bytes] = []
    for text in texts:
        for piece in text.translate(_TABLE).split(b"\n"):
            words = piece.split()
            if len(words) > TOKENS:
                for start in range(0, len(words), TOKENS):
                    yield words[start:start + TOKENS + size - 1]
            elif words:
                held += words
                held.append(_GAP)
                if len(held) >= TOKENS:
                    yield held
                    held = []
    if held:
        yield held


# --- Filters ------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode()) & 0x7FFFFFFF
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mix(_mix(first) + second)


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(4):
        yield ((hashes + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def contains(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in _places(hashes, len(filter_) * 64):
        found &= (filter_[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


def bloom(items: DataFrame, columns: list[str], most_bits: int = MOST_BITS) -> np.ndarray:
    """Bits (64 in a number) of the rows' phrases: ``columns`` are one or two words."""
    rows = items.count()
    bits = 1 << 12
    while bits < min(BITS_AN_ITEM * rows, most_bits):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            parts = [np.concatenate([word_hashes(lang, [w]) for lang, w in zip(langs, batch.column(c).to_pylist())])
                     if langs else np.zeros(0, np.uint64) for c in columns]
            hashes = parts[0] if len(parts) == 1 else pair_hashes(*parts)
            places = np.concatenate(list(_places(hashes, bits)))
            word, bit = places >> 6, np.uint64(1) << (places & 63).astype(np.uint64)
            order = np.argsort(word, kind="stable")
            at, start = np.unique(word[order], return_index=True)
            held = np.bitwise_or.reduceat(bit[order], start) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held.view(np.int64))], names=["at", "held"])

    sent = items.select("lang", *[F.col(c).cast("binary").alias(c) for c in columns])
    got = map_arrow(sent, run, "at bigint, held bigint").groupBy("at").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[got.column("at").to_numpy()] = got.column("held").to_numpy().view(np.uint64)
    return out


# --- Counting -----------------------------------------------------------

class Counts:
    """Phrases of one language and length, counted as packed word numbers."""

    def __init__(self, lang: str, size: int, filters: dict[str, np.ndarray]):
        self.lang, self.size, self.filters = lang, size, filters
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids[_GAP]
        self.words: list[bytes] = [_GAP]
        self.hashes = np.zeros(1, np.uint64)
        self.good = np.zeros(1, bool)
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def _learn(self) -> None:
        """Hashes, and whether they can count, of the words met since."""
        if len(self.ids) > len(self.words):
            new = list(self.ids)[len(self.words):]
            self.words += new
            if "words" in self.filters or "pairs" in self.filters:
                hashes = word_hashes(self.lang, new)
                self.hashes = np.concatenate([self.hashes, hashes])
                good = contains(self.filters["words"], hashes) if "words" in self.filters else np.ones(len(new), bool)
                self.good = np.concatenate([self.good, good])

    def _pair_flags(self, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each place, whether the pair there can count, is to be grown to the
        right, or to the left."""
        distinct, back = np.unique(pairs, return_inverse=True)
        hashes = pair_hashes(self.hashes[distinct >> _ID_BITS], self.hashes[distinct & _MASK])
        return tuple(contains(self.filters[x], hashes)[back] for x in ("pairs", "right", "left"))

    def add(self, tokens: list[bytes]) -> None:
        ids = np.fromiter(map(self.ids.__getitem__, tokens), np.int64, len(tokens))
        self._learn()
        if self.size == 1:
            keys = ids[ids != 0]
        else:
            first, second = ids[:-1], ids[1:]
            real = (first != 0) & (second != 0)
            if self.size == 2:
                keys = (first << _ID_BITS | second)[real & self.good[first] & self.good[second]]
            else:
                pairs = first << _ID_BITS | second
                known, right, left = (np.zeros(len(pairs), bool) for _ in range(3))
                known[real], right[real], left[real] = self._pair_flags(pairs[real])
                hit = known[:-1] & known[1:] & (right[:-1] | left[1:])
                keys = (pairs[:-1] << _ID_BITS | ids[2:])[hit]
        distinct, n = np.unique(keys, return_counts=True)
        self.parts.append((distinct, n))
        self.held += len(distinct)
        if self.held > KEYS:
            self._merge()

    def _merge(self) -> None:
        keys, back = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n in self.parts]), len(keys)).astype(np.int64)
        self.parts, self.held = [(keys, n)], len(keys)

    def take(self) -> Iterator[pa.RecordBatch]:
        """Everything counted so far; the phrases start anew."""
        if self.parts:
            self._merge()
            keys, n = self.parts[0]
            words = pa.array(self.words, pa.binary())
            for start in range(0, len(keys), OUT_ROWS):
                part = keys[start:start + OUT_ROWS]
                columns = [words.take(pa.array(part >> _ID_BITS * (self.size - 1 - i) & _MASK)) for i in range(self.size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([self.lang] * len(part), pa.string()), *columns, pa.array(n[start:start + OUT_ROWS])],
                    names=["lang", *[f"w{i + 1}" for i in range(self.size)], "n"])
        self.__init__(self.lang, self.size, self.filters)


def count_phrases(docs: DataFrame, size: int, filters: dict[str, np.ndarray]) -> DataFrame:
    """(lang, w1, .., n) of the phrases of ``size`` words in ``docs`` (lang, text)
    that the filters let through."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # 16 MB each at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counts] = {}
        for batch in chunks(batches, "text"):
            by_lang: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(i)
            texts = batch.column("text")
            for lang, rows in by_lang.items():
                counts = held.setdefault(lang, Counts(lang, size, sent.value))
                for block in blocks_of((texts[i].as_py() for i in rows), size):
                    counts.add(block)
                    if len(counts.ids) > WORDS or counts.held > KEYS:
                        yield from counts.take()
            if sum(len(c.ids) for c in held.values()) > 2 * WORDS or sum(c.held for c in held.values()) > 2 * KEYS:
                for counts in held.values():
                    yield from counts.take()
                held.clear()
        for counts in held.values():
            yield from counts.take()

    names = [f"w{i + 1}" for i in range(size)]
    parts = map_arrow(docs, run, ", ".join(["lang string", *[f"{w} binary" for w in names], "n bigint"]))
    sums = parts.groupBy("lang", *names).agg(F.sum("n").alias("n"))
    return sums.select("lang", *[F.col(w).cast("string").alias(w) for w in names], "n")


# --- Growth -------------------------------------------------------------

def exact_floor(a: Column, b: Column, l: Column, r: Column) -> Column:
    """floor(10^6 a b / (l r)) of counts below 10^15, without rounding."""
    wide = lambda x: x.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(b) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r)).cast("bigint")


def _thresholds(pairs: DataFrame, langs: DataFrame, admitted: int) -> DataFrame:
    """(lang, tau) for ``langs``: the score of the pair numbered ``admitted``, 0 if
    there are not so many.  There are 10^6 + 1 scores, however many pairs."""
    scores = pairs.join(langs, "lang", "left_semi").groupBy("lang", "score").agg(F.count("*").alias("held"))
    down = Window.partitionBy("lang").orderBy(F.col("score").desc())
    reached = scores.withColumn("sum", F.sum("held").over(down)).where(F.col("sum") >= admitted)
    return langs.join(reached.groupBy("lang").agg(F.max("score").alias("tau")), "lang", "left").select(
        "lang", F.coalesce("tau", F.lit(0).cast("bigint")).alias("tau"))


def _score_triples(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    front = pairs.select("lang", "w1", "w2", F.col("a").alias("f12"), F.col("l").alias("f1"))
    back = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"), F.col("r").alias("f3"))
    a = F.col("a")
    both = (triples.withColumnRenamed("n", "a").join(front, ["lang", "w1", "w2"]).join(back, ["lang", "w2", "w3"])
            .withColumns({"s1": exact_floor(a, a, F.col("f1"), F.col("f23")), "s2": exact_floor(a, a, F.col("f12"), F.col("f3"))}))
    early = F.col("s1") <= F.col("s2")
    return both.select("lang", "w1", "w2", "w3", "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
                       F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, least: int = LEAST,
                 drop_share: int = DROP_SHARE, most_words: int = MOST_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """The first ``top`` phrases of every language: (lang, rank, phrase, a, l, r, n,
    score).  Phrases have 2 to ``most_words`` (2 or 3) words and count ``least``
    times at least; one is dropped if its words stand in a longer one that has
    ``drop_share`` percent of its count."""
    if most_words not in (2, 3) or top < 1 or least < 1:
        raise ValueError("most_words is 2 or 3, top and least are positive")
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.col(text_col).cast("binary").alias("text")).where(F.length("text") > 0)
    words = stored(count_phrases(docs, 1, {}).withColumnRenamed("w1", "w"), "words")
    totals = words.groupBy("lang").agg(F.sum("n").cast("bigint").alias("n"))
    common = words.where(F.col("n") >= least)
    known = bloom(common, ["w"], most_bits)
    counted = count_phrases(docs, 2, {"words": known}).where(F.col("n") >= least).withColumnRenamed("n", "a")
    a, l, r = F.col("a"), F.col("l"), F.col("r")
    pairs = stored(counted.join(common.select("lang", F.col("w").alias("w1"), F.col("n").alias("l")), ["lang", "w1"])
                   .join(common.select("lang", F.col("w").alias("w2"), F.col("n").alias("r")), ["lang", "w2"])
                   .select("lang", "w1", "w2", "a", "l", "r", exact_floor(a, a, l, r).alias("score"),
                           exact_floor(a, F.lit(1), l, F.lit(1)).alias("bound")), "pairs")
    taus = totals.select("lang", F.lit(0).cast("bigint").alias("tau"))
    triples = None
    if most_words == 3:
        triples, taus = _grow(docs, pairs, stored(totals.select("lang"), "langs"), top, least, drop_share, most_bits)
    found = _survivors(pairs, triples, taus, drop_share)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _grow(docs: DataFrame, pairs: DataFrame, langs: DataFrame, top: int, least: int, drop_share: int,
          most_bits: int) -> tuple[DataFrame, DataFrame]:
    """The triples (scored) that the waves have counted, and the threshold (lang,
    tau) at which each language was settled."""
    known = bloom(pairs, ["w1", "w2"], most_bits)
    open_, before, done, triples = langs, None, None, None
    admitted = FIRST * top
    while True:
        taus = stored(_thresholds(pairs, open_, admitted), "taus")
        frontier = pairs.join(taus, "lang")
        if before is not None:  # what lies above the last threshold is expanded
            frontier = frontier.join(before.select("lang", F.col("tau").alias("was")), "lang")
        else:
            frontier = frontier.withColumn("was", F.lit(1 << 60))
        right, left = (frontier.where((F.col(x) >= F.col("tau")) & (F.col(x) < F.col("was"))) for x in ("bound", "score"))
        filters = {"pairs": known, "right": bloom(right, ["w1", "w2"], most_bits), "left": bloom(left, ["w1", "w2"], most_bits)}
        names = [x.lang for x in taus.select("lang").limit(NAMED_LANGUAGES + 1).collect()]
        scanned = docs if len(names) > NAMED_LANGUAGES else docs.where(F.col("lang").isin(names))
        wave = count_phrases(scanned, 3, filters).where(F.col("n") >= least)
        wave = stored(_score_triples(wave, pairs), "triples")
        # A triple can be met in two waves, with the same counts.
        triples = wave if triples is None else stored(triples.union(wave).distinct(), "triples")
        alive = _survivors(pairs, triples, taus, drop_share).groupBy("lang").agg(F.count("*").alias("alive"))
        state = stored(taus.join(alive, "lang", "left").withColumn(
            "settled", (F.col("tau") == 0) | (F.coalesce("alive", F.lit(0)) >= top)), "state")
        now = state.where("settled").select("lang", "tau")
        done = now if done is None else done.union(now)
        before = state.where("not settled").select("lang", "tau")
        open_ = before.select("lang")
        if open_.isEmpty():
            return triples, done
        admitted *= STEP


def _survivors(pairs: DataFrame, triples: DataFrame | None, taus: DataFrame, drop_share: int) -> DataFrame:
    """Candidates at or above the thresholds that no longer one drops."""
    found = pairs.select("lang", "w1", "w2", F.lit(None).cast("string").alias("w3"), "a", "l", "r", "score")
    if triples is not None:
        longer = (triples.select("lang", "w1", "w2", "a").union(triples.select("lang", "w2", "w3", "a"))
                  .toDF("lang", "w1", "w2", "most").groupBy("lang", "w1", "w2").agg(F.max("most").alias("most")))
        kept = found.join(longer, ["lang", "w1", "w2"], "left").where(
            F.col("most").isNull() | (100 * F.col("most") < drop_share * F.col("a"))).drop("most")
        found = kept.unionByName(triples)
    return (found.join(taus, "lang").where(F.col("score") >= F.col("tau"))
            .select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "l", "r", "score"))
