"""Language identification by Bayesian fusion of evidence.

Text likelihood: hashed byte trigrams under a multinomial model per language,
trained here on a bounded sample of labelled rows (``sample_rows`` per language,
chosen by a hash of the id) for every label that occurs.  Trigrams of one text are far from independent, so
the log likelihood counts for ``effective`` trigrams at most.  It is combined
with the language that the page declares, the country suffix of its address,
and the prior of its host.  Host priors come from grouped counts of the text
decisions over all rows, smoothed level by level: all rows, address suffix,
domain, host; a row's own decision is taken out of its host's counts.

Rows are rejected if they have no letters or their best language stays below
``least`` probability.

Defined results: null texts count as empty and are rejected, with language null;
null hosts use the prior of all rows; unknown declared languages and suffixes
say nothing.  Repeated rows get equal results.  Without any labelled row no
language is known and every row is rejected; an empty table gives an empty one.
Of languages with equal probability the first by name wins.  Texts of any length
are scored whole.  Columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import ASCII_LOWER, chunks, free_name, map_arrow, place, plain, stored

CELLS = 1 << 14  # hashed trigrams
SAMPLE_ROWS = 500
DENSE = 64  # languages; of more, tasks get only the cells that a language's texts have
EFFECTIVE = 60
LEAST = 0.5
PRIOR_WEIGHT = 20.0
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.8
BROADCAST_HOSTS = 50_000

# Country suffixes whose pages are mostly in one language.
SUFFIX_LANGUAGE = {"ar": "es", "at": "de", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr", "ie": "en",
                   "it": "it", "mx": "es", "nl": "nl", "pe": "es", "pl": "pl", "pt": "pt", "se": "sv", "uk": "en", "us": "en"}

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
_FLAT = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def trigrams(data: bytes) -> np.ndarray:
    """Hashes of the byte trigrams; everything but letters counts as a space."""
    flat = b" " + b" ".join(data.translate(_FLAT).split()) + b" "
    b = np.frombuffer(flat, np.uint8).astype(np.uint32)
    mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(32 - 14)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts per language of a partition, one row per language."""
    total: dict[str, np.ndarray] = {}
    for batch in chunks(batches, "text"):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if lang not in total:
                total[lang] = np.zeros(CELLS, np.int64)
            if text and text.translate(_FLAT).strip():
                total[lang] += np.bincount(trigrams(text), minlength=CELLS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "cell", "n"])


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of the cells (languages x cells)."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col(lang_col).alias("lang")).where(
        "lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    table = np.full((len(languages), CELLS), 0.5)
    if languages:
        shares = labelled.sparkSession.createDataFrame([(x, sample_rows / sizes[x]) for x in languages], "lang string, share double")
        place = {x: i for i, x in enumerate(languages)}
        draw = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) / 1_000_000
        sums = (map_arrow(rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select("lang", "text"), _counts, "lang string, cell bigint, n bigint")
                .groupBy("lang", "cell").agg(F.sum("n").alias("n")).groupBy("lang")
                .agg(F.collect_list(F.struct("cell", "n")).alias("cells")))
        for r in sums.collect():  # a row of CELLS numbers at most for each language
            cells = np.array([tuple(x) for x in r["cells"]], np.int64)
            table[place[r["lang"]], cells[:, 0]] += cells[:, 1]
    return languages, np.log(table / table.sum(axis=1, keepdims=True))


def scorer(table: np.ndarray):
    """Log likelihoods of the languages for cells and their counts."""
    if len(table) <= DENSE:
        table32 = np.ascontiguousarray(table.T.astype(np.float32))
        return lambda at, n: n @ table32[at]
    floor = table.min(axis=1)  # of a cell that a language's texts do not have
    above = (table - floor[:, None]).T
    cell, lang = np.nonzero(above)
    start, lang, gain = np.searchsorted(cell, np.arange(CELLS + 1)), lang.astype(np.int32), above[cell, lang].astype(np.float32)

    def score(at: np.ndarray, n: np.ndarray) -> np.ndarray:
        sizes = start[at + 1] - start[at]
        held = np.repeat(start[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return n.sum() * floor + np.bincount(lang[held], gain[held] * np.repeat(n, sizes), len(floor))
    return score


def text_scores(rows: DataFrame, model: tuple[list[str], np.ndarray], effective: int) -> DataFrame:
    """Adds ``loglik`` (array<double>, tempered, best is 0) and ``letters`` to the
    columns of ``rows``, whose column ``body`` holds the text as binary and goes."""
    languages, table = model
    kept = [c for c in rows.columns if c != "body"]
    score = scorer(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "body"):
            scores, letters = [], []
            for text in batch.column("body").to_pylist():
                flat = np.frombuffer(text or b"", np.uint8)
                n = int(LETTER[np.frombuffer((text or b"").translate(ASCII_LOWER), np.uint8)].sum()) if len(flat) else 0
                letters.append(n)
                if not n or not languages:
                    scores.append([0.0] * len(languages))
                    continue
                cells = np.bincount(trigrams(text), minlength=CELLS)
                at = np.flatnonzero(cells)
                total = score(at, cells[at].astype(np.float64))
                total = total * min(1.0, effective / cells.sum())
                scores.append((total - total.max()).tolist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(scores, pa.list_(pa.float64())), pa.array(letters, pa.int64())],
                names=[*kept, "loglik", "letters"])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("loglik", T.ArrayType(T.DoubleType())),
                           T.StructField("letters", T.LongType())])
    return map_arrow(rows, run, schema)


def argmax(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int")


def host_suffix(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -1))


def host_domain(host: Column) -> Column:
    return F.when(F.contains(host, F.lit(".")), F.substring_index(host, ".", -2))


def host_priors(decided: DataFrame, n: int) -> DataFrame:
    return priors_of(decided, n)[0]


def priors_of(decided: DataFrame, n: int) -> tuple[DataFrame, list[float]]:
    """(host, counts, up): counts of the text decisions at the host, and the
    smoothed distribution of the level above it; and the smoothed distribution
    of all rows.  ``decided``: (host, best), best from 1 to ``n``.  The plan does
    not grow with the number of languages: counts are rows (host, best, c) and
    become one array a host, suffix or domain at the end."""
    cells = stored(decided.groupBy("host", "best").agg(F.count(F.lit(1)).cast("double").alias("c"))
                   .withColumn("suffix", host_suffix(F.col("host"))).withColumn("domain", host_domain(F.col("host"))), "hosts")

    def held(*key: str) -> DataFrame:
        """``counts`` of each key, in the order of the languages."""
        rows = cells.where(F.col(key[0]).isNotNull()).groupBy(*key, "best").agg(F.sum("c").alias("c"))
        counts = F.map_from_entries(F.collect_list(F.struct("best", "c")))
        return rows.groupBy(*key).agg(counts.alias("m")).select(
            *key, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("counts"))

    everything = {r["best"]: r["c"] for r in cells.groupBy("best").agg(F.sum("c").alias("c")).collect()}
    total = sum(everything.values())
    top = [(everything.get(i + 1, 0) + 1) / (total + n) for i in range(n)]

    def smoothed(parent: Column) -> Column:
        size = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
        return F.zip_with("counts", parent, lambda c, p: (c + PRIOR_WEIGHT * p) / (size + PRIOR_WEIGHT))

    root = F.lit(top)
    by_suffix = held("suffix").select("suffix", smoothed(root).alias("ps"))
    by_domain = held("domain", "suffix").join(by_suffix, "suffix", "left").select(
        "domain", smoothed(F.coalesce("ps", root)).alias("pd"))
    return held("host", "domain").join(by_domain, "domain", "left").select("host", "counts", F.coalesce("pd", root).alias("up")), top


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = "source",
             declared_col: str | None = "lang", model: tuple | None = None, label_col: str = "lang",
             sample_rows: int = SAMPLE_ROWS, effective: int = EFFECTIVE, least: float = LEAST,
             keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with the columns ``id_lang`` (null if rejected),
    ``id_best``, ``id_probability`` and ``id_rejected`` (with a number behind a
    name that the table has already).  ``keep``: return only these columns of the
    table.  Every text is scored once; the scores are written with the kept columns."""
    own, names = plain(docs)
    held = keep or names
    at = [place(names, c) for c in held]
    fresh = [free_name(held, c) for c in ("id_lang", "id_best", "id_probability", "id_rejected")]
    id_at, text_at = place(names, id_col), place(names, text_col)
    model = model or fit(own, id_at, text_at, place(names, label_col), sample_rows)
    languages, n = model[0], len(model[0])
    if not n:
        return own.select(*at, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0.0), F.lit(True)).toDF(*held, *fresh)
    host = F.lower(F.col(place(names, host_col))) if host_col else F.lit(None).cast("string")
    declared = F.lower(F.substring(F.col(place(names, declared_col)), 1, 2)) if declared_col else F.lit(None).cast("string")
    rows = own.select(*at, host.alias("host"), declared.alias("declared"), F.col(text_at).cast("binary").alias("body"))
    scored = stored(text_scores(rows, model, effective), "scores")
    decided = scored.where("letters > 0").select("host", argmax(F.col("loglik")).alias("best"))
    priors, top = priors_of(decided, n)
    priors = priors.toDF("host", "counts", "up")
    if priors.count() <= BROADCAST_HOSTS:
        priors = F.broadcast(priors)
    joined = scored.join(priors, "host", "left")
    best_text = F.when(F.col("letters") > 0, argmax(F.col("loglik"))).otherwise(F.lit(0))
    known = F.lit(languages)
    # The row's own decision does not count for its own prior.
    others = F.transform("counts", lambda c, i: F.greatest(c - (i + 1 == best_text).cast("double"), F.lit(0.0)))
    size = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
    prior = F.coalesce(F.zip_with(others, "up", lambda c, p: (c + PRIOR_WEIGHT * p) / (size + PRIOR_WEIGHT)), F.lit(top))
    log = F.zip_with("loglik", prior, lambda l, p: l + F.log(p))

    def says(value: Column, right: float) -> Column:
        """Log likelihood of a declared value under each language."""
        at = F.coalesce(F.array_position(known, value), F.lit(0))
        rest = F.when(at > 0, F.lit((1 - right) / max(1, n - 1))).otherwise(F.lit(1.0 / n))
        return F.transform(F.array_repeat(rest, n), lambda p, i: F.when(i + 1 == at, F.lit(right)).otherwise(p))

    if declared_col:
        log = F.zip_with(log, says(F.col("declared"), DECLARED_RIGHT), lambda a, p: a + F.log(p))
    suffix = host_suffix(F.col("host"))
    for code, lang in SUFFIX_LANGUAGE.items():
        suffix = F.when(host_suffix(F.col("host")) == code, F.lit(lang)).otherwise(suffix)
    log = F.zip_with(log, says(suffix, SUFFIX_RIGHT), lambda a, p: a + F.log(p))
    out = joined.withColumn("log", log)
    weights = F.transform("log", lambda x: F.exp(x - F.array_max("log")))
    probability = F.when(F.col("letters") > 0, 1 / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))
    best = F.when(F.col("letters") > 0, F.element_at(known, argmax(F.col("log"))))
    out = out.withColumn("best", best).withColumn("probability", probability)
    rejected = F.col("best").isNull() | (F.col("probability") < least)
    out = out.withColumn("rejected", rejected).withColumn("lang", F.when(~F.col("rejected"), F.col("best")))
    return out.select(*at, "lang", "best", "probability", "rejected").toDF(*held, *fresh)


def page_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, host, declared) of raw pages: markup stripped for the
    language model only, the language that the html element declares."""
    html = F.coalesce("html", F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^<]*", " "), r"<[^>]*>?", " ")
    return pages.select(
        "page_id", visible.alias("text"), F.lower(F.regexp_extract("url", r"://([^/?#:]*)", 1)).alias("host"),
        F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2})", 1)), F.lit("")).alias("declared"))
