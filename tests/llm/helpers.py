"""Small tables with awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import duckdb
import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = "lorem ipsum dolor " * 20_000 + "a" * 50_000 + "\n" + "1 " * 20_000
PASSAGE = " ".join(f"alpha{i} beta{i} gamma{i}" for i in range(20)) + "."
ROWS = [
    (1, "Released under the MIT License. " + PASSAGE, "en", "src0", 10),
    (2, "Another opening here.\n" + PASSAGE + "\nAnother end of it.", "en", "src0", 10),
    (2, "Another opening here.\n" + PASSAGE + "\nAnother end of it.", "en", "src0", 10),  # repeated row
    (3, None, "en", "src0", None),
    (4, "", "de", "src1", 0),
    (None, "A row without an id, mail me at x.y@example.com", "en", None, 3),
    (5, LONG, "en", "src0", 3),
    (6, LONG + " tail", None, "src0", 3),
    (7, "\x00\t\n  \r\n", "en", "src0", 3),
    (8, "Ünïcode ÉTÉ 漢字 😀 naïve", "fr", "host.example.fr", 3),
    (9, "Another opening here.\n" + PASSAGE + "\nAnother end of it.", "en", "src0", 10),  # exact copy
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward(spark):
    """The rows above with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("th", "fp", "ids", "spans", "pos", "w", "word", "n", "key", "label", "host", "body", "best", "gone",
                 "item_id", "n_words", "a", "b", "score", "value", "counts", "up", "a.b", "back`tick", "Bo dy", "__th",
                 "__text", "Lines_Gone", "c0", "C1", "id_best"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs.withColumn("parts", F.struct(F.lit(1).alias("a-b"), F.lit("y").alias("c.d")))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text):
    tokens = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i:i + 3]) for i in range(max(1, len(tokens) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Least id reachable, by comparing every pair of distinct fingerprints."""
    values = sorted(set(prints.values()))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for doc, v in prints.items():
        least[find(v)].append(doc)
    return {doc: min(least[find(v)]) for doc, v in prints.items()}


def hits(text, windows):
    """Hit word places and items, by comparing each window at each place."""
    tokens, places, items = words(text), set(), set()
    by_first = defaultdict(list)
    for item, win in windows:
        by_first[win[0]].append((item, win))
    for i, t in enumerate(tokens):
        for item, win in by_first.get(t, ()):
            if tokens[i:i + len(win)] == win:
                places.update(range(i, i + len(win)))
                items.add(item)
    return len(tokens), places, items


def windows(items):
    out = []
    for item, text in items:
        w = words(text)
        out += [(item, w[i:i + 10]) for i in range(max(1, len(w) - 9))] if w else []
    return out


def oracle(sf_dir, sql):
    """The rows of DuckDB SQL over the tables."""
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con.execute(sql).df()


def others(df):
    """The distinct values of all columns but the text, as text."""
    return {str(tuple(r)) for r in df.drop("text").collect()}


def line_dedup(texts, min_words=5):
    """Line dedup by comparing every pair of runs of every pair of documents;
    the longest common order is found among all subsets of the runs held once."""
    lines = {d: [x.strip() for x in t.split("\n") if x.strip()] for d, t in texts.items()}
    runs = {}
    for d, rows in lines.items():
        size = [len(x.split()) for x in rows]
        spans = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows) + 1) if sum(size[a:b]) >= min_words]
        runs[d] = sorted((a, b) for a, b in spans if sum(size[a:b - 1]) < min_words or sum(size[a + 1:b]) < min_words)
    content = {d: [tuple(lines[d][a:b]) for a, b in runs[d]] for d in runs}
    owner = {}
    for d in sorted(texts):
        for i, c in enumerate(content[d]):
            owner.setdefault(c, (d, runs[d][i][0]))
    out = {}
    for d, text in texts.items():
        gone = set()
        for e in {owner[c][0] for c in content[d]} - {d}:
            shared = [(a, b, owner[c][1], content[d].count(c) == 1 == content[e].count(c))
                      for (a, b), c in zip(runs[d], content[d]) if owner[c][0] == e]
            once = sorted((a, b - a, o) for a, b, o, x in shared if x)
            gone |= {i for a, b, o, x in shared if not x for i in range(a, b)}
            gone |= {i for a, n, o in ordered(once) for i in range(a, a + n)}
        kept, n = [], 0
        for line in text.split("\n"):
            if not line.strip() or n not in gone:
                kept.append(line)
            n += bool(line.strip())
        out[d] = "\n".join(kept)
    return out


def ordered(once):
    """All of ``once`` if the owner has the runs in the same order, else a longest
    part of it whose places (and lengths) in the owner ascend; of several the one
    that patience sorting ends with."""
    if all(x[2] <= y[2] for x, y in zip(once, once[1:])):
        return once
    best = [()] * len(once)  # the longest that ends in each
    tails = []
    for i, x in enumerate(once):
        at = next((k for k, t in enumerate(tails) if (once[t][2], once[t][1]) >= (x[2], x[1])), len(tails))
        best[i] = (best[tails[at - 1]] if at else ()) + (x,)
        tails[at:at + 1] = [i]
    return list(best[tails[-1]])
