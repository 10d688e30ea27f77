"""Line dedup, language, URL filter, SimHash, search, decontamination."""

import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlake.llm import ann, components, decontaminate, language_id, line_dedup, queries, simhash, url_filter
from postlake.llm.common import read
from postlake.session import folders, shared_dir
from tests.conftest import SF_MED, SF_SMALL
from tests.llm import helpers as H
from tools.check_oracle import rows_of


def frame(spark, texts):
    return spark.createDataFrame(list(texts), "doc_id bigint, text string")


def left_by(spark, work):
    """Kinds of folders that ``work`` leaves in the shared folder."""
    before = set(folders(spark, shared_dir(spark)))
    work()
    return sorted(x.rsplit("-", 1)[0] for x in set(folders(spark, shared_dir(spark))) - before)


def test_finished_tables_are_deleted(spark):
    """What a result is still read from stays, everything else goes."""
    docs = frame(spark, [(i, "\n".join(f"line {j} of some five words {i % 2}" for j in range(i))) for i in range(8)])
    assert left_by(spark, lambda: line_dedup.line_dedup(docs).collect()) == ["llm-gone"]
    assert left_by(spark, lambda: simhash.near_duplicates(docs).collect()) == ["llm-components", "llm-edges", "llm-prints"]


# --- Line dedup ---------------------------------------------------------

def dedup(spark, texts):
    return {r.doc_id: r.text for r in line_dedup.line_dedup(frame(spark, texts)).collect()}


A, B, C, D = (" ".join(f"{x}{i}" for i in range(9)) for x in "abcd")


def test_line_blocks(spark):
    got = dedup(spark, [
        (1, f"{A}\n{B}\n\n{C}"),
        (2, f"own start\n{A}\n{B}\n\nown end"),
        (3, f"{A}\n{B}\n\n{C}"),
        (4, f"{C}\n{A}"),
        (5, f"only mine {D}\nshort one"),
        (6, f"{D}\nshort one"),
    ])
    assert got[1] == f"{A}\n{B}\n\n{C}" and got[2] == "own start\n\nown end" and got[3].strip() == ""
    assert got[4] in (C, A)  # crossed lines: one order is aligned, the other stays
    assert got[5] == f"only mine {D}\nshort one" and got[6] == f"{D}\nshort one"


def test_common_lines_go_only_with_a_rare_block(spark):
    common = "this line is everywhere"
    texts = [(i, f"{common}\nown line number {i} with words that differ {i * 7} x") for i in range(30)]
    got = dedup(spark, texts + [(100, texts[5][1])])
    assert all(got[i] == t for i, t in texts)
    assert got[100] == ""


def test_frequent_short_lines_go_whatever_their_number(spark):
    verse = "\n".join(f"short verse{i}" for i in range(8))
    han = "天地玄黄宇宙洪荒日月盈昃"
    texts = [(i, f"own{i} line{i}\n{verse}\nend{i}") for i in range(30)] + [(100 + i, f"{han}\nown{i}") for i in range(30)]
    texts += [(200 + i, f"five plain words stand here\nown{i} line{i}") for i in range(30)]
    got = dedup(spark, texts)
    assert all(got[x] == texts[at][1] for x, at in ((0, 0), (100, 30), (200, 60)))
    assert all(got[i] == f"own{i} line{i}\nend{i}" and got[100 + i] == f"own{i}" and got[200 + i] == f"own{i} line{i}" for i in range(1, 30))


def test_blocks_with_lines_of_several_owners(spark):
    passage = [f"four plain words {i}" for i in range(12)]
    whole = "\n".join(passage)
    texts = [(1, "three short words"), (2, "three short words\nand four more words"), (3, "three short words\nand four more words")]
    texts += [(10 + i, f"{line}\nelse{i}") for i, line in enumerate(passage) if i % 2]
    texts += [(50, whole), (51, f"mine\n{whole}\nown\n{whole}\nown\n{passage[0]}"), (52, f"{passage[3]}\n{whole}")]
    got = dedup(spark, texts)
    assert got[2] == texts[1][1] and got[3] == "" and got[50] == whole
    assert got[51] == f"mine\nown\nown\n{passage[0]}" and got[52] == passage[3]
    moved = [(1, f"{A}\n{B}\n{A}\n{C}"), (2, f"{B}\n{A}\n{C}"), (3, f"{D}\n{C}\n{C}")]
    assert dedup(spark, moved) == {1: moved[0][1], 2: "", 3: D}


def test_runs_cover_every_common_block():
    draw = random.Random(6)
    for _ in range(300):
        words = [draw.randrange(1, 7) for _ in range(draw.randrange(12))]
        runs = line_dedup.runs_of(words, 5)
        assert len(runs) == len(set(runs))
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                inside = {x for at, n in runs if a <= at and at + n <= b for x in range(at, at + n)}
                assert inside == (set(range(a, b)) if sum(words[a:b]) >= 5 else set())


def test_line_dedup_properties_on_documents(spark):
    docs = {r.doc_id: r.text for r in read(spark, SF_MED, "documents").collect()}
    got = {r.doc_id: r for r in line_dedup.line_dedup(read(spark, SF_MED, "documents")).collect()}
    assert got.keys() == docs.keys()
    first = {}
    for d in sorted(docs):
        for line in docs[d].split("\n"):
            first.setdefault(line.strip(), d)
    seen, gone = set(), 0
    for d in sorted(docs):
        before, after = docs[d].split("\n"), got[d].text.split("\n")
        rest = iter(before)
        assert got[d].text == "" or all(x in rest for x in after)  # a subsequence
        removed = len(before) - len(after) if got[d].text else len(before)
        gone += got[d].lines_gone
        assert got[d].lines_gone <= removed
        if docs[d] in seen and all(len(x.split()) >= 8 for x in before if x.strip()):
            assert got[d].text.strip() == ""
        seen.add(docs[d])
        kept = set(x.strip() for x in after)
        for line in before:
            # No line of eight words or more stays that an earlier document has,
            # unless the order of the pair differs (then at least one line went).
            if len(line.split()) >= 8 and first[line.strip()] < d and line.strip() in kept:
                assert got[d].lines_gone > 0
            if line.strip() and first[line.strip()] == d:
                assert line.strip() in kept  # a first copy always stays
    assert gone > 0


def test_line_dedup_awkward(spark):
    rows = line_dedup.line_dedup(H.awkward(spark)).collect()
    assert len(rows) == len(H.ROWS)
    got = {r.doc_id: r.text for r in rows}
    assert got[3] is None and got[4] == "" and got[9] == "" and got[6] != H.ROWS[7][1]
    assert sorted(r.text for r in rows if r.doc_id == 2) == [H.ROWS[1][1]] * 2
    assert line_dedup.line_dedup(H.empty(spark)).count() == 0
    assert H.others(line_dedup.line_dedup(H.awkward(spark)).drop("lines_gone_2")) == H.others(H.awkward(spark))


def test_memory_of_a_long_document_of_short_lines():
    """A document of 1 MB in 40,000 lines: the runs leave in bounded batches that
    never hold a text, and the task holds 60 MB of Python objects at most."""
    draw = random.Random(1)
    text = "\n".join(" ".join(f"w{draw.randrange(1000)}" for _ in range(5)) for _ in range(40_000)).encode()[:1_000_000]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text], pa.binary())], names=["doc_id", "th", "text"])
    start, rows = pa.total_allocated_bytes(), 0
    tracemalloc.start()
    for out in line_dedup._runs(5)(iter([batch])):
        assert len(out) <= 2 * line_dedup.RUN_ROWS and out.nbytes <= 50 * len(out)
        assert pa.total_allocated_bytes() - start < 8 << 20
        rows += len(out)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 30_000 and peak < 60 << 20


def test_line_dedup_against_a_brute_force_aligner(spark):
    draw = random.Random(12)
    for _ in range(3):
        pool = [" ".join(f"{draw.choice('abcdefgh')}{draw.randrange(9)}" for _ in range(draw.randrange(1, 8))) for _ in range(14)]
        texts = [(i, "\n".join(draw.choice([*pool, f"own {i} {j}", ""]) for j in range(draw.randrange(12)))) for i in range(25)]
        assert dedup(spark, texts) == H.line_dedup(dict(texts))


def test_longest_increasing_against_brute_force():
    draw = random.Random(5)
    for _ in range(200):
        values = [draw.randrange(9) for _ in range(draw.randrange(9))]
        subsets = ([v for i, v in enumerate(values) if m >> i & 1] for m in range(1 << len(values)))
        best = max(len(s) for s in subsets if all(a < b for a, b in zip(s, s[1:])))
        at = line_dedup.longest_increasing(values)
        assert len(at) == best and at == sorted(at) and all(values[a] < values[b] for a, b in zip(at, at[1:]))


# --- Language -----------------------------------------------------------

def test_language_held_out_accuracy(spark):
    docs = read(spark, SF_MED, "documents")
    model = language_id.fit(docs.where("doc_id % 2 = 0"), "doc_id", "text", "lang", 200)
    held = docs.where("doc_id % 2 = 1")
    found = language_id.identify(held, declared_col=None, host_col="source", model=model).collect()
    assert sum(r.id_lang == r.lang for r in found) / len(found) > 0.97
    assert not any(r.id_rejected for r in found)


def test_language_evidence_decides_short_texts(spark):
    model = language_id.fit(read(spark, SF_MED, "documents"), "doc_id", "text", "lang", 200)
    rows = [(1, "x", "fr", "a.example.com"), (2, "x", None, "b.example.de"), (3, "x", "xx", None), (4, "12 34", "de", "a.example.de"), (5, None, "de", "q")]
    schema = "doc_id bigint, text string, lang string, source string"
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, schema), model=model, least=0.0).collect()}
    assert got[1].id_best == "fr" and got[2].id_best == "de"
    assert got[4].id_rejected and got[5].id_rejected and got[4].id_lang is None
    rows = [(100 + i, "été " * 30, None, "host.example.org") for i in range(40)] + [(6, "q", None, "host.example.org")]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, schema), model=model, least=0.0).collect()}
    assert got[6].id_best == "fr"


def test_host_prior_by_hand(spark):
    decided = spark.createDataFrame([("a.b.com", 1)] * 3 + [("a.b.com", 2)] + [("c.b.com", 2)] * 5 + [("s", 1)], "host string, best int")
    got = {r.host: r for r in language_id.host_priors(decided, 2).collect()}
    w = language_id.PRIOR_WEIGHT
    top = [(4 + 1) / (10 + 2), (6 + 1) / (10 + 2)]
    suffix = [(3 + w * top[0]) / (9 + w), (6 + w * top[1]) / (9 + w)]
    domain = [(3 + w * suffix[0]) / (9 + w), (6 + w * suffix[1]) / (9 + w)]
    assert got["a.b.com"].counts == [3, 1] and got["a.b.com"].up == pytest.approx(domain)
    assert got["s"].up == pytest.approx(top)


def test_host_prior_of_thousands_of_languages(spark):
    """Counts are rows: the plan has as many expressions for 3,000 languages as for two."""
    decided = spark.createDataFrame([("a.com", 1 + i % 3000) for i in range(4000)] + [("b.com", 3000)], "host string, best int")
    few, many = (language_id.host_priors(decided, n) for n in (2, 3000))
    nodes = [df._jdf.queryExecution().optimizedPlan().numberedTreeString().count("#") for df in (few, many)]
    assert nodes[0] == nodes[1]
    got = {r.host: r for r in many.collect()}
    assert len(got["a.com"].counts) == 3000 and sum(got["a.com"].counts) == 4000 and got["b.com"].counts[2999] == 1
    assert got["a.com"].counts[:1000] == [2] * 1000 and sum(got["b.com"].up) == pytest.approx(1)


def test_every_label_is_a_language(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i, j: letters[i % 26] * 2 + letters[i // 26] + letters[j]
    rows = [(100 * i + j, " ".join(word(i, (j + x) % 5) for x in range(12)), f"l{i:02}", None) for i in range(80) for j in range(3 + i % 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    languages, table = language_id.fit(docs, "doc_id", "text", "lang")
    assert languages == [f"l{i:02}" for i in range(80)]
    found = language_id.identify(docs, declared_col=None).collect()
    assert all(r.id_best == r.lang and not r.id_rejected for r in found)
    at, n = np.array([3, 70, 900, 16383]), np.array([1.0, 4.0, 2.0, 1.0])
    assert language_id.scorer(table)(at, n) == pytest.approx(n @ table.T[at], rel=1e-5)


def test_null_host_has_the_prior_of_all_rows(spark):
    model = language_id.fit(read(spark, SF_MED, "documents"), "doc_id", "text", "lang", 200)
    rows = [(i, "été " * 30, None, "h.example.org") for i in range(60)] + [(100, "q", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r for r in language_id.identify(docs, model=model, least=0.0).collect()}
    assert got[100].id_best == "fr" and got[100].id_probability > 0.6


def test_language_of_pages(spark):
    """Every page gets a row; null urls and pages, and the declared language, as evidence."""
    got = queries.QUERIES["language_id_pages"](spark, SF_SMALL).collect()
    pages = {r.page_id: r for r in read(spark, SF_SMALL, "pages").collect()}
    assert sorted(r.page_id for r in got) == sorted(pages)
    told = [r for r in got if r.declared and not r.id_rejected]
    assert told and sum(r.id_lang == r.declared for r in told) / len(told) > 0.9
    odd = spark.createDataFrame([(1, None, "<html lang='de'><p>und der die das nicht</p>"), (2, "http://u:p@h.example.fr:80/x", None),
                                 (3, "no scheme", ""), (None, "http://a.fr", "<p>le la les des est une</p>")], "page_id bigint, url string, html string")
    seen = {r.page_id: r for r in language_id.page_evidence(odd).collect()}
    assert (seen[1].host, seen[1].declared) == (None, "de") and seen[2].text is not None and seen[3].host == ""
    model = language_id.fit(read(spark, SF_SMALL, "documents"), "doc_id", "text", "lang")
    rows = {r.page_id: r for r in language_id.identify(language_id.page_evidence(odd), "page_id", "text", "host", "declared", model).collect()}
    assert rows[1].id_lang == "de" and rows[2].id_rejected and rows[3].id_rejected and rows[None].id_lang == "fr"


def test_language_against_a_brute_force_fusion(spark):
    """Text score, host prior without the own row, declared language and suffix, put
    together row by row in plain Python."""
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in read(spark, SF_SMALL, "documents").limit(60).collect()]
    hosts = ["a.example.fr", "b.example.fr", "c.de", "plain", None]
    rows = [(i, t, lang if i % 3 else None, hosts[i % 5]) for i, (_, t, lang, _) in enumerate(docs)]
    model = language_id.fit(spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string"), "doc_id", "text", "lang")
    langs, table = model
    n, score = len(langs), language_id.scorer(table)
    texts = {}
    for i, t, _, _ in rows:
        cells = np.bincount(language_id.trigrams(t.encode()), minlength=language_id.CELLS)
        at = np.flatnonzero(cells)
        total = score(at, cells[at].astype(float)) * min(1.0, language_id.EFFECTIVE / cells.sum())
        texts[i] = total - total.max()
    suffix = lambda h: h.rsplit(".", 1)[-1] if h and "." in h else None
    domain = lambda h: ".".join(h.split(".")[-2:]) if h and "." in h else None

    def held(keep):
        out = np.zeros(n)
        for i, _, _, h in rows:
            if keep(h):
                out[int(texts[i].argmax())] += 1
        return out

    smooth = lambda c, p: (c + language_id.PRIOR_WEIGHT * p) / (c.sum() + language_id.PRIOR_WEIGHT)
    everything = held(lambda h: True)
    top = (everything + 1) / (everything.sum() + n)
    want = {}
    for i, _, declared, h in rows:
        prior = top
        if h is not None:
            up = top
            if domain(h):
                up = smooth(held(lambda x: domain(x) == domain(h)), smooth(held(lambda x: suffix(x) == suffix(h)), top))
            own = held(lambda x: x == h)
            own[int(texts[i].argmax())] -= 1
            prior = smooth(own, up)
        log = texts[i] + np.log(prior)
        for value, right in ((declared, language_id.DECLARED_RIGHT), (language_id.SUFFIX_LANGUAGE.get(suffix(h)), language_id.SUFFIX_RIGHT)):
            if value in langs:
                log = log + np.log([right if x == value else (1 - right) / (n - 1) for x in langs])
        p = np.exp(log - log.max())
        want[i] = (langs[int(log.argmax())], 1 / p.sum())
    frame_ = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: (r.id_best, r.id_probability) for r in language_id.identify(frame_, model=model, least=0.0).collect()}
    assert {i: b for i, (b, _) in got.items()} == {i: b for i, (b, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], rel=1e-4) for i in want)


def test_language_awkward(spark):
    rows = language_id.identify(H.awkward(spark)).collect()
    assert len(rows) == len(H.ROWS) and rows[0].body == "x"
    rejected = sorted((r.doc_id or 0) for r in rows if r.id_rejected)
    assert set(rejected) >= {3, 4, 7}
    assert language_id.identify(H.empty(spark)).count() == 0
    got = language_id.identify(H.awkward(spark)).drop("id_lang", "id_best_2", "id_probability", "id_rejected")
    assert H.others(got) == H.others(H.awkward(spark))
    assert language_id.identify(H.empty(spark).unionByName(frame(spark, [(1, "abc")]).selectExpr(
        "doc_id", "text", "null lang", "null source", "0L n_chars"))).where("id_rejected").count() == 1


# --- URL filter and decontamination: the registered SQL ------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_registered_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_MED}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF_MED).toPandas(), con.execute(queries.ORACLE[name]).df()
    assert rows_of(got) == rows_of(want)


def test_url_filter_by_hand(spark):
    urls = {None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://x.NET": ("x.net", "", None, "allow"),
            "http://x.net/?a": ("x.net", "/", "net/", "block"), "https://a.example.net/en/x#y": ("a.example.net", "/en/x", "example.net/en/", "allow"),
            "https://a.example.net/enx": ("a.example.net", "/enx", "net/", "block"), "u://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
            "u://badexample.com/de/": ("badexample.com", "/de/", None, "allow"), "u://q.org/fr/a?b": ("q.org", "/fr/a", "org/fr/", "allow"),
            "u://www.cheap-pills.example.com/en/": ("www.cheap-pills.example.com", "/en/", None, "block"),
            "u://" + "a." * 5000 + "net/" + "b/" * 5000: ("a." * 5000 + "net", "/" + "b/" * 5000, "net/", "block"), "://": ("", "", None, "allow"), "": ("", "", None, "allow")}
    schema = "host string, path string, verdict string"
    rules, listed = spark.createDataFrame(url_filter.RULES, schema), spark.createDataFrame(url_filter.LISTED, schema)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] * 2, "page_id bigint, url string").withColumn("host", F.lit("x")).withColumn("block", F.lit(1))
    for blocks in (1, url_filter.BLOCKS):  # one block: many false positives reach the exact join
        got = url_filter.filter_urls(pages, rules, listed, blocks=blocks).collect()
        assert len(got) == 2 * len(urls)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == urls[r.url], r.url
    assert url_filter.filter_urls(pages.limit(0), rules, listed).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0), listed.limit(0)).collect()} == {"allow"}


# --- SimHash ------------------------------------------------------------

def test_simhash_against_all_pairs(spark):
    docs = {r.doc_id: r.text for r in read(spark, SF_MED, "documents").collect()}
    prints = {d: H.simhash(t) for d, t in docs.items()}
    want = H.components(prints)
    got = {r.doc_id: r for r in queries.QUERIES["op8_simhash"](spark, SF_MED).collect()}
    assert got.keys() == docs.keys()
    for d in docs:
        assert got[d].fingerprint == f"{prints[d]:016x}" and got[d].component_id == want[d]


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 5])
def test_trie_links_against_all_pairs(spark, bits):
    draw = random.Random(bits)
    values = {0, 2**64 - 1, 2**63}
    for _ in range(12):
        seed = draw.getrandbits(64)
        values |= {seed ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(5))) for _ in range(25)}
    values = sorted(values)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(values) for b in values[i + 1:] if (a ^ b).bit_count() <= bits}
    got = simhash.trie_links(spark.createDataFrame([(signed(v),) for v in values], "fp bigint"), bits).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (-5, 300)]
    draw = random.Random(2)
    edges = [(a, b) if draw.random() < 0.5 else (b, a) for a, b in edges]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200, -5: -5, 300: -5}
    assert got == want


def test_simhash_awkward(spark):
    rows = simhash.near_duplicates(H.awkward(spark)).collect()
    assert len(rows) == len(H.ROWS)
    got = {r.doc_id: r for r in rows}
    assert got[3].fp == got[4].fp == 0 and got[3].component_id == got[4].component_id == 3
    assert got[9].component_id == 2 and got[None].component_id is None
    kept = simhash.keep_one(H.awkward(spark))
    ids = sorted((r.doc_id or 0) for r in kept.collect())
    assert len(ids) == len(set(ids)) and set(ids) >= {0, 1, 2, 3, 7, 8} and not {4, 9} & set(ids)
    assert kept.columns == H.awkward(spark).columns
    assert H.others(kept) <= H.others(H.awkward(spark))
    assert simhash.near_duplicates(H.empty(spark)).count() == 0 and simhash.keep_one(H.empty(spark)).count() == 0


# --- Nearest vectors ----------------------------------------------------

def brute(vectors, query, k):
    d = sorted((float(np.sqrt(((np.array(v, float) - np.array(vectors[query], float)) ** 2).sum())), i) for i, v in vectors.items() if i != query)
    return d[:k]


def test_nearest_recall_and_scores(spark):
    sf = SF_MED.replace("0.01", "0.1")
    vectors = {r.vec_id: r.embedding for r in read(spark, sf, "embeddings").collect()}
    got = {}
    for r in queries.QUERIES["op9_nearest_vectors"](spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    queried = [q for q in vectors if q % 100 == 0]
    assert sorted(got) == sorted(queried)
    found = 0
    for q in queried:
        want = brute(vectors, q, 10)
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11)) and rows == sorted(rows, key=lambda r: (r[1], r[2]))
        for _, score, v in rows:
            assert score == pytest.approx(float(np.linalg.norm(np.array(vectors[v], float) - np.array(vectors[q], float))), abs=1e-12)
        found += len({v for _, v in want} & {v for _, _, v in rows})
    assert found / (10 * len(queried)) >= 0.9


def test_nearest_recall_on_many_rows(spark, tmp_path):
    """Evenly spread vectors, buckets far more than the least probes (500 to 24)."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(8)
    data = rng.normal(size=(200_000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(data)), "embedding": pa.FixedSizeListArray.from_arrays(
        pa.array(data.ravel()), 64).cast(pa.list_(pa.float32()))}), tmp_path / "v.parquet", row_group_size=20_000)
    got = {}
    for r in ann.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), every=400).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(got) == 500
    found = 0
    for q, rows in got.items():
        dist = ((data - data[q]) ** 2).sum(axis=1)
        dist[q] = np.inf
        found += len(rows & set(np.argpartition(dist, 10)[:10].tolist()))
    print("recall", found / 5000)
    assert found / 5000 >= 0.9


def test_nearest_splits_a_dense_cluster(spark):
    rng = np.random.default_rng(3)
    dense = np.array([3.0] + [0.0] * 15) + rng.normal(size=(900, 16)) * 0.01
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([dense, rng.normal(size=(100, 16))]))],
                                  "vec_id bigint, embedding array<double>")
    whole, split = ([tuple(r) for r in ann.nearest(table, every=10, bucket_rows=50, **sizes).orderBy("query_id", "rank").collect()]
                    for sizes in ({}, {"slot_vectors": 70, "slot_queries": 20}))
    assert len(whole) == 1000 and whole == split


def test_nearest_awkward(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (100, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 0.0]), (2, None), (3, [1.0, None, 0.0]), (4, [float("nan"), 1.0, 0.0]),
            (5, [float("inf"), 0.0, 0.0]), (6, [0.5, 0.5, 0.0]), (6, [0.5, 0.5, 0.0]), (7, [2.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]),
            (200, [1.0, 2.0]), (8, []), (9, [3.0, 4.0])] + [(1000 + i, [0.0, 1.0, 0.0]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("key", F.lit(1)).withColumn("dim", F.lit("x"))
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fit = {i: v for i, v in rows if i is not None and v and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    for q in (0, 100, 1000):
        assert [(i, pytest.approx(d)) for d, i in brute(fit, q, 10)] == [(v, s) for _, v, s in sorted(got[q])]
    assert [(v, s) for _, v, s in got[200]] == [(9, pytest.approx(8 ** 0.5))]
    assert set(got) == {0, 100, 200, 1000}
    assert ann.nearest(table.limit(0)).count() == 0


# --- Decontamination ----------------------------------------------------

def test_decontamination_awkward(spark):
    item = " ".join(f"w{i}" for i in range(25))
    items = [(10, item), (9, "Two Words"), (9, "Two Words"), (8, None), (7, "..."), (None, "lone item here"), (6, " ".join(["aa"] * 12))]
    texts = [(1, "x " + " ".join(f"W{i}" for i in range(3, 20)) + " y"), (1, "x " + " ".join(f"W{i}" for i in range(3, 20)) + " y"),
             (2, "two-words two words"), (3, "lone item here"), (4, "aa " * 30), (5, None), (6, ""), (7, " ".join(f"w{i}" for i in range(9))),
             (None, item), (8, item + " " + item), (8, "other text")]
    want = []
    wins = H.windows([(str(i) if i is not None else None, t) for i, t in items])
    for d, t in texts:
        n, places, found = H.hits(t, wins)
        want.append((d or 0, n, len(places), sorted(x for x in found if x is not None)))
    docs = frame(spark, texts).withColumn("w", F.lit("x")).withColumn("word", F.lit(1)).withColumn("item_id", F.lit(2))
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("win", F.lit("x"))
    for block in (decontaminate.BLOCK_WINDOWS, 5):  # in one block, and in several
        got = decontaminate.decontaminate(docs, bench, block_windows=block).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted(want)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [5, 6, 7, 8] and kept.columns == docs.columns
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.decontaminate(H.awkward(spark), bench).count() == len(H.ROWS)


def test_windows_of_many_items_are_one_class(spark, monkeypatch):
    """Items that share a passage: places are counted once, all items are listed."""
    shared = " ".join(f"s{i}" for i in range(14))
    items = [(i, f"{shared} own{i} tail{i}") for i in range(60)]
    texts = [(1, f"intro {shared} outro"), (2, f"{shared} own7 tail7 {shared}"), (3, "s1 s2 s3"), (4, " ".join(f"s{i}" for i in range(9, 14)))]
    wins = H.windows([(str(i), t) for i, t in items])
    want = []
    for d, t in texts:
        n, places, found = H.hits(t, wins)
        want.append((d, n, len(places), sorted(found)))
    docs, bench = frame(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (decontaminate.BLOCK_BYTES, 10_000):  # in one broadcast, and in several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        got = decontaminate.decontaminate(docs, bench).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == want
