"""HTML extraction, licences, BPE and personal data against brute force."""

import base64
import random
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from postlake.llm import bpe, html_extract, licenses, pii, queries
from postlake.llm.common import read
from tests.conftest import SF_MED, SF_SMALL
from tests.llm import helpers as H

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- HTML ---------------------------------------------------------------

def article_of(html):
    """Blocks of the article element, by plain text replacement."""
    from html import unescape
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    inner = re.sub(r"</?(?:p|h1)>", "\n\n\n", inner)
    inner = re.sub(r"<br>", " ", re.sub(r"</?(?:b|a)[^>]*>", "", inner))
    blocks = [" ".join(unescape(x).split()) for x in inner.split("\n\n\n")]
    return "\n\n".join(x for x in blocks if x)


def test_every_page_gives_its_article(spark):
    got = {r.page_id: r for r in queries.QUERIES["op1_html_extraction"](spark, SF_MED).collect()}
    pages = read(spark, SF_MED, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id].text == article_of(p.html), p.page_id
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


PAGES = {
    "plain": ("<html><body><div class='menu'><a href=/>home</a></div><h1>Head &amp; tail</h1><p>One  two\n three<p>Four"
              " five six seven<div class=sidebar>buy this now</div></body>", "Head & tail\n\nOne two three\n\nFour five six seven"),
    "main": ("<body><header><h1>Site</h1></header><main><h2>T</h2><p>a b c d</p><aside>no no no</aside><form>mail<input></form>"
             "<p>e f</p><section class='comments'><p>first!</p></section></main><footer>f</footer>", "T\n\na b c d\n\ne f"),
    "notice": ("<div id='cookie-notice'>We use cookies on this site for all</div><article><p>real text here</p>"
               "<article class='comment'>nice post</article><script>if (a<b) '</p>'</script><p>x.</p></article>", "real text here\n\nx."),
    "broken": ("<article><p>one <b>two <i>three</p><p>four &lt;five&gt; &#8364; &nosuch; 2 < 3", "one two three\n\nfour <five> € &nosuch; 2 < 3"),
    "list": ("<ARTICLE><UL><LI>one<LI>two</UL><TABLE><TR><TD>c1<TD>c2</TABLE><pre>a\n  b</pre></ARTICLE>", "one\n\ntwo\n\nc1\n\nc2\n\na b"),
    "empty": ("", ""), "none": (None, ""), "tags": ("<div><p></p></div>", ""), "comment": ("<!-- a <p>b</p> --><p>seen words</p><!-- open", "seen words"),
    "boiler": ("<article><div class='ad'>buy</div><p>text one</p><div role=navigation>x y</div></article><div>outside words</div>", "text one"),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_made_pages(name):
    html, text = PAGES[name]
    weights = html_extract.weights_of({"state:in": (100, 0), "state:out": (0, 50), "block:p": (90, 5), "tag:p": (80, 4)})
    assert html_extract.extract(html, weights) == text
    assert html_extract.extract(html, {}) == text


WORDS = "the story has many words and " * 5


@pytest.mark.parametrize("wrapper", [
    "<div class='content with-sidebar'>", "<div id=page class='has-sidebar'>", "<div class='no-header'>", "<section class='social news'>",
    "<div class='ad-free'>", "<div class=sidebar>", "<form id=aspnet>", "<div class=widget><div class='modal'>"])
@pytest.mark.parametrize("inner", ["<article><p>{}</p></article>", "<main><p>{}</p></main>", "<p>{}</p>",
                                   "<article class='post comments-open'><p>{}</p></article>", "<article class='ad-free'><p>{}</p></article>"])
def test_wrappers_keep_their_content(wrapper, inner):
    html = f"<body><div class=menu>home</div>{wrapper}{inner.format(WORDS)}<div class='comment-list'>first!</div>"
    assert html_extract.extract(html, {}) == WORDS.strip()


def test_named_elements_in_content_stay_out():
    html = f"<article><p>short text</p><div class='comments'><article class=comment>{WORDS}</article></div><div class=related><article>{WORDS}</article></div></article>"
    assert html_extract.extract(html, {}) == "short text"


def test_boilerplate_inside_an_article_goes():
    body = "".join(f"<p>real sentence number {i} of the article body</p>" for i in range(6))
    for mark in ('class="user-comments"', 'class="article-comments"', 'id="comments-v2"', 'class="ad-300x250"', 'class="sponsored-content"',
                 'class="cookie-policy"', 'class="google-ad"', 'class="comments"', 'class="ad"'):
        text = html_extract.extract(f"<body><article><h1>Head line</h1>{body}<div {mark}><p>not part of it</p></div></article></body>", {})
        assert "not part" not in text and text.count("real sentence") == 6 and text.startswith("Head line")
    # A wrapper of nearly all words is no part, whatever its name; and long comments are.
    for mark in ('class="ad-free"', 'class="post comments-open"', 'class="no-ads content"'):
        assert html_extract.extract(f"<article><div {mark}>{body}</div></article>", {}).count("real sentence") == 6
        assert html_extract.extract(f"<body><div {mark}><article>{body}</article></div></body>", {}).count("real sentence") == 6
    many = "".join(f"<p>comment number {i} by some reader of it all</p>" for i in range(7))
    text = html_extract.extract(f"<article>{body}<div class='user-comments'>{many}</div></article>", {})
    assert text.count("real sentence") == 6 and "reader" not in text


def test_content_elements_stay():
    for tag in ("math", "object", "label", "map", "figure", "details"):
        text = html_extract.extract(f"<article><p>words before it</p><{tag}>held inside it</{tag}><p>words after it</p></article>", {})
        assert "held inside it" in text
    assert "a <b>literal</b> &amp; text" in html_extract.extract("<article><p>one</p><xmp>a <b>literal</b> &amp; text</xmp><p>two</p></article>", {})


def test_scan_takes_the_best_of_all_regions():
    """Against the score of every run of events, on pages without a marked element."""
    draw = random.Random(17)
    for _ in range(60):
        html = "".join(f"<{t}>{' '.join(['word'] * draw.randrange(6))}{i}</{t}>" for i, t in enumerate(draw.choice(["p", "li", "td", "span", "h2"]) for _ in range(draw.randrange(1, 9))))
        weights = {f"tag:{t}": -draw.random() * 3 for t in ("p", "li", "td", "span", "h2")}
        weights |= {f"block:{t}": draw.uniform(-2, 1) for t in ("p", "li", "td", "span", "h2", "body")}
        page = html_extract.Page(html)
        gains = [weights.get(f"tag:{v}", html_extract.TAG_COST) if k == "t" else n * (1.0 + weights.get(f"block:{v[1]}", 0.0)) for k, v, n, _, _ in page.events]
        best = max((sum(gains[a:b]) for a in range(len(gains)) for b in range(a + 1, len(gains) + 1)), default=0.0)
        if best <= 0:
            continue
        regions = [(a, b) for a in range(len(gains)) for b in range(a + 1, len(gains) + 1) if sum(gains[a:b]) > best - 1e-9]
        texts = set()
        for a, b in regions:
            touched = {page.events[i][3] for i in range(a, b) if page.events[i][0] == "w" and page.events[i][2]}
            blocks = {}
            for k, _, _, block, text in page.events:
                if k == "w" and block in touched:
                    blocks.setdefault(block, []).append(text)
            texts.add("\n\n".join(x for x in (" ".join("".join(p).split()) for p in blocks.values()) if x))
        assert html_extract.extract(html, weights) in texts


def test_awkward_pages(spark):
    rows = [(None, None, None), (1, None, "<p>hello there</p>"), (1, None, "<p>hello there</p>"), (2, "u", "<" * 20000),
            (3, "u", "<p class='" * 5000), (4, "u", "<div>" * 20000 + "deep"), (5, "u", "<p>w</p>" * 20000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("x"))
    got = sorted((r.page_id or 0, r.text) for r in html_extract.extract_pages(pages).collect())
    assert [g[0] for g in got] == [0, 1, 1, 2, 3, 4, 5]
    assert got[0][1] == "" and got[1][1] == got[2][1] == "hello there"
    assert got[5][1] == "deep" and got[6][1].count("w") == 20000
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


# --- Licences -----------------------------------------------------------

def license_base(text):
    tokens = H.words(text)
    found = []
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(tokens)) if tokens[i:i + len(p)] == p]
    return (len(tokens), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None),
            ",".join(sorted({x for _, x in found})))


def test_license_base_on_documents_and_awkward_rows(spark):
    extra = spark.createDataFrame([
        (20, "mit License MIT license; GNU General  Public-License mit", "", "", 0), (21, "MIT-LICENSE" * 3000, "", "", 0),
        (22, "general public license general public license", "", "", 0)], H.SCHEMA)
    docs = read(spark, SF_MED, "documents").unionByName(spark.createDataFrame(H.ROWS, H.SCHEMA)).unionByName(extra)
    want = sorted(map(repr, ((r.doc_id, *license_base(r.text)) for r in docs.collect())))
    rows = licenses.scan_licenses(docs).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in rows))) == want
    for r in rows:
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.scan_licenses(H.awkward(spark)).count() == len(H.ROWS)
    assert licenses.scan_licenses(H.empty(spark)).count() == 0


@pytest.mark.parametrize("text,expression,level", [
    ("// SPDX-License-Identifier: MIT", "MIT", "permissive"),
    ("SPDX-License-Identifier: GPL-2.0-only OR MIT AND Apache-2.0\nmore", "(GPL-2.0-only OR (MIT AND Apache-2.0))", "permissive"),
    ("SPDX-License-Identifier: (MIT or Apache-2.0) and GPL-3.0 */ text", "((MIT OR Apache-2.0) AND GPL-3.0)", "strong copyleft"),
    ("spdx-license-identifier: GPL-2.0 WITH Classpath-exception-2.0", "GPL-2.0 WITH Classpath-exception-2.0", "weak copyleft"),
    ("SPDX-License-Identifier: MIT AND", "MIT", "permissive"),
    ("SPDX-License-Identifier: ((MIT", "MIT", "permissive"),
    ("SPDX-License-Identifier: own-thing", "own-thing", "unknown"),
])
def test_expressions(text, expression, level):
    row = licenses.scan_text(text.encode())
    assert row[7] == [expression] and row[8] == level


# --- BPE ----------------------------------------------------------------

def test_bpe_equals_the_library(spark, encoding):
    draw = random.Random(1)
    alphabet = "ab eé漢😀\n\t'st 01#.,  ABtheingion"
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(0, 400))) for _ in range(300)]
    texts += ["a" * 5000, "the" * 700, " " * 3000, "#" * 2000, "ab" * 300 + "é" * 900, "thing" * 60, "1" * 257, "x" * 256]
    texts += [r.text for r in read(spark, SF_MED, "documents").collect()]
    coded = bpe.encode_texts(texts, PATH, public_tokenizers.PATTERN)
    vocab = bpe.vocabulary(PATH)
    import numpy as np
    for text, ids in zip(texts, coded):
        ids = np.frombuffer(ids, np.int32)
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert vocab.decode(ids) == text.encode()


def test_bpe_query_and_awkward_rows(spark, encoding):
    for r in queries.QUERIES["op3_byte_bpe"](spark, SF_SMALL).join(read(spark, SF_SMALL, "documents"), "doc_id").collect():
        ids = encoding.encode_ordinary(r.text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), H.sha(" ".join(map(str, ids))), H.sha(r.text))
    got = sorted((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in bpe.encode_decode(H.awkward(spark), PATH, public_tokenizers.PATTERN).collect())
    want = sorted((d or 0, encoding.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in H.ROWS)
    assert got == want
    assert bpe.encode_decode(H.empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


# --- Personal data ------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def base_spans(text):
    only = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [(EMAIL, lambda m: True), (IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
             (CARD, lambda m: 12 <= len(only(m)) <= 19 and luhn(only(m))), (PHONE, lambda m: 9 <= len(only(m)) <= 15)]
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(text or "") if ok(m)]
    return sorted(found)


def base_row(doc_id, text):
    found = base_spans(text)
    names = pii.BASE_KINDS
    return (doc_id, *(sum(k == j for _, k, _ in found) for j in range(4)),
            H.sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in found)))


def hard_texts():
    draw = random.Random(3)
    parts = ["a.b@c.d", "@", ".", "..", "x", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111  1111 1111",
             "5500005555555559", "+1 (407) 555-7710", "+49 30 1234567", "+1", " ", "-", "é", "😀", "0", "12", "_", "%", "+", "@b.c.d", "\n",
             "00000000000001.2.3.4", "a@b..c", "a@b.c.", "a@b-.c-d"]
    return ["".join(draw.choices(parts, k=draw.randrange(1, 30))) for _ in range(800)]


def test_personal_data_base_spans(spark):
    texts = hard_texts() + ["a" * 5_000, "a@b" + ".c" * 20_000, "1 " * 30_000, "1" * 5_000, "x@y.zz " * 3000, "+1" * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").unionByName(
        spark.createDataFrame(H.ROWS, H.SCHEMA).select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    docs = docs.unionByName(read(spark, SF_MED, "documents").select((F.col("doc_id") + 200_000).alias("doc_id"), "text"))
    want = sorted(map(repr, (base_row(r.doc_id, r.text) for r in docs.collect())))
    found = pii.find_personal_data(docs)
    held = [pii.count_kind(F.col("base"), k) for k in range(4)]
    got = found.select("doc_id", *held, F.sha2(pii.digest(F.col("base")), 256)).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    long_runs = spark.createDataFrame([(1, "a" * 500_000), (2, "1" * 300_000), (3, "1." * 100_000), (4, "a.b@" * 50_000)], "doc_id bigint, text string")
    assert pii.find_personal_data(long_runs).count() == 4
    names = {r.doc_id: r for r in found.collect()}
    for r in names.values():
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_secrets(spark):
    """Keys and tokens that are named or begin as such; not hashes, ids and long words."""
    draw = random.Random(9)
    key = lambda n, letters="0123456789abcdef": "".join(draw.choice(letters) for _ in range(n))
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    held = [f'some words token = "{key(40)}" and more' for _ in range(30)] + [f"api_key={key(32)}" for _ in range(30)]
    held += [f"use AKIA{key(16, wide[:26] + wide[-10:])} here" for _ in range(30)] + [f"Authorization: Bearer {key(48, wide)}" for _ in range(30)]
    held += [f"my password is {key(18, wide)}7q" for _ in range(20)]
    clean = [f"commit {key(40)} fixed it" for _ in range(30)] + [f"see https://x.example/a/{key(24)}/b" for _ in range(30)]
    clean += ["the key to unquestionablylongwords is practice", "token token token", "secret = aaaaaaaaaaaaaaaaaaaaaaaa1", "x" * 100_000 + "1"]
    clean += ["plain words without any of it"] * 50
    rows = list(enumerate(held + clean))
    got = {r.doc_id: [(x.name, x.start, x.end) for x in r.spans] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, text in rows:
        if i < len(held):
            (name, start, end), = got[i]
            assert name == "secret" and re.fullmatch("[A-Za-z0-9]{16,}", text[start:end]) and not text[end:end + 1].isalnum()
        else:
            assert got[i] == []


def test_personal_data_added_kinds_and_awkward_rows(spark):
    rows = [(i, f"please call my phone {200 + i}-555-{1000 + i} or write to a{i}@example.com today") for i in range(100)]
    rows += [(100 + i, f"version release {200 + i}-555-{1000 + i} of order") for i in range(100)]
    got = {r.doc_id: [x.name for x in r.spans] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == ["local_phone", "email"] for i in range(100))
    assert all(got[100 + i] == [] for i in range(100))
    assert pii.find_personal_data(H.awkward(spark)).count() == len(H.ROWS)
    assert pii.find_personal_data(H.empty(spark)).count() == 0
