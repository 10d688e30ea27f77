"""The pipeline's stages, each on its own input, against brute force."""

import base64

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from postlake.llm import line_dedup
from postlake.llm.common import read, stored
from postlake.session import folders, shared_dir
from tests.conftest import SF_SMALL
from tests.llm import helpers as H


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_and_run(spark):
    docs = read(spark, SF_SMALL, "documents")
    columns = docs.columns
    frames = [docs]
    for name, stage in P.STAGES:
        out = stored(stage(spark, frames[-1], SF_SMALL), f"test-{name}")
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
        frames.append(out)
    start, told, lines, once, clean, coded = frames

    assert texts(told).keys() == {d for d, t in texts(start).items() if any(c.isalpha() for c in t)}
    expected = {r.doc_id: r.text for r in line_dedup.line_dedup(told).collect()}
    before = texts(told)
    assert texts(lines) == {d: t for d, t in expected.items() if t.strip() or not before[d].strip()}
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    roots = H.components({d: H.simhash(t) for d, t in texts(lines).items()})
    assert texts(once).keys() == set(roots.values())
    wins = H.windows((str(r.item_id), r.text) for r in read(spark, SF_SMALL, "benchmark").collect())
    assert texts(clean).keys() == {d for d, t in texts(once).items() if not H.hits(t, wins)[1]}
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in coded.collect()}
    assert got.keys() == texts(clean).keys()
    for d, t in texts(clean).items():
        assert got[d].ids == library.encode_ordinary(t) and got[d].decoded_sha256 == H.sha(t)

    known = set(folders(spark, shared_dir(spark)))
    again = {r.doc_id: r.ids for r in P.run(spark, SF_SMALL).collect()}
    assert again == {d: r.ids for d, r in got.items()}
    # Of the stages' tables only the one that the result is read from is left.
    stages = {x.rsplit("-", 1)[0] for x in set(folders(spark, shared_dir(spark))) - known if "llm-stage" in x}
    assert stages == {f"llm-stage-{P.STAGES[-2][0]}"}


def test_stages_on_awkward_and_empty_tables(spark):
    for docs in (H.awkward(spark).select(*P.COLUMNS, "th", "fp", "w"), H.empty(spark)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF_SMALL)
            n = out.count()
            assert n <= docs.count()
            if name != P.STAGES[-1][0]:
                docs = stored(out, "awkward")
