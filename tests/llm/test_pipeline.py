import pytest

import corpus_pipeline
from quayline.llm import langid, secrets
from tests.llm.test_neardup import brute
from tests.llm.test_tokens import library  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows after each stage."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, DATA)
        out.append(rows.collect())
        docs = spark.createDataFrame(out[-1], rows.schema)
    return out


def test_every_stage_against_brute_force(spark, stages, library):  # noqa: F811
    before, lang, near, clean, redacted, tokens = stages
    assert {r.doc_id for r in before} - {r.doc_id for r in lang} <= {r.doc_id for r in before if not langid._LETTER.search(r.text or "")}
    kept = [int(x[0]) for x in brute([tuple(r) for r in lang], corpus_pipeline.NEAR_PERCENT) if x[3]]
    assert sorted(r.doc_id for r in near) == sorted(kept)
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in near if any(i in " ".join(r.text.split()) for i in items)}
    assert {r.doc_id for r in near} - {r.doc_id for r in clean} == leaks
    texts = {r.doc_id: r.text for r in clean}
    assert {r.doc_id: r.text for r in redacted} == {i: secrets.redact(t, secrets.spans(t)) for i, t in texts.items()}
    after = {r.doc_id: r.text for r in redacted}
    assert all(r.lossless and library.decode(list(r.token_ids)) == after[r.doc_id] for r in tokens) and len(tokens) == len(after)


def test_columns_and_run(spark, stages):
    assert [list(rows[0].asDict()) for rows in stages[:5]] == [list(corpus_pipeline.COLUMNS)] * 5
    got = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.n_tokens) for r in got.select("doc_id", "n_tokens").collect()) == sorted((r.doc_id, r.n_tokens) for r in stages[-1])
