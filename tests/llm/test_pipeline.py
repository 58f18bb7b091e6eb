import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
FILES = "/root/testdata/sf0.001"


def test_each_stage_filters_and_keeps_columns(spark):
    docs = spark.read.parquet(f"{FILES}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, FILES).collect(), docs.schema)
        assert docs.columns == columns, name
        after = docs.count()
        assert 0 < after <= before
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FILES)
    assert last.count() == before
    assert last.filter("n_tokens <> size(ids)").count() == 0


def kept(frame):
    return sorted((str(r.doc_id), str(r.text), str(r.source)) for r in frame.collect())


#: Ids of the awkward rows that a stage takes out: a row's words again, a long text again, and a line with one word more.
GONE = {"lines": set(), "near_duplicates": {6, 8, 11}, "benchmark": set()}


@pytest.mark.parametrize("name", list(GONE))
def test_awkward_rows_stay_or_go_as_stated(spark, awkward, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, awkward, FILES)
    assert out.columns == awkward.columns
    stay = awkward.filter(f"doc_id IS NULL OR doc_id NOT IN ({', '.join(map(str, GONE[name] | {-1}))})")
    assert kept(out) == kept(stay)


def test_quality_keeps_rows_by_their_score(spark, awkward):
    from loomspan.llm import quality

    out = dict(corpus_pipeline.STAGES)["quality"](spark, awkward, FILES)
    docs, labels = (spark.read.parquet(f"{FILES}/{t}.parquet") for t in ("documents", "labels"))
    scores = {}
    for r in quality.score(awkward, quality.fit(awkward, labels)).collect():
        scores.setdefault(r.doc_id, []).append(r.score)
    assert docs.count() and set(kept(out)) <= set(kept(awkward)) and out.columns == awkward.columns
    by_id = {}
    for r in out.collect():
        by_id[r.doc_id] = by_id.get(r.doc_id, 0) + 1
    assert by_id == {i: n for i, n in ((i, sum(x >= quality.GOOD for x in xs)) for i, xs in scores.items()) if n}


def test_tokens_of_awkward_rows(spark, awkward):
    rows = dict(corpus_pipeline.STAGES)["tokens"](spark, awkward, FILES).collect()
    assert len(rows) == awkward.count() and all((r.n_tokens == 0) == (not r.ids) for r in rows)
    empty_ids = {r.doc_id for r in awkward.collect() if not r.text}
    assert {r.doc_id for r in rows if r.n_tokens == 0} == empty_ids


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, empty, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, empty, FILES)
    assert out.collect() == [] and (name == "tokens" or out.columns == empty.columns)
