"""The pipeline's stages, each against what it should do to its own input."""

import importlib
import inspect

import pytest
import sentencepiece

from docweft.llm import decontaminate, line_dedup, near_dup, pieces, toxicity

from .test_text_filters import groups_by_force

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Input and result of every stage, written and read again."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for i, (name, f) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        f(spark, docs, small).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(spark, small, stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    columns = spark.read.parquet(f"{small}/documents.parquet").dtypes
    assert all(after.dtypes == columns for _, _, after in stages[:-1])
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in pipeline.STAGES)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_toxic_documents_go(spark, small, stages):
    _, before, after = stages[0]
    chain = toxicity.train(before, spark.read.parquet(f"{small}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scored(before, chain).where("is_toxic").collect()}
    assert set(rows(after)) == set(rows(before)) - bad
    assert all(r == rows(before)[d] for d, r in rows(after).items())


def test_boilerplate_lines_go(stages):
    _, before, after = stages[1]
    sites: dict = {}
    for r in before.collect():
        for x in r.text.split("\n"):
            if x.strip():
                sites.setdefault(x.strip(), set()).add(r.source)
    bad = {x for x, s in sites.items() if len(s) >= 10}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if x.strip() not in bad) for r in before.collect()}
    assert {d: r.text for d, r in rows(after).items()} == want


def test_one_of_each_group_stays(stages):
    _, before, after = stages[2]
    gone = {d for d, root, _ in groups_by_force([(r.doc_id, r.text) for r in before.collect()]) if d != root}
    assert len(gone ^ (set(rows(before)) - set(rows(after)))) <= 0.05 * len(gone) + 1


def test_contaminated_documents_go(spark, small, stages):
    _, before, after = stages[3]
    bad = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    items = [r.text.lower() for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert {d for d, r in rows(before).items() if any(t in r.text.lower() for t in items)} <= bad
    assert set(rows(after)) == set(rows(before)) - bad


def test_all_that_is_left_is_encoded(stages):
    _, before, after = stages[4]
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = rows(before)
    assert {d: r.ids for d, r in rows(after).items()} == {d: lib.encode(r.text) for d, r in text.items()}


def test_run_is_all_stages(spark, small, stages):
    assert {d: r.ids for d, r in rows(pipeline.run(spark, small)).items()} == {d: r.ids for d, r in rows(stages[-1][2]).items()}


def test_stages_handle_nulls_and_repeated_rows(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, "null id", "en", "s", 7), (900001, None, None, None, None), (900002, "", "en", None, 0), (900003, "kept once", "en", "s", 9), (900003, "kept once", "en", "s", 9)], d.schema)
    docs = d.unionByName(odd)
    for name, f in pipeline.STAGES:
        docs = f(spark, docs, small)
        left = docs.collect()
        assert sum(r.doc_id is None for r in left) == 1 and sum(r.doc_id == 900001 for r in left) == 1 and sum(r.doc_id == 900003 for r in left) == 2, name
        docs = spark.createDataFrame(left, docs.schema)
    empty = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, f in pipeline.STAGES:
        assert f(spark, empty, small).count() == 0


def test_thresholds_are_those_of_the_operators():
    assert inspect.signature(near_dup.near_duplicates).parameters["threshold"].default == 0.6
    assert inspect.signature(line_dedup.boilerplate).parameters["min_sites"].default == 10
