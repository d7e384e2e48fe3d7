"""The pipeline's stages on the test documents, each against what it must do to its own input."""

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as entry
from check import rows_of
from hirelake.llm.common import table
from hirelake.llm.queries import LLM_ORACLES, LLM_QUERIES
from hirelake.session import cut_lineage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut_lineage(stage(spark, docs, SF))
        out.append((name, before, docs))
    return out


def test_stages_keep_the_columns_of_documents(spark, stages):
    assert [n for n, _, _ in stages] == ["toxicity", "line dedup", "near-duplicates", "decontamination", "mixing"]
    for _, before, after in stages[:-1]:
        assert sorted(after.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars"]) and after.count() > 0


def test_each_stage_does_its_work(spark, stages):
    from test_simhash_lines import plain_components, plain_dedup  # the test folder is on the path

    rows = [[(r["doc_id"], r["text"]) for r in after.collect()] if "text" in after.columns else None for _, _, after in stages]
    toxic = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    kept = {i for i, _ in rows[0]}
    assert len(kept & toxic) <= 0.2 * len(toxic) + 1
    assert len(kept) >= 0.9 * (table(spark, SF, "documents").count() - len(toxic))
    assert sorted(rows[1], key=str) == plain_dedup(rows[0])
    assert {i for i, _ in rows[2]} == {c[2] for c in plain_components(rows[1])} and len(rows[2]) == len({i for i, _ in rows[2]})
    assert {i for i, _ in rows[3]} <= {i for i, _ in rows[2]}
    mixed = stages[-1][2].collect()
    assert {r["doc_id"] for r in mixed} == {i for i, _ in rows[3]} and all(r["taken"] <= 2 * r["size"] for r in mixed)


def test_run_applies_the_stages(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1][2].collect()))


def test_registered():
    queries = entry.queries()
    assert set(LLM_QUERIES) | {"pipeline"} <= set(queries) and set(LLM_ORACLES) <= set(entry.oracle_sql())
    assert [f"op{n}_" for n in range(1, 11)] == [q[:q.index("_") + 1] for q in LLM_QUERIES]


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_matches_its_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = LLM_QUERIES[name](spark, SF)
    cur = con.execute(LLM_ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(LLM_QUERIES) - set(LLM_ORACLES)))
def test_query_answers_for_every_row(spark, name):
    got = LLM_QUERIES[name](spark, SF)
    expected = {"op2_main_text": "pages"}.get(name, "documents")
    if name != "op7_decontamination":
        assert got.count() == table(spark, SF, expected).count()
    else:
        assert got.where("edits is null or item_id is null").count() == 0
