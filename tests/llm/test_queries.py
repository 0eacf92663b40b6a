import duckdb
import pytest

from courtspark.llm import registry


def plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_query_is_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = registry.queries()[name](spark, sf_dir)
    want = con.execute(f"select {', '.join(got.columns)} from ({registry.sql()[name]})").fetchall()
    assert plain(got.collect()) == plain(want)


def test_pipeline_takes_effect(spark, sf_dir):
    import corpus_pipeline as C
    from courtspark.llm.common import table
    from courtspark.llm.decontaminate import decontaminate
    from courtspark.llm.jaccard_join import jaccard_rows

    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in C.STAGES:
        docs = table(stage(spark, docs, sf_dir), "stage")
        kept.append((name, docs))
    assert [d.columns for _, d in kept[:-1]] == [list(C.COLUMNS)] * 4
    near, clean, mixed, shards = (d for _, d in kept[1:])
    assert jaccard_rows(near).where("not stays").count() == 0
    assert decontaminate(clean, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    assert mixed.select("doc_id").distinct().join(clean, "doc_id", "left_anti").count() == 0
    assert shards.count() == mixed.count() and shards.select("shard").distinct().count() <= 40


def test_stages_take_nulls_repeats_extra_columns_and_nothing(spark, sf_dir, docs):
    import corpus_pipeline as C

    rows = [(1, None), (1, None), (None, "the same words here and there again"), (2, ""), (3, "w " * 30_000), (4, "plain text of some words"), (4, "plain text of some words"), (5, "plain text of some words")]
    kept = docs(rows)
    for name, stage in C.STAGES:
        got = stage(spark, kept, sf_dir)
        assert got.count() >= (0 if name == "mixing sources" else 1), name
        assert stage(spark, docs([]), sf_dir).count() == 0
    assert {r["doc_id"] for r in C.one_of_near_copies(spark, kept, sf_dir).collect()} == {None, 1, 2, 3, 4}
    assert C.no_benchmark_items(spark, kept, sf_dir).count() == len(rows)
