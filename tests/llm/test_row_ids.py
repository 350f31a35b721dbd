"""Stages keep the right rows when the same files are split otherwise at a later scan."""

import collections

import pytest

from colloq.llm import bayes_dedup, block_names, common, entropy_mix

SPLIT = "spark.sql.files.minPartitionNum"


@pytest.fixture
def moving(spark, tmp_path_factory, monkeypatch):
    """Documents in eight files; after each table that is written, the files are split otherwise."""
    path = str(tmp_path_factory.mktemp("moving") / "d.parquet")
    rows = [(i, f"text {i % 40} " + "w " * (i % 40) + " " * (i // 40), f"s{i % 3}") for i in range(160)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8, "doc_id").write.parquet(path)
    many = [1]

    def durable(df, own=common.durable):
        out = own(df)
        many[0] = 9 - many[0]
        spark.conf.set(SPLIT, str(many[0]))
        return out

    for module in (common, block_names, entropy_mix):
        monkeypatch.setattr(module, "durable", durable)
    spark.conf.set(SPLIT, "1")
    yield rows, spark.read.parquet(path)
    spark.conf.unset(SPLIT)


@pytest.mark.parametrize("split", ["1", "8"])
def test_exact(spark, moving, split):
    rows, docs = moving
    left = block_names.drop_exact_duplicates(docs)
    spark.conf.set(SPLIT, split)
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(120, 160))


@pytest.mark.parametrize("split", ["1", "8"])
def test_mix(spark, moving, split):
    rows, docs = moving
    want = {r["doc_id"]: r["copies"] for r in entropy_mix.mixed(docs).collect() if r["copies"]}
    mixed = entropy_mix.mix(docs)
    spark.conf.set(SPLIT, split)
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == want


def test_columns_with_clashing_names(spark):
    rows = [(i, f"word{i // 2} " * 5, "s", i, f"c{i}", i * 2.0) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _row long, `_copy` string, `a.b` double")
    left = block_names.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(tuple(r) for r in left.collect()) == rows[::2]
    mixed = entropy_mix.mix(docs)
    assert mixed.columns == docs.columns and set(map(tuple, mixed.collect())) <= set(rows)
    assert sorted(tuple(r) for r in bayes_dedup.drop_near_duplicates(docs).collect()) == rows[::2]
