"""Whole blocks are read, and plans do not change with the size of a table."""

import numpy as np

from colloq.llm import bayes_dedup, common, html_blocks


def test_every_word_of_a_block_counts():
    words = [f"w{i}" for i in range(60)]
    seen = [html_blocks.features(html_blocks.blocks("<p>" + " ".join(w)))[0][1] for w in (words, *([*words[:i], "other", *words[i + 1 :]] for i in range(60)))]
    assert all(len(x) == 60 for x in seen) and len(set(seen)) == 61
    net = html_blocks.Labeller()
    net.p["word"] = np.random.default_rng(1).standard_normal(net.p["word"].shape).astype(np.float32)
    once, turned = (net._inputs([html_blocks.features(html_blocks.blocks("<p>" + " ".join(w)))])[0] for w in (words, words[20:] + words[:20]))
    assert np.allclose(once, turned, atol=1e-5)


def shuffled(df):
    """Rows that the exchanges of a run of ``df`` wrote."""
    df.collect()
    found, total = [df._jdf.queryExecution().executedPlan()], 0
    while found:
        plan = found.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            found.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            found.append(plan.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += plan.metrics().apply("shuffleRecordsWritten").value()
            found += [plan.children().apply(i) for i in range(plan.children().size())]
    return total


def test_texts_without_partner_stay_where_they_are(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(-2000, 4000).selectExpr("id AS doc_id", "concat('text ', id) AS text").unionByName(spark.createDataFrame([(None, "x"), (7, "again")], "doc_id long, text string"))
        ids = spark.createDataFrame([(-5,), (7,), (7,), (3999,), (9_999,), (None,)], "doc_id long")
        got = common.those_of(rows, ids, "doc_id")
        assert sorted(map(tuple, got.collect())) == [(-5, "text -5"), (7, "again"), (7, "text 7"), (3999, "text 3999")]
        assert shuffled(got) < 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_near_duplicates_move_the_texts_of_candidates_alone(spark, monkeypatch):
    limit, moved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    monkeypatch.setattr(bayes_dedup, "durable", lambda df: (moved.append(df) if df.columns == ["rep", "sig", "shingles"] else None, common.durable(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(400)]
        texts[17] = texts[3] + " end"
        rows = {r["doc_id"]: r["component_id"] for r in bayes_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        assert rows == {i: 3 if i == 17 else i for i in range(400)}
        assert len(moved) == 1 and shuffled(moved[0]) < 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_keys_of_one_member_are_not_shuffled_twice(spark, monkeypatch):
    limit, moved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), []
    monkeypatch.setattr(bayes_dedup, "durable", lambda df: (moved.append(df) if df.columns == ["key", "lead", "rep"] else None, common.durable(df))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(k, k) for k in range(1000)] + [(5, 4), (5, 6), (-7, 1), (-7, 2), (-7, 2), (-8, 2), (-8, 1)]
        got = bayes_dedup.bucket_members(spark.createDataFrame(rows, "key long, rep long")).collect()
        assert sorted((r["key"], r["size"], r["lead"], r["rep"]) for r in got) == [(-8, 2, 1, 1), (-8, 2, 1, 2), (5, 3, 4, 4), (5, 3, 4, 5), (5, 3, 4, 6)]
        assert len(moved) == 1 and shuffled(moved[0]) < 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
