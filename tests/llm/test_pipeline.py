"""The pipeline's stages on a messy table and on an empty one."""

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EXTRA = {"size": "'x'", "rank": "1", "score": "'s'", "n": "'n'", "node": "2", "key": "'k'", "copies": "'c'", "_key": "0"}  # names the operators use
LINE = "A line that four documents have in common."


def test_stages(spark, tmp_path):
    clean = [(i, f"{LINE}\n" * (i < 4) + " ".join(f"t{i}w{j}" for j in range(30)), "en", f"s{i % 3}", 9) for i in range(40)]
    bad = [(100 + i, " ".join(f"b{i}w{j}" for j in range(20)) + " dreadful", "en", "s0", 9) for i in range(30)]
    near = [(200, clean[20][1], "en", "s1", 9), (201, clean[20][1] + " more", None, None, None)]
    odd = [(300, None, None, None, None), (301, "", "en", "s9", 0), (None, "no id here", "en", "s1", 3), (302, "x" * 200_000, "en", "s2", 5)]
    odd += [(303, "the same row twice, without a like", "en", "s1", 1)] * 2 + [(304, "b second text of one id", "en", "s1", 1), (304, "a first text of one id", "en", "s1", 1)]
    spark.createDataFrame(clean + bad + near + odd, SCHEMA).selectExpr("*", *[f"{e} AS {c}" for c, e in EXTRA.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 1, int(r[0] >= 100)) for r in clean + bad]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    whole = {r[0] for r in clean + near + odd}
    assert ids(seen["toxicity"]) == whole
    texts = {r["doc_id"]: r["text"] for r in seen["line dedup"].collect()}
    assert set(texts) == whole and [LINE in texts[i] for i in range(4)] == [False, False, False, True]
    assert ids(seen["near duplicates"]) == whole - {200, 201}
    kept = [(r["doc_id"], r["text"]) for r in seen["near duplicates"].where("doc_id in (303, 304)").collect()]
    assert sorted(kept) == [(303, "the same row twice, without a like"), (304, "a first text of one id")]
    assert ids(seen["mixing"]) <= whole - {200, 201}
    total = seen["packing"].groupBy().sum("length").first()[0]
    assert total >= seen["mixing"].count()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
