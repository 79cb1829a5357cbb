import re

import corpus_pipeline
from tidepool.llm import common, decontaminate, mixing, simhash, toxicity


def test_stages_step_by_step(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    clean = kept["toxicity"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), labels, ~common.fold("id", 4))
    assert clean.keys() == {i for i, r in before.items() if model.score(r.text) < toxicity.THRESHOLD}
    prints = {i: simhash.fingerprint(r.text) for i, r in clean.items()}
    unique = kept["simhash_near_dedup"]
    ids = sorted(unique)
    assert all((prints[a] ^ prints[b]).bit_count() > 4 for n, a in enumerate(ids) for b in ids[:n])
    phrases = decontaminate.Phrases([(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], 10)
    assert phrases.find([decontaminate.words_of(r.text) for r in unique.values()])
    assert not phrases.find([decontaminate.words_of(r.text) for r in kept["benchmark_decontamination"].values()])
    masked = kept["personal_data"]
    assert masked.keys() == kept["benchmark_decontamination"].keys()
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]", r.text or "") for r in masked.values())
    assert all(r.n_chars == len(r.text) for stage in kept.values() for r in stage.values())
    mixed = kept["mixing"]
    assert {"size", "source_size", "target", "taken"} <= set(docs.columns)
    for source in {r.source for r in masked.values()}:
        own = [r for r in mixed.values() if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) < 1
    assert all(0 < r.taken <= mixing.MOST * r.size for r in mixed.values())


def test_run_equals_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, sf).collect()))


def test_each_stage_runs_once(spark, sf, monkeypatch):
    seen = [spark.sparkContext.accumulator(0) for _ in range(3)]

    def stage(i):
        def run(spark, docs, sf_dir):
            def count(batches):
                for b in batches:
                    seen[i].add(b.num_rows)
                    yield b

            return docs.mapInArrow(count, docs.schema)

        return f"stage_{i}", run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage(i) for i in range(3)])
    n = len(corpus_pipeline.run(spark, sf).collect())
    assert [x.value for x in seen] == [n] * 3


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    text = "word " * 30
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, text, "en", "a", None, "x"), (3, text, "en", "a", None, "x"), (4, text + "a@b.com", None, None, 1, "x"), (None, "some other text of a few words", "de", "b", 5, "x"), (5, "long line " * 60_000, "fr", "b", 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __id string")
    spark.createDataFrame([(4, None, 1), *[(i, 0, 0) for i in range(5, 30)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), docs.schema)
            assert now.columns == docs.columns
        mixed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert (len(mixed) > 0) == (start is docs)
