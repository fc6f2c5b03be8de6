import tracemalloc

import pyarrow as pa

import corpus_pipeline
from engramite.llm import textops
from engramite.llm.common import TEXT_ROWS, written
from tests.llm import test_decontaminate, test_minhash, test_packing
from tests.llm.frames import clashing, docs, prose
from tests.llm.test_secrets import KEY

ITEM = test_decontaminate.ITEM


def corpus():
    clean = [prose(k, 80) for k in range(20)]
    return [*clean, "### $$$ %%% {} " * 20, test_minhash.near(clean[3], 1, 0.02), clean[4], f"{prose(50, 60)} {ITEM} {prose(51, 60)}", f"{prose(52, 60)} {KEY} {prose(53, 60)}", None, "", prose(60, 9000)]


def stage_by_stage(spark, table, bench):
    out, now = {}, table
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, bench))
        out[name] = now
    return out


def folder(spark, tmp_path, table):
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_every_stage_against_brute_force(spark, tmp_path):
    texts = corpus()
    sf = folder(spark, tmp_path, docs(spark, texts))
    out = stage_by_stage(spark, docs(spark, texts), sf)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scan", "packing"]
    ids = {n: sorted(r.doc_id for r in out[n].collect()) for n in names[:-1]}
    good = [i for i in range(len(texts)) if i not in (20, 25, 26)]
    assert ids["quality_rules"] == good
    kept = [texts[i] for i in good]
    assert ids["near_duplicates"] == [good[k] for k, r in enumerate(test_minhash.brute(kept, 0.6)) if r == k]
    assert ids["secret_scan"] == ids["benchmark_decontamination"] == ids["near_duplicates"]
    cut = {r.doc_id: r.text for r in out["benchmark_decontamination"].collect()}
    assert ITEM not in cut[23] and all(cut[i] == texts[i] for i in cut if i != 23)
    last = {r.doc_id: r.text for r in out["secret_scan"].collect()}
    assert KEY not in last[24] and "[aws_access_key]" in last[24] and all(last[i] == cut[i] for i in last if i != 24)
    assert all(r.n_chars == len(r.text) for r in out["secret_scan"].collect())
    windows = out["packing"].collect()
    test_packing.check(windows, last, 4096)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sum(w.n_tokens for w in whole) == sum(w.n_tokens for w in windows)


def test_extra_columns_and_nulls_pass(spark, tmp_path):
    table = clashing(docs(spark, [prose(1, 50), prose(1, 50), prose(2, 50)], [None, None, 3])).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS source", "CAST(NULL AS BIGINT) AS n_chars", "`a.b`", "key", "t", "blob", "spans")
    out = stage_by_stage(spark, table, folder(spark, tmp_path, docs(spark, [])))
    assert out["secret_scan"].columns == table.columns and out["secret_scan"].count() == 2


def test_empty_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, docs(spark, []))).count() == 0


def test_stages_send_few_rows_at_a_time_and_leave_the_session_as_it_is(spark, tmp_path):
    table, before = docs(spark, [prose(k, 30) for k in range(3)]), dict(spark.conf.getAll)
    bench = folder(spark, tmp_path, table)
    for _, stage in corpus_pipeline.STAGES:
        own = stage(spark, table, bench).sparkSession.conf
        assert int(own.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= TEXT_ROWS
        assert int(own.get("spark.sql.parquet.columnarReaderBatchSize")) <= TEXT_ROWS
        assert own.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    assert dict(spark.conf.getAll) == before


def test_words_are_hashed_in_little_memory():
    texts = [prose(k, 3000) for k in range(60)] + ["x" * 100_000, None, "", "Ä" * 40_000 + " end"]
    tracemalloc.start()
    hashes, offs = textops.words(pa.array(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(len(t or "") for t in texts)
    known = {w: int(textops.words(pa.array([w]))[0][0]) for t in texts for w in (t or "").split()}
    for k, t in enumerate(texts):
        assert hashes[offs[k] : offs[k + 1]].tolist() == [known[w] for w in (t or "").split()]
