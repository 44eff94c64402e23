import json
import os
import statistics
import tempfile

import pytest
from pyspark.sql import functions as F

from evalloom.functions import formats, names
from evalloom.operators import leaderboard as lb
from evalloom.operators import results, runs
from evalloom.operators.encode import ArrowTokenizer, VocabTokenizer, build_vocab, encode_sft
from evalloom.operators.predict import batch_predict
from evalloom.plans import jobs
from evalloom.sources import readers, sinks
from evalloom.streaming import streams


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="run-")


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


HEADER = "base_model,dataset_name,subset,init_lora_weights,extra,seed,metric_eval_accuracy,r,lora_alpha,target_modules\n"
CELL = '"[""query"", ""key""]"'


def result_files(folder):
    one = HEADER + "".join(f"m,glue,mrpc,{i},,{s},{v},16,1,{CELL}\n" for i, s, v in
        [("eva", 1, 0.5), ("eva ", 2, 0.75), ("pissa", 1, 0.9), ("olora", 1, 0.9), ("kaiming", 3, 0.123456789012)])
    two = HEADER.replace("seed,", "seed,run_time,") + f"m,glue,rte,eva,,1,3.5,0.25,16,1,{CELL}\n"
    write(f"{folder}/a/mrpc/eval_results.csv", one)
    write(f"{folder}/a/rte/eval_results.csv", two)
    write(f"{folder}/a/notes.csv", "x\n1\n")


def test_leaderboard_from_files(spark, folder):
    result_files(folder)
    found = readers.scan_results(spark, [f"{folder}/a", f"{folder}/a/", f"{folder}/a"])
    assert found.count() == 2
    rows = readers.read_result_csv(spark, found)
    assert rows.filter("dataset_name = 'glue' and target_modules = '[\"query\", \"key\"]' and r = 16").count() == 6
    assert rows.filter("run_time is not null").count() == 1
    board = jobs.build_leaderboard(spark, [f"{folder}/a"]).collect()
    got = [(r["init_lora_weights"], r["metric_eval_accuracy_n"]) for r in board]
    assert got == [("pissa", 1), ("olora", 1), ("eva", 2), ("kaiming", 1), ("eva", 1)]
    assert board[2]["metric_eval_accuracy_std"] == pytest.approx(statistics.stdev([0.5, 0.75]))
    assert board[0]["metric_eval_accuracy_std"] == 0.0
    sinks.write_avg(jobs.build_leaderboard(spark, [f"{folder}/a"]).drop("source_path"), f"{folder}/b_results_avg.csv")
    text = "".join(open(f"{folder}/b_results_avg.csv/{f}").read() for f in sorted(os.listdir(f"{folder}/b_results_avg.csv")) if f.endswith(".csv"))
    assert "m,glue,kaiming,,16,1,0.123456789,0,1" in text
    sinks.write_avg(jobs.build_leaderboard(spark, [f"{folder}/a"]), f"{folder}/by_source")
    assert sum(d.startswith("source_path=") for d in os.listdir(f"{folder}/by_source")) == 2
    with pytest.raises(ValueError):
        sinks.write_avg(rows.filter("r = 9"), f"{folder}/none")
    with pytest.raises(ValueError, match="no file named"):
        readers.scan_results(spark, [f"{folder}/a"], "*_results_avg.csv")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        readers.scan_results(spark, [f"{folder}/missing"])
    write(f"{folder}/c/results.csv", "")
    with pytest.raises(ValueError, match="no header"):
        readers.read_result_csv(spark, [f"{folder}/c/results.csv"])
    with pytest.raises(Exception, match="no number"):
        lb.leaderboard(rows.withColumn("metric_eval_accuracy", F.lit("x"))).collect()
    with pytest.raises(ValueError, match="missing columns"):
        lb.leaderboard(rows, metric="nope")
    assert sinks.average_path("/x/eval_results.csv") == "/x/eval_results_avg.csv"
    assert lb.key_list(lb.LEADERBOARD_KEYS, ["subset", "r"])[-1] == "subset"


def test_leaderboard_keys(spark):
    df = spark.createDataFrame([(" a ", 1.0), ("a", 2.0), (None, 3.0), ("", 5.0)], "k string, m double")
    out = {r["k"]: (r["m_mean"], r["m_n"]) for r in lb.leaderboard(df, ["k", "k"], "m").collect()}
    assert out == {"a": (1.5, 2), "": (4.0, 2)}


def test_macro_mean(spark, folder):
    write(f"{folder}/p/a_results_avg.csv", "base_model,init_lora_weights,extra,r,lora_alpha,metric_eval_accuracy_mean,metric_eval_accuracy_std\nm,eva,,16,1,0.5,0.1\nm,olora,,16,1,,0.1\n")
    write(f"{folder}/q/a_results_avg.csv", "base_model,init_lora_weights,extra,r,lora_alpha,metric_eval_pearson_mean\nm,eva,,16,1,0.75\nm,olora,,16,1,0.25\n")
    out = jobs.build_macro_mean(spark, [folder]).collect()
    assert [(r["init_lora_weights"], r["metric_eval_mean_avg"], r["metric_eval_mean_n"]) for r in out] == [("eva", 0.625, 2), ("olora", 0.25, 1)]
    assert dict(lb.as_text_table(spark.range(1).select(F.lit(1 / 3).alias("d"))).dtypes) == {"d": "string"}
    with pytest.raises(ValueError):
        lb.macro_mean(spark.range(1), ["id"])


def test_append_and_rows(spark, folder):
    old = spark.createDataFrame([(1, "x")], "a int, b string")
    new = spark.createDataFrame([("y", 2.5)], "b string, c double")
    out = results.append_rows(old, new)
    assert out.columns == ["a", "b", "c"] and [tuple(r) for r in out.collect()] == [(1, "x", None), (None, "y", 2.5)]
    sinks.append_results(old, f"{folder}/t")
    sinks.append_results(new, f"{folder}/t")
    assert set(sinks.read_results(spark, f"{folder}/t").columns) == {"a", "b", "c"}
    write(f"{folder}/eval_results.csv", "a,b\n1,\"p \"\"q\"\"\"\n")
    sinks.append_result_csv(spark, f"{folder}/eval_results.csv", new, f"{folder}/next")
    back = readers.read_result_csv(spark, [f"{folder}/next"]).drop("source_path", "row_order")
    assert {tuple(r) for r in back.collect()} == {("1", 'p "q"', None), (None, "y", "2.5")}
    run_rows = spark.createDataFrame(
        [("r1", "t", "glue", "", "sr", 11, 2.5, ("org/base", "True", None, 8, 1, 0.0, ["q", "k]"], "none")), ("r2", None, None, None, None, None, None, None)],
        "run_name string, timestamp string, dataset_name string, subset string, extra string, seed int, run_time double, "
        "adapter struct<base_model_name_or_path string, init_lora_weights string, r int, lora_r int, lora_alpha int, lora_dropout double, target_modules array<string>, bias string>",
    )
    metric = spark.createDataFrame([("r1", 0.5), ("r2", 0.25)], "run_name string, eval_accuracy double")
    rows = results.result_rows(metric, run_rows, ["run_name"]).orderBy("run_name").collect()
    assert rows[0].asDict() == {
        "timestamp": "t", "base_model": "base", "dataset_name": "glue", "subset": None, "init_lora_weights": "kaiming",
        "extra": "sr", "seed": "11", "run_time": 2.5, "metric_eval_accuracy": 0.5, "r": 8, "lora_alpha": 1,
        "lora_dropout": 0.0, "target_modules": '["q", "k]"]', "bias": "none", "run_name": "r1",
    }
    assert rows[1]["init_lora_weights"] == "" and rows[1]["base_model"] == ""
    short = results.accuracy_rows(spark.createDataFrame([("m", "d", 1 / 3)], "model string, dataset string, accuracy double"))
    assert tuple(short.first()) == ("m", "d", "0.33333")


def test_formats(spark):
    def many(values, kind, make):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]

    nums = [0.5, 1 / 3, 1e-7, 123456789012.5, 0.0, None]
    assert many(nums, "double", formats.format_10g) == [None if n is None else f"{n:.10g}" for n in nums]
    assert many(["True", "TRUE", None, "pissa"], "string", formats.init_label) == ["kaiming", "kaiming", "", "pissa"]
    paths = [None, "", "out", "out/x.csv", "/a/b.d/", "x.csv", "a/.hid", "/x.csv"]

    def by_hand(p):
        base = p or "."
        if p and os.path.splitext(p)[1]:
            base = os.path.dirname(p) or "."
        return os.path.join(base, "eval_results.csv")

    assert many(paths, "string", formats.resolve_output_path) == [by_hand(p) for p in paths]


def test_run_paths(spark):
    cases = [
        ("m_d_r16_a1_eva_lora_s11_20260122090308", ("20260122090308", 11, "none"), None),
        ("/o/m_d_lora_sr-init#rp1&rwr0.03_s11_20260122090308/", ("20260122090308", 11, "sr-init#rp1&rwr0.03"), None),
        ("m_lora_sr-init#rp1&rwr0.03_s11_20260122_072326", ("072326", None, "none"), ("20260122_072326", 11, "sr-init#rp1&rwr0.03")),
        ("/o/m_lora_s7_20260122090308/checkpoint-100", ("20260122090308", 7, "none"), None),
        ("plain", ("plain", None, "none"), None),
        ("a_sx_t", ("t", None, "none"), None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, p string")
    for mode, at in (("strict", 1), ("robust", 2)):
        out = df.orderBy("i").select(names.parse_run_path(F.col("p"), mode).alias("s")).collect()
        assert [(r["s"]["timestamp"], r["s"]["seed"], r["s"]["extra"]) for r in out] == [c[at] or c[1] for c in cases]
        assert out[3]["s"]["run_name"] == "m_lora_s7_20260122090308"


def config_rows(spark):
    base = {
        "model": {"name_or_path": "org/m"}, "dataset": {"name": "meta/d", "subset": "mrpc"}, "timestamp": "T",
        "peft": {"variant": "lora", "lora_r": 16, "lora_alpha": 1, "init_lora_weights": True, "use_dora": False, "task_type": "SEQ_CLS", "target_modules": ["q", "k"]},
        "trainer": {"name": names.RESTART_TRAINER, "repeat_n": 1, "repeat_warmup_ratio": 0.03},
        "training": {"seed": 11, "learning_rate": "4e-4", "optim": "adamw_torch_fused", "per_device_train_batch_size": 4, "global_batch_size": 32, "bf16": True, "fp16": True},
        "num_processes": 2, "train_rows": 1000, "seconds": 120.0, "steps": 60, "samples": 240,
    }
    other = {**base, "trainer": None, "dataset": {"name": "d"}, "timestamp": None, "model": {}}
    lines = [json.dumps(base), json.dumps(other)]
    return spark.read.json(spark.createDataFrame([(l,) for l in lines], "value string").select("value").rdd.map(lambda r: r[0]))


def test_run_registry(spark, folder):
    configs = config_rows(spark).orderBy(F.col("timestamp").desc_nulls_last())
    first, second = names.run_name(configs).collect()
    assert first["run_name"] == "m_d_mrpc_r16_a1_True_lora_sr-init#rp1&rwr0.03_s11_T" and second["run_name"] is None
    assert names.cache_key(configs).first()["cache_key"] == "org-m_meta-d_mrpc_r16_dp512_23.pt"
    assert names.tracker_project(configs).first()["tracker_project"] == "nlp_org-m_d_mrpc"
    assert names.run_tags(configs).first()["tags"] == [
        "variant:lora", "rank:16", "alpha:1", "init:True", "lr:4e-04", "optim:adamw-fused", "bs:4x1", "bf16",
        "trainer:CleanedSvdRefactor", "data:meta/d", "model:m", "task:SEQ_CLS", "tgt-mods:q&k",
    ]
    checked = runs.check_runs(configs).collect()
    assert checked[0]["valid"] and checked[1]["failed_rules"] == ["model.name_or_path"]
    assert tuple(runs.check_summary(runs.check_runs(configs)).first()) == (2, 1, 1)
    assert runs.check_runs(configs, ["nope"]).first()["failed_rules"] == ["nope"]
    plan = runs.batch_plan(configs).first()
    assert [plan[c] for c in ("gradient_accumulation_steps", "real_per_device_train_batch_size", "max_steps", "eval_steps")] == [4, 4, 93, 1]
    odd = runs.batch_plan(configs.withColumn("num_processes", F.lit(3)), flag_errors=True).first()
    assert "divide" in odd["plan_error"]
    with pytest.raises(Exception, match="divide"):
        runs.batch_plan(configs.withColumn("num_processes", F.lit(3))).collect()
    assert configs.select(runs.global_batch_size(configs)).first()[0] == 32
    flat = spark.createDataFrame([("o/m", "o/d", 512, 16, 2, 4, 9, "ratio", 0.99, True, False, True)],
        "model_name string, dataset_name string, model_max_length int, rank int, rho int, batch_size int, seed int, early_stop_redist_metric string, "
        "early_stop_sim_thresh double, scale_by_singular_values boolean, whiten boolean, use_label_mask boolean")  # fmt: skip
    assert names.factor_ref(flat).first()["factor_ref"] == "m_d_len512_r16_rho2_bs4_seed9_ratio0.99_scaled_labelmask"
    track = spark.createDataFrame([("o/m", "o/d", "lora", 16, "eva", False, "x_rho2_scaled_svd.bin", 4)],
        "model_name string, dataset_name string, adapter_type string, lora_dim int, lora_init string, redistribute boolean, svd_filepath string, n_components_for_init int")
    assert names.tracker_name(track).first()["tracker_name"] == "m_d_lora_r16_eva_rho2_scaled_n_init4"
    settings = spark.createDataFrame([(1, {"a.b": "1", "a.c": "2", "d": "3", "e.f": "4"})], "k int, settings map<string,string>")
    over = spark.createDataFrame([(1, {"a.b": "9", "d": None, "e": "x", "n": "y"})], "k int, settings map<string,string>")
    assert runs.merge_settings(settings, over, "k").first()["settings"] == {"a.b": "9", "a.c": "2", "d": None, "e": "x", "n": "y"}
    assert runs.merge_settings(settings, over.filter("k = 2"), "k").first()["settings"]["d"] == "3"
    grid = runs.run_grid(spark.createDataFrame([(1,), (2,)], "seed int"), ["eva", "true"], ["true"])
    assert grid.count() == 6
    done = spark.createDataFrame([(1, "eva", False), (2, "true", True)], "seed int, init_lora_weights string, restart boolean")
    assert runs.missing_runs(grid, done).count() == 4
    sinks.write_manifest(configs, f"{folder}/manifest")
    assert spark.read.json(f"{folder}/manifest").first()["total_training_time"] == 2.0
    from evalloom.operators.runlog import run_rates

    rates = run_rates(configs).first()
    assert (rates["minutes"], rates["sec_per_step"], rates["samples_per_sec"]) == (2.0, 2.0, 2.0)


def test_adapters(spark, folder):
    write(f"{folder}/o/one/adapter_config.json", '{\n "r": 8, "base_model_name_or_path": "x/y"\n}')
    write(f"{folder}/o/two/other.txt", "x")
    write(f"{folder}/o/three/deep/adapter_config.json", '{"r": null}')
    seen = {r["adapter_path"].rsplit("/", 1)[1]: r["kept"] for r in readers.scan_adapters(spark, f"{folder}/o").collect()}
    assert seen == {"one": True, "two": False, "three": False}
    adapters = readers.read_adapters(spark, f"{folder}/o", "r int, base_model_name_or_path string")
    good = readers.adapter_rank(adapters.filter(F.endswith("adapter_path", F.lit("one"))))
    assert good.first()["rank"] == 8 and good.first()["adapter_path"] == f"{folder}/o/one"
    with pytest.raises(Exception, match="no rank"):
        readers.adapter_rank(adapters).collect()
    rows = spark.createDataFrame([(f"{folder}/o/one",), ("none",)], "adapter_path string")
    assert results.attach_adapter(rows, adapters).filter("adapter.r = 8").count() == 1


def test_datasets_and_instructions(spark, folder):
    spark.range(10).withColumnRenamed("id", "idx").write.parquet(f"{folder}/name/sub")
    df = readers.load_dataset(spark, "name", "sub", data_dir=folder, keep_in_memory=True, verification_mode=None)
    assert df.count() == 10
    df.unpersist()
    out = readers.load_splits(df, "train[:6]", "train[6:8]", "train[9]")
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 6, "validation": 2, "test": 1}
    both = readers.load_dataset(spark, "x", data_files={"train": f"{folder}/name/sub", "test": f"{folder}/name/sub"}, cache_dir=f"{folder}/cache")
    assert both.filter("split = 'test'").count() == 10 and os.path.isdir(f"{folder}/cache/x")
    with pytest.raises(ValueError):
        readers.load_dataset(spark, None)
    write(f"{folder}/i.txt", "  a \n\n \n b\n")
    assert [r[0] for r in readers.read_instructions(spark, f"{folder}/i.txt").collect()] == ["a", "b"]
    assert readers.read_instructions(spark, text=" x ").first()[0] == " x "
    with pytest.raises(ValueError):
        readers.read_instructions(spark)


def test_evaluation_job(spark, folder):
    write(f"{folder}/g.jsonl", "".join(json.dumps({"query": f"q{i}", "response": f"#### {i}"}) + ("\n\n  \n" if i % 7 == 0 else "\n") for i in range(300)))
    write(f"{folder}/m.jsonl", json.dumps({"output": "\\boxed{1}"}) + "\n" + json.dumps({"instruction": "b", "output": "\\boxed{2}"}) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        items = readers.read_eval_items(spark, "gsm8k", f"{folder}/g.jsonl")
        assert [(r["idx"], r["instruction"]) for r in items.orderBy("idx").collect()] == [(i, f"q{i}") for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    maths = readers.read_eval_items(spark, "math", f"{folder}/m.jsonl")
    assert [r["instruction"] for r in maths.orderBy("idx").collect()] == ["", "b"]

    def load():
        return lambda prompts: ["The answer is: 1. Question" for _ in prompts]

    done = jobs.predict_items(items, load, 128).unionByName(jobs.predict_items(maths, load))
    paths = {"gsm8k": f"{folder}/g.jsonl", "math": f"{folder}/m.jsonl"}
    graded = jobs.evaluate(spark, paths, done, f"{folder}/out", debug=True)
    assert {r["split"]: r["c"] for r in graded.groupBy("split").agg(F.sum(F.col("correct").cast("int")).alias("c")).collect()} == {"gsm8k": 1, "math": 1}
    back = spark.read.json(f"{folder}/out/math/predictions")
    assert {"idx", "split", "correct", "expected_answer", "prediction"} <= set(back.columns) and back.count() == 2
    assert spark.read.json(f"{folder}/out/math/metrics").first()["accuracy"] == 0.5
    assert spark.read.json(f"{folder}/out/math/debug").filter("judge.expected_boxed is not null").count() == 2
    with pytest.raises(ValueError):
        jobs.evaluate(spark, paths, done, folder, ["x"])
    write(f"{folder}/bad.jsonl", "{bad\n")
    with pytest.raises(Exception):
        readers.read_eval_items(spark, "math", f"{folder}/bad.jsonl").collect()
    said = jobs.infer(readers.read_instructions(spark, text="hi"), lambda c: c, load)
    sinks.write_inference(said, f"{folder}/inf")
    assert tuple(spark.read.json(f"{folder}/inf").first()) == ("hi", "The answer is: 1. ")


def test_predict_batches(spark):
    def load():
        return lambda prompts: [f"{p}:{len(prompts)}" for p in prompts]

    out = batch_predict(spark.range(10).coalesce(1).select(F.col("id").cast("string").alias("p")), "p", load, 4).collect()
    assert [r["prediction_raw"].split(":")[1] for r in out] == ["4"] * 8 + ["2"] * 2


def test_training_set_job(spark):
    df = spark.createDataFrame([(i, "GSM_SV", f"a b {i}", "x y") for i in range(20)], "idx long, type string, query string, response string")
    vocab = build_vocab(df.select(F.concat_ws(" ", "query", "response").alias("t")), "t", 2)
    tok = VocabTokenizer(vocab, unk_id=1, eos_id=0)
    out = jobs.prepare_dataset(df, "meta-math/MetaMathQA", tok, "train[:15]", "train[15:]", max_length=12)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 15, "validation": 5}
    from functools import partial

    from evalloom.operators.collate import collate

    done = jobs.calibration_batches(out.filter("split = 'train'"), 8, 85, 3, partial(collate, pad_id=0))
    assert done.groupBy("batch_id").count().count() == 1 or done.count() == 8


def test_streams(spark, folder):
    write(f"{folder}/in/a.json", "".join(json.dumps({"idx": i, "split": "gsm8k", "prediction_raw": f"The answer is: {i}"}) + "\n" for i in range(5)))
    items = spark.createDataFrame([(i, "gsm8k", "q", "#### 3") for i in range(5)], "idx long, split string, instruction string, reference string")
    sdf = streams.read_json_stream(spark, f"{folder}/in", "idx long, split string, prediction_raw string")
    streams.append_stream(streams.grade_stream(sdf, items, "numeric"), f"{folder}/graded", f"{folder}/ck1").awaitTermination()
    assert [r["idx"] for r in sinks.read_results(spark, f"{folder}/graded").filter("correct").collect()] == [3]
    write(f"{folder}/ex/a.json", "".join(json.dumps({"idx": i, "split": "train", "type": "GSM_SV", "query": "q", "response": "a b"}) + "\n" for i in range(4)))
    examples = streams.read_json_stream(spark, f"{folder}/ex", "idx long, split string, type string, query string, response string")
    tokenizer = ArrowTokenizer(lambda: lambda texts: [[len(w) for w in t.split()] for t in texts], eos_id=9)
    streams.append_stream(streams.encode_stream(examples, tokenizer, max_length=8), f"{folder}/enc", f"{folder}/ck2").awaitTermination()
    rows = spark.read.parquet(f"{folder}/enc").collect()
    assert len(rows) == 4 and rows[0]["labels"][-3:] == [1, 1, 9]
    vocab = build_vocab(spark.createDataFrame([("a b",)], "t string"), "t")
    table = VocabTokenizer(vocab, eos_id=9)
    with pytest.raises(TypeError):
        streams.encode_stream(examples, table)
    streams.write_batches(examples, lambda b: encode_sft(b, table), f"{folder}/enc2", f"{folder}/ck3").awaitTermination()
    assert spark.read.parquet(f"{folder}/enc2").count() == 4


def test_metric_cells_are_plain_numbers(spark):
    good = spark.createDataFrame([(" 1 ", 1.0), ("-2.5e1", -25.0), (".5", 0.5), ("3.", 3.0), ("inf", float("inf"))], "m string, want double")
    assert all(r["got"] == r["want"] for r in good.withColumn("got", lb.parsed_metric(good, "m")).collect())
    for text in ("1d", "2f", "", "0x1", None):
        df = spark.createDataFrame([(text,)], "m string")
        with pytest.raises(Exception, match="no number"):
            df.select(lb.parsed_metric(df, "m")).collect()
