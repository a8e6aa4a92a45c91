import hashlib
import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tonemark import schemas
from tonemark.operators import gates as gt
from tonemark.operators import records as rc
from tonemark.operators.accuracy import pair_up
from tonemark.operators.latency import latency_struct
from tonemark.queries import files
from tonemark.sources import manifests as mf
from tonemark.sources import sinks
from tonemark.streaming.records import follow_records


def record(i, ref, asr, rt, ttfa=None, sim=None, rtf=0.1):
    block = {"total_s": 0.1, "media_dur_s": 1.0, "model_load_s": 0.0, "ttfa_s": ttfa, "first_token_s": None, "rtf": rtf}
    return {"sample_id": str(i), "ref_text": ref, "asr_text": asr, "roundtrip_text": rt, "asr_latency": block,
            "tts_latency": dict(block), "speaker_sim": sim, "mos": None, "extra": {}}


@pytest.fixture
def records(spark, tmp_path):
    def run(*rows):
        path = tmp_path / "results.jsonl"
        path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
        return mf.read_sample_records(spark, str(path))

    return run


def test_report_depends_on_tones(records):
    rows = records(record(0, "cần", "cân", "cần"))
    for keep_tone, wer in ((True, 1.0), (False, 0.0)):
        keyed = rows.withColumn("run", F.lit("r"))
        got = rc.report(keyed, ["run"], keep_tone, n_resamples=50).first()
        assert (got.asr_wer, got.rt_wer, got.delta_wer, got.n) == (wer, 0, -wer, 1)
        assert got.tts_ttfa is None and got.speaker_sim is None and got.mos is None


def test_report_pools_characters(records):
    rows = records(record(0, "a", "b", "a", ttfa=0.5, sim=0.5), record(1, "xin chao b", "xin chao b", "xin chao b", sim=0.7))
    got = rc.report(rows.withColumn("run", F.lit("r")), ["run"], n_resamples=50).first()
    assert got.asr_cer == pytest.approx(1 / 11)
    assert got.tts_ttfa.n == 1 and got.asr_latency.median_s == 0.1
    assert got.speaker_sim.point == pytest.approx(0.6)
    again = rc.report(rows.withColumn("run", F.lit("r")), ["run"], n_resamples=50)
    cells = {(r.section, r.metric, r.stat): r.value for r in rc.report_rows(again, ["run"]).collect()}
    assert cells["accuracy", "asr", "substitutions"] == 1 and ("fidelity", "mos", "point") not in cells


def test_nan_tokens_are_read(records):
    got = records(record(0, "a", "a", "a", rtf=float("nan"))).first()
    assert math.isnan(got.asr_latency.rtf) and got.extra == {}


def test_assembly_and_failures(spark):
    lat = latency_struct(F.lit(1.0), F.lit(2.0))
    manifest = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, text string")
    first = manifest.select("id", F.col("text").alias("asr_text"), lat.alias("asr_latency"))
    synth = manifest.where("id = '1'").select("id", lat.alias("tts_latency"))
    second = manifest.select("id", F.col("text").alias("roundtrip_text"))
    made = rc.assemble(manifest, first, synth, second)
    assert made.count() == 1 and made.first().extra == {"tts_input_source": "ref_text"}
    want = spark.createDataFrame([], schemas.SAMPLE_RECORD).schema
    assert [f.name for f in made.schema] == [f.name for f in want]
    assert [r.id for r in rc.failures(manifest, made).collect()] == ["2"]
    counts = rc.run_counts(manifest, made).first()
    assert (counts.n_samples, counts.n_results, counts.n_failed) == (2, 1, 1)
    row = spark.range(1).select(
        rc.synthesis_input(F.lit("ref_text"), F.lit("a"), F.lit("b")).alias("a"),
        rc.synthesis_input(F.lit("asr_text"), F.lit("a"), F.lit("b")).alias("b"),
        rc.voice_similarity(F.lit(False), F.array(F.lit(1.0)), F.array(F.lit(1.0))).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == ("a", "b", None)


def test_gates_fail_on_nan_and_need_a_threshold(spark):
    rows = [("tts", "rtf_max", float("nan")), ("tts", "min_rms", 0.01), ("tts", "unknown", 1.0)]
    measured = spark.createDataFrame(rows, "grp string, name string, measured double")
    gates = gt.gate(measured, gt.threshold_table(spark, gt.TTS_GATES))
    # what was not measured fails like a bad value
    passed = {r.name for r in gates.collect() if r.passed}
    assert passed == {"min_rms"} and gates.count() == 4
    got = gt.verdict(gates).first()
    assert (got.n_pass, got.n_gates, got.verdict) == (1, 4, "FAIL (3 gate)")


def test_reruns_and_settings(spark):
    runs = spark.createDataFrame(
        [("x", 1, "Xin chào!"), ("x", 2, "xin chào"), ("y", 1, "a"), ("y", 2, "b")], "id string, run int, text string"
    )
    one, two = runs.where("run = 1"), runs.where("run = 2")
    assert [r.id for r in gt.rerun_mismatches(one, two, "id", "text").collect()] == ["y"]
    assert sorted((r.id, r.run) for r in gt.unstable_runs(runs, "id", "run", "text").collect()) == [("x", 2), ("y", 2)]
    table = spark.createDataFrame(
        [("A", 0.2, 9.0, 0), ("B", 0.1, 8.0, 1), ("C", 0.1, 7.0, 2)], "config string, wer double, infer_s double, ord int"
    )
    got = {r.config: r for r in gt.compare_settings(table, "config", "ord").collect()}
    assert [c for c, r in got.items() if r.is_best] == ["C"]
    assert got["B"].wer_vs_first == pytest.approx(-0.1) and got["A"].infer_s_vs_first == 0


def test_small_quality_sample_is_one_failing_gate(spark):
    df = spark.createDataFrame([("a b", "a b")] * 3, "ref string, hyp string").withColumn("k", F.lit(1))
    measured = gt.qc_measures(df, ["k"], F.col("ref"), F.col("hyp"))
    gates = gt.gate(measured, gt.threshold_table(spark, gt.DATA_GATES), absent_fails=False).collect()
    assert [(g.name, g.passed) for g in gates] == [("DST-qc-n", False)]
    many = spark.createDataFrame([("a b", "a b")] * 300, "ref string, hyp string").withColumn("k", F.lit(1))
    measured = gt.qc_measures(many, ["k"], F.col("ref"), F.col("hyp"))
    assert all(g.passed for g in gt.gate(measured, gt.threshold_table(spark, gt.DATA_GATES), absent_fails=False).collect())


def test_manifest_forms(spark, tmp_path):
    array, lines = tmp_path / "a.json", tmp_path / "b.jsonl"
    array.write_text(json.dumps([{"id": "a", "audio": "x", "text_raw": "abc"}, {"id": "b", "audio": "y", "text": "d"}]))
    lines.write_text('{"id": "a", "audio": "x", "text": "abc", "text_raw": "no"}\n\n{"id": "b", "audio": "y", "text_raw": "d"}\n')
    for path in (array, lines):
        assert [(r.id, r.text) for r in mf.read_any_manifest(spark, str(path)).collect()] == [("a", "abc"), ("b", "d")]
    bare = tmp_path / "c.jsonl"
    bare.write_text('{"audio": "data/clips/ood2_0001.wav", "text": "t"}\n')
    assert mf.read_unnamed_set(spark, str(bare)).first().id == "ood2_0001"
    gate_set = tmp_path / "d.jsonl"
    gate_set.write_text('{"id": "1", "audio": "x", "dur_s": 2.5, "text": "t"}\n')
    assert mf.read_gate_set(spark, str(gate_set)).first().duration_s == 2.5
    ood = tmp_path / "e.jsonl"
    ood.write_text('{"id": "1", "audio": "x", "text": "t", "duration": 6.0, "accent": "North", "role": "Host"}\n')
    assert mf.read_ood_set(spark, str(ood)).first().accent == "North"
    text = tmp_path / "ref.txt"
    text.write_text("  một hai\nba \n", encoding="utf-8")
    assert mf.read_transcripts(spark, str(text)).first().text == "một hai\nba"


def test_tone_setting(spark, tmp_path):
    def setting():
        return mf.read_keep_tone(spark, str(tmp_path)).first().keep_tone

    assert setting() is True
    for content, want in (('{"config": {"keep_tone": false}}', False), ('{"config": {}}', True), ("{broken", True)):
        (tmp_path / "run_meta.json").write_text(content)
        assert setting() is want


def test_checksums(spark, tmp_path):
    clips = tmp_path / "clips"
    clips.mkdir()
    for name in ("b.wav", "a.wav"):
        (clips / name).write_bytes(name.encode())
    names = ["v1.jsonl", "dev.jsonl"]
    for name in names:
        (tmp_path / name).write_text(name)
    got = sinks.checksums(spark, str(tmp_path), names, "clips").collect()
    assert [r.path for r in got] == ["v1.jsonl", "dev.jsonl", "clips/a.wav", "clips/b.wav"]
    assert got[2].line == f"{hashlib.sha256(b'a.wav').hexdigest()}  clips/a.wav"


def test_broken_lines_and_mixed_folders(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.json").write_text('\n[{"id": "1", "audio": "x", "text_raw": "một"},\n {"id": "2", "audio": "x", "text": "hai"}]\n')
    (folder / "b.jsonl").write_text('{"id": "3", "audio": "x", "text": "ba", "text_raw": "no"}\n\n{"id": "4", "audio": "x"}\n')
    got = {r.id: r.text for r in mf.read_any_manifest(spark, str(folder)).collect()}
    assert got == {"1": "một", "2": "hai", "3": "ba", "4": None}
    broken = tmp_path / "broken.jsonl"
    broken.write_text('{"id": "1", "audio": "x", "text": "t"}\n{"id": "2", "aud\n')
    for read in (mf.read_manifest, mf.read_any_manifest, mf.read_sample_records):
        with pytest.raises(Exception, match="MALFORMED|Malformed"):
            read(spark, str(broken)).collect()


def test_a_missing_rerun_and_an_unpaired_id_are_noticed(spark):
    one = spark.createDataFrame([("x", "a"), ("y", "b")], "id string, text string")
    assert [r.id for r in gt.rerun_mismatches(one, one.where("id = 'x'"), "id", "text").collect()] == ["y"]
    measured = gt.determinism_measure(one, one.where("id = 'x'"), "id", "text", 1)
    assert measured.first().measured == 0
    hyps = one.where("id = 'x'").withColumnRenamed("text", "hyp")
    with pytest.raises(Exception, match="do not pair up for id y"):
        pair_up(one, hyps, "id", "text", "hyp").count()


def test_followed_records_are_read_once(spark, tmp_path):
    landing, table, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i in range(2):
        one = spark.createDataFrame([json.dumps(record(i, "a", "a", "a"))], "string")
        one.write.mode("append").text(landing)
        follow_records(spark, landing, table, state).awaitTermination()
        assert spark.read.parquet(table).count() == i + 1


def test_aggregate_keeps_absent_blocks(spark, tmp_path):
    sinks.write_aggregate(spark.range(1).withColumn("mos", F.lit(None).cast("double")), str(tmp_path / "agg"))
    assert spark.read.text(str(tmp_path / "agg")).first()[0] == '{"id":0,"mos":null}'


def test_product_gates_score_the_pairs_once(spark):
    pairs = [("a", 10.0, "một hai", "một hai"), ("a", 50.0, "ba bốn", "ba"), (None, 10.0, "năm", "sáu")]
    rows = spark.createDataFrame(pairs, "model string, s double, ref string, hyp string")
    measured = gt.product_measures(
        rows, ["model"], F.col("ref"), F.col("hyp"), F.col("s") / 10, F.col("s") >= 30, F.lit(0.1)
    )
    gates = gt.gate(measured, gt.threshold_table(spark, gt.ASR_GATES))
    got = {(r.model, r.grp, r.name): r.measured for r in gates.collect()}
    assert len(got) == 14 and got["a", "longform", "wer_max"] == 0.5 and got[None, "per_utterance", "wer_max"] == 1.0
    assert got["a", "per_utterance", "infer_p50_max_s"] == 1.0 and got[None, "longform", "rtf_max"] is None
    nodes = gates._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("EvalPython [scored" in x for x in nodes) == 1


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    for i in range(5 * cores + 40):
        folder = tmp_path / "clips" / f"conv_id={i}"
        folder.mkdir(parents=True)
        (folder / "part.txt").write_text(f" text {i}\n")
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before, tracker = spark.conf.get(key), spark.sparkContext.statusTracker()
    for name, read in (
        ("texts", lambda: mf.read_transcripts(spark, str(tmp_path / "clips"))),
        ("sums", lambda: sinks.checksums(spark, str(tmp_path), [], "clips", glob="*.txt")),
    ):
        spark.sparkContext.setJobGroup(name, name)
        got = read()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(name)]
        spark.sparkContext.setJobGroup("", "")
        tasks = [tracker.getStageInfo(s).numTasks for job in jobs for s in job.stageIds]
        assert tasks and max(tasks) <= 4 * cores
        assert got.count() == 5 * cores + 40
        assert spark.conf.get(key) == before


def test_transcripts_are_written_one_file_each(spark, tmp_path):
    rows = [(i % 7 if i % 9 else None, 100 - i, f"turn {i}" if i % 5 else None, "user") for i in range(60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    folder = Path(files._write_transcripts(spark, str(tmp_path)).removeprefix("file://"))
    want = {}
    for conv, _, text, _ in sorted(rows, key=lambda r: r[1]):
        name = "__HIVE_DEFAULT_PARTITION__" if conv is None else conv
        want[f"conv_id={name}"] = want.get(f"conv_id={name}", "") + (text or "") + "\n"
    assert {f.parent.name: f.read_text() for f in folder.rglob("*.txt")} == want
