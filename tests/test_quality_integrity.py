import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemark.functions import text as tx
from tonemark.operators import integrity as integ
from tonemark.operators import quality as ql
from tonemark.operators.gates import DATA_GATES, gate, measures, threshold_table, verdict
from tonemark.sources.audio import decode_wav, read_audio_features
from tonemark.sources.manifests import existing, read_manifest


def write_wav(path, seconds=2.0, rate=16000, amplitude=0.3, channels=1, width=2):
    t = np.arange(int(seconds * rate)) / rate
    x = amplitude * np.sin(2 * np.pi * 220 * t)
    x = np.repeat(x[:, None], channels, axis=1)
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(width)
        out.setframerate(rate)
        if width == 1:
            out.writeframes((x * 127 + 128).astype(np.uint8).tobytes())
        elif width == 3:
            ints = (x * (2**23 - 1)).astype("<i4").ravel()
            out.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in ints))
        else:
            peak = 2 ** (8 * width - 1) - 1
            out.writeframes((x * peak).astype(f"<i{width}").tobytes())
    return path


@pytest.fixture
def text_gates(spark):
    def run(texts):
        df = spark.createDataFrame([(t,) for t in texts], "text string")
        wide = ql.text_percentages(df, [], F.col("text"))
        gates = gate(measures(wide, [], "text", list(ql.TEXT_RULES)), threshold_table(spark, DATA_GATES))
        return gates

    return run


def test_each_text_rule_trips(text_gates):
    got = {r.name: r.passed for r in text_gates(["Xin Chào ANH", "có 5 quả cam", "câu sạch bình thường"]).collect()}
    assert not got["TXT-uppercase"] and not got["TXT-digit"] and got["TXT-nfc"] and got["TXT-empty"]
    bad = {
        "TXT-empty": "   ", "TXT-punct": "a, b", "TXT-nfc": "cà phê", "TXT-whitespace": "a\tb",
        "TXT-charset": "câu 中 văn", "TXT-minwords": "một",
    }
    for rule, text in bad.items():
        got = {r.name: r.passed for r in text_gates([text, "câu sạch bình thường"]).collect()}
        assert not got[rule], rule


def test_clean_set_passes(text_gates):
    gates = text_gates([f"câu tiếng việt sạch số {'x' * i}" for i in range(1, 11)])
    assert verdict(gates).first().verdict == "PASS"


def test_blank_rows_raise_one_flag_and_count_in_the_total(spark):
    df = spark.createDataFrame([("",), (None,), ("A",), ("b c",)], "text string")
    got = ql.text_percentages(df, [], F.col("text")).first()
    assert (got["TXT-empty"], got["TXT-uppercase"], got["TXT-minwords"]) == (50, 25, 25)


def test_no_rows_are_an_error(spark):
    with pytest.raises(Exception, match="at least one row"):
        ql.text_percentages(spark.createDataFrame([], "text string"), [], F.col("text")).collect()


def test_offending_characters(spark):
    df = spark.createDataFrame([("中中 ж",), ("中 a",), ("ok ²",), (None,)], "text string")
    assert [(r.char, r.n_rows) for r in ql.offending_characters(df, F.col("text")).collect()] == [("中", 2), ("ж", 1)]


def test_training_text_repairs_only_what_it_may(spark):
    df = spark.createDataFrame(
        [("Xin  CHÀO​bạn",), ("cà phê",), ("có 5 quả",), ("một",), ("a, b",)], "text string"
    )
    made = ql.training_text(df, "text")
    assert [(r.train_text, r.kept) for r in made.collect()] == [
        ("xin chào bạn", True), ("cà phê", True), ("có 5 quả", False), ("một", False), ("a, b", False)
    ]
    rate = ql.drop_rate(made).first()
    assert (rate.n_rows, rate.n_kept, rate.drop_pct, rate.must_stop) == (5, 2, 60, True)


def test_audio_rules(spark, tmp_path):
    write_wav(tmp_path / "ok.wav")
    write_wav(tmp_path / "quiet.wav", amplitude=0.001)
    write_wav(tmp_path / "slow.wav", rate=8000, seconds=0.5)
    write_wav(tmp_path / "loud.wav", amplitude=1.0)
    (tmp_path / "other.txt").write_text("no audio")
    features = read_audio_features(spark, str(tmp_path)).withColumn("text", F.lit("một câu vừa đủ dài ổn"))
    flags = ql.audio_flags(
        features, F.col("sample_rate"), F.col("duration_s"), F.col("rms"), F.col("clip_ratio"), F.col("text")
    )
    got = {r.path.rsplit("/", 1)[1]: r for r in flags.collect()}
    assert set(got) == {"ok.wav", "quiet.wav", "slow.wav", "loud.wav"}
    ok = got["ok.wav"]
    assert (ok.sample_rate, ok.n_samples, ok.duration_s) == (16000, 32000, 2.0)
    assert ok.rms == pytest.approx(0.3 / np.sqrt(2), rel=1e-3)
    assert not any([ok.wrong_rate, ok.odd_duration, ok.quiet, ok.clipped, ok.odd_speed])
    assert got["quiet.wav"].quiet and got["loud.wav"].clipped
    slow = got["slow.wav"]
    assert slow.wrong_rate and slow.odd_duration and slow.odd_speed
    pct = ql.audio_percentages(flags).first()
    assert (pct["AUD-samplerate"], pct["AUD-rms"], pct["AUD-durdist"]) == (25, 25, 0)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("channels", [1, 2])
def test_wav_widths_and_channels(tmp_path, width, channels):
    path = write_wav(tmp_path / "x.wav", seconds=0.1, width=width, channels=channels)
    samples, rate = decode_wav(path.read_bytes())
    want = 0.3 * np.sin(2 * np.pi * 220 * np.arange(1600) / 16000)
    assert rate == 16000 and samples == pytest.approx(want, abs=0.02)


def test_repeats_and_duplicate_audio(spark, tmp_path):
    for name in ("a", "b"):
        write_wav(tmp_path / f"{name}.wav")
    write_wav(tmp_path / "c.wav", seconds=1.5)
    texts = ["Đăng ký kênh nhé!"] * 6 + ["một câu khác"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    report = integ.copies_report(integ.copy_counts(df, [], integ.text_digest(F.col("text")))).first()
    assert (report.n_rows, report.extra_copies, report.max_repeat) == (7, 5, 6)
    top = integ.most_repeated(df, F.col("text")).first()
    assert (top.copies, top.match_text) == (6, "đăng ký kênh nhé")
    audio = integ.copy_counts(read_audio_features(spark, str(tmp_path)), [], F.col("sha1"))
    assert integ.copies_report(audio).first().extra_copies == 1


def test_contamination_skips_missing_manifests(spark, tmp_path):
    path = tmp_path / "eval.jsonl"
    path.write_text('{"id": "1", "audio": "x", "text": "Lần lữa mãi, mới gặp."}\n\n', encoding="utf-8")
    found = existing(spark, [str(path), str(tmp_path / "absent.jsonl")])
    assert found == [str(path)]
    keys = integ.evaluation_keys([read_manifest(spark, p) for p in found])
    train = spark.createDataFrame([("lần lữa mãi mới gặp",), ("lần lữa mãi mới gặp!",), ("khác",)], "text string")
    got = integ.contamination_count(train, [], keys, F.col("text")).first()
    assert (got.n_rows, got.n_contaminated) == (3, 2)
    assert integ.contaminated_rows(train, keys, F.col("text")).count() == 2


def test_set_operations(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    cache = spark.createDataFrame([(2, 9)], "id int, score int")
    fresh = integ.refresh_cache(rows, cache, "id", lambda d: d.select("id", F.lit(1).alias("score")))
    assert sorted((r.id, r.score) for r in fresh.collect()) == [(1, 1), (2, 9), (3, 1)]
    assert integ.only_chosen(rows, cache, "id").first().t == "b"
    assert integ.without(rows, cache, "id").count() == 2


def test_bloom_filter_lets_every_key_pass_and_few_others(spark):
    from tonemark.plans.bloom import bloom_filter, may_hold

    keys = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    keys = keys.unionByName(spark.createDataFrame([(None,)], "k string"))
    others = spark.range(5000, 25000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    bloom = bloom_filter(keys, "k")
    assert keys.where(~may_hold(bloom, F.col("k"))).count() == 0
    assert others.where(may_hold(bloom, F.col("k"))).count() < 20
    none = bloom_filter(keys.limit(0), "k")
    assert others.where(may_hold(none, F.col("k"))).count() == 0


def test_rows_of_one_repeated_evaluation_text_spread_over_tasks(spark):
    """All rows are one text that is in the evaluation set; no task may get them all."""
    from tonemark.operators.integrity import contaminated_rows, evaluation_keys

    train = spark.range(0, 4000, 1, 4).select("id", F.when(F.col("id") % 10 == 0, F.lit("other")).otherwise(F.lit("The Same!")).alias("text"))
    keys = evaluation_keys([spark.createDataFrame([("the same",), ("not here",), (None,)], "text string")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hit = contaminated_rows(train, keys, F.col("text"))
        rows = hit.withColumn("_task", F.spark_partition_id()).groupBy("_task").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in rows) == 3600 and hit.columns == ["id", "text"]
    assert len(rows) == 4 and max(r["count"] for r in rows) < 2000


def test_training_text_is_repaired_once_in_a_plan(spark):
    rows = spark.createDataFrame([("  Một  HAI ",), (None,), ("ba",)], "raw string").withColumn("text", tx.normalize(F.col("raw")))
    made = ql.training_text(rows, "text")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # the text's own normal form, its marks, and the repair; the optimizer made many copies of them before
    assert plan.count("regexp_replace") <= 6
    assert [(r["train_text"], r["kept"]) for r in made.collect()] == [("một hai", True), ("", False), ("ba", False)]
