from pyspark.sql import functions as F

from tonemark.operators.service import repeat_report, request_report


def test_requests_by_hand(spark):
    rows = [
        ("a", "má hai", "ma hai", 1.0, 2.0, 0.1),
        ("a", "ba", "ba", 3.0, None, 0.3),
        ("a", "bốn", "", 2.0, float("nan"), 0.2),
        (None, "x", "x", 5.0, 6.0, 0.5),
        ("b", "y", "z", None, None, None),
    ]
    df = spark.createDataFrame(rows, "g string, ref string, hyp string, infer double, server double, rtf double")
    times = {c: F.col(c) for c in ("infer", "server", "rtf")}
    got = {r.g: r for r in request_report(df, ["g"], F.col("ref"), F.col("hyp"), times, F.lit(2.0), F.col("infer")).collect()}
    a = got["a"]
    assert (a.n_clips, a.speech_s, a.infer_s) == (3, 6.0, 6.0)
    assert (a.wer, a.substitutions, a.deletions, a.insertions, a.hits, a.ref_words) == (0.5, 1, 1, 0, 2, 4)
    assert (a.no_tone_wer, a.no_tone_substitutions, a.no_tone_hits) == (0.25, 0, 3)
    assert tuple(a["infer"]) == (2.0, 3.0) and tuple(a["server"]) == (2.0, 2.0)
    assert got[None].wer == 0 and tuple(got[None]["infer"]) == (5.0, 5.0)
    assert got["b"].wer == 1 and got["b"]["infer"] is None


def test_median_and_rank_of_even_numbers(spark):
    df = spark.createDataFrame([("f", float(v), float(v)) for v in range(1, 7)], "f string, t double, u double")
    row = repeat_report(df, ["f"], {"t": F.col("t"), "u": F.col("u")}, "t").first()
    assert (row.n_runs, row.t, row.u, row.t_min, row.t_max) == (6, 3.5, 3.5, 1.0, 6.0)
    none = repeat_report(df.limit(0), ["f"], {"t": F.col("t")}, "t")
    assert none.count() == 0
