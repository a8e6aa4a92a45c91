import random

import pytest
from pyspark.sql import functions as F

from tonemark import schemas
from tonemark.operators import segments as sg


def seg(win, w0, w1, i, start, text, audio="x", ratio=1.2, logprob=-0.1, silent=0.0):
    return (audio, win, int(w0 * 16000), int(w1 * 16000), i, float(start), start + 0.02, text, logprob, silent, ratio)


@pytest.fixture
def absolute(spark):
    def run(rows):
        out = sg.absolute_segments(spark.createDataFrame(rows, schemas.SEGMENT))
        return out.orderBy("audio_id", "win_idx", "seg_idx").collect()

    return run


def test_offset_and_tiling(absolute):
    got = absolute([seg(0, 0, 5, 0, 0.5, "a"), seg(1, 10, 15, 0, 0.5, "b")])
    assert [(r.start, r.end, r.text) for r in got] == [(0.5, 5.0, "a"), (10.5, 15.0, "b")]
    got = absolute([seg(0, 0, 10, 0, 1, "a"), seg(0, 0, 10, 1, 4, "b")])
    assert [(r.start, r.end) for r in got] == [(1, 4), (4, 10)]


def test_overlap_clamp_blank_and_metrics(absolute):
    got = absolute([seg(0, 0, 5, 0, 0, "x"), seg(1, 1, 5, 0, 0, "y")])
    assert got[1].start >= got[0].end
    got = absolute([seg(0, 0, 3, 0, 5, "late")])
    assert (got[0].start, got[0].end) == (3, 3)
    got = absolute([seg(0, 0, 5, 0, 0, "  \t"), seg(0, 0, 5, 1, 1, " b ", ratio=2.1, logprob=-0.7, silent=0.3)])
    assert [r.text for r in got] == ["b"]
    assert (got[0].avg_logprob, got[0].no_speech_prob, got[0].compression_ratio) == (-0.7, 0.3, 2.1)


WORKED = [
    # a window that reaches back behind the one before starts where that one ended
    ([(0, 4, [(1.0, "a"), (2.5, "b")]), (3, 9, [(0.0, "c"), (4.0, "d")])],
     [(1, 2.5, "a"), (2.5, 4, "b"), (4, 7, "c"), (7, 9, "d")]),
    # starts that fall back are held, starts behind the window end at it
    ([(10, 14, [(3.0, "a"), (1.0, "b"), (9.0, "c")])], [(13, 13, "a"), (13, 14, "b"), (14, 14, "c")]),
    # a window of blank texts does not count as reached
    ([(0, 2, [(0.5, "a")]), (1, 6, [(0.0, "  ")]), (5, 8, [(0.5, " b ")])], [(0.5, 2, "a"), (5.5, 8, "b")]),
    # a window inside the one before has no room left
    ([(0, 10, [(0.0, "a")]), (2, 6, [(1.0, "b")])], [(0, 10, "a"), (6, 6, "b")]),
]


@pytest.mark.parametrize("block", [1, 4096])
@pytest.mark.parametrize("windows, want", WORKED)
def test_worked_timelines(absolute, monkeypatch, block, windows, want):
    monkeypatch.setattr(sg, "WINDOW_BLOCK", block)
    rows = [seg(n, w0, w1, i, s, t) for n, (w0, w1, parts) in enumerate(windows) for i, (s, t) in enumerate(parts)]
    assert [(r.start, r.end, r.text) for r in absolute(rows)] == want


def test_timelines_keep_their_order_in_blocks_of_any_size(absolute, monkeypatch):
    rng = random.Random(8)
    rows = []
    for n in range(25):
        at = 0
        for win in range(rng.randint(1, 8)):
            w0 = max(0, at - rng.choice([0, 0, 3]))
            at = w0 + rng.randint(1, 10)
            for i in range(rng.randint(0, 4)):
                rows.append(seg(win, w0, at, i, rng.randint(0, 12) / 2, rng.choice(["a", "b c", " "]), audio=f"r{n:02d}"))
    seen = []
    for block in (1, 3, 4096):
        monkeypatch.setattr(sg, "WINDOW_BLOCK", block)
        seen.append([(r.audio_id, r.win_idx, r.seg_idx, r.start, r.end, r.text) for r in absolute(rows)])
    assert seen[0] == seen[1] == seen[2]
    bounds = {(r[0], r[1]): (r[2] / 16000, r[3] / 16000) for r in rows}
    kept = {(r[0], r[1], r[4]) for r in rows if r[7].strip()}
    assert {s[:3] for s in seen[0]} == kept
    for s, after in zip(seen[0], [*seen[0][1:], None]):
        w0, w1 = bounds[s[:2]]
        assert w0 <= s[3] <= s[4] <= w1
        if after and after[:2] == s[:2]:
            assert s[3] <= after[3] and s[4] == max(after[3], s[3])
        else:
            assert s[4] == w1


def test_repeats_transcript_and_routing(spark):
    df = spark.createDataFrame(
        [seg(1, 5, 9, 0, 0, "c"), seg(0, 0, 5, 1, 1, "b"), seg(0, 0, 5, 0, 0, "a"), seg(0, 0, 5, 2, 2, "z z z", ratio=3.1)],
        schemas.SEGMENT,
    )
    kept = sg.without_repeats(df)
    assert sg.transcripts(kept).first().transcript == "a b c"
    row = spark.range(1).select(
        sg.route(F.lit(29.9)).alias("a"), sg.route(F.lit(30.0)).alias("b"), sg.route(F.lit(99.0), None).alias("c"),
        sg.route(F.lit(35.0), windowed=True).alias("d"), sg.route(F.lit(5.0), windowed=True).alias("e"),
        sg.profile_params(F.lit("long"), {"beam": "5", "vad": "true"}, {"beam": "1"}).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("short", "long", "short", "windowed", "short")
    assert row.f == {"beam": "1", "vad": "true"}


@pytest.mark.parametrize("block", [2.0, 3600.0])
def test_speech_windows(spark, monkeypatch, block):
    monkeypatch.setattr(sg, "TIME_BLOCK_S", block)
    rng = random.Random(2)
    speech = []
    for _ in range(120):
        s = rng.randint(0, 4000) / 10
        speech.append(("x", s, s + rng.randint(1, 40) / 10))
    speech.append(("y", 0.1, 65.0))
    got = sg.speech_windows(spark.createDataFrame(speech, "audio_id string, start double, end double"))
    wins = [(r.win_start_s, r.win_end_s) for r in got.where("audio_id = 'x'").orderBy("win_start_s").collect()]
    merged = []
    for _, s, e in sorted(t for t in speech if t[0] == "x"):
        if merged and s - merged[-1][1] < 0.5:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    want = []
    for i, (s, e) in enumerate(merged):
        left = min(0.2, (s - merged[i - 1][1]) / 2 if i else s)
        right = min(0.2, (merged[i + 1][0] - e) / 2 if i + 1 < len(merged) else 0.2)
        a, b = s - left, e + right
        while b - a > 28:
            want.append((a, a + 28))
            a += 28
        want.append((a, b))
    assert len(wins) == len(want)
    for g, w in zip(wins, want):
        assert g == pytest.approx(w)
    assert all(a[1] <= b[0] + 1e-9 for a, b in zip(wins, wins[1:]))
    long = [(r.win_start_s, r.win_end_s) for r in got.where("audio_id = 'y'").orderBy("win_start_s").collect()]
    assert long == [pytest.approx(p) for p in [(0.0, 28.0), (28.0, 56.0), (56.0, 65.2)]]
