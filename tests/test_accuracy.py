import random

import pytest
from pyspark.sql import functions as F

from tonemark.functions import edits as ed
from tonemark.operators.accuracy import (
    View,
    corpus_rate,
    folded_report,
    pair_up,
    row_rate,
    synthesis_delta,
    tone_report,
    with_edits,
)


def table_edits(a, b):
    """Full edit table with the documented choice among equal alignments."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    cost = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(
                cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (a[i - 1] != b[j - 1])
            )
    i, j, s, d, n, h = len(a), len(b), 0, 0, 0, 0
    while i and j:
        if cost[i][j] == cost[i - 1][j] + 1:
            d, i = d + 1, i - 1
        elif cost[i][j - 1] == cost[i - 1][j - 1] - 1:
            n, j = n + 1, j - 1
        else:
            s, h = s + (a[i - 1] != b[j - 1]), h + (a[i - 1] == b[j - 1])
            i, j = i - 1, j - 1
    return s, d + i, n + j, h + head + tail


@pytest.mark.parametrize("margin", [1, 64])
@pytest.mark.parametrize("kept", [1, 1 << 26])
def test_edit_counts_equal_full_table(monkeypatch, margin, kept):
    monkeypatch.setattr(ed, "_FIRST_MARGIN", margin)
    monkeypatch.setattr(ed, "_KEPT", kept)
    rng = random.Random(margin + kept)
    for _ in range(400):
        size = rng.choice([5, 15, 60, 150])
        a = [rng.choice("abc") for _ in range(rng.randint(0, size))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, size))]
        counts = ed.count_edits(a, b)
        assert counts == table_edits(a, b)
        s, d, i, h = counts
        assert ed.edit_cost(a, b) == s + d + i
        assert s + d + h == len(a) and s + i + h == len(b) and i - d == len(b) - len(a)


def test_edit_cost_of_unrelated_and_long_texts():
    rng = random.Random(3)
    a = "".join(rng.choice("abcd") for _ in range(900))
    b = "".join(rng.choice("wxyz") for _ in range(700))
    assert ed.edit_cost(a, b) == 900
    changed = list(a)
    for at in range(0, 900, 30):
        changed[at] = "z"
    assert ed.edit_cost(a, "".join(changed)) == 30


@pytest.mark.parametrize("kept, compared, lanes", [(1, 1, 3), (1 << 26, 1 << 22, 512)])
def test_many_pairs_side_by_side_equal_full_tables(monkeypatch, kept, compared, lanes):
    monkeypatch.setattr(ed, "_KEPT", kept)
    monkeypatch.setattr(ed, "_COMPARED", compared)
    monkeypatch.setattr(ed, "_MOST_LANES", lanes)
    rng = random.Random(8)
    refs, hyps = [], []
    for size in (0, 1, 5, 63, 64, 65, 128, 200, 256, 257, 400):
        for _ in range(12):
            refs.append("".join(rng.choice("abc đ") for _ in range(size)))
            hyps.append("".join(rng.choice("abcd ") for _ in range(rng.randint(0, 2 * size + 3))))
            refs.append([rng.choice(["x", "y", "zz"]) for _ in range(size)])
            hyps.append([c for c in refs[-1] if rng.random() > 0.1])
    want = [table_edits(r, h) for r, h in zip(refs, hyps)]
    assert ed.all_edits(refs, hyps) == want
    assert ed.edit_costs(refs, hyps) == [sum(w[:3]) for w in want]


def test_pairs_proved_without_a_band_equal_full_tables():
    rng = random.Random(21)
    proved = 0
    for chars in (True, False):
        for _ in range(300):
            words = [rng.choice(["an", "ban", "cuu", "d", "em", "gi"]) + rng.choice("xyz") for _ in range(rng.randint(0, 40))]
            other = [w for i, w in enumerate(words) if i % 11 != rng.choice([4, 5])]
            other = [rng.choice(["ж" + w[1:], w, w, w + " ё"]) if i % 5 == 2 else w for i, w in enumerate(other)]
            ref, hyp = (" ".join(words), " ".join(other)) if chars else (words, " ".join(other).split())
            want = table_edits(ref, hyp)
            cost, sure = ed._walked(ref, hyp)
            assert cost is None or cost >= sum(want[:3])
            if sure:
                proved += 1
                assert ed.count_edits(ref, hyp) == want and cost == sum(want[:3])
            assert ed.all_edits([ref], [hyp]) == [want]
    assert proved > 200


def test_long_pairs_with_words_lost_and_changed_need_no_band(monkeypatch):
    words = [f"w{i}x" for i in range(20_000)]
    other = ["ж" + w[1:] if i % 13 == 5 else w for i, w in enumerate(words) if i % 11 != 4]
    monkeypatch.setattr(ed, "_Bands", None)
    lost = [i for i in range(20_000) if i % 11 == 4]
    changed = sum(i % 13 == 5 and i % 11 != 4 for i in range(20_000))
    assert ed.count_edits(words, other) == (changed, len(lost), 0, 20_000 - len(lost) - changed)
    gone = sum(len(words[i]) + 1 for i in lost)
    s, d, n, _ = ed.count_edits(" ".join(words), " ".join(other))
    assert (s, d, n) == (changed, gone, 0)


def test_batch_is_scored_in_slices_of_bounded_text(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ed, "_SCORED", 100)
    refs = [None if i == 3 else "đa " * (i % 40) for i in range(200)]
    hyps = ["a" * (i % 7) for i in range(200)]
    parts = list(ed._slices(pa.array(refs), pa.array(hyps)))
    assert [r for part, _ in parts for r in part] == refs and [h for _, part in parts for h in part] == hyps
    assert all(len(r) == 1 or sum(len((t or "").encode()) for t in [*r[1:], *h[1:]]) <= 100 for r, h in parts)
    assert list(ed._slices(pa.array([], pa.string()), pa.array([], pa.string()))) in ([], [([], [])])


@pytest.fixture
def score(spark):
    def run(rows, view=View()):
        df = spark.createDataFrame(rows, "ref string, hyp string")
        return corpus_rate(df, [], F.col("ref"), F.col("hyp"), view).first()

    return run


@pytest.fixture
def rates(spark):
    def run(rows, view):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, ref string, hyp string")
        scored = with_edits(df, F.col("ref"), {"e": (F.col("hyp"), view)})
        return [r[0] for r in scored.orderBy("i").select(row_rate(F.col("e"))).collect()]

    return run


def test_row_rates(rates):
    word = [("xin chao ban", "xin chao ban nhe"), ("xin chào bạn", "Xin chào bạn!"), ("...", ""), ("!", "a")]
    assert rates(word, View()) == pytest.approx([1 / 3, 0, 0, 1])
    assert rates([("xin chào", "xin chao")], View("char")) == [0.125]
    assert rates([("xin chào", "xin chao")], View("char", keep_tone=False)) == [0]


def test_pooled_word_rate(score):
    got = score([("xin chao ban", "xin chao ban"), ("toi hoc bai", "toi hoc bai roi")])
    assert (got.ref_words, got.insertions, got.hits) == (6, 1, 6)
    assert got.wer == pytest.approx(1 / 6)


def test_pooled_char_rate_is_not_a_mean(score):
    got = score([("aaaa", "aaab"), ("a", "b")], View("char"))
    assert (got.cer, got.ref_chars) == (0.4, 5)


def test_empty_references(score):
    got = score([("...", ""), ("!!", "?")])
    assert (got.wer, got.ref_words) == (0, 0)
    with pytest.raises(Exception, match="no reference units"):
        score([("...", "xin chao"), ("!!", "um")])


def test_unpaired_ids_are_an_error(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b")], "id int, ref string")
    good = spark.createDataFrame([(1, "a"), (2, "c")], "id int, hyp string")
    assert pair_up(refs, good, "id", "ref", "hyp").count() == 2
    for hyps in ([(1, "a")], [(1, "a"), (2, "b"), (3, "c")]):
        lone = spark.createDataFrame(hyps, "id int, hyp string")
        with pytest.raises(Exception, match="pair up"):
            pair_up(refs, lone, "id", "ref", "hyp").collect()


def test_folded_rate_is_secondary(spark):
    df = spark.createDataFrame([("quy hoạch kỳ lạ", "quy hoạch kì lạ")], "ref string, hyp string")
    got = folded_report(df, [], F.col("ref"), F.col("hyp")).first()
    assert got.wer > 0 and got.wer_folded == 0


def test_tone_share_and_delta(spark):
    df = spark.createDataFrame([("cần", "cân", "cần")], "ref string, hyp string, rt string")
    tone = tone_report(df, [], F.col("ref"), F.col("hyp")).first()
    assert (tone.wer, tone.wer_no_tone, tone.tone_wer) == (1, 0, 1)
    delta = synthesis_delta(df, [], F.col("ref"), F.col("hyp"), F.col("rt")).first()
    assert (delta.asr_wer, delta.rt_wer, delta.delta_wer) == (1, 0, -1)


def test_pairs_in_batches_have_the_counts_of_pairs_alone():
    rng = random.Random(12)

    def changed(units, rate):
        out = []
        for u in units:
            at = rng.random()
            out += [] if at < rate else [rng.choice("abcdef ")] if at < 2 * rate else [u, "x"] if at < 3 * rate else [u]
        return "".join(out)

    refs = ["".join(rng.choice("abcdefghij éđ ") for _ in range(rng.choice([1, 30, 200, 700, 1500]))) for _ in range(120)]
    hyps = [changed(r, rng.choice([0, 0.01, 0.1, 0.3])) for r in refs]
    refs, hyps = refs + ["", "a", "", "same"], hyps + ["", "", "b", "same"]
    for split in (str, str.split):
        left, right = [split(r) for r in refs], [split(h) for h in hyps]
        assert ed.all_edits(left, right) == [ed.count_edits(r, h) for r, h in zip(left, right)]
        assert ed.edit_costs(left, right) == [ed.edit_cost(r, h) for r, h in zip(left, right)]


def test_folded_and_toneless_views_share_the_normal_form(spark):
    rows = spark.createDataFrame([("Hóa, mà", "hoá ma")], "ref string, hyp string")
    hyp = F.col("hyp")
    targets = {"_w": (hyp, View()), "_f": (hyp, View(fold=True)), "_n": (hyp, View(keep_tone=False))}
    scored = with_edits(rows, F.col("ref"), targets)
    got = scored.first()
    assert (got._w.errors, got._f.errors, got._n.errors) == (2, 1, 0)
    # one composition for each side, asked for by name in the node that runs it
    nodes = [x for x in scored._jdf.queryExecution().optimizedPlan().toString().splitlines() if "EvalPython [_compose" in x]
    assert sum(x.split("], [")[0].count("_compose(") for x in nodes) == 2
