"""Core operators against the values of the specification and brute force."""

import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import frontend, rewards, signal, text, tokens, vectors
from voxloom.functions.forms import bare, label, language_code
from voxloom.operators import audit, batching, datasets, measures, ranking, speech
from voxloom.plans import protocols, scale, settings
from voxloom.sources import files
from voxloom.streaming import ingest


def one(spark, column, **values):
    """Value of an expression over literals, as a plain column of one row."""
    df = spark.range(1).select(*[v.alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def ints(*x):
    return F.array(*[F.lit(v) for v in x]).cast("array<int>")


def test_bare_folds_in_full(spark):
    rows = [("Straße GROSSE",), ("İSTANBUL ılık",), ("ΟΔΟΣ ς",), ("ﬁn – 12,5!",), (" \t",), (None,)]
    got = [r.b for r in spark.createDataFrame(rows, "t string").select(bare(F.col("t")).alias("b")).collect()]
    assert got == ["strassegrosse", "istanbulilik", "οδοσσ", "fin125", "", None]


def test_labels(spark):
    rows = [(" Joy ", "en_GB"), (None, "Dutch"), ("", " tr "), ("x", "und"), ("x", None)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "e string, l string").select(label(F.col("e")), language_code(F.col("l"))).collect()]
    assert got == [("joy", "en"), ("neutral", "nl"), ("neutral", "tr"), ("x", None), ("x", None)]


L = tokens.TokenLayout(100, 2, 3, 8)


def test_token_layout(spark):
    codes = F.array(ints(0, 1), ints(2, 3), ints(4, 5))
    ids = one(spark, L.from_codes(codes))
    assert ids == [110, 120, 130, 111, 121, 131]
    assert one(spark, L.from_codes(codes, F.lit(1))) == ids[:3] and one(spark, L.from_codes(codes, F.lit(9))) == ids and one(spark, L.from_codes(codes, F.lit(0))) == []
    assert one(spark, L.to_codes(ints(*ids, 110, 999))) == [[0, 1], [2, 3], [4, 5]]
    assert one(spark, L.to_codes(ints(110, 110))) is None
    row = one(spark, L.speech(ints(7, 8), ints(*ids)))
    assert row == [103, 7, 8, 2, 104, 105, 101, *ids, 102]
    assert one(spark, L.answer(ints(10, 11), ints(20))) == [103, 10, 11, 2, 104, 105, 20, 2]
    parts = one(spark, L.parts(ints(*row), 10.0))
    assert (parts.prompt, parts.text_ids, parts.audio_ids, parts.seconds, parts.error) == (row[:7], [7, 8], ids, 0.2, None)
    for bad, why in (([], "empty"), ([103, 7], "markers"), ([1, *row[1:]], "start"), ([*row[:4], 105, 104, *row[6:]], "order"), (row[:-1], "audio"), ([*row[:-2], 102], "audio")):
        assert one(spark, L.parts(ints(*bad)))["error"] == why
    done = one(spark, L.completion(ints(*ids, 102, 5)))
    assert (done.payload, done.terminated, done.valid, done.frames) == (ids, True, True, 2)
    assert not one(spark, L.completion(ints(*ids)))["valid"] and not one(spark, L.completion(ints(102)))["valid"]
    assert one(spark, L.reference_audio(ints(*ids, 102))) == ids and one(spark, L.reference_audio(ints(*ids[:2]))) is None
    assert one(spark, tokens.text_of_code_points(tokens.code_points(F.lit("aß猫😀")))) == "aß猫😀"
    assert one(spark, tokens.code_points(F.lit("ab"))) == [97, 98] and one(spark, tokens.code_points(F.lit(""))) == []
    legal = one(spark, L.legal(F.lit(6), F.lit(2), F.lit(2)))
    assert (legal.low, legal.high, legal.may_end, legal.must_end) == (110, 118, True, True)
    assert tokens.TokenLayout.from_vocabulary({"<custom_token_0>": 10}, 30, 12, 2, 2).base == 10
    assert tokens.TokenLayout.from_vocabulary({"<custom_token_0>": 10}, 30, 12, 2).eot == 2


def test_equal_prefix_and_padding(spark):
    assert one(spark, tokens.equal_prefix(ints(1, 2, 3), ints(1, 2, 4))) == 2
    assert one(spark, tokens.equal_prefix(ints(1, 2), ints(1, 2, 4))) == 2
    df = spark.createDataFrame([(1, [1, 2, 3]), (1, [4]), (2, [5])], "b int, ids array<int>")
    got = sorted(map(tuple, ((tuple(r.ids), tuple(r.attention_mask), tuple(r.labels)) for r in batching.collated(df, ["b"], "ids", 0).collect())))
    assert got == [((1, 2, 3), (1, 1, 1), (1, 2, 3)), ((4, 0, 0), (1, 0, 0), (4, -100, -100)), ((5,), (1,), (5,))]


@pytest.mark.parametrize(("a", "b", "wer", "cer"), [("Hello!", "hello", 0.0, 0.0), ("猫です。", "猫で", 1.0, 1 / 3), ("", "", 0.0, 0.0), ("", "a", 1.0, 1.0), ("a b", "a c d", 1.0, 1.0), ("<nar_event type=sob>Ja &amp; nein", "ja nein", 0.0, 0.0), ("Straße", "STRASSE", 0.0, 0.0)])
def test_error_rates(spark, a, b, wer, cer):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = df.select(text.word_error_rate(F.col("a"), F.col("b")).alias("w"), text.character_error_rate(F.col("a"), F.col("b")).alias("c")).first()
    assert (r.w, r.c) == pytest.approx((wer, cer))


def test_word_distance_is_symmetric():
    assert text.word_distance("a b c".split(), "a x c d".split()) == text.word_distance("a x c d".split(), "a b c".split()) == 2


@pytest.mark.parametrize(("n", "tr", "en"), [(0, "sıfır", "zero"), (1000, "bin", "one thousand"), (1100, "bin yüz", "one thousand one hundred"), (-21, "eksi yirmi bir", "minus twenty one"), (2_000_015, "iki milyon on beş", "two million fifteen"), (10**18, str(10**18), str(10**18)), (999, "dokuz yüz doksan dokuz", "nine hundred ninety nine")])
def test_number_words(n, tr, en):
    assert (frontend.number_words(n, "tr"), frontend.number_words(n, "en-GB")) == (tr, en)


def test_frontend():
    n = frontend.Frontend("tr", lexicon={"nar": "nâr"}).normalize
    assert n("Dr.  Ay 5.3.2024’te %25 ödedi: 3,5 ve 40 TL – Nar") == "doktor Ay beş mart iki bin yirmi dört'te yüzde yirmi beş ödedi: üç virgül beş ve kırk Türk lirası - nâr"
    assert n("1.1.2020 x 5.13.2020").startswith("bir ocak iki bin yirmi x")
    assert frontend.Frontend("en").normalize("Mr. X paid $2.50, %5 of -3") == "mister X paid two point five zero dollars, five percent of minus three"
    assert frontend.Frontend("de").normalize("25 Eier") == "25 Eier" and n(None) is None


def test_control_markup(spark):
    events = F.array(F.struct(F.lit("sob").alias("type"), F.lit(1).alias("after_word"), F.lit(None).cast("double").alias("at_seconds"), F.lit("short").alias("duration"), F.lit(None).cast("double").alias("duration_seconds"), F.lit(1).alias("count")))
    c = frontend.control(F.lit("sadness"), F.lit(0.9), F.lit("crying_speech"), F.lit(-0.8), F.lit(None), events)
    df = spark.createDataFrame([("Ben  iyiyim , dedi.",)], "t string")
    got = df.select(frontend.rendered(F.col("t"), c).alias("x")).first().x
    assert got == "<nar_control emotion=sadness intensity=0.900 delivery=crying_speech valence=-0.800> Ben <nar_event type=sob after_word=1 duration=short count=1> iyiyim, dedi."
    assert one(spark, text.strip_markup_exact(F.lit(got + " &lt;"))) == "Ben iyiyim, dedi. <"
    assert one(spark, frontend.control_errors(c)) == []
    bad = frontend.control(F.lit("bored"), F.lit(2.0), F.lit("x"), F.lit(None), F.lit(3.0), F.transform(events, lambda e: e.withField("count", F.lit(0))))
    assert one(spark, frontend.control_errors(bad)) == ["emotion", "intensity", "delivery", "arousal", "event_count"]
    assert frontend.placed("a b", ["E9", "E0", "EL"], [9, 0, None]) == "E0 a b E9 EL" and frontend.placed(" ", [], []) is None
    neutral = frontend.control(F.lit(None), F.lit(None), F.lit(""), F.lit(None), F.lit(None), F.lit(None))
    assert one(spark, frontend.is_neutral(neutral))
    assert one(spark, F.size(frontend.events_of_json(F.lit('[{"type":"sob"}]')))) == 1 and one(spark, frontend.events_of_json(F.lit("{}"))) is None and one(spark, frontend.events_of_json(F.lit(""))) == []


def test_chunks():
    t = "Eins zwei drei vier. Fünf sechs sieben! Acht neun."
    assert frontend.chunks(t, 25) == ["Eins zwei drei vier.", "Fünf sechs sieben!", "Acht neun."]
    long = "wort " * 30 + "x" * 50
    got = frontend.chunks(long, 30)
    assert max(map(len, got)) <= 30 and "".join(got).replace(" ", "") == long.replace(" ", "")
    assert frontend.chunks("", 30) == [] and frontend.chunks(None, 30) == []
    with pytest.raises(ValueError):
        frontend.chunks("x", 10)


def test_split_events(spark):
    ev = lambda n, at=None: F.struct(F.lit("sob").alias("type"), F.lit(n).cast("int").alias("after_word"), F.lit(at).cast("double").alias("at_seconds"), F.lit("short").alias("duration"), F.lit(1).alias("count"))
    got = one(spark, speech.split_events(F.array(F.lit("bir iki"), F.lit("üç dört beş")), F.array(ev(2), ev(3), ev(99), ev(None, 4.0))))
    assert [[(e.after_word, e.at_seconds) for e in chunk] for chunk in got] == [[(2, None), (None, 4.0)], [(1, None), (97, None)]]


def test_signal(spark):
    rate = 8000
    x = (0.1 * np.sin(2 * np.pi * 220 * np.arange(rate) / rate)).astype(np.float32)
    clean, clipped = signal.analyze(x, rate), signal.analyze(np.sign(x), rate)
    k = {m: i for i, m in enumerate(signal.METRICS)}
    assert clean[k["technical_quality"]] > clipped[k["technical_quality"]] and clean[k["pitch_median_hz"]] == pytest.approx(220, rel=0.03)
    df = spark.createDataFrame([(x.tolist(),)], "w array<float>")
    r = df.select(
        signal.peak(F.col("w")).alias("peak"), signal.decibels(signal.rms(F.col("w"))).alias("rms"), signal.silence_ratio(F.col("w"), rate).alias("silence"), signal.energy_deviation(F.col("w"), rate).alias("energy"),
        signal.si_sdr(F.col("w"), F.col("w")).alias("same"), signal.analyzed(F.col("w"), F.lit(rate)).alias("m"), signal.si_sdr(F.transform("w", lambda _: F.lit(0.0)), F.col("w")).alias("silent"),
    ).first()
    assert r.peak == pytest.approx(clean[k["peak"]]) and r.rms == pytest.approx(clean[k["rms_dbfs"]], abs=1e-4) and r.silence == clean[k["silence_ratio"]] and r.energy == pytest.approx(clean[k["energy_std_db"]], abs=1e-3)
    assert r.same > 100 and r.silent == float("-inf") and r.m.technical_quality == pytest.approx(clean[k["technical_quality"]])
    assert signal.analyze([], rate) is None and signal.analyze([float("nan")], rate) is None and signal.analyze(None, rate) is None
    assert signal.spectral_distance(x, x, rate) == 0
    joined = one(spark, signal.crossfaded(F.array(F.array_repeat(F.lit(1.0), 100), F.array_repeat(F.lit(0.0), 100)), 1000, 10))
    assert len(joined) == 190 and all(a >= b for a, b in zip(joined, joined[1:]))
    assert one(spark, signal.window_starts(F.lit(1000), 400, 250)) == [0, 250, 500, 600] and one(spark, signal.window_starts(F.lit(10), 400, 250)) == [0]


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    assert one(spark, vectors.cosine(v(1, 0), v(0.9, 0.1))) == pytest.approx(0.9 / math.hypot(0.9, 0.1))
    assert one(spark, vectors.cosine(v(0, 0), v(1, 0))) == 0 and one(spark, vectors.cosine(v(1), v(1, 0))) is None
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.9, 0.1]), (2, 1, [1.0, 0.0])], "i int, p int, e array<double>").withColumn("ref", v(1, 0))
    got = {r.i: r for r in vectors.drift(df, "i", "p", "e", "ref").collect()}
    assert got[1].score > 0.8 and got[2].adjacent_similarity == 1 and got[2].window_std == 0


def test_rewards(spark):
    f = F.lit
    assert one(spark, rewards.error_reward(f(0.0))) == 1 and one(spark, rewards.nll_reward(f(3.0))) == pytest.approx(math.exp(-1)) and one(spark, rewards.error_reward(f(None).cast("double"))) is None
    assert one(spark, rewards.weighted_harmonic_mean([f(0.5), f(1.0)], [1, 1])) == pytest.approx(2 / 3) and one(spark, rewards.weighted_harmonic_mean([f(None).cast("double")], [1])) == 0
    assert one(spark, rewards.duration_reward(f(1.0), f(1.1))) == 1 and one(spark, rewards.duration_reward(f(2.0), f(1.0))) == 0 and one(spark, rewards.duration_reward(f(0.0), f(1.0))) is None
    assert one(spark, rewards.duration_reward(f(2.0), f(1.0), "smooth_log", scale=1.0)) == pytest.approx(0.5)
    assert one(spark, rewards.fused_reward({"intelligibility": f(None).cast("double")}, f(True))) == -1 and one(spark, rewards.fused_reward({"intelligibility": f(0.5)}, f(False))) == -1
    scores = F.array(F.struct(f("a").alias("label"), f(0.5).alias("score")), F.struct(f("b").alias("label"), f(0.9).alias("score")))
    assert one(spark, rewards.top_label(scores)) == "b" and one(spark, rewards.first_over(scores, 0.4)) == "a"


def test_event_alignment(spark):
    def run(expected, detected):
        ev = "array<struct<type:string,start:double>>"
        return spark.createDataFrame([(expected, detected)], f"e {ev}, d {ev}").select(measures.aligned(F.col("e"), F.col("d")).alias("a")).first().a

    assert run([("laugh", 1.0)], [("laugh", 1.2)]).f1 == 1 and run([], []).f1 == 1
    assert run([("laugh", 1.0)], []).precision == 0 and run([], [("sob", 1.0)]).recall == 0
    rng = np.random.default_rng(1)
    for _ in range(10):
        e, d = ([(str(rng.choice(["a", "b"])), float(round(rng.uniform(0, 3), 2))) for _ in range(rng.integers(0, 6))] for _ in range(2))
        free, errors = set(range(len(d))), []
        for kind, at in e:
            near = min(((abs(at - d[i][1]), i) for i in free if d[i][0] == kind), default=None)
            if near and near[0] <= 0.75:
                free.discard(near[1])
                errors.append(near[0])
        got = run(e, d)
        assert got.recall == pytest.approx(len(errors) / len(e) if e else float(not d))
        assert got.mean_error == (pytest.approx(np.mean(errors)) if errors else None)


def test_aggregate_numeric(spark):
    df = spark.createDataFrame([(1, 1.0, None, True), (2, 3.0, float("nan"), True), (3, float("inf"), None, False)], "id int, a double, b double, c boolean")
    got = {r.metric: r for r in measures.aggregate_numeric(df).collect()}
    assert set(got) == {"a"} and (got["a"]["mean"], got["a"]["median"], got["a"]["n_values"]) == (2, 2, 2) and got["a"]["p95"] == pytest.approx(2.9)
    assert measures.aggregate_numeric(spark.createDataFrame([], "s string")).count() == 0


def test_percentiles_without_a_buffer(spark):
    r = np.random.default_rng(3)
    x = {"a": r.normal(size=3000), "b": np.round(r.exponential(size=3000), 1), "c": np.full(3000, 7.0), "d": r.normal(size=3000) * 1e300}
    df = spark.createDataFrame([tuple(map(float, v)) for v in zip(*x.values())], "a double, b double, c double, d double").repartition(5)
    df = df.unionByName(spark.createDataFrame([(None, None, None, None), (float("nan"), None, float("inf"), None)], df.schema))
    got = {m.metric: m for m in measures.aggregate_numeric(df, in_memory=10).collect()}
    for k, v in x.items():
        assert (got[k].n_values, got[k]["median"], got[k].p95) == (3000, pytest.approx(np.quantile(v, 0.5)), pytest.approx(np.quantile(v, 0.95)))


def test_audit(spark):
    rows = [(1, "a", "x.wav", "Hello  World", "s", "cc0"), (2, "b", "x.wav", "other text", "t", None), (3, "c", "y.wav", "hello world ", "s", "cc0"), (4, None, None, None, None, ""), (5, "e", "z.wav", "x", "s", "l"), (6, "f", "x.wav", "HELLO WORLD", "s", "l")]
    df = spark.createDataFrame(rows, "row_no long, id string, audio string, text string, speaker string, license string")
    out = audit.audit(df, digest=F.col("audio"), thresholds=audit.Thresholds(require_license=True))
    got = {r.row_no: (r.rejection_reasons, r.duplicate_of) for r in out.collect()}
    assert got == {1: ([], None), 2: (["duplicate_audio", "missing_license"], "a"), 3: (["duplicate_speaker_text"], "a"), 4: (["missing_license", "text_length"], None), 5: (["text_length"], None), 6: (["duplicate_audio", "duplicate_speaker_text"], "a")}
    assert audit.totals(out).first()["n_rejected"] == 5 and audit.accepted(out).columns == df.columns
    assert audit.audit(df.limit(0)).count() == 0
    m = F.struct(F.lit(0.1).alias("duration_seconds"), F.lit(0.5).alias("clipping_ratio"), F.lit(0.9).alias("silence_ratio"), F.lit(-0.2).alias("dc_offset"), F.lit(0.0).alias("rms_dbfs"))
    loud = audit.audit(df.filter("row_no = 1"), metrics=m).first()
    assert loud.rejection_reasons == ["clipping", "dc_offset", "duration", "level", "silence", "text_audio_ratio"]
    with pytest.raises(ValueError):
        audit.Thresholds(minimum_seconds=5, maximum_seconds=1)


def test_ranking(spark):
    ddl = "r int, c int, valid boolean, duration_seconds double, expected_seconds double, technical_quality double, repetition_similarity double, cer double, speaker_similarity double, emotion_confidence double, event_f1 double, emotion string, n_events int"
    rows = [(0, 0, True, 1.0, 1.0, 0.9, 0.5, 0.4, 0.9, None, None, "neutral", 0), (0, 1, True, 1.0, 1.0, 0.9, 0.5, 0.0, 0.9, None, None, "neutral", 0), (1, 0, True, 1.0, None, 0.9, 0.5, None, None, None, None, "joy", 1), (2, 0, False, None, None, None, None, None, None, None, None, None, None)]
    g = ranking.gated(spark.createDataFrame(rows, ddl), ranking.Gate(require_emotion=True, require_events=True))
    got = {(r.r, r.c): r for r in g.collect()}
    assert got[0, 0].rejection_reasons == ["cer"] and got[0, 1].accepted and got[1, 0].rejection_reasons == ["asr_missing", "emotion_missing", "event_missing"]
    assert got[2, 0].rejection_reasons == ["invalid_audio_tokens"] and got[2, 0].score == 0
    requests = spark.createDataFrame([(i,) for i in range(4)], "r int")
    best = ranking.winners(g.select("r", "c", "score", "accepted"), ["r"], "c", requests)
    assert {r.r: r.c for r in best.collect()} == {0: 1, 1: 0, 2: 0, 3: None}
    assert sorted((r.r, r.candidate) for r in ranking.retry_set(requests, best, ["r"], 2, 4).collect()) == [(i, c) for i in (1, 2, 3) for c in (2, 3)]
    tie = spark.createDataFrame([(1, 5, 0.5, True), (1, 3, 0.5, True), (1, 1, 0.9, False)], "r int, c int, score double, accepted boolean")
    assert ranking.winners(tie, ["r"], "c").first().c == 3
    w = "struct<audio_path:string,score:double,accepted:boolean,cer:double>"
    reports = spark.createDataFrame([("a", "t", ("p", 0.9, True, 0.0), None), ("b", "t", ("p", 0.9, False, 0.0), True), ("c", "t", ("p", 0.9, True, None), True), ("d", "t", None, True), ("e", "t", ("", 0.9, True, 0.0), True)], f"id string, text string, winner {w}, hard_case boolean")
    assert [(r.id, r.hard_case) for r in ranking.distilled(reports).collect()] == [("a", False)]
    with pytest.raises(ValueError):
        ranking.Gate(weights={"x": 1})


def test_length_batches(spark):
    lengths = [100, 10, 90, 20, 80, 30, 70, 40]
    df = spark.createDataFrame(list(enumerate(lengths)), "position long, n long")
    got = sorted(((r.n, r.batch_no) for r in batching.length_batches(df, "position", "n", 3, 8, 180).collect()))
    assert [b for _, b in got] == [0, 0, 0, 1, 1, 2, 2, 3]
    plain = sorted((r.n, r.batch_no) for r in batching.length_batches(df, "position", "n", 3, 8).collect())
    assert [b for _, b in plain] == [0, 0, 0, 1, 1, 1, 2, 2]
    assert batching.batch_stats(batching.length_batches(df.limit(0), "position", "n", 3), "n").first().efficiency == 1
    files_ = spark.createDataFrame([("a", 3), ("b", 4), ("c", 7)], "o string, s long")
    assert [r.batch_no for r in batching.upload_batches(files_.withColumn("g", F.lit(1)), "o", "s", 2, 100, "g").orderBy("o").collect()] == [0, 0, 1]
    assert [r.batch_no for r in batching.upload_batches(files_.withColumn("g", F.lit(1)), "o", "s", 9, 8, "g").orderBy("o").collect()] == [0, 0, 1]


def test_datasets(spark):
    df = spark.createDataFrame([(1, False), (2, True), (3, None)], "k int, hard_case boolean")
    assert sorted((r.k, r.copy_no) for r in datasets.oversampled(df).collect()) == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 1)]
    assert datasets.taken(df, "k", 2).count() == 2 and datasets.taken(df, "k", 2, 5).count() == 2
    assert {r.k for r in datasets.shuffled(df, "k", 3).collect()} == {1, 2, 3}
    n = datasets.numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")), "k")
    assert all(r.k == r.position for r in n.collect())
    ids = [103, 72, 105, 2, 104, 105, 101, 110, 120, 130, 102]
    rows = spark.createDataFrame([(ids,), ([1],), (None,)], "input_ids array<int>")
    made = datasets.examples(rows, "tts_tokens", L, frame_rate=10.0)
    good = datasets.kept(made).first()
    assert (good.target_text, good.reference_audio_ids, good.target_duration_seconds) == ("Hi", [110, 120, 130], 0.1) and made.filter("error is not null").count() == 2
    clone = datasets.examples(spark.createDataFrame([("hi", "ref", [110, 120, 130]), ("hi", "ref", [1]), (" ", "r", None)], "text string, ref_text string, ref_ids array<int>"), "voice_clone_tokens", L).collect()
    assert [r.error for r in clone] == [None, "reference_audio", "empty_text"] and clone[0].prompt[-3:] == [110, 120, 130]
    assert datasets.examples(spark.createDataFrame([("x",)], "text string"), "text", L, most_prompt=3).first().error == "long_prompt"
    with pytest.raises(ValueError):
        datasets.examples(df, "tts_tokens", L)
    with pytest.raises(ValueError):
        datasets.prune(df, {"a": "nope"}, ["a"])
    with pytest.raises(Exception, match="bad row"):
        datasets.kept(made, strict=True).collect()


def test_interleave_matches_a_loop(spark):
    plan, texts, speeches = datasets.Interleave(2, 3, 1, 10), 40, 13

    def slot(i, step):
        r = max(round(3 - 2 * min(step / 10, 1)), 1)
        c, p = divmod(i, (r + 1) * 2)
        return (True, (c * r * 2 + p) % texts) if p < r * 2 else (False, (c * 2 + p - r * 2) % speeches)

    df = spark.range(plan.length(texts, speeches)).withColumn("step", F.floor(F.col("id") / 3)).withColumn("s", plan.slots(F.col("id"), F.col("step"), texts, speeches))
    rows = df.collect()
    assert len(rows) == min(40 // 6, 13 // 2) * 8 and all((r.s.is_text, r.s["at"]) == slot(r.id, r.step) for r in rows)


def test_jsonl_round_trip(spark, tmp_path):
    src = tmp_path / "m.jsonl"
    src.write_text('{"id":"1","text":"a","extra":{"b":1}}\n\n  \n{"text":"猫","id":"2"}\n', encoding="utf-8")
    got = files.read_jsonl(spark, str(src), "id string, text string", rest="all").orderBy("_line").collect()
    assert [(r.id, r.text, r._line) for r in got] == [("1", "a", 1), ("2", "猫", 4)]
    src.write_text('{"id":"1"}\n[1]\n{oops\n')
    assert files.read_jsonl(spark, str(src), "id string", strict=False).count() == 1
    with pytest.raises(Exception, match="not a JSON object"):
        files.read_jsonl(spark, str(src), "id string").collect()
    out = str(tmp_path / "out")
    files.write_jsonl(spark.createDataFrame([("猫", 1)], "z string, a int"), out)
    assert spark.read.text(out).first().value == '{"a":1,"z":"猫"}'
    files.append_hard_cases(spark.createDataFrame([("x",)], "a string"), out)
    assert spark.read.text(out).count() == 2
    files.write_small_json({"b": 1, "a": "ü"}, str(tmp_path / "r.json"))
    assert files.read_config(str(tmp_path / "r.json")) == {"a": "ü", "b": 1} and files.merged({"a": {"x": 1, "y": 2}}, {"a": {"x": 3}}) == {"a": {"x": 3, "y": 2}}
    (tmp_path / "rep.json").write_text('{"text":"t","winner":{"audio_path":"p","score":0.9,"accepted":true,"verification":{"cer":0.0}},"hard_case":false}')
    assert [r.id for r in ranking.distilled(files.read_reports(spark, [str(tmp_path / "rep.json")])).collect()] == ["rep"]


def test_jsonl_lines_of_a_split_file(spark, tmp_path):
    src = tmp_path / "big.jsonl"
    src.write_text("".join(f'{{"id":"{i}"}}\n' for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = files.read_jsonl(spark, str(src), "id string")
        assert rows.filter("cast(id as long) <> _line").count() == 0 and rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def _wav(seconds, rate, channels=1):
    import io

    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(b"\0\0" * channels * int(seconds * rate))
    return b.getvalue()


def test_audio_shards(spark, tmp_path):
    rows = [((_wav(0.1, 16000), "a"), "x"), ((_wav(0.2, 24000), "b"), "x"), ((_wav(0.3, 22050, 2), "c"), "x"), (None, "x"), ((_wav(0.8, 24000), "d"), "x"), ((b"nope", "e"), "x"), ((_wav(0.2, 8000), "f"), " ")]
    df = spark.createDataFrame(rows, "audio struct<bytes:binary,path:string>, text string")
    got = files.decoded(df, least=0.15, most=0.5).collect()
    assert [r.dropped for r in got] == ["duration", None, None, "missing", "duration", "decode", "missing"] and len(got[1].samples) == 4800 and got[2].n_frames == 4
    files.write_tokens(spark.createDataFrame([], "input_ids array<int>"), str(tmp_path / "empty"))
    assert spark.read.schema("input_ids array<int>").parquet(str(tmp_path / "empty")).count() == 0
    files.write_tokens(spark.createDataFrame([([1, 2],), ([3],)], "input_ids array<int>"), str(tmp_path / "t"))
    assert sorted(r.input_ids for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [[1, 2], [3]]


def test_stable_paths(spark):
    df = spark.createDataFrame([("data/a/train.parquet",), ("data/b/train.parquet",)], "k string")
    a, b = (r.p for r in df.select(text.stable_path(F.col("k")).alias("p")).collect())
    assert a != b and a.endswith("-train.parquet") and a.split("/")[1] == a.split("/")[2][:2]
    for bad in ("../x", "/abs", "a/../b", ""):
        with pytest.raises(Exception, match="unsafe path"):
            spark.createDataFrame([(bad,)], "k string").select(text.stable_path(F.col("k"))).collect()


def test_ingest_resumes_and_guards(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    spark.range(10).repartition(3).write.parquet(src)
    run = lambda **k: ingest.ingest(spark, src, dst, "id long", lambda b: b.withColumn("x", F.col("id") * 2), k, 2)
    assert run(v=1) == {"shards": 3, "rows": 10} and run(v=1) == {"shards": 3, "rows": 10}
    spark.range(10, 15).repartition(1).write.mode("append").parquet(src)
    assert run(v=1)["rows"] == 15 and spark.read.parquet(f"{dst}/data").count() == 15
    assert all(r.ok for r in ingest.verified(spark, dst).collect())
    with pytest.raises(ingest.Drift, match="v"):
        run(v=2)
    with ingest.exclusive(spark, dst), pytest.raises(RuntimeError):
        run(v=1)
    calls = []
    assert ingest.retried(lambda: calls.append(1) or (1 if len(calls) > 2 else (_ for _ in ()).throw(OSError())), sleep=lambda _: None) == 1
    with pytest.raises(ValueError):
        ingest.inside(dst, "../other")


def test_ingest_leaves_out_bad_shards_and_retires_good_ones(spark, tmp_path):
    src, dst = f"file:{tmp_path}/src", f"file:{tmp_path}/dst"
    for i in range(4):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(src)
    bad = lambda b: b.withColumn("x", F.when(F.col("id") == 25, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(ingest.FailedShards, match="1 shards"):
        ingest.ingest(spark, src, dst, "id long", bad, {}, 3, isolate=True)
    assert {r.id for r in spark.read.parquet(f"{dst}/data").collect()} == {*range(20), *range(30, 40)}
    assert ingest.totals(spark, dst) == {"shards": 3, "rows": 30, "failed": 1}
    assert ingest.retire(spark, dst) == 3 and spark.read.schema("id long").parquet(src).count() == 10


def test_publish_moves_verified_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for name, n in (("x", 10), ("b/y", 20), ("b/z", 5), ("w", 0)):
        (tmp_path / "a" / name).write_bytes(b"1" * n)
    got = {r.path: (r.size, r.batch_no) for r in ingest.publish(spark, f"file:{tmp_path}/a", f"file:{tmp_path}/out", 2, 30).collect()}
    assert got == {"b/y": (20, 0), "b/z": (5, 0), "w": (0, 1), "x": (10, 1)}
    assert (tmp_path / "out/b/y").read_bytes() == b"1" * 20 and not (tmp_path / "a/x").exists()
    with pytest.raises(ValueError):
        ingest.inside("s3a://bucket/root", "../../other")
    assert ingest.inside("s3a://bucket/root", "a/../b") == "s3a://bucket/root/b"


def test_settings():
    assert settings.Scenario().frames == (7, 150) and settings.Scenario().completion_length == 4801
    for bad in ({"generations": 1}, {"streaming": True}, {"reward_asr": "b"}, {"most_seconds": 0.1}):
        with pytest.raises(settings.Invalid):
            settings.Scenario(**bad)
    with pytest.raises(settings.Invalid):
        settings.Encode.of({"nope": 1})
    with pytest.raises(settings.Invalid):
        settings.Encode(most_seconds=0.1)


def test_preferences():
    hooks = {"asr": "a", "speaker": "s", "emotion": "e", "event": "v"}
    good = settings.Preferences.of({"weights": {"intelligibility": 1, "emotion": 0.5}, "hooks": hooks, "columns": ("input_ids", "target_text", "emotion")})
    assert good.mode == "tts_tokens"
    for bad in (
        {}, {"hooks": hooks, "mode": "x"}, {"hooks": hooks, "columns": ()}, {"hooks": hooks, "weights": {"beauty": 1}}, {"hooks": hooks, "weights": {"format": -1}}, {"hooks": hooks, "weights": {"format": 0}},
        {"hooks": hooks, "weights": {"emotion": 1}}, {"hooks": {**hooks, "emotion": ""}, "weights": {"emotion": 1}, "columns": ("input_ids", "emotion")}, {"hooks": hooks, "weights": {"speaker_drift": 1}}, {"hooks": hooks, "metric": "ter"},
        {"hooks": hooks, "on_invalid": "skip"}, {"hooks": hooks, "nll_reduction": "max"}, {"hooks": hooks, "duration_mode": "x"}, {"hooks": hooks, "speed_direction": "up"}, {"hooks": hooks, "temperature": 0}, {"hooks": hooks, "loader_workers": -1},
        {"hooks": hooks, "most_prompt": 0}, {"hooks": hooks, "most_rows": 1.5}, {"hooks": hooks, "error_terms": ()}, {"hooks": hooks, "nothing": 1}, {"hooks": hooks, "weights": {"format": float("nan")}},
    ):
        with pytest.raises(settings.Invalid):
            settings.Preferences.of(bad)
    assert settings.accumulated(8, 4, 2, 4, 32) == 4
    for bad in ((3, 4, 2, 4, 32), (8, 4, 3, 4, 32), (0, 4, 2, 4, 32)):
        with pytest.raises(settings.Invalid):
            settings.accumulated(*bad)
    stack = {"a": {"extends": "b", "x": {"y": 1}}, "b": {"x": {"y": 0, "z": 2}, "w": 3}, "c": {"extends": "c"}}
    assert settings.extended("a", stack.get) == {"x": {"y": 1, "z": 2}, "w": 3}
    with pytest.raises(settings.Invalid):
        settings.extended("c", stack.get)


def test_hooks(spark):
    import pandas as pd

    seen = []
    h = protocols.Hook("len", ("t",), "n int", lambda x: pd.DataFrame({"n": x["t"].str.len().astype("int32")}))
    df = spark.createDataFrame([(1, "ab", True), (2, "abc", False), (3, "ab", True)], "k int, t string, valid boolean")
    assert {r.k: r.n for r in protocols.verified(df, [h], ["k"]).collect()} == {1: 2, 2: None, 3: 2}
    assert {r.k: r.n for r in protocols.once(df, h).collect()} == {1: 2, 2: 3, 3: 2}
    short = protocols.Hook("bad", ("t",), "n int", lambda x: pd.DataFrame({"n": []}))
    with pytest.raises(Exception, match="results for"):
        protocols.applied(df, short, ["k"]).collect()
    assert not seen


def test_skewed_join_and_running_keep_all_rows(spark, monkeypatch):
    n = 30_000  # one key holds two thirds
    big = spark.range(n).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id")).alias("k"), "id")
    small = big.select("k").distinct().withColumn("v", F.col("k") * 2)
    out = scale.skew_join(big, small, ["k"], "id", "left")
    assert out.count() == n and out.filter("v <> k * 2 or v is null").count() == 0
    placed = big.withColumn("place", scale.mixed(F.col("id")))
    ranks = scale.running(placed, ["k"], "place", ["id"], 6).filter("k = 0").agg(F.min("rank"), F.max("rank"), F.countDistinct("rank"), F.count("rank")).first()
    assert ranks[0] == 1 and ranks[1] == ranks[2] == ranks[3] == n * 2 // 3
    sums = scale.running(placed, ["k"], "place", ["id"], 6, "id", "s").filter("k = 0").agg(F.max("s")).first()[0]
    assert sums == sum(i for i in range(n) if i % 3 < 2)


def test_queries_run_on_the_smallest_tables(spark, sf):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and e.entry(spark).count() > 0
    for name in ("d1_aggregate_numeric", "g6_accepted", "i5_completions", "n1_stream_ingest"):
        assert q[name](spark, sf).count() > 0


# whole runs


def _clip(seconds, rate=2000, pitch=110.0, level=0.3):
    return (level * np.sin(2 * np.pi * pitch * np.arange(int(seconds * rate)) / rate)).astype(np.float32)


def test_resample_keeps_a_tone():
    for rate, to in ((44100, 24000), (8000, 24000), (24000, 16000)):
        x = np.sin(2 * np.pi * 440 * np.arange(rate // 2) / rate)
        y = signal.resample(x, rate, to)
        want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / to)
        assert len(y) == -(-len(x) * to // rate) and np.abs(y - want)[200:-200].max() < 0.02
    assert signal.resample([], 8000, 16000).size == 0


def test_preprocess(spark, tmp_path):
    import pandas as pd

    from voxloom.operators import verbs
    from voxloom.plans.protocols import Hook
    from voxloom.plans.settings import Encode

    seen = []
    rows = [(i, (bytearray(files.encode_wav(_clip(0.5 + i / 10), 2000)), "x"), f"text {i}") for i in range(9)]
    rows += [(9, (bytearray(b"no wav"), "x"), "t"), (10, None, "t"), (11, (bytearray(files.encode_wav(_clip(90), 2000)), "x"), "t"), (12, (bytearray(files.encode_wav(_clip(1), 2000)), "x"), " "), (13, (bytearray(files.encode_wav(_clip(1), 4000)), "x"), "other rate")]
    shards = spark.createDataFrame(rows, "position long, audio struct<bytes:binary,path:string>, text string")

    def encode(x):
        if len(x) > 3:
            raise MemoryError
        return pd.DataFrame({"codes": [[[len(s) // 160] * (len(s) // 160)] * 2 for s in x["samples"]]})

    made = verbs.preprocess(shards, tokens.TokenLayout(1000, 2, 2, 2048), Hook("codec", ("samples",), "codes array<array<int>>", encode), settings=Encode(batch_rows=4, bucket_rows=8), rate=2000, target=f"file:{tmp_path}/tokens")
    got = {r.position: r.input_ids for r in made.sequences.collect()}
    assert set(got) == {*range(9), 13} and got[0] == [1003, *map(ord, "text 0"), 2, 1004, 1005, 1001, *[1010 + 6, 1010 + 2048 + 6] * 6, 1002]
    assert got[13].count(1010 + 6) == 6  # half a second, whatever the rate it came with
    assert {r.dropped: r.n_rows for r in made.dropped.collect()} == {"decode": 1, "missing": 2, "duration": 1}
    stats = made.stats.first()
    assert (stats.n_input, stats.n_rows, stats.n_dropped) == (14, 10, 4) and 0 < stats.efficiency <= 1 and not seen
    assert spark.read.parquet(f"file:{tmp_path}/tokens").count() == 10


def _asked(spark, rows):
    from voxloom.operators import verbs

    asked = verbs.requests(spark.createDataFrame(rows, "request_id long, id string, text string, reference_audio string, reference_text string, emotion string, control string"))
    return asked.withColumns({"target_duration_seconds": F.lit(1.0), "reference_seconds": F.lit(None).cast("double")})


def test_requests_of_a_manifest(spark):
    got = {r.request_id: r for r in _asked(spark, [(1, "a", "x", "r.wav", "y", "Joy", None), (2, None, "x", "r.wav", "", None, '{"emotion":"anger","intensity":0.5}'), (3, None, None, None, None, None, None)]).collect()}
    assert [got[i].ok for i in (1, 2, 3)] == [True, False, False] and got[1].output_path == "out/a.wav" and got[2].output_path == "out/2.wav"
    assert (got[1].control.emotion, got[2].control.emotion, got[2].control.intensity, got[3].control.emotion) == ("joy", "anger", 0.5, "neutral")


def test_infer_takes_the_best_and_tries_again(spark):
    import pandas as pd

    from voxloom.operators import verbs
    from voxloom.plans.protocols import Hook

    asked = _asked(spark, [(1, "a", "eins", "r", "y", None, None), (2, "b", "zwei", "r", "y", None, None), (3, "c", "drei", "r", "y", None, None), (4, "d", "", "r", "y", None, None)])

    def generate(x):  # request "zwei" succeeds at its third candidate, "drei" never
        good = [("eins" in t) or ("zwei" in t and c >= 2) for t, c in zip(x["model_text"], x["candidate"])]
        return pd.DataFrame({"samples": [_clip(1.0 if g else 9.0) for g in good]})

    verify = Hook("asr", ("said", "samples"), "transcript string", lambda x: pd.DataFrame({"transcript": x["said"]}))
    made = verbs.infer(asked, Hook("model", ("model_text", "candidate"), "samples array<float>", generate), verify, ranking.Gate(minimum_technical_quality=0.0, maximum_repetition_similarity=1.0), 2, 4, 2000)
    won = {r.request_id: (r.candidate, r.accepted) for r in made.winners.collect()}
    assert won == {1: (0, True), 2: (2, True), 3: (0, False), 4: (None, None)} and not made.accepted()
    assert {(r.request_id, r["count"]) for r in made.candidates.groupBy("request_id").count().collect()} == {(1, 2), (2, 4), (3, 4)}


def test_long_texts_go_on_from_chunk_to_chunk(spark):
    import pandas as pd

    from voxloom.operators import verbs
    from voxloom.plans.protocols import Hook

    asked = _asked(spark, [(1, "a", "Erster Satz hier. Zweiter Satz dort. Dritter Satz da.", "r", "y", None, None), (2, "b", "Nur ein Satz.", "r", "y", None, None)])
    asked = asked.withColumn("reference_samples", F.array_repeat(F.lit(0.5).cast("float"), 1000))
    lengths = lambda x: pd.DataFrame({"samples": [np.full(2000, len(r) / 10_000, np.float32) for r in x["reference_samples"]]})
    gate = ranking.Gate(require_asr=False, minimum_technical_quality=0.0, maximum_repetition_similarity=1.0, minimum_duration_ratio=0.01, maximum_duration_ratio=99.0)
    results, chunks = verbs.infer_long(asked, Hook("model", ("model_text", "candidate", "reference_samples"), "samples array<float>", lengths), gate, 20, 2000, fade=0.0)
    got = {r.request_id: r for r in results.collect()}
    first, later = 1000, 1000 + int(0.08 * 2000) + 2000  # the original; with a pause and the chunk before
    assert got[1].n_chunks == 3 and got[2].n_chunks == 1 and len(got[1].samples) == 6000
    assert [round(got[1].samples[i] * 10_000) for i in (0, 2000, 4000)] == [first, later, later] and chunks.count() == 4


def test_command_verbs(spark, tmp_path, capsys):
    import json

    from voxloom.__main__ import main

    (tmp_path / "m.jsonl").write_text('{"id":"a","audio":"x","text":"hello there","speaker":"s"}\n{"id":"b","audio":"y","text":"h","speaker":"s"}\n')
    at = f"file:{tmp_path}"
    assert main(["audit", f"{at}/m.jsonl", f"{at}/good", f"{at}/bad"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"n_input": 2, "n_accepted": 1, "n_rejected": 1, "reasons": {"text_length": 1}}
    assert main(["audit", f"{at}/m.jsonl", f"{at}/good", f"{at}/bad", "--thresholds", '{"minimum_characters": 9, "maximum_characters": 1}'], spark) == 2
    (tmp_path / "r" / "deep").mkdir(parents=True)
    for name, score in (("r/a", 0.9), ("r/deep/b", 0.5)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"text": "t", "winner": {"audio_path": "w", "score": score, "accepted": True, "verification": {"cer": 0.0}}}))
    assert main(["distill", f"{at}/r/**/*.json", f"{at}/kept"], spark) == 2
    assert json.loads(capsys.readouterr().out) == {"n_reports": 2, "n_kept": 1}
    assert [r.id for r in spark.read.json(f"{at}/kept").collect()] == ["a"] and [p.rpartition("/")[2] for p in files.report_paths(spark, [f"{at}/r/*.json"])] == ["a.json"]
    with pytest.raises(FileNotFoundError):
        files.report_paths(spark, [f"{at}/none/*.json"])
    with pytest.raises(SystemExit):
        main(["nothing"], spark)


def test_restricted_log_probabilities(spark):
    scores = [0.5, 1.0, -1.0, 2.0, 0.0]
    got = spark.range(1).select(tokens.restricted_log_probabilities(F.array(*map(F.lit, scores)), F.lit(1), F.lit(3), F.lit(4)).alias("x")).select("x", tokens.entropy(F.col("x")).alias("e")).first()
    p = np.exp([1.0, -1.0, 0.0]) / np.exp([1.0, -1.0, 0.0]).sum()
    assert np.exp(got.x) == pytest.approx(p) and got.e == pytest.approx(-(p * np.log(p)).sum())


def test_wavs_are_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0.0, 0.5, -0.5], "a/1.wav"), (2, None, "a/2.wav")], "id long, samples array<float>, path string")
    got = {r.id: r.bytes_written for r in files.write_wavs(rows, "samples", "path", str(tmp_path), 8000).collect()}
    assert got == {1: 50, 2: None} and files.decode_wav((tmp_path / "a/1.wav").read_bytes())[1] == 8000


def test_content_digest(spark):
    import hashlib

    got = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "x binary").select(text.content_digest(F.col("x")).alias("d")).collect()
    assert [r.d for r in got] == [hashlib.blake2b(b"abc", digest_size=20).hexdigest(), None]
