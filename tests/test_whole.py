"""Queries over rows that DuckDB cannot say the same of, against brute force."""

import html
import json
import re
import unicodedata

import pytest

from pyspark.sql import functions as F

from voxloom.functions import rewards, text, tokens
from voxloom.functions.text import word_distance
from voxloom.plans import protocols, queries
from voxloom.sources import files


def said(t, characters=False):
    t = unicodedata.normalize("NFKC", t)
    t = html.unescape(" ".join(re.sub(r"(?i)<nar_(control|event)\b[^>]*>", " ", t).split())).casefold()
    words = "".join(" " if unicodedata.category(c)[0] in "PSZ" else c for c in t).split()
    return ("" if characters else " ").join(words)


def save(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


TEXTS = ["Hello, world!", "İSTANBUL'da ılık bir gün", "ΟΔΟΣ ς", "Große Straße", "Привет, мир!", "猫です。", "<nar_event type=sob> Ja &amp; nein", "", None]


def test_transcripts_of_every_row(spark, tmp_path):
    d = save(spark, tmp_path, "manifest", list(enumerate(TEXTS)), "row_no long, text string")
    got = {r.row_no: r.said for r in queries.queries()["h1_transcripts"](spark, d).collect()}
    assert got == {k: None if t is None else said(t) for k, t in enumerate(TEXTS)}


def test_errors_and_durations_of_every_example(spark, tmp_path):
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    times = [None, -1.0, 2.5, float("nan")]
    rows = [(k, a, b, times[k % 4], [7] * 800 if k % 3 else None) for k, (a, b) in enumerate(pairs * 4)]
    d = save(spark, tmp_path, "grpo_example", rows, "example_id long, target_text string, reference_text string, target_duration_seconds double, reference_audio_ids array<int>")

    def cer(a, b):
        if a is None or b is None:
            return None
        a, b = said(a, True), said(b, True)
        return word_distance(list(a), list(b)) / len(a) if a else float(bool(b))

    def seconds(a, b, t, ids):
        if t is not None and t > 0:
            return t
        a, b = said(a or "", True), said(b or "", True)
        return len(ids) / 32 / 12.5 * len(a) / len(b) if ids and a and b else -1.0

    errors = {r.example_id: r.rate for r in queries.queries()["h3_character_errors"](spark, d).collect()}
    spans = {r.example_id: r.seconds for r in queries.queries()["h16_reward_durations"](spark, d).collect()}
    assert len(errors) == len(spans) == len(rows)
    for k, a, b, t, ids in rows:
        assert errors[k] == (None if cer(a, b) is None else pytest.approx(cer(a, b), abs=1e-8)), (a, b)
        assert spans[k] == pytest.approx(seconds(a, b, t, ids), abs=1e-5), (a, b, t)


def test_plain_quotes_of_every_request(spark, tmp_path):
    rows = [(1, "“Dr. Smith” —\n Prof.  Lee…"), (2, "MR. and mrs. X"), (3, "the shmr. stays"), (4, None), (5, " a　b ")]
    d = save(spark, tmp_path, "synthesis_request", rows, "request_id long, text string")
    got = {r.request_id: r.plain for r in queries.queries()["h8_plain_quotes"](spark, d).collect()}
    assert got == {1: '"doctor Smith" - professor Lee...', 2: "mister and missus X", 3: "the shmr. stays", 4: None, 5: "a b"}


def test_detected_events(spark, tmp_path):
    rows = [(1, 2, 0.07, 0.09), (1, 1, 0.06, 0.01), (2, 1, 0.01, 0.02), (3, 1, 0.05, 0.05)]
    d = save(spark, tmp_path, "lineitem", rows, "l_orderkey long, l_linenumber int, l_discount double, l_tax double")
    got = sorted((r.l_orderkey, r.start, r.type) for r in queries.queries()["e12_detected_events"](spark, d).collect())
    assert got[:2] == [(1, 1.0, "Joy"), (1, 2.0, "anger")] and [r[:2] for r in got[2:]] == [(3, 1.0)]


def test_equal_prefix_is_never_broadcast(spark, tmp_path):
    ids = {1: [1, 2, 3], 2: [1, 2, 4, 5], 3: [1, 2], 4: [], 5: None, 6: [7], 8: [7], 9: [8, None], 10: [8, None, 9], 11: list(range(30_000)), 12: [*range(29_999), 0]}
    d = save(spark, tmp_path, "expressive", [*ids.items(), (12, [0])], "row_no long, input_ids array<int>")
    df = queries.queries()["e15_equal_prefix"](spark, d)
    assert sorted(map(tuple, df.collect())) == [(2, 2), (3, 2), (4, 0), (9, 0), (10, 2), (11, 0), (12, 1), (12, 29_999)]
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_labels_components_and_lexicon(spark, tmp_path):
    df = spark.createDataFrame([("en_GB", "JOY", 0.5, True), ("xx", "fear", None, True), (None, None, 0.5, False)], "l string, e string, v double, ok boolean")
    got = df.select(text.language_name(F.col("l")), text.mapped_label(F.col("e"), {"Joy": "glad"}), rewards.component_or_invalid(F.col("v"), F.col("ok"))).collect()
    assert [tuple(r) for r in got] == [("English", "glad", 0.5), (None, "fear", None), (None, None, -1.0)]
    path = tmp_path / "lexicon.json"
    path.write_text(json.dumps({"ab": "cd"}))
    assert files.read_lexicon(str(path)) == {"ab": "cd"}
    path.write_text("[1]")
    with pytest.raises(TypeError):
        files.read_lexicon(str(path))
    layout = tokens.TokenLayout(100, 2, 3, 8)
    assert layout.token_strings()[0] == "<custom_token_0>" and len(layout.token_strings()) == layout.added + 1
    hook = type("H", (), {"name": "a"})()
    with pytest.raises(ValueError):
        protocols.independent(hook, hook)
