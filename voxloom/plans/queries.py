"""Queries over whole tables, one or more for each operator, with the same in SQL.

``QUERIES`` maps a name to (function, SQL or None). Names begin with the section of the
operator that they show. Where SQL cannot say the same (random orders, folds, Fourier
transforms, streams) there is none, and tests hold the operator against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import frontend, rewards, signal, text, tokens, vectors
from voxloom.functions.forms import language_code
from voxloom.operators import audit, batching, datasets, measures, ranking, speech, verbs
from voxloom.plans import protocols
from voxloom.plans.scale import own_path, skew_join, written
from voxloom.plans.settings import Encode
from voxloom.sources import files
from voxloom.sources.tables import table
from voxloom.streaming import ingest

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
LAYOUT = tokens.TokenLayout(160000, 3)
#: Small layout for codes made of embeddings.
SMALL = tokens.TokenLayout(1000, 2, 4, 16)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return keep


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(8201) || chr(8239) || chr(12288)"
_SPACES = r"[\s\x0B\x{85}\p{Z}]+"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACES}|{_SPACES}$', '', 'g')"


def _squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{_SPACES}', ' ', 'g'))"


def _fold(x: str) -> str:
    return f"replace(replace(lower(translate({x}, 'İIı', 'iii')), 'ß', 'ss'), 'ς', 'σ')"


# A: scans, sources, sinks


@query("SELECT audio, text FROM manifest")
def a3_projection(s, d):
    return table(s, d, "manifest", "audio", "text")


@query("""SELECT request_id, coalesce(id, CAST(request_id AS VARCHAR)) AS id, text, reference_audio, coalesce(nullif(reference_text, ''), '') AS reference_text,
          'out/' || coalesce(nullif(output_path, ''), coalesce(id, CAST(request_id AS VARCHAR)) || '.wav') AS output_path,
          coalesce(json_extract_string(control::JSON, '$.emotion'), 'neutral') AS emotion, coalesce(CAST(json_extract_string(control::JSON, '$.intensity') AS DOUBLE), 0) AS intensity,
          text IS NOT NULL AND length(trim(text)) > 0 AND coalesce(reference_text, '') <> '' AND coalesce(reference_audio, '') <> '' AS ok FROM synthesis_request""")
def a17_requests(s, d):
    r = table(s, d, "synthesis_request")
    id_ = F.coalesce("id", F.col("request_id").cast("string"))
    c = F.from_json("control", frontend.CONTROL_TYPE)
    full = lambda k: F.coalesce(F.length(k), F.lit(0)) > 0
    return r.select(
        "request_id", id_.alias("id"), "text", "reference_audio", F.coalesce("reference_text", F.lit("")).alias("reference_text"),
        F.concat(F.lit("out/"), F.coalesce(F.when(full("output_path"), F.col("output_path")), F.concat(id_, F.lit(".wav")))).alias("output_path"),
        F.coalesce(c["emotion"], F.lit("neutral")).alias("emotion"), F.coalesce(c["intensity"], F.lit(0.0)).alias("intensity"),
        (F.col("text").isNotNull() & (F.length(F.trim("text")) > 0) & full("reference_text") & full("reference_audio")).alias("ok"),
    )


@query("""SELECT row_no, 'data/' || substring(sha256(audio), 1, 2) || '/' || sha256(audio) || '-' ||
          right(regexp_replace(regexp_replace(regexp_extract(audio, '[^/]*$'), '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), 120) AS path FROM manifest""")
def a18_stable_paths(s, d):
    return table(s, d, "manifest", "row_no", text.stable_path(F.col("audio")).alias("path"))


@query("SELECT id, audio, text, CAST(NULL AS DOUBLE) AS naturalness, CAST(NULL AS DOUBLE) AS similarity, CAST(NULL AS DOUBLE) AS emotion, CAST(NULL AS VARCHAR) AS comment FROM manifest")
def a19_listening_sheet(s, d):
    return speech.listening_sheet(table(s, d, "manifest", "id", "audio", "text"))


@query("SELECT row_no, CASE WHEN audio LIKE '/%' THEN audio WHEN audio <> '' THEN '/clips/' || audio END AS path FROM manifest")
def a20_audio_path(s, d):
    m = table(s, d, "manifest", "row_no", "audio")
    return m.select("row_no", files.audio_path(m, root="/clips").alias("path"))


# B: projections, filters, predicates

_AUDIT = f"""
    WITH m AS (SELECT row_no, id, audio, license, {_trim("coalesce(text, '')")} AS t, {_trim("coalesce(speaker, '')")} AS s FROM manifest),
    k AS (SELECT *, {_squeeze(_fold("t"))} AS f FROM m),
    w AS (SELECT *, first_value(row_no) OVER a AS heard, first_value(id) OVER a AS heard_id,
          CASE WHEN s <> '' AND t <> '' THEN first_value(row_no) OVER b END AS said, CASE WHEN s <> '' AND t <> '' THEN first_value(id) OVER b END AS said_id
          FROM k WINDOW a AS (PARTITION BY audio ORDER BY row_no), b AS (PARTITION BY s, f, s <> '' AND t <> '' ORDER BY row_no)),
    r AS (SELECT row_no, list_filter([CASE WHEN audio IS NOT NULL AND heard < row_no THEN 'duplicate_audio' END, CASE WHEN said < row_no THEN 'duplicate_speaker_text' END,
          CASE WHEN coalesce(license, '') = '' THEN 'missing_license' END, CASE WHEN length(t) NOT BETWEEN 2 AND 1000 THEN 'text_length' END], lambda x: x IS NOT NULL) AS reasons,
          CASE WHEN audio IS NOT NULL AND heard < row_no THEN heard_id WHEN said < row_no THEN said_id END AS duplicate_of FROM w)"""


def _audited(s, d):
    m = table(s, d, "manifest", "row_no", "id", "audio", "text", "speaker", "license")
    return audit.audit(m, digest=F.sha2("audio", 256), thresholds=audit.Thresholds(require_license=True))


@query(_AUDIT + " SELECT row_no, array_to_string(reasons, ',') AS reasons, duplicate_of FROM r")
def b1_audit(s, d):
    return _audited(s, d).select("row_no", F.concat_ws(",", "rejection_reasons").alias("reasons"), "duplicate_of")


@query(_AUDIT + " SELECT m.* FROM manifest m JOIN r USING (row_no) WHERE len(r.reasons) = 0")
def g6_accepted(s, d):
    keep = audit.accepted(_audited(s, d)).select("row_no")
    return table(s, d, "manifest").join(keep, "row_no", "left_semi")


@query(_AUDIT + " SELECT reason, count(*) AS n_rows FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason")
def d2_reason_counts(s, d):
    return audit.reason_counts(_audited(s, d))


#: Metrics of a clip, made of its number so that every rule is broken now and then.
_METRICS = {
    "duration_seconds": "CAST(row_no % 403 AS DOUBLE) / 13", "clipping_ratio": "CAST(row_no % 211 AS DOUBLE) / 200000", "silence_ratio": "CAST(row_no % 131 AS DOUBLE) / 160",
    "dc_offset": "CAST(row_no % 97 AS DOUBLE) / 1500 - 0.005e0", "rms_dbfs": "CAST(row_no % 89 AS DOUBLE) / 2 - 45.5e0",
}
_SIGNALS = _AUDIT + f""", heard AS (SELECT row_no, row_no % 53 = 0 AS broken, {", ".join(f"{v.replace('e0', '::DOUBLE')} AS {k}" for k, v in _METRICS.items())}, {_trim("coalesce(text, '')")} AS t FROM manifest),
    all_ AS (SELECT r.row_no, r.duplicate_of, list_sort(list_concat(r.reasons, CASE WHEN broken THEN ['audio_error'] ELSE list_filter([
        CASE WHEN duration_seconds NOT BETWEEN 0.4::DOUBLE AND 30 THEN 'duration' END, CASE WHEN clipping_ratio > 0.001::DOUBLE THEN 'clipping' END, CASE WHEN silence_ratio > 0.75 THEN 'silence' END, CASE WHEN abs(dc_offset) > 0.05::DOUBLE THEN 'dc_offset' END,
        CASE WHEN rms_dbfs NOT BETWEEN -45 AND -3 THEN 'level' END, CASE WHEN length(t) / greatest(duration_seconds, 1e-6) NOT BETWEEN 1 AND 35 THEN 'text_audio_ratio' END], lambda x: x IS NOT NULL) END)) AS reasons FROM r JOIN heard USING (row_no))"""


def _heard(s, d):
    m = table(s, d, "manifest", "row_no", "id", "audio", "text", "speaker", "license")
    metrics = F.when(F.col("row_no") % 53 != 0, F.struct(*[F.expr(v).alias(k) for k, v in _METRICS.items()]))
    return audit.audit(m, digest=F.sha2("audio", 256), metrics=metrics, thresholds=audit.Thresholds(require_license=True))


@query(_SIGNALS + " SELECT row_no, array_to_string(reasons, ',') AS reasons, duplicate_of FROM all_")
def b1_audit_with_signals(s, d):
    """All eleven reasons; metrics are made of the row's number, as the tables hold no audio."""
    return _heard(s, d).select("row_no", F.concat_ws(",", "rejection_reasons").alias("reasons"), "duplicate_of")


@query(_SIGNALS + " SELECT reason, count(*) AS n_rows FROM (SELECT unnest(reasons) AS reason FROM all_) GROUP BY reason")
def d2_all_reason_counts(s, d):
    return audit.reason_counts(_heard(s, d))


@query(_AUDIT + " SELECT count(*) AS n_input, count(*) FILTER (len(reasons) = 0) AS n_accepted, count(*) FILTER (len(reasons) > 0) AS n_rejected FROM r")
def d3_audit_totals(s, d):
    return audit.totals(_audited(s, d))


_PARTS = """
    WITH e AS (SELECT row_no, input_ids AS x, list_position(input_ids, 160001) AS sos, list_position(input_ids, 160002) AS eos FROM expressive),
    p AS (SELECT *, list_position(x[1:greatest(sos - 1, 0)], 3) AS eot, CASE WHEN eos > 0 AND sos > 0 AND list_position(x[sos + 1:], 160002) > 0 THEN x[sos + 1:sos + list_position(x[sos + 1:], 160002) - 1] END AS audio FROM e),
    v AS (SELECT *, len(audio) > 0 AND len(audio) % 32 = 0 AND list_bool_and(list_transform(audio, lambda a, i: a >= 160010 + ((i - 1) % 32) * 2048 AND a < 160010 + ((i - 1) % 32 + 1) * 2048)) AS good FROM p),
    q AS (SELECT *, CASE WHEN x IS NULL OR len(x) = 0 THEN 'empty' WHEN coalesce(sos, 0) < 1 OR coalesce(eot, 0) < 1 THEN 'markers' WHEN x[1] <> 160003 THEN 'start'
          WHEN sos <> eot + 3 OR x[eot + 1:eot + 3] <> [160004, 160005, 160001] THEN 'order' WHEN NOT coalesce(good, false) THEN 'audio' END AS error FROM v)"""


@query(_PARTS + """ SELECT row_no, CASE WHEN error IS NULL THEN sos END AS prompt_len, CASE WHEN error IS NULL THEN eot - 2 END AS text_len, CASE WHEN error IS NULL THEN len(audio) END AS audio_len,
       CASE WHEN error IS NULL THEN len(audio) / 32 / 12.5::DOUBLE END AS seconds, error FROM q""")
def i7_split_sequences(s, d):
    rows = table(s, d, "expressive", "row_no", "input_ids")
    return rows.select("row_no", LAYOUT.parts(F.col("input_ids"), places=True).alias("p")).select("row_no", "p.*")


@query(_PARTS + " SELECT row_no, len(audio) / 32 / 12.5::DOUBLE AS seconds FROM q WHERE error IS NULL AND sos <= 400 AND len(list_filter(x[2:eot - 1], lambda c: c NOT IN (9, 10, 11, 12, 13, 32, 133, 160, 12288))) > 0")
def b9_tts_examples(s, d):
    made = datasets.examples(table(s, d, "expressive", "row_no", "input_ids"), "tts_tokens", LAYOUT, most_prompt=400)
    return datasets.kept(made).select("row_no", F.col("target_duration_seconds").alias("seconds"))


@query(rf"SELECT example_id, len({_squeeze('target_text')}) + 5 AS prompt_len, len({_squeeze('target_text')}) AS text_len, len({_squeeze('target_text')}) + 5 <= 256 AS ok FROM grpo_example WHERE len({_squeeze('target_text')}) > 0")
def b10_prompts(s, d):
    g = table(s, d, "grpo_example", "example_id", F.col("target_text").alias("text"))
    made = datasets.examples(g, "text", LAYOUT, most_prompt=256).filter("error is null or error = 'long_prompt'")
    return made.select("example_id", F.size("prompt").alias("prompt_len"), F.length("target_text").alias("text_len"), F.col("error").isNull().alias("ok"))


def _candidates(s, d):
    lines, orders = table(s, d, "lineitem"), table(s, d, "orders", F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    c = lines.join(orders, "l_orderkey")
    null = F.lit(None).cast("double")
    return c.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") > 2).alias("valid"), (F.col("l_quantity") / 10).alias("duration_seconds"),
        (1 + F.col("o_totalprice") / 100000).alias("expected_seconds"), (0.5 + F.col("l_discount") * 4).alias("technical_quality"), (0.985 + F.col("l_tax") / 5).alias("repetition_similarity"),
        F.when(F.col("l_tax") < 0.02, null).otherwise(F.col("l_discount") * 1.5).alias("cer"), F.when(F.col("l_returnflag") == "N", null).otherwise(1 - F.col("l_quantity") / 50).alias("speaker_similarity"),
        F.when(F.col("l_linestatus") == "O", null).otherwise(F.col("l_tax") * 8).alias("emotion_confidence"), F.when(F.col("l_quantity") > 40, null).otherwise(F.col("l_discount") * 10).alias("event_f1"),
        F.when(F.col("l_linenumber") % 3 == 0, "joy").otherwise("neutral").alias("emotion"), (F.col("l_linenumber") % 2).alias("n_events"),
    )


_GATE = ranking.Gate(require_emotion=True, require_events=True)
_CAND = """
    WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity > 2 AS valid, (l_quantity / 10) / (1 + o_totalprice / 100000) AS ratio, 0.5::DOUBLE + l_discount * 4 AS tq, 0.985::DOUBLE + l_tax / 5 AS rep,
      CASE WHEN l_tax >= 0.02::DOUBLE THEN l_discount * 1.5::DOUBLE END AS cer, CASE WHEN l_returnflag <> 'N' THEN 1 - l_quantity / 50 END AS spk, CASE WHEN l_linestatus <> 'O' THEN l_tax * 8 END AS emo,
      CASE WHEN l_quantity <= 40 THEN l_discount * 10 END AS ev, l_linenumber % 3 = 0 AS wants, l_linenumber % 2 AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    g AS (SELECT *, CASE WHEN NOT valid THEN ['invalid_audio_tokens'] ELSE list_filter([CASE WHEN cer IS NULL THEN 'asr_missing' END, CASE WHEN wants AND emo IS NULL THEN 'emotion_missing' END,
      CASE WHEN n > 0 AND ev IS NULL THEN 'event_missing' END, CASE WHEN cer > 0.12::DOUBLE THEN 'cer' END, CASE WHEN tq < 0.55::DOUBLE THEN 'technical_quality' END, CASE WHEN rep > 0.995::DOUBLE THEN 'repetition' END,
      CASE WHEN ratio NOT BETWEEN 0.55::DOUBLE AND 1.8::DOUBLE THEN 'duration' END, CASE WHEN spk < 0.45::DOUBLE THEN 'speaker' END, CASE WHEN emo < 0.35::DOUBLE THEN 'emotion' END, CASE WHEN ev < 0.5::DOUBLE THEN 'event' END], lambda x: x IS NOT NULL) END AS reasons,
      CASE WHEN valid THEN (coalesce(greatest(0, 1 - cer) * 0.5, 0) + tq * 0.2 + exp(-abs(ln(ratio)) / 0.45) * 0.1 + coalesce(spk * 0.1, 0) + coalesce(emo * 0.05, 0) + coalesce(ev * 0.05, 0))
        / (CASE WHEN cer IS NULL THEN 0 ELSE 0.5 END + 0.2 + 0.1 + CASE WHEN spk IS NULL THEN 0 ELSE 0.1 END + CASE WHEN emo IS NULL THEN 0 ELSE 0.05 END + CASE WHEN ev IS NULL THEN 0 ELSE 0.05 END) ELSE 0 END AS score FROM c),
    a AS (SELECT *, valid AND len(reasons) = 0 AS accepted, row_number() OVER (PARTITION BY l_orderkey ORDER BY valid AND len(reasons) = 0 DESC, round(score, 9) DESC, l_linenumber) AS place FROM g)"""


def _gated(s, d):
    g = ranking.gated(_candidates(s, d), _GATE)
    return g.withColumn("score", F.round("score", 9))


@query(_CAND + " SELECT l_orderkey, l_linenumber, array_to_string(reasons, ',') AS reasons, round(round(score, 9), 6) AS score, accepted FROM a")
def b11_quality_gate(s, d):
    return _gated(s, d).select("l_orderkey", "l_linenumber", F.concat_ws(",", "rejection_reasons").alias("reasons"), F.round("score", 6).alias("score"), "accepted")


@query(_CAND + " SELECT o_orderkey AS l_orderkey, l_linenumber, round(round(score, 9), 6) AS score, accepted FROM orders LEFT JOIN a ON l_orderkey = o_orderkey AND place = 1")
def e3_winners(s, d):
    best = ranking.winners(_gated(s, d).select("l_orderkey", "l_linenumber", "score", "accepted"), ["l_orderkey"], "l_linenumber", table(s, d, "orders", F.col("o_orderkey").alias("l_orderkey")))
    return best.select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"), "accepted")


@query(_CAND + " SELECT o_orderkey AS l_orderkey, unnest([2, 3]) AS candidate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM a WHERE place = 1 AND accepted)")
def e4_second_round(s, d):
    requests = table(s, d, "orders", F.col("o_orderkey").alias("l_orderkey"))
    best = ranking.winners(_gated(s, d).select("l_orderkey", "l_linenumber", "score", "accepted"), ["l_orderkey"], "l_linenumber")
    return ranking.retry_set(requests, best, ["l_orderkey"], 2, 4)


@query("""SELECT id, text, audio_path AS audio, teacher_score AS score, teacher_cer AS cer, coalesce(hard_case, false) AS hard_case FROM expressive
          WHERE audio_path <> '' AND license IS NOT NULL AND teacher_score >= 0.75::DOUBLE AND teacher_cer <= 0.1::DOUBLE""")
def b13_distilled(s, d):
    e = table(s, d, "expressive", "id", "text", "audio_path", "license", "teacher_score", "teacher_cer", "hard_case")
    w = F.struct("audio_path", F.col("teacher_score").alias("score"), F.col("license").isNotNull().alias("accepted"), F.col("teacher_cer").alias("cer"))
    return ranking.distilled(e.withColumn("winner", w))


def _control(events: str = "json"):
    ev = frontend.events_of_json(F.col("events")) if events == "json" else frontend.widened_events(F.col("events"))
    return frontend.control(F.col("emotion"), F.col("intensity"), F.col("delivery"), F.col("valence"), F.col("arousal"), ev)


_LABEL = "coalesce(nullif(lower(trim({0})), ''), 'neutral')"
_HEAD = f"""
    WITH c AS (SELECT example_id, {_LABEL.format("emotion")} AS e, CASE WHEN isnan(intensity) THEN 0 ELSE coalesce(intensity, 0) END AS i, {_LABEL.format("delivery")} AS v, CASE WHEN NOT isnan(valence) THEN valence END AS va,
               CASE WHEN NOT isnan(arousal) THEN arousal END AS ar, coalesce(events, []) AS ev FROM grpo_example)"""


@query(_HEAD + """ SELECT example_id, '<nar_control emotion=' || e || ' intensity=' || format('{:.3f}', i) || ' delivery=' || v || CASE WHEN va IS NULL THEN '' ELSE ' valence=' || format('{:.3f}', va) END ||
       CASE WHEN ar IS NULL THEN '' ELSE ' arousal=' || format('{:.3f}', ar) END || '>' AS header, e = 'neutral' AND i = 0 AND v = 'neutral' AND va IS NULL AND ar IS NULL AND len(ev) = 0 AS neutral FROM c""")
def h6_control_headers(s, d):
    g = table(s, d, "grpo_example").select("example_id", _control("array").alias("c"))
    return g.select("example_id", frontend.control_header(F.col("c")).alias("header"), frontend.is_neutral(F.col("c")).alias("neutral"))


@query(_HEAD + """ SELECT example_id, array_to_string(list_filter([CASE WHEN e NOT IN ('neutral', 'joy', 'sadness', 'anger', 'fear', 'surprise') THEN 'emotion' END, CASE WHEN i NOT BETWEEN 0 AND 1 THEN 'intensity' END,
       CASE WHEN v NOT IN ('neutral', 'crying_speech', 'speech_laugh') THEN 'delivery' END, CASE WHEN va NOT BETWEEN -1 AND 1 THEN 'valence' END, CASE WHEN ar NOT BETWEEN -1 AND 1 THEN 'arousal' END,
       CASE WHEN len(list_filter(ev, lambda x: coalesce(lower(trim(x.type)) NOT IN ('laugh', 'chuckle', 'sob', 'cry', 'sniff', 'sigh', 'gasp', 'breath'), true))) > 0 THEN 'event_type' END,
       CASE WHEN len(list_filter(ev, lambda x: (x.after_word IS NOT NULL AND x.at_seconds IS NOT NULL) OR coalesce(x.after_word < 0, false) OR coalesce(x.at_seconds < 0, false))) > 0 THEN 'event_position' END,
       CASE WHEN len(list_filter(ev, lambda x: coalesce(lower(trim(x.duration)), 'medium') NOT IN ('short', 'medium', 'long'))) > 0 THEN 'event_duration' END,
       CASE WHEN len(list_filter(ev, lambda x: coalesce(x.count, 1) < 1)) > 0 THEN 'event_count' END], lambda x: x IS NOT NULL), ',') AS errors FROM c""")
def b16_control_errors(s, d):
    g = table(s, d, "grpo_example").select("example_id", _control("array").alias("c"))
    return g.select("example_id", F.concat_ws(",", frontend.control_errors(F.col("c"))).alias("errors"))


# C: joins and lookups


@query("""WITH f AS (SELECT DISTINCT audio, 'data/' || substring(sha256(audio), 1, 2) || '/' || sha256(audio) || '-' || regexp_extract(audio, '[^/]*$') AS p, 'data/' || regexp_extract(audio, '[^/]*$') AS q FROM manifest),
          e AS (SELECT DISTINCT 'data/' || regexp_extract(audio_path, '[^/]*$') AS path FROM expressive WHERE hard_case), l AS (SELECT DISTINCT 'data/' || regexp_extract(audio_path, '[^/]*$') AS path FROM expressive),
          o AS (SELECT * FROM f WHERE q NOT IN (SELECT path FROM e WHERE path IS NOT NULL))
          SELECT audio AS source, CASE WHEN q IN (SELECT path FROM l WHERE path IS NOT NULL) THEN 'upload' ELSE 'encode' END AS work FROM o WHERE audio IS NOT NULL""")
def c6_work_plan(s, d):
    f = ingest.shards(table(s, d, "manifest", F.col("audio").alias("source")).filter("source is not null").distinct())
    flat = lambda df: df.select(F.concat(F.lit("data/"), F.element_at(F.split("audio_path", "/"), -1)).alias("path")).filter("path is not null")
    e = table(s, d, "expressive", "audio_path", "hard_case")
    todo, backlog = ingest.work_plan(f, flat(e.filter("hard_case")), flat(e))
    return todo.select("source", F.lit("encode").alias("work")).unionByName(backlog.select("source", F.lit("upload").alias("work")))


_NAMES = "(VALUES ('en','en'),('tr','tr'),('de','de'),('nl','nl'),('fr','fr'),('es','es'),('pt','pt'),('ru','ru'),('ja','ja'),('english','en'),('turkish','tr'),('german','de'),('dutch','nl'),('french','fr'),('spanish','es'),('portuguese','pt'),('russian','ru'),('japanese','ja'),('eng','en'),('tur','tr'),('deu','de'),('ger','de'),('nld','nl'),('dut','nl'),('fra','fr'),('fre','fr'),('spa','es'),('por','pt'),('rus','ru'),('jpn','ja')) n(name, code)"


@query(f"SELECT row_no, code FROM manifest LEFT JOIN {_NAMES} ON name = regexp_extract({_squeeze('lower(language)')}, '^([a-z]+)([-_][a-z0-9]+)*$', 1)")
def c5_language_codes(s, d):
    return table(s, d, "manifest", "row_no", language_code(F.col("language")).alias("code"))


# D: aggregations

_NUM = " UNION ALL ".join(f"SELECT '{c}' AS metric, round(avg({c}), 6) AS mean, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({c}::DOUBLE, 0.95), 6) AS p95, count({c}) AS n_values FROM (SELECT CASE WHEN isfinite({c}::DOUBLE) THEN {c}::DOUBLE END AS {c} FROM {{t}}) HAVING count({c}) > 0" for c in ("audio_seconds", "intensity", "valence", "arousal", "teacher_score", "teacher_cer"))


@query(_NUM.format(t="expressive"))
def d1_aggregate_numeric(s, d):
    e = table(s, d, "expressive", "audio_seconds", "intensity", "valence", "arousal", "teacher_score", "teacher_cer")
    return measures.aggregate_numeric(e).select("metric", *[F.round(k, 6).alias(k) for k in ("mean", "median", "p95")], "n_values")


@query(f"SELECT {_LABEL.format('emotion')} || ':' || {_LABEL.format('delivery')} AS key, count(*) AS n_rows FROM expressive GROUP BY 1")
def d4_control_counts(s, d):
    from voxloom.functions.forms import label

    return speech.counts_by(table(s, d, "expressive", label(F.trim("emotion")).alias("emotion"), label(F.trim("delivery")).alias("delivery")), "emotion", "delivery")


@query("SELECT count(*) AS n_rows, count(DISTINCT id) AS n_clips, round(sum(audio_seconds), 3) AS audio_seconds FROM expressive")
def d10_run_totals(s, d):
    return table(s, d, "expressive", "id", "audio_seconds").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_clips"), F.round(F.sum("audio_seconds"), 3).alias("audio_seconds"))


@query("""WITH r AS (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY label),
          w AS (SELECT e.label, list_cosine_similarity(e.embedding::DOUBLE[], r.ref::DOUBLE[]) AS s, list_cosine_similarity(e.embedding::DOUBLE[], lag(e.embedding) OVER (PARTITION BY e.label ORDER BY vec_id)::DOUBLE[]) AS a FROM embeddings e JOIN r ON r.label = e.label)
          SELECT label, round(min(s), 6) AS minimum_similarity, round(avg(s), 6) AS mean_similarity, round(stddev_pop(s), 6) AS window_std, round(coalesce(avg(a), 1), 6) AS adjacent_similarity,
          round(least(1, greatest(0, 0.7 * greatest(0, min(s)) + 0.3 * greatest(0, coalesce(avg(a), 1)) - stddev_pop(s))), 6) AS score FROM w GROUP BY label""")
def d12_speaker_drift(s, d):
    e = table(s, d, "embeddings")
    ref = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    out = vectors.drift(skew_join(e, ref, ["label"], "vec_id", "inner"), "label", "vec_id", "embedding", "ref")
    return out.select("label", *[F.round(k, 6).alias(k) for k in out.columns if k != "label"])


@query("""WITH c AS (SELECT l_orderkey AS request, l_extendedprice / 100000 AS score, l_discount < 0.05::DOUBLE AS accepted, [CASE WHEN l_tax > 0.04::DOUBLE THEN 'cer' ELSE 'duration' END] AS r, l_quantity / 5 AS s, l_quantity / 10 AS t FROM lineitem)
          SELECT request, count(*) AS n_chunks, round(avg(score), 11) AS score, bool_and(accepted) AS accepted, array_to_string(list_sort(list_distinct(flatten(list(r)))), ',') AS reasons, round(sum(s), 6) AS audio_seconds, round(sum(t) / sum(s), 6) AS real_time_factor FROM c GROUP BY request""")
def d14_long_form(s, d):
    c = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("request"), (F.col("l_extendedprice") / 100000).alias("score"), (F.col("l_discount") < 0.05).alias("accepted"),
        F.array(F.when(F.col("l_tax") > 0.04, "cer").otherwise("duration")).alias("rejection_reasons"), (F.col("l_quantity") / 5).alias("audio_seconds"), (F.col("l_quantity") / 10).alias("total_seconds"),
    )
    out = measures.long_form(c, "request")
    return out.select("request", "n_chunks", F.round("score", 11).alias("score"), "accepted", F.concat_ws(",", "reasons").alias("reasons"), F.round("audio_seconds", 6).alias("audio_seconds"), F.round("real_time_factor", 6).alias("real_time_factor"))


@query("""SELECT l_orderkey, l_linenumber, round(coalesce((l_extendedprice - avg(l_extendedprice) OVER w) / (stddev_pop(l_extendedprice) OVER w + 0.0001), 0) + 0.5 * coalesce((l_discount - avg(l_discount) OVER w) / (stddev_pop(l_discount) OVER w + 0.0001), 0), 4) AS advantage
          FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def d15_group_advantages(s, d):
    out = ranking.group_advantages(table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), ["l_orderkey"], {"l_extendedprice": 1.0, "l_discount": 0.5})
    return out.select("l_orderkey", "l_linenumber", F.round("advantage", 4).alias("advantage"))


# E: order


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, n_chars FROM documents), b AS (SELECT *, position // 64 AS bucket_no FROM n),
          r AS (SELECT *, row_number() OVER (PARTITION BY bucket_no ORDER BY n_chars, position) - 1 AS r FROM b) SELECT position, n_chars, bucket_no, CAST(r // 8 AS INT) AS batch_no, CAST(r % 8 AS INT) AS place FROM r""")
def e8_length_batches(s, d):
    return batching.length_batches(datasets.numbered(table(s, d, "documents", "doc_id", "n_chars"), "doc_id"), "position", "n_chars", 8)


@query("""WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, n_chars FROM documents), b AS (SELECT *, position // 64 AS bucket_no FROM n),
          r AS (SELECT *, row_number() OVER (PARTITION BY bucket_no ORDER BY n_chars, position) AS r FROM b),
          f AS (SELECT position, n_chars, bucket_no, r, 0 AS batch_no, 0 AS place FROM r WHERE r = 1
                UNION ALL SELECT r.position, r.n_chars, r.bucket_no, r.r, CASE WHEN f.place + 1 >= 8 OR (f.place + 2) * r.n_chars > 12000 THEN f.batch_no + 1 ELSE f.batch_no END, CASE WHEN f.place + 1 >= 8 OR (f.place + 2) * r.n_chars > 12000 THEN 0 ELSE f.place + 1 END
                FROM f JOIN r ON r.bucket_no = f.bucket_no AND r.r = f.r + 1)
          SELECT position, n_chars, bucket_no, batch_no, place FROM f""")
def e8_budget_batches(s, d):
    return batching.length_batches(datasets.numbered(table(s, d, "documents", "doc_id", "n_chars"), "doc_id"), "position", "n_chars", 8, budget=12000)


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, n_chars FROM documents), r AS (SELECT n_chars, position // 64 AS b, (row_number() OVER (PARTITION BY position // 64 ORDER BY n_chars, position) - 1) // 8 AS k FROM n),
          g AS (SELECT count(*) AS n, sum(n_chars) AS s, max(n_chars) * count(*) AS p FROM r GROUP BY b, k) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_batches, CAST(sum(s) AS BIGINT) AS samples, CAST(sum(p) AS BIGINT) AS padded, round(sum(s) / sum(p), 9) AS efficiency FROM g""")
def d9_batch_stats(s, d):
    out = batching.batch_stats(e8_length_batches(s, d), "n_chars")
    return out.withColumn("efficiency", F.round("efficiency", 9))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) WHERE p % 4 = 1")
def e9_strided(s, d):
    return datasets.numbered(table(s, d, "documents", "doc_id"), "doc_id").filter(datasets.strided(F.col("position"), 4, 1)).select("doc_id")


@query("""WITH t AS (SELECT row_no AS k, row_number() OVER (ORDER BY row_no) - 1 AS p FROM expressive), g AS (SELECT example_id AS k, row_number() OVER (ORDER BY example_id) - 1 AS p FROM grpo_example),
          z AS (SELECT (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM g) AS ng), i AS (SELECT unnest(range(0, CAST(least(nt // 24, ng // 8) * 4 * 8 AS BIGINT))) AS i, nt, ng FROM z),
          r AS (SELECT i, nt, ng, CAST(greatest(round_even(3 - 2 * least((i // 8) / 100::DOUBLE, 1), 0), 1) AS BIGINT) AS r FROM i), c AS (SELECT *, i // ((r + 1) * 8) AS c, i % ((r + 1) * 8) AS q FROM r),
          x AS (SELECT i, q < r * 8 AS is_text, CASE WHEN q < r * 8 THEN (c * r * 8 + q) % nt ELSE (c * 8 + q - r * 8) % ng END AS place FROM c)
          SELECT i AS slot, is_text, CASE WHEN is_text THEN t.k ELSE g.k END AS row_key FROM x LEFT JOIN t ON is_text AND t.p = place LEFT JOIN g ON NOT is_text AND g.p = place""")
def e10_interleaved(s, d):
    """Text rows from expressive, speech rows from grpo_example, eight a batch."""
    t = written(datasets.numbered(table(s, d, "expressive", F.col("row_no").alias("k")), "k", "at").withColumn("is_text", F.lit(True)), "texts")
    g = written(datasets.numbered(table(s, d, "grpo_example", F.col("example_id").alias("k")), "k", "at").withColumn("is_text", F.lit(False)), "speeches")
    plan, nt, ng = datasets.Interleave(8, 3, 1, 100), t.count(), g.count()
    slots = s.range(plan.length(nt, ng)).withColumn("s", plan.slots(F.col("id"), F.floor(F.col("id") / 8), nt, ng))
    return slots.select(F.col("id").alias("slot"), "s.is_text", "s.at").join(t.unionByName(g), ["is_text", "at"], "left").select("slot", "is_text", F.col("k").alias("row_key"))


@query("""WITH w AS (SELECT doc_id, n_chars AS n, CAST(greatest(n_chars - 500, 0) // 250 AS BIGINT) + 1 AS k FROM documents)
          SELECT doc_id, k + CASE WHEN (k - 1) * 250 + 500 < n THEN 1 ELSE 0 END AS n_windows, CASE WHEN (k - 1) * 250 + 500 < n THEN n - 500 ELSE (k - 1) * 250 END AS last_start FROM w""")
def e13_windows(s, d):
    starts = signal.window_starts(F.col("n_chars"), 500, 250)
    return table(s, d, "documents", "doc_id", "n_chars").select("doc_id", F.size(starts).alias("n_windows"), F.element_at(starts, -1).alias("last_start"))


@query("""WITH g AS (SELECT example_id, CASE WHEN target_duration_seconds > 0 AND NOT isnan(target_duration_seconds) THEN target_duration_seconds END AS t, array_length(regexp_extract_all(coalesce(target_text, ''), '[^\\s\\p{Z}\\x{85}\\x0B]+')) AS n, unnest(events) AS e FROM grpo_example)
          SELECT example_id, e.type AS type, round(coalesce(e.at_seconds, t * e.after_word / greatest(n, 1), t / 2), 6) AS expected FROM g""")
def e14_expected_times(s, d):
    g = table(s, d, "grpo_example", "example_id", "target_text", "target_duration_seconds", F.explode("events").alias("e"))
    known = F.when((F.col("target_duration_seconds") > 0) & ~F.isnan("target_duration_seconds"), F.col("target_duration_seconds"))
    at = measures.expected_time(F.col("e"), known, F.coalesce(text.split_words(F.col("target_text")), F.lit(0)))
    return g.select("example_id", F.col("e.type").alias("type"), F.round(at, 6).alias("expected"))


@query("""WITH p AS (SELECT row_no, input_ids AS a, lag(input_ids) OVER (ORDER BY row_no) AS b FROM expressive)
          SELECT row_no, CAST(coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i]), true) - 1, least(len(a), len(b))) AS INT) AS shared FROM p WHERE a IS NOT NULL AND b IS NOT NULL""".replace("SELECT row_no, input_ids AS a, lag(input_ids) OVER (ORDER BY row_no) AS b FROM expressive", "SELECT x.row_no, x.input_ids AS a, y.input_ids AS b FROM expressive x JOIN expressive y ON y.row_no = x.row_no - 1"))
def e15_equal_prefix(s, d):
    e = table(s, d, "expressive", "row_no", F.col("input_ids").alias("a"))
    prev = table(s, d, "expressive", (F.col("row_no") + 1).alias("row_no"), F.col("input_ids").alias("b"))
    # Spark takes an array for 4 bytes in its estimates, and would broadcast some hundred MB of ids as a few MB
    return e.join(prev.hint("merge"), "row_no").filter("a is not null and b is not null").select("row_no", tokens.equal_prefix(F.col("a"), F.col("b")).alias("shared"))


# F, G: order, limits, sets


@query("SELECT example_id, n_copies FROM (SELECT example_id, unnest(range(1, CASE WHEN hard_case THEN 3 ELSE 1 END + 1)) AS n_copies FROM (SELECT * FROM grpo_example ORDER BY example_id LIMIT 500))".replace("n_copies", "copy_no"))
def g1_oversampled(s, d):
    return datasets.oversampled(datasets.taken(table(s, d, "grpo_example", "example_id", "hard_case"), "example_id", 500)).select("example_id", "copy_no")


@query("SELECT example_id, clip_id FROM grpo_example")
def f2_shuffled(s, d):
    return datasets.shuffled(table(s, d, "grpo_example", "example_id", "clip_id"), "example_id", 7)


# H: text


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<nar_(control|event)\b[^>]*>', ' ', 'gi'), '[\s\x0B\x{85}\p{Z}]+', ' ', 'g')) AS plain FROM documents""")
def h4_plain_documents(s, d):
    return table(s, d, "documents", "doc_id", text.strip_markup_exact(F.col("text")).alias("plain"))


_TAGS = r"<nar_(control|event)\b[^>]*>"


def _transcript(x: str, blank: str = " ") -> str:
    """SQL of the transcript form: composed, without tags, case folded in full, marks as blanks."""
    folded = f"replace(replace(lower(replace(replace(regexp_replace(nfc_normalize({x}), '{_TAGS}', ' ', 'gi'), 'İ', 'i' || chr(775)), 'ẞ', 'ss')), 'ß', 'ss'), 'ς', 'σ')"
    return rf"trim(regexp_replace({folded}, '[\s\x0B\x1C-\x1F\x{{85}}\p{{P}}\p{{S}}\p{{Z}}]+', '{blank}', 'g'))"


def _distance(t: str) -> str:
    """SQL of the edit distance of two lists of at most 127 different values (all in d): each
    value becomes a character of one byte, as DuckDB compares bytes."""
    spelled = lambda x: f"array_to_string(list_transform({x}, lambda v: chr(list_position({t}.d, v))), '')"
    return f"levenshtein({spelled(f'{t}.a')}, {spelled(f'{t}.b')})"


def _error_rate(t: str) -> str:
    return f"CASE WHEN {t}.a IS NULL OR {t}.b IS NULL THEN NULL WHEN len({t}.a) > 0 THEN {_distance(t)} / len({t}.a) WHEN len({t}.b) > 0 THEN 1 ELSE 0 END"


_LISTED = "CASE WHEN {0} IS NOT NULL THEN list_filter(string_split({0}, '{1}'), lambda v: v <> '') END"
_PAIRS = f"""WITH t AS (SELECT example_id, {_transcript("target_text", "")} AS ca, {_transcript("reference_text", "")} AS cb, {_transcript("target_text")} AS wa, {_transcript("reference_text")} AS wb, reference_text <> '' AND target_text <> '' AS given FROM grpo_example),
    c0 AS (SELECT example_id, given, {_LISTED.format("ca", "")} AS a, {_LISTED.format("cb", "")} AS b FROM t), c AS (SELECT *, list_distinct(list_concat(a, b)) AS d FROM c0),
    w0 AS (SELECT example_id, given, {_LISTED.format("wa", " ")} AS a, {_LISTED.format("wb", " ")} AS b FROM t), w AS (SELECT *, list_distinct(list_concat(a, b)) AS d FROM w0)"""


@query(f"SELECT row_no, {_transcript('text')} AS said FROM manifest")
def h1_transcripts(s, d):
    return table(s, d, "manifest", "row_no", "text").select("row_no", text.transcript(F.col("text")).alias("said"))


def _both(g: DataFrame, rate) -> DataFrame:
    """The rate of each row, null where a text is."""
    have = F.col("target_text").isNotNull() & F.col("reference_text").isNotNull()
    return g.select("example_id", F.when(have, F.round(rate, 9)).alias("rate"))


@query(f"{_PAIRS} SELECT example_id, round({_error_rate('c')}, 9) AS rate FROM c")
def h3_character_errors(s, d):
    g = table(s, d, "grpo_example", "example_id", "target_text", "reference_text")
    return _both(g, text.character_error_rate(F.col("target_text"), F.col("reference_text")))


@query(f"{_PAIRS} SELECT example_id, round({_error_rate('w')}, 9) AS rate FROM w")
def h3_word_errors(s, d):
    g = table(s, d, "grpo_example", "example_id", "target_text", "reference_text")
    return _both(g, text.word_error_rate(F.col("target_text"), F.col("reference_text")))


@query()
def h5_rendered(s, d):
    g = table(s, d, "grpo_example")
    return g.select("example_id", frontend.rendered(F.regexp_replace("target_text", r"(?U)\s+", " "), _control("array")).alias("model_text"))


@query()
def h8_normalized(s, d):
    r = table(s, d, "synthesis_request", "request_id", "text", language_code(F.col("language")).alias("lang"))
    return r.select("request_id", frontend.normalized(F.col("text"), F.coalesce("lang", F.lit("tr"))).alias("normal"))


def _shortened(x: str, short: str, full: str) -> str:
    one = lambda y: rf"regexp_replace({y}, '(^|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]){short}\.', '\1{full}', 'gi')"
    return one(one(x))  # twice: matches that touch


_QUOTED = "replace(regexp_replace(regexp_replace(regexp_replace(text, '[“”]', '\"', 'g'), '[‘’]', chr(39), 'g'), '[–—]', '-', 'g'), '…', '...')"
for _s, _f in (("dr", "doctor"), ("prof", "professor"), ("mr", "mister"), ("mrs", "missus")):
    _QUOTED = _shortened(_QUOTED, _s, _f)


@query(rf"SELECT request_id, trim(regexp_replace({_QUOTED}, '{_SPACES}', ' ', 'g')) AS plain FROM synthesis_request")
def h8_plain_quotes(s, d):
    return table(s, d, "synthesis_request", "request_id", "text").select("request_id", frontend.native_normalized(F.col("text"), "en").alias("plain"))


@query()
def h13_chunks(s, d):
    r = table(s, d, "synthesis_request", "request_id", "text")
    return r.select("request_id", F.posexplode(frontend.chunked(F.col("text"), 280)).alias("chunk_no", "chunk"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[^\s\x0B\x{85}\p{Z}]+')) AS n_split, len(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]+')) AS n_runs FROM documents WHERE text IS NOT NULL""")
def h14_word_counts(s, d):
    t = F.col("text")
    return table(s, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", text.split_words(t).alias("n_split"), text.word_runs(t).alias("n_runs"))


_UNITS = r"len(regexp_replace(coalesce({0}, ''), '[\s\x0B\x{{85}}\p{{Z}}]+', '', 'g'))"


@query(rf"""WITH u AS (SELECT example_id, target_duration_seconds AS t, {_UNITS.format("target_text")} AS a, {_UNITS.format("reference_text")} AS b, len(reference_audio_ids) / 32 / 12.5::DOUBLE AS s FROM grpo_example)
           SELECT example_id, round(CASE WHEN t > 0 AND NOT isnan(t) THEN t WHEN s > 0 AND a > 0 AND b > 0 THEN s * a / b END, 6) AS seconds FROM u""")
def h15_target_durations(s, d):
    g = table(s, d, "grpo_example", "example_id", "target_duration_seconds", "target_text", "reference_text", "reference_audio_ids")
    given = F.when(~F.isnan("target_duration_seconds"), F.col("target_duration_seconds"))
    return g.select("example_id", F.round(text.target_duration(given, F.col("target_text"), F.col("reference_text"), F.size("reference_audio_ids") / 32 / 12.5), 6).alias("seconds"))


@query(f"SELECT {_squeeze(_fold('text'))} AS key, count(*) AS n_rows FROM manifest WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def h18_duplicate_keys(s, d):
    m = table(s, d, "manifest", "text").filter("text is not null")
    return m.groupBy(text.duplicate_key(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


# I: tokens

_CODES = "list_transform(embedding, lambda x: CAST(floor(abs(x) * 100) AS INT) % 16)"


def _codes(s, d):
    e = table(s, d, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.transform("embedding", lambda x: F.pmod(F.floor(F.abs(x) * F.lit(100).cast("float")).cast("int"), F.lit(16))).alias("flat"))


@query(f"SELECT vec_id, list_transform({_CODES}, lambda x, i: CAST(1010 + ((i - 1) % 4) * 16 + x AS INT)) AS ids FROM embeddings".replace("{_CODES}", _CODES))
def i1_ids_of_codes(s, d):
    """A matrix of four codebooks from the flat codes, and back to ids."""
    rows = _codes(s, d).withColumn("m", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.filter("flat", lambda _, i: F.pmod(i, F.lit(4)) == c)))
    return rows.select("vec_id", SMALL.from_codes(F.col("m")).alias("ids"))


@query(f"SELECT vec_id, list_transform([0, 1, 2, 3], lambda c: list_transform(range(0, 15), lambda t: ({_CODES})[t * 4 + c + 1])) AS codes FROM embeddings")
def i2_codes_of_ids(s, d):
    """Sixteen frames of which the last is broken by an id of another codebook."""
    ids = F.concat(F.slice(SMALL.from_frames(F.col("flat")), 1, 62), F.array(F.lit(1010), F.lit(1010)))
    return _codes(s, d).select("vec_id", SMALL.to_codes(ids).alias("codes"))


@query(f"SELECT vec_id, list_concat(list_concat([1003, 65, 66, 2, 1004, 1005, 1001], list_transform({_CODES}, lambda x, i: CAST(1010 + ((i - 1) % 4) * 16 + x AS INT))), [1002]) AS ids FROM embeddings")
def i3_speech_sequences(s, d):
    return _codes(s, d).select("vec_id", SMALL.speech(F.array(F.lit(65), F.lit(66)), SMALL.from_frames(F.col("flat"))).alias("ids"))


@query(f"""SELECT example_id, list_concat(list_concat(list_concat(list_concat([160003], list_transform(string_split({_squeeze("reference_text")}, ''), lambda c: unicode(c))), [3, 160004, 160005]), list_transform(string_split({_squeeze("target_text")}, ''), lambda c: unicode(c))), [3]) AS ids
          FROM grpo_example WHERE len({_squeeze("reference_text")}) > 0 AND len({_squeeze("target_text")}) > 0""")
def i4_answer_sequences(s, d):
    from voxloom.functions.forms import squeezed

    g = table(s, d, "grpo_example", "example_id", squeezed(F.col("reference_text")).alias("q"), squeezed(F.col("target_text")).alias("a")).filter("length(q) > 0 and length(a) > 0")
    return g.select("example_id", LAYOUT.answer(tokens.code_points(F.col("q")), tokens.code_points(F.col("a"))).alias("ids"))


@query("""WITH g AS (SELECT example_id, reference_audio_ids AS x FROM grpo_example WHERE reference_audio_ids IS NOT NULL),
          b AS (SELECT *, list_position(list_transform(x, lambda a, i: a < 160010 + ((i - 1) % 32) * 2048 OR a >= 160010 + ((i - 1) % 32 + 1) * 2048), true) AS bad FROM g)
          SELECT example_id, CAST((CASE WHEN bad > 0 THEN bad - 1 ELSE len(x) END) // 32 AS INT) AS frames, coalesce(bad, 0) = 0 AND len(x) > 0 AND len(x) % 32 = 0 AS valid FROM b""")
def i5_completions(s, d):
    g = table(s, d, "grpo_example", "example_id", "reference_audio_ids").filter("reference_audio_ids is not null")
    c = LAYOUT.completion(F.array_append("reference_audio_ids", F.lit(LAYOUT.special(tokens.EOS_SPEECH))))
    return g.select("example_id", c.alias("c")).select("example_id", "c.frames", "c.valid")


@query("""WITH g AS (SELECT example_id, prompt AS x, example_id // 16 AS b FROM grpo_example WHERE prompt IS NOT NULL), m AS (SELECT *, max(len(x)) OVER (PARTITION BY b) AS n FROM g)
          SELECT example_id, list_concat(x, list_transform(range(0, n - len(x)), lambda _: CAST(0 AS INT))) AS ids, list_concat(list_transform(x, lambda _: CAST(1 AS INT)), list_transform(range(0, n - len(x)), lambda _: CAST(0 AS INT))) AS attention_mask,
          list_concat(x, list_transform(range(0, n - len(x)), lambda _: CAST(-100 AS INT))) AS labels FROM m""")
def i11_collated(s, d):
    g = table(s, d, "grpo_example", "example_id", F.col("prompt").alias("ids")).filter("ids is not null").withColumn("b", F.floor(F.col("example_id") / 16))
    return batching.collated(g, ["b"], "ids", 0).select("example_id", "ids", "attention_mask", "labels")


@query("""WITH g AS (SELECT example_id, prompt AS x, max(len(prompt)) OVER (PARTITION BY example_id // 16) AS n FROM grpo_example WHERE prompt IS NOT NULL)
          SELECT example_id, list_concat(list_transform(range(0, n - len(x)), lambda _: CAST(7 AS INT)), x) AS ids FROM g""")
def i12_left_padded(s, d):
    g = table(s, d, "grpo_example", "example_id", F.col("prompt").alias("ids")).filter("ids is not null").withColumn("b", F.floor(F.col("example_id") / 16))
    return batching.left_padded(g, ["b"], "ids", 7).select("example_id", "ids")


@query("SELECT row_no, CAST(ceil(audio_seconds * 24000 / 1920) AS INT) AS frames, CAST(greatest(1, ceil(audio_seconds / 2 * 12.5)) AS INT) AS least, CAST(ceil(audio_seconds * 2 * 12.5) AS INT) AS most FROM expressive WHERE audio_seconds IS NOT NULL")
def i13_frame_limits(s, d):
    e = table(s, d, "expressive", "row_no", "audio_seconds").filter("audio_seconds is not null")
    lim = tokens.frame_limits(F.col("audio_seconds") / 2, F.col("audio_seconds") * 2)
    return e.select("row_no", tokens.frame_count(F.col("audio_seconds") * 24000).alias("frames"), lim["least"].alias("least"), lim["most"].alias("most"))


@query("""SELECT vec_id, CAST(1010 + (vec_id % 4) * 16 AS BIGINT) AS low, CAST(1026 + (vec_id % 4) * 16 AS BIGINT) AS high, vec_id % 4 = 0 AND vec_id // 4 >= 3 AS may_end, vec_id % 4 = 0 AND vec_id // 4 >= 100 AS must_end FROM embeddings""")
def i15_legal_ids(s, d):
    return table(s, d, "embeddings", "vec_id", SMALL.legal(F.col("vec_id"), F.lit(3), F.lit(100)).alias("l")).select("vec_id", "l.*")


@query("SELECT row_no, CAST(coalesce(json_array_length(nullif(events, '')::JSON), 0) AS INT) AS n_events, json_extract_string(nullif(events, '')::JSON, '$[0].type') AS first_type FROM expressive")
def i17_events(s, d):
    ev = frontend.events_of_json(F.col("events"))
    return table(s, d, "expressive", "row_no", "events").select("row_no", F.size(ev).alias("n_events"), F.get(ev, F.lit(0))["type"].alias("first_type"))


# J: signals and vectors


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
          SELECT vec_id, round(list_max(list_transform(x, lambda v: abs(v))), 6) AS peak, round(20 * log10(greatest(sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)), 1e-10)), 5) AS rms_dbfs,
          round(list_sum(x) / len(x), 6) AS dc_offset, round(len(list_filter(x, lambda v: abs(v) >= 0.999::DOUBLE)) / len(x), 6) AS clipping_ratio FROM e""")
def j2_levels(s, d):
    x = F.col("embedding")
    return table(s, d, "embeddings").select(
        "vec_id", F.round(signal.peak(x), 6).alias("peak"), F.round(signal.decibels(signal.rms(x)), 5).alias("rms_dbfs"), F.round(signal.dc_offset(x), 6).alias("dc_offset"), F.round(signal.clipping_ratio(x), 6).alias("clipping_ratio"),
    )


@query("""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v / 40) AS x FROM embeddings), f AS (SELECT vec_id, list_transform(range(0, 1 + (len(x) - 16) // 8), lambda i: x[CAST(i * 8 + 1 AS BIGINT):CAST(i * 8 + 16 AS BIGINT)]) AS f FROM e),
          l AS (SELECT vec_id, list_transform(f, lambda w: 20 * log10(greatest(sqrt(list_sum(list_transform(w, lambda v: v * v)) / len(w) + 1e-12), 1e-10))) AS l FROM f)
          SELECT vec_id, round(len(list_filter(l, lambda v: v < -45)) / len(l), 6) AS silence_ratio FROM l""")
def j4_silence(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(signal.silence_ratio(F.transform(F.col("embedding").cast("array<double>"), lambda v: v / 40), 640), 6).alias("silence_ratio"))


@query("""WITH r AS (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY label) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], ref::DOUBLE[]), 6) AS similarity FROM embeddings JOIN r USING (label)""")
def j8_cosines(s, d):
    e = table(s, d, "embeddings")
    ref = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return skew_join(e, ref, ["label"], "vec_id", "inner").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("ref")), 6).alias("similarity"))


@query("""WITH r AS (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY label), p AS (SELECT vec_id, ref::DOUBLE[] AS a, embedding::DOUBLE[] AS b FROM embeddings JOIN r USING (label)),
          u AS (SELECT vec_id, unnest(a) AS a, unnest(b) AS b FROM p), m AS (SELECT vec_id, avg(a) AS ma, avg(b) AS mb FROM u GROUP BY vec_id),
          s AS (SELECT vec_id, sum((a - ma) * (a - ma)) AS xx, sum((b - mb) * (b - mb)) AS yy, sum((a - ma) * (b - mb)) AS xy FROM u JOIN m USING (vec_id) GROUP BY vec_id)
          SELECT vec_id, round(10 * log10((xy * xy / xx + 1e-12) / (yy - xy * xy / xx + 1e-12)), 4) AS si_sdr FROM s WHERE vec_id NOT IN (SELECT min(vec_id) FROM embeddings GROUP BY label)""")
def j10_si_sdr(s, d):
    e = table(s, d, "embeddings")
    ref = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"), F.min("vec_id").alias("first"))
    return skew_join(e, ref, ["label"], "vec_id", "inner").filter("vec_id <> first").select("vec_id", F.round(signal.si_sdr(F.col("ref"), F.col("embedding")), 4).alias("si_sdr"))


@query("""SELECT vec_id, round(list_sum(list_transform(u, lambda v: v * v)), 6) AS size, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)""")
def j12_unit_vectors(s, d):
    u = vectors.unit(F.col("embedding"))
    return table(s, d, "embeddings").select("vec_id", u.alias("u")).select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("size"), F.round(F.get("u", F.lit(0)), 6).alias("first"))


@query("""WITH e AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
          SELECT vec_id, list_transform(list_concat(list_concat(x[1:54], list_transform(range(1, 11), lambda i: x[54 + i] * (1 - (i - 1) / 10) + y[i] * ((i - 1) / 10))), y[11:]), lambda v: round(v, 5) + 0.0::DOUBLE) AS joined FROM e""")
def j13_crossfaded(s, d):
    e = table(s, d, "embeddings", "vec_id", F.col("embedding").alias("x"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(nxt, "vec_id").select("vec_id", F.transform(signal.crossfaded(F.array("x", "y"), 1000, 10), lambda v: F.round(v, 5) + F.lit(0.0)).alias("joined"))


def _waves(s, d):
    return table(s, d, "embeddings", "vec_id", F.flatten(F.array_repeat("embedding", 8)).alias("wave"))


@query()
def j1_waveform_metrics(s, d):
    return _waves(s, d).select("vec_id", signal.analyzed(F.col("wave"), F.lit(200)).alias("m")).select("vec_id", "m.*")


@query()
def j11_codec_check(s, d):
    pairs = _waves(s, d).withColumn("estimate", F.transform("wave", lambda v: F.round(v, 1).cast("float")))
    return speech.codec_check(pairs, "wave", "estimate", 200).drop("wave", "estimate")


# K: rewards


def _measured(s, d):
    return table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") > 3).alias("valid"), F.when(F.col("l_tax") < 0.07, F.col("l_discount") * 2).alias("error"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") / 10).alias("nll"),
        (F.col("l_quantity") / 4).alias("seconds"), F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") / 10000).alias("target"), F.when(F.col("l_linestatus") == "F", F.col("l_tax") * 10).alias("speaker"),
    )


_MEASURED = """WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity > 3 AS valid, CASE WHEN l_tax < 0.07::DOUBLE THEN l_discount * 2 END AS error, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 10 END AS nll, l_quantity / 4 AS seconds,
      CASE WHEN l_returnflag <> 'N' THEN l_extendedprice / 10000 END AS target, CASE WHEN l_linestatus = 'F' THEN l_tax * 10 END AS speaker FROM lineitem),
    p AS (SELECT *, 1 - tanh(3 * greatest(0, error)) AS er, exp(-greatest(0, nll) / 3) AS nr, CASE WHEN seconds > 0 AND target > 0 THEN CASE WHEN seconds / target BETWEEN 0.75::DOUBLE AND 1.25::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS dr,
      CASE WHEN seconds > 0 AND target > 0 THEN exp(-abs(ln(seconds / target)) / 0.35) END AS ds, 1 - least(seconds / 12, 1) AS sp FROM m),
    i AS (SELECT *, CASE WHEN error IS NULL AND nll IS NULL THEN 0 ELSE (CASE WHEN error IS NULL THEN 0 ELSE 0.6 END + CASE WHEN nll IS NULL THEN 0 ELSE 0.4 END) / (CASE WHEN er IS NULL THEN 0 ELSE 0.6 / greatest(er, 1e-8) END + CASE WHEN nr IS NULL THEN 0 ELSE 0.4 / greatest(nr, 1e-8) END) END AS it FROM (SELECT * REPLACE (CASE WHEN error IS NOT NULL THEN er END AS er, CASE WHEN nll IS NOT NULL THEN nr END AS nr) FROM p))"""
_WEIGHTS = {"intelligibility": 1.0, "speaker": 0.5, "duration": 0.25, "speed": 0.1, "format": 0.1}


def _components():
    c = F.col
    return {
        "intelligibility": rewards.intelligibility(c("error"), c("nll")), "speaker": c("speaker"), "duration": rewards.duration_reward(c("seconds"), c("target")),
        "speed": rewards.speed_reward(c("seconds")), "format": c("valid").cast("double"),
    }


@query(_MEASURED + """ SELECT l_orderkey, l_linenumber, round(er, 6) AS error_reward, round(nr, 6) AS nll_reward, dr AS duration, round(ds, 6) AS smooth, round(sp, 6) AS speed, round(it, 6) AS intelligibility FROM i""")
def k1_components(s, d):
    c, p = F.col, _components()
    return _measured(s, d).select(
        "l_orderkey", "l_linenumber", F.round(F.when(c("error").isNotNull(), rewards.error_reward(c("error"))), 6).alias("error_reward"), F.round(F.when(c("nll").isNotNull(), rewards.nll_reward(c("nll"))), 6).alias("nll_reward"), p["duration"].alias("duration"),
        F.round(rewards.duration_reward(c("seconds"), c("target"), "smooth_log"), 6).alias("smooth"), F.round(p["speed"], 6).alias("speed"), F.round(p["intelligibility"], 6).alias("intelligibility"),
    )


_FUSED = """CASE WHEN NOT valid THEN -1 ELSE (it + coalesce(speaker * 0.5, 0) + coalesce(dr * 0.25, 0) + sp * 0.1 + 0.1) / (1 + CASE WHEN speaker IS NULL THEN 0 ELSE 0.5 END + CASE WHEN dr IS NULL THEN 0 ELSE 0.25 END + 0.1 + 0.1) END"""


@query(_MEASURED + f" SELECT l_orderkey, l_linenumber, round({_FUSED}, 6) AS reward FROM i")
def k9_rewards(s, d):
    made = rewards.rewarded(_measured(s, d), _components(), F.col("valid"), _WEIGHTS)
    return made.select("l_orderkey", "l_linenumber", F.round("reward", 6).alias("reward"))


@query(_MEASURED + """ SELECT round(avg(it) FILTER (valid), 6) AS intelligibility, round(avg(speaker) FILTER (valid), 6) AS speaker, round(avg(dr) FILTER (valid), 6) AS duration, round(avg(sp) FILTER (valid), 6) AS speed, round(avg(valid::INT), 6) AS format FROM i""")
def d8_component_means(s, d):
    p = _components()
    return _measured(s, d).agg(*[F.round(F.avg(v if k == "format" else F.when(F.col("valid"), v)), 6).alias(k) for k, v in p.items()])


# L: JSON and hashing


@query("SELECT l_orderkey, l_linenumber, '{\"discount\":' || l_discount || ',\"flag\":\"' || l_returnflag || '\"}' AS j FROM lineitem")
def l2_sorted_json(s, d):
    li = table(s, d, "lineitem", "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("discount"))
    return li.select("l_orderkey", "l_linenumber", files.sorted_json(li.select("flag", "discount")).alias("j"))


@query("SELECT sha256(audio) AS digest, count(*) AS n_rows, min(row_no) AS first_row FROM manifest WHERE audio IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def l6_digests(s, d):
    m = table(s, d, "manifest", "row_no", "audio").filter("audio is not null")
    return m.groupBy(F.sha2("audio", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("row_no").alias("first_row")).filter("n_rows > 1")


# N: streams


@query("SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def n0_event_rates(s, d):
    return ingest.event_rates(table(s, d, "events")).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n_events", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def n1_stream_ingest(s, d):
    """The events table through the file stream, batch by batch, and back."""
    target = own_path(s, "ingest")
    kinds = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ingest.ingest(s, f"{d}/events.parquet*", target, kinds, lambda b: b.select("event_id", "user_id", "event_type", "value"), {"table": "events"}, 4)
    return s.read.schema("event_id long, user_id long, event_type string, value double").parquet(f"{target}/data/batch=*")


@query("""WITH RECURSIVE r AS (SELECT doc_id, n_chars, doc_id // 5000 AS writer, row_number() OVER (PARTITION BY doc_id // 5000 ORDER BY doc_id) AS k FROM documents),
          f AS (SELECT doc_id, n_chars, writer, k, 0 AS batch_no, 1 AS n, n_chars AS b FROM r WHERE k = 1
                UNION ALL SELECT r.doc_id, r.n_chars, r.writer, r.k, CASE WHEN c THEN f.batch_no + 1 ELSE f.batch_no END, CASE WHEN c THEN 1 ELSE f.n + 1 END, CASE WHEN c THEN r.n_chars ELSE f.b + r.n_chars END
                FROM f JOIN r ON r.writer = f.writer AND r.k = f.k + 1, LATERAL (SELECT f.n >= 64 OR f.b >= 50000 OR f.b + r.n_chars > 50000 AS c))
          SELECT writer, doc_id, n_chars, batch_no FROM f""")
def n4_upload_batches(s, d):
    m = table(s, d, "documents", "doc_id", "n_chars", F.floor(F.col("doc_id") / 5000).alias("writer"))
    return batching.upload_batches(m, "doc_id", "n_chars", 64, 50_000, "writer")


# more of the scalar functions


@query("""SELECT l_orderkey, l_linenumber, round((exp(-abs(l_quantity - 25) / 8) + exp(-abs(l_discount - 0.05::DOUBLE) / 0.35) + exp(-abs(l_tax - 0.04::DOUBLE) / 0.3) + CASE WHEN l_returnflag <> 'N' THEN exp(-abs(12 * log2(l_extendedprice / 100 / 200)) / 8) ELSE 0 END
          + CASE WHEN l_linestatus <> 'O' THEN exp(-abs(l_tax * 50 - 2) / 4) ELSE 0 END) / (3 + CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END + CASE WHEN l_linestatus <> 'O' THEN 1 ELSE 0 END), 6) AS prosody FROM lineitem""")
def d13_prosody(s, d):
    named = lambda e, v, q, p, t: F.struct(e.alias("energy_std_db"), v.alias("voiced_ratio"), q.alias("silence_ratio"), p.alias("pitch_median_hz"), t.alias("pitch_std_semitones"))
    c = F.col
    own = named(c("l_quantity"), c("l_discount"), c("l_tax"), F.when(c("l_returnflag") != "N", c("l_extendedprice") / 100), F.when(c("l_linestatus") != "O", c("l_tax") * 50))
    ref = named(F.lit(25.0), F.lit(0.05), F.lit(0.04), F.lit(200.0), F.lit(2.0))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(signal.prosody_similarity(own, ref), 6).alias("prosody"))


@query(f"""WITH t AS (SELECT example_id, target_duration_seconds AS t, len({_transcript("target_text", "")}) AS a, len({_transcript("reference_text", "")}) AS b, len(reference_audio_ids) AS n, len(reference_text) AS r FROM grpo_example)
           SELECT example_id, round(CASE WHEN t > 0 AND NOT isnan(t) THEN t WHEN n > 0 AND r > 0 AND a > 0 AND b > 0 THEN n / 32::DOUBLE / 12.5 * a / b ELSE -1 END, 6) AS seconds FROM t""")
def h16_reward_durations(s, d):
    g = table(s, d, "grpo_example", "example_id", "target_duration_seconds", "target_text", "reference_text", "reference_audio_ids")
    given = F.when(~F.isnan("target_duration_seconds"), F.col("target_duration_seconds"))
    return g.select("example_id", F.round(text.reward_duration(given, F.col("target_text"), F.col("reference_text"), F.col("reference_audio_ids")), 6).alias("seconds"))


@query("SELECT example_id, CASE WHEN lower(coalesce(language, '')) LIKE 'en%' THEN 'wer' ELSE 'cer' END AS metric FROM grpo_example")
def h20_metric_names(s, d):
    return table(s, d, "grpo_example", "example_id", text.metric_name(F.col("language")).alias("metric"))


@query("""SELECT example_id, list_concat(list_concat(list_concat(list_concat([160003], list_transform(string_split(reference_text, ''), lambda c: unicode(c))), list_transform(string_split(target_text, ''), lambda c: unicode(c))), [3, 160004, 160005, 160001]), reference_audio_ids) AS ids
          FROM grpo_example WHERE reference_text <> '' AND target_text <> '' AND reference_audio_ids IS NOT NULL""")
def i9_clone_prompts(s, d):
    g = table(s, d, "grpo_example", "example_id", "reference_text", "target_text", "reference_audio_ids").filter("reference_text <> '' and target_text <> '' and reference_audio_ids is not null")
    return g.select("example_id", LAYOUT.clone_prompt(tokens.code_points(F.col("reference_text")), tokens.code_points(F.col("target_text")), F.col("reference_audio_ids")).alias("ids"))


@query("""SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, 0.3 * exp(-1500 * l_discount / 100) + 0.15 * exp(-40 * l_tax / 10) + 0.2 * exp(-abs(20 * log10(l_quantity / 50) + 20) / 18) + 0.15 * exp(-5 * greatest(0, l_discount * 10 - 0.65)) + 0.2 * exp(-80 * greatest(0, 0.98 + l_tax / 10 - 0.985)))), 6) AS quality FROM lineitem""")
def j7_technical_quality(s, d):
    c = F.col
    q = signal.technical_quality(c("l_discount") / 100, c("l_tax") / 10, c("l_quantity") / 50, c("l_discount") * 10, 0.98 + c("l_tax") / 10)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(q, 6).alias("quality"))


@query("""WITH r AS (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY label)
          SELECT vec_id, round(least(1, greatest(0, list_dot_product(embedding::DOUBLE[], ref::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(ref::DOUBLE[], ref::DOUBLE[])))), 6) AS similarity FROM embeddings JOIN r USING (label)""")
def j9_clipped_dots(s, d):
    e = table(s, d, "embeddings")
    ref = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return skew_join(e, ref, ["label"], "vec_id", "inner").select("vec_id", F.round(vectors.clipped_dot(vectors.unit(F.col("embedding")), vectors.unit(F.col("ref")), 0.0), 6).alias("similarity"))


@query("SELECT vec_id, list_transform(range(0, 32), lambda i: round((embedding[i * 2 + 1]::DOUBLE + embedding[i * 2 + 2]::DOUBLE) / 2, 6) + 0.0::DOUBLE) AS mono FROM embeddings")
def j15_mono(s, d):
    e = table(s, d, "embeddings", "vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.slice("embedding", i * 2 + 1, 2)).alias("frames"))
    return e.select("vec_id", F.transform(signal.mono(F.col("frames")), lambda v: F.round(v, 6) + F.lit(0.0)).alias("mono"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN l_discount WHEN l_linenumber % 3 = 1 THEN l_tax ELSE 0 END AS score, CASE WHEN l_discount >= l_tax THEN 'Joy' ELSE 'anger' END AS top, CASE WHEN l_discount >= 0.05::DOUBLE THEN 'Joy' WHEN l_tax >= 0.05::DOUBLE THEN 'anger' END AS first FROM lineitem""")
def k7_class_scores(s, d):
    c = F.col
    pair = lambda k, v: F.struct(F.lit(k).alias("label"), c(v).alias("score"))
    listed = F.array(pair("Joy", "l_discount"), pair("anger", "l_tax"))
    target = F.when(c("l_linenumber") % 3 == 0, "joy").when(c("l_linenumber") % 3 == 1, "ANGER").otherwise("fear")
    score = rewards.class_score(F.create_map(F.lit("Joy"), c("l_discount"), F.lit("anger"), c("l_tax")), target)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"), rewards.top_label(listed).alias("top"), rewards.first_over(listed, 0.05).alias("first"))


@query("""SELECT l_orderkey, CASE WHEN l_discount >= l_tax THEN 'Joy' ELSE 'anger' END AS type, l_linenumber::DOUBLE AS start FROM lineitem WHERE greatest(l_discount, l_tax) >= 0.05::DOUBLE""")
def e12_detected_events(s, d):
    """Lines of an order as windows with a score for each of two labels."""
    pair = lambda k, v: F.struct(F.lit(k).alias("label"), F.col(v).cast("double").alias("score"))
    w = F.struct(F.col("l_linenumber").cast("double").alias("start"), F.array(pair("Joy", "l_discount"), pair("anger", "l_tax")).alias("scores"))
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(w)).alias("windows"))
    return g.select("l_orderkey", F.explode(measures.detected_events(F.col("windows"), 0.05)).alias("e")).select("l_orderkey", "e.*")


# composite: events of different users aligned, long texts with their events


@query()
def c7_event_alignment(s, d):
    """Clicks of a user as expected, views as detected events of one day, by hour."""
    e = table(s, d, "events").select("user_id", F.to_date("ts").alias("day"), F.struct(F.lit("event").alias("type"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("start")).alias("e"), "event_type")
    own = lambda k: F.array_sort(F.collect_list(F.when(F.col("event_type") == k, F.col("e"))))
    g = e.filter(F.col("event_type").isin("click", "view")).groupBy("user_id", "day").agg(own("click").alias("expected"), own("view").alias("detected"))
    return g.select("user_id", "day", measures.aligned(F.col("expected"), F.col("detected"), 2.0).alias("a")).select("user_id", "day", "a.*")


@query()
def e7_split_events(s, d):
    g = table(s, d, "grpo_example", "example_id", "target_text", "events").filter("target_text is not null and size(events) > 0")
    chunks = g.withColumn("chunks", frontend.chunked(F.col("target_text"), 80)).filter("size(chunks) > 0")
    return chunks.select("example_id", F.posexplode(speech.split_events(F.col("chunks"), frontend.widened_events(F.col("events")))).alias("chunk_no", "events")).select("example_id", "chunk_no", F.to_json("events").alias("events"))


@query(f"""{_PAIRS}, v AS (SELECT 'cer' AS metric, {_error_rate('c')} AS v FROM c WHERE a IS NOT NULL AND given UNION ALL SELECT 'wer', {_error_rate('w')} FROM w WHERE a IS NOT NULL AND given)
           SELECT metric, round(avg(v), 9) AS mean, round(quantile_cont(v, 0.5), 9) AS median, round(quantile_cont(v, 0.95), 9) AS p95, count(*) AS n_values FROM v GROUP BY metric""")
def r2_evaluated(s, d):
    g = table(s, d, "grpo_example", "example_id", F.col("target_text").alias("text"), F.col("reference_text").alias("hypothesis")).filter("text is not null and hypothesis is not null")
    made = measures.aggregate_numeric(speech.evaluated(g), ["cer", "wer"])
    return made.select("metric", *[F.round(c, 9).alias(c) for c in ("mean", "median", "p95")], "n_values")


@query()
def r4_expressive(s, d):
    g = table(s, d, "grpo_example")
    rows = g.select("example_id", F.col("target_text").alias("text"), language_code(F.col("language")).alias("language"), F.col("clip_id").alias("id"), "hard_case", _control("array").alias("c"), LAYOUT.to_codes(F.col("reference_audio_ids")).alias("codes")).filter("codes is not null")
    return speech.expressive(rows, LAYOUT, F.col("c"), F.col("codes"), language=F.col("language"))


# round trips through sinks and sources


@query("SELECT id, audio, text, speaker, language, license FROM manifest")
def a1_json_lines(s, d):
    """The manifest as JSON lines and back."""
    path = own_path(s, "manifest.jsonl")
    files.write_jsonl(table(s, d, "manifest", "id", "audio", "text", "speaker", "language", "license"), path)
    return files.read_jsonl(s, path).drop("_file", "_line")


@query("SELECT len(input_ids) AS n_ids, md5(array_to_string(input_ids, ',')) AS digest FROM expressive WHERE input_ids IS NOT NULL")
def a7_token_shards(s, d):
    path = own_path(s, "tokens")
    files.write_tokens(table(s, d, "expressive", "input_ids").filter("input_ids is not null"), path)
    ids = s.read.schema("input_ids array<int>").parquet(path)
    return ids.select(F.size("input_ids").cast("long").alias("n_ids"), F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("digest"))


@query("SELECT row_no, id, text, emotion, audio_seconds, teacher_cer, hard_case, len(input_ids) AS n_ids FROM expressive")
def a8_expressive_shards(s, d):
    path = own_path(s, "expressive")
    rows = table(s, d, "expressive", "row_no", "id", "text", "emotion", "audio_seconds", "teacher_cer", "hard_case", "input_ids")
    files.write_expressive(rows, path)
    return s.read.schema(rows.schema).parquet(path).withColumn("n_ids", F.size("input_ids").cast("long")).drop("input_ids")


@query("SELECT emotion, count(*) AS n_rows, sum(example_id) AS ids FROM grpo_example WHERE hard_case AND emotion IS NOT NULL GROUP BY emotion")
def a11_hard_case_store(s, d):
    """Hard cases in two appends, then counted in the store."""
    path = own_path(s, "hard.jsonl")
    g = table(s, d, "grpo_example", "example_id", "emotion", "hard_case").filter("hard_case and emotion is not null")
    for half in (0, 1):
        files.append_hard_cases(g.filter(F.col("example_id") % 2 == half), path)
    return s.read.schema("example_id long, emotion string").json(path).groupBy("emotion").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("example_id").alias("ids"))


_PCM = "list_transform(embedding, lambda v: CASE WHEN round_even(greatest(-1, least(1, v::DOUBLE)) * 32767, 0) IS NULL THEN 0 ELSE round_even(greatest(-1, least(1, v::DOUBLE)) * 32767, 0) END)"


@query(f"""SELECT vec_id, CAST(len(embedding) AS INT) AS n_samples, CASE WHEN len(embedding) / 160 NOT BETWEEN 0.2 AND 30 THEN 'duration' END AS dropped,
           CASE WHEN len(embedding) / 160 BETWEEN 0.2 AND 30 THEN round(list_sum({_PCM}) / 32768, 4) END AS total FROM embeddings""")
def a13_decoded_clips(s, d):
    """Vectors as clips of 160 samples a second: encoded as WAV, decoded, filtered by duration."""
    e = table(s, d, "embeddings", "vec_id", "embedding").withColumns({"audio": F.struct(files.encoded_wav(F.col("embedding"), F.lit(160)).alias("bytes"), F.lit("x.wav").alias("path")), "text": F.lit("said")})
    out = files.decoded(e, rate=160)
    total = F.round(F.aggregate(F.transform("samples", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 4)
    return out.select("vec_id", F.size("embedding").alias("n_samples"), "dropped", total.alias("total"))


@query("SELECT l_orderkey, l_linenumber, CAST(greatest(1, ceil(l_discount * 10 * 12.5)) AS INT) AS least, CAST(ceil(l_quantity * 12.5) AS INT) AS most FROM lineitem")
def i14_second_limits(s, d):
    limits = tokens.frame_limits(F.col("l_discount") * 10, F.col("l_quantity"))
    return table(s, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_quantity").select("l_orderkey", "l_linenumber", limits.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


_E = "l_linenumber % 5 AS expected, l_linenumber % 3 AS detected, least(l_linenumber % 5, l_linenumber % 3) AS matched"


@query(f"""WITH e AS (SELECT l_orderkey, l_linenumber, {_E} FROM lineitem),
           p AS (SELECT *, CASE WHEN detected > 0 THEN matched / detected WHEN expected = 0 THEN 1 ELSE 0 END AS p, CASE WHEN expected > 0 THEN matched / expected WHEN detected = 0 THEN 1 ELSE 0 END AS r FROM e)
           SELECT l_orderkey, l_linenumber, round(p, 9) AS "precision", round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1, round(abs(detected - expected) / greatest(expected, 1), 9) AS count_error FROM p""")
def d11_event_scores(s, d):
    e = table(s, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", *_E.split(", ", 2))
    x = measures.event_scores(F.col("matched"), F.col("expected"), F.col("detected"))
    return e.select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", *[F.round(f"x.{c}", 9).alias(c) for c in ("precision", "recall", "f1", "count_error")])


def _said(n: str, lang: str) -> str:
    """SQL of the words of a number from 0 to 999,999."""
    ones, tens = frontend.ONES[lang], frontend.TENS[lang]
    pick = lambda words, at: f"list_extract([{', '.join(repr(w) for w in words)}], {at})"
    hundred, thousand = frontend.HUNDRED[lang], frontend.SCALES[lang][0]

    def below(x: str) -> str:
        many = f"CASE WHEN {x} // 100 = 1 THEN '{hundred}' ELSE {pick(ones, f'CAST({x} // 100 + 1 AS INT)')} || ' {hundred}' END" if lang == "tr" else f"{pick(ones, f'CAST({x} // 100 + 1 AS INT)')} || ' {hundred}'"
        small = f"CASE WHEN {x} % 100 < {len(ones)} THEN CASE WHEN {x} % 100 > 0 THEN {pick(ones, f'CAST({x} % 100 + 1 AS INT)')} ELSE '' END ELSE trim({pick(tens, f'CAST({x} % 100 // 10 AS INT)')} || ' ' || CASE WHEN {x} % 10 > 0 THEN {pick(ones, f'CAST({x} % 10 + 1 AS INT)')} ELSE '' END) END"
        return f"trim(CASE WHEN {x} >= 100 THEN {many} ELSE '' END || ' ' || {small})"

    lead = f"CASE WHEN {n} // 1000 = 1 THEN '{thousand}' ELSE {below(f'({n} // 1000)')} || ' {thousand}' END" if lang == "tr" else f"{below(f'({n} // 1000)')} || ' {thousand}'"
    return f"CASE WHEN {n} = 0 THEN '{ones[0]}' ELSE trim(CASE WHEN {n} >= 1000 THEN {lead} ELSE '' END || ' ' || {below(f'({n} % 1000)')}) END"


@query(f"WITH n AS (SELECT o_orderkey, o_orderkey * 37 % 1000000 AS n FROM orders) SELECT o_orderkey, {_said('n', 'tr')} AS tr, {_said('n', 'en')} AS en FROM n")
def h9_number_words(s, d):
    words = lambda lang: frontend.normalized((F.col("o_orderkey") * 37 % 1_000_000).cast("string"), F.lit(lang))
    return table(s, d, "orders", "o_orderkey").select("o_orderkey", words("tr").alias("tr"), words("en").alias("en"))


@query(f"""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o FROM orders), n AS (SELECT o_orderkey, day(o) AS dd, month(o) AS mm, year(o) AS yy FROM x)
           SELECT o_orderkey, {_said('dd', 'tr')} || ' ' || list_extract([{', '.join(repr(m) for m in frontend.MONTHS)}], CAST(mm AS INT)) || ' ' || {_said('yy', 'tr')} || ' günü, yüzde ' || {_said('dd', 'tr')} || ', ' || {_said('yy', 'tr')} || ' Türk lirası, doktor' AS said FROM n""")
def h11_dates_and_amounts(s, d):
    o = F.col("o_orderdate").cast("date")
    t = F.concat(F.dayofmonth(o), F.lit("."), F.month(o), F.lit("."), F.year(o), F.lit(" günü, %"), F.dayofmonth(o), F.lit(", "), F.year(o), F.lit(" TL, Dr."))
    return table(s, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", frontend.normalized(t, F.lit("tr")).alias("said"))


@query("SELECT request_id, id, text FROM synthesis_request ORDER BY request_id LIMIT 100")
def f1_first_rows(s, d):
    """A limit is the feature here."""
    return datasets.taken(table(s, d, "synthesis_request", "request_id", "id", "text"), "request_id", 100)


def _tone_codes(x):
    """Eight codes of a clip: whether its first samples are above zero."""
    import pandas as pd

    return pd.DataFrame({"codes": [[[int(w[t * 4 + c] > 0) for t in range(2)] for c in range(4)] for w in x["samples"]]})


@query("""SELECT vec_id, '1003,115,97,105,100,2,1004,1005,1001,' || array_to_string(list_transform(range(0, 8), lambda i: 1010 + (i % 4) * 16 + CASE WHEN embedding[i + 1]::DOUBLE * 32767 > 0.5 THEN 1 ELSE 0 END), ',') || ',1002' AS ids
          FROM embeddings WHERE len(embedding) >= 32""")
def r5_preprocessed(s, d):
    """Vectors as clips through the whole run: decode, batch, encode, pack, write, read."""
    e = table(s, d, "embeddings", F.col("vec_id").cast("long").alias("position"), F.struct(files.encoded_wav(F.col("embedding"), F.lit(160)).alias("bytes"), F.lit("x.wav").alias("path")).alias("audio"), F.lit("said").alias("text"))
    hook = protocols.Hook("codes", ("samples",), "codes array<array<int>>", _tone_codes)
    made = verbs.preprocess(e, SMALL, hook, settings=Encode(least_seconds=0.2), rate=160)
    return made.sequences.select(F.col("position").alias("vec_id"), F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("ids"))


def _tones(x):
    """A tone a request whose length depends on text and candidate."""
    import numpy as np
    import pandas as pd

    seconds = [0.5 + len(t) % 7 / 4 + c / 2 for t, c in zip(x["model_text"], x["candidate"])]
    return pd.DataFrame({"samples": [(0.3 * np.sin(2 * np.pi * 110 * np.arange(int(n * 400)) / 400)).astype(np.float32) for n in seconds]})


def _asked(s, d):
    asked = verbs.requests(table(s, d, "synthesis_request"))
    return asked.join(table(s, d, "synthesis_request", "request_id", "target_duration_seconds"), "request_id")


@query("SELECT request_id, text IS NOT NULL AND length(trim(text)) > 0 AND length(trim(coalesce(reference_text, ''))) > 0 AND length(trim(coalesce(reference_audio, ''))) > 0 AS made FROM synthesis_request")
def r6_inferred(s, d):
    """Requests through the whole run around a hook that makes tones: those that are ok have a winner."""
    gate = ranking.Gate(require_asr=False, minimum_technical_quality=0.0, maximum_repetition_similarity=1.0)
    made = verbs.infer(_asked(s, d), protocols.Hook("tones", ("model_text", "candidate"), "samples array<float>", _tones), None, gate, 2, 4, 400)
    return made.winners.select("request_id", F.col("candidate").isNotNull().alias("made"))


@query("SELECT o_orderkey, CAST((o_orderkey % 40 + 30) * 3 AS INT) AS n, round(o_orderkey % 7 / 7, 2) AS middle FROM orders")
def j14_resampled(s, d):
    """Constant signals at three times their rate: the level in the middle stays."""
    k, v = (F.col("o_orderkey") % 40 + 30).cast("int"), (F.col("o_orderkey") % 7) / 7
    o = table(s, d, "orders", "o_orderkey").select("o_orderkey", F.array_repeat(v.cast("float"), k).alias("x"))
    o = o.select("o_orderkey", signal.resampled(F.col("x"), F.lit(8000), 24000).alias("y"))
    return o.select("o_orderkey", F.size("y").alias("n"), F.round(F.get("y", F.floor(F.size("y") / 2).cast("int")).cast("double"), 2).alias("middle"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in QUERIES.items() if q}


