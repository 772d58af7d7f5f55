"""Queries over the operators of this package and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import components, contamination, dedup, languages, mixture, packing, residue, sampling, splitting
from voxloom.plans.scale import own_path, written
from voxloom.sources.tables import table


def _keys(s: SparkSession, d: str) -> DataFrame:
    return components.example_keys(table(s, d, "grpo_example", "example_id", "clip_id", "reference_text"), table(s, d, "expressive", "id", "speaker"))


def p1_found(s, d):
    """From the component table of one delivery, as it was persisted."""
    path = own_path(s, "components")
    components.deliver(_keys(s, d), path)
    return components.found(components.members(components.stored(s, path)))


def p1_splits(s, d):
    return components.deliver(_keys(s, d), own_path(s, "components"))


def _two(s, d):
    """Hard cases arrive as a second delivery, together with every row of the first that
    has no clip once more."""
    hard = table(s, d, "grpo_example", "example_id", F.coalesce("hard_case", F.lit(False)).alias("hard"), F.col("clip_id").isNull().alias("twice"))
    keys = written(_keys(s, d).join(hard, "example_id"), "deliveries")
    path = own_path(s, "components")
    first = components.deliver(keys.filter("not hard").drop("hard", "twice"), path)
    second = components.deliver(keys.filter("hard or twice").drop("hard", "twice"), path)
    return path, keys, first.withColumn("delivery", F.lit(1)).unionByName(second.withColumn("delivery", F.lit(2)))


def p1_incremental(s, d):
    return _two(s, d)[2]


def p1_closed(s, d):
    """Groups of the component table after both deliveries."""
    path, _, _ = _two(s, d)
    return components.members(components.stored(s, path)).select("example_id", "group_id")


def p1_together(s, d):
    """Keys of the examples and the splits that their examples got in either delivery."""
    _, keys, both = _two(s, d)
    splits = both.groupBy("example_id").agg(F.max("split").alias("split"), F.max("delivery").alias("delivery"))
    sides = keys.join(splits, "example_id").select(F.explode(F.array("skey", "tkey")).alias("key"), "split").filter("key is not null")
    return sides.groupBy("key").agg(F.count(F.lit(1)).alias("n_examples"), (F.count_distinct("split") <= 1).alias("together")).select(F.hex("key").alias("key"), "n_examples", "together")


def p1_shares(s, d):
    return components.reached(p1_splits(s, d))


def _model(s, d):
    noisy = table(s, d, "grpo_example", F.col("example_id").alias("doc_id"), F.col("target_text").alias("text"), F.col("language").alias("lang"))
    return languages.train(table(s, d, "documents", "doc_id", "text", "lang"), noisy=noisy)


def p2_segments(s, d):
    return languages.segments(table(s, d, "grpo_example", "example_id", "target_text", "language"), _model(s, d))


def p2_found(s, d):
    return languages.found(p2_segments(s, d))


def _sample(s, d):
    return sampling.sample(table(s, d, "grpo_example", "example_id", "emotion", "delivery", "language"), table(s, d, "sample_target"))


def p3_found(s, d):
    return sampling.found(_sample(s, d)[1])


def p3_sample(s, d):
    return _sample(s, d)[0]


def p3_report(s, d):
    return _sample(s, d)[1]


def p3_cells(s, d):
    """Of the report what doesn't depend on the draw."""
    r = _sample(s, d)[1]
    has = lambda why: F.coalesce(F.array_contains(F.split("reason", ","), why), F.lit(False))
    return r.select("plan_no", "cell_no", "n_rows", F.round("target_rows", 6).alias("target_rows"), has("few_rows").alias("few"), has("below_floor").alias("below"))


def _packed(s, d):
    return packing.pack(table(s, d, "expressive", "row_no", "input_ids"))


def p4_found(s, d):
    return packing.found(_packed(s, d))


def p4_places(s, d):
    return _packed(s, d)


def p4_fill(s, d):
    return packing.fill(_packed(s, d))


def p4_covered(s, d):
    """What the containers hold of each sequence: all of it, in as many pieces as needed."""
    return _packed(s, d).groupBy("row_no").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("n_ids"), F.count_distinct("container").alias("n_containers"))


def p4_containers(s, d):
    return packing.containers(table(s, d, "expressive", "row_no", "input_ids"), written(_packed(s, d), "packed"))


def p5_pieces(s, d):
    return splitting.split(table(s, d, "synthesis_request", "request_id", "text"))


def p5_found(s, d):
    return splitting.found(p5_pieces(s, d))


def p5_rebuilt(s, d):
    """Texts put together from what is new in their pieces, and how many pieces are too long."""
    each = F.struct("piece_no", F.expr("substr(piece, start - begin + 1)").alias("new"))
    rebuilt = F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["new"]), "")  # the pieces of one text
    return p5_pieces(s, d).groupBy("request_id").agg(F.md5(rebuilt).alias("digest"), F.count_if(F.length("piece") > 260).alias("too_long"))


def p6_found(s, d):
    return dedup.found(dedup.duplicate_sets(table(s, d, "manifest", "row_no", "text", "speaker", "extra")))


def p6_collapsed(s, d):
    return dedup.collapsed(table(s, d, "manifest"))


def p6_copies(s, d):
    """The kept rows and how many copies each had."""
    return dedup.collapsed(table(s, d, "manifest")).select("row_no", "n_copies")


def _leaks(s, d, near=True):
    return contamination.leaks(table(s, d, "documents", "doc_id", "text"), table(s, d, "eval_item", "item_id", "text"), near=near)


def p7_leaks(s, d):
    return _leaks(s, d)


def p7_found(s, d):
    return contamination.found(_leaks(s, d, near=False))


def p7_exact(s, d):
    """Exact rows of the search that looks for near leaks too."""
    return contamination.found(_leaks(s, d))


def _mix(s, d, size, schedules=None):
    return mixture.mix(table(s, d, "documents", "doc_id", "source", "text", "n_chars"), table(s, d, "source_weight"), size, schedules)


def p8_found(s, d):
    sizes = table(s, d, "documents", "doc_id", "source", F.col("n_chars").alias("size"))
    return mixture.found(mixture.plan(sizes, table(s, d, "source_weight"))[0])


def p8_supply(s, d):
    """The plan in characters: what each source has, what is wanted of it, what it can give."""
    sizes = table(s, d, "documents", "doc_id", "source", F.col("n_chars").alias("size"))
    r = mixture.plan(sizes, table(s, d, "source_weight"))[0]
    return r.select("source", "docs", "size", F.round("wanted", 4).alias("wanted"), F.round("given", 4).alias("given"), F.round("reached_bp", 4).alias("reached_bp"), F.round("runs_out_at", 6).alias("runs_out_at"), "short")


def p8_mixture(s, d):
    return _mix(s, d, mixture.token_count(F.col("text")))[0]


def p8_curriculum(s, d):
    """Two sources are brought forward, one grows towards the end."""
    return _mix(s, d, mixture.token_count(F.col("text")), {"story-shelf": [3, 1, 0.5], "museum-guides": [2, 1], "night-show": [0.2, 1, 3]})[0]


def p8_report(s, d):
    return _mix(s, d, mixture.token_count(F.col("text")))[1]


def _residue(s, d):
    return residue.detect(table(s, d, "documents", "doc_id", "text", "source"))


def p9_found(s, d):
    return residue.found(_residue(s, d))


def p9_marked(s, d):
    return _residue(s, d)


def p9_clean(s, d):
    return residue.clean(table(s, d, "documents"), _residue(s, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        p1_found, p1_splits, p1_incremental, p1_closed, p1_together, p1_shares, p2_found, p2_segments, p3_found, p3_sample, p3_report, p3_cells, p4_found, p4_places, p4_covered, p4_fill, p4_containers,
        p5_found, p5_pieces, p5_rebuilt, p6_found, p6_collapsed, p6_copies, p7_found, p7_leaks, p7_exact, p8_found, p8_supply, p8_mixture, p8_curriculum, p8_report, p9_found, p9_marked, p9_clean,
    )}


def _bare(x: str) -> str:
    return rf"regexp_replace(replace(replace(lower(translate({x}, 'İIı', 'iii')), 'ß', 'ss'), 'ς', 'σ'), '[^\p{{L}}\p{{M}}\p{{Nd}}]+', '', 'g')"


_NAMES = "({})".format(
    " UNION ALL ".join(f"SELECT '{n}' AS name, '{c}' AS code" for n, c in __import__("voxloom.functions.forms", fromlist=["NAMES"]).NAMES.items())
)


def oracle_sql() -> dict[str, str]:
    p1 = f"""
    WITH RECURSIVE sp AS (SELECT id, max(speaker) AS speaker FROM expressive WHERE id IS NOT NULL GROUP BY id),
    k AS (SELECT g.example_id AS e, CASE WHEN {_bare("sp.speaker")} NOT IN ('', 'unknown') THEN {_bare("sp.speaker")} END AS s, nullif({_bare("g.reference_text")}, '') AS t
          FROM grpo_example g LEFT JOIN sp ON sp.id = g.clip_id)"""
    p1_groups = p1 + """,
    b AS (SELECT e, s, min(e) OVER (PARTITION BY coalesce('s' || s, 'e' || e)) AS ms, min(e) OVER (PARTITION BY coalesce('t' || t, 'e' || e)) AS mt FROM k),
    edge AS (SELECT DISTINCT e AS a, ms AS b FROM b UNION SELECT DISTINCT e, mt FROM b UNION SELECT ms, e FROM b UNION SELECT mt, e FROM b),
    reach(root, node) AS (SELECT e, e FROM b UNION SELECT r.root, x.b FROM reach r JOIN edge x ON x.a = r.node WHERE r.root <= x.b),
    g AS (SELECT node AS e, min(root) AS group_id FROM reach GROUP BY node)"""
    p1_cases = p1_groups + """,
    c AS (SELECT g.group_id FROM g JOIN b USING (e) GROUP BY g.group_id HAVING count(DISTINCT coalesce(s, '')) > 1)
    SELECT e AS example_id, group_id FROM g WHERE group_id IN (SELECT group_id FROM c)"""
    p3 = rf"""
    WITH g AS (SELECT coalesce(nullif(lower(trim(emotion, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))), ''), 'neutral') AS emotion,
                      coalesce(nullif(lower(trim(delivery, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))), ''), 'neutral') AS delivery,
                      n.code AS language
               FROM grpo_example LEFT JOIN {_NAMES} n ON n.name = regexp_extract(lower(trim(language, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288))), '^([a-z]+)([-_][a-z0-9]+)*$', 1))
    SELECT t.plan_no, t.cell_no, count(g.emotion) AS n_rows, round(any_value(t.target_bp) * any_value(t.sample_pct) * (SELECT count(*) FROM grpo_example) / 1000000, 6) AS target_rows,
           count(g.emotion) * 1000000 < any_value(t.target_bp) * any_value(t.sample_pct) * (SELECT count(*) FROM grpo_example) AS few, count(g.emotion) < any_value(t.min_rows) AS below
    FROM sample_target t LEFT JOIN g ON (t.emotion IS NULL OR t.emotion = g.emotion) AND (t.delivery IS NULL OR t.delivery = g.delivery) AND (t.language IS NULL OR t.language = g.language)
    GROUP BY t.plan_no, t.cell_no"""
    p6 = f"""
    WITH x AS (SELECT row_no, {_bare("speaker")} AS s, {_bare("text")} AS t, extra FROM manifest),
    v AS (SELECT DISTINCT extra FROM x WHERE extra IS NOT NULL),
    f AS (SELECT v.extra, string_agg(j.fullkey || '=' || CASE WHEN j.type IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') THEN 'NUMBER=' || (j.atom::VARCHAR)::DOUBLE ELSE j.type || '=' || CASE WHEN j.type IN ('OBJECT', 'ARRAY') THEN '' ELSE coalesce(j.atom::VARCHAR, 'null') END END, chr(1) ORDER BY j.fullkey) AS form FROM v, json_tree(v.extra::JSON) j GROUP BY v.extra),
    k AS (SELECT row_no, min(row_no) OVER (PARTITION BY s, t, f.form) AS keep_no FROM x LEFT JOIN f ON f.extra = x.extra WHERE s <> '' AND t <> '')"""
    tags = r"regexp_replace(text, '<nar_(control|event)\b[^>]*>', '', 'gi')"
    p7 = f"""
    WITH i AS (SELECT item_id, {_bare("text")} AS b FROM eval_item), d AS (SELECT doc_id, {_bare(tags)} AS b FROM documents),
    si AS (SELECT DISTINCT item_id, substring(b, p, 60) AS w FROM (SELECT item_id, b, unnest(range(1, length(b) - 58)) AS p FROM i WHERE length(b) >= 60)),
    sd AS (SELECT DISTINCT doc_id, substring(b, p, 60) AS w FROM (SELECT doc_id, b, unnest(range(1, length(b) - 58)) AS p FROM d WHERE length(b) >= 60))
    SELECT DISTINCT doc_id, item_id FROM sd JOIN si USING (w)"""
    return {
        "p1_found": p1_cases,
        "p1_closed": p1_groups + " SELECT e AS example_id, group_id FROM g",
        "p1_together": p1 + " SELECT upper(md5(key)) AS key, count(*) AS n_examples, true AS together FROM (SELECT unnest([coalesce('s' || s, ''), coalesce('t' || t, '')]) AS key FROM k) WHERE key <> '' GROUP BY 1",
        "p3_found": f"SELECT plan_no, cell_no FROM ({p3}) WHERE few OR below",
        "p3_cells": p3,
        "p4_covered": "SELECT row_no, CAST(greatest(1, ceil(coalesce(len(input_ids), 0) / 8192)) AS BIGINT) AS n_pieces, coalesce(len(input_ids), 0) AS n_ids, CAST(ceil(coalesce(len(input_ids), 0) / 8192) AS BIGINT) AS n_containers FROM expressive",
        "p4_found": "SELECT row_no FROM expressive WHERE len(input_ids) > 8192",
        "p5_found": r"SELECT request_id FROM synthesis_request WHERE regexp_matches(text, '[^\p{P}\p{Z}\s\x0B\x1C-\x1F\x{85}]{261}')",
        "p5_rebuilt": "SELECT request_id, md5(text) AS digest, 0 AS too_long FROM synthesis_request WHERE text <> ''",
        "p6_found": p6 + " SELECT keep_no, row_no AS copy_no FROM k WHERE keep_no <> row_no",
        "p6_copies": p6 + " SELECT keep_no AS row_no, count(*) AS n_copies FROM k GROUP BY keep_no UNION ALL SELECT row_no, 1 FROM manifest WHERE row_no NOT IN (SELECT row_no FROM k)",
        "p7_found": p7,
        "p7_exact": p7,
        "p8_supply": """WITH t AS (SELECT sum(n_chars) AS t FROM documents), d AS (SELECT source, count(*) AS docs, sum(n_chars) AS size FROM documents GROUP BY source),
                        r AS (SELECT w.source, coalesce(docs, 0) AS docs, coalesce(size, 0) AS size, target_bp * t / 10000 AS wanted, coalesce(size, 0) * max_repeat AS supply FROM source_weight w LEFT JOIN d USING (source), t)
                        SELECT source, docs, size, round(wanted, 4) AS wanted, round(least(wanted, supply), 4) AS given, round(10000 * least(wanted, supply) / (SELECT sum(least(wanted, supply)) FROM r), 4) AS reached_bp,
                               round(CASE WHEN wanted > 0 THEN least(1, supply / wanted) ELSE 1 END, 6) AS runs_out_at, supply < wanted AS short FROM r""",
        "p8_found": """SELECT w.source FROM source_weight w LEFT JOIN (SELECT source, sum(n_chars) AS s FROM documents GROUP BY source) d USING (source)
                       WHERE coalesce(s, 0) * max_repeat * 10000 < target_bp * (SELECT sum(n_chars) FROM documents)""",
    }
