"""Training-data operators against brute force, round trips and held-out rows."""

import json
import random
import re
import time
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.llm import components, contamination, dedup, languages, mixture, packing, queries, residue, sampling, splitting


def bare(t):
    t = (t or "").replace("İ", "i").replace("ı", "i").casefold().replace("i̇", "i")
    return "".join(c for c in t if unicodedata.category(c)[0] in "LM" or unicodedata.category(c) == "Nd")


# 1: splits


def groups_of(rows):
    """Brute force: (example, speaker, text) -> {example: smallest of its group}."""
    parent = {e: e for e, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for e, s, t in rows:
        for k in (("s", bare(s)) if bare(s) not in ("", "unknown") else None, ("t", bare(t)) if bare(t) else None):
            if k:
                a, b = sorted((find(first.setdefault(k, e)), find(e)))
                parent[b] = a
    return {e: find(e) for e in parent}


def keys(spark, rows):
    ex = spark.createDataFrame([(e, f"c{e}", t, "x") for e, _, t in rows], "example_id long, clip_id string, reference_text string, key string")
    clips = spark.createDataFrame([(f"c{e}", s, 1) for e, s, _ in rows for _ in range(2)] + [(None, "zz", 1)], "id string, speaker string, node int")
    return components.example_keys(ex, clips)


def random_examples(n, seed, speakers=12, texts=25):
    r = random.Random(seed)
    form = lambda x: r.choice([x, x.upper(), f" {x}. ", x.replace("e", "E")])
    return [(i, r.choice([None, "", " ", "Unknown", *[form(f"sprecher {k}") for k in range(speakers)]]), r.choice([None, "!", *[form(f"text nummer {k}") for k in range(texts)]])) for i in r.sample(range(10 * n), n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_are_closed(spark, seed):
    rows = random_examples(40, seed, 30, 30)
    got = components.components(keys(spark, rows))
    assert {r.example_id: r.group_id for r in got.collect()} == groups_of(rows)
    want, own = groups_of(rows), defaultdict(set)
    for e, s, _ in rows:
        own[want[e]].add(bare(s) if bare(s) != "unknown" else "")
    cases = {(e, g) for e, g in want.items() if len(own[g]) > 1}
    assert {tuple(r) for r in components.found(got).collect()} == cases


def test_long_chain_and_star(spark):
    n = 60
    chain = [(i, i + 1) for i in range(n)]
    star = [(1000, 1000 + i) for i in range(1, 40)]
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(chain + star + [(5000, 5000)], "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[1000 + i] == 1000 for i in range(40)) and 5000 not in got


def test_deliveries_keep_their_splits(spark):
    rows = [(10, "a", "t1"), (11, "a", None), (20, "b", "t2"), (30, None, None)]
    first, store = components.assign(keys(spark, rows), shares={"train": 0.5, "test": 0.5})
    one = {r.example_id: (r.group_id, r.split, r.status) for r in first.collect()}
    assert one[10][:2] == one[11][:2] and {v[2] for v in one.values()} == {"new"} and one[20][1] != one[10][1]
    # a new row joins a, another group comes, and a bridge ties a and b, which lie apart
    more = [(5, "a", "t9"), (40, "c", "t3"), (41, None, "T3!")]
    second, store2 = components.assign(keys(spark, more), store, shares={"train": 0.5, "test": 0.5})
    two = {r.example_id: (r.group_id, r.split, r.status) for r in second.collect()}
    assert two[5] == (5, one[10][1], "kept") and two[40][:2] == two[41][:2] and two[40][2] == "new"
    third, store3 = components.assign(keys(spark, [(50, "A", "t2"), (51, "d", "t9")]), store2, shares={"train": 0.5, "test": 0.5})
    three = {r.example_id: (r.group_id, r.split, r.status) for r in third.collect()}
    assert three == {50: (5, None, "quarantine"), 51: (5, None, "quarantine")}
    before, after = ({bytes(r.key): (r.part, r.split) for r in s.keys.collect()} for s in (store2, store3))
    new = {k: v for k, v in after.items() if k not in before}
    assert before.items() <= after.items() and len(new) == 1 and list(new.values())[0][1] is None  # the parts keep their splits, the new key is held
    empty, store4 = components.assign(keys(spark, [(1, "a", "a")]).limit(0), store3)
    assert empty.count() == 0 and store4.keys.count() == store3.keys.count()
    # rows with a held key are quarantined too; those of a part alone go on as before
    fourth, store5 = components.assign(keys(spark, [(60, "d", None), (61, "a", None), (62, None, "t2"), (63, "D.", "t44")]), store4, shares={"train": 0.5, "test": 0.5})
    four = {r.example_id: (r.group_id, r.split, r.status) for r in fourth.collect()}
    assert four == {60: (5, None, "quarantine"), 63: (5, None, "quarantine"), 61: (5, one[10][1], "kept"), 62: (5, one[20][1], "kept")}
    assert {r.example_id: r.group_id for r in components.members(store5).collect()} == groups_of([*rows, *more, (50, "A", "t2"), (51, "d", "t9"), (60, "d", None), (61, "a", None), (62, None, "t2"), (63, "D.", "t44")])


def test_counts_of_splits(spark):
    rows = [(i, f"s{i // 2}", None) if i < 200 else (i, None, None) for i in range(400)]
    half = {"train": 0.5, "test": 0.5}
    out, store = components.assign(keys(spark, rows), shares=half)
    first = {r.example_id: r.split for r in out.collect()}
    assert {r.split: r.n for r in store.totals.collect()} == Counter(first.values()) and sum(Counter(first.values()).values()) == 400
    # all once more, one of them twice, and a keyless one now with a key
    out, store2 = components.assign(keys(spark, [*rows[:399], rows[0], (399, "late", None)]), store, shares=half)
    again = {r.example_id: (r.split, r.status) for r in out.collect()}
    assert {e: s for e, (s, _) in again.items()} == first and {x for _, x in again.values()} == {"kept"} and out.count() == 401
    assert {r.split: r.n for r in store2.totals.collect()} == Counter(first.values())
    out, store3 = components.assign(keys(spark, [(500, "late", None), (501, "s1", "tie"), (502, None, "tie"), (0, "s7", None)]), store2, shares=half)
    got = {r.example_id: (r.group_id, r.split, r.status) for r in out.collect()}
    assert got[500] == (399, first[399], "kept") and got[501] == got[502] == (2, first[2], "kept")
    assert got[0] == (0, first[0], "kept") if first[0] == first[14] else got[0] == (0, None, "quarantine")  # 0 came as s0 before
    want = Counter(first.values())
    want.update([first[399], first[2], first[2]])
    assert {r.split: r.n for r in store3.totals.collect()} == want and store3.members.select("example_id").distinct().count() == 403


@pytest.mark.parametrize("seed", [4])
def test_table_on_disk_over_deliveries(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = random_examples(90, seed, 40, 40)
    path, all_, splits = f"file:{tmp_path}/table", [], {}
    assert components.stored(spark, path) is None
    for part in (rows[:30], rows[30:60] + r.sample(rows[:30], 10), rows[60:] + r.sample(rows[:60], 10)):
        got = components.deliver(keys(spark, part), path).collect()
        all_ += [x for x in part if x not in all_]
        want = groups_of(all_)
        assert {x.example_id: x.group_id for x in got} == {e: want[e] for e, _, _ in part}
        for x in got:  # what has a split keeps it, or is quarantined by a later tie
            assert x.split is None or splits.setdefault(x.example_id, x.split) == x.split
        own = defaultdict(set)
        for e, speaker, text in all_:
            for k in (("s", bare(speaker)) if bare(speaker) != "unknown" else None, ("t", bare(text))):
                if k and k[1] and e in splits:
                    own[k].add(splits[e])
        assert all(len(x) == 1 for x in own.values())
    state = components.stored(spark, path)
    assert {x.example_id: x.group_id for x in components.members(state).collect()} == groups_of(all_)
    assert {x.split: x.n for x in state.totals.collect()} == Counter(splits.values())


def test_shares_are_met(spark):
    rows = random_examples(600, 3, 400, 400)
    out, _ = components.assign(keys(spark, rows))
    got = out.collect()
    assert len(got) == 600 and all(len({r.split for r in got if r.group_id == g}) == 1 for g in {r.group_id for r in got})
    share = Counter(r.split for r in got)
    biggest = max(Counter(r.group_id for r in got).values())
    assert abs(share["train"] - 480) <= biggest and abs(share["test"] - 60) <= biggest
    assert sum(r.n_rows for r in components.reached(out).collect()) == 600
    assert components.assign(keys(spark, rows).limit(0))[0].count() == 0


# 2: languages

SENTENCES = {
    "en": "the old reader waits near the bridge while nobody speaks. this is what we would have thought about the weather",
    "de": "der alte leser wartet an der brücke während niemand spricht. das ist was wir über das wetter gedacht hätten",
    "fr": "le vieux lecteur attend près du pont pendant que personne ne parle. c'est ce que nous aurions pensé du temps",
    "ja": "年老いた読み手は橋のそばで待っているが、だれも話さない。これは天気について考えたことです",
}


@pytest.fixture(scope="module")
def model():
    return languages.Model.train([(k, v) for k, v in SENTENCES.items()] * 3)


def test_passages(model):
    langs = lambda t: [p[2] for p in languages.passages(model, t)]
    de, en, ja = (SENTENCES[k].split(".")[0].split("。")[0] for k in ("de", "en", "ja"))
    assert langs(f"{de}. {en}.") == ["de", "en"] and langs(f"{de}, {en}.") == ["de", "en"] and langs(f"{en}. ({de}.) {en}.") == ["en", "de", "en"]
    assert langs(f"{ja}。{de}") == ["ja", "de"] and langs(f"{de}. Bridge. {de}") == ["de"] and langs(f"<nar_control emotion=joy> {de}") == ["de"]
    for t in (None, "", " ", "12, 5!", "…"):
        assert [p[2:] for p in languages.passages(model, t)] == [("und", 0.0)]
    t = f"{de}. {en}." * 50
    parts = languages.passages(model, t)
    assert parts[0][0] == 0 and parts[-1][1] == len(t) and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(parts, parts[1:])) and all(0 < p[3] <= 1 for p in parts)


def test_em_finds_proportions():
    likely = np.log(np.array([[0.9, 0.1]] * 6 + [[0.1, 0.9]] * 2))
    pi, total, post = languages.proportions(likely, 200)
    grid = max((np.log((np.exp(likely) * [p, 1 - p]).sum(1)).sum(), p) for p in np.linspace(0.001, 0.999, 999))
    assert pi[0] == pytest.approx(grid[1], abs=0.02) and total == pytest.approx(grid[0], abs=1e-2) and post.shape == likely.shape


def test_held_out_languages(spark, sf):
    import pyarrow.dataset as ds

    from voxloom.functions.forms import language_of_label

    m = languages.train(spark.read.parquet(f"{sf}/documents.parquet"), rows=10)
    rows = ds.dataset(f"{sf}/eval_item.parquet").to_table().to_pylist()
    right = [languages.passages(m, r["text"])[0][2] == language_of_label(r["lang"]) for r in rows]
    assert np.mean(right) > 0.97
    none = languages.train(spark.createDataFrame([(1, "x", "zz")], "doc_id int, text string, lang string"))
    assert [p[2:] for p in languages.passages(none, "some text")] == [("und", 0.0)]


def test_other_languages_are_unknown(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # 60 documents a language
    noisy = spark.read.parquet(f"{sf}/grpo_example.parquet").select(F.col("example_id").alias("doc_id"), F.col("target_text").alias("text"), F.col("language").alias("lang"))
    m = languages.train(spark.read.parquet(f"{sf}/documents.parquet"), noisy=noisy)
    known = {
        "en": "This morning I went to the market and bought many fresh vegetables for dinner tonight.", "de": "Heute Morgen bin ich zum Markt gegangen und habe viel frisches Gemüse für das Abendessen gekauft.",
        "fr": "Ce matin je suis allé au marché et j'ai acheté beaucoup de légumes frais pour le dîner.", "es": "Esta mañana fui al mercado y compré muchas verduras frescas para la cena de esta noche.",
        "pt": "Esta manhã fui ao mercado e comprei muitos legumes frescos para o jantar desta noite.", "nl": "Vanochtend ging ik naar de markt en kocht veel verse groenten voor het avondeten.",
        "tr": "Bu sabah pazara gittim ve akşam yemeği için çok taze sebze aldım.", "ru": "Сегодня утром я пошёл на рынок и купил много свежих овощей на ужин.", "ja": "今朝、私は市場に行って、夕食のためにたくさんの新鮮な野菜を買いました。",
    }
    other = [
        "Questa mattina sono andato al mercato e ho comprato molte verdure fresche per la cena di stasera.", "Dzisiaj rano poszedłem na targ i kupiłem dużo świeżych warzyw na dzisiejszą kolację.", "I morges gik jeg på markedet og købte mange friske grøntsager til aftensmaden i aften.",
        "I morse gick jag till marknaden och köpte många färska grönsaker till kvällens middag.", "今天早上我去市场买了很多新鲜蔬菜准备晚饭。", "Σήμερα το πρωί πήγα στην αγορά και αγόρασα πολλά φρέσκα λαχανικά.", "Tänä aamuna kävin torilla ja ostin paljon tuoreita vihanneksia illalliseksi.",
        "Ma reggel elmentem a piacra és sok friss zöldséget vettem vacsorára.", "Dnes ráno jsem šel na trh a koupil jsem hodně čerstvé zeleniny k večeři.", "Astăzi dimineață am mers la piață și am cumpărat multe legume proaspete pentru cină.", "오늘 아침에 시장에 가서 저녁에 먹을 신선한 채소를 많이 샀어요.",
        "ذهبت هذا الصباح إلى السوق واشتريت الكثير من الخضروات الطازجة.", "Сьогодні вранці я пішов на ринок і купив багато свіжих овочів на вечерю.", "Тази сутрин отидох на пазара и купих много пресни зеленчуци за вечеря.", "Tadi pagi saya pergi ke pasar dan membeli banyak sayuran segar untuk makan malam.",
        "Sáng nay tôi đi chợ và mua rất nhiều rau tươi cho bữa tối.", "הבוקר הלכתי לשוק וקניתי הרבה ירקות טריים.", "आज सुबह मैं बाज़ार गया और बहुत सारी ताज़ी सब्ज़ियाँ खरीदीं।", "เช้านี้ฉันไปตลาดและซื้อผักสดมากมาย", "დღეს დილით ბაზარში წავედი და ბევრი ბოსტნეული ვიყიდე.",
    ]
    unknown = [languages.passages(m, t)[0][2] == "und" for t in other]
    assert [languages.passages(m, t)[0][2] for t in known.values()] == list(known) and np.mean(unknown) >= 0.9
    mixed = languages.passages(m, f"{known['en']} {other[0]} {known['de']}")
    assert [p[2] for p in mixed] == ["en", "und", "de"] and all(0 < p[3] <= 1 for p in mixed)


def test_length_of_a_text_is_no_switch(model):
    for k, t in SENTENCES.items():
        words = t.split()[:3] if k != "ja" else [t[:9]]
        short = " ".join(words)
        assert languages.passages(model, short)[0][2] == languages.passages(model, short + " " * 60)[0][2] == k


def test_segments_table(spark, model):
    df = spark.createDataFrame([(1, SENTENCES["de"], "de"), (2, SENTENCES["de"], "English"), (3, None, None), (1, SENTENCES["de"], "de_AT")], "example_id int, target_text string, language string").withColumn("seg_no", F.lit("clash"))
    segs = languages.segments(df, model)
    assert segs.count() == 4 and sorted(tuple(r) for r in languages.found(segs).collect()) == [(2, 1, "de"), (3, 1, "und")]
    assert languages.segments(df.limit(0), model).count() == 0


# 3: sample


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 4), st.integers(0, 30)), min_size=1, max_size=6), st.integers(0, 60))
def test_seats_are_those_of_the_divisor_method(cells, size):
    made = [{"cell_no": i, "target": t, "floor": f, "rows": n, "sample": size} for i, (t, f, n) in enumerate(cells)]
    got = {k: v[0] for k, v in sampling.seats(made).items()}
    want = {c["cell_no"]: min(c["floor"], c["rows"]) for c in made}
    queue = sorted(((r - 0.5) / c["target"], c["cell_no"]) for c in made if c["target"] for r in range(want[c["cell_no"]] + 1, c["rows"] + 1))
    for _, k in queue[: max(0, size - sum(want.values()))]:
        want[k] += 1
    assert got == want


def test_sample_and_report(spark):
    rows = [(i, ["joy", " JOY", "fear", None, ""][i % 5], "neutral", ["de_AT", "English", "und", None][i % 4]) for i in range(200)]
    ex = spark.createDataFrame(rows, "example_id long, emotion string, delivery string, language string").withColumn("kind", F.lit(1))
    t = spark.createDataFrame([(1, 1, "joy", None, None, 5000, 3, 25), (1, 2, "fear", None, None, 5000, 50, 25), (2, 1, None, None, "de", 2000, 0, 10), (2, 2, "joy", None, None, 8000, 0, 10), (3, 1, "anger", None, None, 10000, 1, 10)], "plan_no int, cell_no int, emotion string, delivery string, language string, target_bp int, min_rows int, sample_pct int")
    out, report = sampling.sample(ex, t)
    rep = {(r.plan_no, r.cell_no): r for r in report.collect()}
    n = Counter((r.plan_no, r.cell_no) for r in out.collect())
    assert rep[1, 1].n_rows == 80 and rep[1, 2].n_rows == 40 and n[1, 2] == 40 and n[1, 1] == 10 and rep[1, 2].reason == "below_floor"
    assert n[2, 1] + n[2, 2] == 20 and rep[3, 1].reason == "few_rows,below_floor" and rep[3, 1].drawn == 0
    both = Counter(r.example_id for r in out.filter("plan_no = 2").collect())
    assert max(both.values()) == 1  # an example in two cells is drawn once
    assert {tuple(r) for r in sampling.found(report).collect()} == {(1, 2), (3, 1)}
    none, rep0 = sampling.sample(ex.limit(0), t)
    assert none.count() == 0 and rep0.count() == 5
    assert sampling.sample(ex, t.limit(0))[1].count() == 0
    again = {tuple(r) for r in sampling.sample(ex.repartition(7), t)[0].collect()}
    assert again == {tuple(r) for r in out.collect()}


# 4: containers


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=12))
def test_plan_packs_every_item_once(histogram):
    rules, total = packing.plan(histogram, 60)
    load, seen, large = Counter(), Counter(), Counter()
    for length, rank, count, first, each, _ in rules:
        assert rank == seen[length] and count % each == 0
        seen[length] += count
        for i in range(count):
            load[first + i // each] += length
            large[first + i // each] += 3 * length > 60
    assert seen == Counter(histogram) and len(load) == total and all(v <= 60 for v in load.values()) and all(v <= 2 for v in large.values())
    least = -(-sum(k * v for k, v in histogram.items()) // 60)
    assert total >= least
    if histogram:  # no two containers could be one
        loads = sorted(load.values())
        assert len(loads) < 2 or loads[0] + loads[1] > 60 or total == least or all(3 * k > 60 for k in histogram)


def test_pack_table(spark):
    rows = [(i, list(range(n))) for i, n in enumerate([0, 5, 40, 41, 100, 200, 201, 33, 33, 67, 67])] + [(50, None)]
    df = spark.createDataFrame(rows, "row_no long, input_ids array<int>").withColumn("slot", F.lit("x"))
    packed = packing.pack(df, capacity=100)
    got = packed.collect()
    assert {r.row_no for r in got} == {r[0] for r in rows} and [r.row_no for r in got if r.length == 0] and all((r.container is None) == (r.length == 0) for r in got)
    load = Counter()
    for r in got:
        if r.length:
            load[r.container] += r.length
    assert max(load.values()) <= 100 and sorted(r.row_no for r in packing.found(packed).collect()) == [5, 6]
    whole = defaultdict(list)
    for c in packing.containers(df, packed).collect():
        at = 0
        for row, n in zip(c.row_nos, c.lengths):
            whole[row].append(c.ids[at : at + n])
            at += n
        assert at == len(c.ids) <= 100
    assert all(sorted(sum(whole[i], [])) == ids for i, ids in rows if ids)
    info = packing.fill(packed, 100).first()
    assert info.n_ids == sum(len(x or []) for _, x in rows) and info.containers >= info.least_containers
    assert packing.pack(df.limit(0), capacity=100).count() == 0 and packing.fill(packing.pack(df.limit(0)), 100).first().containers == 0


# 5: pieces


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=" \n\t,.;!?ab1Zç猫。、<>-( #/\u0301", max_size=220), st.integers(4, 40), st.integers(0, 3))
def test_pieces_cover_the_text(text, limit, overlap):
    got = splitting.pieces(text, limit, overlap)
    assert "".join(t[s - b :] for b, s, e, _, t in got) == text
    assert all(len(t) <= limit and text[b:e] == t and s - b <= overlap for b, s, e, _, t in got)
    run = max((len(r) for r in re.findall(r"[^\s" + re.escape(",.;!?。、-(#/") + "]+", text)), default=0)
    assert any(k == "hard" for *_, k, _ in got) == (run > limit)
    tags = [m.span() for m in re.finditer(r"<[^<>\n]+>", text) if len(m[0]) <= max(1, limit - overlap)]
    assert not any(a < cut < b for _, s, e, _, _ in got for cut in (s, e) for a, b in tags)


def test_tags_are_edges_and_stay_whole():
    event = "<nar_event type=sob duration=short count=1>"
    assert splitting.spans("a" * 230 + event) == [(0, 230, "mark"), (230, 273, "end")]  # no run is above the limit
    text = "ab " * 133 + "<nar_control emotion=joy intensity=0.5>" + "cd " * 100
    assert sum("<nar_control emotion=joy intensity=0.5>" in t for *_, t in splitting.pieces(text)) >= 1
    assert not any(text.index("<") < s < text.index(">") + 1 for _, s, *_ in splitting.pieces(text))
    assert [k for *_, k in splitting.spans("a" * 259 + "<i>" + "b" * 9)][0] == "hard"  # 263 letters and signs in a row
    assert all(not t.startswith("\u0301") for *_, t in splitting.pieces("e\u0301" * 400, 101, 0))


def test_a_tree_by_headings_lists_and_markup():
    text = "# A\n" + "a b. " * 6 + "\n## A1\n" + "c d. " * 6 + "\n## A2\n" + "e f. " * 2 + "\n# B\n" + "g h. " * 2
    assert [t[:4].strip() for *_, t in splitting.pieces(text, 50, 0)] == ["# A", "## A", "## A", "# B"]  # A2 and B have no parent in common below the root
    text = "Intro\n- one\n  - under one\n\n  - more under one\n- two\n\nAfter the list."
    assert [t.strip() for *_, t in splitting.pieces(text, 48, 0)] == ["Intro\n- one\n  - under one\n\n  - more under one", "- two", "After the list."]
    text = "<doc><sec>" + "a b. " * 5 + "</sec><sec>" + "c d. " * 5 + "</sec><br></doc> tail"
    assert [t[-6:] for *_, t in splitting.pieces(text, 50, 0)] == ["</sec>", "</doc>", " tail"]


def test_long_texts_take_linear_time():
    began = time.perf_counter()
    for text in ("word <b> and more. " * 10_000, "<i>x " * 20_000 + "</i> " * 20_000, "- a\n" + "".join(" " * i + "- item\n" for i in range(600))):
        assert sum(e - s for _, s, e, _, _ in splitting.pieces(text)) == len(text)
    assert time.perf_counter() - began < 20


def test_natural_boundaries():
    text = "# Eins\nDr. Kaya kam um 3,75 Uhr. Dann ging er.\n\n- Punkt eins\n- Punkt zwei\n\nEin sehr langer Satz, der nicht passt; er geht weiter und weiter."
    got = splitting.pieces(text, 45, 0)
    assert [t.strip() for *_, t in got][:3] == ["# Eins", "Dr. Kaya kam um 3,75 Uhr. Dann ging er.", "- Punkt eins\n- Punkt zwei"]
    assert [k for *_, k, _ in got][0] == "line" and got[-1][3] == "end"
    assert [t for *_, t in splitting.pieces("Dr. Kaya kam um 3,75 Uhr. Dann ging er.", 30, 0)] == ["Dr. Kaya kam um 3,75 Uhr. ", "Dann ging er."]
    over = splitting.pieces("eins zwei drei vier fünf sechs", 14, 6)
    assert all(text2.startswith(over[i - 1][4].split()[-1][:1]) or b == s for i, (b, s, _, _, text2) in enumerate(over) if i)
    tag = splitting.pieces("ab " * 10 + "<nar_event type=sob duration=short count=1> " + "cd " * 10, 60, 0)
    assert sum("<nar_event type=sob duration=short count=1>" in t for *_, t in tag) == 1
    assert splitting.pieces(None) == [] and splitting.pieces("") == [] and len(splitting.pieces("x" * 260)) == 1 and len(splitting.pieces("x" * 100_000, 260, 0)) == 385


def test_split_table(spark):
    df = spark.createDataFrame([(1, "a" * 300), (2, "kurz"), (3, None), (4, ""), (2, "kurz"), (5, "a" * 260 + "!" + "b" * 260)], "request_id long, text string").withColumn("piece", F.lit(0))
    out = splitting.split(df)
    assert out.filter("request_id = 2").count() == 2 and out.filter("request_id in (3, 4)").count() == 0
    assert [r.request_id for r in splitting.found(out).collect()] == [1] and splitting.split(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splitting.split(df, limit=10, overlap=10)


# 6: duplicates


def test_json_forms():
    f = dedup.json_form
    assert f('{"a": 1, "b": [1.0, {"y": null, "x": "Ü"}]}') == f('{"b":[1,{"x":"\\u00dc","y":null}],"a":1e0}') != f('{"a": "1", "b": [1, {"y": null, "x": "Ü"}]}')
    assert f('{"a":1.10}') == f('{"a":1.1}') and f("0.0") == f("-0") and f(None) is None and f("{oops") == "\x01{oops" and f("") == "\x01" and f("1" * 400) == f("1" * 400)
    assert f("[1,2]") != f("[2,1]") and f("true") != f("1") and f("NaN") is not None


def test_duplicate_sets(spark):
    r = random.Random(5)
    speakers, texts = ["spk-1", "Spk 1.", "SPK1", "other", None, "!", ""], ["Straße nach Süd", "STRASSE NACH SÜD!", "strasse-nach-süd", "was anderes", None, " "]
    extras = ['{"a": 1, "b": 2}', '{"b":2,"a":1.0}', '{"a":2}', None, "", "{x"]
    rows = [(i, r.choice(texts), r.choice(speakers), r.choice(extras), "z") for i in r.sample(range(1000), 150)]
    df = spark.createDataFrame(rows, "row_no long, text string, speaker string, extra string, form string").withColumn("t_id", F.lit(1))
    own = defaultdict(list)
    for i, t, s, x, _ in rows:
        own[(bare(t), bare(s), dedup.json_form(x)) if bare(t) and bare(s) else ("alone", i)].append(i)
    want = {i: (min(g), len(g)) for g in own.values() for i in g}
    sets = dedup.duplicate_sets(df)
    assert {x.row_no: (x.keep_no, x.copies) for x in sets.collect()} == want
    assert {tuple(x) for x in dedup.found(sets).collect()} == {(k, i) for i, (k, _) in want.items() if k != i}
    kept = dedup.collapsed(df)
    assert sum(x.n_copies for x in kept.collect()) == 150 and set(df.columns) < set(kept.columns)
    assert dedup.duplicate_sets(df.limit(0)).count() == 0


def test_hot_set_of_copies(spark):
    n = 30_000  # more than a third of all rows are one set
    df = spark.range(n).select(F.col("id").alias("row_no"), F.when(F.col("id") % 2 == 0, "Same.").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit("s").alias("speaker"), F.lit(None).cast("string").alias("extra"))
    got = dedup.found(dedup.duplicate_sets(df)).agg(F.count("copy_no"), F.max("keep_no"), F.countDistinct("copy_no")).first()
    assert tuple(got) == (n // 2 - 1, 0, n // 2 - 1)


# 7: leaks


def leak_pairs(docs, items, run=60):
    tag = re.compile(r"<nar_(?:control|event)\b[^>]*>", re.I)
    parts = defaultdict(set)
    for i, t in items:
        b = bare(t)
        for k in range(len(b) - run + 1):
            parts[b[k : k + run]].add(i)
    out = set()
    for d, t in docs:
        b = bare(tag.sub("", t or ""))
        for k in range(len(b) - run + 1):
            out |= {(d, i) for i in parts.get(b[k : k + run], ())}
    return out


def test_every_common_run_is_found(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeiıİßüé猫") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(12)] + [(90, "short"), (91, None)]
    items.append((92, items[0][1]))
    docs = []
    for d in range(150):
        text = [word() for _ in range(r.randint(0, 60))]
        if d % 2:
            b = items[r.randrange(12)][1]
            n = r.randint(50, 90)
            at = r.randrange(max(1, len(b) - n))
            part = b[at : at + n]
            part = r.choice([part, part.upper(), part.replace(" ", " <nar_event type=sob> "), part.replace(" ", ", ")])
            text.insert(r.randrange(len(text) + 1), part)
        docs.append((d, " ".join(text)))
    docs += [(500, None), (501, ""), (502, "<nar_control x>"), (503, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    it = spark.createDataFrame(items, "item_id long, text string")
    want = leak_pairs(docs, items)
    out = contamination.leaks(df, it)
    assert {tuple(x) for x in contamination.found(out).collect()} == want and len(want) > 20
    assert out.filter("exact and similarity < 0.8").count() == 0
    assert contamination.leaks(df.limit(0), it).count() == 0 and contamination.leaks(df, it.limit(0)).count() == 0
    with pytest.raises(ValueError):
        contamination.leaks(df, it, run=40)


def test_item_blocks_give_the_same(spark, monkeypatch):
    items = [(i, f"item {i} " + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(6)]
    docs = [(i, t) for i, t in items]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(x) for x in contamination.found(contamination.leaks(df, it)).collect()}
    monkeypatch.setattr(contamination, "BLOCK_CHARS", 400)
    assert {tuple(x) for x in contamination.found(contamination.leaks(df, it)).collect()} == whole == {(i, i) for i in range(6)}


@pytest.mark.parametrize("radius", [1, 3])
def test_hamming_blocks_miss_none_within_the_radius(radius):
    keep = contamination.kept_characters()
    rng = random.Random(1)
    ix = contamination.ItemIndex([1], ["".join(rng.choice("abcdefgh") for _ in range(400))], keep, radius)
    base = ix.prints[::7]
    flips = np.array([sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius + 2))) for _ in base], dtype=np.uint64)
    asked = base ^ flips
    got = set(zip(*(x.tolist() for x in ix.candidates(asked))))
    want = {(i, j) for i, p in enumerate(asked.tolist()) for j, q in enumerate(ix.prints.tolist()) if (p ^ q).bit_count() <= radius}
    assert got == want


def test_simhash_counts_bits():
    rng = np.random.default_rng(2)
    grams = rng.integers(0, 2**63, 6 * 13, dtype=np.uint64)
    got = contamination.simhashes(grams)
    for w, h in enumerate(got.tolist()):
        part = grams[w * 6 : w * 6 + 48].tolist()
        assert h == sum(1 << b for b in range(64) if sum(x >> b & 1 for x in part) >= 24)
    assert len(got) == 13 - 7


# 8: mixture


def mix_tables(spark):
    docs = [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(4)] + [(2000 + i, None, 50) for i in range(2)] + [(3000, "other", 60), (3001, "a", None), (3002, "b", 0)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n int").withColumn("position", F.lit(1))
    w = spark.createDataFrame([("a", 5000, 1), ("b", 1000, 2), ("c", 4000, 3)], "source string, target_bp int, max_repeat int")
    return d, w


def test_mixture(spark):
    d, w = mix_tables(spark)
    out, report = mixture.mix(d, w, F.col("n"))
    rep = {r.source: r for r in report.collect()}
    total = 1000 + 40 + 100 + 60
    assert rep["a"].wanted == total / 2 and rep["a"].given == total / 2 and rep["b"].given == 80 and rep["c"].given == 0
    assert {r.source for r in mixture.found(report).collect()} == {"b", "c"}
    rows = out.collect()
    used = Counter(r.source for r in rows)
    assert used["b"] - sum(r.doc_id == 3002 for r in rows) == 8 and abs(10 * used["a"] - 600) <= 20 and max(Counter(r.doc_id for r in rows if r.source == "b").values()) == 2
    assert all(0 <= r.position <= 1 for r in rows) and [r.position for r in rows] == sorted(r.position for r in rows)
    with pytest.raises(ValueError):
        mixture.mix(d, w.union(w), F.col("n"))
    assert mixture.mix(d.limit(0), w, F.col("n"))[0].count() == 0 and mixture.mix(d, w.limit(0), F.col("n"))[0].count() == 0


def test_schedules_move_documents(spark):
    d, w = mix_tables(spark)
    early = mixture.mix(d, w, F.col("n"), {"a": [1, 0]})[0].filter("source = 'a'").collect()
    # weights 1 -> 0: three quarters of the demand are over by half time
    assert np.mean([r.position <= 0.5 for r in early]) == pytest.approx(0.75, abs=0.03)
    weights, areas = mixture._schedule([1, 3, 2])
    shares = [0.0, 0.1, 0.33, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(s, weights, areas) for s in shares], "s double, w array<double>, a array<double>")
    got = [r.t for r in df.select(mixture.time_of(F.col("s"), F.col("w"), F.col("a")).alias("t")).collect()]
    grid = np.linspace(0, 1, 20001)
    area = np.cumsum(np.interp(grid, [0, 0.5, 1], weights)) / 20000
    assert got == pytest.approx([float(np.interp(s, area / area[-1], grid)) for s in shares], abs=1e-3)


def test_tokens(spark):
    import tiktoken  # noqa: F401

    df = spark.createDataFrame([("hello world",), ("",), (None,), ("a\n" * 150_000,)], "t string")
    got = [r.n for r in df.select(mixture.token_count(F.col("t"), "/opt/tokenizers/byte_bpe_50k.tiktoken").alias("n")).collect()]
    assert got[0] == 2 and got[1:3] == [0, 0] and got[3] >= 150_000
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb"))}
    whole = tiktoken.Encoding("own", pat_str=mixture.SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    r = random.Random(2)
    texts = ["".join(r.choice(["a", "word", " ", "\n", "  ", "'s", "12", "!", "\n\n", "é"]) for _ in range(400)) for _ in range(40)]
    assert all(sum(len(whole(p)) for p in mixture._parts(t, 30)) == len(whole(t)) for t in texts) and any(len(list(mixture._parts(t, 30))) > 5 for t in texts)


# 9: residue

BAD = [
    "{{ speaker_name }}", "Welcome, <?= $title ?>, to today's reading.", "この章は{speaker}が読みます。", "Next on the programme: [NOM DU LECTEUR]", "[your text here]", "Bienvenido, NaN, a la lectura de hoy.", "Bu bölümü undefined okuyor.",
    "This chapter is read by [object Object].", "Lorem ipsum dolor sit amet consectetur adipiscing elit.", "dummy line. " * 6, "deneme metni", "404 Not Found – Aradığınız sayfa bulunamadı", "HTTP 504", "KeyError: 'speaker'", "    at render (player:640)",
    "Se ha producido un error en el servidor.", "Votre session a expiré.", "Too many requests, try again later.", "Please enable JavaScript to listen.", "Anna Berg | Bitte aktivieren Sie JavaScript, um diese Lesung zu hören.", "スクリプトを有効にして再読み込みしてください", "$LISTENER_NAME$さん、ようこそ。",
]
FINE = [
    "Anna explains that a mark such as {{speaker}} is swapped for the reader's name.", "{{isim}} gibi bir işaret, okuyucunun adıyla değiştirilir.", "A good template, says Jo, leaves a blank like %s only where the clerk will write.", "The ship's log says error 503 on the lamp, and Jo calls the boat.",
    "The lesson on JavaScript is read by Jo, who says that scripts must be enabled before the example runs.", "Jo laughs: the word lorem was all the old printer could remember.", "[door closes]", "(sighs)", '{"type": "laugh", "after_word": 3}', "<nar_control emotion=joy intensity=0.3> Hallo", "In the story, Jo knocks at room 404, which is not found on any map.",
    "None of the readers came.", "El actor lee la frase sin un solo error.", "{{名前}}のような印は名前に置きかえる。", "take 8 / booth a / ribbon 2 / gain -5.3 dB", "## Anna", "50% of them left at $5 each.", "", "   ",
]


@pytest.mark.parametrize("line", BAD)
def test_residue_lines(line):
    assert residue.line_kinds(line)


@pytest.mark.parametrize("line", FINE)
def test_harmless_lines(line):
    assert not residue.line_kinds(line)


def test_residue_table(spark):
    prose = "Anna walks along the river and nobody speaks. " * 40
    host = "server weirdness 12"
    rows = [(1, prose, "a"), (2, prose + "\n" + BAD[0] + "\n" + prose, "a"), (3, None, None), (4, "", "a"), (5, host, "a"), (6, host.replace("12", "99"), "b"), (7, host, None), (8, "server weirdness of another kind", "b"), (9, "x\nx\nx\nx", "a"), (2, prose, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shape", F.lit("s"))
    out = residue.detect(df)
    got = {(r.doc_id, r.residue): r for r in out.collect()}
    assert out.count() == 10 and {d for d, bad in got if bad} == {2, 5, 6, 7, 9} and got[2, True].lines == [41 - 39] and got[5, True].kinds == ["host"]
    assert {r.doc_id for r in residue.clean(df, out).collect()} == {1, 2, 3, 4, 8}
    assert residue.detect(df.limit(0)).count() == 0


# all queries


def test_queries_have_the_stated_columns(spark, sf):
    want = {"p1_found": ["example_id", "group_id"], "p2_found": ["example_id", "seg_no", "lang"], "p3_found": ["plan_no", "cell_no"], "p4_found": ["row_no"], "p5_found": ["request_id"], "p6_found": ["keep_no", "copy_no"], "p7_found": ["doc_id", "item_id"], "p8_found": ["source"], "p9_found": ["doc_id"]}
    own = queries.queries()
    for name, columns in want.items():
        df = own[name](spark, sf)
        assert df.columns == columns and df.count() >= 0
    assert set(queries.oracle_sql()) <= set(own)
    assert json.dumps(sorted(want))
