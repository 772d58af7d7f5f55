"""Shares really dealt, leaks that are near, residue in long lines."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import contamination, mixture, queries, residue


def test_report_counts_the_copies_dealt(spark):
    # one document of 2,134, wanted 2,788: it is dealt once, not 1.3 times
    docs = [(1, "one", 2134)] + [(10 + i, "many", 10) for i in range(2500)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n int")
    w = spark.createDataFrame([("one", 1027, 4), ("many", 8973, 1), ("none", 0, 3)], "source string, target_bp int, max_repeat int")
    out, report = mixture.mix(d, w, F.col("n"))
    dealt = Counter()
    for r in out.collect():
        dealt[r.source] += r.size
    rep = {r.source: r for r in report.collect()}
    assert dealt["one"] == 2134 and rep["one"].wanted > 2700
    assert {s: r.given for s, r in rep.items()} == {s: dealt[s] for s in ("one", "many", "none")}
    assert all(r.reached_bp == pytest.approx(10000 * dealt[s] / sum(dealt.values())) for s, r in rep.items())


def test_mixture_queries_count_tokens(spark, sf):
    own = queries.queries()
    tokens = {r.source: r.n for r in own["p8_mixture"](spark, sf).groupBy("source").agg(F.sum("size").alias("n")).collect()}
    report = {r.source: r.given for r in own["p8_report"](spark, sf).collect()}
    assert {s: g for s, g in report.items() if g} == {s: n for s, n in tokens.items() if n}
    course = {r.source: r.n for r in own["p8_curriculum"](spark, sf).groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert course == tokens


# 7: leaks


def passage(seed, words=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvyz") for _ in range(r.randint(3, 8))) for _ in range(words))


def test_an_unclosed_tag_ends_with_its_text(spark):
    items = [(i, passage(i)) for i in range(3)]
    docs = [(10, items[0][1]), (11, passage(50) + " <nar_control emotion=joy"), (12, items[1][1]), (13, items[1][1] + " <NAR_EVENT type"), (14, "<nar_event type=sob> " + items[2][1]), (15, "x > y"), (16, items[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    it = spark.createDataFrame([*items[:2], (2, items[2][1]), (3, "<nar_control " + items[0][1])], "item_id long, text string")
    got = {tuple(r) for r in contamination.found(contamination.leaks(df, it)).collect()}
    assert got == {(10, 0), (10, 3), (12, 1), (13, 1), (14, 2), (16, 0), (16, 3)}


def test_every_near_window_is_found():
    r = random.Random(3)
    items = [(i, passage(i, 30)) for i in range(8)] + [(8, "aaaa" * 30), (9, passage(1, 12) + " " + passage(2, 12))]
    texts = []
    for i in range(60):
        part = list(items[i % 10][1])
        for at in range(r.randint(10, 50), len(part), r.choice([30, 45, 60, 80])):  # changed, missing, added characters
            part[at] = r.choice(["", "q", part[at] + "q"])
        texts.append(passage(100 + i, 5) + " " + "".join(part))
    keep = contamination.kept_characters()
    ix = contamination.ItemIndex([i for i, _ in items], [t for _, t in items], keep)
    codes = contamination.bare_codes(texts, keep)
    grams, ends, want = contamination.gram_hashes(codes), np.flatnonzero(codes == 0), {}
    for p in range(0, len(codes) - contamination.WINDOW, 6):
        t = int(np.searchsorted(ends, p))
        if p + contamination.WINDOW > ends[t]:
            continue
        a = np.repeat(grams[p : p + 48][None], len(ix.places), 0)
        sim = ix.similarity(a, ix.grams[ix.places[:, None] + np.arange(48)])
        for o, v in zip(ix.owner[sim >= 0.8].tolist(), sim[sim >= 0.8].tolist()):
            want[t, o] = max(want.get((t, o), 0), v)
    got = {(t, o): v for t, o, _, v in ix.leaks(codes)}
    assert got == pytest.approx(want) and len(want) > 40
    assert sum(v < 1 for v in want.values()) > 10


def test_large_suites_by_joins(spark):
    r = random.Random(9)
    items = [(i, passage(i % 25, 25)) for i in range(40)] + [(90, None), (91, "short"), (92, "a" * 300)]
    docs = [(i, passage(200 + i, 30) + " " + items[r.randrange(40)][1][(k := r.randrange(20)) : k + r.choice([40, 66, 75, 120])].upper() + " " + passage(300 + i, 10)) for i in range(60)] + [(99, None), (98, "a" * 90), (97, "")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    small = {tuple(x) for x in contamination.found(contamination.leaks(d, i, near=False)).collect()}
    large = {tuple(x) for x in contamination.found(contamination.leaks(d, i, near=False, block_chars=500)).collect()}
    assert small == large and len(small) > 30 and (98, 92) in small
    keep = contamination.kept_characters()
    plain = lambda t: contamination.bare_codes([t], keep)[:-1].tobytes().decode("utf-32-le")
    want = {(a, b) for a, x in docs for b, y in items if x and y and any(plain(y)[k : k + 60] in plain(x) for k in range(len(plain(y)) - 59))}
    assert small == want


def test_near_fingerprints_by_blocks(spark):
    r = random.Random(4)
    a = {r.getrandbits(64) for _ in range(60)}
    b = {x ^ sum(1 << k for k in r.sample(range(64), r.randrange(5))) for x in a}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    table_ = lambda s_: spark.createDataFrame([(signed(x),) for x in s_], "print long")
    for radius in (0, 1, 3):
        got = {tuple(x) for x in contamination.near_classes(table_(a), table_(b), radius).collect()}
        assert got == {(signed(x), signed(y)) for x in a for y in b if (x ^ y).bit_count() <= radius}


def test_edits_every_forty_characters_are_near_leaks():
    r = random.Random(11)
    items = [(i, passage(500 + i, 40)) for i in range(60)]
    keep = contamination.kept_characters()
    ix = contamination.ItemIndex([i for i, _ in items], [t for _, t in items], keep)
    texts = []
    for _, t in items:
        part = [c for c in t if c != " "]
        for at in range(r.randrange(40), len(part), 40):
            part[at] = "q" if part[at] != "q" else "z"
        texts.append(passage(900, 5) + "".join(part))
    got = {(t, o) for t, o, _, _ in ix.leaks(contamination.bare_codes(texts, keep))}
    assert sum((i, i) in got for i in range(60)) >= 54


# 9: residue

PROSE = "Anna walks along the river and nobody speaks, while the boats drift slowly past the old mill. The evening is cold and the lamps burn low. "


@pytest.mark.parametrize(("said", "kind"), [
    ("Please enable JavaScript to listen.", "script"), ("The page you requested could not be found.", "error"), ("Then undefined opened the door and smiled.", "value"), ("Se ha producido un error en el servidor.", "error"),
    ("HTTP 504", "error"), ("404 Not Found", "error"), ("We could not load this page.", "error"), ("Hello %s, here is the next chapter.", "placeholder"),
])
def test_long_lines_are_read_by_sentences(said, kind):
    assert kind in residue.line_kinds(said)
    for line in (PROSE * 2 + said, said.rstrip(".") + ". " + PROSE * 2, PROSE + said.rstrip(".") + ". " + PROSE):
        assert len(line) > 160 and residue.line_kinds(line) == {kind}


@pytest.mark.parametrize("said", ["We could not open the door.", "There was a problem with the roof.", "450 people came.", "None of them spoke.", "A mark such as undefined is only a word."])
def test_stories_in_long_lines_are_harmless(said):
    assert residue.line_kinds(PROSE * 2 + said + " " + PROSE) == set()


@pytest.mark.parametrize("line", [
    "Please enable JavaScript to continue reading this story.", "The page of this story was not found.", "No tiene acceso a esta cuenta.", "Você não tem acesso a esta conta.", "This story requires JavaScript.",
    "Para usar su cuenta, active JavaScript en el navegador.", "You do not have access to this account.", "Your session has expired. Sign in to read the lesson.", "この物語を読むにはJavaScriptを有効にしてください。", "To hear this chapter read by Anna, please enable JavaScript.",
])
def test_messages_that_name_a_story_or_account(line):
    assert residue.line_kinds(line)


@pytest.mark.parametrize("line", [
    "The page was not found, says Jo, and laughs.", "“Access denied”, says the old clerk.", "Jo explains that you should please enable JavaScript first.", "Ana cuenta que la página necesita JavaScript.", "Paul dit que le site nécessite JavaScript.",
    "The lesson on JavaScript is read by Jo, who says that scripts must be enabled before the example runs.", "Öğretmen JavaScript etkinleştirin diyor.",
])
def test_messages_that_are_told(line):
    assert not residue.line_kinds(line)
