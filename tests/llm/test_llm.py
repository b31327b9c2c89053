import random
from collections import Counter, defaultdict

import pytest
from helpers import C, rows

from pyspark.sql import functions as F

from seriesmill.llm import epoch_sample, mixture, packing, quota_sample, sentences

COUNTS = "g string, c string, n bigint"
TARGETS = "g string, c string, target_permille int, min_count int, sample_size int"


def report(spark, counts, targets):
    r = quota_sample.quotas(spark.createDataFrame(counts, COUNTS), spark.createDataFrame(targets, TARGETS), ["g"], ["c"])
    return {x.c: (x.required, x.available, x.quota, x.short) for x in r.collect()}


def test_quotas(spark):
    exact = report(spark, [("g", "a", 900), ("g", "b", 900), ("g", "c", 900)], [("g", "a", 333, 0, 100), ("g", "b", 333, 0, 100), ("g", "c", 334, 0, 100)])
    assert exact == {"a": (33, 900, 33, 0), "b": (33, 900, 33, 0), "c": (33, 900, 34, 0)}
    short = report(spark, [("g", "a", 900), ("g", "b", 4)], [("g", "a", 500, 0, 100), ("g", "b", 500, 0, 100)])
    assert short == {"a": (50, 900, 96, 0), "b": (50, 4, 4, 46)}
    floors = report(spark, [("g", "a", 900), ("g", "b", 50)], [("g", "a", 990, 0, 100), ("g", "b", 10, 20, 100), ("g", "c", None, None, 100)])
    assert floors["b"][2] == 20 and floors["a"][2] == 99 and floors["c"] == (0, 0, 0, 0)
    assert report(spark, [], [("g", "a", 1000, 0, 10)]) == {"a": (10, 0, 0, 10)} and report(spark, [("g", "a", 1)], []) == {}


def by_levels(cats, size):
    """Quotas by bisection over exact fractions: cats is {c: (share, floor, available)}."""
    from fractions import Fraction as Q

    lo = {c: min(max(f, s * size // 1000), a) for c, (s, f, a) in cats.items()}
    goal = max(sum(s for s, _, _ in cats.values()) * size // 1000, sum(lo.values()))
    at = lambda x: {c: max(Q(lo[c]), min(Q(a), x * s)) if s else Q(lo[c]) for c, (s, _, a) in cats.items()}
    a, b = Q(0), Q(max([1, *(a for _, _, a in cats.values())]))
    if sum(at(b).values()) <= goal:
        return {c: int(v) for c, v in at(b).items()}
    for _ in range(60):
        m = (a + b) / 2
        a, b = (m, b) if sum(at(m).values()) <= goal else (a, m)
    inside = [c for c, (s, _, v) in cats.items() if s and lo[c] <= b * s and a * s < v and max(lo[c], min(v, a * s)) != max(lo[c], min(v, b * s))]
    fixed = {c: v for c, v in at(a).items() if c not in inside}
    left = goal - sum(int(round(v)) for v in fixed.values())
    w = sum(cats[c][0] for c in inside)
    out = {c: int(round(v)) for c, v in fixed.items()} | {c: left * cats[c][0] // w for c in inside}
    rest = sorted((c for c in inside if left * cats[c][0] % w), key=lambda c: (-(left * cats[c][0] % w), c))
    for c in rest[: goal - sum(out.values())]:
        out[c] += 1
    return out


def test_quotas_with_chained_caps(spark):
    t, n, want, r = [], [], {}, random.Random(11)
    groups = [({"A": (500, 0, 10), "B": (100, 0, 150), "C": (200, 0, 1000), "D": (200, 0, 1000)}, 1000)]
    groups += [({f"c{i}": (r.choice([0, 1, 7, 50, 200, 333]), r.choice([0, 0, 3, 40]), r.choice([0, 1, 5, 30, 90, 400])) for i in range(r.randint(1, 9))}, r.choice([1, 10, 97, 300])) for _ in range(150)]
    for g, (cats, size) in enumerate(groups):
        for c, (s, f, a) in cats.items():
            t.append((str(g), c, s, f, size))
            n.append((str(g), c, a))
        want |= {(str(g), c): q for c, q in by_levels(cats, size).items()}
    got = {(x.g, x.c): x.quota for x in quota_sample.quotas(spark.createDataFrame(n, COUNTS), spark.createDataFrame(t, TARGETS), ["g"], ["c"]).collect()}
    assert {c: q for (g, c), q in got.items() if g == "0"} == {"A": 10, "B": 150, "C": 420, "D": 420}
    assert got == want


def test_quota_sample_is_exact_and_stable(spark):
    items = spark.createDataFrame([("g", "hot" if i % 3 else "rare", f"i{i}") for i in range(3000)] + [(None, "hot", "x"), ("g", None, "y"), ("g", "hot", None)], "g string, c string, id string")
    rep = spark.createDataFrame([("g", "hot", 700), ("g", "rare", 5)], "g string, c string, quota bigint")
    one = rows(quota_sample.smallest_keys(items, rep, ["g", "c"], "id", 3), "c", "id")
    assert Counter(c for c, _ in one) == {"hot": 700, "rare": 5}
    assert one == rows(quota_sample.smallest_keys(items.repartition(13), rep, ["g", "c"], "id", 3), "c", "id")
    assert one != rows(quota_sample.smallest_keys(items, rep, ["g", "c"], "id", 4), "c", "id")


def test_latest_labels(spark):
    s = "annotation_id bigint, image_id string, source string, chart_type string, batch_id string, annotated_at int"
    a = [(1, "0123456789ab", "generated", "line", "b1", 5), (2, "X/0123456789AB.json", "Extracted ", "Vertical Bar", "b2", 5), (3, "0123456789ab", "generated", "dot", "b3", None), (4, None, "generated", "dot", "b3", 9), (5, "0123456789ac", "??", None, "b1", 1)]
    assert rows(quota_sample.latest_labels(spark.createDataFrame(a, s)).where("source is not null"), "image_id", "batch_id", "source", "chart_type") == [("0123456789ab", "b2", "extracted", "vertical_bar")]


def test_epoch_sample_only_grows(spark):
    frame = lambda a, b: spark.createDataFrame([(f"id{i}",) for i in range(a, b)] + [(None,)], "id string")
    first = epoch_sample.extend_ledger(None, frame(0, 2000), "id", 1, 0.3)
    second = epoch_sample.extend_ledger(first, frame(1000, 6000).unionByName(frame(0, 10)), "id", 2, 0.05)
    one, two = set(rows(epoch_sample.selected(first, "id", 7), "id")), set(rows(epoch_sample.selected(second.repartition(9), "id", 7), "id"))
    assert one <= two and second.count() == 6000 and 500 < len(one) < 700 and 150 < len(two - one) < 250
    assert {r.epoch for r in second.join(first, "id", "left_semi").collect()} == {1}


def test_units_are_even(spark):
    us = [r.u for r in spark.range(4000).select(epoch_sample.unit(C("id"), 1).alias("u")).collect()]
    assert all(0 <= u < 1 for u in us) and max(abs(sorted(us)[i] - i / 4000) for i in range(4000)) < 0.04


def test_image_sample_keeps_picks(spark):
    h = [f"{i:012x}" for i in range(300)]
    refs = spark.createDataFrame([(x if i % 2 else None, f"a/{x}.jpg", i) for i, x in enumerate(h)], "image_id string, path string, t int")
    ann = spark.createDataFrame([(x.upper(), i) for i, x in enumerate(h[:200])], "image_id string, t int")
    picks = spark.createDataFrame([(1, f"D:\\x\\{h[3].upper()}.JPG", 50), (2, f"{h[3]}_x", 90), (2, h[5], 90), (2, h[250], 90), (None, "bad", 1), (2, None, 1)], "draw_no int, image_id string, t int")
    at = lambda d, c: d.withColumn(c, F.timestamp_seconds("t")).drop("t")
    args = (at(refs, "loaded_at"), at(ann, "loaded_at"), at(picks, "picked_at"))
    s = epoch_sample.image_sample(*args)
    assert rows(s.where("carried"), "image_id", "epoch") == [(h[3], 1), (h[5], 2)]
    assert set(rows(s.where("not carried"), "image_id")) <= {(x,) for x in h[:200]} and rows(s, "image_id") == rows(epoch_sample.image_sample(*(a.repartition(5) for a in args)), "image_id")
    assert epoch_sample.image_sample(*(a.where("false") for a in args)).count() == 0


def test_image_sample_stores_its_ledger(spark, tmp_path):
    h = [f"{i:012x}" for i in range(900)]
    at = lambda ids, c, t=10: spark.createDataFrame([(x, t) for x in ids], "image_id string, t int").select("image_id", F.timestamp_seconds("t").alias(c))
    draw = lambda taken: at(taken, "picked_at", 50).withColumn("draw_no", F.lit(1))
    sample = lambda ids, taken, rate: {r.image_id: (r.epoch, r.rate, r.carried) for r in epoch_sample.image_sample(at(ids, "loaded_at").withColumn("path", F.lit(None).cast("string")), at(ids, "loaded_at"), draw(taken), rate, ledger=f"{tmp_path}/ledger").collect()}
    one = sample(h[:400], h[:1], 0.5)
    assert one[h[0]] == (1, 1.0, True) and 150 < len(one) < 250 and one == sample(h[:400], h[:1], 0.05)
    late = next(x for x in h[100:400] if x not in one)
    two = sample(h[100:], [late], 0.05)
    assert {x: two[x] for x in one} == one and two[late] == (1, 1.0, True)
    new = {x: v for x, v in two.items() if x not in one and x != late}
    assert 5 < len(new) < 60 and set(new.values()) == {(2, 0.05, False)} and set(new) <= set(h[400:])
    assert sample(h[:0], [], 0.9) == two


DOCS = "doc_id bigint, text string, source string"


def docs(spark, sizes, source="s"):
    return spark.createDataFrame([(i, None if n is None else "x" * n, source) for i, n in enumerate(sizes)], DOCS)


def best_fit_decreasing(sizes, cap):
    import bisect

    gaps, n = [], 0
    for s in sorted((s % cap if s > cap else s for s in sizes if s), reverse=True):
        if s == 0:
            continue
        k = bisect.bisect_left(gaps, s)
        if k == len(gaps):
            n += 1
            bisect.insort(gaps, cap - s)
        else:
            bisect.insort(gaps, gaps.pop(k) - s)
    return n + sum(s // cap for s in sizes if s and s > cap)


@pytest.mark.parametrize("kind", ["uniform", "small", "equal", "mixed", "tiny"])
def test_packing_against_best_fit(spark, kind):
    r = random.Random(5)
    cap = 200
    sizes = {"uniform": [r.randint(1, 200) for _ in range(800)], "small": [r.randint(1, 30) for _ in range(2000)], "equal": [67] * 900, "mixed": [None, 0, 200, 201, 400, 5000] + [r.choice([7, 90, 110, 150, 260]) for _ in range(900)], "tiny": [1] * 1500}[kind]
    specs = spark.createDataFrame([("a", cap), ("b", 64)], "spec_id string, capacity_tokens int")
    got = packing.pack(docs(spark, sizes), specs).collect()
    for spec, c in (("a", cap), ("b", 64)):
        mine = [p for p in got if p.spec_id == spec]
        fill, per_doc = defaultdict(int), defaultdict(list)
        for p in mine:
            per_doc[p.doc_id].append(p)
            if p.container_id is not None:
                fill[p.container_id] += p.tok_end - p.tok_start
        assert set(per_doc) == set(range(len(sizes))) and max(fill.values()) <= c
        for d, ps in per_doc.items():
            n, ps = sizes[d] or 0, sorted(ps, key=lambda p: p.piece_no)
            assert [p.tok_start for p in ps] == [i * c for i in range(len(ps))] and ps[-1].tok_end == n and (len(ps) > 1) == (n > c)
        least = best_fit_decreasing(sizes, c)
        assert len(fill) <= least * 1.03 + 2, (len(fill), least)
    f = packing.fill_report(packing.pack(docs(spark, sizes), specs), specs).where("spec_id = 'a'").first()
    assert f.tokens == sum(s or 0 for s in sizes) and f.documents_cut == sum((s or 0) > cap for s in sizes)


def test_packing_edges(spark):
    specs = spark.createDataFrame([("a", 10)], "spec_id string, capacity_tokens int")
    assert packing.pack(docs(spark, []), specs).count() == 0 and packing.pack(docs(spark, [5]), specs.where("false")).count() == 0
    twice = docs(spark, [25, 3]).unionByName(docs(spark, [25, 3])).withColumn("capacity_tokens", F.lit("clash"))
    got = packing.pack(twice, specs).collect()
    fill = Counter()
    for p in got:
        fill[p.container_id] += p.tok_end - p.tok_start
    assert max(fill.values()) <= 10 and sum(fill.values()) == 56
    with pytest.raises(ValueError):
        packing.pack(docs(spark, [5]), spark.createDataFrame([("a", 0)], specs.schema))


MIX = "mix_id string, source string, target_permille int, max_repeats int, budget_permille int"


def test_mixing(spark):
    r = random.Random(2)
    d = spark.createDataFrame([(i, "y" * r.randint(0, 80), [" A", "a\n", "B", None][i % 4]) for i in range(800)], DOCS)
    size = defaultdict(int)
    for x in d.collect():
        size[(x.source or "?").strip().lower()] += len(x.text)
    total = sum(size.values())
    m = [("m", "a", 300, 2, 1000), ("m", "b", 600, 3, 1000), ("m", "none", 100, 5, 1000), ("n", "A ", 900, 1, 1500), ("n", "b", 0, 1, 1500), ("z", None, 10, 1, 10)]
    mix = spark.createDataFrame(m, MIX)
    rep = {(x.mix_id, x.source): x for x in mixture.mix_report(d, mix).collect()}
    for mid, s, t, most, b in m:
        x, own, goal = rep[mid, s], size.get((s or "-").strip().lower(), 0), t * b * total / 1e6
        assert x.out_of_reach == (own * most < goal) and x.goal_tokens == pytest.approx(goal)
        assert x.actual_tokens == own * most if x.out_of_reach else abs(x.actual_tokens - goal) <= 41
    sel = mixture.mixed(d, mix)
    assert rows(sel, "mix_id", "doc_id", "repeats") == rows(mixture.mixed(d.repartition(11), mix), "mix_id", "doc_id", "repeats")
    assert sel.where("mix_id = 'm' and source = 'b'").agg(F.max("repeats") - F.min("repeats")).first()[0] <= 1
    assert mixture.mixed(d.where("false"), mix).count() == 0 and mixture.mix_report(d, mix.where("false")).count() == 0


def brute_prefix(weights, sizes, part, seed=7):
    """The ids that a broken pass over one source takes."""
    import hashlib
    import math

    def key(i):
        e = math.log(-math.log((int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 1) / (2**52 + 1)))
        w = weights[i]
        rank = -1 if w == math.inf else 0 if w is not None and w > 0 else 1
        return (rank, e - math.log(w) if rank == 0 else e, i)

    before, out = 0, set()
    for i in sorted(sizes, key=key):
        if 2 * before + sizes[i] <= 2 * part:
            out.add(i)
        before += sizes[i]
    return out


@pytest.mark.parametrize("resolution", [1, 1024])
def test_mix_by_brute_force(spark, monkeypatch, resolution):
    monkeypatch.setattr(mixture, "RESOLUTION", resolution)
    r = random.Random(9)
    w = {i: r.choice([None, 0.0, -1.0, float("nan"), float("inf"), 1e-9, 0.5, 3.0, 100.0]) for i in range(400)}
    sizes = {i: r.choice([0, 0, 3, 9, 40]) for i in w}
    d = spark.createDataFrame([(i, "y" * sizes[i], "s", w[i]) for i in w], f"{DOCS}, w double")
    total = sum(sizes.values())
    parts = [0, 1, 7, 130, 331, 500, 777, 999, 1000, 1250]
    mix = spark.createDataFrame([(f"m{p}", "s", 1000, 2, p) for p in parts], MIX)
    got = defaultdict(dict)
    for x in mixture.mixed(d, mix, C("w")).collect():
        got[x.mix_id][x.doc_id] = x.repeats
    rep = {x.mix_id: x for x in mixture.mix_report(d, mix, C("w")).collect()}
    plain = {i: v if v is None or v == v else None for i, v in w.items()}
    for p in parts:
        passes, part = divmod(p * total, 1000 * total)
        taken = brute_prefix(plain, sizes, part // 1000) if part else set()
        want = {i: passes + (i in taken) for i in w if passes + (i in taken)}
        assert got[f"m{p}"] == want
        assert (rep[f"m{p}"].actual_tokens, rep[f"m{p}"].texts) == (sum(sizes[i] * n for i, n in want.items()), len(want))


def test_weights_matter(spark):
    d = spark.createDataFrame([(i, "x", "s") for i in range(4000)], DOCS)
    mix = spark.createDataFrame([("m", "s", 1000, 1, 100)], MIX)
    for heavy, least, most in ((1.0, 290, 350), (25.0, 375, 400)):
        got = mixture.mixed(d, mix, F.when(C("doc_id") < 2000, heavy).otherwise(0.25)).collect()
        assert len(got) == 400 and least < sum(x.doc_id < 2000 for x in got) <= most


TEXTS = {
    "He left at 4 p.m. on May 3. She, e.g. Dr. K. Lee, stayed... and slept. Pi is 3.14. See http://a.b/c.D?x=1. ok": ["He left at 4 p.m. on May 3.", "She, e.g. Dr. K. Lee, stayed... and slept.", "Pi is 3.14.", "See http://a.b/c.D?x=1.", "ok"],
    'He said "No. Not now." and left. She read “Go home.” Then rain! (See p. 3.) End': ['He said "No. Not now." and left.', "She read “Go home.”", "Then rain!", "(See p. 3.)", "End"],
    "Made in the U.S. It sold. The U.S. series ran. A, B, etc. were. C etc. (D.) 1999 was it.": ["Made in the U.S.", "It sold.", "The U.S. series ran.", "A, B, etc. were.", "C etc.", "(D.)", "1999 was it."],
    "One\ntwo. Three\n\nHead\n\n1. e.g. first\n2. second\n\n• a\n• b\n\nEnd.Next one": ["One\ntwo.", "Three", "Head", "1. e.g. first", "2. second", "• a", "• b", "End.", "Next one"],
    "Am 6. Mai kam er. Im 4. Quartal fiel z. B. Nr. 3, „Was? Nie.“, rief sie. Ende": ["Am 6. Mai kam er.", "Im 4. Quartal fiel z. B. Nr. 3, „Was? Nie.“, rief sie.", "Ende"],
    "«\xa0Quoi\xa0?\xa0» dit-il. Bon\xa0! ¿Qué? ¡No!": ["«\xa0Quoi\xa0?\xa0» dit-il.", "Bon\xa0!", "¿Qué?", "¡No!"],
    "「行くの？」と言った。次です！『終。』だけ。3.5も……。": ["「行くの？」と言った。", "次です！", "『終。』だけ。", "3.5も……。"],
    "图写着“合计。”为什么？！他写：“缺。重画。”但没有。1、2……3，断了……好": ["图写着“合计。”", "为什么？！", "他写：“缺。重画。”但没有。", "1、2……3，断了……", "好"],
    "Πού είναι; Εδώ· ναι. Το 2009; κ.λπ. Τέλος": ["Πού είναι;", "Εδώ· ναι.", "Το 2009;", "κ.λπ.", "Τέλος"],
    "यह है। वह है | क्या? हाँ ।": ["यह है।", "वह है |", "क्या?", "हाँ ।"],
    "هل هذا؟ نعم؛ لا. د. B. قال.": ["هل هذا؟", "نعم؛ لا.", "د. B. قال."],
    "이것은 책이다. \"누구?\"라고 했다. 3.5개": ["이것은 책이다.", "\"누구?\"라고 했다.", "3.5개"],
    "ค่าอยู่ที่ 14.90 หน่วย รูปที่ 3 ไม่มี ป้ายต่าง ๆ อ่านไม่ออก": ["ค่าอยู่ที่ 14.90 หน่วย", "รูปที่ 3 ไม่มี", "ป้ายต่าง ๆ อ่านไม่ออก"],
    "The answer was no. We moved on. Close the tab. Open the file.": ["The answer was no.", "We moved on.", "Close the tab.", "Open the file."],
    "Dijo que no. Luego miramos la tabla. Despues nada.": ["Dijo que no.", "Luego miramos la tabla.", "Despues nada."],
    "He picked option M. Then he left. Mr. M. Then was late.": ["He picked option M.", "Then he left.", "Mr. M.", "Then was late."],
    "We climbed Mt. Everest once. Sgt. Smith of the U.S. Army came. It is in the U.S. Scores fell.": ["We climbed Mt. Everest once.", "Sgt. Smith of the U.S. Army came.", "It is in the U.S.", "Scores fell."],
    "Exmo. Sr. Costa chegou. Veja cfr. fig. 2 e o sig. Rossi. Depois. La sig. Bianchi no. Ecco.": ["Exmo. Sr. Costa chegou.", "Veja cfr. fig. 2 e o sig. Rossi.", "Depois.", "La sig. Bianchi no.", "Ecco."],
    f"See http://a.b/{'x' * 400}/report.Html now. Next.": [f"See http://a.b/{'x' * 400}/report.Html now.", "Next."],
    f"Items\n{' ' * 12}3. item one\n{' ' * 12}100. item two\n1000. item three": ["Items", "3. item one", "100. item two", "1000. item three"],
    "100. first\n101. second. In the year\n1973. Then it rose.": ["100. first", "101. second.", "In the year\n1973.", "Then it rose."],
    f"Το plot {'είναι ' * 30}25 km; Ναι. 由此。Γιατί; Ναι": [f"Το plot {'είναι ' * 30}25 km;", "Ναι.", "由此。", "Γιατί;", "Ναι"],
    "Он живёт в г. Москва. В 1966 г. Показатель вырос. Дал им. Потом ушёл. Длина 5 см. Это мало.": ["Он живёт в г. Москва.", "В 1966 г.", "Показатель вырос.", "Дал им.", "Потом ушёл.", "Длина 5 см.", "Это мало."],
    "5!!!!Next thing. op. cit. is known. it was nice. it is": ["5!!!!", "Next thing.", "op. cit. is known.", "it was nice.", "it is"],
    "「行くの？」それは違う。「はい。」と言った。": ["「行くの？」", "それは違う。", "「はい。」と言った。"],
    "“缺。”他说。然后走了。“好。”第六位读者问。“完。”图表结束。": ["“缺。”他说。", "然后走了。", "“好。”第六位读者问。", "“完。”", "图表结束。"],
    "क     | ख है।": ["क     |", "ख है।"],
    f"ก{' ' * 20}ข": ["ก", "ข"],
    "Am 100. Tag kam er. Im Jahr 1983. Januar war kalt.": ["Am 100. Tag kam er.", "Im Jahr 1983.", "Januar war kalt."],
    "No end": ["No end"],
    "😀 a😀. B \ue000c.": ["😀 a😀.", "B \ue000c."],
    "": [],
    " \n\t": [],
    None: [],
}


@pytest.mark.parametrize("text", list(TEXTS), ids=range(len(TEXTS)))
def test_sentences(spark, text):
    d = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = sorted(sentences.sentences(d, with_text=True).collect(), key=lambda r: r.sent_no)
    assert [r.sentence for r in got] == TEXTS[text]
    assert all(text[r.sent_start : r.sent_end] == r.sentence for r in got)


def test_sentences_cover_the_text(spark):
    r = random.Random(4)
    pieces = [" ", "\n", "\n\n", ".", "?", "…", "...", "“", "”", '"', "«", "»", "(", ")", "A", "b", "3", "。", "「", "」", "ไ", "क", "।", ";", "e.g", "1. ", "- ", "\ue001", "😀", "\xa0"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["a. B " * 20000, '"' + "x. " * 20000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = defaultdict(list)
    for x in sentences.sentences(d).collect():
        spans[x.doc_id].append((x.sent_start, x.sent_end))
    for i, t in enumerate(texts):
        covered, last = set(), 0
        for a, b in sorted(spans[i]):
            assert last <= a < b <= len(t) and not t[a].isspace() and not t[b - 1].isspace()
            covered |= set(range(a, b))
            last = b
        assert all(t[k].isspace() for k in range(len(t)) if k not in covered), repr(t[:80])


def test_sentence_spans_take_time_in_proportion(spark):
    import time

    def took(n):
        d = spark.createDataFrame([(1, "This is it. " * n)], "doc_id int, text string")
        best = []
        for _ in range(2):
            began = time.time()
            assert sentences.sentences(d).count() == n
            best.append(time.time() - began)
        return min(best)

    took(1000)
    assert took(64_000) < 5 * took(16_000) + 1


def test_running_sums(spark):
    r = random.Random(3)
    lists = [[r.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 3, 7, 8, 9, 1000)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, a array<int>").select("i", sentences.running_sums(C("a")).alias("s")).collect()
    assert {x.i: x.s for x in got} == {i: [sum(a[: k + 1]) for k in range(len(a))] for i, a in enumerate(lists)}


def test_sentences_of_long_runs(spark):
    n = 100_000
    runs = ["!" * n, "?!" * (n // 2), "?." * (n // 2), "。" * n]
    texts = [f"{a}{r}{b}" for r in runs for a, b in (("", ""), ("Ab", " Next one"), ("Ab", "x end"))]
    got = defaultdict(list)
    for x in sentences.sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect():
        got[x.doc_id].append((x.sent_start, x.sent_end))
    cut = lambda i: [(0, n + 2), (n + 3, n + 11)]
    for k in range(3):
        assert got[3 * k] == [(0, n)] and sorted(got[3 * k + 1]) == cut(k) and got[3 * k + 2] == [(0, n + 7)]
    assert got[9] == [(0, n)] and sorted(got[10]) == cut(3) and sorted(got[11]) == [(0, n + 2), (n + 2, n + 7)]
