"""Each operator on odd rows, and against brute force, an exact round trip or planted cases."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import chat, common, decontaminate, langid, licenses, linededup, mixing, pii, quality, simhash, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "alpha beta gamma delta " * 5000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else 0) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, columns whose names clash."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, LONG, "en", "b"), (None, "no id here. one two", None, "b"), (5, "same words here.", "en", None), (5, "same words here.", "en", None), (6, "123 456", "en", "a"), (7, "日本語のテキスト", "ja", "c")]
    return docs(spark, rows).withColumn("score", F.lit("x")).withColumn("size", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("kept", F.lit(3)).withColumn("base", F.lit(4)).withColumn("license", F.lit(5)).withColumn("n_hit", F.lit(6))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def mixed_rows():
    rng = random.Random(1)
    return [(k, " ".join(["w"] * rng.randint(0, 30)), "en", s) for k, s in enumerate(rng.choices(["a", "b", "c", "d", None], [60, 10, 10, 10, 10], k=400))]


def test_mix_reaches_targets(spark, odd, none):
    rows = mixed_rows()
    got = mixing.mixed_documents(docs(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own) and abs(sum(r.taken for r in own) - own[0].target) <= len(by)
    total = sum(r.size for r in got)
    assert abs(sum(own[0].target for own in by.values()) - 1.5 * total) < 1e-6 and sum(r.taken for r in got) == 3 * total // 2
    again = mixing.mixed_documents(docs(spark, rows).repartition(3), rows_a_part=10).collect()
    assert {r.doc_id: (r.taken, r.position) for r in again} == {r.doc_id: (r.taken, r.position) for r in got}
    assert mixing.mixed_documents(odd).count() == odd.count() and mixing.mixed_documents(none).count() == 0


def test_mix_against_word_by_word_queueing(spark):
    """Serve single words: the k-th of a source ends at k / weight; the budget's worth of earliest ends is what the mix takes."""
    rows = mixed_rows()
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True))
    queues = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (hashlib.md5(f"mix:{r[0]}".encode()).hexdigest(), r[0])) for s in weight}
    ends = []
    for s, q in queues.items():
        words = [r[0] for r in q for _ in r[1].split()] * 2
        ends += [((k + 1) / weight[s], str(s), k, doc) for k, doc in enumerate(words)]
    budget = 3 * (len(ends) // 2) // 2
    want = {}
    for _, _, _, doc in sorted(ends)[:budget]:
        want[doc] = want.get(doc, 0) + 1
    got = {r.doc_id: r.taken for r in mixing.mixed_documents(docs(spark, rows)).collect()}
    assert sum(got.values()) == budget and sum(abs(got[k] - want.get(k, 0)) for k in got) <= 2 * len(weight)


def test_mix_positions_are_one_order(spark):
    m = [r for r in mixing.mix(docs(spark, [(k, "w " * (k % 5 + 1), "en", "ab"[k % 2]) for k in range(50)])).collect() if r.position is not None]
    m.sort(key=lambda r: r.position)
    assert [r.virtual_finish for r in m] == sorted(r.virtual_finish for r in m)
    at, budget = 0, 225
    for r in m:
        assert r.position >= at and r.taken <= max(0, budget - r.position)
        at = r.position + r.taken
    assert sum(r.taken for r in m) == budget and all(r.taken == 0 for r in m if r.position >= budget)


def test_decontaminate(spark, odd, none):
    item = " ".join(f"w{k}" for k in range(15))
    bench = spark.createDataFrame([(10, item), (9, "short one"), (8, None), (7, "..."), (None, "null item text is here")], "item_id bigint, text string")
    rows = [(1, "x " + item.upper().replace(" ", ", ") + " y", "en", "a"), (2, " ".join(item.split()[:9]), "en", "a"), (3, "a Short-ONE b", "en", "a"), (4, None, "en", "a"), (5, " ".join(item.split()[3:13]) + " short one", "en", "a")]
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()}
    assert {k: (r.n_words, r.n_hit, r.n_items, r.contaminated) for k, r in got.items()} == {1: (17, 15, 1, True), 2: (9, 0, 0, False), 3: (4, 2, 1, True), 4: (0, 0, 0, False), 5: (12, 12, 2, True)}
    assert got[5].items_sha256 == hashlib.sha256(b"10,9").hexdigest() and got[4].items_sha256 == hashlib.sha256(b"").hexdigest()
    small = decontaminate.decontaminate(docs(spark, rows), bench, max_words=3)  # many blocks, the same result
    assert {r.doc_id: (r.n_hit, r.items_sha256) for r in small.collect()} == {k: (r.n_hit, r.items_sha256) for k, r in got.items()}
    cut = {r.doc_id: r.clean_text for r in decontaminate.decontaminate(docs(spark, rows), bench, mode="cut").collect()}
    assert cut[1] == "x  y" and cut[3] == "a  b" and cut[2] == rows[1][1]
    assert decontaminate.decontaminate(odd, bench).count() == odd.count() and decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.where("false")).where("contaminated").count() == 0


EN, DE = "the and of that with from this have not they which their would there".split(), "der und die das nicht ist ein eine mit auf sich auch dem werden".split()


def prose(ws, n, rng):
    return " ".join(rng.choice(ws) for _ in range(n)) + "."


def test_language_spans(spark, odd, none):
    rng = random.Random(2)
    train = [("en", prose(EN, 40, rng)) for _ in range(40)] + [("de", prose(DE, 40, rng)) for _ in range(40)] + [("el", "και το να της για")]
    m = langid.fit(train)
    (lang, score, spans), short, greek, other, nothing = langid.predict(m, [prose(EN, 30, rng) + " " + prose(DE, 60, rng), "nicht", "για", "日本", None])
    assert lang == "de" and 0 <= score <= 1 and [s[2] for s in spans] == ["en", "de"] and abs(spans[0][1] - 30) <= 1
    assert short[0] == "de" and greek[0] == "el" and other[0] in m.langs and nothing == ("und", 0.0, [])
    held = [("en", prose(EN, 8, rng)) for _ in range(50)] + [("de", prose(DE, 8, rng)) for _ in range(50)]
    assert [p[0] for p in langid.predict(m, [t for _, t in held])] == [a for a, _ in held]
    got = langid.detect(odd, m).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 6)} == {"und"} and langid.detect(none, m).count() == 0


def test_viterbi_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(0)
    texts = [rng.normal(0, 3, (n, 3)) for n in (1, 5, 6, 3)]
    for e, path in zip(texts, langid.viterbi(texts, 2.0), strict=True):
        cost = lambda p, e=e: sum(e[k, s] for k, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        assert abs(cost(path) - max(map(cost, product(range(3), repeat=len(e))))) < 1e-9
        best, mixed = langid._mixed(e, 2.0)
        if not mixed:
            assert abs(cost([best] * len(e)) - cost(path)) < 1e-9


def test_model_sample_is_bounded(spark):
    rows = [(k, "the and", "en", "a") for k in range(500)] + [(k, "der", "de", "a") for k in range(500, 505)]
    got = langid.sample(docs(spark, rows), per_lang=50)
    assert 20 < sum(a == "en" for a, _ in got) < 100 and sum(a == "de" for a, _ in got) == 5


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def luhn(s):
    return sum(int(c) if not k % 2 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0


def test_base_pii_against_re(spark, odd, none):
    rng = random.Random(3)
    bits = ["a@b.c", "_d@e.f.", "é", "1.2.3.4", ".5", "256.1.1.1", "4041894974608795", "4041 8949-7460 8795", "+1 (988) 555-2485", "+12", " ", "-", "@", ".", "x", "0", "\n", "+", "%"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)] + ["a@b.c " * 3000, "1" * 5000 + "." * 500, "a" * 20000 + "@b.c"]
    got = {r.doc_id: r for r in pii.find(docs(spark, [(k, t, None, None) for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        want = sorted((m.start(), n, m.end()) for n, kind in enumerate(pii.KINDS) for m in re.finditer(PII[kind][0], t) if PII[kind][1](m[0]))
        assert [tuple(x) for x in got[k].base] == want, t[:200]
    assert pii.find(odd).count() == odd.count() and pii.find(none).count() == 0


def test_bootstrap_finds_unseen(spark):
    rows = [(k, f"please mail to user{k}@mail{k}.example.com today and rest {k} words", None, None) for k in range(12)]
    rows += [(100, "please mail to user-at-home99887 today and rest", None, None), (101, "the number 99887766 stands elsewhere", None, None)]
    rows += [(200 + k, f'with token = "{hashlib.sha1(str(k).encode()).hexdigest()}" in it', None, None) for k in range(8)] + [(300, 'TOKEN = "0A1B2C3D4E5F"!!', None, None)]
    rows += [(400, f"commit {hashlib.sha1(b'x').hexdigest()} is no secret", None, None)]
    got = {r.doc_id: r for r in pii.find(docs(spark, rows)).collect()}
    start = rows[12][1].index("user-at")
    assert [tuple(x) for x in got[100].added] == [(start, 0, start + len("user-at-home99887"))] and got[101].added == []
    secret = pii.NAMES.index("secret")
    assert [tuple(x) for x in got[300].added] == [(9, secret, 21)] and all([x[1] for x in got[200 + k].added] == [secret] for k in range(8)) and got[400].added == []
    shown = spark.createDataFrame([("x a@b.c y",)], "text string").select(pii.redact(F.col("text"), pii.base_spans(F.col("text"))))
    assert shown.first()[0] == "x [EMAIL] y"


def test_bootstrap_by_brute_force(spark):
    """Two rounds over a random graph against the definition."""
    rng = random.Random(12)
    cands = [(f"i{rng.randint(0, 60)}", [f"p{rng.randint(0, 5)}", f"q{rng.randint(0, 25)}"]) for _ in range(300)]
    kind = {f"i{k}": (0 if k % 3 else 1) for k in range(40)} | {"i40": 4, "i41": 4}
    rows = [(i, ctx, kind.get(i)) for i, ctx in cands]
    edges = {(p, i) for i, ctx in cands for p in ctx}
    known, best = {i: (k, 1.0) for i, k in kind.items() if any(i == e[1] for e in edges)}, {}
    seeds = dict(known)
    for _ in range(2):
        conf = {}
        for p in {p for p, _ in edges}:
            own = [i for q, i in edges if q == p]
            told = [i for i in own if i in known]
            for k in (0, 1, 4):
                mine = [i for i in told if known[i][0] == k]
                s = sum(known[i][1] for i in mine)
                if len(mine) >= 3 and s / (s + len(told) - len(mine) + (len(own) - len(told)) / 2 + 1) >= 0.4:
                    conf[p, k] = s / (s + len(told) - len(mine) + (len(own) - len(told)) / 2 + 1)
        best = {}
        for i in {i for _, i in edges if i not in seeds or seeds[i][0] >= 4}:
            odds = {}
            for p, k in conf:
                if (p, i) in edges and (i not in seeds or seeds[i][0] == k):
                    odds[k] = odds.get(k, 1.0) * (1 - conf[p, k])
            if odds:
                score, k = max((1 - v, -k) for k, v in odds.items())
                if score >= 0.4:
                    best[i] = (-k, score)
        known = seeds | {i: v for i, v in best.items() if i not in seeds}
    got, _ = pii.bootstrap(spark.createDataFrame(rows, "inst string, ctx array<string>, seed int"), rounds=2, min_seeds=3, min_confidence=0.4)
    got = {r.inst: (r.kind, r.score) for r in got.collect()}
    assert got.keys() == best.keys() and len(got) > 5 and all(got[i][0] == best[i][0] and abs(got[i][1] - best[i][1]) < 1e-9 for i in got)


def test_running_starts(spark):
    a = [random.Random(5).randint(0, 9) for _ in range(1000)]
    got = spark.createDataFrame([(a,), ([],)], "a array<bigint>").select(common.running_starts(F.col("a"))).collect()
    assert got[0][0] == [sum(a[:k]) for k in range(1000)] and got[1][0] == []


def test_fingerprint_by_definition():
    import xxhash

    def plain(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        if not ws:
            return 0
        sh = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or [" ".join(ws)]
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    for t in ("", " \n", "One", "one TWO", "a b c", "É b c d e f g a b c", "x " * 100):
        assert simhash.fingerprint(t.encode()) == plain(t)


@pytest.mark.parametrize("small", [1, 64])
def test_near_edges_against_brute_force(spark, small):
    rng = random.Random(6)
    fps = [0, 1, 3, 7, 2**63]
    for _ in range(40):
        f = rng.getrandbits(64)
        fps += [f] + [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(6)]
    fps = sorted(set(fps))
    d = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp bigint")
    comp = {r.node: r.component for r in common.components(simhash.near_edges(d, 2, small)).collect()}
    parent = list(range(len(fps)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in range(len(fps)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= 2:
                parent[find(x)] = find(y)
    want = {}
    for k, f in enumerate(fps):
        want.setdefault(find(k), set()).add(simhash._signed(f))
    got = {}
    for f in fps:
        s = simhash._signed(f)
        got.setdefault(comp.get(s, s), set()).add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_components_of_odd_rows(spark, odd, none):
    got = simhash.near_components(odd).collect()
    by = {r.doc_id: r.component_id for r in got}
    assert len(got) == odd.count() and by[1] == by[2] == by[3] == 1 and by[5] == 5 and simhash.near_components(none).count() == 0
    kept = simhash.one_per_group(odd.select("doc_id", "text"))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 4, 5, 6, 7]


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    comp = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {comp[k] for k in range(1, 31)} == {0} and {comp[k] for k in range(101, 160)} == {100}


def test_components_of_few_edges_shuffle_once(spark, monkeypatch):
    """Few edges take a few tasks a round, whatever the number of shuffle partitions; many, by shuffles, have the same components."""
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 540)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    launched = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalTasks()
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        before = launched()
        few = {r.node: r.component for r in common.components(edges).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        took = launched() - before
        assert took < 800, took
        monkeypatch.setattr(common, "ALONE", 0)
        assert {r.node: r.component for r in common.components(edges).collect()} == few
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(few) > 250 and {few[k] for k in range(501, 541)} == {500}


def test_verified_pairs_of_lines_with_repeated_runs(spark):
    """The similarity is that of the sets, however often a line repeats a run."""
    rng = random.Random(6)
    texts = []
    for k in range(40):
        own = "".join(rng.choice("abcdefgh ") for _ in range(120))
        t = own[: 40 + k] + "".join(rng.choice("abcdefgh ") for _ in range(k)) + own[40 + k :]
        texts += [own + "x" * (20 + 10 * k), t + "x" * 400]
    known = spark.createDataFrame([(k, t, *[0] * linededup.BANDS) for k, t in enumerate(texts)], "line_id bigint, line string, " + ", ".join(f"k{b} bigint" for b in range(linededup.BANDS)))
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1, 0) for k in range(40)], "a bigint, b bigint, least int")
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in texts]
    want = {2 * k for k in range(40) if len(sets[2 * k] & sets[2 * k + 1]) >= 0.8 * len(sets[2 * k] | sets[2 * k + 1])}
    assert {r.a for r in linededup.verified(pairs, known, 0.8).collect()} == want and 10 < len(want) < 40


def test_line_dedup(spark, odd, none):
    base = "It was a bright cold day in April, and the clocks were striking thirteen all over the town again."
    near = base.replace("bright", "brigth")
    far = "Something else entirely stands in this line, which nobody has ever written before or since."
    rows = [(1, f"{base}\n{far}", "en", "a"), (2, f"\n{near}\nown line two", "en", "a"), (3, f"{far}\n{far}\nown line three", "en", "a"), (4, base, "en", "a")]
    got = {r.doc_id: r for r in linededup.line_report(docs(spark, rows)).collect()}
    assert {k: (r.n_lines, r.dropped) for k, r in got.items()} == {1: (2, []), 2: (2, [1]), 3: (3, [0, 1]), 4: (1, [0])}
    out = {r.doc_id: (r.text, r.n_chars) for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert out == {1: (rows[0][1], len(rows[0][1])), 2: ("\nown line two", 13), 3: ("own line three", 14)}
    assert linededup.line_report(odd).count() == odd.count() and linededup.line_report(none).count() == 0


def test_line_recall(spark):
    rng = random.Random(8)
    rows, want = [], 0
    for k in range(120):
        ws = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(40)]
        rows.append((2 * k, " ".join(ws), "en", "a"))
        ws[rng.randrange(40)] = "zzzz"
        rows.append((2 * k + 1, " ".join(ws), "en", "a"))
        want += 1
    got = linededup.line_report(docs(spark, rows)).collect()
    assert sum(r.n_dropped for r in got) >= 0.95 * want and all(r.n_dropped == 0 for r in got if r.doc_id % 2 == 0)


def test_line_recall_of_one_long_token(spark):
    """Lines without a blank that differ near the start only, exact Jaccard 0.92."""
    rng = random.Random(11)
    rows = []
    for k in range(60):
        t = "".join(rng.choice("abcdefgh0123/") for _ in range(100))
        rows += [(2 * k, t, "en", "a"), (2 * k + 1, t[:3] + "Z" + t[4:], "en", "a")]
    got = {r.doc_id: r.n_dropped for r in linededup.line_report(docs(spark, rows)).collect()}
    assert sum(got.values()) >= 57 and all(got[2 * k] == 0 for k in range(60))


def test_line_dedup_in_hot_buckets(spark):
    """Families of a common template: buckets whose first line is unlike most of their other lines."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    head = word(160)
    rows = []
    for k in range(150):
        t = head + word(24)
        rows += [(2 * k, t, "en", "a"), (2 * k + 1, t[:-1] + "Z", "en", "a")]
    lines = linededup.lines(docs(spark, rows))
    shared = linededup.meetings(linededup.signatures(lines)).cache()
    assert shared.agg(F.max("members")).first()[0] > linededup.PAIRED
    got = {r.doc_id: r.n_dropped for r in linededup.line_report(docs(spark, rows)).collect()}
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for _, t, _, _ in rows]
    jac = lambda a, b: len(a & b) / len(a | b)
    assert max(jac(sets[0], sets[2 * k]) for k in range(1, 150)) < 0.8 < min(jac(sets[2 * k], sets[2 * k + 1]) for k in range(150))
    assert all(got[2 * k] == 0 and got[2 * k + 1] == 1 for k in range(150))


def runs(t):
    return {t[i : i + 8] for i in range(max(1, len(t) - 7))}


def families(rng, n, total, free, changed):
    """Lines of one template, n of them in pairs: ``free`` of its ``total`` words are a pair's own, ``changed`` words differ within a pair."""
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(2000)]
    base = [rng.choice(words) for _ in range(total)]
    out = []
    for _ in range(n // 2):
        t = base[: total - free] + [rng.choice(words) for _ in range(free)]
        u = list(t)
        for _ in range(changed):
            u[rng.randrange(total)] = rng.choice(words)
        out += [" ".join(t), " ".join(u)]
    return list(dict.fromkeys(out))


@pytest.mark.parametrize(("free", "changed"), [(6, 1), (6, 2), (30, 2)])
def test_template_families_by_brute_force(spark, free, changed):
    """Against exact Jaccard of all pairs: what one line per component would drop."""
    texts = families(random.Random(free + changed), 500, 40, free, changed)
    sets = [runs(t) for t in texts]
    parent = list(range(len(texts)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both >= 0.8 * (len(sets[x]) + len(sets[y]) - both):
                parent[find(x)] = find(y)
    want = len(texts) - len({find(k) for k in range(len(texts))})
    got = linededup.line_report(docs(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect()
    assert want > 100 and 0.95 * want <= sum(r.n_dropped for r in got) <= want


def test_hot_buckets_lose_no_link(spark):
    """Variants of one line, in buckets of far over 16 lines: as many lines go as by exact Jaccard of all pairs."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(2000)]
    base = [rng.choice(words) for _ in range(30)]
    texts = []
    for _ in range(600):
        t = list(base)
        for _ in range(2):
            t[rng.randrange(30)] = rng.choice(words)
        texts.append(" ".join(t))
    texts = list(dict.fromkeys(texts))
    sets, parent = [runs(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 1.8 >= 0.8 * (len(sets[a]) + len(sets[b])) - 1e-9:
                parent[find(a)] = find(b)
    want = len(texts) - len({find(a) for a in range(len(texts))})
    got = linededup.line_report(docs(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect()
    assert want > 100 and sum(r.n_dropped for r in got) == want


def test_hot_buckets_shuffle_no_shingle_sets(spark):
    """Long lines of one family, at the threshold and around it: as many go as by exact Jaccard of all pairs, and of their shingles only the first are shuffled."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    base, texts = [rng.choice(words) for _ in range(150)], []
    for k in range(300):
        t = list(base)
        for _ in range(4 + k % 12):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    sets, parent = [runs(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) * 1.8 >= 0.8 * (len(sets[a]) + len(sets[b])) - 1e-9:
                parent[find(a)] = find(b)
    want = len(texts) - len({find(a) for a in range(len(texts))})
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    got = linededup.line_report(docs(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    took = (written() - before) / sum(map(len, sets))
    assert want > 50 and sum(r.n_dropped for r in got) == want
    assert took < 20, took  # bytes a shingle


def test_lines_of_repeated_and_odd_ids(spark):
    """Rows are known by id and text, whatever the id: nothing else of a row goes, and exact copies of a row do."""
    want = {"dup line here\nunique alpha text", "precious content\nother text line"}
    for kind, one in (("bigint", 7), ("bigint", None), ("string", "x-7"), ("double", 0.5)):
        rows = [(one, t, "n", 1) for t in ["dup line here\nunique alpha text", "precious content\nother text line", "dup line here"]] + [(one, "precious content\nother text line", "n", 1)] * 3
        d = spark.createDataFrame(rows, f"doc_id {kind}, text string, dropped string, r1 int")
        out = linededup.dedup_lines(d)
        assert out.columns == d.columns and "\n".join(sorted(r.text for r in out.collect())).count("dup line here") == 1
        got = sorted(line for r in out.collect() for line in r.text.split("\n"))
        assert got == sorted(line for t in want for line in t.split("\n")), (kind, one)
        report = linededup.line_report(d).collect()
        assert len(report) == 6 and sum(r.n_lines - r.n_dropped for r in report) == 4


def test_dedup_lines_of_odd_rows(spark, odd, none):
    """Null and blank texts stay, an exact copy of a row goes, names that clash don't matter, an empty table has no rows."""
    d = odd.withColumn("dropped", F.lit("x")).withColumn("_d", F.lit(1)).withColumn("line_id", F.lit(2)).withColumn("new", F.lit(3)).withColumn("has", F.lit(4)).withColumn("c0", F.lit(5))
    out = linededup.dedup_lines(d)
    assert out.schema == d.schema
    rows = out.collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 2, 3, 4, 5, 6, 7] and all(r.dropped == "x" and r.c0 == 5 for r in rows)
    assert linededup.dedup_lines(none).count() == 0


def test_licenses(spark, odd, none):
    mit = "Copyright (c) 2020 Somebody\n\n" + licenses.TEXTS["MIT"].upper().replace(",", " ;")
    rows = [(1, mit, None, None), (2, "Prose.\nReleased under the MIT Licence!\nlicensed under CC BY-NC 4.0.", None, None), (3, "Prose about licensing, MIT included.", None, None), (4, "This work is licensed under the GNU General Public License, version 3.", None, None)]
    got = {r.doc_id: (r.license, r.notices) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {1: ("MIT", []), 2: (None, ["CC-BY-NC-4.0", "MIT"]), 3: (None, []), 4: ("GPL-3.0", ["GPL-3.0"])}
    more = spark.createDataFrame([("X", "my own terms")], "license string, text string")
    assert licenses.scan(docs(spark, [(1, "My own; TERMS", None, None)]), more).first().license == "X"
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


def test_licenses_by_brute_force(spark):
    """Every known text and notice, disturbed as the method allows, against the same normalisation in Python; and near misses."""
    rng = random.Random(13)

    def plain(t):
        t = t.lower()
        if re.search(r"\(c\)|©|copyright", t):
            t = re.sub(r"(?m)^[^\w\n]*(?:copyright\b|©|\(c\))(?![^\n]*\bnotice\b)[^\n]*$|\ball rights reserved\b\.?", "", t)
        for a, b in licenses.SPELLINGS:
            t = t.replace(a, b)
        return " ".join(re.findall(r"[^\W_]+", t))

    known = {}
    for own in (licenses.TEXTS, licenses.HEADERS):
        for name, text in own.items():
            known.setdefault(plain(text), name)
    for name, names in licenses.NAMES.items():
        for text in (n.format(x) for x in names for n in licenses.NOTICES):
            known[plain(text)] = min(name, known.get(plain(text), name))
    cases = []
    for text in [*licenses.TEXTS.values(), *licenses.HEADERS.values(), "Released under the MIT License", "SPDX-License-Identifier: Zlib"]:
        cases += [text, "Copyright (c) 2024 A. Body\n" + text.upper(), text.replace("license", "licence").replace(",", ";  "), text.replace(" ", "\n ", 3), text.replace("the", "a", 1), text + " more", " ".join(rng.sample(text.split(), len(text.split())))]
    got = {r.doc_id: r.license for r in licenses.scan(docs(spark, [(k, t, None, None) for k, t in enumerate(cases)])).collect()}
    want = {k: known.get(plain(t)) for k, t in enumerate(cases)}
    assert got == want and sum(v is not None for v in want.values()) > 3 * len(licenses.TEXTS) and {*licenses.TEXTS, *licenses.HEADERS} <= {*got.values()}


def test_toxicity(spark, odd, none):
    rng = random.Random(9)
    clean = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def text(bad):
        ws = [rng.choice(clean) for _ in range(60)]
        if bad:
            for _ in range(3):
                ws[rng.randrange(60)] = rng.choice(["scumbag", "dipwad", "jerkface"])
        return " ".join(ws)

    rows = [(k % 2, text(k % 2)) for k in range(240)]
    m = toxicity.train(rows)
    z = toxicity.raw_scores(m, [text(k % 2) for k in range(100)] + ["one two scumbagg three", "one two three", None, ""])
    hit = z[:100] >= np.log(0.3 / 0.7)
    assert (hit == np.arange(100) % 2).mean() >= 0.9 and z[100] > z[101] and not np.isfinite(z[102:]).any()
    got = toxicity.score(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and toxicity.score(none, m).count() == 0
    assert toxicity.train([]).floor == 0 and toxicity.train([(0, "a")]).bias < 0


CONTROLS = ["[INST]", "[/INST]", "</s>", "<<SYS>>", "<|", "|>", "\\", "<|>", "a", " ", "\n", "user", "é", "<", "|", ">"]


def test_chat_round_trip():
    rng = random.Random(10)
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "", "<|user|>", "to\\ol"]), "".join(rng.choice(CONTROLS) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(1, 5))]
        text, mask = chat.format_turns(turns)
        assert chat.parse(text) == turns
        assert chat.read_back(text, mask) == (turns, "".join(t for r, t in turns if r == "assistant"))
    assert chat.parse("<|user|>no end") is None and chat.parse("junk") is None and chat.parse("") == []


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, "x</s>"), (None, 0, "assistant", "z")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()}
    assert got[1].n_turns == 3 and got[1].loss_chars == 1 and got[None].loss_sha256 == hashlib.sha256(b"z").hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"\nx</s>\n").hexdigest() and got[2].formatted_chars == len(got[2].formatted)


def test_quality_counts(spark, odd, none):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) + "\n" + rng.choice(["", "x y\nx y", "  ", "a | b | c | d"]) for _ in range(80)] + [LONG, "", None]
    got = {r.doc_id: r for r in quality.rate(docs(spark, [(k, t, None, None) for k, t in enumerate(texts)])).collect()}
    for k, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        rep = len({i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)})
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (got[k].n_words, got[k].word_chars, got[k].n_repeat_words, got[k].n_dup_lines) == (len(w), sum(map(len, w)), rep, len(lines) - len(set(lines)))
        assert got[k].base_failed == (len(w) < 50 or 100 * rep > 50 * len(w))
    assert quality.rate(odd).count() == odd.count() and quality.rate(none).count() == 0


def test_line_rules(spark):
    words = [f"word{k}" for k in range(60)]
    clean = " ".join(words[:30]) + ".\n" + " ".join(words[30:]) + "."
    menu = "Home | News | About | Contact\n" * 20
    got = quality.rate(docs(spark, [(1, clean, None, None), (2, clean + "\nClick here to subscribe", None, None), (3, " ".join(f"w{k}&&&" for k in range(60)), None, None), (4, clean[:40] + "\n" + menu, None, None)]), keep_text=True)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1].kept and by[2].kept and by[2].clean_text == clean and not by[3].kept and not by[4].kept
