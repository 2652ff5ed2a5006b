"""Canonical mapping, packing, mixing and language labels."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

canonical = pytest.importorskip("ventra.llm.canonical")
from ventra.llm import language, mixing, packing, tokens  # noqa: E402

# 3 canonical


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_canonical_values(spark):
    ref = spark.createDataFrame([(1, "sleep", 0), (2, "quiet wake", 0), (4, "rearing supported", 0), (5, "rearing unsupported", 0), (9, "digging", 0), (9, "digging", 0), (7, None, 0)], "id int, label string, value int")
    want = {"Sleep  ": 1, "slepe": 1, "selep": 1, "skeep": 1, "beh: sleep": 1, "*slee*": 1, "sleep, left": 1, "11_sleep": 1, "quietwake": 2, "qiuet wkae": 2}
    want |= {"rearin hunsupported": 5, "rearing nsupported": 5, "rearing suported": 4, "digged": 9, "weighed": None, "??": None, "": None, "n.n. 28": None, "x" * 50_000: None}
    other = {"schlafen": 1, "schlafne": 1, "QW": 2, "awake, still": 2, "dig": 9}
    values = spark.createDataFrame([(v, 1) for v in [*want, *other, "sleep", "sleep", None]], "value string, id int")
    got = {r.value: r.id for r in canonical.map_to_list(values, ref).collect()}
    assert got == want | dict.fromkeys(other) | {"sleep": 1}
    wordings = spark.createDataFrame([(1, "schlafen"), (2, "qw"), (2, "awake still"), (9, "Dig"), (None, "x"), (3, None)], "id int, wording string")
    got = {r.value: r.id for r in canonical.map_to_list(values, ref, wordings).collect()}
    assert got == want | other | {"sleep": 1}
    assert canonical.map_to_list(values.limit(0), ref).count() == 0
    assert {r.status for r in canonical.map_to_list(values, ref.limit(0)).collect()} == {"unmatched"}


def test_wordings_are_learned_from_what_is_scored_beside_them(spark):
    rng = random.Random(3)
    labels = ["sleep", "walking", "grooming", "digging", "climbing"]
    other = {"schlafen": "sleep", "strolling": "walking"}
    rows = []
    for source in range(40):
        for k in range(30):  # each stretch is scored twice, here and there by another word or with a remark that says nothing
            at, what = 400.0 * k, rng.choice(labels)
            word = next((w for w, x in other.items() if x == what and rng.random() < 0.5), what)
            rows += [(source, at, at + 50, what), (source, at + rng.random(), at + 49, word)]
            if rng.random() < 0.2:
                rows.append((source, at + 10, at + 20, "see notes"))
    rows += [(None, 0.0, 1.0, "schlafen"), (1, None, None, "Schlafen!?"), (1, float("nan"), 3.0, None), (1, 0.0, 1.0, "??")]
    bouts = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(rows)], "row_key long, source int, start_at double, end_at double, value string, id int")
    bouts = bouts.withColumn("start_at", F.when(~F.isnan("start_at"), F.col("start_at")))
    ref = spark.createDataFrame(list(enumerate(labels, 1)), "id int, label string")
    mapped = canonical.map_to_list(bouts, ref)
    got = {(r.id, r.wording) for r in canonical.learned_wordings(bouts, mapped).collect()}
    assert got == {(1, "schlafen"), (2, "strolling")}
    assert canonical.learned_wordings(bouts.limit(0), mapped).count() == canonical.learned_wordings(bouts, mapped.limit(0)).count() == 0


def test_canonical_finds_all_within_two_edits(spark):
    random.seed(5)
    labels = ["grooming", "climbing", "scratching", "stretching", "nest building", "light off", "light on"]
    typed = set()
    for _ in range(300):
        w = list(random.choice(labels).replace(" ", ""))
        for _ in range(2):
            i = random.randrange(len(w))
            w[i : i + 1] = random.choice([[], [w[i], random.choice("abcdef")], [random.choice("abcdef")]])
        typed.add("".join(w))
    ref = spark.createDataFrame(list(enumerate(labels, 1)), "id int, label string")
    got = {r.value: r for r in canonical.map_to_list(spark.createDataFrame([(t,) for t in typed], "value string"), ref).collect()}
    refs = [x.replace(" ", "") for x in labels]
    for t in typed:
        best = min(_distance(t, r) for r in refs)
        if best <= 2:
            assert got[t].status == "matched" and got[t].edits <= best


# 8 packing


def test_packing_places_every_piece_once(spark):
    random.seed(6)
    data = [(i, random.choice([0, None, 5, random.randrange(1, 300), 1000]), "x") for i in range(3000)]
    sizes = spark.createDataFrame(data, "doc_id long, n_tokens long, shard string")
    packs = spark.createDataFrame([("a", 256), ("b", 1000), ("bad", 0), ("none", None)], "pack_name string, capacity_tokens int")
    got = packing.pack(sizes, packs, 3000, shard=700).toPandas()
    for name, cap in (("a", 256), ("b", 1000)):
        g = got[got.pack_name == name]
        assert g.groupby("doc_id").n_tokens.sum().to_dict() == {i: n or 0 for i, n, _ in data}
        boxes = g[g.container_no.notna()].groupby(["shard", "container_no"]).n_tokens.sum()
        assert boxes.max() <= cap and boxes.sum() / (len(boxes) * cap) > 0.95
        pieces = g.groupby("doc_id").piece_no.max() + 1
        assert all(pieces[i] == max(1, -(-(n or 0) // cap)) for i, n, _ in data)
        assert g[g.n_tokens == 0].container_no.isna().all()
    assert set(got.pack_name) == {"a", "b"}
    assert packing.pack(sizes.limit(0), packs, 0).count() == 0
    assert packing.pack(sizes, packs.limit(0), 3000).count() == 0


def test_sum_of_squares_rule():
    levels = packing.Levels(10)
    assert [levels.place(6), levels.place(4), levels.place(10)] == [0, 0, 1]
    assert levels.count.sum() == 0


# 9 mixing


def test_pivot_keeps_the_sum():
    rng = np.random.default_rng(7)
    for _ in range(50):
        sizes, shares = rng.integers(1, 1000, 60).tolist(), rng.random(60).tolist()
        ones, left = mixing.pivot(sizes, shares, rng.random(60))
        total = sum(s for s, o in zip(sizes, ones) if o == 1) + (sizes[left[0]] * left[1] if left else 0)
        assert abs(total - sum(s * p for s, p in zip(sizes, shares))) < 1e-6
        assert ones.count(-1) == (1 if left else 0)


def test_pivot_keeps_expectations():
    rng = np.random.default_rng(8)
    sums = np.zeros(6)
    for _ in range(4000):
        ones, left = mixing.pivot([1, 2, 3, 4, 5, 6], [0.3] * 6, rng.random(6))
        sums += [left[1] if o < 0 else o for o in ones]
    assert np.abs(sums / 4000 - 0.3).max() < 0.04


def test_every_document_of_a_small_source_keeps_its_share(spark):
    """400 sources alike stand for seeds: eight documents each, one of them far larger than what is to be given."""
    n_tokens = [9000, 700, 600, 500, 400, 300, 200, 100]
    data = [(100 * s + i, f"s{s}", n) for s in range(400) for i, n in enumerate(n_tokens)]
    sizes = spark.createDataFrame(data, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([(f"s{s}", 1 / 400, 1) for s in range(400)], "source string, target_share double, max_repeats int")
    chosen, _ = mixing.mix(sizes, targets, total_tokens=0.3 * 400 * sum(n_tokens), shard=4)
    mean = chosen.groupBy((F.col("doc_id") % 100).alias("i")).agg(F.avg("copies").alias("m")).orderBy("i").collect()
    assert all(abs(r.m - 0.3) < 0.08 for r in mean)
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).agg(F.max(F.abs(F.col("t") - 0.3 * sum(n_tokens)))).first()[0]
    assert reached <= max(n_tokens)


def test_mix_shares(spark):
    random.seed(9)
    data = [(i, s := random.choice(["a", "a", "a", "b", "c", None, "other"]), random.choice([None, 0, random.randrange(1, 2000)]) if i % 5 == 0 else random.randrange(1, 2000), 0) for i in range(8000)]
    data += [(1, "a", 50, 0), (1, "a", 50, 0)]
    sizes = spark.createDataFrame(data, "doc_id long, source string, n_tokens long, copies int")
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.29, 1), ("d", 0.01, 5)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(sizes, targets, shard=500)
    rows = chosen.collect()
    assert Counter(r.source for r in rows) == Counter(s for _, s, *_ in data if s in ("a", "b", "c"))
    cap = {"a": 1, "b": 3, "c": 1}
    assert all(0 <= r.copies <= cap[r.source] and (r.n_tokens or r.copies == 0) for r in rows)
    held = Counter()
    for r in rows:
        held[r.source] += r.n_tokens
    give = mixing.amounts(held, {"a": (0.3, 1), "b": (0.4, 3), "c": (0.29, 1), "d": (0.01, 5)}, sum(held.values()))
    got = Counter()
    for r in rows:
        got[r.source] += r.n_tokens * r.copies
    assert all(abs(got[s] - give[s]) < 2000 for s in "abc") and give["c"] == held["c"]
    shares = {r.source: r for r in report.collect()}
    assert shares["d"].short and shares["d"].reached_tokens == 0 and shares["c"].short and not shares["b"].short
    assert abs(sum(r.reached_share for r in shares.values()) - 1) < 1e-9
    assert rows == mixing.mix(sizes, targets, shard=500)[0].collect() or sorted(rows) == sorted(mixing.mix(sizes, targets, shard=500)[0].collect())
    empty, report = mixing.mix(sizes.limit(0), targets)
    assert empty.count() == 0 and report.count() == 4


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", 1), (2, "", 1), (3, None, 1), (4, "<|endoftext|>", 1)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in tokens.with_tokens(df, ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


# 10 language

WORDS = {
    "en": "the and you that was for are with his they have this from had not but what all were when".split(),
    "de": "der die und das ist nicht ich ein sie mit auf für dem den wir auch noch nach über schon".split(),
    "ru": "и в не на я что он с это как по но они мы все она так его только еще".split(),
}


def _cues(parts, rng):
    text, n = "", 0
    for lang, count in parts:
        for _ in range(count):
            n += 1
            words = " ".join(rng.choice(WORDS[lang]) for _ in range(7)) if lang else "♪ ♪"
            text += f"{n}\n00:00:{n % 60:02d},000 --> 00:00:{n % 60:02d},900\n<i>{words}</i>\n\n"
    return text


def test_language_of_documents_and_stretches(spark):
    rng = random.Random(10)
    data = [(i, _cues([(k := ["en", "de", "ru"][i % 3], 8)], rng), {"en": "en-GB", "de": "ger", "ru": "Russian"}[k], 5) for i in range(240)]
    data += [
        (1000, _cues([("en", 6), ("de", 4), ("en", 3)], rng), "en", 5), (1001, _cues([("de", 5), ("en", 2), ("de", 5)], rng), None, 5), (1002, _cues([("en", 4), (None, 2), ("ru", 5)], rng), "de", 5),
        (1003, "", "en", 5), (1004, None, "en", 5), (1005, "1\n00:00:01,000 --> 00:00:02,000\n♪ 123\n", "en", 5), (1006, "the and you that was", "unknown", 5), (1007, _cues([("de", 2000)], rng), "de", 5),
        (1007, _cues([("de", 2000)], rng), "de", 5),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, cue_no int")
    out = {}
    for r in language.label_languages(df).collect():
        out.setdefault(r.doc_id, []).append((r.cue_no, r.lang))
    assert all(out[i] == [(0, ["en", "de", "ru"][i % 3])] for i in range(240))
    assert sorted(out[1000]) == [(0, "en"), (1, "en"), (7, "de"), (11, "en")]
    assert out[1001] == [(0, "de")] and out[1006] == [(0, "en")] and out[1007] == [(0, "de")] * 2
    assert sorted(out[1002]) == [(0, "en"), (1, "en"), (7, "ru")]
    assert out[1003] == out[1004] == out[1005] == [(0, None)]
    assert language.label_languages(df.limit(0)).count() == 0


def test_held_out_accuracy_on_tables(spark):
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    d = spark.read.parquet(path)
    fitted = language.fit_languages(d.where("doc_id % 2 = 0"))
    rows = language.label_languages(d.where("doc_id % 2 = 1"), fitted).where("cue_no = 0 and lang is not null and label is not null").collect()
    assert sum(r.lang == r.label for r in rows) / len(rows) > 0.88  # the labels themselves are wrong in places


def test_labels_and_repairs():
    codes = {"en-GB": "en", "ENGLISH": "en", "deu": "de", "pt_PT": "pt", "es-419": "es", "und": None, " ": None, None: None, "fr": "fr", "Dutch": "nl"}
    assert {k: language.label_code(k) for k in codes} == codes
    assert language.repaired("Knöpfe".encode().decode("cp1252")) == "Knöpfe"
    assert language.repaired("Вернись сюда".encode("koi8-r").decode("latin-1")) == "Вернись сюда"
    assert language.repaired("déjà vendu") == "déjà vendu"


def test_cut_pays_with_neutral_cues_inside():
    """Two cues speak up for the other language and one between them hardly does."""
    own, other, faint = [0.0, -9.0], [-9.0, 0.0], [-0.5, 0.0]
    x = np.array([own] * 5 + [other, faint, other] + [own] * 5)
    assert language.segments(x, np.ones(len(x), bool)) == [(0, 0), (5, 1), (8, 0)]
    x = np.array([own] * 5 + [other, faint, faint])
    assert language.segments(x, np.ones(len(x), bool)) == [(0, 0), (5, 1)]


def test_early_exit_hides_no_cut():
    """Against all ways to cut, by plain enumeration."""
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(60):
        x = -rng.choice([0.0, 0.5, 3.0, 9.0], (8, 3), p=[0.4, 0.3, 0.2, 0.1])
        loss = np.minimum(x.max(axis=1, keepdims=True) - x, language.CAP)
        least = np.inf
        for k in range(3):
            for cuts in itertools.combinations(range(3, 6), k):
                ends = [0, *cuts, 8]
                if min(np.diff(ends)) < language.LEAST_RUN:
                    continue
                for langs in itertools.product(range(3), repeat=k + 1):
                    cost = k * language.SWITCH + sum(loss[a:b, w].sum() for a, b, w in zip(ends, ends[1:], langs))
                    least = min(least, cost)
        got = language.segments(x, np.ones(8, bool))
        ends = [*[p[0] for p in got], 8]
        assert (len(got) - 1) * language.SWITCH + sum(loss[a:b, w].sum() for a, b, (_, w) in zip(ends, ends[1:], got)) == pytest.approx(least)


def test_rare_language_is_kept_if_its_documents_confirm_it(spark):
    rng = random.Random(8)
    english = "the and you that was for are with his they this have from one had word but not what all were when your can said".split()
    finnish = "ja on ei se että hän olen minä sinä mutta niin kuin mitä tämä kun nyt vain hyvä kiitos tule".split()
    text = lambda words: " ".join(rng.choices(words, k=30))
    data = [(i, text(english), "en") for i in range(2500)] + [(3000 + i, text(finnish), "fi") for i in range(6)]
    data += [(4000 + i, text(english), "cs") for i in range(6)] + [(5000 + i, text(finnish), "qq") for i in range(6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language.fit_languages(docs)
    assert model.languages == ["en", "fi"]
    got = {r.doc_id: r.lang for r in language.label_languages(docs.where("doc_id >= 3000"), model).collect()}
    assert all(v == ("en" if 4000 <= k < 5000 else "fi") for k, v in got.items()) and len(got) == 18
