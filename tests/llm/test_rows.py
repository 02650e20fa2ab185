"""Chat, fingerprints, URL filter, classifier, toxicity and mixing: by hand, by SQL, on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstally.llm import chat, fingerprints, mixing, quality, toxicity, urls
from crosstally.llm.frames import WORD, word_count
from crosstally.llm.queries import HOSTILE, URL_RULES
from crosstally.llm.sampling import labelled_sample

DOCS = "doc_id long, text string"
SOURCED = "doc_id long, text string, source string"


def table(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


# Chat ----------------------------------------------------------------------------------------

MESSAGES = "tree_id string, message_id long, parent_id long, role string, text string, score double, up int, m int, leaf int"


def messages(spark, *rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], MESSAGES)


def conversations(df):
    out = chat.formatted(df).select("tree_id", "leaf_id", "rank", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss")).alias("learned"), "loss")
    return {(r["tree_id"], r["leaf_id"]): r for r in out.collect()}


def test_branches_are_ranked_and_formatted(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 5.0), ("t", 3, 1, "assistant", "bad", 1.0),
        ("t", 4, 2, "user", "more", 0.0), ("t", 5, 4, "assistant", "deep", 9.0), ("t", 6, 3, "user", "end", 0.0),
        (None, 1, 99, "user", None, None), ("cycle", 1, 2, "a", "x", 1.0), ("cycle", 2, 1, "a", "y", 1.0), ("cycle", 3, 1, "a", "z", 1.0),
    ]
    best = conversations(chat.branches(messages(spark, *rows), 1))
    assert set(best) == {("t", 5), (None, 1)}
    assert [(t["role"], t["text"]) for t in best["t", 5]["turns"]] == [("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "deep")]
    assert best["t", 5]["learned"] == "gooddeep"
    assert [(t["role"], t["text"]) for t in best[None, 1]["turns"]] == [("user", "")]
    every = conversations(chat.branches(messages(spark, *rows), None))
    assert {k: r["rank"] for k, r in every.items()} == {("t", 5): 1, ("t", 6): 2, (None, 1): 1}
    assert chat.branches(messages(spark, *rows).limit(0)).count() == 0


def test_template_is_reversible(spark):
    parts = ["<", "|", "\\", "im_end", ">", "\n", "%", "0A", "25", "<|im_end|>\n", "<|im_start|>assistant\n", "é", "一", "$1"]
    rng = random.Random(2)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [HOSTILE, "", "<\\|", "x" * 50_000]
    rows = [("t", i + 1, i or None, rng.choice(["user", "assistant", texts[i]]), t, 0.0) for i, t in enumerate(texts)]
    [own] = conversations(chat.branches(messages(spark, *rows), 1)).values()
    assert [(t["role"], t["text"]) for t in own["turns"]] == [(r[3], r[4]) for r in rows]
    learned = [r[4] for r in rows if r[3] == "assistant"]
    assert own["learned"] == "".join(learned) and len(own["loss"]) == len(learned)
    assert own["formatted"].count("<|im_start|>") == len(rows) == own["formatted"].count("<|im_end|>")


def test_a_long_branch_and_repeated_messages(spark):
    rows = [("t", i, i - 1 or None, "user", f"m{i}", 1.0) for i in range(1, 201)]
    own = conversations(chat.branches(messages(spark, *rows, *rows[:50]), 1))
    assert [t["text"] for t in own["t", 200]["turns"]] == [f"m{i}" for i in range(1, 201)]


# Fingerprints --------------------------------------------------------------------------------

def winnowed(spark, texts):
    """Fingerprints by the definition, with Spark's hash of each gram."""
    grams_of = {}
    for text in texts:
        plain = re.sub(r"[ \t-\r]+", " ", text or "").strip(" ")
        tokens = [t[i : i + 32] for t in plain.split(" ") if t for i in range(0, len(t), 32)]
        grams = [" ".join(tokens[i : i + 4]) for i in range(len(tokens) - 3)]
        grams_of[text] = grams or ([" ".join(tokens)] if tokens else [])
    distinct = sorted({g for grams in grams_of.values() for g in grams})
    hashed = dict(map(tuple, spark.createDataFrame([(g,) for g in distinct], "g string").select("g", F.xxhash64("g")).collect())) if distinct else {}
    out = {}
    for text, grams in grams_of.items():
        chosen = []
        for low in range(max(1, len(grams) - 3) if grams else 0):
            span = range(low, min(low + 4, len(grams)))
            at = min(span, key=lambda i: (hashed[grams[i]] >> 31, -i))
            if at not in chosen:
                chosen.append(at)
        out[text] = [(hashed[grams[i]], i) for i in chosen]
    return out


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["a", "b", "cd", "e" * 70, "一二三"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [None, "", " \n\t ", "one", "one two three", "a b c d", "a\n b\tc  d", "z " * 5000, "q" * 5000]
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    found = {r["doc_id"]: list(zip(r["hashes"], r["positions"])) for r in fingerprints.fingerprints(spark.createDataFrame(rows, f"{DOCS}, hashes int")).collect()}
    expected = winnowed(spark, texts)
    assert found == {i: expected[t] for i, t in enumerate(texts)}
    assert found[texts.index("a b c d")] == found[texts.index("a\n b\tc  d")]


def test_shared_passages_share_a_fingerprint(spark):
    rng = random.Random(6)
    rows, guarantee = [], fingerprints.GRAM + fingerprints.WINDOW - 1
    for i in range(40):
        shared = [f"s{rng.random()}" for _ in range(guarantee)]
        for j in range(2):
            noise = [f"n{rng.random()}" for _ in range(20)]
            at = rng.randrange(20)
            rows.append((2 * i + j, " ".join(noise[:at] + shared + noise[at:])))
    found = {r["doc_id"]: set(r["hashes"]) for r in fingerprints.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(found[2 * i] & found[2 * i + 1] for i in range(40))
    assert not any(found[2 * i] & found[2 * i + 2] for i in range(39))


@pytest.mark.parametrize("ids", [[0], [5, 3], list(range(0, 4000, 7)), [1, 2, 10**12, 10**12 + 5, -7]])
def test_edited_texts(spark, ids):
    rng = random.Random(len(ids))
    rows = [(i, "".join(rng.choice("ab é一\n") for _ in range(rng.randint(0, 90)))) for i in ids]
    rows[0] = (rows[0][0], None)
    found = {r["doc_id"]: r for r in fingerprints.compared(spark.createDataFrame(rows, DOCS)).collect()}
    order = sorted(rows)
    for n, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(n + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own = found[doc_id]
        assert own["n_chars"] == len(text) and own["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= own["near_edited"] <= 1 and 0 <= own["near_next"] <= 1
        assert text != edited or own["near_edited"] == 1 and own["fingerprint"] == own["edited_fingerprint"]


def test_edited_texts_of_odd_ids(spark):
    assert fingerprints.compared(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "n"), (1, "a b"), (1, "a b"), (1, "c d"), (2, "e f")]
    assert fingerprints.compared(spark.createDataFrame(rows, DOCS)).count() == 5


def test_given_documents_resemble_their_edits(spark):
    found = fingerprints.compared(table(spark, "documents")).where("n_chars > 400").agg(
        F.avg("near_edited").alias("edited"), F.min("near_edited").alias("least"), F.expr("percentile(near_next, 0.9)").alias("next")
    ).first()
    assert 0.4 < found["edited"] < 0.7 and found["least"] > 0.1 and found["next"] < 0.1


# URLs ----------------------------------------------------------------------------------------

def ruling_by_hand(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p) for _, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


ODD_URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://org/", "https://A.Example.ORG/es/x?y=/z", "http://example.org/en/1",
    "http://example.org/en/2#/es/", "http://myexample.org/es/", "http://x.com/fr/", "http://com/de/#a", "http://x.com?/fr/", "ftp://É.com/fr/é",
    "a://b://org/", "http://x.net/fr/1", "http://x.net/de/1", "://x.org/", "http://x.com\n/fr/",
]


def test_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(ODD_URLS)] + [(0, None, "x", 1)], "page_id long, url string, host string, run int")
    found = urls.judge(pages, URL_RULES).collect()
    assert len(found) == len(ODD_URLS) + 1
    for r in found:
        assert (r["host"], r["path"], r["rule"]) == ruling_by_hand(ODD_URLS[r["page_id"]])
        if r["rule"]:
            assert r["verdict"] == {h + p: v for v, h, p in URL_RULES}[r["rule"]]
        assert r["verdict"] in ("allow", "block")
    assert urls.judge(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in urls.judge(pages.where("page_id = 15"), URL_RULES).collect()} == {"allow"}


def test_model_equals_brute_force(spark):
    """Ratios of the smoothed models, computed from the definition."""
    good, bad, judged = ["abab", "abba"], ["caca"], ["abac", "zz"]
    rows = [(b, "allow", 1) for b in good] + [(b, "block", 1) for b in bad] + [(b, None, 1) for b in judged]
    runs = urls._runs(spark.createDataFrame(rows, "body string, ruling string, fold int"), ["body", "ruling", "fold"])
    found = {r["body"]: r["score"] for r in urls._scores(runs, F.lit(True), F.col("ruling").isNull(), "t", 1.0).collect()}

    def grams(body):
        padded = "\u0002" * 3 + body + "\u0003"
        return [padded[i : i + 4] for i in range(len(body) + 1)]

    letters = len({g[-1] for b, _, _ in rows for g in grams(b)})

    def probability(texts, gram):
        p, seen = 1 / letters, [g for t in texts for g in grams(t)]
        for n in range(1, 5):
            p = (sum(g[4 - n :] == gram[4 - n :] for g in seen) + p) / (sum(g[4 - n : 3] == gram[4 - n : 3] for g in seen) + 1)
        return p

    for body in judged:
        each = [np.log(probability(good, g)) - np.log(probability(bad, g)) for g in grams(body)]
        assert found[body] == pytest.approx(np.mean(each))


def test_model_judges_pages_without_rules(spark):
    rows = [(i, f"http://{w}{i}.{t}") for i in range(150) for w, t in (("bets", "com/de/casino"), ("news", "com/fr/article"))]
    rows += [(1000 + i, f"http://bets{i}.net/casino") for i in range(20)] + [(2000 + i, f"http://news{i}.net/article") for i in range(20)]
    found = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).where("rule is null").collect()
    assert all(r["verdict"] == ("block" if r["page_id"] < 2000 else "allow") for r in found) and len(found) == 40


# Quality -------------------------------------------------------------------------------------

def test_classifier_on_held_out_rows(spark):
    labels = table(spark, "labels")
    found = quality.classify(table(spark, "documents"), labels).join(labels, "doc_id").where("held_out").collect()
    good = [r["score"] for r in found if r["quality"] == 1]
    bad = [r["score"] for r in found if r["quality"] == 0]
    wins = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert wins > 0.95 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    assert np.mean([g >= 0.3 for g in good]) > 0.97


def test_classifier_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5, True), (2, "", 0.1, False), (2, "good text here", 0.1, False), (None, "x", 0.0, True), (4, "##!! %%", 1.0, True)], f"{DOCS}, score double, held_out boolean")
    labels = spark.createDataFrame([(2, 1, "a"), (4, 0, "b"), (4, None, "c"), (None, 1, "d"), (77, 1, "e")], "doc_id long, quality int, text string")
    for used in (labels, labels.limit(0), labels.where("quality = 1")):
        found = quality.classify(docs, used).collect()
        assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_the_driver_gives_the_memory_of_a_fit_back(spark, monkeypatch):
    done, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: (done.append("fit"), fit(*a))[1])
    monkeypatch.setattr(quality, "released", lambda: done.append("released"))
    docs = spark.createDataFrame([(1, "one text"), (2, "ANOTHER 2")], "doc_id long, text string")
    quality.learn(docs, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, label int"))
    assert done == ["fit", "released"]


def test_hinge_solution_meets_its_conditions():
    """At the optimum no row lies on the wrong side of the margin unless its dual is at the bound."""
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(50, 8, replace=False)).astype(np.int32) for _ in range(80)]
    labels = np.array([int(r.min() < 5) for r in rows])
    ratios = quality.log_count_ratios(rows, labels)
    weights, bias = quality.fit_hinge(rows, labels, ratios, cost=100.0, rounds=500)
    margins = [weights[r].sum() / np.sqrt(len(r)) + bias for r in rows]
    assert np.mean((np.array(margins) > 0) == (labels == 1)) > 0.95


def test_features_of_long_texts_follow_the_whole_text():
    text = "plain words here " * 90_000
    assert len(text) > quality.BLOCK
    marked = text + "ZQXJ##"
    assert set(quality.features(text)) < set(quality.features(marked))
    assert len(quality.features(None)) == len(quality.features("")) == 0


# Toxicity ------------------------------------------------------------------------------------

def test_toxicity_by_cross_check(spark):
    """Learned from one half of the labels, judged on the other."""
    labels, docs = table(spark, "labels"), table(spark, "documents")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = toxicity.grade_toxicity(docs, labels.where(half)).join(labels.where(~half), "doc_id").collect()
    bad = [r["expected_severity"] for r in found if r["toxic"] is not None and r[-1] == 1]
    good = [r["expected_severity"] for r in found if r[-1] == 0]
    assert np.mean([(b > g) + (b == g) / 2 for b in bad for g in good]) > 0.9
    assert all(0 <= r["toxic_probability"] <= r["expected_severity"] <= 2 for r in found)


def test_toxicity_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "w"), (2, "", "w"), (2, "vile words", "w"), (None, "vile", "w"), (3, "kind " * 400_000, "w")], f"{DOCS}, label string")
    labels = spark.createDataFrame([(2, 1), (3, 0), (None, 1), (9, 1), (3, None)], "doc_id long, toxic int")
    for used in (labels, labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        assert toxicity.grade_toxicity(docs, used).count() == 5
    assert toxicity.grade_toxicity(docs.limit(0), labels).count() == 0


def test_ordinal_weights_order_the_grades():
    rng = np.random.default_rng(1)
    words = np.sort(mixed_words := rng.integers(1, 2**62, 60, dtype=np.uint64))
    del mixed_words
    rows = [np.sort(rng.choice(words, rng.integers(3, 20), replace=False)) for _ in range(600)]
    bad = set(words[:6].tolist())
    grade = np.array([min(2, len(bad & set(r.tolist()))) for r in rows])
    model = toxicity.fit(rows, grade, np.ones(len(rows)))
    expected = np.array([model.exceedances(r).sum() for r in rows])
    assert expected[grade == 0].max() < expected[grade == 2].mean() and np.all(np.diff(model.thresholds) > 0)
    means = [expected[grade == g].mean() for g in (0, 1, 2)]
    assert means[0] < means[1] < means[2]


def test_words_across_blocks(monkeypatch):
    text = "Alpha beta, gamma-delta é " * 50
    whole = toxicity.words(text)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert np.array_equal(toxicity.words(text), whole) and len(whole) == 5
    assert len(toxicity.words(None)) == len(toxicity.words("12 34")) == 0


# Mixing --------------------------------------------------------------------------------------

def targets_by_hand(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300, 3000])), rng.choice([None, "a", "a", "a", "b", "c", "é", ""]), 1, 2) for i in range(400)]
    rows += [(7, "again " * 50, "a", 1, 2), (8, None, "z", 1, 2)]
    docs = spark.createDataFrame(rows, f"{SOURCED}, size int, start int")
    mixed, placed = mixing.mix(docs)
    found = mixing.taken(mixed, placed).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    targets = targets_by_hand(sizes)
    by_id = {r[0]: r for r in rows}
    got = dict.fromkeys(sizes, 0)
    for r in found:
        source = by_id[r["doc_id"]][2]
        assert r["taken"] <= 2 * r["size"]
        if r["doc_id"] not in (7, 8):  # these ids stand twice
            assert r["source_size"] == sizes[source] and r["target"] == pytest.approx(targets[source])
    for r in placed.join(mixed.groupBy("source_no", "start").agg(F.sum("words").alias("w")), ["source_no", "start"]).where("size > 0").collect():
        got[r["source"]] += r["w"]
    for source, target in targets.items():
        assert abs(got[source] - target) <= 3 * 64 + 0.02 * target
    again = mixing.taken(*mixing.mix(docs.repartition(7))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


@pytest.mark.parametrize("size", [10, 65, 130, 200, 3000])
def test_small_sources_come_near_their_targets(spark, size):
    rows = [(i, " ".join(["w"] * size), f"s{i:02}") for i in range(30)] + [(99, " ".join(["w"] * 20000), "z")]
    docs = spark.createDataFrame(rows, SOURCED)
    found = mixing.taken(*mixing.mix(docs, weights=(1,), share=1.9)).collect()
    small = [r for r in found if r["doc_id"] < 99]
    assert all(r["taken"] == pytest.approx(r["target"], rel=0.05, abs=2) for r in found)
    assert sum(r["taken"] for r in small) == pytest.approx(sum(r["target"] for r in small), rel=0.04)
    few = mixing.taken(*mixing.mix(docs.where("doc_id = 0").withColumn("text", F.lit("a b c d")))).collect()
    assert few[0]["taken"] == 6


def test_mix_of_odd_tables(spark):
    assert mixing.taken(*mixing.mix(spark.createDataFrame([], SOURCED))).count() == 0
    wordless = mixing.taken(*mixing.mix(spark.createDataFrame([(1, None, None), (None, " ", "a")], SOURCED))).collect()
    assert sorted((r["size"], r["taken"], r["target"]) for r in wordless) == [(0, 0, 0.0)] * 2
    one = mixing.taken(*mixing.mix(spark.createDataFrame([(1, "w " * 1000, "a")], SOURCED))).collect()
    assert [(r["size"], r["target"]) for r in one] == [(1000, 1500.0)] and abs(one[0]["taken"] - 1500) <= 64


def test_words_are_counted_without_an_array_of_them(spark):
    white, rng = " \t\n\v\f\r", random.Random(5)
    texts = [None, "", *white, white, "x", "x ", " x", " x\t x ", "\u00a0 \u2003 \x1c\x85", "$1 \\x {x} \U0001f600\U0001f600", "é" * 70000 + "\n", "x" + " " * 500000]
    texts += ["".join(rng.choices(white + "xé\u3000\0", k=rng.randrange(40))) for _ in range(300)]
    counted = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", word_count(F.col("text")).alias("n"))
    assert {r["i"]: r["n"] for r in counted.collect()} == {i: len(re.findall(WORD, t or "")) for i, t in enumerate(texts)}
    assert dict(counted.dtypes)["n"] == "bigint"
    assert "regexp_extract_all" not in counted._jdf.queryExecution().executedPlan().toString()


def test_slots_meet_pieces_in_a_shuffle_at_every_size(spark):
    # The stored table is small, its pieces are many: 4,096 in one document.
    mixed, _ = mixing.mix(spark.createDataFrame([(1, "w " * 64 * 4096, "a")], SOURCED))
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[source_no#\d+, block_no#\d+L\]", plan)
    assert not re.search(r"BroadcastHashJoin \[source_no#\d+, block_no#\d+L\]", plan)


def test_points_are_the_golden_sequence(spark):
    slots = [0, 1, 2, 3, 65535, 65536, 10**6, 2**32 + 5, 2**40 + 1]
    rows = spark.createDataFrame([(s,) for s in slots], "s long").select("s", mixing.golden_point(F.col("s"))).collect()
    assert all(point == s * mixing.GOLDEN % 2**32 for s, point in rows)


def test_labelled_sample_stays_within_its_bound(spark):
    docs = spark.createDataFrame(
        [(1, f"text {i}") for i in range(200)] + [(1, "same")] * 50 + [(2, None), (3, "three"), (None, "none")], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(1, 1)] * 5 + [(2, 0), (3, 0), (3, 1), (9, 1), (None, 1)], "doc_id long, label int")
    texts, counts = labelled_sample(docs, labels, 7)
    found = [(r["label"], r["text"]) for r in texts.collect()]
    assert counts == {0: 2, 1: 6}
    assert sorted((x for x in found if not x[0]), key=repr) == [(0, "three"), (0, None)]
    assert len([x for x in found if x[0]]) == 7 == len({x for x in found if x[0]})
    assert labelled_sample(docs, labels.limit(0), 7) == (None, {})


def test_urls_without_a_rule_are_judged_beside_ruled_ones_of_equal_text(spark):
    rows = [(i, f"http://a{i}.org/good{i}") for i in range(20)] + [(100 + i, f"http://a{i}.com/de/bad{i}") for i in range(20)]
    twins = [(500, "http://shop.com/DE/bad3"), (501, "http://shop.com/de/bad3"), (502, "shop.com/de/bad3")]
    found = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows + twins, "page_id long, url string"), URL_RULES).collect()}
    assert found[501]["rule"] == "com/de/" and found[501]["score"] is None
    assert found[500]["rule"] is None and found[502]["rule"] is None
    assert found[500]["score"] == found[502]["score"] < 0
    assert len(found) == 43
