"""Near-dedup, line dedup, passages and decontamination against brute force, and odd inputs."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F

from crosstally.llm import chunk_dedup, decontamination, graph, line_dedup, minhash
from crosstally.llm.frames import Scratch
from crosstally.llm.queries import QUERIES
from crosstally.llm.shingles import Shingler

DOCS = "doc_id long, text string"
CLASHING = (
    "doc_id long, text string, class string, keys int, doc string, place int, rank int, h int, "
    "start int, component string, size int, source string, bucket int, __own int"
)


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    return frame(spark, [(*r, "x", 1, "x", 2, 3, 4, 5, "x", 6, "s", 7, 8) for r in rows], CLASHING)


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def near_copies(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, nth = [], 0
    for _ in range(12):
        base = sentence(rng, rng.randint(3, 90), words).split()
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((nth, " ".join(own)))
            nth += 1
    rng.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one\ttwo"), (905, "Ä b"), (906, "ä b")]


def components_by_hand(rows):
    sets = {}
    for doc_id, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split()
        n = min(5, len(words))
        sets[doc_id] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((root(a), root(b)))
            least[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = near_copies(seed)
    expected = components_by_hand(rows)
    found = {r["doc_id"]: r for r in minhash.near_duplicates(clashing(spark, rows)).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == expected
    assert all(r["kept"] == (d == r["component_id"]) for d, r in found.items())


def test_texts_without_an_id_link_and_are_linked(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (0, 30, 59)]
    # 1 and 2 differ by two words of 60; the text without an id differs from each by one.
    rows = [(5, " ".join(words)), (None, near[0]), (None, near[2]), (9, "other words only, and enough of them here")]
    found = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert found == {(5, 5, True), (None, 5, False), (9, 9, True)}


def test_one_row_of_each_group_is_kept(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [
        (1, a), (1, a), (2, a + " end"), (2, b), (3, b), (None, c), (None, c), (None, c + " end"),
        (4, None), (4, ""), (4, ""), (5, "short"), (5, "short"),
    ]
    docs = frame(spark, rows).select("*", F.lit(1).alias("h"), F.lit(2).alias("n"), F.lit(3).alias("component"), F.lit(4).alias("row"))
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert [x for x in found if x[0] is not None] == [(1, a), (2, b), (4, ""), (4, ""), (4, None), (5, "short")]
    assert len([x for x in found if x[0] is None]) == 1
    assert minhash.one_of_each(docs.limit(0)).count() == 0


def test_near_duplicates_of_repeated_null_and_missing_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "z"), (1, "other words")]
    found = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert len(found) == 5
    assert all(r[2] == 1 for r in found if r[1] and r[0] in (1, None))
    only = minhash.near_duplicates(frame(spark, [(None, None), (None, "a")])).collect()
    assert [(r["component_id"], r["kept"]) for r in only] == [(None, True)] * 2


@pytest.mark.parametrize("part", [2, 1024])
def test_two_alike_that_are_unlike_the_centre_are_still_linked(spark, monkeypatch, part):
    """One bucket holds pairs that are alike and a centre like none of them: the repair finds the pairs."""
    monkeypatch.setattr(minhash, "PART", part)
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.integers(0, 2**63, 40, dtype=np.uint64)) for _ in range(8)]
    sets += [np.sort(np.append(s[:-3], rng.integers(0, 2**63, 2, dtype=np.uint64))) for s in sets[1:5]]
    names = [bytes([i + 1]) * 16 for i in range(len(sets))]
    crowded = spark.createDataFrame([(0, 7, bytearray(c), 40, len(sets)) for c in names], "band int, key long, u binary, u_n long, size long")
    table = spark.createDataFrame([(bytearray(c), bytearray(s.tobytes())) for c, s in zip(names, sets)], "class binary, shingles binary")
    found = spark.createDataFrame([(bytearray(names[1]), bytearray(names[1])), (bytearray(names[8]), bytearray(names[1]))], "node binary, component binary")
    pairs = {tuple(sorted((bytes(r["u"]), bytes(r["v"])))) for r in minhash._missed(crowded, found, table, Scratch()).collect()}
    assert pairs == {(names[i], names[i + 7]) for i in (2, 3, 4)}


def test_signature_estimates_likeness():
    rng = np.random.default_rng(0)
    same = []
    for _ in range(200):
        pool = rng.integers(0, 2**63, 500, dtype=np.uint64)
        a, b = np.unique(pool[:400]), np.unique(pool[100:])
        same.append((minhash.signature(a) == minhash.signature(b)).mean())
    assert abs(np.mean(same) - 0.6) < 0.03
    tiny = minhash.signature(np.array([5], np.uint64))
    assert len(tiny) == minhash.BINS and np.array_equal(tiny, minhash.signature(np.array([5], np.uint64)))


def test_shingles():
    own = Shingler()
    assert len(own(None)) == len(own(" \n")) == 0 and len(own("a b")) == 1 and len(own("a b c d e f")) == 2
    assert np.array_equal(own("A b"), own("a\tB")) and not np.array_equal(own("a b"), own("ab"))
    assert len(own("x " * 100_000)) == 1


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 50)]
    found = dict(map(tuple, graph.components(spark.createDataFrame(path + star, "u long, v long"), "t").collect()))
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}}
    assert graph.components(spark.createDataFrame([], "u long, v long"), "t").count() == 0


def lines_by_hand(rows, min_lines, min_chars=120):
    """(doc_id, text, n_lines, n_removed) by looking at every window of ``min_lines`` lines and every long line."""
    docs = sorted({(i, t) for i, t in rows if t is not None})
    seen, gone = set(), {}
    for doc, (_, text) in enumerate(docs):
        own = [x for x in text.split("\n") if x.strip(" \t\r\n\v\f")]
        gone[doc] = set()
        for p in range(len(own) - min_lines + 1):
            window = tuple(own[p : p + min_lines])
            if window in seen:
                gone[doc].update(range(p, p + min_lines))
            seen.add(window)
        for p, x in enumerate(own):
            if len(x) >= min_chars:
                if ("long", x) in seen:
                    gone[doc].add(p)
                seen.add(("long", x))
    out = {}
    for doc, (doc_id, text) in enumerate(docs):
        kept, place, dropping = [], 0, False
        for x in text.split("\n"):
            if x.strip(" \t\r\n\v\f"):
                dropping = place in gone[doc]
                place += 1
            if not dropping:
                kept.append(x)
        out[doc_id, text] = ("\n".join(kept), place, len(gone[doc]))
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 4])
def test_line_dedup_equals_brute_force(spark, min_lines):
    rng = random.Random(min_lines)
    rows = []
    for i in range(60):
        own = [rng.choice("abcdefgh") if rng.random() < 0.6 else f"u{rng.random()}" for _ in range(rng.randint(0, 14))]
        if rows and rng.random() < 0.4:
            own += rng.choice(rows)[1].split("\n")[: rng.randint(1, 12)]
        own = [x if rng.random() > 0.1 else rng.choice(["", "  "]) for x in own]
        rows.append((i, "\n".join(own)))
    rows += [(100, "a\n" * 40), (101, "a\n" * 33), (102, rows[5][1]), (103, "\n".join(f"z{i}" for i in range(70))), (104, "\n".join(f"z{i}" for i in range(70)))]
    cut, runs = line_dedup.dedup_lines(clashing(spark, rows), min_lines)
    found = {r["doc_id"]: (r["text"], r["__n_lines"], r["__n_removed"]) for r in cut.collect()}
    assert found == {d: x for (d, _), x in lines_by_hand(rows, min_lines).items()}
    longest = runs.where("doc.doc_id = 104").collect()
    assert [(r["place"], r["length"], r["first_doc"]["doc_id"], r["first_place"]) for r in longest] == [(0, 70, 103, 0)]


@pytest.mark.parametrize("min_lines", [1, 2, 4])
def test_long_lines_that_are_repeated_alone_go(spark, min_lines):
    rng = random.Random(10 + min_lines)
    pool = [x * n for x in "abcd" for n in (1, 4, 5, 6)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"u{rng.random()}" for _ in range(rng.randint(0, 9)))) for i in range(80)]
    cut, _ = line_dedup.dedup_lines(frame(spark, rows), min_lines, min_chars=5)
    found = {r["doc_id"]: (r["text"], r["__n_lines"], r["__n_removed"]) for r in cut.collect()}
    assert found == {d: x for (d, _), x in lines_by_hand(rows, min_lines, 5).items()}


def test_line_dedup_beside_columns_of_its_own_names(spark):
    names = ["doc", "spans", "cut", "row", "__doc", "__spans", "__cut", "h", "place"]
    docs = frame(spark, [(1, "a\nb"), (2, "a\nb\nc")]).select("*", *[F.lit(n).alias(n) for n in names])
    cut, _ = line_dedup.dedup_lines(docs)
    assert cut.columns == ["doc_id", "text", *names, "__n_lines", "__n_removed"]
    assert sorted(map(tuple, cut.select("doc_id", "text", *names).collect())) == [(1, "a\nb", *names), (2, "c", *names)]


def test_line_dedup_of_odd_rows(spark):
    assert line_dedup.dedup_lines(frame(spark, []))[0].count() == 0
    rows = [(1, None), (2, ""), (None, "a\nb\nc"), (3, "a\nb\nc"), (3, "a\nb\nc"), (3, "x\ny"), (4, "\n\n"), (5, "x\ny\n\nend")]
    cut, _ = line_dedup.dedup_lines(frame(spark, rows))
    found = sorted(((r["doc_id"], r["text"], r["__n_removed"]) for r in cut.collect()), key=repr)
    assert found == sorted(
        [(1, None, 0), (2, "", 0), (None, "a\nb\nc", 0), (3, "", 3), (3, "", 3), (3, "x\ny", 0), (4, "\n\n", 0), (5, "end", 2)], key=repr
    )
    with pytest.raises(ValueError):
        line_dedup.repeated_runs(frame(spark, rows), 3)


def test_each_level_of_line_dedup_takes_few_stages(spark):
    """Seven levels of copies; a level stores its pairs, numbers them and looks up the first suffix on the way."""
    text = "\n".join(f"line {i}" for i in range(100))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "own\n" + text)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("lines", "stages of line dedup")
    try:
        found = line_dedup.dedup_lines(docs)[0].select("__n_removed").collect()
        tracker = spark.sparkContext.statusTracker()
        jobs = len(tracker.getJobIdsForGroup("lines"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r[0] for r in found) == [0, 100, 100]
    assert jobs <= 120


def test_passages_are_found_whatever_stands_before_them(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    shared = [sentence(rng, 70, words) for _ in range(6)]
    rows = [(i, f"{sentence(rng, rng.randint(5, 60), words)} {shared[i % 6]} {sentence(rng, 40, words)}") for i in range(48)]
    rows += [(100 + i, sentence(rng, 150, words)) for i in range(30)] + [(200, None), (201, ""), (202, "x" * 3000)]
    cut, repeats = chunk_dedup.dedup_passages(clashing(spark, rows))
    caught = {r["doc_id"] for r in repeats.collect()}
    assert caught >= set(range(6, 48)) and not caught & set(range(6)) and not caught & set(range(100, 130))
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[0] == rows[0][1] and texts[200] is None and texts[201] == ""
    for i in range(6, 48):
        assert shared[i % 6] not in texts[i] and rows[i][1].split()[0] == texts[i].split()[0]


def test_chunks_cover_texts_and_ignore_shifts():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdef é一") for _ in range(5000))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = chunk_dedup.boundaries(codes)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes.max() <= chunk_dedup.MOST and sizes[:-1].min() >= chunk_dedup.LEAST
    moved = np.frombuffer(("shift " * 7 + text).encode("utf-32-le"), np.uint32)
    shifted = {e - 42 for e in chunk_dedup.boundaries(moved)}
    assert len(shifted & set(ends)) > 0.8 * len(ends)
    by_hand, h = [], 0
    for c in codes[:200]:
        h = ((h << 1) + int(chunk_dedup._GEAR[c & 0xFFFF])) & 0xFFFF
        by_hand.append(h)
    assert chunk_dedup.gear_hash(codes[:200]).tolist() == by_hand


def test_passages_of_odd_rows(spark):
    assert chunk_dedup.repeated_passages(frame(spark, [])).count() == 0
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(None, text), (1, text), (1, text), (2, text + " and more")]
    found = {r["doc_id"] for r in chunk_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert found == {1, 2}


def test_the_passage_query_cuts_every_document(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (2, f"other start {text}"), (2, "a second text of one id"), (3, "no copy"), (4, None), (5, "")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = [tuple(r) for r in QUERIES["op5_substring_dedup"](spark, str(tmp_path)).select("doc_id", "removed", "text").collect()]
    assert len(found) == len(rows)
    assert set(found) >= {(d, 0, t) for d, t in rows if d != 2} | {(2, 0, "a second text of one id")}
    (removed, left), = [(n, t) for d, n, t in found if n]
    assert len(left) == len(rows[1][1]) - removed and left.startswith("other start") and removed > len(text) // 2


@pytest.mark.parametrize("words_shared", [24, 51])
def test_copied_passages_go_whole(spark, words_shared):
    rng = random.Random(words_shared)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows, rest = [], {}
    for i in range(150):
        shared = sentence(rng, words_shared, words)
        for doc_id in (i, 1000 + i):
            head, tail = sentence(rng, 30, words), sentence(rng, 30, words)
            rows.append((doc_id, f"{head}. {shared} ({tail}"))
            rest[doc_id] = head, tail
    cut, _ = chunk_dedup.dedup_passages(frame(spark, rows))
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert all(texts[i] == rows[2 * i][1] for i in range(150))
    # Of a copy at most the marks around it stay.
    whole = [i for i in range(150) if len(texts[1000 + i]) <= sum(map(len, rest[1000 + i])) + 4]
    for i in whole:
        head, tail = (x.split() for x in rest[1000 + i])
        assert texts[1000 + i].split()[:29] == head[:29] and texts[1000 + i].split()[-29:] == tail[-29:]
    assert len(whole) >= (150 if words_shared > 50 else 125)


def test_growth_ends_at_words():
    for own, other, n in (
        ("x end of", "x end to", 4), ("xy end", "xy and", 1), ("xyz", "xyq", 1), (" abc", " abd", 0), ("x ab", "x abc", 0),
        ("x", "x more", 0), ("x ab  c", "x ab  d", 3), ("xab", "xab", 2),
    ):
        assert chunk_dedup.grown(own, other, 100) == (n, False), (own, other)
    assert chunk_dedup.grown("x ab cde", "x ab cde", 5) == (3, True) and chunk_dedup.grown("xabcdefg", "xabcdefg", 4) == (0, True)


def best_distance(item, text):
    """Least edit distance of the item to any substring of the text (Sellers)."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, x in enumerate(item, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != c)))
        row = new
        best = min(best, row[-1])
    return best


def edited(rng, text, n):
    own = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(own)), rng.randrange(3)
        own[at : at + (kind < 2)] = [] if kind == 0 else [rng.choice("abcxyz")]
    return "".join(own)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    items = [(i, sentence(rng, rng.randint(8, 30), words)) for i in range(12)] + [(50, None), (51, ""), (52, "too short")]
    items += [(53, items[0][1].upper()), (54, words[0]), (55, " ".join(words[:2])), (56, words[3][:2].upper())]
    rows = [(i, sentence(rng, 30, words) + " " + edited(rng, rng.choice(items[:12])[1], rng.randint(0, 12)) + " " + sentence(rng, 20, words)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, items[3][1].replace(" ", "\n  ").title())]
    found = decontamination.find_leaks(clashing(spark, rows), frame(spark, items, "item_id long, text string"), 0.1).collect()
    expected = {}
    for doc_id, text in rows:
        text = decontamination.normalised(text)
        for item_id, item in items:
            item = decontamination.normalised(item)
            if len(item) < decontamination.WHOLE_BELOW:
                if item and re.search(rf"(?<![a-z0-9]){re.escape(item)}(?![a-z0-9])", text):
                    expected[doc_id, item_id] = 0
            elif (d := best_distance(item, text)) <= len(item) // 10:
                expected[doc_id, item_id] = d
    assert {(r["doc_id"], r["item_id"]): r["errors"] for r in found} == expected and len(expected) > 20
    texts = dict(rows)
    for r in found:
        if not r["errors"]:
            span = decontamination.normalised(texts[r["doc_id"]])[r["start"] : r["end"]]
            assert span == decontamination.normalised(dict(items)[r["item_id"]])


def test_short_items_match_as_whole_words(spark):
    items = frame(spark, [(1, "an ox"), (2, "ox"), (3, "(ox)"), (4, " ")], "item_id long, text string")
    rows = [(1, "An  OX runs"), (2, "oxen and a box"), (3, "by (ox) cart"), (4, "an oxen"), (5, "ox"), (6, "a\nnox")]
    found = decontamination.find_leaks(frame(spark, rows), items).collect()
    assert {(r["doc_id"], r["item_id"], r["start"], r["end"]) for r in found} == {
        (1, 1, 0, 5), (1, 2, 3, 5), (3, 2, 4, 6), (3, 3, 3, 7), (5, 2, 0, 2)
    }


def test_decontamination_of_odd_tables(spark):
    items = frame(spark, [(1, "a" * 60), (2, "b" * 60)], "item_id long, text string")
    assert decontamination.find_leaks(frame(spark, []), items).count() == 0
    assert decontamination.find_leaks(frame(spark, [(1, "a" * 60)]), items.limit(0)).count() == 0
    rows = [(None, "a" * 60), (7, "x" + "b" * 60), (7, "b" * 59), (8, "clean"), (9, "ab" * 300_000)]
    whole = decontamination.find_leaks(frame(spark, rows), items)
    blocks = decontamination.find_leaks(frame(spark, rows), items, block_chars=60)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, blocks.collect()), key=repr)
    assert {(r["doc_id"], r["item_id"], r["errors"]) for r in whole.collect()} == {(None, 1, 0), (7, 2, 0)}
    left = decontamination.without_leaks(frame(spark, rows), whole)
    assert sorted(r["doc_id"] for r in left.collect()) == [8, 9]


def test_myers_equals_the_matrix():
    rng = random.Random(11)
    for _ in range(300):
        item = "".join(rng.choice("ab") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))
        got = decontamination.myers(decontamination.peq(item), len(item), text, len(item))
        if text:
            assert min(got[0] if got else len(item), len(item)) == min(best_distance(item, text), len(item))
