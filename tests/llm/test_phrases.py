"""Phrase collocations against plain counting, with several waves and with odd texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from crosstally.llm import phrases

SCHEMA = "doc_id long, lang string, text string, h int, n int, word string, w1 int, bar int, score int"


def by_hand(rows, top, least):
    f, sizes = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for m in (1, 2, 3, 4):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    candidates = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    covered = set()
    for (lang, p), a in candidates.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inner = lang, p[i : i + m]
                if 100 * a >= 80 * f[inner]:
                    covered.add(inner)
    found = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in covered:
            cuts = [(f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min((2_000_000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(cuts))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, sizes[lang], -score)
        for lang, some in found.items()
        for rank, (score, a, p, l, r) in enumerate(sorted(some)[:top], 1)
    )


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Über", "a\x1cb", "x y", " "]
    rows = []
    for nth in range(160):
        parts = []
        for _ in range(rng.randint(1, 6)):
            start = rng.randrange(len(words))
            run = [words[(start + i) % len(words)] for i in range(rng.randint(1, 9))]
            if rng.random() < 0.4:
                run = [rng.choice(words) for _ in run]
            parts.append(rng.choice((" ", "\t", "  ")).join(run))
        rows.append((rng.choice(("en", "en", "de", None, "")), rng.choice((". ", "\n", "!", ", ")).join(parts)))
    return rows + [("en", "tip top " * 40), ("en", None), ("de", ""), (None, " \t.,"), ("xx", "one two"), ("en", "W1 W2. w3")] + [
        ("de", "same old song again")
    ] * 50


def mined(spark, rows, **options):
    wide = [(i, lang, text, 1, 2, "x", 3, 4, 5) for i, (lang, text) in enumerate(rows)]
    df = phrases.collocations(spark.createDataFrame(wide, SCHEMA), **options)
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("top, batch", [(2000, 65_536), (3, 60)])
def test_against_counting(spark, top, batch):
    rows = corpus(top)
    assert mined(spark, rows, top=top, least=8, batch=batch) == by_hand(rows, top, 8)


def test_bounded_tables_of_words(spark, monkeypatch):
    rows = corpus(7)
    monkeypatch.setattr(phrases, "_TOKENS", 50)
    monkeypatch.setattr(phrases, "_SLICE", 20)
    monkeypatch.setattr(phrases, "FILTER_BITS", 32_768)
    assert mined(spark, rows, top=50, least=8) == by_hand(rows, 50, 8)


def test_a_very_long_text(spark):
    rows = [("en", "red green blue. " * 80_000)]
    assert mined(spark, rows) == [("en", 1, "red green blue", 80_000, 80_000, 80_000, 240_000, 1_000_000)]


def test_no_rows(spark):
    assert mined(spark, []) == []
