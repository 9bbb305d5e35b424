"""License notices against edit distances of all spans of words."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import license_scan as ls

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    words = words_of(text)
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def least_edits(words, notice, k):
    """Fewest edits between the notice and any span of words, None beyond k."""
    best = None
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            span = " ".join(words[i:j])
            if len(span) > len(notice) + k:
                break
            if len(span) >= len(notice) - k and (d := distance(span, notice)) <= k and (best is None or d < best):
                best = d
    return best


def spoil(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + rng.choice("abz ") + text[i:], text[:i] + rng.choice("xyz") + text[i + 1 :]])
    return text


@pytest.mark.parametrize("seed", range(6))
def test_no_place_within_the_bound_is_missed(seed):
    rng = random.Random(seed)
    notices = [("a", "licensed under the apache license"), ("b", "creative commons attribution"), ("c", "redistribution and use in source and binary forms"), ("d", "mit licence")]
    scanner = ls.Scanner(notices)
    for _ in range(60):
        label, text = rng.choice(notices)
        page = " ".join(["some", "words", spoil(rng, text, rng.randint(0, 5)), "the", "license", spoil(rng, rng.choice(notices)[1], rng.randint(0, 3)), "end"])
        folded, n = ls.folded(page)
        words = words_of(page)
        assert folded == f" {' '.join(words)} " and n == len(words)
        found = {}
        for i, a, b, edits in scanner.places(folded):
            assert folded[a - 1] == folded[b] == " " and distance(folded[a:b], notices[i][1]) <= edits <= scanner.notices[i].edits
            found[i] = min(edits, found.get(i, 99))
        for i, (_, notice) in enumerate(notices):
            assert found.get(i) == least_edits(words, notice, len(notice) // 12), (page, notice)


def test_spans_in_words():
    text = "Intro. This is LICENSED under the Apachee  License, version 2. More; Permission is herby granted, free of charge, to any person obtainin a copy of this software and so on. Licensed under CC-BY-NC 4.0"
    hits = ls.Scanner().hits(ls.folded(text)[0])
    words = words_of(text)
    spans = [(label, " ".join(words[at : at + n]), edits) for label, at, n, edits, _ in hits]
    assert spans == [
        ("apache", "licensed under the apachee license", 1),
        ("mit", "permission is herby granted free of charge to any person obtainin a copy of this software", 2),
        ("cc-by-nc", "licensed under cc by nc", 0),
    ]


def test_repeats_and_clean_texts():
    scanner = ls.Scanner()
    assert len(scanner.hits(ls.folded("released under the mit license. " * 3000)[0])) == 3000
    for text in ("a commons attributed to the creative people of the public domain", "the license plate was issued under the law", "driver license", "it is licensed by the state", ""):
        assert scanner.hits(ls.folded(text)[0]) == []


def test_odd_rows(spark, odd, none):
    extra = spark.createDataFrame([(900, "MIT License! mit license mit LICENSE mit"), (901, "The GNU General   Public-License, or\nApache License"), (902, "submit license"), (903, "é" * 70000 + " mit license " + "word " * 50000)], "doc_id long, text string")
    rows = odd.select("doc_id", "text", "label" if "label" in odd.columns else F.col("row")).unionByName(extra, True)
    found = rows.select("*", ls.scan(F.col("text")).alias("f")).select("*", "f.*").collect()
    assert len(found) == rows.count()
    for r in found:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(r["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) or not r["base_labels"]
        assert 0 <= r["score"] <= 1 and (r["score"] == 1) >= (r["n_base"] > 0) and (r["score"] > 0) == bool(r["labels"])
    assert none.select(ls.scan(F.col("text")).alias("f")).count() == 0
