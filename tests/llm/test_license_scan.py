"""License scan against a walk over the words."""

import re

import pytest

from gaugewatch.llm import license_scan

TEXTS = [
    (1, "Licensed under CC BY-NC 4.0."), (2, None), (3, ""), (4, "ALL RIGHTS reserved; all rights. Reserved all Rights reserved"),
    (5, "This work is licensed under the GNU General Public License, version 3."), (6, "cc by cc by cc cc by"),
    (7, "Licensed under the fine Apache License, Version 2.0"), (8, "all rights are reserved"), (None, "General  Public\nLicense"),
    (8, "all rights are reserved"), (9, "CCéBY cc é by ccby"), (10, "the the the license " * 50), (11, "Released under MIT License"),
]


def words_of(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_against_walk(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, label string, row int")
    got = sorted((tuple(r) for r in license_scan.scan(docs).collect()), key=str)
    assert len(got) == len(TEXTS)
    base = []
    for doc_id, text in TEXTS:
        words = words_of(text)
        places = [(i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        base.append((doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in places}))))
    assert sorted((g[:6] for g in got), key=str) == sorted(base, key=str)
    labels = {g[0]: g[6:] for g in got}
    assert labels[1] == ("cc-by,cc-by-nc-4.0", 1.0)
    assert labels[5][0] == "gnu-gpl,gpl"
    assert labels[7][0] == "apache-2.0" and 0.7 <= labels[7][1] < 1
    assert labels[8] == ("", 0.0) and labels[10] == ("", 0.0) and labels[3] == ("", 0.0)


def share_by_loops(words, phrase):
    """Best span: matches on diagonals no more than the reach apart, the longest run that ascends in both."""
    template = phrase.split()
    n = len(template) - 1
    matches = [(p, i) for i in range(len(words) - 1) for p in range(n) if words[i : i + 2] == template[p : p + 2]]
    best = 0
    for first in {i - p for p, i in matches}:
        own = sorted(m for m in matches if first <= m[1] - m[0] <= first + 2 + n // 10)
        longest = {}
        for p, i in own:
            longest[p, i] = 1 + max((k for (q, j), k in longest.items() if q < p and j < i), default=0)
        best = max(best, *longest.values())
    return best / n if best >= license_scan.SHARE * n else 0.0


SPANS = [
    "the mit license mit license", "released under the mit license mit license mit license", "released under mit the license license",
    "license mit the under released", "released under the very mit license", "released released under under the the mit mit license license",
    "this source code form is really subject to all the terms of the public mozilla public license",
    "redistribution and use in source and binary forms with or without any modification are permitted",
    "permission is hereby granted to any person obtaining a copy of this software",
    " ".join(["licensed under cc by nc 4 0 and"] * 40), "licensed under cc by sa 4 0 or licensed under cc by nc 4 0",
]


def test_labels_and_scores_by_loops(spark):
    docs = spark.createDataFrame(list(enumerate(SPANS)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(docs).collect()}
    for k, text in enumerate(SPANS):
        words = words_of(text)
        base = {label for phrase, label in license_scan.BASE if f" {phrase} " in f" {' '.join(words)} "}
        shares = [share_by_loops(words, phrase) for phrase, _ in license_scan.NOTICES]
        best = max([*shares, 1.0 if base else 0.0])
        own = {label for phrase, label in license_scan.NOTICES if share_by_loops(words, phrase)}
        assert got[k] == (",".join(sorted(base | own)), pytest.approx(best)), text
    assert got[0] == ("", 0.0) and got[1] == ("mit", 1.0) and got[3] == ("", 0.0)


def test_notices_of_a_table(spark):
    """A long text is found with words put in and left out, and not in pieces that are out of order."""
    long = [f"w{i}" for i in range(300)]
    changed = long[:50] + ["by", "some", "body"] + long[50:140] + long[143:220] + ["x"] * 9 + long[220:]
    shuffled = long[200:] + long[100:200] + long[:100]
    notices = spark.createDataFrame([("long", " ".join(long)), ("none", None), (None, "two words"), ("one", "word"), ("long", " ".join(long))], "label string, text string")
    docs = spark.createDataFrame([(1, "a b " + " ".join(changed)), (2, " ".join(shuffled)), (3, None), (4, "released under the mit license cc by")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs, notices).collect()}
    assert got[1].labels == "long" and 0.9 < got[1].score < 1
    assert got[2].labels == "" and got[3].labels == "" and got[4].labels == "cc-by"


def test_empty_table(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|InArrow", plan)
