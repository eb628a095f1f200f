"""Repeated edited notices against the alignment of every window."""

from __future__ import annotations

import random

from kartlens.llm import license_scan
from kartlens.llm.common import words_alnum

BSD = words_alnum(license_scan.TEMPLATES["bsd"].encode())


def brute_best(text: list, template: list) -> float:
    size = len(template)
    ends = [(a, b) for a in range(len(text)) for b in range(a + 1, min(len(text), a + 2 * size) + 1)]
    return max(len(license_scan.align(text[a:b], template)) for a, b in ends) / size if ends else 0.0


def test_missing_word_stands_elsewhere():
    edited = [w for w in BSD if w != b"provided"]
    for copies in (1, 2, 5):
        for text in ([b"provided", b"x", *edited * copies], [*edited * copies, b"x", b"provided"]):
            share, first, last = license_scan.coverage(text, BSD)
            assert share >= 20 / 21 and last - first < 2 * len(BSD)


def test_scan_reports_repeated_edited_notice(spark):
    edited = " ".join(w.decode() for w in BSD if w != b"provided")
    rows = [(1, f"provided {'as is ' * 90}{edited} and more {edited}"), (2, "provided " * 30 + edited[:60])]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["license"] == "bsd" and got[1]["licenses"] == ["bsd"] and got[2]["license"] is None


def test_windows_reach_the_brute_force_best():
    rng = random.Random(5)
    template = "a b c a d e f b g h i j".split()
    reached = 0
    for _ in range(150):
        text = [rng.choice(template) for _ in range(rng.randrange(3))]
        for _ in range(rng.randrange(1, 4)):
            notice = list(template)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(notice))
                notice[k : k + rng.randrange(2)] = rng.choice([[], ["x"], [rng.choice(template)]])
            text += notice + [rng.choice(["x", "y", *template]) for _ in range(rng.randrange(3))]
        want = brute_best(text, template)
        got = license_scan.coverage(text, template, 0.75)[0]
        assert (got >= 0.75) == (want >= 0.75)
        assert want < 0.75 or got == want
        reached += want >= 0.75
    assert reached > 50


def test_scattered_words_are_no_notice(spark):
    notices = ["Released under the MIT License", "licensed under cc by 4 0", license_scan.TEMPLATES["bsd"]]
    rows = [(i, " filler words of no meaning ".join(n.split())) for i, n in enumerate(notices)]
    rows += [(i + 10, f"{t} and then {notices[i]} end") for i, t in rows]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: None, 1: None, 2: None, 10: "mit", 11: "cc-by-4.0", 12: "bsd"}


def test_every_template_is_found_in_a_text_of_its_own(spark):
    rows = [(i, f"x y z # {t} // z y x") for i, t in enumerate(license_scan.TEMPLATES.values())]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(license_scan.TEMPLATES):
        assert got[i]["license"] == name and got[i]["coverage"] == 1.0 and got[i]["first_word"] == 3, name
