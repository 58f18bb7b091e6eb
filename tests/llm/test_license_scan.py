import re

from loomspan.llm import license_scan
from loomspan.llm.common import WORD


def brute(text):
    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_awkward_rows_equal_brute_force(awkward, empty):
    texts = {r.doc_id: r.text for r in awkward.collect()}
    got = license_scan.scan(awkward).collect()
    assert len(got) == awkward.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert 0 <= r.score <= 1
    assert license_scan.scan(empty).collect() == []


def test_places_labels_and_scores(spark):
    texts = [
        "x CC-BY y cc by cc BY", "by cc", "GENERAL public-license of it", "All rights reserved. all rights RESERVED",
        "Some words. This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        "Licensed under the Apache License, Version 2.0.", "license apache the under licensed 0 2 version", "the public license reserved", "cc " * 50 + "by " * 50,
    ]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == brute(text)
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))
    assert "gpl-3" in got[4].labels.split(",") and "gpl-2" not in got[4].labels.split(",")
    assert got[5].labels == "cc-by,cc-by-nc-4.0" and got[6].labels == "apache-2.0" and got[6].score >= 0.6
    assert got[7].labels == "" and got[8].labels == ""
    assert [got[i].score for i in (0, 3, 7, 8, 9)] == [1.0, 1.0, 0.0, 0.0, 1.0]


def test_scores_tell_whole_from_part_and_from_none(spark):
    mit = license_scan.TEMPLATES["mit"][0].split()
    cut = " ".join(mit[:12] + ["xx"] * (len(mit) - 17) + mit[-5:])
    texts = [" ".join(mit), cut, "plain words of no licence", "", None, "SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: GPL-3.0-only", "spdx license", "identifier of a license: mit spdx"]
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == ("mit", 1.0) and got[1][0] == "mit" and license_scan.ENOUGH <= got[1][1] < 1
    assert [got[i] for i in (2, 3, 4, 7, 8)] == [("", 0.0)] * 5
    assert got[5] == ("mit", 1.0) and got[6] == ("gpl-3", 1.0)


def test_a_file_that_joins_several_licences_has_all_their_labels(spark):
    """The labels of a text don't depend on how many licence words stand before."""
    joined = ". ".join(opening for opening, _ in license_scan.TEMPLATES.values())
    first = ". ".join(license_scan.TEMPLATES[k][0] for k in ("mit", "bsd"))
    texts = [joined, first + ". All rights reserved. This work is licensed under the GNU General Public License version 3"]
    got = {r.doc_id: r.labels.split(",") for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    alone = {k: v for k, v in license_scan.TEMPLATES.items() if "#" not in k}
    assert {k for k, (opening, phrases) in alone.items() if all(f" {p} " in f" {opening} " for p in phrases)} <= set(got[0])
    assert {"mit", "bsd", "gpl-3"} <= set(got[1])
