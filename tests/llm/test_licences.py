"""License scans: each template is found, in altered layout too, and differences are told apart."""

import random

import pytest

from brindle.llm.licences import MOST_DIFFERENT, TEMPLATES, candidate_blocks, differences, ranked_templates, scan_licences, scan_text, words_of
from tests.llm.cases import frame, tables, words


def test_every_template_is_found_among_other_text():
    for name, text in TEMPLATES.items():
        lines = "\n".join(" ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
        for wording in (text, lines, text.upper()):
            whole = words(1, 50) + "\n" + wording + "\n" + words(2, 50)
            found = scan_text(whole)
            assert [f["license"] for f in found] == [name], name
            assert found[0]["missing"] == 0
            span = whole[found[0]["start"] : found[0]["end"]]
            assert words_of(span) == words_of(text)


def test_reduction_ranks_the_right_template_first():
    for name in ("MIT", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "ISC"):
        assert ranked_templates(TEMPLATES[name])[0][1] == name


def test_versions_and_variants():
    assert [f["license"] for f in scan_text("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0-notice"]
    assert [f["license"] for f in scan_text("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0-notice"]
    changed = TEMPLATES["MIT"].replace("free of charge", "for a fee")
    (found,) = scan_text(changed)
    assert found["license"] == "MIT" and found["missing"] > 0
    assert scan_text("All rights reserved. No permission is given, and no license at all, for anything in here.") == []


def test_several_in_one_block():
    text = "Released under the MIT License.\nLicensed under CC BY-NC 4.0.\n" + TEMPLATES["GPL-3.0"] + "\nLicensed under the Apache License, Version 2.0."
    assert [f["license"] for f in scan_text(text)] == ["MIT-notice", "CC-BY-NC-4.0-notice", "GPL-3.0", "Apache-2.0-notice"]


def test_differences():
    assert differences("a b c d".split(), "x a b y c d z".split()) == (0, 1, 1, 6)
    assert differences("a b".split(), "c".split()) == (2, 0, 0, 0)
    assert words_of("The MIT-License (v2.0), it's") == ["the", "mit-license", "v2.0", "it's"]


def test_blocks_cover_cues_wherever_they_are():
    text = "x " * 40_000 + "Released under the MIT License." + " y" * 40_000
    (block,) = candidate_blocks(text)
    assert block[0] < 80_000 < block[1] and block[1] - block[0] < 2000
    assert candidate_blocks("İİİ license İ") == [(0, 13)]


def test_rows(spark):
    for df, rows in tables(spark):
        got = scan_licences(df).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        assert all(r.found == [] and r.license is None for r in got)
    rows = [(1, "a\nReleased under the MIT License.\nb", "en", "s", 1), (1, "a\nReleased under the MIT License.\nb", "en", "s", 1)]
    assert [r.license for r in scan_licences(frame(spark, rows)).collect()] == ["MIT-notice"] * 2


def test_wordings_inside_long_lines_and_blocks():
    prose = [words(k, 400, 500) for k in range(4)]
    for name, text in TEMPLATES.items():
        for before, after in ((prose[0][:400], prose[1][:400]), (prose[0], prose[1])):
            whole = before + " " + text + " " + after
            (found,) = scan_text(whole)
            assert (found["license"], found["missing"], found["extra"]) == (name, 0, 0)
            assert words_of(whole[found["start"] : found["end"]]) == words_of(text)
        # Lines with cues 300 characters apart are one block, with all the prose between them.
        between = "\n" + prose[2][:300] + "\n"
        whole = "All copyright lies with us." + between + text + between + "No warranty at all."
        assert [f["license"] for f in scan_text(whole)] == [name]
    # Cue words throughout, and more templates alike than a short ranking holds.
    cued = "\n".join(words(k, 30) + " license " + words(k + 50, 30) for k in range(40))
    notices = [n for n in TEMPLATES if n.endswith("notice")]
    whole = cued + "\n" + ("\n" + cued + "\n").join(TEMPLATES[n] for n in notices) + "\n" + cued
    assert [f["license"] for f in scan_text(whole)] == notices


def test_a_near_wording_is_not_hidden_by_another():
    altered = TEMPLATES["ISC"].split()
    altered[5::18] = ["other"] * len(altered[5::18])
    whole = " ".join(altered) + " " + TEMPLATES["MIT"] + " " + TEMPLATES["ISC"]
    assert [f["license"] for f in scan_text(whole)] == ["ISC", "MIT", "ISC"]


@pytest.mark.parametrize("lines", [0, 1, 20, 80, 1000])
def test_wordings_between_cue_lines(lines):
    cues = [f"{words(k, 6)} license {words(k + 7, 5)} warranty" for k in range(lines)]
    for name, text in TEMPLATES.items():
        whole = "\n".join([*cues, text, *cues[::-1]])
        (found,) = scan_text(whole)
        assert (found["license"], found["missing"], found["extra"]) == (name, 0, 0)
        assert words_of(whole[found["start"] : found["end"]]) == words_of(text)


def least_differences(template, words):
    """Fewest words missing from or extra in any stretch of the words, by dynamic programming over all places."""
    row = [0] * (len(words) + 1)  # a stretch may begin anywhere
    for i, t in enumerate(template, 1):
        new = [i]
        for j, w in enumerate(words, 1):
            new.append(row[j - 1] if t == w else min(row[j], new[j - 1]) + 1)
        row = new
    return min(row)  # and end anywhere


def test_recall_against_every_template_everywhere():
    """Altered wordings in prose: what brute force confirms is found, and what it rules out is not reported."""
    r = random.Random(11)
    planted = found = told = 0
    for name, text in TEMPLATES.items():
        own = words_of(text)
        for trial in range(12):
            altered = own[:]
            for _ in range(r.randrange(int(len(own) * 0.25) + 1)):
                i = r.randrange(len(altered))
                altered[i : i + 1] = r.choice([[], [f"z{r.randrange(9)}"], [altered[i], f"z{r.randrange(9)}"]])
            whole = f"{words(trial, 30)} license {words(trial + 99, 12)} {' '.join(altered)} {words(trial + 50, 30)}"
            # Fewest differences of a replaced word are two: one missing, one extra.
            right = {n for n, t in TEMPLATES.items() if least_differences(words_of(t), words_of(whole)) <= MOST_DIFFERENT * len(words_of(t))}
            got = {f["license"] for f in scan_text(whole)}
            assert got <= right
            planted += bool(right)
            found += bool(got)
            told += name in right and name in got
    # All are found; one in ten as a variant of the same wording that differs by no more.
    assert planted == found == 100 and told >= 90
