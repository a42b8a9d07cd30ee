from __future__ import annotations

import random
import re
import textwrap

import pytest

from logweave.llm.license_scan import CUE, MOST, WORDS_FOR_ONE, Templates, aligned, blocks, differences, license_scan, notices, words_of
from logweave.llm.license_texts import TEMPLATES, TEXTS, TITLES
from tests.llm.fixtures import documents

MIT = """MIT License

Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def edits(template, block):
    """Brute force: word edits from the template to each run of the block."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    return min(distance(template, block[i:j]) for i in range(len(block) + 1) for j in range(i, len(block) + 1))


@pytest.mark.parametrize("block", ["", "under the mit", "x released the under mit license y", "released under the mit license", "a b c d e f"])
def test_differences_equal_brute_force(block):
    t = "released under the mit license".split()
    assert differences(t, block.split())[0] == edits(t, block.split())
    price, a, b = aligned(t, block.split())
    assert price == edits(t, block.split()) == edits(t[::-1], block.split()[a:b][::-1])


def names(text):
    return [n for n, _ in notices(text)[1]]


def test_each_template_has_a_cue_and_finds_itself():
    for name, text in TEMPLATES:
        assert re.search(CUE, text), text
        assert names(f"Notice: this work is {text}. All of it.") == [name], text
        assert names("Words before\n" + textwrap.fill(text, 30, initial_indent=" * ", subsequent_indent=" * ", break_long_words=False) + "\nand after") == [name], text


def test_other_versions_and_other_words_do_not_hold():
    assert names("licensed under the Apache License, Version 3.0") == names("licensed under the Apache License, Version 2.1") == []
    assert names("licensed under the GNU General Public License, version 2") == ["GPL-2.0"]
    assert names("you need a driving license to park here") == names("SPDX-License-Identifier: none") == []


def test_notices_as_they_are_written():
    assert names(MIT) == ["MIT"]
    assert names("SPDX-License-Identifier: Apache-2.0") == ["Apache-2.0"]
    assert names("GNU General\nPublic License, version 3") == [] and names("under the GNU General\nPublic License, version 3") == ["GPL-3.0"]
    assert names("Released under the MIT License. Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0", "MIT"]
    assert names("// SPDX-License-Identifier: GPL-2.0-or-later\n// SPDX-License-Identifier: CC-BY-SA-4.0") == ["CC-BY-SA-4.0", "GPL-2.0"]
    assert names("Licensed under the GNU GPL v3.0 or, at your choice, under the terms of the Mozilla Public Licence version 2") == ["GPL-3.0", "MPL-2.0"]
    two, three = (dict(TEXTS)[n] for n in ("BSD-2-Clause", "BSD-3-Clause"))
    assert names(two) == ["BSD-2-Clause"] and names(three) == ["BSD-3-Clause"]
    assert names(three.replace("copyright holder", "University of Somewhere")) == ["BSD-3-Clause"]
    assert names(f"{MIT}\n\n---\n\n{three}\n\n{MIT}") == ["BSD-3-Clause", "MIT", "MIT"]


def brute(text, planted):
    """Every template that has a run within its bound, whatever its block, less those whose words lie in a longer notice that was planted."""
    words = words_of(text)[0]
    return [name for name in planted if any(n == name and edits(w, words) <= len(w) // WORDS_FOR_ONE for n, t in TEMPLATES if len(w := words_of(t)[0]) < 14)]


@pytest.mark.parametrize("seed", range(4))
def test_random_wrapped_and_mixed_texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfghjklmnprstw") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    short = [t for t in TEMPLATES if len(t[1]) < 90]
    for _ in range(6):
        planted = rng.sample(short, rng.randint(0, 3)) + rng.sample(TEXTS, rng.randint(0, 1))
        body = "\n".join([prose(rng.randrange(400)), *(f"{t}. {prose(rng.randrange(30))}" for _, t in planted), prose(40)])
        text = textwrap.fill(body, rng.choice([30, 60, 200]), break_long_words=False)
        assert names(text) == sorted(n for n, _ in planted), text
        few = [n for n, t in planted if len(t) < 90]
        near = " ".join(words_of(text)[0][-45:]) if few else ""
        assert sorted(brute(near, [n for n in few if n in names(near)])) == sorted(n for n in few if n in names(near))


@pytest.mark.parametrize("length", [300, 500, 800])
def test_verbatim_notices_in_long_varied_lines_hold(length):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n // 6))
    for name, text in TEMPLATES[:40]:
        assert names(f"{prose(length // 2)} {text}. {prose(length // 2)}") == [name]


def test_blocks_are_bounded_and_lose_no_notice():
    text = " ".join(f"b{i}" for i in range(50)) + "\n\n   License " + "\n".join(f"c{i}" for i in range(50))
    assert blocks(text, 2) == [(48, ["b48", "b49", "license", "c0", "c1"])]
    assert blocks("x license y z license w", 2) == [(0, ["x", "license", "y", "z", "license", "w"])] and blocks("x sublicensed y", 1) == [(0, ["x", "sublicensed", "y"])]
    assert blocks("nothing", 3) == blocks("", 3) == []
    reach = Templates().reach
    many = "copyright holder " * 30_000
    assert max(len(w) for _, w in blocks(many, reach)) <= MOST * reach
    rows = notices("copyright holder and so on " * 400 + "Released under the MIT License. " + "copyright " * 900 + MIT * 3)
    assert [n for n, _ in rows[1]] == ["MIT"] * 4 and rows[0] > 3


def test_table(spark):
    bodies = [None, "", "nothing", "text\nThis work is licensed under the GNU General Public License, version 3.\nmore", "Released under the MIT License. Licensed under CC BY-NC 4.0.", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", "word " * 9000 + "Released under the MIT License.", "Released under the MIT License.\n" + "word " * 900 + MIT]
    ids = [0, 1, 2, 3, 4, 5, 6, 7]
    rows = {r.doc_id: (r.n_blocks, r.licenses, r.n_notices) for r in license_scan(documents(spark, bodies, ids)).collect()}
    assert rows[0] == rows[1] == rows[2] == (0, None, 0)
    assert rows[3] == (1, "GPL-3.0", 1)
    assert rows[4] == rows[5] == (1, "CC-BY-NC-4.0,MIT", 2) and rows[6] == (1, "MIT", 1) and rows[7] == (2, "MIT", 2)
    assert license_scan(documents(spark).limit(0)).collect() == []
    same = license_scan(documents(spark, [MIT, MIT, None], [None, None, None])).collect()
    assert sorted((r.doc_id, r.licenses or "") for r in same) == [(None, ""), (None, "MIT"), (None, "MIT")]


def test_every_title_is_known():
    assert {n for n, _ in TEMPLATES} == set(TITLES)
