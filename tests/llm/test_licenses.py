import time

import pytest
from pyspark.sql import functions as F

from paperloom.llm.licenses import TEMPLATES, Scanner, every_text, license_scan

ALL = sorted((k, t.replace("[*]", "the copyright holder")) for k, t in every_text(TEMPLATES))


@pytest.fixture(scope="module")
def scanner():
    return Scanner()


def found(scanner, text):
    return [f.license for f in scanner.document(text)[1]]


@pytest.mark.parametrize("key,template", ALL)
def test_each_template_is_found_in_prose(scanner, key, template):
    text = f"some words before\n{template}\nand after it"
    names = found(scanner, text)
    assert names == [key]
    f = scanner.document(text)[1][0]
    assert text[f.start : f.end].startswith(template.split()[0].rstrip(":")) and f.differences == 0


def test_wording(scanner):
    assert found(scanner, "Licensed under the Apache License, Version 1.1.") == []
    assert found(scanner, "Not licensed under the Apache License, Version 2.0.") == []
    assert found(scanner, "Licensed under CC BY-NC-SA 4.0.") == []
    assert found(scanner, "Licenced under the Apache Licence, version 2.0") == ["Apache-2.0"]
    assert found(scanner, "Released under the MIT License. Licensed under CC BY 4.0.") == ["MIT", "CC-BY-4.0"]
    split = TEMPLATES["Apache-2.0"][1].replace("; ", ";\n").replace("compliance with", "compliance\nwith")
    assert found(scanner, split) == ["Apache-2.0"]
    two = "Copyright (c) X. " + TEMPLATES["BSD-2-Clause"][0] + ": 1. Redistributions of source code must retain the notice. 2. Redistributions in binary form must reproduce it."
    assert found(scanner, two) == ["BSD-2-Clause"] and found(scanner, two + " 3. " + TEMPLATES["BSD-3-Clause"][0].replace("[*]", "X")) == ["BSD-3-Clause"]
    assert found(scanner, "// SPDX-License-Identifier: MIT\nint x;") == ["MIT"] and found(scanner, "SPDX-License-Identifier: GPL-3.0-or-later") == ["GPL-3.0"]
    assert found(scanner, "It is GNU GPL v3 software, not GNU GPL v2.") == ["GPL-3.0"]


def test_ranking_names_the_nearest_template(scanner):
    assert scanner.ranked("this work is licensed under the GNU General Public License, version 3.")[0][1].license == "GPL-3.0"


@pytest.mark.parametrize("key,template", [x for x in ALL if "SPDX" not in x[1]])
def test_wrapped_at_any_word(scanner, key, template):
    words = template.split()
    for i in range(1, len(words)):
        text = "before it\n" + " ".join(words[:i]) + "\n" + " ".join(words[i:]) + "\nafter it"
        assert found(scanner, text) == [key]
    assert found(scanner, "\n".join(["before", *words, "after"])) == [key]


def test_long_lines_of_prose(scanner, spark):
    """In a long line of other words a dictionary saves nothing; the notice is still found."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    prose = " ".join(x for r in docs for line in (r.text or "").split("\n") if not scanner.document(x := line)[0])
    assert len(prose) > 20_000
    for size in (5_000, 20_000):
        for key, template in ALL:
            assert found(scanner, f"{prose[: size // 2]} . {template} {prose[size // 2 : size]}") == [key]


def test_repeated_notices_take_time_in_proportion(scanner):
    line = "Licensed under the Apache License, Version 2.0. Some words follow.\n"
    clock = []
    for n in (500, 4000):
        began = time.process_time()
        assert found(scanner, line * n) == ["Apache-2.0"] * n
        clock.append(time.process_time() - began)
    assert clock[1] < 16 * clock[0]


def test_a_denied_notice_hides_no_other(scanner):
    assert found(scanner, "Not released under the MIT License. Later: released under the MIT License.") == ["MIT"]


def test_planted_lines_equal_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = {"Apache-2.0": "Licensed under the Apache License, Version 2.0", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0", "MIT": "Released under the MIT License", "GPL-3.0": "licensed under the GNU General Public License, version 3"}
    got = {r.doc_id: r.licenses for r in license_scan(docs).collect()}
    assert got == {r.doc_id: ",".join(sorted(k for k, v in plain.items() if v in r.text)) for r in docs.collect()}


def test_edges(spark, documents, edge_texts):
    texts = edge_texts + [(9, "word " * 30_000 + "released under the MIT License. " + "word " * 30_000)]
    got = sorted([(r.doc_id, r.n_findings, r.licenses) for r in license_scan(documents(texts).withColumn("licenses", F.lit(0))).collect()], key=repr)
    assert got == sorted([(i, int(i == 9), "MIT" if i == 9 else "") for i, _ in texts], key=repr)
    assert license_scan(documents([])).count() == 0


FSF = "is free software{} you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: (1) x. (2) y. Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["BSD-3-Clause"]),
        ("Neither the name of the University of California, Berkeley and its regents nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["BSD-3-Clause"]),
        ("Neither the name of " + "very " * 20 + "long nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", []),
        ("This library " + FSF.format(";", "Lesser General Public License", "2.1"), ["LGPL-2.1"]), ("Foo " + FSF.format(":", "General Public License", "3"), ["GPL-3.0"]),
        ("THIS PROGRAM " + FSF.format(";", "General Public License", "2").upper(), ["GPL-2.0"]), ("It is licensed under the MIT license.", ["MIT"]),
        ("MIT License\n\nCopyright (c) 2020 A. Body\n", ["MIT"]), ("Licensed under the Apache License 2.0", ["Apache-2.0"]), ("Distributed under the terms of the BSD 3-Clause License", ["BSD-3-Clause"]),
        ("SPDX-License-Identifier: (MIT OR Apache-2.0)", ["MIT", "Apache-2.0"]), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND ISC // MIT", ["GPL-2.0", "ISC"]),
        ("not licensed under the MIT license", []), ("Unlike the MIT license, ours is stricter.", []),
    ],
)
def test_holes_names_and_expressions(scanner, text, expected):
    assert found(scanner, "Some words first. " + text + " And more.") == expected


def test_windows_that_are_left_out_hold_no_notice():
    """The rank excludes nothing that the alignment would confirm: all windows aligned, or only those."""
    import random

    rng = random.Random(3)
    ranking, every = Scanner(), Scanner()
    every.candidate = lambda words, template: True
    filler = "license of the under this software free permission name copyright public version source use that x 2.0 3 mit gnu".split()
    asked = [0, 0]
    inner = ranking.candidate
    for _ in range(150):
        key, template = rng.choice(ALL)
        words = template.split()
        for _ in range(rng.randrange(3)):  # loose words out or in, here and there
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(2)] = rng.choice([[], ["the"], ["this", "work"]])
        around = [rng.choice(filler) for _ in range(rng.randrange(80))]
        cut = rng.randrange(len(around) + 1)
        text = " ".join(around[:cut] + words + around[cut:])
        text = text.upper() if rng.random() < 0.2 else text

        def counted(w, t):
            good = inner(w, t)
            asked[good] += 1
            return good

        ranking.candidate = counted
        assert ranking.document(text) == every.document(text), (key, text)
    assert asked[0] > 0
