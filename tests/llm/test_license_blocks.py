"""Wrapped notices, blocks with several licences and notices in long blocks."""

import random

import pytest

from lexspark.llm import license_scan

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\n{0}of this software and associated documentation files (the \"Software\"), to deal"
BSD = "Redistribution and use in source and binary forms, with or without\n{0}modification, are permitted provided that the following conditions\n{0}are met:"
GPL = "it under the terms of the GNU General Public License as published by the Free\n{0}Software Foundation, either version 3 of the License, or (at your\n{0}option) any later version."
CC0 = "To the extent possible under law,\n{0}the author has waived all copyright and related or\n{0}neighboring rights to this work."
FOUR = "\n".join(f"SPDX-License-Identifier: {x}" for x in ("MIT", "Apache-2.0", "MPL-2.0", "BSD-3-Clause"))
FAR = "This license covers " + "words of the license that say nothing in particular " * 60


def _found(scanner, text):
    return {x["license"] for b in scanner.blocks(text) for x in scanner.scan(b)}


def test_wrapped_notices():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for notice, name in ((MIT, "MIT"), (BSD, "BSD-3-Clause"), (GPL, "GPL-3.0"), (CC0, "CC0-1.0")):
        for mark in ("", "# ", " * "):
            text = "Some code.\n\n" + mark + notice.format(mark) + "\n\nmore words that follow\n" * 3
            assert _found(scanner, text) == {name}, (name, mark)
    assert _found(scanner, MIT.format("").replace("Permission is hereby", "Permission is\nhereby")) == {"MIT"}
    assert _found(scanner, GPL.format("").replace("version 3", "version 2")) == {"GPL-2.0"}


def test_all_licences_of_a_block():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    assert _found(scanner, FOUR) == {"MIT", "Apache-2.0", "MPL-2.0", "BSD-3-Clause"}


def test_changed_first_words_in_a_long_block():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    notice = license_scan.TEMPLATES["BSD-3-Clause"][0].replace("Redistribution and use", "Copying or reuse")
    assert _found(scanner, notice + " license") == _found(scanner, FAR + notice + " license") == {"BSD-3-Clause"}


def test_saving_does_not_depend_on_the_length_of_a_block():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    lines = [f"Copyright {1900 + i % 100} by holder number {i * 7919 % 1000}" for i in range(3000)]
    notice = license_scan.TEMPLATES["Apache-2.0"][1].replace("Licensed under the", "Licenced by the")
    for at in (0, 1500, 3000):
        assert _found(scanner, "\n".join([*lines[:at], notice, *lines[at:]])) == {"Apache-2.0"}


def test_four_tags_with_other_licences():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    names = ("MIT", "MPL-2.0", "CC0-1.0", "BSD-3-Clause")
    assert _found(scanner, "\n".join(f"SPDX-License-Identifier: {x}" for x in names)) == set(names)


@pytest.mark.parametrize(
    "text, names",
    [
        ("SPDX-License-Identifier: GPL-3.0-or-later", {"GPL-3.0"}), ("// SPDX-License-Identifier: GPL-2.0-only", {"GPL-2.0"}), ("SPDX-License-Identifier: BSD-2-Clause", {"BSD-2-Clause"}), ("SPDX-License-Identifier: MIT OR Apache-2.0", {"MIT", "Apache-2.0"}),
        ("# SPDX-License-Identifier: (LGPL-2.1-only AND CC-BY-SA-4.0) OR GPL-2.0 WITH Classpath-exception-2.0", {"LGPL-2.1", "CC-BY-SA-4.0", "GPL-2.0"}), ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", {"Apache-2.0"}), ("it is licensed under the Apache-2.0 license", {"Apache-2.0"}),
        ("MIT License\n\nCopyright (c) 2020 X", {"MIT"}), ("Licensed under the Boost Software License, Version 1.0.", {"BSL-1.0"}), ("released under the BSD 3-Clause License", {"BSD-3-Clause"}), ("Licensed under the Apache License, Version 1.1.", set()), ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", {"GPL-3.0"}),
        ("Distributed under the Mozilla Public License Version 2.0", {"MPL-2.0"}), ("Licensed under CC BY-NC-SA 4.0.", {"CC-BY-NC-SA-4.0"}), ("a license to kill and a licence for nothing", set()), ("SPDX-License-Identifier: NONE", set()), ("Use and copying of this software, MIT or not, is permitted", set()),
    ],
)
def test_names_and_expressions(text, names):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for around in ("", "words that come before it\n"):
        assert _found(scanner, around + text) == names


def test_a_name_in_each_notice():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    assert len(license_scan.TEMPLATES) >= 50
    for name, notices in license_scan.TEMPLATES.items():
        for notice in notices:
            assert name in _found(scanner, "x\n" + notice + "\ny license"), (name, notice)


def test_against_all_places_of_all_notices():
    """The scan gives what a comparison of every notice with every place of the whole text gives."""
    rnd = random.Random(9)
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    filler = "some words that say nothing about terms in any way and go on for a while".split()
    for _ in range(40):
        lines = [" ".join(rnd.choices(filler, k=rnd.randint(0, 30))) for _ in range(rnd.randint(1, 12))]
        for _ in range(rnd.randint(0, 3)):
            words = rnd.choice(license_scan.TEMPLATES[rnd.choice(list(license_scan.TEMPLATES))]).split()
            for _ in range(rnd.randint(0, 1 + len(words) // 10)):
                words[rnd.randrange(len(words))] = rnd.choice(filler)
            lines.insert(rnd.randint(0, len(lines)), " ".join(words))
        text = "\n".join(lines)
        whole = license_scan._words(text)
        want = {k for k, v in scanner.notices.items() for n in v if license_scan._differences(n, whole) is not None}
        assert _found(scanner, text) == want
