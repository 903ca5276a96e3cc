"""Licence notices in other words, versions and families than those of the test documents."""

import pytest

from cascadia.llm import licenses

GNU = "/* This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU {}General Public License as published by\n * the Free Software Foundation; either version {} of the License, or\n * (at your option) any later version. */"


@pytest.mark.parametrize("text, names", [
    ("Released under the MIT License, see below", ["mit"]),
    ("(Licensed under CC BY-NC 4.0)", ["cc-by-nc-4.0"]),
    ("# Licensed under the Apache License, Version 2.0", ["apache-2.0"]),
    (GNU.format("", 2), ["gpl-2.0"]),
    (GNU.format("", 3), ["gpl-3.0"]),
    (GNU.format("Lesser ", "2.1"), ["lgpl-2.1"]),
    (GNU.format("Lesser ", 3), ["lgpl-3.0"]),
    (GNU.format("Affero ", 3), ["agpl-3.0"]),
    (GNU.format("", 9), []),
    (GNU.format("", 2) + " and then " + GNU.format("", 3), ["gpl-2.0", "gpl-3.0"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License", ["cc-by-sa-3.0"]),
    ("Creative Commons Legal Code CC0 1.0 Universal", ["cc0-1.0"]),
    ("This is free and unencumbered software released into the public domain.", ["unlicense"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["isc"]),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation", ["gpl-3.0"]),
    ("A permission is hereby granted to the reader, who may modify the text at any time.", []),
])
def test_notices(make, text, names):
    got = licenses.scan(make([(1, f"some words before it\n{text}\nand others after it")])).collect()
    assert sorted(r["license"] for r in got) == names


def test_first_word_counts_all_words(make):
    got = licenses.scan(make([(1, "// -- a b\n// Released under the MIT License.")])).collect()
    assert [(r["license"], r["containment"], r["first_word"]) for r in got] == [("mit", 1.0, 5)]
