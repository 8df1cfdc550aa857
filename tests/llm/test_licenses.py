"""Neighbours of the licence lines: variants that differ by a word or a version."""

from __future__ import annotations

import pytest

from hitweave.llm import licenses

CASES = {
    "Licensed under CC BY 4.0": "cc-by",
    "Licensed under CC BY-SA 4.0": "cc-by-sa",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Licensed under CC BY-NC-SA 3.0": "cc-by-nc-sa",
    "Licensed under CC BY-SA 2.5": "cc-by-sa",
    "Licensed under CC0 1.0": "cc0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License": "cc-by-nd",
    "This work is licensed under the GNU Affero General Public License, version 3": "agpl",
    "licensed under the table of the house": "",
}


@pytest.mark.parametrize("line", CASES)
def test_neighbours(line):
    labels = {s[0] for s in licenses.scanner().scan(f"some words before. {line}. Some words after.")[2]}
    assert ",".join(sorted(labels)) == CASES[line]


def test_short_matches_join_a_chain():
    own = licenses.Scanner([("x", "a b c d e f g h i j")], [])
    (_, start, end, covered), = own.scan("a b c d zz e f yy g h")[2]
    assert (start, end, covered) == (0, 10, 0.8)
    assert not own.scan("a b zz c d yy e f xx g h")[2]
