import random

import pytest

from anamnesis.llm import licenses


@pytest.fixture(scope="module")
def index():
    return licenses.Index(licenses.TEMPLATES)


def _names(index, text):
    return [m[0] for m in licenses.find(index, text)]


def test_drift_along_a_chain_is_followed(index):
    words = licenses.TEMPLATES["Apache-2.0 (header)"].split()
    for step in (7, 9, 12):
        lines = [" ".join(words[at : at + step]) for at in range(0, len(words), step)]
        text = "\n".join(f"{40 + n}: REM {line}" for n, line in enumerate(lines))
        ((name, coverage, start, end),) = licenses.find(index, text)
        assert name == "Apache-2.0 (header)" and coverage > 0.95 and text[start:end].startswith("Licensed under") and "limitations under" in text[start:end]


def _plain(template, text):
    """Least cost and most matches of the whole template against any part of the text."""
    row = [(0, 0)] * (len(text) + 1)
    for word in template:
        new = [(row[0][0] + 1, row[0][1])]
        for at, other in enumerate(text):
            took = (row[at][0], row[at][1] - 1) if word == other else (row[at][0] + 1, row[at][1])
            new.append(min(took, (row[at + 1][0] + 1, row[at + 1][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    return -min(row)[1]


def test_alignment_agrees_with_a_plain_search():
    import numpy as np

    draw = random.Random(3)
    for _ in range(200):
        template = np.array([draw.randint(1, 6) for _ in range(draw.randint(1, 12))])
        text = np.array([draw.randint(1, 6) for _ in range(draw.randint(1, 20))])
        matches, first, last = licenses.align(template, text, -len(template), len(text))
        assert matches == _plain(template.tolist(), text.tolist())
        assert matches == 0 or 0 <= first <= last < len(text)


LIKE = {
    "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0 (notice)"],
    "This work is licensed under the GNU Affero General Public License, version 3.": ["AGPL-3.0 (notice)"],
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": ["LGPL-2.1 (notice)"],
    "This work is licensed under the GNU General Public License, version 2.1.": [],
    "This work is licensed under the GNU General Public License, version 2.0.": ["GPL-2.0 (notice)"],
    "Licensed under CC BY-ND 4.0.": ["CC-BY-ND-4.0 (notice)"],
    "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0 (notice)"],
    "Licensed under CC BY 3.0.": ["CC-BY-3.0 (notice)"],
    "Licensed under CC BY 2.5.": [],
    "Licensed under the Apache License, Version 1.1.": [],
    "Released under the BSD License.": [],
    "Released under the MIT License.": ["MIT (notice)"],
    "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */": ["MIT (SPDX)", "Apache-2.0 (SPDX)", "GPL-2.0-only (SPDX)"],
}


@pytest.mark.parametrize("text", LIKE)
def test_like_licenses_are_told_apart(index, text):
    assert _names(index, f"Some words. {text}\nOther words.") == LIKE[text]


def test_every_template_is_found_as_itself(index):
    for name, text in licenses.TEMPLATES.items():
        ((found, coverage, start, _),) = licenses.find(index, f"Before it.\n\n{text}\n\nAfter it.")
        assert (found, coverage, start) == (name, 1.0, len("Before it.\n\n") + len(text) - len(text.lstrip()))


def test_unknown_kinds_are_not_given_another_name():
    known = {name: licenses.TEMPLATES[name] for name in ("GPL-3.0 (notice)", "CC-BY-4.0 (notice)", "BSD-2-Clause", "BSD-2-Clause (conditions)")}
    index = licenses.Index(known)
    for name in ("LGPL-3.0 (notice)", "AGPL-3.0 (notice)", "CC-BY-ND-4.0 (notice)"):
        assert _names(index, licenses.TEMPLATES[name]) == []
    assert "BSD-2-Clause" not in _names(index, licenses.TEMPLATES["BSD-3-Clause"])
