"""Places where items open, against every pattern searched through the whole text."""

from __future__ import annotations

import random
import re
import time

from finweave.functions import constants as K
from finweave.operators import text

PATTERNS = [(item, re.compile(p)) for item, (_, p) in K.SECTIONS.items()] + [(item, re.compile(p, re.M)) for item, ps in K.SECTION_ALTERNATES.items() for p in ps]
PIECES = (
    "Item Items ITEM item\u00a0 \u0130TEM \u0131tem item1a. 1 1. 1A. 1b 2. 2 3. 4 5. 6 7 7A 8. 9 9a 9B. 10. 11 12 13 14 15 16 and and1a. Business BUSINE\u017fS business description of Risk risk\u212a Ri\u017fk r\u0131sk Factors Unresolved staff comments Properties legal proceedings mine safety disclosures "
    "market for registrant selected consolidated financial data management managements discussion analysis MD&A md&a quantitative qualitative disclosures statements changes in disagreements controls procedures other information directors executive officers compensation security ownership "
    "certain relationships principal accountant fees exhibits statement schedules form 10-K 10k summary Straße \u0391\u03a3 \u00c9t\u00e9"
).split(" ")


def searched(t):
    return {(m.start(), item) for item, p in PATTERNS for m in p.finditer(t)}


def test_places_of_random_texts():
    draw = random.Random(5)
    openings = [re.sub(r"\\s\*", " ", p.replace("(?i)", "")).replace("\\.?", ".").replace(".*", " x ") for p in (p for _, p in K.SECTIONS.values())]
    seen = 0
    for _ in range(6_000):
        parts = [draw.choice(PIECES) if draw.random() < 0.8 else draw.choice((str.upper, str.title, str))(draw.choice(openings)) for _ in range(draw.randrange(1, 25))]
        t = "".join(p + draw.choice(("", " ", " ", "\n", "\t")) for p in parts)
        assert text.openings(t) == searched(t), t
        seen += len(searched(t))
    assert seen > 2_000


def test_text_without_items_is_not_searched_by_every_pattern():
    t = "the quick brown fox sat on a mat in a quiet room and said what it had seen " * 20_000
    began = time.perf_counter()
    searched(t)
    plain = time.perf_counter() - began
    began = time.perf_counter()
    assert text.find_sections(t) == []
    assert time.perf_counter() - began < plain / 5
