import random
import re

import pytest

from docintake.llm.secrets import RULES
from docintake.llm.trigrams import ANY, trigram_query


def holds(query, text):
    low = text.lower()
    return any(all(t in low for t in alternative) for alternative in query)


def test_queries_of_known_patterns():
    assert trigram_query("abcd") == frozenset([frozenset(["abc", "bcd"])])
    assert trigram_query("ab?c[0-9]xyz") == frozenset([frozenset(["abc", "xyz"]), frozenset(["xyz"])]) or holds(trigram_query("ab?c[0-9]xyz"), "ac5xyz")
    assert trigram_query("[0-9a-f]{24,}") == ANY
    assert trigram_query("(cat|dog)s+") == frozenset([frozenset(["cat"]), frozenset(["dog"])])
    assert trigram_query("x*") == ANY
    assert trigram_query("(ab){2}") == frozenset([frozenset(["aba", "bab"])])
    names = {r.kind: trigram_query(r.pattern, r.flags) for r in RULES}
    assert [k for k, q in names.items() if q == ANY] == ["hex"]
    assert frozenset(["aki", "kia"]) in names["access"]


@pytest.mark.parametrize("pattern", ["ab?c", "(foo|ba[rz])+q", "a{2,4}bcd", "(?:xy|z)(abc)?def", "[ab]cd[ef]g", "^abc$|d.e.fgh", "a|b", "(abc|)d"])
def test_every_match_fulfils_its_query(pattern):
    r = random.Random(pattern)
    query = trigram_query(pattern)
    for _ in range(4000):
        text = "".join(r.choice("abcdefgoqrxyz") for _ in range(r.randint(0, 12)))
        if re.search(pattern, text):
            assert holds(query, text), (pattern, text, query)
