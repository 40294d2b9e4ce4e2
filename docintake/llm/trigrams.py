"""Boolean trigram queries from regular expressions.

A query is a set of alternatives, each a set of trigrams that all must occur in
a text, in lower case, for the expression to match it.  ``ANY`` asks nothing:
such an expression has no mandatory trigram and must scan every text.
"""

from itertools import product
from re import _constants as C
from re import _parser as parser

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: More strings or alternatives than this are given up for a weaker query, which only adds candidates.
MOST = 64


def simplest(query) -> Query:
    """Without alternatives that another one contains in full."""
    query = set(query)
    small = frozenset(q for q in query if not any(o < q for o in query))
    return small if len(small) <= MOST else ANY


def both(a: Query, b: Query) -> Query:
    joined = simplest(x | y for x in a for y in b) if len(a) * len(b) <= MOST * MOST else ANY
    return joined if joined != ANY else min((a, b), key=lambda q: (q == ANY, len(q)))


def of_strings(strings) -> Query:
    """One of the strings occurs."""
    return simplest(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def analyse(items) -> tuple[frozenset[str] | None, Query]:
    """The strings a sequence matches, if they are few, and its query."""
    run: frozenset[str] | None = frozenset([""])  # what the last items match
    whole, query = True, ANY
    for op, value in items:
        exact, own = analyse_one(op, value)
        if exact is not None and len(run) * len(exact) <= MOST:
            run = frozenset(a + b for a, b in product(run, exact))
            continue
        query = both(both(query, of_strings(run)), own)
        run, whole = frozenset([""]), False
        if exact is not None:
            run = exact
    return (run if whole else None), both(query, of_strings(run))


def analyse_one(op, value) -> tuple[frozenset[str] | None, Query]:
    if op is C.LITERAL:
        return frozenset([chr(value).lower()]), ANY
    if op is C.IN:
        letters = frozenset(chr(v).lower() for o, v in value if o is C.LITERAL)
        return (letters, ANY) if len(value) == sum(o is C.LITERAL for o, _ in value) and len(letters) <= 4 else (None, ANY)
    if op is C.SUBPATTERN:
        return analyse(value[-1])
    if op is C.BRANCH:
        found = [analyse(branch) for branch in value[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= MOST:
            return frozenset().union(*(e for e, _ in found)), ANY
        # a branch's query already holds that of its strings
        return None, simplest(q for _, query in found for q in query)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, inner = value
        exact, query = analyse(inner)
        if exact is not None and (least, most) == (0, 1):
            return exact | {""}, ANY
        if exact is not None and least == most and len(exact) ** least <= MOST and least <= 32:
            return frozenset("".join(p) for p in product(exact, repeat=least)), ANY
        return None, query if least else ANY
    if op is C.AT:
        return frozenset([""]), ANY
    return None, ANY


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """What every match of the pattern contains; ANY if nothing is certain."""
    exact, query = analyse(parser.parse(pattern, flags))
    return query if exact is None else of_strings(exact)
