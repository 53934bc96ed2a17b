"""Many literals in one pass over a text.

All literals that rules look for in one text column make one automaton (Aho-Corasick); a
row's text is read once, however many literals there are. Literals form groups: one holds when
any, or all, of its literals occur. A row yields the groups that hold and the literals found, so rules
are picked by what occurs in the row and not tried one by one.
"""

import hashlib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this many literals on a search goes to the automaton; below it JVM ``contains`` is faster.
MANY = 24
FOUND = "struct<groups:array<int>,found:array<int>>"

_automata: dict[bytes, object] = {}


def automaton(literals: list[str]):
    """The worker's automaton for some literals; workers keep it from task to task. None if there are only empty ones."""
    import ahocorasick

    key = hashlib.sha256("\0".join(literals).encode("utf-8", "surrogatepass")).digest()
    if key not in _automata:
        a = ahocorasick.Automaton()
        for i, text in enumerate(literals):
            if text:
                a.add_word(text, i)
        if len(a):
            a.make_automaton()
        _automata[key] = a if len(a) else None
    return _automata[key]


class Literals:
    """The literals that one text column is searched for, in lower case, and their groups."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.groups: dict[tuple[int, frozenset[int]], int] = {}

    def group(self, texts: Iterable[str], every: bool = False) -> int:
        """Number of the group that holds when any, or every one, of ``texts`` occurs."""
        own = frozenset(self.numbers.setdefault(t.lower(), len(self.numbers)) for t in texts)
        return self.groups.setdefault((len(own) if every else 1, own), len(self.groups))

    def members(self, group: int) -> list[tuple[int, str]]:
        """(number, literal) of a group's literals, in the order of their texts."""
        own = next(k for k, g in self.groups.items() if g == group)[1]
        return sorted(((n, t) for t, n in self.numbers.items() if n in own), key=lambda x: x[1])

    def searcher(self) -> Callable[[str], tuple[list[int], list[int]]]:
        """A function of a lower-case text that gives (groups that hold, literals found), both ascending."""
        literals = list(self.numbers)
        always = {n for t, n in self.numbers.items() if not t}
        single: dict[int, list[int]] = {}
        counted: dict[int, list[int]] = {}
        least: dict[int, int] = {}
        for (need, own), g in self.groups.items():
            for n in own:
                (single if need == 1 else counted).setdefault(n, []).append(g)
            least[g] = need
        machine = automaton(literals)

        def search(text: str) -> tuple[list[int], list[int]]:
            found = {n for _, n in machine.iter(text)} if machine is not None else set()
            found |= always
            holds, counts = set(), {}
            for n in found:
                holds.update(single.get(n, ()))
                for g in counted.get(n, ()):
                    counts[g] = counts.get(g, 0) + 1
            holds.update(g for g, c in counts.items() if c >= least[g])
            return sorted(holds), sorted(found)

        return search

    def column(self, low: Column) -> Column:
        """The groups that hold in a lower-case text and the literals found; null is an empty text."""
        whole = self

        @F.pandas_udf(FOUND)
        def search(texts: pd.Series) -> pd.DataFrame:
            find = whole.searcher()
            got = [find(t or "") for t in texts]
            return pd.DataFrame({"groups": [g for g, _ in got], "found": [f for _, f in got]})

        return search(low)
