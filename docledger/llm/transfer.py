"""Cheapest repairs of role and fault sequences, over a Re-Pair grammar of min-plus matrices.

A row of a conversation is one of nine symbols: it must go, or it has one of four kinds of
role and ends properly or not. The roles that a repaired conversation may have, `(s?(ua)+)?`
by their initials, are the walks of an automaton of four states. What the edits of a row, and
the insertions before it, can do is a 4 x 4 matrix: per pair of states the least cost and, of
the edits at that cost, the least audit string. Sequences are products of such matrices, and
a rule of the grammar, a pair of symbols that occurs more than once, has its product made
once, whatever number of conversations it occurs in. Audits are ropes: a product refers to
those of its parts.

Taking the least (cost, audit) pair by pair is exact: equally dear audits of the same rows
are never prefixes of each other, as all letters but insertions stand for rows, and an
insertion costs.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence

# Costs of the edits, and of a row left without an end.
KEEP, REROLE, DELETE, INSERT, UNENDED = 0, 3, 4, 3, 3
#: The symbol of a row that must go; the others are 1 + 2 * (place in ROLES) + (1 if unended).
GONE = 0
ROLES = ("s", "u", "a", "")
SYMBOLS = 1 + 2 * len(ROLES)
STATES = range(4)
#: state -> {role: next state}; conversations begin in 0 and end in 0 or 3.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
SHORT = 32


def symbol(role: str, unended: bool) -> int:
    place = ROLES.index(role[:1]) if role[:1] in ROLES[:3] and role else 3
    return 1 + 2 * place + unended


class Rope:
    """A string as a leaf, or as two ropes one after the other."""

    __slots__ = ("left", "length", "right", "text")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right
        self.length = len(text) if text is not None else left.length + right.length

    def __add__(self, other: Rope) -> Rope:
        if not self.length or not other.length:
            return self if self.length else other
        if self.length + other.length <= SHORT:
            return Rope(str(self) + str(other))
        return Rope(None, self, other)

    def __str__(self) -> str:
        parts, stack = [], [self]
        while stack:
            rope = stack.pop()
            if rope.text is not None:
                parts.append(rope.text)
            else:
                stack += [rope.right, rope.left]
        return "".join(parts)

    def __lt__(self, other: Rope) -> bool:
        """Whether this string is the lesser; parts that both share are not looked into."""
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine.pop(), theirs.pop()
            if a is b:
                continue
            if a.text is not None and b.text is not None:
                size = min(a.length, b.length)
                if a.text[:size] != b.text[:size]:
                    return a.text[:size] < b.text[:size]
                if a.length > size:
                    mine.append(Rope(a.text[size:]))
                if b.length > size:
                    theirs.append(Rope(b.text[size:]))
            elif b.text is not None or (a.text is None and a.length >= b.length):
                mine += [a.right, a.left]
                theirs.append(b)
            else:
                mine.append(a)
                theirs += [b.right, b.left]
        return any(rope.length for rope in theirs)


#: (cost, audit) or None where no edits lead from the one state to the other.
Entry = tuple[int, Rope] | None
Row = list[Entry]
Matrix = list[Row]
EMPTY = Rope("")


def least(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return a or b
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if b[1] < a[1] else a


def through(row: Row, matrix: Matrix) -> Row:
    """A row of costs and audits, carried on through a matrix."""
    found: Row = [None] * 4
    for entry, onward in zip(row, matrix, strict=True):
        if entry is not None:
            for q, step in enumerate(onward):
                if step is not None:
                    have = found[q]
                    if have is None or have[0] >= entry[0] + step[0]:
                        found[q] = least(have, (entry[0] + step[0], entry[1] + step[1]))
    return found


def product(a: Matrix, b: Matrix) -> Matrix:
    return [through(row, b) for row in a]


def product_of(matrices: Sequence[Matrix]) -> Matrix:
    """The product of all, by halves, so that ropes stay shallow."""
    if not matrices:
        return [[(0, EMPTY) if p == q else None for q in STATES] for p in STATES]
    matrices = list(matrices)
    while len(matrices) > 1:
        pairs = [product(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


def _inserts() -> Matrix:
    """What insertions alone can do."""
    one: Matrix = [[(0, EMPTY) if p == q else None for q in STATES] for p in STATES]
    for p in STATES:
        for role in ("u", "a"):
            if role in STEPS[p]:
                one[p][STEPS[p][role]] = least(one[p][STEPS[p][role]], (INSERT, Rope("I")))
    return product(one, one)  # no state is further than two insertions away


INSERTS = _inserts()


def terminal(kind: int) -> Matrix:
    """Insertions before a row, then an edit of it."""
    edits: Matrix = [[None] * 4 for _ in STATES]
    place, unended = divmod(kind - 1, 2)
    extra = UNENDED * unended
    for p in STATES:
        edits[p][p] = (DELETE, Rope("D"))
        if kind != GONE:
            own = STEPS[p].get(ROLES[place])
            if own is not None:
                edits[p][own] = least(edits[p][own], (KEEP + extra, Rope("K")))
            for role in ("u", "a"):
                if role in STEPS[p]:
                    q = STEPS[p][role]
                    edits[p][q] = least(edits[p][q], (REROLE + extra, Rope("R")))
    return product(INSERTS, edits)


TERMINALS = [terminal(kind) for kind in range(SYMBOLS)]


def paired(sequence: list[int], pair: tuple[int, int], name: int) -> list[int]:
    """`sequence` with `name` for each occurrence of `pair`, from the left."""
    a, b = pair
    found, at, last = [], 0, len(sequence) - 1
    while at <= last:
        if at < last and sequence[at] == a and sequence[at + 1] == b:
            found.append(name)
            at += 2
        else:
            found.append(sequence[at])
            at += 1
    return found


def pairs_in(sequence: list[int]) -> Counter:
    """How often each pair can be replaced, overlaps in runs of one symbol not counted."""
    found: Counter = Counter()
    run = False
    for a, b in zip(sequence, sequence[1:]):
        run = a == b and not run
        if a != b or run:
            found[a, b] += 1
    return found


class Grammar:
    """Rules found so far, each with its transfer matrix.

    `limit` bounds the rules that are remembered; what comes later stays a longer sequence
    of symbols, with the same result.
    """

    def __init__(self, limit: int = 4096) -> None:
        self.limit = limit
        self.rules: dict[tuple[int, int], int] = {}
        self.matrices: list[Matrix] = list(TERMINALS)

    def _known(self, sequence: list[int]) -> list[int]:
        """The sequence in terms of the rules there are, oldest first."""
        while len(sequence) > 1:
            name = min((self.rules.get(p, self.limit + SYMBOLS) for p in zip(sequence, sequence[1:])))
            if name >= self.limit + SYMBOLS:
                break
            pair = next(p for p in zip(sequence, sequence[1:]) if self.rules.get(p) == name)
            sequence = paired(sequence, pair, name)
        return sequence

    def compress(self, sequences: Sequence[Sequence[int]]) -> list[list[int]]:
        """Re-Pair: the most frequent pair of all sequences becomes a rule, while one recurs."""
        left = [self._known(list(s)) for s in sequences]
        counts: Counter = Counter()
        where: dict[tuple[int, int], set[int]] = defaultdict(set)
        for i, sequence in enumerate(left):
            for pair, n in pairs_in(sequence).items():
                counts[pair] += n
                where[pair].add(i)
        while counts and len(self.rules) < self.limit:
            pair, n = max(counts.items(), key=lambda item: (item[1], item[0]))
            if n < 2:
                break
            name = len(self.matrices)
            self.rules[pair] = name
            self.matrices.append(product(self.matrices[pair[0]], self.matrices[pair[1]]))
            for i in sorted(where.pop(pair)):
                before = pairs_in(left[i])
                left[i] = paired(left[i], pair, name)
                after = pairs_in(left[i])
                for gone, n in before.items():
                    counts[gone] -= n
                    if counts[gone] <= 0:
                        del counts[gone]
                    if gone not in after and gone in where:
                        where[gone].discard(i)
                for come, n in after.items():
                    counts[come] += n
                    where[come].add(i)
        return left

    def matrix(self, compressed: Sequence[int]) -> Matrix:
        return product_of([self.matrices[s] for s in compressed])

    def repair(self, compressed: Sequence[int]) -> tuple[int, str]:
        """Cost and audit of a whole conversation."""
        row: Row = [(0, EMPTY), None, None, None]
        for s in compressed:
            row = through(row, self.matrices[s])
        return ended(row)


def ended(row: Row) -> tuple[int, str]:
    """The best way to end: insertions after the last row, and a state to stop in."""
    row = through(row, INSERTS)
    best = None
    for state in ENDS:
        best = least(best, row[state])
    return best[0], str(best[1])


def packed(matrix: Matrix) -> list[dict]:
    return [
        {"p": p, "q": q, "cost": entry[0], "audit": str(entry[1])}
        for p, row in enumerate(matrix)
        for q, entry in enumerate(row)
        if entry is not None
    ]


def unpacked(entries: Sequence[dict]) -> Matrix:
    matrix: Matrix = [[None] * 4 for _ in STATES]
    for e in entries:
        matrix[e["p"]][e["q"]] = (e["cost"], Rope(e["audit"]))
    return matrix
