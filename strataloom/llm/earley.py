"""Error-correcting Earley parsing of role sequences."""

from __future__ import annotations

from collections import defaultdict

#: What has been read, as a left-linear grammar: nothing kept yet (S), a system turn (B), a user's turn (U), an assistant's turn (A).
STATES, FINAL = "SBUA", "SA"
_RULES = [
    ("S", ("S", "d")),
    ("B", ("S", "s")),
    ("B", ("B", "d")),
    ("U", ("S", "u")),
    ("U", ("B", "u")),
    ("U", ("A", "u")),
    ("U", ("U", "d")),
    ("A", ("U", "a")),
    ("A", ("A", "d")),
    ("s", ("keep s",)),
    ("u", ("keep u",)),
    ("a", ("keep a",)),
    # the error productions
    ("u", ("rerole u",)),
    ("a", ("rerole a",)),
    ("u", ("insert u",)),
    ("a", ("insert a",)),
    ("d", ("delete -",)),
]
_COST = {"keep": 0, "rerole": 2, "delete": 3, "insert": 2}
_HEADS = {lhs for lhs, _ in _RULES}

#: (cost, audit, roles): audit has the initial of each edit, roles the initial of each row that comes out.
Value = tuple[int, str, str]


def _join(a: Value, b: Value) -> Value:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def _edit(terminal: str, more: int) -> Value:
    kind, role = terminal.split()
    return _COST[kind] + more, kind[0].upper(), role.strip("-")


def parse(rows: list[tuple[str, bool, bool]], start: str = "S") -> dict[str, Value]:
    """Of each state that rows can lead to from `start`, the least (cost, audit, roles).

    rows: role initial, whether it must be deleted, whether it is truncated. Chart items are (rule, dot, origin) with
    the least value of what they cover; an item that improves is worked on again, and as each insertion costs, the
    cycles of insertions end. Two audits of one span and cost never begin one another, so the least audit of a span
    stays the least in whatever contains it.
    """
    rules = [*_RULES, (start, ())]
    of = defaultdict(list)
    for i, (lhs, _) in enumerate(rules):
        of[lhs].append(i)
    waiting: list[dict[str, dict]] = []
    column: dict[tuple[int, int, int], Value] = {}
    agenda: list[tuple[int, int, int]] = []

    def add(col: dict, todo: list, item: tuple[int, int, int], value: Value) -> None:
        old = col.get(item)
        if old is None or value < old:
            col[item] = value
            todo.append(item)

    for state in STATES:
        for i in of[state]:
            add(column, agenda, (i, 0, 0), (0, "", ""))
    done: dict[tuple[str, int], Value] = {}
    for j in range(len(rows) + 1):
        row = rows[j] if j < len(rows) else None
        waiting.append(defaultdict(dict))
        after: dict[tuple[int, int, int], Value] = {}
        then: list[tuple[int, int, int]] = []
        done = {}
        while agenda:
            item = agenda.pop()
            i, dot, origin = item
            value, (lhs, rhs) = column[item], rules[i]
            if dot == len(rhs):  # complete
                if (lhs, origin) not in done or value < done[lhs, origin]:
                    done[lhs, origin] = value
                    for (w, d, o), before in waiting[origin][lhs].items():
                        add(column, agenda, (w, d + 1, o), _join(before, value))
            elif rhs[dot] in _HEADS:  # predict
                waiting[j][rhs[dot]][item] = value
                for w in of[rhs[dot]]:
                    add(column, agenda, (w, 0, j), (0, "", ""))
                if (rhs[dot], j) in done:
                    add(column, agenda, (i, dot + 1, origin), _join(value, done[rhs[dot], j]))
            elif rhs[dot].startswith("insert"):
                add(column, agenda, (i, dot + 1, origin), _join(value, _edit(rhs[dot], 0)))
            elif row is not None:  # scan
                initial, must, truncated = row
                kind, role = rhs[dot].split()
                if kind == "delete" or not must and (kind == "rerole" or role == initial):
                    add(after, then, (i, dot + 1, origin), _join(value, _edit(rhs[dot], truncated and kind != "delete")))
        column, agenda = after, then
    return {lhs: value for (lhs, origin), value in done.items() if origin == 0 and lhs in STATES}
