"""Task-side weighted CYK parsing of damaged role sequences.

A row is a symbol, and a repaired sequence must spell ``(s?(ua)+)?``. Nonterminals of the repair grammar are pairs
(p, q): the span is repaired to a piece that leads from state p to state q. Its rules are in Chomsky normal
form: (p, q) -> (p, r) (r, q), and terminals for the ways to keep, change or delete one row. A cell holds the
least (cost, audit) of each nonterminal. Insertions belong to no row; each cell is closed under them.
"""

from __future__ import annotations

#: States: before anything, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a kept initial leads to, and where user and assistant rows that are made may stand.
STEPS = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}
MADE = STEPS["u"] + STEPS["a"]
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5

Cell = dict[tuple[int, int], tuple[int, str]]


def _least(cell: Cell, at: tuple[int, int], value: tuple[int, str]) -> None:
    if at not in cell or value < cell[at]:
        cell[at] = value


def _joined(left: Cell, right: Cell, into: Cell) -> None:
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            other = right.get((r, q))
            if other is not None:
                _least(into, (p, q), (cost + other[0], audit + other[1]))


def _insertions() -> Cell:
    """Cheapest insertions alone between any two states; the empty span's cell."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    while True:
        longer = dict(cell)
        _joined(cell, {step: (INSERT, "I") for step in MADE}, longer)
        if longer == cell:
            return cell
        cell = longer


EMPTY = _insertions()


def closed(cell: Cell) -> Cell:
    """``cell`` with insertions before and after its span."""
    half: Cell = {}
    _joined(EMPTY, cell, half)
    out: Cell = {}
    _joined(half, EMPTY, out)
    return out


def _terminal(symbol: str) -> Cell:
    """The cell of one row. A symbol is the initial (``-`` if no other) of a good row, in upper case (``_``) of a
    truncated one, or ``x`` for a row that has to go."""
    cell: Cell = {}
    if symbol != "x":
        cut = CUT if symbol.isupper() or symbol == "_" else 0
        for step in STEPS.get(symbol.lower(), []):
            _least(cell, step, (KEEP + cut, "K"))
        for step in MADE:
            _least(cell, step, (REROLE + cut, "R"))
    for p in range(4):
        _least(cell, (p, p), (DELETE, "D"))
    return closed(cell)


def parse(cells: list[Cell]) -> Cell:
    """The cell of the whole span, from those of neighbouring parts, by all splits of all spans, short ones first."""
    if not cells:
        return EMPTY
    n = len(cells)
    table = {(i, i + 1): cell for i, cell in enumerate(cells)}
    for length in range(2, n + 1):
        for low in range(n - length + 1):
            cell: Cell = {}
            for split in range(low + 1, low + length):
                _joined(table[low, split], table[split, low + length], cell)
            table[low, low + length] = cell  # closed, as its parts are
    return table[0, n]


TERMINALS = {symbol: _terminal(symbol) for symbol in "suaSUA-_x"}
#: Cells of short spans seen before in this worker; most conversations look alike.
_known: dict[str, Cell] = {}


def parse_symbols(symbols: str) -> Cell:
    """The cell of a span of rows."""
    cell = _known.get(symbols)
    if cell is None:
        cell = parse([TERMINALS[s] for s in symbols])
        if len(_known) < 100_000:
            _known[symbols] = cell
    return cell


def answer(cell: Cell) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation: nothing left, or an assistant row last."""
    return min(cell[end] for end in ((START, START), (START, ASSISTANT)) if end in cell)


def flat(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in sorted(cell.items())]


def thick(rows: list[dict]) -> Cell:
    return {(r["p"], r["q"]): (r["cost"], r["audit"]) for r in rows}


def next_state(state: int, kept_system: bool) -> int:
    """The state after one more row of a repaired sequence."""
    if kept_system:
        return SYSTEM
    return ASSISTANT if state == USER else USER


def pieces(audit: str, parts: list[int], symbols: list[str]) -> list[tuple[str, int]]:
    """The audit cut into pieces of ``parts`` rows each, and the state each begins in.

    Insertions go with the row that follows them; those at the end with the last piece.
    """
    out, at, state = [], 0, START
    for k, rows in enumerate(parts):
        begin, first, done = at, state, 0
        while at < len(audit) and (done < rows or k == len(parts) - 1):
            edit = audit[at]
            if edit != "D":
                state = next_state(state, edit == "K" and symbols[k][done] in "sS")
            done += edit != "I"
            at += 1
        out.append((audit[begin:at], first))
    return out


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The repaired (role, text) rows of a piece that begins in ``state``."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        kept = edit == "K"
        state = next_state(state, kept and roles[at][:1] == "s")
        made = "user" if state == USER else "assistant"
        if edit == "I":
            out.append((made, ""))
            continue
        out.append((roles[at] if kept else made, texts[at]))
        at += 1
    return out


def illegal(initials: list[str]) -> int:
    """Neighbours that may not follow each other."""
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
