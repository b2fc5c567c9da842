"""Finite-state scans over whole column batches, vectorised with numpy.

A batch of texts is one long symbol array. It is cut into equal lanes; each lane's *state map* (state at its
start -> state at its end) is found first, the maps are composed by a doubling prefix scan, and then every lane
runs once from its now known start state. No step walks the text symbol by symbol in Python.
"""

from __future__ import annotations

import numpy as np
import regex

LANE = 256
#: Symbols over which almost every state map is constant (a letter resets all states but two).
SETTLE = 12


def compose_prefix(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (lanes x states), by doubling: log2(lanes) rounds."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step].copy(), axis=1)
        step *= 2
    return out


def run_transducer(symbols: np.ndarray, nxt: np.ndarray, emit: np.ndarray, start: int = 0) -> np.ndarray:
    """Output of a small deterministic transducer for each symbol.

    nxt, emit: states x alphabet tables. Returns an array as long as symbols. An empty input gives an empty output.
    """
    n, (states, width) = len(symbols), nxt.shape
    if not n:
        return np.zeros(0, emit.dtype)
    lanes = -(-n // LANE)
    grid = np.zeros(lanes * LANE, np.intp)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
    step = (nxt.astype(np.intp) * width).ravel()  # a state is held as its row's offset
    out = emit.ravel()
    maps = np.broadcast_to(np.arange(states, dtype=np.intp) * width, (lanes, states)).copy()
    for t in range(LANE - SETTLE, LANE):
        maps = step[maps + grid[t][:, None]]
    # a lane whose last symbols lead every state to one needs no more; the rest are mapped over their whole length
    open_ = np.flatnonzero((maps != maps[:, :1]).any(axis=1))
    if len(open_):
        wide = np.broadcast_to(np.arange(states, dtype=np.intp) * width, (len(open_), states))
        for t in range(LANE):
            wide = step[wide + grid[t][open_][:, None]]
        maps[open_] = wide
    ends = compose_prefix(maps // width)
    at = np.empty(lanes, np.intp)
    at[0], at[1:] = start * width, ends[:-1, start] * width
    flags = np.empty((LANE, lanes), emit.dtype)
    for t in range(LANE):
        at += grid[t]
        np.take(out, at, out=flags[t], mode="clip")
        at = step.take(at, mode="clip")
    return np.ascontiguousarray(flags.T).ravel()[:n]


# --- code point classes and the two pre-tokenisation patterns -------------------------------------------------

SEP, LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_LAST, WHITE_LAST, WHITE = range(9)
#: Between two texts of a batch; a lone surrogate, so that it never stands in a text.
MARK = "\ud800"
_classes: np.ndarray | None = None


def every_code_point() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def code_point_classes() -> np.ndarray:
    """uint8 class of every code point: LETTER, NUMBER, WHITE or OTHER; MARK is SEP."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, OTHER, np.uint8)
        every = every_code_point()
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
            for m in regex.finditer(pattern, every):
                first, last = ord(m[0][0]), ord(m[0][-1])
                table[first : last + 1] = np.where(table[first : last + 1] == OTHER, kind, table[first : last + 1])
        table[0xD800:0xE000] = SEP
        _classes = table
    return _classes


def code_points(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols_of(cps: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """Class of each code point, refined by the one or two that follow: contractions and the last white space."""
    sym = (code_point_classes() if classes is None else classes)[cps]
    after = np.zeros_like(sym)
    after[:-1] = sym[1:]
    white = sym == WHITE
    last = white & (after != WHITE) & (after != SEP)
    out = sym.copy()
    out[last] = np.where(cps[last] == 32, SPACE_LAST, WHITE_LAST)
    q = np.flatnonzero(cps == 39)
    if len(q):
        padded = np.append(cps, [0, 0])
        a, b = padded[q + 1], padded[q + 2]
        s, t, m, d, r, e, v, l_ = (ord(c) for c in "stmdrevl")
        out[q[(a == s) | (a == t) | (a == m) | (a == d)]] = SHORT
        out[q[((a == r) & (b == e)) | ((a == v) & (b == e)) | ((a == l_) & (b == l_))]] = LONG
    return out


def pattern_tables(spaces_attach: bool, number_runs: bool) -> tuple[np.ndarray, np.ndarray]:
    """Transducer whose output is 1 where a pre-token starts.

    spaces_attach: one space joins the run after it, and white space makes pre-tokens of its own; otherwise white
    space belongs to no pre-token. number_runs: digits form runs; otherwise each is a pre-token.
    """
    fresh, letters, numbers, others, one_more, two_more, space, white = range(8)
    nxt, emit = np.zeros((8, 9), np.uint8), np.zeros((8, 9), np.uint8)

    def put(state, symbol, to, flag):
        nxt[state, symbol], emit[state, symbol] = to, flag

    for state in range(8):
        put(state, SEP, fresh, 0)
        for symbol, to in ((LETTER, letters), (NUMBER, numbers), (OTHER, others), (SHORT, one_more), (LONG, two_more)):
            put(state, symbol, to, 1)
        for symbol, to in ((SPACE_LAST, space), (WHITE_LAST, white), (WHITE, white)):
            put(state, symbol, to if spaces_attach else fresh, int(spaces_attach))
    put(letters, LETTER, letters, 0)
    if number_runs:
        put(numbers, NUMBER, numbers, 0)
    for symbol in (OTHER, SHORT, LONG):
        put(others, symbol, others, 0)
    for symbol in range(1, 9):
        put(two_more, symbol, one_more, 0)
        put(one_more, symbol, fresh, 0)
    if spaces_attach:
        put(space, LETTER, letters, 0)
        put(space, NUMBER, numbers, 0)
        for symbol in (OTHER, SHORT, LONG):
            put(space, symbol, others, 0)
        put(white, WHITE, white, 0)
    return nxt, emit


def slabs(texts: list[str], most: int = 2_000_000):
    """Cuts a list into runs (from, to) of about `most` characters, at least one text each."""
    at = size = 0
    for k, x in enumerate(texts):
        if size and size + len(x) > most:
            yield at, k
            at, size = k, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, len(texts)
