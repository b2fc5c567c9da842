"""Tables drawn with characters: cells are traced along their borders, spans become empty cells."""

from __future__ import annotations

import re

# Lines and columns of characters that a drawn table may have; a larger one is text.
LINES, WIDTH = 4096, 4096


def is_grid(line: str) -> bool:
    return bool(re.fullmatch(r"\+(?:[-=]+\+)+\s*", line))


def grid(lines: list[str]) -> tuple[list[list[str]], int] | None:
    """Rows of cells, and how many of the first are a header; None where the drawing is no table.

    Every corner that no cell has yet is the upper left of one: its border is followed to the right, down, and back, over
    corners of other cells, and the smallest closed way is the cell."""
    width = max(map(len, lines), default=0)
    if len(lines) < 3 or len(lines) > LINES or width > WIDTH or not is_grid(lines[0]) or not is_grid(lines[-1]):
        return None
    area = [line.rstrip().ljust(width) for line in lines]
    head = next((k for k, line in enumerate(area) if k and k + 1 < len(area) and re.fullmatch(r"\+(?:=+\+)+\s*", line)), None)
    flat = lambda r, a, b: all(c in "-+=" for c in area[r][a:b])
    steep = lambda c, a, b: all(area[r][c] in "|+" for r in range(a, b))

    def traced(top: int, left: int):
        for right in range(left + 1, width):
            if area[top][right] not in "-=+":
                return None
            if area[top][right] != "+" or top + 1 == len(area) or area[top + 1][right] not in "|+":
                continue
            for bottom in range(top + 1, len(area)):
                if area[bottom][right] not in "|+" or area[bottom][left] not in "|+":
                    break
                if area[bottom][right] == area[bottom][left] == "+" and flat(bottom, left, right + 1) and steep(left, top, bottom + 1):
                    return bottom, right
        return None

    cells, covered, todo = [], set(), [(0, 0)]
    while todo:
        top, left = todo.pop()
        if (top, left) in covered or top + 1 >= len(area) or left + 1 >= width or area[top][left] != "+":
            continue
        covered.add((top, left))
        if (end := traced(top, left)) is not None:
            cells.append((top, left, *end))
            todo += [(top, end[1]), (end[0], left), (end[0], end[1])]
            todo += [(end[0], c) for c in range(left + 1, end[1]) if area[end[0]][c] == "+"] + [(r, end[1]) for r in range(top + 1, end[0]) if area[r][end[1]] == "+"]
    if sum((b - t) * (r - c) for t, c, b, r in cells) != (len(area) - 1) * (len(area[0].rstrip()) - 1):
        return None  # cells do not fill the drawing
    tops, lefts = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    rows = [[""] * len(lefts) for _ in tops]
    for top, left, bottom, right in cells:
        text = [area[r][left + 1 : right].strip() for r in range(top + 1, bottom)]
        rows[tops.index(top)][lefts.index(left)] = "\n".join("\n".join(text).strip("\n").split("\n"))
    return rows, 0 if head is None else sum(t < head for t in tops)


def is_simple(line: str) -> bool:
    return bool(re.fullmatch(r"=+(?: +=+)+\s*", line))


def simple(lines: list[str]) -> tuple[list[list[str]], int] | None:
    """Rows of a table whose columns stand below runs of `=`; lines with a blank first column go on with the row above, a line
    of `-` joins columns."""
    if len(lines) < 3 or not is_simple(lines[0]) or not is_simple(lines[-1]):
        return None
    edges = [m.span() for m in re.finditer("=+", lines[0])]
    borders = [k for k, line in enumerate(lines) if is_simple(line)]
    rows, head, k = [], 0, 1
    while k < len(lines) - 1:
        line = lines[k]
        if k in borders:
            head = len(rows)
        elif re.fullmatch(r"-+(?: +-+)*\s*", line):
            if rows:  # the row above has the spans that this line draws
                rows[-1] = _spanned(lines, k, edges, [m.span() for m in re.finditer("-+", line)], rows[-1])
        elif line.strip():
            cells = [line[a : (edges[n + 1][0] if n + 1 < len(edges) else len(line))].strip() for n, (a, _) in enumerate(edges)]
            if not cells[0] and rows and k - 1 not in borders and line[: edges[0][1]].strip() == "":
                rows[-1] = [f"{x}\n{y}".strip("\n") if y else x for x, y in zip(rows[-1], cells)]
            else:
                rows.append([c if c != "\\" else "" for c in cells])
        k += 1
    return rows, head


def _spanned(lines: list[str], k: int, edges, drawn, row: list[str]) -> list[str]:
    out = [""] * len(edges)
    for a, b in drawn:
        first = next((n for n, e in enumerate(edges) if e[0] >= a), 0)
        end = max((e[1] for e in edges if e[0] < b), default=b)
        out[first] = lines[k - 1][a : max(end, b)].strip()
    return out


def blocks(rows: list[list[str]], head: int, number: int):
    """Row blocks; a table without a header has an empty one, further header rows stand as rows."""
    if not head:
        yield "row", number, "\x1f".join([""] * max(map(len, rows), default=1))
    for row in rows:
        yield "row", number, "\x1f".join(row)
