"""Pages that arrive in pieces: streamed segments put where their placeholders stand, and declarative shadow roots opened.

A page's scripts say which segment completes which placeholder. Placeholders may stand within segments, so the pieces form a
graph; every placeholder is filled by walking it from the page down, each segment at most once on a way (a cycle ends where
it would begin anew). The walk is linear in what it writes; only a page whose segments would fill many times its own size is
left as it is.
"""

from __future__ import annotations

import re
from bisect import bisect_right

# Instructions, ids and bytes of segments that a bounded page may have. With more it stays as it is.
INSTRUCTIONS, IDS, BYTES, NODES = 256, 512, 2 << 20, 200_000
_DONE = re.compile(r"""\$R([CS])\(\s*(["'])([\w:.\-]{1,64})\2\s*,\s*(["'])([\w:.\-]{1,64})\4""")
_SCRIPT = re.compile(r"<script\b[^>]*>.*?</script\s*>", re.S | re.I)
_SEGMENT = re.compile(r"""<(div|table|svg|math)\b(?=[^>]*\shidden\b)(?=[^>]*\sid=(["']?)([\w:.\-]{1,64})\2)[^>]*>""", re.I)
_HOLE = re.compile(r"""<template\b[^>]*\sid=(["']?)([\w:.\-]{1,64})\1[^>]*>\s*</template\s*>""", re.I)
_SHADOW = re.compile(r"""<template\b(?=[^>]*\sshadowrootmode=)[^>]*>""", re.I)
_SLOT = re.compile(r"""<slot\b([^>]*)>(.*?)</slot\s*>""", re.S | re.I)


def _end(html: str, tag: str, at: int) -> tuple[int, int] | None:
    """Where the element whose content begins at `at` ends: of its content, and behind its end tag."""
    depth, inert = 1, 0
    for m in re.compile(rf"<script\b|</script\s*>|<(/?){tag}\b[^>]*>", re.I).finditer(html, at):
        word = m[0].lower()
        if word.startswith("<script"):
            inert += 1
        elif word.startswith("</script"):
            inert -= 1
        elif inert <= 0 and not word.endswith("/>"):
            depth += -1 if m[1] else 1
            if not depth:
                return m.start(), m.end()
    return None


def _segments(html: str, bounded: bool) -> tuple[dict[str, str], list[tuple[int, int]]] | None:
    """Contents of hidden segments by id (the first of each counts), and where they stand; none beyond the bounds, if bounded."""
    found, places, at, size = {}, [], 0, 0
    scripts = [m.span() for m in _SCRIPT.finditer(html)]
    begins = [a for a, _ in scripts]
    while m := _SEGMENT.search(html, at):
        at = m.end()
        k = bisect_right(begins, m.start()) - 1
        if (k >= 0 and m.start() < scripts[k][1]) or (end := _end(html, m[1], m.end())) is None:
            continue
        size += end[0] - m.end()
        if m[3] not in found:
            found[m[3]] = html[m.end() : end[0]]
            places.append((m.start(), end[1]))
            at = end[1]
        if bounded and (len(found) > IDS or size > BYTES):
            return None
    return found, places


def restored(html: str, bounded: bool = True) -> str:
    """The page with its completed segments in their places. Segments that complete nothing stay hidden where they are;
    placeholders without a segment keep what is shown meanwhile. bounded: a page beyond the bounds stays as it is."""
    if "$R" not in html or "\0" in html:
        return html
    done = {}
    for script in _SCRIPT.findall(html):
        for kind, _, a, _, b in _DONE.findall(script):
            hole, segment = (a, b) if kind == "C" else (b, a)
            done.setdefault(hole, segment)
    within = not bounded or (len(done) <= INSTRUCTIONS and html.count("<") <= NODES)
    parts = _segments(html, bounded) if done and within else None
    if not parts:
        return html
    segments, places = parts
    used: set[str] = set()
    left = 4 * (len(html) + BYTES)  # characters that segments may fill

    def filled(page: str) -> str:
        """Depth first, with a stack of its own: a text, its placeholders to come, where reading goes on, and its segment."""
        nonlocal left
        out, way = [], set()
        stack = [[page, _HOLE.finditer(page), 0, None]]
        while stack:
            text, holes, at, own = top = stack[-1]
            m = next(holes, None)
            if m is None:
                out.append(text[at:])
                way.discard(own)
                stack.pop()
                continue
            segment = done.get(m[2])
            if m.start() < at or segment not in segments or segment in way or left < 0:
                continue
            left -= len(segments[segment])
            used.add(segment)
            out.append(text[at : m.start()])
            top[2], before = m.end(), m.start()
            while before and text[before - 1].isspace():
                before -= 1
            if text.endswith(("<!--$?-->", "<!--$~-->"), 0, before) and (end := text.find("<!--/$-->", m.end())) >= 0:
                top[2] = end  # what is shown meanwhile goes
            way.add(segment)
            stack.append([segments[segment], _HOLE.finditer(segments[segment]), 0, segment])
        return "".join(out)

    page, at = [], 0
    for k, (a, b) in enumerate(places):  # segments are taken out before the page is filled
        page += [html[at:a], f"\0{k}\0"]
        at = b
    text = filled("".join(page) + html[at:])
    if left < 0:
        return html  # segments that stand in very many places
    names = list(segments)
    kept = lambda m: "" if names[int(m[1])] in used else html[slice(*places[int(m[1])])]
    return re.sub("\0([0-9]+)\0", kept, text)


def opened(html: str) -> str:
    """The page with declarative shadow roots as part of it: a host's own children go where the root's slots are, those of a
    name to the slot of that name; a root without a slot hides them."""
    at = 0
    for _ in range(IDS):
        m = _SHADOW.search(html, at)
        if not m:
            return html
        end = _end(html, "template", m.end())
        host = re.search(r"<([a-z][\w-]*)\b[^>]*>\s*$", html[: m.start()], re.I)
        if end is None or host is None or (close := _end(html, host[1], end[1])) is None:
            at = m.end()
            continue
        root, light = html[m.end() : end[0]], html[end[1] : close[0]]
        named = {}
        for child in re.finditer(r"""<([a-z][\w-]*)\b[^>]*\sslot=(["']?)([\w-]+)\2[^>]*>""", light, re.I):
            if (stop := _end(light, child[1], child.end())) is not None:
                named.setdefault(child[3], []).append((child.start(), stop[1]))
        rest, cut = [], 0
        for a, b in sorted(x for spans in named.values() for x in spans):
            if a >= cut:
                rest.append(light[cut:a])
                cut = b
        rest.append(light[cut:])

        def slot(s):
            name = re.search(r"""\sname=(["']?)([\w-]+)\1""", s[1])
            own = "".join(light[a:b] for a, b in named.get(name[2], [])) if name else "".join(rest)
            return own if own.strip() else s[2]

        html = html[: m.start()] + _SLOT.sub(slot, root) + html[close[0] :]
        at = m.start()
    return html
