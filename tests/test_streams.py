"""Streamed segments and shadow roots."""

from quillflow.sources import html as H, streams as S


def texts(page):
    return [t for k, _, t in H.page_blocks(page, None) if k not in ("title", "meta")]


def rc(hole, segment):
    return f'<script>$RC("{hole}","{segment}")</script>'


def test_segments_stand_in_their_places():
    page = '<main><p>Head</p><!--$?--><template id="B:0"></template><p>Loading</p><!--/$--><p>Tail</p></main><div hidden id="S:0"><div><p>Body</p></div></div>' + rc("B:0", "S:0")
    assert texts(page) == ["Head", "Body", "Tail"]
    assert texts(page.replace("$RC", "$RX")) == ["Head", "Loading", "Tail"]


def test_segments_within_segments():
    page = '<p>A</p><template id="B:0"></template><div hidden id="S:1"><p>inner</p></div><div hidden id="S:0"><p>outer</p><template id="P:1"></template><p>end</p></div>'
    assert texts(page + rc("B:0", "S:0") + '<script>$RS("S:1","P:1")</script>') == ["A", "outer", "inner", "end"]


def test_cycles_and_lost_segments():
    page = '<p>A</p><template id="B:0"></template><div hidden id="S:0"><p>x</p><template id="B:1"></template></div><div hidden id="S:1"><p>y</p><template id="B:0"></template></div>'
    assert texts(page + rc("B:0", "S:0") + rc("B:1", "S:1")) == ["A", "x", "y"]
    assert texts('<!--$?--><template id="B:0"></template><p>wait</p><!--/$-->' + rc("B:0", "S:9")) == ["wait"]
    assert texts('<p>A</p><div hidden id="S:0"><p>never</p></div>' + rc("B:5", "S:0")) == ["A"]
    assert texts('<p>A</p><div hidden id="S:0"><p>open' + rc("B:0", "S:0")) == ["A"]


def test_bounds():
    many = "".join(f'<template id="B:{k}"></template><div hidden id="S:{k}"><p>{k}</p></div>' for k in range(S.IDS + 1))
    assert S.restored(many + rc("B:0", "S:0")) == many + rc("B:0", "S:0")
    few = "".join(f'<template id="B:{k}"></template><div hidden id="S:{k}"><p>{k}</p></div>' for k in range(200)) + "".join(rc(f"B:{k}", f"S:{k}") for k in range(200))
    assert texts(few) == [str(k) for k in range(200)]
    wide = "".join(f'<div hidden id="S:{k}">{f"""<template id="B:{k + 1}"></template>""" * 8}<p>{k}</p></div>' for k in range(12))
    page = '<template id="B:0"></template>' + wide + "".join(rc(f"B:{k}", f"S:{k}") for k in range(12))
    assert len(S.restored(page)) <= 4 * (len(page) + S.BYTES)


def test_shadow_roots():
    page = "<my-card><template shadowrootmode=open><h2><slot name=title>none</slot></h2><slot></slot><p>foot</p></template><span slot=title>Name</span><p>light</p></my-card><p>after</p>"
    assert texts(page) == ["Name", "light", "foot", "after"]
    assert texts("<x-a><template shadowrootmode=closed><p>only root</p></template><p>hidden</p></x-a>") == ["only root"]
    assert texts("<x-a><template shadowrootmode=open><x-b><template shadowrootmode=open><p>in</p></template></x-b></template></x-a>") == ["in"]
    assert texts("<x-a><template shadowrootmode=open><p>broken") == []


def test_pages_of_very_many_segments():
    """The reader puts all segments in their places, side by side or one within the other, however many they are."""
    n = 3 * S.IDS
    calls = "".join(rc(f"B:{k}", f"S:{k}") for k in range(n))
    flat = "".join(f'<template id="B:{k}"></template><div hidden id="S:{k}"><p>{k}</p></div>' for k in range(n))
    assert texts(flat + calls) == [str(k) for k in range(n)]
    deep = '<template id="B:0"></template>' + "".join(f'<div hidden id="S:{k}"><p>{k}</p><template id="B:{k + 1}"></template></div>' for k in range(n))
    assert texts(deep + calls) == [str(k) for k in range(n)]
