"""Presentation MathML as TeX: a formula is a tree that is rewritten from its leaves up."""

from __future__ import annotations

import unicodedata

DEEPEST = 64
# Operators by their TeX names, accents, large operators, functions, fences of matrices, styles of letters.
OPERATORS = {
    "×": "\\times", "÷": "\\div", "±": "\\pm", "∓": "\\mp", "·": "\\cdot", "⋅": "\\cdot", "∗": "*", "∘": "\\circ", "≤": "\\le", "≥": "\\ge", "≠": "\\ne", "≈": "\\approx", "≡": "\\equiv", "∼": "\\sim",
    "≃": "\\simeq", "≅": "\\cong", "∝": "\\propto", "<": "\\lt", ">": "\\gt", "≪": "\\ll", "≫": "\\gg", "∈": "\\in", "∉": "\\notin", "∋": "\\ni", "⊂": "\\subset", "⊃": "\\supset", "⊆": "\\subseteq",
    "⊇": "\\supseteq", "∪": "\\cup", "∩": "\\cap", "∅": "\\emptyset", "∖": "\\setminus", "∧": "\\land", "∨": "\\lor", "¬": "\\neg", "⇒": "\\Rightarrow", "⇐": "\\Leftarrow", "⇔": "\\Leftrightarrow",
    "→": "\\to", "←": "\\leftarrow", "↔": "\\leftrightarrow", "↦": "\\mapsto", "↑": "\\uparrow", "↓": "\\downarrow", "∀": "\\forall", "∃": "\\exists", "∂": "\\partial", "∇": "\\nabla", "∞": "\\infty",
    "∑": "\\sum", "∏": "\\prod", "∐": "\\coprod", "∫": "\\int", "∬": "\\iint", "∭": "\\iiint", "∮": "\\oint", "⋃": "\\bigcup", "⋂": "\\bigcap", "⨁": "\\bigoplus", "⨂": "\\bigotimes", "⊕": "\\oplus",
    "⊗": "\\otimes", "⊥": "\\perp", "∥": "\\parallel", "∠": "\\angle", "…": "\\ldots", "⋯": "\\cdots", "⋮": "\\vdots", "⋱": "\\ddots", "′": "'", "″": "''", "−": "-", "ℓ": "\\ell", "ℏ": "\\hbar", "ℜ": "\\Re",
    "ℑ": "\\Im", "ℵ": "\\aleph", "⟨": "\\langle", "⟩": "\\rangle", "⌊": "\\lfloor", "⌋": "\\rfloor", "⌈": "\\lceil", "⌉": "\\rceil", "‖": "\\|", "∣": "|", "⊢": "\\vdash", "⊨": "\\models", "†": "\\dagger",
}
ACCENTS = {"^": "\\hat", "ˆ": "\\hat", "~": "\\tilde", "˜": "\\tilde", "∼": "\\tilde", "¯": "\\bar", "‾": "\\overline", "―": "\\overline", "→": "\\vec", "⃗": "\\vec", "˙": "\\dot", ".": "\\dot", "¨": "\\ddot", "ˇ": "\\check", "˘": "\\breve", "⏞": "\\overbrace", "⏜": "\\overbrace"}
UNDER = {"_": "\\underline", "¯": "\\underline", "‾": "\\underline", "̲": "\\underline", "⏟": "\\underbrace", "⏝": "\\underbrace"}
LARGE = set("∑∏∐⋃⋂⨁⨂⋁⋀") | {"lim", "max", "min", "sup", "inf", "lim sup", "lim inf", "det", "gcd"}
FUNCTIONS = set("arccos arcsin arctan arg cos cosh cot coth csc deg det dim exp gcd hom inf ker lg lim ln log max min sec sin sinh sup tan tanh Pr".split())
MATRICES = {("(", ")"): "pmatrix", ("[", "]"): "bmatrix", ("{", "}"): "Bmatrix", ("|", "|"): "vmatrix", ("‖", "‖"): "Vmatrix", ("{", ""): "cases"}
STYLES = {"bold": "\\mathbf", "double-struck": "\\mathbb", "script": "\\mathcal", "fraktur": "\\mathfrak", "sans-serif": "\\mathsf", "monospace": "\\mathtt", "bold-italic": "\\boldsymbol"}
ESCAPES = {"\\": "\\backslash", "{": "\\{", "}": "\\}", "%": "\\%", "#": "\\#", "&": "\\&", "_": "\\_", "$": "\\$"}
LEAVES = {"mi", "mn", "mo", "mtext", "ms"}
INERT = {"annotation", "annotation-xml", "script", "style"}
_UNSEEN = dict.fromkeys(map(ord, "⁡⁢⁣⁤​﻿"))


class Formula:
    """Builds the tree of one math element from a parser's events."""

    def __init__(self, attributes: dict):
        self.root = ("math", attributes, [])
        self.open, self.deep = [self.root], False

    def start(self, tag: str, attributes: dict) -> None:
        node = (tag, attributes, [])
        self.open[-1][2].append(node)
        self.open.append(node)
        self.deep = self.deep or len(self.open) > DEEPEST

    def end(self, tag: str) -> None:
        if any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def text(self, data: str) -> None:
        if not any(n[0] in INERT for n in self.open):
            self.open[-1][2].append(data)

    def tex(self) -> str:
        """TeX, or the plain text of a formula nested too deep."""
        return " ".join(_plain(self.root).split()) if self.deep else _row(self.root[2])


def _plain(node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x[0] not in INERT:
            todo += reversed(x[2])
    return "".join(out)


def _kids(node) -> list:
    return [k for k in node[2] if not isinstance(k, str) and k[0] not in INERT]


def _symbol(c: str) -> str:
    if c in OPERATORS:
        return OPERATORS[c]
    if "Ͱ" <= c <= "Ͽ":  # Greek letters by their names
        words = unicodedata.name(c, "").split()
        if words[:1] == ["GREEK"] and words[-1] in ("ALPHA BETA GAMMA DELTA EPSILON ZETA ETA THETA IOTA KAPPA LAMDA MU NU XI PI RHO SIGMA TAU UPSILON PHI CHI PSI OMEGA").split() and "WITH" not in words:
            name = words[-1].lower().replace("lamda", "lambda")
            if "FINAL" in words:
                return "\\varsigma"
            if words[1] == "SMALL" and name != "omicron":
                return "\\" + ("varepsilon" if name == "epsilon" else "varphi" if name == "phi" else name)
            if words[1] == "CAPITAL":
                return "\\" + name.capitalize() if name in ("gamma", "delta", "theta", "lambda", "xi", "pi", "sigma", "upsilon", "phi", "psi", "omega") else name[0].upper()
        return {"ϵ": "\\epsilon", "ϕ": "\\phi", "ϑ": "\\vartheta", "ϱ": "\\varrho", "ϖ": "\\varpi", "ϰ": "\\varkappa"}.get(c, c)
    return ESCAPES.get(c, c)


def _symbols(text: str) -> str:
    out = ""
    for c in text:
        s = _symbol(c)
        out += (" " if out[-1:].isalpha() and "\\" in out.split(" ")[-1] and s[:1].isalpha() else "") + s
    return out


def _leaf(node) -> str:
    tag, a, _ = node
    text = " ".join(_plain(node).translate(_UNSEEN).split())
    if not text:
        return ""
    if tag in ("mtext", "ms"):
        body = "".join({"\\": "\\textbackslash ", "~": "\\textasciitilde ", "^": "\\textasciicircum "}.get(c, ESCAPES.get(c, c)) for c in text)
        return f"\\text{{{body}}}"
    if tag == "mi" and len(text) > 1:
        return "\\" + text if text in FUNCTIONS else f"\\operatorname{{{text}}}" if text.isalpha() and text.isascii() else _symbols(text)
    if tag == "mo" and text in FUNCTIONS:
        return "\\" + text
    body = _symbols(text)
    style = STYLES.get(a.get("mathvariant", ""))
    return f"{style}{{{body}}}" if style else body


def _base(tex: str, node) -> str:
    """What a script hangs on: a single letter, number or command stands bare, anything else in braces."""
    alone = node is not None and not isinstance(node, str) and node[0] in (*LEAVES, "mover", "munder", "mfenced", "msqrt", "mroot")
    return tex if alone and tex else f"{{{tex}}}"


def _row(kids: list) -> str:
    """Kids side by side; a table between fences of a matrix takes them in."""
    own = [k for k in kids if not isinstance(k, str) and k[0] not in INERT]
    for k, node in enumerate(own):
        if node[0] == "mtable" or (node[0] == "mrow" and [x[0] for x in _kids(node)] == ["mtable"]):
            sign = lambda x: _plain(x).strip() if x is not None and x[0] == "mo" else None
            before, after = sign(own[k - 1]) if k else None, sign(own[k + 1]) if k + 1 < len(own) else None
            fence = (before, after if after is not None else "")
            table = node if node[0] == "mtable" else _kids(node)[0]
            if before is not None and fence in MATRICES:
                return " ".join(filter(None, [_row(own[: k - 1]), _table(table, MATRICES[fence]), _row(own[k + 1 + (after is not None) :])]))
    return " ".join(filter(None, (k.strip() if isinstance(k, str) else _tex(k) for k in kids if isinstance(k, str) or k[0] not in INERT)))


def _table(node, kind: str) -> str:
    rows = [[_row(cell[2]) for cell in _kids(row) if cell[0] == "mtd"] for row in _kids(node) if row[0] in ("mtr", "mlabeledtr")]
    return f"\\begin{{{kind}}}" + " \\\\ ".join(" & ".join(cells) for cells in rows) + f"\\end{{{kind}}}"


def _scripts(node) -> str:
    """mmultiscripts: the base, pairs of scripts behind it, and pairs before it after mprescripts."""
    kids = _kids(node)
    cut = next((k for k, x in enumerate(kids) if x[0] == "mprescripts"), len(kids))
    one = lambda x: "" if x[0] == "none" else _tex(x)
    pairs = lambda xs: "".join((f"_{{{one(a)}}}" if one(a) else "") + (f"^{{{one(b)}}}" if one(b) else "") for a, b in zip(xs[::2], xs[1::2]))
    before = pairs(kids[cut + 1 :])
    return ("{}" + before + " " if before else "") + (_base(_tex(kids[0]), kids[0]) + pairs(kids[1:cut]) if kids else "")


def _limits(tag: str, kids: list) -> str:
    base, text = _tex(kids[0]), _plain(kids[0]).strip()
    marks = [_plain(k).strip() for k in kids[1:]]
    if tag == "mover" and marks[0] in ACCENTS:
        name = ACCENTS[marks[0]][1:]
        if len(text) > 1:
            name = {"hat": "widehat", "tilde": "widetilde", "bar": "overline", "vec": "overrightarrow"}.get(name, name)
        return f"\\{name}{{{base}}}"
    if tag == "munder" and marks[0] in UNDER:
        return f"{UNDER[marks[0]]}{{{base}}}"
    inner = [_tex(k) for k in kids[1:]]
    if text in LARGE or base.split("{")[0] in ("\\int", "\\oint", "\\iint", "\\iiint", "\\overbrace", "\\underbrace"):
        under, over = (inner[0], None) if tag == "munder" else (None, inner[0]) if tag == "mover" else inner
        return base + (f"_{{{under}}}" if under is not None else "") + (f"^{{{over}}}" if over is not None else "")
    if tag == "munderover":
        return f"\\underset{{{inner[0]}}}{{\\overset{{{inner[1]}}}{{{base}}}}}"
    return f"{'\\overset' if tag == 'mover' else '\\underset'}{{{inner[0]}}}{{{base}}}"


def _tex(node) -> str:
    tag, a, _ = node
    kids = _kids(node)
    if tag in LEAVES:
        return _leaf(node)
    if tag in ("msub", "msup", "munder", "mover", "mfrac", "mroot") and len(kids) >= 2:
        x, y = kids[:2]
        if tag == "mfrac":
            thin = a.get("linethickness", "").strip() in ("0", "0px", "0pt", "0em")
            return f"{{{_tex(x)} \\atop {_tex(y)}}}" if thin else f"\\frac{{{_tex(x)}}}{{{_tex(y)}}}"
        if tag == "mroot":
            return f"\\sqrt[{_tex(y)}]{{{_tex(x)}}}"
        return _limits(tag, kids[:2]) if tag in ("munder", "mover") else _base(_tex(x), x) + ("_" if tag == "msub" else "^") + f"{{{_tex(y)}}}"
    if tag == "msubsup" and len(kids) >= 3:
        return _base(_tex(kids[0]), kids[0]) + f"_{{{_tex(kids[1])}}}^{{{_tex(kids[2])}}}"
    if tag == "munderover" and len(kids) >= 3:
        return _limits(tag, kids[:3])
    if tag == "mmultiscripts":
        return _scripts(node)
    if tag == "msqrt":
        return f"\\sqrt{{{_row(node[2])}}}"
    if tag == "mtable":
        return _table(node, "aligned")
    if tag == "mfenced":
        marks = [x for x in a.get("separators", ",") if not x.isspace()]
        inner = [_tex(k) for k in kids]
        parts = [p + ((marks[min(n, len(marks) - 1)] + " ") if marks and n + 1 < len(inner) else "") for n, p in enumerate(inner)]
        fence = lambda x: _symbols(x) or "."
        return f"\\left{fence(a.get('open', '('))}{''.join(parts)}\\right{fence(a.get('close', ')'))}"
    if tag == "mspace":
        return "\\;" if a.get("width", "")[:1].isdigit() and not a["width"].startswith("0") else ""
    if tag == "menclose" and "box" in a.get("notation", ""):
        return f"\\boxed{{{_row(node[2])}}}"
    if tag == "semantics" or tag == "maction":
        return _tex(kids[0]) if kids else ""
    return "" if tag in ("mphantom", "none", "mprescripts") else _row(node[2])
