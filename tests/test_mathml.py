"""MathML as TeX."""

import pytest

from quillflow.sources import html as H


def shown(inner, attributes=""):
    return [t for k, _, t in H.page_blocks(f"<math{attributes}>{inner}</math>", None) if k != "warning"]


def leaves(text):
    return "".join(f"<m{'n' if c.isdigit() else 'i' if c.isalpha() else 'o'}>{c.replace('<', '&lt;')}</m{'n' if c.isdigit() else 'i' if c.isalpha() else 'o'}>" for c in text)


TABLE = "<mtable><mtr><mtd><mi>x</mi></mtd><mtd><mi>y</mi></mtd></mtr><mtr><mtd><mi>u</mi></mtd><mtd><mi>v</mi></mtd></mtr></mtable>"
CASES = [
    ("<mrow><mfrac><msubsup><mi>x</mi><mn>1</mn><mn>2</mn></msubsup><mroot><mi>y</mi><mn>3</mn></mroot></mfrac><mo>+</mo><msqrt><mrow><mi>α</mi><mo>×</mo><mi>β</mi></mrow></msqrt><mo>=</mo><mover><mi>F</mi><mo>→</mo></mover></mrow>",
     r"\frac{x_{1}^{2}}{\sqrt[3]{y}} + \sqrt{\alpha \times \beta} = \vec{F}"),
    ('<mfenced open="[" close="]"><mi>a</mi><mfrac><mn>1</mn><mi>b</mi></mfrac></mfenced>', r"\left[a, \frac{1}{b}\right]"),
    (TABLE, r"\begin{aligned}x & y \\ u & v\end{aligned}"),
    (f"<mi>A</mi><mo>=</mo><mo>(</mo>{TABLE}<mo>)</mo><mo>+</mo><mn>1</mn>", r"A = \begin{pmatrix}x & y \\ u & v\end{pmatrix} + 1"),
    (f"<mrow><mo>[</mo><mrow>{TABLE}</mrow><mo>]</mo></mrow>", r"\begin{bmatrix}x & y \\ u & v\end{bmatrix}"),
    (f"<mo>{{</mo>{TABLE}", r"\begin{cases}x & y \\ u & v\end{cases}"),
    (f"<msup><mrow>{leaves('(a+b)')}</mrow><mn>2</mn></msup>", "{( a + b )}^{2}"),
    ("<munderover><mo>∑</mo><mrow><mi>i</mi><mo>=</mo><mn>1</mn></mrow><mi>n</mi></munderover><msub><mi>a</mi><mi>i</mi></msub>", r"\sum_{i = 1}^{n} a_{i}"),
    ("<munder><mi>lim</mi><mrow><mi>x</mi><mo>→</mo><mn>0</mn></mrow></munder><mi>sin</mi><mo>&#x2061;</mo><mi>x</mi>", r"\lim_{x \to 0} \sin x"),
    ("<mover><mrow><mi>a</mi><mi>b</mi></mrow><mo>¯</mo></mover><mover><mi>x</mi><mo>^</mo></mover><munder><mi>y</mi><mo>_</mo></munder>", r"\overline{a b} \hat{x} \underline{y}"),
    ("<mover><mi>x</mi><mtext>def</mtext></mover>", r"\overset{\text{def}}{x}"),
    ("<mmultiscripts><mi>X</mi><mi>a</mi><none/><mprescripts/><mi>b</mi><mi>c</mi></mmultiscripts>", "{}_{b}^{c} X_{a}"),
    ('<mfrac linethickness="0"><mi>n</mi><mi>k</mi></mfrac>', r"{n \atop k}"),
    ("<mi mathvariant='double-struck'>R</mi><mo>∋</mo><mi>rank</mi><mo>≤</mo><mn>3</mn><mo>&lt;</mo><mn>5%</mn>", r"\mathbb{R} \ni \operatorname{rank} \le 3 \lt 5\%"),
    ("<mrow><mi>x</mi><script>no()</script><annotation-xml><mtext>no</mtext></annotation-xml><mo>+</mo><mtext>safe text</mtext></mrow>", r"x + \text{safe text}"),
    ("<semantics><mi>x</mi><annotation encoding='application/x-tex'>x^2</annotation></semantics>", "x^2"),
    ("<mi>Γ</mi><mi>ε</mi><mi>ϕ</mi><mi>ς</mi>", r"\Gamma \varepsilon \phi \varsigma"),
    ("<msup><mfrac><mi>a</mi><mi>b</mi></mfrac><mi>c</mi></msup>", r"{\frac{a}{b}}^{c}"),
]


@pytest.mark.parametrize("source, tex", CASES)
def test_formula(source, tex):
    assert shown(source) == [f"${tex}$"] and shown(source, ' display="block"') == [f"$${tex}$$"]


def test_places_and_bounds():
    assert [t for _, _, t in H.page_blocks("<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then <b>y</b>.</p>", None)] == ["If $x = 1$ then **y**."]
    assert shown("") == [] and shown("<mi>q</mi>", ' alttext="x_1"') == ["$x_1$"]
    deep = list(H.page_blocks("<p>a</p><math>" + "<mrow>" * 66 + "<mi>x</mi>" + "</mrow>" * 66 + "</math><p>b</p>", None))
    assert [t for k, _, t in deep if k != "warning"] == ["a", "x", "b"] and [k for k, *_ in deep].count("warning") == 1
    assert shown("<mfrac><mi>a</mi></mfrac><msup/><mtable></mtable>") and shown("<mi>a<mo>b") == ["$\\operatorname{ab}$"]
