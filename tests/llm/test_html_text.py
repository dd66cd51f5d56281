import html
import random
import re
import time

import pytest

from fotolake.llm.html_text import html_text, render

CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b</div>": "a\nb",
    "<b>x<p>y</b>z</p>": "x\n\nyz",
    "<title>t</title><p>a  \n b": "a b",
    "<head><meta><title>t</title><p>in body": "in body",
    "<p>a<script>if (a<b) '</p>'</script>c": "ac",
    "<p hidden>a</p><p style='display: none'>b</p><p>c": "c",
    "<p style='visibility:hidden'>a<b style='visibility:visible'>b</b></p>": "b",
    "<details><summary>s</summary>gone</details><details open><summary>s</summary>here</details>": "s\ns\nhere",
    "a<br>b<br><br>c": "a\nb\n\nc",
    "<form>a <input type=submit value=Go> <input value=typed><input type=BUTTON value='x &amp; y' hidden><input type=reset value=No></form>": "a Go No",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>f": "- a\n- b\n  3. c\n  4. d\n- e\n\nf",
    "<pre>\na\n  b\n\nc</pre>": "a\n  b\n\nc",
    "<table><tr><th>n<th>value<tr><td>long name<td>1</table>": "n         | value\nlong name | 1",
    "<table><td colspan=2>wide cell<tr><td>a<td>b</table>": "wide cell\na | b",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a | b\n  | c",
    "<table><tr><td>x<table><tr><td>1<td>2</table><td>y</table>": "x     | y\n      |\n1 | 2 |",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\n  d\nu\n  e",
    "1 < 2 <!-- no --> yes <!doctype html>": "1 < 2 yes",
    "<h1>A</h2><p>b</h1>c": "A\n\nbc",
    "<option>a<option>b": "a\nb",
    "x&nbsp;&nbsp;y": "x  y",
    "<p title='a>b'>c</p><p title=\"q\">d": "c\n\nd",
}


@pytest.mark.parametrize("source", CASES)
def test_layout(source):
    assert render(source) == CASES[source]


def test_depth_and_length():
    assert render("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert render("<ul><li>" * 300 + "x").endswith("- x")
    began = time.process_time()
    assert render("<ul><li>" * 20_000 + "x").endswith("- x") and len(render("<ul><li>x" * 10_000)) < 10_000 * 100
    assert render("<i>" * 10_000 + "<b>" * 10_000 + "x" + "</i>" * 10_000 + "y") == "xy"
    assert time.process_time() - began < 10
    assert len(render("word " * 400_000)) == 1_999_999


def test_rows(spark):
    df = spark.createDataFrame([(1, "<p>a"), (None, None), (1, "<p>a"), (2, "")], "page_id long, html string").selectExpr("*", "'x' as text", "1 as id")
    assert sorted(map(repr, (tuple(r) for r in html_text(df).collect()))) == sorted(map(repr, [(1, "a"), (None, ""), (1, "a"), (2, "")]))
    assert html_text(df.limit(0)).collect() == []


def test_forms_formulas_and_labels():
    from fotolake.llm.html_text import render

    assert render("<p>a</p><textarea>\n x  y\n  z</textarea><p>b") == "a\n\n x  y\n  z\n\nb"
    assert render("a<select><optgroup><option>one<option>two</optgroup></select>b<datalist><option>no</datalist>") == "a\none\ntwo\nb"
    assert render("so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds") == "so x=2 holds"
    assert render("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><linearGradient id=g /><text>label</text><text>other</text></svg> end") == "label\nother\nend"
    assert render("<map name=m>see <a href=x>here</a><area></map>") == "see here"


def test_scripts_objects_and_dialogs():
    assert render("<noscript>no <b>script</b></noscript><object data=x>in its place</object>") == "no scriptin its place"
    assert render("a<dialog>no</dialog><dialog open>yes</dialog>b") == "a\nyes\nb"
    assert render("<i>a<b>c</i>d</b>e<i>f</b>g</i>") == "acdefg"


#: Blank lines around the blocks of the trees below.
AROUND = {"p": 1, "h2": 1, "pre": 1, "ul": 1, "ol": 1, "table": 1, "blockquote": 1, "div": 0, "li": 0, "section": 0}


def tree(rng, depth, inside=""):
    """A random tree: a text, or (tag, children)."""
    if depth == 0 or rng.random() < 0.35:
        return rng.choice(["word", "two words", " lead", "trail ", "a < b & c", "  ", "\n"])
    kinds = ["b", "span", "br", "gone", "unseen"] if inside in ("p", "h2") else ["div", "p", "h2", "ul", "ol", "table", "pre", "b", "blockquote", "section", "gone", "unseen"]
    tag = rng.choice(kinds)
    some = lambda within: [tree(rng, depth - 1, within) for _ in range(rng.randrange(1, 4))]
    if tag == "br":
        return tag, []
    if tag in ("ul", "ol"):
        return tag, [("li", some("")) for _ in range(rng.randrange(1, 4))]
    if tag == "table":
        return tag, [("tr", [("td", some("p")) for _ in range(rng.randrange(1, 4))]) for _ in range(rng.randrange(1, 4))]
    if tag == "unseen":
        return tag, ["hidden words"]
    if tag == "pre":
        return tag, [rng.choice(["x  y", "one\n  two", "q"])]
    return tag, some("p" if inside in ("p", "h2") or tag in ("p", "h2", "b", "span") else "")


def source(node, rng):
    if isinstance(node, str):
        return html.escape(node)
    tag, children = node
    inner = "".join(source(c, rng) for c in children)
    if tag in ("gone", "unseen"):
        return f"<span style='display:none'>{inner}</span>" if tag == "gone" else f"<span style='visibility:hidden'>{inner}</span>"
    if tag == "br":
        return "<br>"
    return f"<{tag}>{inner}" + ("" if tag in ("li", "td", "tr") and rng.random() < 0.5 else f"</{tag}>")


def tokens(node, listed=False):
    """Of a tree, in order: ("text", s), ("raw", s), ("br",), ("edge", blank lines), ("in", lead, mark) and ("out",)."""
    if isinstance(node, str):
        yield "text", node
        return
    tag, children = node
    if tag == "gone" or tag == "unseen":
        return
    if tag == "br":
        yield ("br",)
        return
    if tag == "table":
        yield "edge", 1
        rows = [[layout([t for c in cell[1] for t in tokens(c)]) for cell in row[1]] for row in children]
        wide = [max((len(x) for row in rows if k < len(row) for x in row[k]), default=0) for k in range(max(map(len, rows)))]
        for row in rows:
            for i in range(max(map(len, row), default=0)):
                line = " | ".join((c[i] if i < len(c) else "").ljust(w) for c, w in zip(row, wide))
                yield "raw", line.rstrip()
                yield "edge", 0
        yield "edge", 1
        return
    around = AROUND.get(tag)
    if tag in ("ul", "ol") and listed:
        around = 0
    if around is not None:
        yield "edge", around
    for n, child in enumerate(children, 1):
        if tag in ("ul", "ol"):
            mark = f"{n}. " if tag == "ol" else "- "
            yield "edge", 0
            yield "in", " " * len(mark), mark
            for c in child[1]:
                yield from tokens(c, True)
            yield "edge", 0
            yield ("out",)
        elif tag == "pre":
            for k, part in enumerate(child.split("\n")):
                if k:
                    yield "edge", 0
                yield "raw", part
        else:
            if tag == "blockquote" and n == 1:
                yield "in", "  ", ""
            yield from tokens(child, listed)
    if tag == "blockquote":
        yield "edge", 0
        yield ("out",)
    if around is not None:
        yield "edge", around


def layout(stream):
    """Lines of tokens."""
    lines, line, gap, leads, mark = [], "", 0, [], ""

    def end(keep=False):
        nonlocal line, gap, mark
        text = line.rstrip()
        line = ""
        if not text and not keep:
            return
        if gap and lines and lines[-1]:
            lines.append("")
        gap = 0
        lead = "".join(leads)
        if text and mark:
            lead, mark = lead[: len(lead) - len(mark)] + mark, ""
        lines.append(lead + text if text else "")

    for kind, *rest in stream:
        if kind == "text":
            text = " ".join(x for x in re.split("[ \n]+", rest[0]) if x)
            text = (" " if rest[0][:1] in " \n" else "") + text + (" " if text and rest[0][-1:] in " \n" else "")
            line += text[1:] if text[:1] == " " and (not line or line[-1] == " ") else text
        elif kind == "raw":
            line += rest[0]
        elif kind == "br":
            end(bool(line) or bool(lines))
        elif kind == "edge":
            end()
            gap = max(gap, rest[0])
        elif kind == "in":
            leads.append(rest[0])
            mark = rest[1] or mark
        else:
            leads.pop()
            mark = ""
    end()
    while lines and not lines[-1]:
        lines.pop()
    return lines


def test_against_a_tree_renderer():
    rng = random.Random(3)
    for _ in range(3000):
        nodes = [tree(rng, 4) for _ in range(rng.randrange(1, 4))]
        page = "".join(source(n, rng) for n in nodes)
        assert render(page) == "\n".join(layout([t for n in nodes for t in tokens(n)])), page
