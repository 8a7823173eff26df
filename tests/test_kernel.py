"""The text kernel: lossless trees, golden expansions and HTML, near-linear time."""

from __future__ import annotations

import random
import time
from dataclasses import replace

import pytest

from markloom.config import DEFAULT
from markloom.kernel import parse as kernel
from markloom.kernel import shapes
from markloom.kernel.expand import Expander, call, evaluate, register_function
from markloom.kernel.parse import FIELDS, clean, parse, rows, table
from markloom.kernel.render import highlight, register_tag, render
from markloom.kernel.titles import normalise


def leaves(text: str, **kw) -> str:
    body = clean(text)
    found = rows(parse(body, **kw), body)
    return "".join(r["data"] for r in sorted((r for r in found if r["type"] == "text"), key=lambda r: r["start"]))


PIECES = ["{{", "}}", "{{{", "}}}", "[[", "]]", "|", "=", "''", "'''", "\n", "== h ==", "* ", "; a : b", "{|", "|-", "|}", "! x", "<ref>", "</ref>", "<!--", "-->", "<b>", "</b>", "<nowiki>", "</nowiki>", "a", " ", "http://x.y/z", "[http://x.y z]", "#", "ISBN 1234567890", "__TOC__", "----", "File:A.png", "-{", "}-", "é𝒳"]


def test_every_tree_is_lossless():
    rng = random.Random(11)
    for _ in range(1500):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 40)))
        assert leaves(text) == clean(text)
        assert leaves(text, include=True) == clean(text)


def test_nested_sets_hold():
    text = "{{a|b={{c}}}} [[d|''e'']]\n{|\n| x || {{y}}\n|}"
    found = rows(parse(text), text)
    by = {r["node_id"]: r for r in found}
    for r in found:
        if r["parent_id"] is not None:
            p = by[r["parent_id"]]
            assert p["node_id"] < r["node_id"] <= p["last_id"] and p["start"] <= r["start"] <= r["end"] <= p["end"]
            assert [a["id"] for a in r["anc"]][-1] == p["node_id"] and len(r["anc"]) == r["depth"]


def types(text: str, **kw) -> list[str]:
    body = clean(text)
    return [r["type"] for r in rows(parse(body, **kw), body) if r["type"] not in ("text", "root")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("#REDIRECT [[A]]", ["redirect", "redirect-syntax", "redirect-target", "link-target"]),
        ("<!-- x", ["comment"]),
        ("{{{a|b|c}}}", ["arg", "arg-name", "arg-default", "hidden"]),
        ("{{a b|c}}", ["template", "template-name", "parameter", "parameter-key", "parameter-value"]),
        ("{{#if:x|y}}", ["magic-word", "magic-word-name", "parameter", "parameter-key", "parameter-value"] + ["parameter", "parameter-key", "parameter-value"]),
        ("{{a[b}}", []),
        ("[[:File:A.png]]", ["link", "link-target"]),
        ("[[Category:A|k]]", ["category", "link-target", "link-text"]),
        ("[[a\nb]]", []),
        ("''''a''''", ["quote", "quote"]),
        ("RFC 123", ["magic-link"]),
        ("__NOTOC__ __nope__", ["double-underscore"]),
        ("<unknown>", []),
        ("<br/>", ["html"]),
        ("; a : b", ["list", "dd"]),
    ],
)
def test_node_types(text, want):
    assert types(text) == want


def test_quote_repair():
    body = "a '''b ''c''' d"
    marks = [(r["start"], r["end"]) for r in rows(parse(body), body) if r["type"] == "quote"]
    assert marks == [(2, 5), (7, 9), (10, 13)]


TEMPLATES = {"Template:T": "<noinclude>doc</noinclude>[{{{1|none}}}/{{{k|}}}]", "Template:Loop": "{{Loop}}", "Template:List": "* a", "Template:Deep": "{{T|{{{1}}}|k={{{2}}}}}"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{{T}}", "[none/]"), ("{{T|x|k= y }}", "[x/y]"), ("{{T|a|1=b}}", "[b/]"), ("{{deep|p|q}}", "[p/q]"), ("{{Loop}}", '<span class="error">Template loop detected: [[Template:Loop]]</span>'),
        ("x {{List}}", "x \n* a"), ("{{Missing|a}}", "{{Missing|a}}"), ("{{#if: |a|b}}", "b"), ("{{#ifeq:01|1.0|y|n}}", "y"), ("{{#switch:c|a=1|b|c=2|#default=3}}", "2"), ("{{#switch:z|a=1|9}}", "9"),
        ("{{#expr:2^3 mod 5 + 1/4}}", "3.25"), ("{{#expr:1/0}}", '<strong class="error">Expression error: Division by zero.</strong>'), ("{{#iferror:{{#expr:(}}|bad|ok}}", "bad"), ("{{uc:{{lc:Ab}}}}", "AB"),
        ("{{padleft:xyz|2|_}}", "xyz"), ("{{padleft:7|3}}", "007"), ("{{#titleparts:a/b/c|2}}", "a/b"), ("{{#rel2abs:../x|a/b}}", "a/x"), ("{{#len:  ab }}", "2"), ("{{#sub:abcdef|-3|2}}", "de"), ("{{#pos:abc|z}}", ""), ("{{#rpos:abab|b}}", "3"),
        ("{{#explode:a,b,c|,|-1}}", "c"), ("{{#replace:aXbX|X|-}}", "a-b-"), ("{{plural:1|page|pages}}", "page"), ("{{ns:10}}", "Template"), ("{{FULLPAGENAME}}", "User:A/b"), ("{{SUBPAGENAME}}", "b"), ("{{TALKPAGENAME}}", "User talk:A/b"),
        ("{{CURRENTYEAR}}-{{CURRENTMONTHNAME}}", "1970-January"), ("{{urlencode:a b|WIKI}}", "a_b"), ("{{localurl:a b}}", "/wiki/A_b"), ("a{{!}}b", "a|b"), ("{{#tag:ref|x|name=n}}", '<ref name="n">x</ref>'), ("<!-- c -->a", "a"),
    ],
)
def test_expansion(text, want):
    assert Expander(TEMPLATES, page="User:A/b").page_text(text) == want


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("a<onlyinclude>b</onlyinclude>c", "b"), ("a<onlyinclude>b{{{1}}}</onlyinclude>c<onlyinclude>{{T}}</onlyinclude>", "bx[none/]"), ("a<onlyinclude>b", "ab"),
        ("<onlyinclude>a<noinclude>n</noinclude><includeonly>i</includeonly></onlyinclude>z", "ai"), ("<includeonly>i</includeonly><noinclude>n</noinclude>", "i"),
    ],
)
def test_inclusion_tags(body, want):
    assert Expander({**TEMPLATES, "Template:P": body}).page_text("{{P|x}}") == want


def test_pages_show_their_onlyinclude_parts_and_the_rest():
    assert types("a<onlyinclude>{{b}}</onlyinclude>c") == ["noinclude", "template", "template-name", "noinclude"]
    assert types("a<onlyinclude>{{b}}</onlyinclude>c", include=True) == ["noinclude", "onlyinclude", "template", "template-name", "noinclude"]


def test_translate():
    config = replace(DEFAULT, ext=DEFAULT.ext | {"translate", "tvar"})
    text = "<translate nowrap>a <tvar name=x>[[b]]</tvar> <tvar|y>c</> <nowiki></translate></nowiki></translate> d"
    found = [r for r in rows(parse(text, config), text) if r["type"] != "text"]
    assert [r["type"] for r in found] == ["root", "translate", "translate-attr", "translate-inner", "tvar", "link", "link-target", "tvar", "tvar", "tvar", "ext", "ext-inner"]
    assert Expander({"Template:P": "<translate>{{{1}}}</translate>!"}, config=config).page_text("{{P|x}}") == "x!"
    assert "".join(r["data"] for r in rows(parse(text, config), text) if r["type"] == "text") == text


@pytest.mark.parametrize(
    ("text", "colons"),
    [
        ("; a : b", [4]), ("; a <b>x:y</b> : d", [15]), ("; a ''x:y'' : d", [12]), ("; [[x:y]] : d", [10]), (";; a : b : c", [5, 9]), ("; a : b : c", [4]), ("* a : b", []), ("; a -{x:y}- : b", [12]),
        (";; a :: b", [5]), ("; a <br> : b", [9]), ("; a </b> : b", [9]), ("; '''a : b", []), (";\n; t : d", [6]), ("*; a\n*; b : c", [10]),
    ],
)
def test_terms_end_at_colons(text, colons):
    assert [r["start"] for r in rows(parse(text), text) if r["type"] == "dd"] == colons


def test_inner_models_of_tags():
    config = replace(DEFAULT, ext=DEFAULT.ext | set("poll choose option choicetemplate combobox combooption seo tab tabs dynamicpagelist".split()))

    def inner(text):
        found = rows(parse(text, config), text)
        assert "".join(r["data"] for r in found if r["type"] == "text") == text
        return [(r["type"], text[r["start"] : r["end"]]) for r in found if r["type"] not in ("text", "root", "ext", "ext-inner") and "attr" not in r["type"]]

    assert inner("<pre>[[a]] <nowiki>b</nowiki></pre>") == [("noinclude", "<nowiki>"), ("noinclude", "</nowiki>")]
    assert inner("<pre format=wikitext>[[a]]</pre>") == [("link", "[[a]]"), ("link-target", "a")]
    assert inner("<seo>title=a|b = c</seo>") == [("param-line", "title=a"), ("param-line", "b = c")]
    assert inner("<hiero>A1<!-- x -->B</hiero>") == [("comment", "<!-- x -->")]
    assert inner("<choose>x<option>[[a]]</option></choose>") == [("noinclude", "x"), ("link", "[[a]]"), ("link-target", "a")]
    assert inner("<combobox><combooption>[[a]]</combooption> <b></combobox>") == [("link", "[[a]]"), ("link-target", "a"), ("noinclude", " <b>")]
    assert inner("<references>x<ref>[[a]]</ref></references>") == [("noinclude", "x"), ("link", "[[a]]"), ("link-target", "a")]
    assert inner("<charinsert>a+b c\n<nowiki>d e</nowiki></charinsert>") == [("charinsert-line", "a+b c"), ("charinsert-item", "a+b"), ("charinsert-item", "c"), ("charinsert-line", "<nowiki>d e</nowiki>"), ("charinsert-item", "<nowiki>d e</nowiki>")]
    assert inner("<poem>== a ==\n[[b]]</poem>") == [("link", "[[b]]"), ("link-target", "b")]


def test_nested_converters():
    config = replace(DEFAULT, variants=("zh-cn", "zh-tw"))
    text = "-{zh-cn:a; x=>zh-tw:-{R|b}-}-"
    found = [r for r in rows(parse(text, config), text) if r["type"] in ("converter", "converter-rule")]
    assert [(r["type"], r["start"]) for r in found] == [("converter", 0), ("converter-rule", 2), ("converter-rule", 10), ("converter", 20), ("converter-rule", 24)]
    assert found[2]["props"] == {"variant": "zh-tw", "from": "x", "to": "-{R|b}-"}


def test_constant_solving_leaves_templates():
    assert Expander(TEMPLATES, constant=True).page_text("{{#if:x|{{T}}|n}}") == "{{T}}"


def test_hooks_and_calls():
    register_function("shout", lambda s="": s.upper() + "!")
    assert call("shout", ["hi"]) == "HI!" and call("uc", ["x"]) == "X" and call("nothing", []) is None
    register_tag("score", lambda attrs, inner: f"<b>{inner}</b>")
    assert render("<score>x</score>") == "<p><b>x</b>\n</p>"
    assert evaluate("1 + 2 * 3") == 7 and evaluate(" ") is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("'''''a''' b''", "<p><i><b>a</b> b</i>\n</p>"),
        ("'''a\nb", "<p><b>a</b>\nb\n</p>"),
        ("* a\n* b\n*# c", "<ul><li>a</li>\n<li>b<ol><li>c</li></ol></li></ul>"),
        ("; t : d", "<dl><dt>t</dt>\n<dd>d</dd></dl>"),
        ("a\n\nb", "<p>a\n</p>\n<p>b\n</p>"),
        (" pre", "<pre>pre\n</pre>"),
        ("== A ==\n== A ==", '<h2 id="A">A</h2>\n<h2 id="A_2">A</h2>'),
        ("[[a|b]] [[a#c]]", '<p><a href="/wiki/A" title="A">b</a> <a href="/wiki/A#c" title="A">a#c</a>\n</p>'),
        ("a & b < c", "<p>a &amp; b &lt; c\n</p>"),
        ("<p onclick=\"x\" class=\"q\">y</p>", '<p class="q">y</p>'),
        ("<nowiki>''x''</nowiki>", "<p>''x''\n</p>"),
        ("{|\n! a\n|-\n| b || c\n|}", "<table>\n<tbody><tr>\n<th>a\n</th></tr>\n<tr>\n<td>b\n</td>\n<td>c\n</td></tr></tbody></table>"),
        ("----", "<hr>"),
    ],
)
def test_html(text, want):
    assert render(text) == want


def test_highlight_is_lossless():
    import html
    import re

    text = "{{a|<b>}} & [[c]] '''d'''"
    assert html.unescape(re.sub(r'<span class="wl-[\w-]+">|</span>', "", highlight(parse(text), text))) == text


@pytest.mark.parametrize(
    ("raw", "title", "ns", "valid"),
    [("template:foo_bar", "Foo bar", 10, True), (" : image:x.png ", "X.png", 6, True), ("a%20b", "A b", 0, True), ("a<b", "A<b", 0, False), ("../x", "../x", 0, False), ("", "", 0, False), ("x#y", "X", 0, True)],
)
def test_titles(raw, title, ns, valid):
    t = normalise(raw)
    assert (t.main, t.ns, t.valid) == (title, ns, valid)


#: Without the ancestors of every node, whose number is nodes times depth.
PLAIN = frozenset(FIELDS) - {"anc"}
REPEATS = ["{{a|b}}", "[[a|b]]", "'''a''' ", "<b>x</b>", "* a\n", "== h ==\n", "<ref>x</ref>", "<!-- c -->", "{|\n| a\n|}\n", "[http://x.y z] ", "http://x.y ", "{{{a|b}}}", "__TOC__", "----\n", "{{", "[[", "{|\n", "'''", "<b", "-{a}-"]


@pytest.mark.parametrize("piece", REPEATS)
def test_time_is_near_linear(piece):
    text = piece * 10_000
    began = time.time()
    n = len(table(parse(text), text, PLAIN))
    assert n >= 2 and time.time() - began < 12


@pytest.mark.parametrize(("opens", "closes", "kind"), [("{{a|", "}}", "template"), ("{|\n|\n", "\n|}", "table"), ("<ref><poem>", "</poem></ref>", "ext"), ("{{{a|", "}}}", "arg"), ("[[File:A.png|", "]]", "file")])
def test_deep_nesting_is_parsed(opens, closes, kind):
    depth = 300 if kind != "ext" else 1  # an extension tag holds none of its own name
    text = opens * depth + "x" + closes * depth
    found = rows(parse(text), text)
    assert sum(r["type"] == kind for r in found) == depth * (2 if kind == "ext" else 1)
    assert "".join(r["data"] for r in found if r["type"] == "text") == text


def test_positions_of_nodes():
    text = "ab\n== h ==\n{{x}} y"
    found = {r["type"]: r for r in rows(parse(text), text) if r["type"] != "text"}
    assert [found["template"][k] for k in ("line", "col", "end_line", "end_col")] == [2, 0, 2, 5]
    assert [found["heading"][k] for k in ("line", "col", "end_line", "end_col")] == [1, 0, 1, 7]
    assert found["heading"]["props"]["title"] == "h" and found["heading"]["props"]["source"] == " h "


def test_plain_numbers_are_not_taken_through_the_stages(monkeypatch):
    from markloom.kernel import parse as kernel

    seen = []
    monkeypatch.setattr(kernel.Parser, "_urls", lambda self, parent, start, end, depth, skip, f=kernel.Parser._urls: (seen.append(self.text[start:end]), f(self, parent, start, end, depth, skip))[1])
    text = "{|\n| 12 || rfc 13\n|}"
    types = [r[6] for r in kernel.table(kernel.parse(text), text)]
    assert " 12 " not in seen and " rfc 13\n" in seen and types.count("magic-link") == 1


# -- shapes


def _columns(text, columns, types, config=DEFAULT):
    found = kernel.table(kernel.parse(text, config), text, frozenset(columns), types, config)
    return [[r[kernel.FIELDS.index(c)] for r in found] for c in columns]


def test_pages_of_one_shape_are_parsed_once(monkeypatch):
    """Words and their lengths don't matter, and the rows are those of the parser."""
    page = "{{| class=\"{0}\"\n|+ Order {1}\n! line !! {2}=2 | é {0}\n|-\n| {1} || style='color:#{1}' id={2} | {0}\n|}}\n* {0}:{1}\n"
    texts = [page.format(*words) for words in (("wikitable", 7, "colspan"), ("A", 123456, "Style"), ("x9", 0, "style"))]
    columns = [c for c in kernel.FIELDS if c not in ("line", "col", "end_line", "end_col")]
    for types in (None, frozenset(["td", "table-attr", "td-inner"])):
        want = [_columns(t, columns, types) for t in texts]
        made = shapes.Tables(DEFAULT, columns, types)
        calls = []
        with monkeypatch.context() as m:
            m.setattr(kernel, "parse", lambda *a, f=kernel.parse: calls.append(a) or f(*a))
            got = [made.of(t, False, "") for t in texts]
        assert [[list(c) for c in cols] for _, cols in got] == want
        assert [n for n, _ in got] == [len(w[0]) for w in want]
        assert len(calls) == 1


@pytest.mark.parametrize(
    "first, second",
    [
        ("| ab:c", "| tel:5"), ("| abc 12", "| RFC 12"), ("| abcd 9780306406157", "| ISBN 9780306406157"), ("| abcdefghi=1 a=2 | c", "| itemscope=1 a=2 | c"),
        ("| a]b", "| aaa]b"), ("| <b>c</b>", "| <i>c</i>"), ("| {{T}}", "| {{!}}"), ("| [[A]]", "| [[B]]"), ("| a''b", "| c''d"), ("| __ABC__", "| __TOC__"), ("| style=\"a  b\" | c", "| style=\"aa  b\" | c"),
    ],
)
def test_words_that_matter_have_no_shape(first, second):
    columns = [c for c in kernel.FIELDS if c not in ("line", "col", "end_line", "end_col")]
    made = shapes.Tables(DEFAULT, columns, None)
    for line in (first, second, first):
        text = f"{{|\n{line}\n|}}"
        assert [list(c) for c in made.of(text, False, "")[1]] == _columns(text, columns, None)


def test_words_of_the_same_lengths_are_not_looked_for(monkeypatch):
    """Such pages share their places, and the lists of what is no page's own."""
    page = "{{|\n|-\n| {0} || style=\"color:#{1}\" | {0}\n|}}\n"
    columns = ["node_id", "type", "start", "attrs", "text"]
    made = shapes.Tables(DEFAULT, columns, None)
    for words in ((7, "a1"), (8, "b2")):
        made.of(page.format(*words), False, "")
    monkeypatch.setattr(shapes, "WORD", None)
    got = [made.of(page.format(*words), False, "")[1] for words in ((9, "c3"), (5, "d4"))]
    assert [[list(c) for c in cols] for cols in got] == [_columns(page.format(*words), columns, None) for words in ((9, "c3"), (5, "d4"))]
    assert [a is b for a, b in zip(*got, strict=True)] == [True, True, True, False, False]


def test_tasks_of_a_worker_share_shapes():
    asked = (DEFAULT, ["node_id"], frozenset(["tr"]))
    assert shapes.tables(*asked) is shapes.tables(*asked) is not shapes.tables(DEFAULT, ["node_id"], None)


@pytest.mark.parametrize("first, second", [("| bttp:x", "| http:x"), ("| abc 12", "| RFC 12"), ("| abcdefghi=1 a=2 | c", "| itemscope=1 a=2 | c")])
def test_words_that_matter_are_not_cut(first, second):
    made = shapes.Tables(DEFAULT, ["type", "text"], None)
    for line in (first, first, second):
        text = f"{{|\n{line}\n|}}"
        assert [list(c) for c in made.of(text, False, "")[1]] == _columns(text, ["type", "text"], None)
    assert made.cuts


def _batches(texts, columns, types, monkeypatch, first=0):
    """Rows of each page by the kernel of a batch, and how many pages were told one by one."""
    import pyarrow as pa

    from markloom.plans import parse as plan

    monkeypatch.setattr(plan, "FIRST", first)
    run = plan._kernel(DEFAULT, ["page_id", *columns], types, "convert", "raise")
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(texts))), "title": [""] * len(texts), "text": texts, "include": [False] * len(texts)})
    alone, rows = [], {}
    monkeypatch.setattr(shapes.Tables, "of", lambda self, *a, f=shapes.Tables.of: alone.append(a) or f(self, *a))
    for out in run(iter([batch])):
        for r in out.to_pylist():
            rows.setdefault(r.pop("page_id"), []).append(list(r.values()))
    return [rows.get(k, []) for k in range(len(texts))], len(alone)


def test_pages_of_a_cut_are_told_at_once(monkeypatch):
    """The rows are those of the parser, also beside pages that share no cut."""
    page = "{{|\n|+ Order {0}\n! line !! COLSPAN=2 | part\n|-\n| {0} || style=\"color:#{1}\" | {1}\n|}}\n"
    odd = ["RFC 12", "é", "\r\n", "", None, "{|\n| ab=1 ac=2 | x\n|}", "{|\n| ab=1 ab=2 | x\n|}", "{|\n| http:x\n|}", "<b>x</b>"]
    texts = [page.format(100 + k, "a%d" % (k % 10)) for k in range(40)] + odd + [page.format(100 + k, "B%d" % (k % 10)) for k in range(40)] + odd
    columns = [c for c in kernel.FIELDS if c not in ("line", "col", "end_line", "end_col")]
    for types in (None, frozenset(["td", "table-attr", "td-inner"])):
        monkeypatch.setattr(shapes, "_LAST", [])
        with monkeypatch.context() as m:
            got, alone = _batches(texts, columns, types, m, first=30)
        assert alone < 60
        for text, rows in zip(texts, got, strict=True):
            want = _columns(shapes.kernel.clean(text), columns, types)
            plain = [[dict(v) if c in ("attrs", "props") else [(x["id"], x["type"]) for x in v] if c == "anc" else v for c, v in zip(columns, r, strict=True)] for r in rows]
            assert plain == [[list(v) if c == "anc" else v for c, v in zip(columns, r, strict=True)] for r in zip(*want, strict=True)]
