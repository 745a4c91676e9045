"""Legal pages that leave tags out, and broken ones: no main text is lost, no hidden text leaks."""

import pytest

from skyweave.llm import op9_html

LONG = "word " * 40 + "end"

CASES = [
    # a head that is never closed
    (f"<html><head><title>t</title><body><p>{LONG}</p></body></html>", [LONG]),
    (f"<head><title>t</title><meta charset=x><p>{LONG}", [LONG]),
    (f"<head><title>t</title><script>a</script>{LONG}", [LONG]),
    (f"<head><style>p{{}}</style><noscript><img src=x></noscript><link rel=x><div>{LONG}</div>", [LONG]),
    (f"<head><title>t</title></head><p>{LONG}<body class=x><p>{LONG}", [LONG, LONG]),
    # hidden elements without an end tag
    (f"<body><p hidden>SECRET<p>{LONG}", [LONG]),
    (f"<p hidden>SECRET<div>{LONG}</div>", [LONG]),
    (f"<ul><li hidden>SECRET<li>{LONG}</ul>", [LONG]),
    (f"<dl><dt hidden>SECRET<dd>{LONG}</dl>", [LONG]),
    (f"<table><tr><td hidden>SECRET<td>{LONG}</table>", [LONG]),
    (f"<table><tr hidden><td>SECRET<td>SECRET<tr><td>{LONG}</table>", [LONG]),
    (f"<table><tbody hidden><tr><td>SECRET<tbody><tr><td>{LONG}</table>", [LONG]),
    (f"<h2 hidden>SECRET<h3>{LONG}</h3>", [LONG]),
    (f"<ul><li>{LONG}<ul><li hidden>SECRET</ul><li>{LONG}</ul>", [LONG, LONG]),
    # end tags inside hidden elements
    (f"<p>{LONG} <span hidden><span>SECRET</span>SECRET</span> after</p>", [LONG, "after"]),
    (f"<div hidden><div>SECRET</div><p>SECRET<p>SECRET</div><p>{LONG}", [LONG]),
    (f"<p>{LONG}<span hidden>SECRET</p><p>{LONG}", [LONG, LONG]),
    (f"<p>{LONG}</p><div style='display:none'><b>SECRET</i>SECRET</b>SECRET<br>SECRET</div>{LONG}", [LONG, LONG]),
    (f"<div hidden><img src=x><input><p>SECRET</p><hr>SECRET</div><p>{LONG}</p>", [LONG]),
    (f"<template><p>SECRET</p><div>SECRET</div></template><p>{LONG}</p>", [LONG]),
    # drawings, selections and buttons that stay open
    (f"<svg><path d=x><text>SECRET</text><p>{LONG}</p>", [LONG]),
    (f"<svg><title>SECRET</title><g/></svg><p>{LONG}</p>", [LONG]),
    (f"<form><select><option>SECRET<option>SECRET</select></form><p>{LONG}", [LONG]),
    # misnested inline elements and ends without a start
    (f"<b><div hidden>SECRET</b>SECRET</div><p>{LONG}", [LONG]),
    (f"</div></p></span></td><p>{LONG}</b></p>", [LONG]),
    (f"<table><tr><td></div>{LONG}</td></tr></table>", [LONG]),
    (f"<p>{LONG}</p></body></html><p>{LONG}</p>", [LONG, LONG]),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_blocks_of_broken_pages(page, want):
    texts, features = op9_html.blocks(page)
    assert texts == want and len(features) == len(want)


def test_broken_pages_keep_their_text():
    for page, want in CASES:
        got = op9_html.extract(page)
        assert "SECRET" not in got and all(t in got for t in want if t == LONG)


def test_boilerplate_ends_where_its_element_does():
    """An inline end tag doesn't close a sidebar, and an omitted one doesn't keep a footer open."""
    menu = "<a href=x>one</a> <a href=x>two</a>"
    page = f"<b><div class=sidebar>{menu}</b> {LONG}</div><ul class=nav><li>{menu}<li>{menu}</ul><article><p>{LONG}<p>{LONG}</article><footer><p>{LONG}"
    assert op9_html.extract(page) == f"{LONG}\n{LONG}"
    rows = op9_html.blocks(page)[1]
    strong = rows[:, op9_html.FEATURES.index("strong")]
    assert strong[0] == 1 and strong[-1] == 0 and rows[-1, op9_html.FEATURES.index("in_boiler")] == 1
