"""Unclosed dropped elements do not take the rest of the page along."""

import pytest

from tessera.llm import dom

ARTICLE = "<p>The article</p>"


def text(page):
    tree = dom.parse(page)
    return dom.text_of(tree, [True] * len(tree.tag))


@pytest.mark.parametrize("page", [
    f"<datalist><option value=A><option value=B></datalist>{ARTICLE}",
    f"<datalist><optgroup><option>A<option>B</optgroup></datalist>{ARTICLE}",
    f"<option>A{ARTICLE}",
    f"<html><head><title>T</title><meta name=a><link rel=b>\n<script>if (a < b) c = '<p>'</script>{ARTICLE}",
    f"<head><title>T</title>{ARTICLE}</head>",
    f"<head><title>T</title></head><body>{ARTICLE}",
    f"<head><title>T</title>\n<body>{ARTICLE}",
    *(f"<div><{name} class=x>Buy</div>{ARTICLE}" for name in "button svg object canvas audio video select template".split()),
    *(f"<body><{name}>Buy{ARTICLE}" for name in "button svg object canvas audio video select template".split()),
    *(f"<body><{name}>Buy{ARTICLE}<{name}>x</{name}>" for name in "button svg object video".split()),
    f"<div><button>Buy</div>{ARTICLE}</button>",
    f"<svg><svg><title>T</title></svg>more</svg>{ARTICLE}",
    f"<svg><title>T</svg>{ARTICLE}",
    f"<button><div>Buy</div><p>now</button>{ARTICLE}",
    f"<button>Buy<script>'</button>'</script> now</button>{ARTICLE}",
    f"<svg/><object data=a><p>no plugin</p></object>{ARTICLE}",
    f"{ARTICLE}<script>unclosed <p>more",
    f"{ARTICLE}<textarea>unclosed <p>more",
])
def test_only_the_element_is_dropped(page):
    assert text(page) == "The article"


def test_many_unclosed_elements_take_linear_time():
    assert text("<svg><object><option><button>" * 20_000 + ARTICLE) == "The article"


def test_formulas_are_text():
    assert text("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here</p>") == "Energy is E=m here"
    assert text(f"<p>See <math>x{ARTICLE}") == "See x The article"
