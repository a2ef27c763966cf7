"""reStructuredText: a document of each construct, and that no word is lost."""

import random
import re

import pytest

from skein.operators.rst import rst_markdown, rst_to_markdown

CASES = {
    "sections by order of their adornments": ("=====\nTitle\n=====\n\nOne\n===\n\nTwo\n---\n\nThree\n====\n", "# Title\n\n## One\n\n### Two\n\n## Three"),
    "paragraphs and inline markup": ("Some *soft* and **hard** ``x_ * y``,\non two lines.\n\nAn `emphasis`.", "Some *soft* and **hard** `x_ * y`, on two lines.\n\nAn *emphasis*."),
    "links": ("See `the site <https://a.b/>`_, `named`_, word_ and `other text <word_>`_.\n\n.. _named: https://n.m\n.. _word:\n.. _also: https://w.x/\n   y", "See [the site](https://a.b/), [named](https://n.m), [word](https://w.x/y) and [other text](https://w.x/y)."),
    "a word with an underscore that is no target": ("my_name_ stays, call_me too", "my_name_ stays, call_me too"),
    "roles": (":func:`~a.b`, :ref:`shown <here>`, :math:`x^2`, :strong:`s`", "`a.b`, shown, $x^2$, **s**"),
    "substitutions": ("Use |v| and |logo|.\n\n.. |v| replace:: version *2*\n.. |logo| image:: l.png", "Use version *2* and ![logo](l.png)."),
    "bullets, nested": ("- one\n- two\n  goes on\n\n  - inner\n  - more\n- three", "- one\n- two goes on\n  - inner\n  - more\n- three"),
    "numbers": ("1. one\n2. two\n#. three\n\n(a) x\n(b) y", "1. one\n2. two\n3. three\n4. x\n5. y"),
    "an item of two paragraphs": ("* first\n\n  second\n\n* last", "- first\n\n  second\n\n- last"),
    "definitions": ("term : kind\n    What it is.\nother\n    More.", "**term — kind**\n\nWhat it is.\n\n**other**\n\nMore."),
    "fields": (":Author: A. B.\n:Long field: begins\n   and goes on", "**Author:** A. B.\n**Long field:** begins and goes on"),
    "literal blocks": ("Run this::\n\n    a = 1\n\n      b\n\nAnd::\n\n  c\n\n::\n\n  d", "Run this:\n\n```\na = 1\n\n  b\n```\n\nAnd:\n\n```\nc\n```\n\n```\nd\n```"),
    "quoted literal blocks": ("Said::\n\n> one\n> two\n\nend", "Said:\n\n```\n> one\n> two\n```\n\nend"),
    "code": (".. code-block:: python\n   :linenos:\n\n   def f():\n       return 1\n\nafter", "```python\ndef f():\n    return 1\n```\n\nafter"),
    "code with fences": ("::\n\n   ```\n   x\n   ```", "````\n```\nx\n```\n````"),
    "doctest": (">>> 1 + 1\n2\n\nnext", "```python\n>>> 1 + 1\n2\n```\n\nnext"),
    "notes": (".. note:: Mind the *gap*.\n\n.. warning::\n\n   First.\n\n   - a\n\n.. versionadded:: 3.5\n   The thing.", "> **Note:** Mind the *gap*.\n\n> **Warning:** First.\n>\n> - a\n\n> **New in version:** 3.5\n>\n> The thing."),
    "images": (".. figure:: a.png\n   :alt: A pic\n\n   The caption.\n\n.. image:: b.png", "![A pic](a.png)\n\nThe caption.\n\n![](b.png)"),
    "hidden": (".. toctree::\n   :maxdepth: 2\n\n   a\n   b\n\n.. a comment\n   of two lines\n\nshown", "shown"),
    "grid table": ("+-----+-------+\n| a   | b     |\n+=====+=======+\n| 1   | two   |\n|     | lines |\n+-----+-------+\n| x|y | **z** |\n+-----+-------+", "| a | b |\n| --- | --- |\n| 1 | two lines |\n| x\\|y | **z** |"),
    "grid table with a span": ("+---+---+\n| wide  |\n+---+---+\n| a | b |\n+---+---+", "|  |  |\n| --- | --- |\n| wide |  |\n| a | b |"),
    "simple table": ("===  =====\nk    v\n===  =====\n1    one\n     more\n2    two\n===  =====\n\nend", "| k | v |\n| --- | --- |\n| 1 | one more |\n| 2 | two |\n\nend"),
    "list table": (".. list-table:: Things\n   :header-rows: 1\n\n   * - a\n     - b\n   * - 1\n     - 2", "**Things**\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"),
    "csv table": ('.. csv-table::\n   :header: "x", "y"\n\n   1, "a, b"', "| x | y |\n| --- | --- |\n| 1 | a, b |"),
    "line blocks": ("| one\n| two\n  on\n|\n| four", "one  \ntwo on  \n  \nfour"),
    "block quotes": ("Said:\n\n   Wise words.\n\n   - list\n\nend", "Said:\n\n> Wise words.\n>\n> - list\n\nend"),
    "transitions": ("before\n\n----\n\nafter", "before\n\n---\n\nafter"),
    "footnotes": ("Known [1]_.\n\n.. [1] From here\n   and there.", "Known [^1].\n\n[^1]: From here and there."),
    "math": (".. math::\n\n   x = y", "$$\nx = y\n$$"),
    "escapes": (r"a\*b\*c and re\ ``x``", "a*b*c and re`x`"),
    "objects": (".. py:function:: f(x)\n\n   Does it.", "**function** `f(x)`\n\nDoes it."),
    "nothing": ("", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_construct(name):
    text, want = CASES[name]
    assert rst_markdown(text) == want


def test_any_text_ends_and_keeps_its_words(spark, sf_dir):
    """Lines of documents under random marks and indentations: every word comes out, whatever the structure."""
    r = random.Random(8)
    texts = [t.text for t in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect() if t.text]
    for text in texts:
        lines = [r.choice(["", "  ", "    ", "- ", "1. ", "   - "]) + x for x in text.split("\n")]
        words = lambda s: sorted(re.findall(r"[^\W_]{4,}", s))
        got = rst_markdown("\n".join(lines))
        assert set(words(re.sub(r"`\S*`|https?\S*", "", "\n".join(lines)))) <= set(words(got))


def test_by_row(spark):
    docs = spark.createDataFrame([(1, "T\n=\n\nx"), (2, None), (3, ""), (4, "Top\n===\n\n- x")], "k long, text string")
    assert {r.k: (r.title, r.markdown) for r in rst_to_markdown(docs, "k").collect()} == {1: (None, "T =\n\nx"), 2: (None, None), 3: (None, ""), 4: ("Top", "# Top\n\n- x")}
