"""Elements as intervals against a walk over the tags with stacks."""

import random
import re

import pytest

from ladderline.functions import boxes

KINDS = ["div", "li", "b"]


def walked(html):
    """Elements by a stack for each kind; what is not closed reaches to the end."""
    page = re.sub(boxes.OPAQUE, "", html or "")
    opened, out = {k: [] for k in KINDS}, []
    for m in re.finditer(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>", page):
        name = m[2].lower()
        if name not in KINDS:
            continue
        if not m[1]:
            css = re.search(r"""\sclass\s*=\s*["']([^"'>]*)["']""", m[3])
            element = [name, css[1] if css else "", m.start(), len(page)]
            opened[name].append(element)
            out.append(element)
        elif opened[name]:
            opened[name].pop()[3] = m.end()
    return sorted(map(tuple, out))


def pages(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id int, html string")


@pytest.mark.parametrize("stray", [False, True])
def test_elements_are_those_of_a_walk(spark, stray):
    rng = random.Random(stray)
    texts = [None, "", "no tags", "a < b > c", '<DIV CLASS="x">é</DIV >', "<div><!-- <div> --><script>'<li>'</script></div>", "<div><li><b></div>"]

    def nested(depth):
        parts = [rng.choice(["text ", "é🙂", "<p>", "<br/>", "<!-- </div> -->"])]
        for _ in range(rng.randint(0, 3) if depth else 0):
            name = rng.choice(KINDS)
            parts += [f'<{name}{rng.choice(["", " id=1", chr(32) + "class=" + chr(34) + "k m" + chr(34)])}>', nested(depth - 1), f"</{name}>", "x"]
        if stray and not rng.randint(0, 5):
            parts.append(f"<{rng.choice(KINDS)}>")  # never closed
        return "".join(parts)

    texts += [nested(4) for _ in range(150)]
    found = {}
    for r in boxes.elements(pages(spark, texts), "page_id", "html", KINDS).collect():
        found.setdefault(r.page_id, []).append((r.name, r.css_class, r.start, r.end))
    for k, text in enumerate(texts):
        own = sorted(found.get(k, []))
        if stray:  # an element that is never closed may take another's end of its level, but begins where it does
            assert [x[:3] for x in own] == [x[:3] for x in walked(text)]
        else:
            assert own == walked(text), text


def test_containment(spark):
    rows = boxes.outermost(boxes.elements(pages(spark, ["<div>1<li>2<div>3</div></li></div><li>4<li>5</li></li><div>6</div>"]), "page_id", "html", KINDS), "page_id").orderBy("start").collect()
    assert [(r.name, r.of_kind, r.outer) for r in rows] == [("div", True, True), ("li", True, False), ("div", False, False), ("li", True, True), ("li", False, False), ("div", True, True)]


def test_a_page_is_cleared_once_and_not_for_each_of_its_tags(spark):
    rows = boxes.elements(pages(spark, ["<div>x</div>"]), "page_id", "html", KINDS)
    above, _, _ = rows._jdf.queryExecution().optimizedPlan().toString().partition("Generate")
    assert "regexp_replace" not in above
