"""Ranking pages to rows: selectors of two tiers, then structural guesses."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator

import pandas as pd
import yaml
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderline.functions.html import Element, parse_html
from ladderline.functions.urls import joined_url

#: The selectors of the two markets, by tier. A YAML file of the same shape can stand in for them.
SELECTORS = {
    "amazon_us": {
        "primary": {"product_card": "div[data-asin]", "rank": {"css": "span.zg-bdg-text"}, "product_name": {"css": "a.a-link-normal span div", "alt_css": "div._cDEzb_p13n-sc-css-line-clamp-3_g3dy1"}, "product_url": {"css": "a.a-link-normal", "attr": "href"}, "brand": {"css": "span.a-size-small.a-color-base", "optional": True}, "pagination": {"next_page_css": "li.a-last a", "next_page_attr": "href"}},
        "fallback": {"product_card": "div.a-cardui", "rank": {"css": "span.zg-badge-text"}, "product_name": {"css": "div.p13n-sc-truncate-desktop-type2", "alt_css": "span.a-size-medium.a-color-base"}, "product_url": {"css": "a[href*='/dp/']", "attr": "href"}, "brand": {"css": "span.a-size-small", "optional": True}, "pagination": {"next_page_css": "ul.a-pagination li.a-last a", "next_page_attr": "href"}},
        "heuristic": {"rank_pattern": r"#(\d+)", "container_attr": "data-asin"},
    },
    "cosme_jp": {
        "primary": {"product_card": "div.ranking-product-item", "rank": {"css": "span.ranking-number", "attr": "data-rank"}, "product_name": {"css": "p.product-name a", "alt_css": "a.product-name"}, "product_url": {"css": "a.product-link", "attr": "href"}, "brand": {"css": "p.brand-name", "alt_css": "span.brand", "optional": True}, "pagination": {"next_page_css": "a.next-page", "next_page_attr": "href"}},
        "fallback": {"product_card": "li.product-item", "rank": {"css": "span.rank", "alt_css": "div.ranking-badge"}, "product_name": {"css": "h3.product-title a", "alt_css": "div.product-info a"}, "product_url": {"css": "a[href*='/products/']", "attr": "href"}, "brand": {"css": "span.brand-name", "optional": True}, "pagination": {"next_page_css": "nav.pagination a[rel='next']", "next_page_attr": "href"}},
        "heuristic": {"rank_pattern": r"(\d+)位?", "name_class_patterns": ["product-name", "item-name", "title"], "container_class_patterns": ["ranking", "product", "item"]},
    },
}
#: What a page without items says.
NO_ITEMS, NO_TIER = "no tier found an item", "primary, fallback and heuristic tiers gave nothing"
#: By market: what product links contain, and whether a name comes from the first link of all (with its least length) or from product links.
_LINKS = {"amazon_us": (("/dp/",), "a", 5), "cosme_jp": (("/products/", "/item/"), "a[href*='/products/'], a[href*='/item/']", 2)}
_RANK_FORMS = [re.compile(p) for p in (r"#(\d+)", r"(\d+)位", r"(\d+)등", r"^(\d+)$", r"(\d+)")]


def load_selectors(path: str) -> dict:
    """The selectors of a file, read anew with every call; empty, with a warning, where it is missing or can't be read."""
    try:
        with open(path, encoding="utf-8") as file:
            return yaml.safe_load(file) or {}
    except (OSError, yaml.YAMLError) as e:
        logging.getLogger(__name__).warning("no selectors from %s: %s", path, e)
        return {}


def cleaned(text: str | None) -> str:
    return " ".join((text or "").split())


def rank_in(text: str) -> int | None:
    text = text.strip()
    return next((int(m[1]) for form in _RANK_FORMS if (m := form.search(text))), None)


def _settings(found: object) -> dict:
    """A selector may be given as a text alone."""
    return found if isinstance(found, dict) else {"css": found} if found else {}


def _text_at(card: Element, *selectors: str | None) -> str | None:
    """The text of the first selector that finds an element at all, however empty it is."""
    hit = next((e for s in selectors if s and (e := card.first(s))), None)
    return None if hit is None else cleaned(hit.text())


def _rank(card: Element, tier: dict, position: int) -> int:
    how = _settings(tier.get("rank"))
    texts = (_text_at(card, how.get("css")), card.attrs.get(how["attr"]) if how.get("attr") else None, _text_at(card, how.get("alt_css")))
    return next((n for t in texts if t and (n := rank_in(t))), position)


def _item(card: Element, market: str, tier: dict, base_url: str, position: int) -> dict | None:
    hints, name_links, least = _LINKS[market]
    how = _settings(tier.get("product_name"))
    name = _text_at(card, how.get("css"), how.get("alt_css"))
    if name is None:
        links = card.select(name_links)
        texts = [cleaned(e.text()) for e in (links[:1] if market == "amazon_us" else links)]
        name = next((t for t in texts if len(t) > least), None)
    how = _settings(tier.get("product_url"))
    link = card.first(how["css"]) if how.get("css") else None
    href = link.attrs.get(how.get("attr", "href")) if link else None
    href = href or next((h for e in card.select("a[href]") if any(x in (h := e.attrs["href"]) for x in hints)), None)
    if not name or not href:
        return None
    how = _settings(tier.get("brand"))
    brand = None if how.get("optional") is False else _text_at(card, how.get("css"), how.get("alt_css"))
    return {"rank": _rank(card, tier, position), "product_name_raw": name, "product_url": joined_url(base_url, href), "brand_raw": brand, "notes": ""}


def _guessed_rank(box: Element, selector: str, pattern: str, position: int) -> int:
    badge = box.first(selector)
    m = re.search(pattern, badge.text()) if badge else None
    return int(m[1]) if m else position


def _guess_by_links(root: Element, how: dict, base_url: str, top_n: int) -> list[dict]:
    """Boxes with the container attribute, or else divs around product links."""
    boxes = root.select(f"[{how.get('container_attr', 'data-asin')}]") or root.select('div:has(a[href*="/dp/"])')
    items = []
    for k, box in enumerate(boxes[:top_n], 1):
        if not (link := box.first('a[href*="/dp/"]')):
            continue
        names = [cleaned(link.text())] if len(cleaned(link.text())) > 5 else []
        names += [cleaned(v) for a in ("title", "alt") if (v := link.attrs.get(a))][:1]
        name = names[0] if names else None
        if not name:
            name = next((t for e in box.select("span, div") if 10 < len(t := cleaned(e.text())) < 200), None)
        if name:
            rank = _guessed_rank(box, '[class*="badge"], [class*="rank"]', how.get("rank_pattern", r"#(\d+)"), k)
            items.append({"rank": rank, "product_name_raw": name, "product_url": joined_url(base_url, link.attrs["href"]), "brand_raw": None, "notes": "heuristic_extraction"})
    return items


def _guess_by_classes(root: Element, how: dict, base_url: str, top_n: int) -> list[dict]:
    """Outermost boxes with a telling class and a product link, once for each class pattern that they have."""
    product = 'a[href*="/products/"]'
    boxes = [e for p in how.get("container_class_patterns", ["ranking", "product", "item"]) for e in root.select(f'[class*="{p}"]') if e.first(product)]
    outer, reach = set(), 0
    for e in sorted(set(boxes), key=lambda e: e.start):
        if e.start > reach:
            outer.add(e.start)
            reach = e.end
    items = []
    for k, box in enumerate([e for e in boxes if e.start in outer][:top_n], 1):
        link = box.first(product)
        name = cleaned(link.text())
        if len(name) <= 2:
            name = cleaned(link.attrs.get("title"))
        if not name:
            named = (box.first(f'[class*="{p}"]') for p in how.get("name_class_patterns", ["name", "title"]))
            name = next((t for e in named if e and len(t := cleaned(e.text())) > 2), None)
        if name:
            brand = box.first('[class*="brand"]')
            rank = _guessed_rank(box, '[class*="rank"], [class*="num"]', how.get("rank_pattern", r"(\d+)位?"), k)
            items.append({"rank": rank, "product_name_raw": name, "product_url": joined_url(base_url, link.attrs["href"]), "brand_raw": cleaned(brand.text()) if brand else None, "notes": "heuristic_extraction"})
    return items


def parse_page(html: str | None, base_url: str, market: str, top_n: int = 100, selectors: dict | None = None) -> dict:
    """Status, items, next page, error and notes of a ranking page; the first tier that finds an item wins."""
    nothing = {"items": [], "next_page_url": None, "error_message": None, "notes": ""}
    try:
        own = (SELECTORS if selectors is None else selectors).get(market) or {}
        root = parse_html(html or "")
        for name, status, notes in (("primary", "ok", ""), ("fallback", "partial", "Used fallback selectors")):
            tier = own.get(name, {})
            card = _settings(tier.get("product_card")).get("css")
            cards = root.select(card)[:top_n] if card else []
            if items := [i for k, c in enumerate(cards, 1) if (i := _item(c, market, tier, base_url, k))]:
                pages = tier.get("pagination", {})
                link = root.first(pages["next_page_css"]) if pages.get("next_page_css") else None
                href = link.attrs.get(pages.get("next_page_attr", "href")) if link else None
                return nothing | {"status": status, "items": items, "next_page_url": joined_url(base_url, href) if href else None, "notes": notes}
        guess = _guess_by_links if market == "amazon_us" else _guess_by_classes
        if items := guess(root, own.get("heuristic", {}), base_url, top_n):
            return nothing | {"status": "partial", "items": items, "notes": "Used heuristic parsing"}
        return nothing | {"status": "failed", "error_message": NO_ITEMS, "notes": NO_TIER}
    except Exception as e:  # noqa: BLE001  a page that can't be parsed is a result, not an error
        return nothing | {"status": "failed", "error_message": str(e)}


ITEM = T.StructType([T.StructField("rank", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("product_name_raw", "product_url", "brand_raw", "notes"))])
PAGE = T.StructType([T.StructField("status", T.StringType()), T.StructField("items", T.ArrayType(ITEM)), *(T.StructField(n, T.StringType()) for n in ("next_page_url", "error_message", "notes"))])


def page_parser(selectors: dict | None = None) -> Callable[..., Column]:
    """A function of the columns html, base_url, market and top_n that gives the parsed page, by these selectors or the built-in ones."""

    @F.pandas_udf(PAGE)
    def parsed(html: pd.Series, base_url: pd.Series, market: pd.Series, top_n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(*x, selectors) for x in zip(html, base_url, market, top_n.astype(int), strict=True)], columns=PAGE.names)

    return parsed


parsed_page = page_parser()


ROW = T.StructType([T.StructField(n, T.IntegerType() if n == "rank" else T.StringType()) for n in ("status", "rank", "product_name_raw", "product_url", "brand_raw", "item_notes", "next_page_url", "error_message", "notes")])


def table_function(selectors: dict | None = None) -> type:
    """parse_ranking(html, base_url, market, top_n) by these selectors or the built-in ones: a row for each item, or one without an item where a page has none."""

    class ParseRanking:
        def eval(self, html: str, base_url: str, market: str, top_n: int) -> Iterator[tuple]:
            page = parse_page(html, base_url, market, top_n, selectors)
            for item in page["items"] or [dict.fromkeys(ITEM.names)]:
                yield (page["status"], *(item[n] for n in ITEM.names), page["next_page_url"], page["error_message"], page["notes"])

    return F.udtf(ParseRanking, returnType=ROW)


def register(spark: SparkSession, selectors: dict | None = None, name: str = "parse_ranking") -> None:
    """Makes the table function known to SQL, for LATERAL joins."""
    spark.udtf.register(name, table_function(selectors))
