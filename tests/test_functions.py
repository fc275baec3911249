"""Scalar functions, robots rules, and pages to rows."""

import pytest
from pyspark.sql import functions as F

from ladderline.functions import text
from ladderline.functions.html import parse_html
from ladderline.functions.ranking_pages import parse_page, register, table_function
from ladderline.functions.urls import crawl_delay_of, is_allowed, joined_url


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_rank_numbers(spark):
    cases = {"#1": 1, "#42": 42, "#100": 100, "1位": 1, "10位": 10, "99位": 99, "1": 1, " 50 ": 50, "3등": 3, "Rank 7 of 9": 7, "1,234": 1, "１位": 1, "２３": 23, "": None, "abc": None, None: None, "9 #3": 3}
    assert values(spark, list(cases), text.rank_number(F.col("x"))) == list(cases.values())


def test_digits_of_other_scripts_are_numbers(spark):
    cases = {"#١٢": 12, "४५位": 45, "𝟕": 7, "１位": 1, "rank ๓": 3, "²": None, "Ⅷ": None}
    assert values(spark, list(cases), text.rank_number(F.col("x"))) == list(cases.values())


def test_clean_text(spark):
    cases = {"  Hello   World  ": "Hello World", "\n\tTest\n\n": "Test", "No  Extra   Spaces": "No Extra Spaces", "  a　b\x1c ": "a b", "": "", None: ""}
    assert values(spark, list(cases), text.clean_text(F.col("x"))) == list(cases.values())


def test_bodies_and_blocks(spark):
    pages = ["<html><BODY class=x>in</body>out", "no body", "<body>open", "<body>a</body>b</body>c", "</body><body>"]
    assert values(spark, pages, text.body_content(F.col("x"))) == ["in", "no body", "<body>open", "a</body>b", ""]
    df = spark.createDataFrame([(200, "<script>captcha</script><body>fine</body>", []), (429, "", []), (200, "<body>Too Many Requests: CAPTCHA</body>", []), (200, "", ["https://x/ok", "https://x/errors/sorry"])], "s int, h string, r array<string>")
    assert [r[0] for r in df.select(text.blocking_reason(F.col("s"), F.col("h"), F.col("r"))).collect()] == [None, "blocking_status_code_429", "captcha_indicator:captcha", "suspicious_redirect:/errors/"]


def test_retries_and_backoff(spark):
    df = spark.createDataFrame([(429, 0), (503, 0), (502, 0), (404, 0), (429, 3)], "s int, a int")
    assert [r[0] for r in df.select(text.should_retry(F.col("s"), F.col("a"))).collect()] == [True, True, True, False, False]
    assert [r[0] for r in spark.range(3).select(text.backoff_delay(F.col("id"))).collect()] == [5.0, 10.0, 20.0]
    delays = [r[0] for r in spark.range(50).select(text.request_delay(F.when(F.col("id") % 2 == 0, 10.0))).collect()]
    assert all(d == 10.0 for d in delays[::2]) and all(3 <= d <= 8 for d in delays[1::2])


def test_run_ids(spark):
    made = spark.range(1).select(text.new_run_id(F.lit("2024-01-01 20:00:00").cast("timestamp_ntz")).alias("x"))
    assert made.first().x.startswith("20240102_050000_") and len(made.first().x) == 24
    assert [str(v) for v in values(spark, ["20240102_050000_ab", "20240102", "x_y"], text.run_id_time(F.col("x")))] == ["2024-01-02 05:00:00", "None", "None"]


def test_urls():
    assert joined_url("https://a.com/b/c", "../d") == "https://a.com/d" and joined_url("https://a.com", "") == "" and joined_url("https://[", "https://[x") == "https://[x"


def test_robots():
    robots = "User-agent: *\nCrawl-delay: 4\nDisallow: /no\nUser-agent: other\nCrawl-delay: 9\nUser-agent: ladder\nCrawl-delay: 7\nCrawl-delay: x"
    assert crawl_delay_of(robots, "Ladderline/1") == 7 and crawl_delay_of(None, "a") is None
    assert not is_allowed(robots, "me", "https://x/no/1") and is_allowed(robots, "me", "https://x/yes") and is_allowed(None, "me", "https://x/no")


PAGE = """<html><head><style>p {}</style></head><body><div id=top class="a b"><p>one<p>two<br>three</div><ul><li class="x"><a href='/dp/1' title=T>L&amp;M</a><li data-k><script>no</script>yes</ul></body>"""


@pytest.mark.parametrize(
    ("selector", "found"),
    [("div", 1), ("#top", 1), (".a.b", 1), (".a .b", 0), ("div p", 2), ("p p", 1), ("[data-k]", 1), ("a[href*='/dp/']", 1), ('a[title="T"], #top', 2), ("li:has(a[href])", 1), ("ul li", 2), ("*[class='x']", 1), ("body div.a", 1), ("p a", 0)],
)
def test_selectors(selector, found):
    assert len(parse_html(PAGE).select(selector)) == found


def test_texts_of_elements():
    root = parse_html(PAGE)
    assert root.first("a").text() == "L&M" and root.first("[data-k]").text() == "yes" and root.first("div").text() == "onetwothree"


def card(n, name="Product name", href="/dp/B{n}", rank="#{n}", extra=""):
    return f'<div data-asin="B{n}"><span class="zg-bdg-text">{rank.format(n=n)}</span><a class="a-link-normal" href="{href.format(n=n)}"><span><div>{name}</div></span></a>{extra}</div>'


def test_primary_tier():
    page = parse_page("".join(card(n) for n in range(1, 6)) + '<ul><li class="a-last"><a href="?pg=2">next</a></li></ul>', "https://shop.example.com/list", "amazon_us", 3)
    assert page["status"] == "ok" and [i["rank"] for i in page["items"]] == [1, 2, 3] and page["next_page_url"] == "https://shop.example.com/list?pg=2"
    assert page["items"][0]["product_url"] == "https://shop.example.com/dp/B1"


def test_cards_without_name_or_url_use_up_the_limit():
    page = parse_page(card(1, name="") + card(2, rank="0") + card(3), "https://x.com", "amazon_us", 2)
    assert [(i["rank"], i["product_url"]) for i in page["items"]] == [(2, "https://x.com/dp/B2")]


def test_lower_tiers():
    fallback = '<div class="a-cardui"><span class="zg-badge-text">#7</span><a href="/dp/X">A long name</a></div>'
    page = parse_page(fallback, "https://x.com", "amazon_us")
    assert (page["status"], page["notes"], page["items"][0]["rank"], page["items"][0]["product_name_raw"]) == ("partial", "Used fallback selectors", 7, "A long name")
    page = parse_page('<p data-asin=1><a href="/dp/X">tiny</a><span>some longer text here</span></p>', "https://x.com", "amazon_us")
    assert page["items"][0] | {"product_url": 0} == {"rank": 1, "product_name_raw": "some longer text here", "product_url": 0, "brand_raw": None, "notes": "heuristic_extraction"}
    page = parse_page('<body class="ranking"><div class="item"><a href="/products/1">One</a></div><div class="item"><a href="/products/2">Two</a></div></body>', "https://x.com", "cosme_jp")
    assert [i["product_name_raw"] for i in page["items"]] == ["One"]  # the body is the outermost box
    page = parse_page('<div class="product item"><a href="/products/1">One</a></div>', "https://x.com", "cosme_jp")
    assert len(page["items"]) == 2  # once for each pattern
    assert parse_page("<p>nothing</p>", "https://x.com", "cosme_jp")["status"] == "failed"
    assert parse_page("", "", "nowhere")["status"] == "failed"


def test_table_function(spark):
    register(spark)
    spark.createDataFrame([(card(1) + card(2),), ("",)], "html string").createOrReplaceTempView("cards")
    rows = spark.sql("SELECT p.status, p.rank FROM cards, LATERAL parse_ranking(html, 'https://x.com', 'amazon_us', 10) p").collect()
    assert sorted((r.status, r.rank) for r in rows if r.rank) == [("ok", 1), ("ok", 2)] and len(rows) == 3
    assert table_function() is not None
