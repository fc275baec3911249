import pytest

from ladderline.cli import main
from ladderline.functions.ranking_pages import load_selectors, page_parser, register
from ladderline.sources import config

YAML = """
compliance: {daily_budget: 7, delay_range_s: {min: 1, max: 2}, retry: {max_retries: 1}}
collection: {brand_filter: {enabled: true, keywords: [a]}}
insights: {top_n_thresholds: []}
categories:
  - {url: "https://x/1", category_key: one, market: amazon_us}
  - {url: "https://x/2", category_key: two, market: cosme_jp}
"""


@pytest.fixture
def path(tmp_path):
    (tmp_path / "config.yaml").write_text(YAML)
    return tmp_path / "config.yaml"


def test_settings(path, spark):
    s = config.load_settings(path)
    assert (s.max_requests_per_day, s.min_delay, s.max_retries, s.base_backoff, s.thresholds, s.brand_keywords) == (7, 1.0, 1, 5.0, (5, 10, 100), ("a",))
    assert [c.category_key for c in config.categories(s, "cosme_jp")] == ["two"] and config.categories(s, None, "one")[0].url == "https://x/1"
    assert config.category_table(spark, s).count() == 2
    assert config.project_root(path.parent) == path.parent


def test_a_category_without_a_market_is_an_error():
    with pytest.raises(KeyError):
        config.settings_of({"categories": [{"url": "u", "category_key": "k"}]})


def test_selectors():
    assert config.selector("amazon_us", "primary", "product_card") == "div[data-asin]"
    assert config.selector("cosme_jp", "fallback", "rank") == "span.rank" and config.selector("cosme_jp", "primary", "none") is None
    assert config.selector_with_fallback("m", "x", {"m": {"fallback": {"x": {"alt_css": "b"}}}}) == "b"
    assert config.selector_attribute("cosme_jp", "primary", "rank") == "data-rank"


def test_selector_files(tmp_path, spark):
    """A file stands in for the built-in selectors, in the functions too; a missing or broken one is empty; it is read anew."""
    path = tmp_path / "selectors.yaml"
    assert load_selectors(str(path)) == {}
    path.write_text("a: [")
    assert load_selectors(str(path)) == {}
    path.write_text("shop: {primary: {product_card: p, product_name: b, product_url: {css: a, attr: href}}, heuristic: {rank_pattern: x}}\namazon_us: {primary: {product_card: article, product_name: b, product_url: {css: a, attr: href}}}\ncommon: {c: 1}\nvalidation: {v: 2}\n")
    known = load_selectors(str(path))
    assert config.heuristic("shop", "rank_pattern", known) == "x" and config.market_selectors("none", known) == {}
    assert (config.common_patterns(known), config.validation_rules(known)) == ({"c": 1}, {"v": 2})
    assert config.validation_rules() == {"min_items_per_page": 1, "max_items_per_page": 100} and 403 in config.common_patterns()["blocking_status_codes"]
    assert config.selector_table(spark, known).where("market = 'shop'").count() == 3
    register(spark, known, "parse_own")
    html = "<article>#4 <b>A name</b><a href=/x>y</a></article>"
    spark.createDataFrame([(html, "https://s.com/", "amazon_us", 5)], "html string, base_url string, market string, top_n int").createOrReplaceTempView("own_pages")
    assert [tuple(r) for r in spark.sql("SELECT p.status, p.rank, p.product_name_raw, p.product_url FROM own_pages o, LATERAL parse_own(o.html, o.base_url, o.market, o.top_n) p").collect()] == [("ok", 1, "A name", "https://s.com/x")]
    page = spark.table("own_pages").select(page_parser(known)("html", "base_url", "market", "top_n").alias("p")).first().p
    assert page["status"] == "ok" and len(page["items"]) == 1


def test_command_line(path, spark, capsys, tmp_path):
    assert main(["--config", str(path), "--dry-run", "--market", "amazon_us"]) == 0
    assert "1 categories" in capsys.readouterr().out
    assert main(["--config", str(path), "--insights-only", "--history", str(tmp_path / "none")]) == 0
    assert "Rankings at a glance" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["--config", str(path)])
