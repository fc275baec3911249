"""The pipeline's stages, each against plain rules on what it was given."""

from pyspark.sql import functions as F

import corpus_pipeline
from ladderline.llm import mixing, pii, quality_rules
from tests.llm.conftest import SCHEMA, frame
from tests.llm.test_dedup import brute_components
from tests.llm.test_quality import brute_measures
from tests.llm.test_scans import brute_pii

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given, out = {}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given[name] = docs
        docs = out[name] = corpus_pipeline.cut(stage(spark, docs, SF), f"test-{name}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == given["quality_rules"].columns
    rows = {name: {r.doc_id: r for r in df.collect()} for name, df in out.items() if name != "packing"}
    first = {r.doc_id: r for r in given["quality_rules"].collect()}
    judged = {r.doc_id: r.kept for r in quality_rules.judged(given["quality_rules"]).collect()}
    assert set(rows["quality_rules"]) == {d for d, kept in judged.items() if kept}
    for d, r in first.items():
        n, *_, repeated = brute_measures(r.text)
        assert not (judged[d] and (n < 50 or 100 * repeated > 50 * n))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    long_enough = [d for d, q in labels.items() if q == 1 and d in first and brute_measures(first[d].text)[0] >= 50]
    assert sum(judged[d] for d in long_enough) >= 0.98 * len(long_enough)
    assert set(rows["near_dedup"]) == set(brute_components([(d, r.text) for d, r in rows["quality_rules"].items()], 5).values())
    assert set(rows["pii"]) == set(rows["near_dedup"])
    for d, r in rows["pii"].items():
        before = rows["near_dedup"][d].text
        assert not brute_pii(r.text) and (r.text == before or brute_pii(before))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = mixing.with_posteriors(given["mixing"], mixing.fit_domains(given["mixing"], labels)).select("doc_id", "n_tokens", "_posterior").persist()
    moves = mixing.fit_rates(known, mixing.reachable(known, corpus_pipeline.COMPOSITION), 1.0)
    rates = {r.doc_id: r.rate for r in known.select("doc_id", mixing._rate(F.col("_posterior"), moves, 1.0).alias("rate")).collect()}
    assert {d for d, rate in rates.items() if rate == 1} <= set(rows["mixing"]) <= {d for d, rate in rates.items() if rate > 0}
    pieces = out["packing"].collect()
    assert {p.doc_id for p in pieces} == set(rows["mixing"])
    ends = {}
    for p in sorted(pieces, key=lambda p: p.offset):
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 2048
    assert pii.sanitised_text("a b@c.de d", "email:2:8") == "a [EMAIL] d"


ODD = [(1, None, "en"), (2, "", "en"), (3, " \n ", None), (4, "mail a@b.cd " + " ".join(f"w{k}" for k in range(300)), "en"), (4, "mail a@b.cd " + " ".join(f"w{k}" for k in range(300)), "en"), (5, " ".join(f"w{k}" for k in range(299)), "xx"), (None, " ".join(f"v{k}" for k in range(200)), "en"), (6, " ".join(f"x{k % 4000}" for k in range(60_000)), "en"), (7, "short", "de")]


def through(spark, docs, folder):
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, folder), "test-odd")
    return docs


def test_a_run_leaves_one_table_and_the_setting_as_it_was(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ladderline.llm.common.shared_dir", lambda _: str(tmp_path))
    before = spark.conf.get(corpus_pipeline._SETTING)
    found = corpus_pipeline.run(spark, SF)
    assert found.count() > 0 and [p.name.split("-")[0] for p in tmp_path.iterdir() if p.name.startswith(("pipeline", "pack", "mix", "quality"))] == ["pack"]
    assert spark.conf.get(corpus_pipeline._SETTING) == before


def test_odd_rows_pass_all_stages(spark):
    """Nulls, empty and long texts, repeated rows, unknown languages and columns whose names the stages use themselves."""
    docs = frame(spark, ODD).withColumns({c: F.lit("mine") for c in ("n_words", "kept", "component_id", "spans", "rate", "row", "piece", "hash", "_words")})
    pieces = through(spark, docs, SF).collect()
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    assert set(by) == {4, None} and sum(p.length for p in by[4]) > 300


def test_an_empty_table_passes_all_stages(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert through(spark, docs, SF).collect() == []
