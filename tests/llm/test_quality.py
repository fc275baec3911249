"""Quality rules, the classifier and mixing."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderline.llm import mixing, quality_knn, quality_rules
from tests.llm.conftest import SCHEMA, frame

LABELS = "doc_id long, quality int, toxic int"


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    times = Counter(windows)
    marked = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def odd_texts():
    rng = random.Random(9)
    bits = ["a", "b", "the", " ", "  ", "\n", "\t", "\r\n", "\x0b", "#", "|", "é", "🙂", "a b c", "\x1f", " ", "<", "x y"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["one two three " * 3000, "w" * 100_000]


def test_measures_are_those_of_brute_force(spark):
    texts = [None, "", *odd_texts()]
    found = quality_rules.judged(frame(spark, list(enumerate(texts)))).collect()
    assert len(found) == len(texts)
    for r in found:
        expected = brute_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, repr(texts[r.doc_id])[:200]
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0])
        assert not (r.kept and r.base_failed)


def prose(rng, n=150):
    common = quality_rules.COMMON_WORDS["en"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(n)).capitalize() + "."


def test_divergent_documents_are_rejected(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng)) for k in range(40)]
    rows += [(40, " ".join(f"{rng.randint(0, 10**6)}$" for _ in range(200))), (41, prose(rng).upper() + "!!!"), (42, " ".join("".join(rng.choice("bcdfgh") for _ in range(6)) for _ in range(200)))]
    rows += [(43, prose(rng), None), (44, prose(rng), "xx")]
    kept = {r.doc_id: r.kept for r in quality_rules.judged(frame(spark, rows)).collect()}
    assert {d for d, k in kept.items() if not k} == {40, 41, 42}


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("symbols", [False, True])
def test_junk_does_not_move_the_reference(spark, hot, symbols):
    """A third of all rows is junk: in every source alike, or as one hot source that is most of its language."""
    rng = random.Random(6)
    junk = (lambda: " ".join(f"{rng.randint(0, 10**6)}$" for _ in range(200))) if symbols else (lambda: " ".join("".join(rng.choice("bcdfgh") for _ in range(6)) for _ in range(200)))
    clean = [(k, prose(rng), "en" if not hot or k < 30 else "de", f"src{k % 5}") for k in range(80)]
    rows = clean + [(k, junk(), "en", "hot" if hot else f"src{k % 5}") for k in range(80, 120)]
    docs = spark.createDataFrame([(d, text, lang, source, len(text)) for d, text, lang, source in rows], SCHEMA).repartition(3)
    kept = {r.doc_id for r in quality_rules.judged(docs).collect() if r.kept}
    english = {d for d, _, lang, _ in clean if lang == "en"}
    assert kept & english == english and not kept & set(range(80, 120))


def test_jensen_shannon_distance(spark):
    row = spark.range(1).select(quality_rules.jensen_shannon(F.array(F.lit(0.5), F.lit(0.25)), F.array(F.lit(0.1), F.lit(0.9))).alias("d")).first()
    p, q = [0.5, 0.25, 0.25], [0.1, 0.9, 0.0]
    h = lambda x: -sum(v * math.log2(v) for v in x if v > 0)
    assert row.d == pytest.approx(math.sqrt(h([(a + b) / 2 for a, b in zip(p, q, strict=True)]) - (h(p) + h(q)) / 2))


def test_keep_good_keeps_columns(spark):
    rng = random.Random(2)
    docs = frame(spark, [(k, prose(rng)) for k in range(20)] + [(20, None), (5, "short"), (None, prose(rng))]).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(1))
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted([*map(str, range(20)), "None"])


def test_no_python_on_the_main_path(spark, capsys):
    docs = frame(spark, [(1, "a b")])
    quality_rules.judged(docs).explain()
    mixing.mixing_rates(docs, spark.createDataFrame([], LABELS)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


def test_empty_rule_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judged(empty).collect() == [] and quality_rules.keep_good(empty).collect() == []


def test_verdicts_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    by = []
    for parts in (1, 7, 60):
        rows = quality_rules.judged(docs.repartition(parts, F.rand(parts))).select("doc_id", "char_distance", "word_distance", "kept").collect()
        by.append(sorted(map(tuple, rows)))
    assert by[0] == by[1] == by[2] and any(not r[-1] for r in by[0])


@pytest.mark.parametrize("n", [1, 2, 5, 8])
def test_medians_are_lower_medians_within_and_over_sources(spark, n):
    rng = random.Random(n)
    rows = [("k", rng.choice("abc"), rng.randint(0, 12) / 12) for _ in range(3 * n)] + [("j", None, 0.5)]
    found = quality_rules.medians(spark.createDataFrame(rows, "_key string, _source string, v double"), {"v": F.col("v")})
    lower = lambda values: sorted(values)[(len(values) - 1) // 2]
    own = [lower([v for _, s, v in rows[: 3 * n] if s == source]) for source in {s for _, s, _ in rows[: 3 * n]}]
    assert found["k"]["v"] == pytest.approx(lower(own), abs=1 / quality_rules.GRID) and found["j"]["v"] == 0.5


def labelled(spark, n=300):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        poor, toxic = k % 5 == 0, k % 7 == 0
        text = " ".join(rng.choice("#$%&|") + "".join(rng.choice("ABCDEF") for _ in range(5)) for _ in range(80)) if poor else prose(rng)
        rows.append((k, text + (" you worthless idiot" if toxic else "")))
        labels.append((k, 0 if poor else 1, int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, LABELS)


def test_classifier_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    rows = quality_knn.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 30 and np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_held_out_labels_are_never_read(spark):
    docs, labels = labelled(spark, 120)
    spoilt = labels.withColumn("quality", F.when(quality_knn.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda by: sorted(map(str, quality_knn.quality_scores(docs, by).collect()))
    assert score(labels) == score(spoilt)


def test_votes_are_exact_cosines():
    rng = np.random.default_rng(1)
    vectors = rng.random((50, quality_knn.WIDTH)) * (rng.random((50, quality_knn.WIDTH)) < 0.05)
    labels = rng.integers(0, 2, 50)
    model = quality_knn.LatentVote(vectors, labels)
    new = vectors[:5] + 0.1 * rng.random((5, quality_knn.WIDTH))
    z, known = (model.latent(v).astype(int).tolist() for v in (new, vectors))
    for k, score in enumerate(model.scores(new)):
        cosines = [sum(a * b for a, b in zip(z[k], v, strict=True)) / 2**44 for v in known]
        near = sorted(zip(cosines, labels.tolist(), strict=True), reverse=True)[: quality_knn.NEIGHBOURS]
        votes = [(max(s, 0) ** 8, y) for s, y in near]
        assert score == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), rel=1e-12)


def plain_terms(text):
    """Counts of hashed triplets and the bins of the structure facts, one by one."""
    data = text.encode()
    h = quality_knn._HASH
    counts = Counter(int(h[0][a] ^ h[1][b] ^ h[2][c]) for a, b, c in zip(data, data[1:], data[2:], strict=False))
    logs = {k: math.log1p(n) for k, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in logs.values()))
    out = [0.0] * quality_knn.WIDTH
    for k, v in logs.items():
        out[k] = v / norm
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    symbols = sum(chr(c) in "#*$%&|<>@^~_=+/\\{}[]" for c in data)
    facts = [symbols / max(len(data), 1), sum(65 <= c < 91 for c in data) / max(len(data), 1), len(set(words)) / max(len(words), 1), 1 - len(set(lines)) / max(len(lines), 1), len(words)]
    at = quality_knn.TERMS
    for value, (_, bounds) in zip(facts, quality_knn._FACTS, strict=True):
        out[at + sum(value >= b for b in bounds)] = 1.0
        at += len(bounds) + 1
    return out


def test_scores_are_those_of_brute_force(spark):
    """Vectors, axes and votes of a small corpus, from counts one by one, a full decomposition and all cosines."""
    docs, labels = labelled(spark, 80)
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = [r.doc_id for r in labels.where(~quality_knn.held_out(F.col("doc_id"))).collect()]
    quality = {r.doc_id: r.quality for r in labels.collect()}
    x = np.array([plain_terms(texts[d]) for d in known])
    weight = np.log((1 + len(x)) / (1 + (np.rint(x * 2**15) > 0).sum(0)))
    weight[quality_knn.TERMS :] = quality_knn._FACT_WEIGHT / math.sqrt(len(quality_knn._FACTS))
    axes = np.linalg.svd(x * weight, full_matrices=False)[2][: min(quality_knn.LATENT, len(x))].T
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    z = unit((x * weight) @ axes)
    for r in quality_knn.quality_scores(docs, labels).collect():
        cosines = z @ unit((np.array(plain_terms(texts[r.doc_id])) * weight) @ axes)
        votes = sorted(((max(c, 0.0) ** 8, quality[d]) for c, d in zip(cosines, known, strict=True)), reverse=True)
        # neighbours that are tied but for rounding may stand on either side of the last place
        own = votes[: quality_knn.NEIGHBOURS] + [v for v in votes[quality_knn.NEIGHBOURS :] if v[0] > votes[quality_knn.NEIGHBOURS - 1][0] * (1 - 1e-5)]
        assert r.score == pytest.approx(sum(w * y for w, y in own) / sum(w for w, _ in own), abs=0.02)


def test_scores_do_not_depend_on_the_batch(spark):
    docs, labels = labelled(spark, 200)
    model = quality_knn.fit(docs, labels)
    vectors = np.stack([quality_knn.term_vector(r.text) for r in docs.collect()])
    at_once = model.scores(vectors)
    for height in (1, 2, 3, 7, 33, 128):
        assert np.array_equal(at_once, np.concatenate([model.scores(vectors[k : k + height]) for k in range(0, len(vectors), height)]))
    repeated = docs.unionByName(docs).unionByName(docs)
    by: dict[int, set] = {}
    for parts in (1, 5, 50):
        for r in quality_knn.quality_scores(repeated.repartition(parts), labels).collect():
            by.setdefault(r.doc_id, set()).add((parts, r.score))
    assert all(len(found) == 3 for found in by.values())


def test_tied_neighbours_all_vote():
    vectors = np.ones((60, quality_knn.WIDTH), np.float32)
    vectors[40:, : quality_knn.TERMS] = np.random.default_rng(2).random((20, quality_knn.TERMS)) < 0.1
    labels = np.array([1] * 30 + [0] * 30)
    for order in (np.arange(60), np.arange(60)[::-1]):
        assert quality_knn.LatentVote(vectors[order], labels[order]).scores(vectors[:1])[0] == pytest.approx(0.75, abs=1e-3)


def test_classifier_on_odd_tables(spark):
    docs, labels = labelled(spark, 60)
    odd = docs.unionByName(frame(spark, [(900, None), (901, ""), (901, ""), (None, "x"), (902, "y" * 200_000)])).withColumn("score", F.lit("mine"))
    assert quality_knn.quality_scores(odd, labels.unionByName(labels)).count() == 65
    assert {r.score for r in quality_knn.quality_scores(docs, spark.createDataFrame([], LABELS)).collect()} == {0.5}
    assert quality_knn.quality_scores(spark.createDataFrame([], SCHEMA), labels).collect() == []


def naive_features(text):
    """Distinct words and bins of a text."""
    text = text or ""
    words = [w for w in re.split(r"[\s.,;:!?|]+", text.lower()) if w]
    size = max(len(text), 1)
    shares = {"symbols": len(re.findall(r"[#*$%&|<>]", text)) / size, "capitals": len(re.findall("[A-Z]", text)) / size, "variety": len(set(words)) / max(len(words), 1)}
    return set(words) | {f"# {name} {sum(shares[name] >= b for b in bounds)}" for name, bounds in mixing._BINS.items()}


def test_posteriors_are_those_of_plain_naive_bayes(spark):
    docs, labels = labelled(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    domain = {r.doc_id: "toxic" if r.toxic else "good" if r.quality else "poor" for r in labels.collect()}
    n = Counter(domain.values())
    features = {d: naive_features(t) for d, t in texts.items()}
    model = mixing.fit_domains(docs, labels)
    words = [f for f in model["odds"] if f not in mixing._BIN_NAMES]
    assert words and all(f in model["odds"] for f in set().union(*features.values()) if f in mixing._BIN_NAMES)
    share = {f: {d: (sum(f in features[k] for k in domain if domain[k] == d) + 0.5) / (n[d] + 1) for d in mixing.DOMAINS} for f in model["odds"]}
    found = {r.doc_id: r for r in mixing.with_posteriors(docs, model).collect()}
    for k, own in features.items():
        score = []
        for d in mixing.DOMAINS:
            total = math.log((n[d] + 1) / (len(domain) + len(mixing.DOMAINS)))
            total += sum(math.log(share[f][d] if f in own else 1 - share[f][d]) for f in words)
            total += sum(math.log(share[f][d]) for f in own if f in mixing._BIN_NAMES)
            score.append(math.exp(total))
        assert list(found[k]._posterior) == pytest.approx([x / sum(score) for x in score], abs=1e-9)


def test_words_with_a_hash_do_not_displace_bins(spark):
    docs, labels = labelled(spark, 60)
    bins = lambda model: {w: v for w, v in model["odds"].items() if w.startswith("#") and not w.startswith("#tag")}
    plain = mixing.fit_domains(docs, labels)
    # as many tokens and capitals, but hashtags and words named like bins, in half of the documents; '#' words compete as words
    tags = " ".join([f"#tag{k}" for k in range(40)] + ["#symbols0", "#capitals0", "#variety0"])
    tagged = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat_ws(" ", "text", F.lit(tags))).otherwise(F.col("text")))
    with_tags = mixing.fit_domains(tagged, labels)
    seen = {r[0] for r in mixing.with_features(tagged).select(F.explode("_bins")).distinct().collect()}
    assert seen <= set(with_tags["odds"]) and bins(plain)
    assert any(w.startswith("#tag") for w in with_tags["odds"])
    by = {r.name: r.n for r in mixing.with_features(tagged).select(F.explode("_bins").alias("name")).groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert sum(by.values()) == 3 * 60 and not {"#symbols0", "#capitals0", "#variety0"} & set(by)


def test_rates_meet_the_targets(spark):
    docs, labels = labelled(spark)
    rows = mixing.mixing_rates(docs, labels, {"good": 0.5, "poor": 0.3, "toxic": 0.2}).collect()
    total = sum(r.n_tokens for r in rows)
    for d, target in (("good", 0.5), ("poor", 0.3), ("toxic", 0.2)):
        assert sum(r[f"p_{d}"] * r.n_tokens * r.rate for r in rows) / total == pytest.approx(target, abs=0.03)
    assert all(r.rate >= 0 and r.p_good + r.p_poor + r.p_toxic == pytest.approx(1) for r in rows)


def test_every_reachable_target_is_met(spark):
    docs, labels = labelled(spark)
    rows = mixing.mixing_rates(docs, labels).collect()
    total = sum(r.n_tokens for r in rows)
    for d, target in mixing.TARGETS.items():
        assert sum(r[f"p_{d}"] * r.n_tokens * r.rate for r in rows) / total == pytest.approx(target, rel=1e-3)


@pytest.mark.parametrize("most", [None, 3.0, 1.0])
def test_rates_of_a_weak_classifier(spark, most):
    """Posteriors that hardly tell the domains apart; with rates of at most 1 not all targets can be met."""
    rng = np.random.default_rng(4)
    p, n = rng.dirichlet([6, 2, 1], 400), rng.integers(20, 400, 400)
    rows = spark.createDataFrame([(int(k), [float(v) for v in q]) for k, q in zip(n, p, strict=True)], "n_tokens long, _posterior array<double>")
    x = np.array([r[0] for r in rows.select(mixing._rate(F.col("_posterior"), mixing.fit_rates(rows, {"good": 0.8, "poor": 0.15, "toxic": 0.05}, most), most)).collect()])
    got, wanted = (n / n.sum() * x) @ p, np.array([0.8, 0.15, 0.05])
    if most != 1.0:
        assert got == pytest.approx(wanted, rel=1e-3)
    # no document can be moved within its bounds so that the squares of what is missing fall
    slope = p @ ((got - wanted) / (n / n.sum() @ p))
    assert np.abs(np.clip(x - slope, 0, most) - x).max() < 1e-2 and x.min() >= 0 and x.max() <= (most or np.inf)


def test_rates_are_those_of_a_dense_solver(spark):
    """The same objective, minimised by many plain projected steps over the whole matrix."""
    docs, labels = labelled(spark, 120)
    targets = {"good": 0.4, "poor": 0.4, "toxic": 0.2}
    rows = mixing.mixing_rates(docs, labels, targets).collect()
    p, n = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows]), np.array([r.n_tokens for r in rows], float)
    share, t = n / n.sum(), np.array([targets[d] for d in mixing.DOMAINS])
    scale, x = share @ p, np.ones(len(n))
    for _ in range(20_000):
        x = np.maximum(0, x - 0.2 * (p @ (((share * x) @ p - t) / scale) + mixing.PULL * (x - 1)))
    rate = np.array([r.rate for r in rows])
    assert np.abs((share * x) @ p - (share * rate) @ p).max() < 0.01
    assert np.abs(x - rate).max() < 0.1 * x.max()


def test_mixing_keeps_good_documents_and_columns(spark):
    docs, labels = labelled(spark)
    docs = docs.withColumn("n_tokens", F.lit("mine"))
    composition = {"good": 0.95, "poor": 0.03, "toxic": 0.02}
    out = mixing.mix(docs, labels, composition)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    good = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    rest = {r.doc_id for r in labels.where("quality = 0 or toxic = 1").collect()}
    assert len(good & kept) >= 0.98 * len(good) and len(rest & kept) <= 0.5 * len(rest)


def test_mixing_meets_the_composition(spark):
    """Expected tokens within 0.1 percent of each target; kept ones, which are drawn, near it; a domain without a target is left alone."""
    docs, labels = labelled(spark)
    known = mixing.with_posteriors(docs, mixing.fit_domains(docs, labels)).select("doc_id", "n_tokens", "_posterior").persist()
    for composition in ({"good": 0.95, "poor": 0.03, "toxic": 0.02}, {"good": 0.96, "toxic": 0.04}):
        targets = mixing.reachable(known, composition)
        moves = mixing.fit_rates(known, targets, 1.0)
        kept = {r.doc_id for r in mixing.mix(docs, labels, composition).collect()}
        rows = known.withColumn("rate", mixing._rate(F.col("_posterior"), moves, 1.0)).collect()
        total = sum(r.n_tokens for r in rows)
        expected, drawn = ({d: sum(r.n_tokens * r._posterior[k] * share(r) for r in rows) / total for k, d in enumerate(mixing.DOMAINS)} for share in (lambda r: r.rate, lambda r: r.doc_id in kept))
        assert all(abs(expected[d] - t) <= 1e-3 * t for d, t in targets.items()), (expected, targets)
        for d, t in targets.items():
            spread = sum((r.n_tokens * r._posterior[mixing.DOMAINS.index(d)]) ** 2 * r.rate * (1 - r.rate) for r in rows) ** 0.5 / total
            assert abs(drawn[d] - t) <= 4 * spread + 1e-3 * t, (drawn, targets)
        assert all(0 <= r.rate <= 1 for r in rows) and (("poor" in targets) or moves[1] == 0)
    known.unpersist()


def test_mixing_odd_tables(spark):
    docs, labels = labelled(spark, 40)
    odd = docs.unionByName(frame(spark, [(900, None), (901, ""), (901, ""), (None, "x")]))
    assert mixing.mixing_rates(odd, labels.unionByName(labels)).count() == 44
    assert mixing.mixing_rates(docs, spark.createDataFrame([], LABELS)).count() == 40
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mixing_rates(empty, labels).collect() == [] and mixing.mix(empty, labels, {"good": 0.9, "toxic": 0.1}).collect() == []
