"""Mixing sources to target weights: soft domain membership, and document rates fitted by projected least squares.

A naive Bayes classifier, fitted on a bounded sample of labelled documents, gives every document its posterior over the
domains. Rates x >= 0 (how often a document is to be used) are then fitted so that the expected tokens of each domain,
sum over documents of posterior x tokens x rate, meet the targets: least squares of what is
missing, projected on the bounds, with a pull of every rate to 1 that shrinks until the targets are met, or to PULL where they cannot be. Gradients are combinations of
the domains' posteriors, so the sum of all steps is one number a domain, and projecting it on the bounds gives a document's rate: nothing
is kept for each document between iterations. A step is one distributed sum of gradient and curvature. It is no plain gradient step but the gradient scaled by
the inverse curvature over the documents that are not at a bound (a Newton step on those numbers), halved until the objective falls: plain projected steps, which a test
compares its rates with, come to the same rates in thousands of sums instead of some dozens. Only built-in expressions are used.

Defined cases: a null or empty text has 0 tokens and the posterior of its structure alone; a long text is read whole, and its words count once each; without labels all domains are as likely; labels that
repeat a doc_id count once (the smallest); repeated rows of documents get equal rates; an empty table gives an empty table; other columns are ignored,
or kept by mix().
"""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import cut, where_computed

#: Domains, and what a label makes of a document.
DOMAINS = ("good", "poor", "toxic")
#: Bounds of the classifier, as parameters: the labelled documents that it is fitted on (those of the smallest hashes), and the words that it takes from a
#: domain (of at least 5 labelled documents, by at least 4 standard deviations more frequent there; the most telling ones).
SAMPLE, WORDS = 12_000, 64
#: Shares of all tokens that the domains are to have.
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
#: In mix(), the share of its tokens that the scarcest domain keeps: what is left for targets to be met with documents of mixed membership.
KEEP = 0.995
#: Pulls of rates to 1, taken one after the other. Targets count as met at a relative error of CLOSE; smaller ones than LEAST, at that share of LEAST.
PULLS = (1e-2, 1e-4, 1e-6)
PULL, MOST_STEPS, CLOSE, LEAST = PULLS[-1], 200, 1e-4, 1e-3
_INNER = ("_words", "_symbols", "_capitals")
_BINS = {"symbols": (0.002, 0.01, 0.03), "capitals": (0.06, 0.15, 0.4), "variety": (0.1, 0.25, 0.4, 0.6)}
#: Bins are told from words by the white space in their names, which no word has.
_BIN_NAMES = [f"# {name} {k}" for name, bounds in _BINS.items() for k in range(len(bounds) + 1)]


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when(quality == 1, "good")


def with_features(docs: DataFrame) -> DataFrame:
    """Adds n_tokens (words between white space), _distinct (the distinct words in lower case) and _bins (binned shares, named as in _BIN_NAMES)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    # what needs the text comes first and leaves numbers, so that the text is not carried beside its words
    rows = docs.withColumns({"_words": F.array_remove(F.split(F.lower(text), r"[\s.,;:!?|]+"), ""), "_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / size, "_capitals": F.regexp_count(text, F.lit("[A-Z]")) / size})
    rows = rows.withColumns({"n_tokens": F.size("_words").cast("long"), "_distinct": F.array_distinct("_words")})
    shares = {"symbols": F.col("_symbols"), "capitals": F.col("_capitals"), "variety": F.size("_distinct") / F.greatest(F.col("n_tokens"), F.lit(1))}

    def binned(name: str) -> Column:
        out = F.lit(f"# {name} {len(_BINS[name])}")
        for k, bound in reversed(list(enumerate(_BINS[name]))):
            out = F.when(shares[name] < bound, f"# {name} {k}").otherwise(out)
        return out

    return rows.withColumn("_bins", F.array(*map(binned, _BINS))).drop(*_INNER)


def fit_domains(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS) -> dict:
    """Log priors and, for each known feature, its log odds by domain: at most len(DOMAINS) * words words and all bins."""
    ids = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(domain_of(F.col("quality"), F.col("toxic"))).alias("_domain")).where(F.col("_domain").isNotNull() & F.col("_id").isNotNull())
    chosen = ids.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    known = with_features(docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(chosen), "_id"))
    known = cut(known.select("_domain", F.concat("_bins", "_distinct").alias("_features")), "mix-sample")
    sizes = {r[0]: r[1] for r in known.groupBy("_domain").count().collect()}
    n = {d: sizes.get(d, 0) for d in DOMAINS}
    total = sum(n.values())
    counts = known.select("_domain", F.explode("_features").alias("feature")).groupBy("feature").agg(*(F.count_if(F.col("_domain") == d).alias(d) for d in DOMAINS))
    found: dict[str, tuple[int, ...]] = {}
    for d in DOMAINS if total else ():
        # how many more documents of the domain have the word than if it did not depend on the domain, in standard deviations
        seen = sum(F.col(x) for x in DOMAINS)
        expected = seen * (n[d] / total)
        score = (F.col(d) - expected) / F.sqrt(expected * (1 - n[d] / total) + 1.0)
        best = counts.where(~F.col("feature").isin(_BIN_NAMES) & (seen >= 5) & (score >= 4)).orderBy(score.desc(), "feature").limit(words)
        found |= {r["feature"]: tuple(r[x] for x in DOMAINS) for r in best.collect()}
    found |= {r["feature"]: tuple(r[x] for x in DOMAINS) for r in counts.where(F.col("feature").isin(_BIN_NAMES)).collect()}  # at most a row a bin
    base = [math.log((n[d] + 1) / (total + len(DOMAINS))) for d in DOMAINS]
    odds: dict[str, list[float]] = {}
    for feature, by in sorted(found.items()):
        shares = [(c + 0.5) / (n[d] + 1) for c, d in zip(by, DOMAINS, strict=True)]
        if feature in _BIN_NAMES:
            odds[feature] = [math.log(p) for p in shares]
        else:
            odds[feature] = [math.log(p / (1 - p)) if p < 1 else 10.0 for p in shares]
            base = [b + math.log(max(1 - p, 1e-6)) for b, p in zip(base, shares, strict=True)]
    return {"base": base, "odds": odds}


def with_posteriors(docs: DataFrame, model: dict) -> DataFrame:
    """Adds n_tokens and _posterior, an array in the order of DOMAINS."""
    rows = with_features(docs)
    names = list(model["odds"])
    if not names:
        return rows.withColumn("_posterior", F.array(*[F.lit(1.0 / len(DOMAINS))] * len(DOMAINS))).drop("_bins", "_distinct")
    known = F.array(*map(F.lit, names))
    rows = rows.withColumn("_at", F.filter(F.transform(F.concat("_bins", F.array_intersect("_distinct", known)), lambda w: F.array_position(known, w).cast("int") - 1), lambda i: i >= 0))

    def score(k: int) -> Column:
        weights = F.array(*(F.lit(model["odds"][w][k]) for w in names))
        return F.aggregate("_at", F.lit(model["base"][k]), lambda total, i: total + F.get(weights, i))

    scores = [score(k) for k in range(len(DOMAINS))]
    rows = rows.withColumn("_scores", F.array(*scores))
    rows = rows.withColumn("_shifted", F.transform("_scores", lambda s: F.exp(s - F.array_max("_scores"))))
    return rows.withColumn("_posterior", F.transform("_shifted", lambda s: s / F.aggregate("_shifted", F.lit(0.0), lambda t, x: t + x))).drop("_bins", "_distinct", "_at", "_scores", "_shifted")


def _rate(posterior: Column, moves: list[float], most: float | None) -> Column:
    """The rate after moves, the sum of all steps by domain: projected on 0 to most."""
    out = F.greatest(F.lit(0.0), F.lit(1.0) + sum(F.get(posterior, F.lit(k)) * F.lit(float(m)) for k, m in enumerate(moves)))
    return F.least(F.lit(float(most)), out) if most is not None else out


def fit_rates(rows: DataFrame, targets: dict[str, float], most: float | None = None) -> list[float]:
    """The sum of all steps by domain. rows: n_tokens and _posterior; each step is one sum over all rows.

    A domain without a target takes no steps of its own. Logs the totals that are attained, as a warning where a target is missed.
    """
    n, log = len(DOMAINS), logging.getLogger(__name__)
    asked = np.array([d in targets for d in DOMAINS])
    p = [F.col(f"p{k}") for k in range(n)]
    rows = rows.select(F.col("n_tokens").cast("double").alias("w"), *(F.get("_posterior", F.lit(k)).alias(f"p{k}") for k in range(n)))
    first = rows.agg(F.sum("w").alias("total"), *(F.sum(F.col("w") * p[k]).alias(f"s{k}") for k in range(n))).first()
    total = float(first["total"] or 0)
    if not total:
        return [0.0] * n
    scale = np.array([max(float(first[f"s{k}"]) / total, 1e-6) for k in range(n)])
    wanted = np.array([targets.get(d, 0.0) for d in DOMAINS])
    bound = np.where(asked, CLOSE * np.maximum(wanted, LEAST), np.inf)
    pairs = [(j, k) for j in range(n) for k in range(j, n)]

    def summed(moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Shares of the domains, curvature, and the part of the objective's dual that is a sum over documents."""
        z = F.col("z")
        at = rows.withColumn("z", sum(p[k] * F.lit(float(m)) for k, m in enumerate(moves)))
        x, free = F.greatest(F.lit(0.0), 1 + z), z > -1
        value = F.when(free, z * z / 2 + z).otherwise(-0.5)
        if most is not None:
            x, value = F.least(F.lit(float(most)), x), F.when(z < most - 1, value).otherwise(most * z - (most - 1) ** 2 / 2)
            free &= z < most - 1
        r = at.withColumns({"x": x, "free": F.when(free, F.col("w")).otherwise(0.0), "value": value}).agg(
            *(F.sum(F.col("w") * F.col("x") * p[k]).alias(f"s{k}") for k in range(n)), *(F.sum(F.col("free") * p[j] * p[k]).alias(f"h{j}{k}") for j, k in pairs), F.sum(F.col("w") * F.col("value")).alias("value")
        ).first()
        curved = np.zeros((n, n))
        for j, k in pairs:
            curved[j, k] = curved[k, j] = r[f"h{j}{k}"] / total
        return np.array([r[f"s{k}"] for k in range(n)]) / total, curved, r["value"] / total

    moves, steps = np.zeros(n), 0
    got, curved, value = summed(moves)
    for pull in PULLS:
        objective = lambda m, v: v - wanted @ m + pull / 2 * (scale * m) @ m  # noqa: B023, E731
        while steps < MOST_STEPS:
            gradient = np.where(asked, got - wanted + pull * scale * moves, 0.0)
            if (np.abs(gradient) <= bound / 4).all():
                break
            way, length = np.zeros(n), 1.0
            way[asked] = -np.linalg.lstsq((curved + pull * np.diag(scale))[np.ix_(asked, asked)], gradient[asked], rcond=1e-15)[0]
            before = objective(moves, value)
            while steps < MOST_STEPS:
                new = summed(moves + length * way)
                steps += 1
                if objective(moves + length * way, new[2]) <= before + 1e-4 * length * (gradient @ way) + 1e-14 * max(1.0, abs(before)):
                    moves, (got, curved, value) = moves + length * way, new
                    break
                length /= 2
        if (np.abs(got - wanted) <= bound).all():
            break
    met = (np.abs(got - wanted) <= bound).all()
    log.log(logging.INFO if met else logging.WARNING, "mixing: %s after %d steps%s", ", ".join(f"{d} {g:.6f}" + (f" for {targets[d]:g}" if d in targets else "") for d, g in zip(DOMAINS, got, strict=True)), steps, "" if met else (": not converged" if steps >= MOST_STEPS else ": out of reach"))
    return [float(m) for m in moves]


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, most: float | None = None) -> DataFrame:
    """One row a document: doc_id, n_tokens, the posterior of each domain, and its rate."""
    model = fit_domains(docs, labels)
    rows = cut(with_posteriors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "n_tokens", "_posterior"), "mix-posteriors")
    moves = fit_rates(rows, targets, most)
    posteriors = [F.round(F.get("_posterior", F.lit(k)), 9).alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    return rows.select("doc_id", "n_tokens", *posteriors, F.round(_rate(F.col("_posterior"), moves, most), 6).alias("rate"))


def reachable(rows: DataFrame, composition: dict[str, float], keep: float = KEEP) -> dict[str, float]:
    """Targets, as shares of all tokens there are, that have these proportions and that documents used at most once can meet.

    The domain that is scarcest against its proportion keeps the share `keep` of its tokens.
    """
    found = rows.agg(F.sum(F.col("n_tokens").cast("double")).alias("total"), *(F.sum(F.col("n_tokens") * F.get("_posterior", F.lit(k))).alias(d) for k, d in enumerate(DOMAINS))).first()
    if not found["total"]:
        return dict.fromkeys(composition, 0.0)
    total = keep * min(found[d] / found["total"] / share for d, share in composition.items() if share)
    return {d: share * total for d, share in composition.items()}


def mix(docs: DataFrame, labels: DataFrame, composition: dict[str, float], keep: float = KEEP) -> DataFrame:
    """The documents thinned to rates, which are at most 1 here, that give the domains these proportions of tokens.

    A document stays if its hash, as a share, is below its rate.
    """
    model = fit_domains(docs, labels)
    known = cut(with_posteriors(docs.select("doc_id", "text"), model).select("n_tokens", "_posterior"), "mix-posteriors")
    moves = fit_rates(known, reachable(known, composition, keep), 1.0)
    drawn = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1 << 20)) / (1 << 20)
    rows = with_posteriors(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")), model)
    return where_computed(rows, drawn < _rate(F.col("_posterior"), moves, 1.0)).select("_row.*")
