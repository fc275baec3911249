"""Quality rules: length and repetition rules, and divergence of a document's histograms from its language's reference.

Two histograms are compared with the reference of the document's language by Jensen-Shannon distance (base 2, 0 to 1): one of
character classes (lower-case and other letters, upper case, digits, white space, punctuation, symbols) and one of the
language's most common words (with one bin for all other words). A reference is a trimmed mean histogram of the documents of the
language that pass the length and repetition rules: of the nearer half around the median, every source counting once however many
documents it has. So junk moves it neither as one hot source nor as up to half of each source's documents. Languages without a
word list share one pooled reference of character classes.
Medians and means are taken over whole numbers of fixed steps, so that they are exact and do not depend on how rows are dealt out: a run repeats another's verdicts.
Only built-in expressions are used; the references are as many rows as there are word lists, plus one. Texts are read once: the
measures are written as a table, from which the references are taken and the documents judged.

Defined cases: a null text has no words and fails the length rule; where no document passes the length and repetition rules there is no
reference, and the divergence passes; a null lang counts as a language without a word list; a null source, or documents without that column, count as
one source; a long text is measured whole, n words in n log n steps; repeated rows are judged each by itself; an empty table gives an empty table; columns beyond text and lang are kept as they are (measure columns are added under their own
names, replacing clashing ones only in op8's result).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderline.llm.common import cut

#: Common words by language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "das", "von", "mit", "den", "im", "ist", "nicht", "ein", "eine", "zu", "sich", "auf", "dem", "des", "als", "auch", "für"],
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as", "are", "this", "by", "be", "at", "from", "or", "was"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo"],
    "fr": ["le", "la", "de", "et", "les", "des", "en", "un", "une", "du", "que", "est", "dans", "pour", "qui", "au", "sur", "par", "pas", "plus"],
}
OTHER = "other"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Below so many words, the histogram of words is too coarse to judge by.
MIN_HISTOGRAM_WORDS = 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.27
#: Steps that shares are counted in for medians (of distances, too), and added up in for means.
GRID, FINE = 10_000, 1_000_000_000
_SPACE = r"[\x20\x09-\x0D]"
_SPACES = " \t\n\x0b\f\r"
_CLASSES = {"upper": r"[A-ZÀ-ÖØ-Þ]", "digit": r"[0-9]", "punctuation": r"[.,;:!?'\"()\-]", "symbol": r"[#*$%&|<>@^~_=+/\\{}\[\]]"}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(OTHER)


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text that is not null."""
    trimmed = F.btrim(text, F.lit(_SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{_SPACE}+"))


def words_in_repeated_windows(words: Column) -> Column:
    """How many words stand in a window of three words that the text has twice or more.

    Windows are hashed to 64 bits; equal ones meet by sorting (hash, place), and the places are swept once, so that a
    text of n words costs n log n.
    """
    n = F.greatest(F.size(words) - 2, F.lit(0))
    hashes = F.zip_with(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b)), F.slice(words, 3, n), lambda h, c: F.xxhash64(h, c))

    def covered(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = _let(ordered, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        steps = _let(places, lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.coalesce(F.least(F.lit(3), b - a), F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def with_histograms(docs: DataFrame) -> DataFrame:
    """Adds _text, _words, n_words, _language and the two histograms as shares (_chars, _common)."""
    rows = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit(""))).withColumn("_words", words_of(F.col("_text")))
    text, size = F.col("_text"), F.greatest(F.length("_text"), F.lit(1))
    counts = [_count(text, p) for p in _CLASSES.values()]
    space = _count(text, _SPACE)
    rows = rows.withColumn("n_words", F.size("_words").cast("long")).withColumn("_language", _language(F.col("lang"))).withColumn("_classes", F.array(space, *counts))
    rows = rows.withColumn("_chars", F.transform(F.concat(F.array(F.length("_text") - F.aggregate("_classes", F.lit(0).cast("long"), lambda t, x: t + x)), F.col("_classes")), lambda x: x / size))
    hits = lambda own: F.transform(F.filter("_words", lambda w: F.array_contains(own, F.lower(w))), lambda w: F.lower(w))
    share = lambda own: _let(hits(own), lambda h: F.transform(own, lambda w: F.size(F.filter(h, lambda x: x == w)) / F.greatest(F.col("n_words"), F.lit(1))))
    common = F.coalesce(*(F.when(F.col("_language") == lang, share(F.array(*map(F.lit, own)))) for lang, own in COMMON_WORDS.items()), F.array().cast("array<double>"))
    return rows.withColumn("_common", common)


def measured(docs: DataFrame) -> DataFrame:
    """The documents without their text, with their measures, base_failed, and what references are taken from."""
    rows = with_histograms(docs.withColumn("_source", F.col("source") if "source" in docs.columns else F.lit(None).cast("string")))
    text, words = F.col("_text"), F.col("_words")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_SPACES)) != "")
    rows = rows.withColumns(
        {
            "word_chars": F.length("_text") - F.get("_classes", F.lit(0)),
            "n_symbols": _count(text, r"[#*$%&|<>]"),
            "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": words_in_repeated_windows(words),
        }
    ).drop("text", "_text", "_words", "_classes")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def _stepped(value: Column, steps: int) -> Column:
    """A value as a whole number of steps: sums and medians of these do not depend on the order of rows."""
    return F.floor(value * steps + 0.5).cast("long")


def _by_key(found: DataFrame) -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for r in found.collect():  # at most a row for each word list (and one for all else) and column
        out.setdefault(r["_key"], {})[r["name"]] = r["value"]
    return out


def _cells(rows: DataFrame, columns: dict[str, Column], steps: int) -> DataFrame:
    named = F.array(*(F.struct(F.lit(name).alias("name"), _stepped(c, steps).alias("at")) for name, c in columns.items()))
    return rows.select("_key", "_source", F.explode(named).alias("c")).select("_key", "_source", "c.*").where("at is not null")


def medians(rows: DataFrame, columns: dict[str, Column]) -> dict[str, dict[str, float]]:
    """Lower medians by key and column, taken within each source and then over the sources: exact over a grid of GRID steps, from counts of its cells."""
    cells = _cells(rows, columns, GRID)
    for by in (["_key", "_source", "name"], ["_key", "name"]):
        own = Window.partitionBy(*by)  # as many rows as the grid has cells
        counted = cells.groupBy(*by, "at").agg(F.count("*").alias("n"))
        upto = counted.select(*by, "at", F.sum("n").over(own.orderBy("at")).alias("upto"), F.sum("n").over(own).alias("all"))
        cells = upto.where("2 * upto >= all").groupBy(*by).agg(F.min("at").alias("at"))
    return _by_key(cells.select("_key", "name", (F.col("at") / GRID).alias("value")))


def means(rows: DataFrame, columns: dict[str, Column]) -> dict[str, dict[str, float]]:
    """Means by key and column, taken within each source and then over the sources, from whole numbers."""
    own = _cells(rows, columns, FINE).groupBy("_key", "_source", "name").agg((F.sum("at") / F.count("*")).alias("mean"))
    return _by_key(own.groupBy("_key", "name").agg((F.sum(_stepped(F.col("mean"), 1)) / F.count("*") / FINE).alias("value")))


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Histograms by language, and those of all languages under OTHER, of measured documents that are not base_failed.

    Histograms of characters count if they are as near to the median one as half of the documents are, those of words if the share
    of common words is so. Medians and means are taken within each source and then over the sources.
    """
    n_chars, n_common = len(_CLASSES) + 2, len(next(iter(COMMON_WORDS.values())))
    used = rows.where(~F.col("base_failed")).select("_source", "_chars", "_common", F.explode(F.array_distinct(F.array(F.col("_language"), F.lit(OTHER)))).alias("_key"))
    used = used.withColumn("share", F.aggregate("_common", F.lit(0.0), lambda total, x: total + x))
    chars = {f"c{i}": F.get("_chars", F.lit(i)) for i in range(n_chars)}
    common = {f"w{i}": F.get("_common", F.lit(i)) for i in range(n_common)}
    middle = medians(used, {**chars, "share": F.col("share")})
    if not middle:
        return {}

    def of_key(values: dict[str, Column]) -> Column:
        out = F.lit(None)
        for key, value in sorted(values.items()):
            out = F.when(F.col("_key") == key, value).otherwise(out)
        return out

    centre = of_key({key: F.array(*(F.lit(r[c]) for c in chars)) for key, r in middle.items()})
    used = used.withColumn("_centre", centre).withColumns({"_far": sum(F.abs(c - F.get("_centre", F.lit(i))) for i, c in enumerate(chars.values())), "_off": F.abs(F.col("share") - of_key({key: F.lit(r["share"]) for key, r in middle.items()}))})
    limits = medians(used, {"far": F.col("_far"), "off": F.col("_off")})
    # compared in steps of the grid, as the limits are
    near, usual = (_stepped(F.col(c), GRID) <= of_key({key: _stepped(F.lit(r[limit]), GRID) for key, r in limits.items()}) for c, limit in (("_far", "far"), ("_off", "off")))
    found = means(used, {**{name: F.when(near, c) for name, c in chars.items()}, **{name: F.when(usual, c) for name, c in common.items()}})
    return {key: ([r.get(c) for c in chars], [r.get(w) for w in common] if key in COMMON_WORDS else []) for key, r in found.items()}


def _entropy_terms(shares: Column) -> Column:
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def jensen_shannon(shares: Column, reference: Column) -> Column:
    """The Jensen-Shannon distance of two histograms given as shares; what they lack to 1 is one more bin."""
    whole = lambda h: F.concat(h, F.array(F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(h, F.lit(0.0), lambda t, x: t + x))))
    return _let(F.struct(whole(shares).alias("p"), whole(reference).alias("q")), lambda x: F.sqrt(F.greatest(F.lit(0.0), _entropy_terms(F.zip_with(x["p"], x["q"], lambda a, b: (a + b) / 2)) - (_entropy_terms(x["p"]) + _entropy_terms(x["q"])) / 2)))


def judged(docs: DataFrame, known: dict[str, tuple[list[float], list[float]]] | None = None) -> DataFrame:
    """The documents without their text, with their measures, base_failed, char_distance, word_distance (null without a reference) and kept.

    Internal columns begin with an underscore; a column of docs that has the name of a measure is replaced.
    """
    rows = cut(measured(docs), "quality-measures")
    known = references(rows) if known is None else known

    def distance(column: str, which: int) -> Column:
        found = F.lit(None).cast("double")
        for lang, histograms in sorted(known.items()):
            if lang != OTHER and histograms[which]:
                found = F.when(F.col("_language") == lang, jensen_shannon(F.col(column), F.array(*map(F.lit, histograms[which])))).otherwise(found)
        if OTHER in known and which == 0:
            found = F.coalesce(found, jensen_shannon(F.col(column), F.array(*map(F.lit, known[OTHER][0]))))
        return found

    rows = rows.withColumns({"char_distance": distance("_chars", 0), "word_distance": F.when(F.col("n_words") >= MIN_HISTOGRAM_WORDS, distance("_common", 1))})
    near = (F.coalesce("char_distance", F.lit(0.0)) <= MAX_CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return rows.withColumn("kept", ~F.col("base_failed") & near)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    source = ["source"] if "source" in docs.columns else []
    return judged(docs.select("text", "lang", *source, F.struct(*docs.columns).alias("_row"))).where("kept").select("_row.*")


#: The measures that the query returns.
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
