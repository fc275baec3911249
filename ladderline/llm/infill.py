"""Fill-in-middle transformation: marker injection with an escaped delimiter, in built-in expressions alone.

A unit is a word with the white space before it, or the white space that ends a text. The delimiter and the escape character are escaped in the text,
a delimiter is appended after every unit, and delimiters are counted: that is the number of units. Two of the places 0 to n, drawn from a hash of
doc_id, cut the text in prefix, middle and suffix, which substring_index takes out of the marked text by the ranks of their delimiters. Unescaped,
they are put together in one of three forms: the text itself (plain), prefix, suffix, middle (psm) or suffix, prefix, middle (spm).

Defined cases: a null or empty text, or one that contains a sentinel, stays plain; a null doc_id is drawn from like an empty one; a long text is cut whole, in time in proportion to its
length; rows that repeat a doc_id are drawn alike, each cut by its own units; an empty table gives an empty table; transform() keeps the other columns, and columns that begin with
an underscore do not clash, as the document travels in a struct of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What is hashed before doc_id, and percentages of texts that are cut and, of these, that begin with the suffix.
SEED, CUT_PERCENT, SPM_PERCENT = 42, 50, 80
#: The delimiter, the escape character, and what stands for each in an escaped text.
_DELIMITER, _ESCAPE = "\x01", "\x02"
_ESCAPED = ((_ESCAPE, _ESCAPE + "e"), (_DELIMITER, _ESCAPE + "d"))
# runs of white space and of other characters end where the other begins: nothing has to be given back, so the possessive form finds the same units
_UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


def escape(text: Column) -> Column:
    for plain, escaped in _ESCAPED:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(_ESCAPED):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 of a document: the first digits of the hash of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _part(marked: Column, first: Column, last: Column) -> Column:
    """Units first to last (from 0, last excluded) of a marked text."""
    units = F.call_function("substring_index", marked, F.lit(_DELIMITER), last)
    return unescape(F.replace(F.call_function("substring_index", units, F.lit(_DELIMITER), first - last), F.lit(_DELIMITER), F.lit("")))


def transform(docs: DataFrame, seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """The documents with n (units), form, prefix, middle, suffix (null where plain) and output; columns of docs with these names are replaced."""
    doc = F.struct("*").alias("_doc")
    rows = docs.select(doc, F.coalesce(F.col("text"), F.lit("")).alias("_text"), *(h.alias(f"_h{k}") for k, h in enumerate(draws(F.col("doc_id"), seed))))
    rows = rows.withColumn("_marked", F.regexp_replace(escape(F.col("_text")), F.lit(_UNIT), F.lit("$0" + _DELIMITER)))
    rows = rows.withColumn("_n", F.length("_marked") - F.length(F.replace(F.col("_marked"), F.lit(_DELIMITER), F.lit("")))).withColumn("_n", F.col("_n").cast("long"))
    whole = (F.col("_text") == "") | (F.col("_h2") % 100 >= cut_percent)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        whole = whole | F.contains(F.col("_text"), F.lit(sentinel))
    form = F.when(whole, "plain").when(F.col("_h3") % 100 < spm_percent, "spm").otherwise("psm")
    places = [(F.col(h) % (F.col("_n") + 1)).cast("int") for h in ("_h0", "_h1")]
    rows = rows.withColumns({"_form": form, "_from": F.least(*places), "_to": F.greatest(*places)})
    parts = {"_prefix": (F.lit(0), F.col("_from")), "_middle": (F.col("_from"), F.col("_to")), "_suffix": (F.col("_to"), F.col("_n").cast("int"))}
    rows = rows.withColumns({name: F.when(F.col("_form") != "plain", _part(F.col("_marked"), *bounds)) for name, bounds in parts.items()})
    pieces = {"psm": (PREFIX, "_prefix", SUFFIX, "_suffix", MIDDLE, "_middle"), "spm": (SUFFIX, "_suffix", PREFIX, "_prefix", MIDDLE, "_middle")}
    output = F.col("_text")
    for name, order in pieces.items():
        output = F.when(F.col("_form") == name, F.concat(*(F.col(p) if p.startswith("_") else F.lit(p) for p in order))).otherwise(output)
    made = {"n": F.col("_n"), "form": F.col("_form"), "prefix": F.col("_prefix"), "middle": F.col("_middle"), "suffix": F.col("_suffix"), "output": output}
    kept = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in made]
    return rows.select(*kept, *(c.alias(name) for name, c in made.items()))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Parts of a cut text hold no sentinel, so the first one found is the one put there."""
    between = lambda a, b: F.call_function("substring_index", F.call_function("substring_index", output, F.lit(b), F.lit(1)), F.lit(a), F.lit(-1))
    middle = F.substr(output, F.instr(output, F.lit(MIDDLE)) + len(MIDDLE))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(docs: DataFrame) -> DataFrame:
    """One row a document: n, form, lengths of prefix and middle, and hashes of the output and of the text rebuilt from it."""
    rows = transform(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
