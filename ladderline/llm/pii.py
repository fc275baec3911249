"""PII: spans of personal data, and information-theoretic sanitising of the terms that give it away.

Base spans (email, ip, card, phone) are found by pattern. Each found value is a protected entity. Over all documents, the
operator counts how often a term stands within a window of an entity, and in how many documents the term stands at all; a
term discloses entity e by PMI(e; t) / IC(e) = log(N df(e,t) / (df(e) df(t))) / log(N / df(e)), which is 1 if every document
with the term has the entity. Terms at or above the threshold, seen with the entity in at least `support` different
contexts (copies of one context count once), become spans of kind term wherever they stand, in any document:
the windows serve only to estimate. Sanitising replaces base spans by their kind (generalised) and removes the disclosing terms.

Defined cases: a null or empty text has no spans; rows that repeat a doc_id are kept, each with the
spans of its own text; a long text costs in proportion to its length, whatever it holds; an empty table gives an empty table; extra columns are kept by sanitise() and ignored by the rest.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ladderline.llm.common import apart, arrow_map, cut, id_and_text, in_bitmap, key_bitmap

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on each side of an entity that count as its context.
WINDOW = 6
THRESHOLD, SUPPORT = 0.8, 3
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A leftmost match begins where a run of digits begins, or, after a match, which takes whole runs, at a later run.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
_REPLACE = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[...]"}


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for k, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    """A match begins with the whole run of local characters before an at sign, so only at signs have to be visited."""
    spans, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            spans.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = _emails(text)
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(part[-4:]) <= 255 and len(part.lstrip("0")) <= 3 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _merged(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Starts and ends of the spans in order, overlapping ones made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """For each base span: its value, a hash of the context, and the terms around it with their places. Terms of the text are found once."""
    out, merged = [], _merged(spans)
    begins = [s for s, _ in merged]
    terms = [m.span() for m in _TERM.finditer(text)]
    starts, ends = [s for s, _ in terms], [e for _, e in terms]

    def free(start: int, end: int) -> bool:
        k = bisect_left(begins, end)  # the last span that begins before the term's end
        return k == 0 or merged[k - 1][1] <= start

    for kind, start, end in spans:
        value = f"{kind}:{text[start:end].lower()}"
        before, after = bisect_right(ends, start), bisect_left(starts, end)
        near = [t for t in terms[max(0, before - WINDOW) : before] + terms[after : after + WINDOW] if free(*t)]
        found = [{"term": text[s:e].lower(), "start": s, "end": e} for s, e in near]
        seen = hashlib.md5(" ".join(t["term"] for t in found).encode()).hexdigest()
        out.append({"entity": value, "context": seen, "terms": found})
    return out


_PLACE = pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SCAN = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.string()), ("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), ("contexts", pa.list_(pa.struct([("entity", pa.string()), ("context", pa.string()), ("terms", pa.list_(_PLACE))])))])


def _text_hash(text: str) -> str:
    """Tells rows of equal doc_id apart."""
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _scan(batch: pa.RecordBatch) -> dict[str, object]:
    texts = batch.column("text").to_pylist()
    spans = [base_spans(t) for t in texts]
    hashes = [_text_hash(t) for t in texts]
    return {"doc_id": batch.column("doc_id"), "text_hash": hashes, "base": [[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in spans], "contexts": [contexts(t, s) if s else [] for t, s in zip(texts, spans, strict=True)]}


def term_frequency(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """In how many documents each of these terms stands. A bitmap of fixed size skips nearly all other words."""
    bits = key_bitmap(terms, F.crc32("term"))
    if bits is None:
        return terms.select("term", F.lit(0).cast("long").alias("df"))
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def of_batch(batch: pa.RecordBatch) -> dict[str, object] | None:
        counts: dict[str, int] = {}
        for text in batch.column("text").to_pylist():
            for term in set(_TERM.findall(text.lower())):
                if in_bitmap(shared.value, term.encode()):
                    counts[term] = counts.get(term, 0) + 1
        return {"term": list(counts), "df": list(counts.values())} if counts else None

    found = arrow_map(id_and_text(docs), pa.schema([("term", pa.string()), ("df", pa.int64())]), of_batch)
    return found.groupBy("term").agg(F.sum("df").alias("df")).join(terms, "term", "left_semi")


def disclosing_pairs(docs: DataFrame, scanned: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(entity, term, disclosure) of the terms that give an entity away. Counts cover all documents."""
    total = scanned.count()
    near = scanned.select("doc_id", "text_hash", F.explode("contexts").alias("c")).select("doc_id", "text_hash", "c.entity", "c.context", F.explode(F.array_distinct(F.col("c.terms.term"))).alias("term"))
    once = near.groupBy("entity", "term", "doc_id", "text_hash").agg(F.min("context").alias("context"))
    pairs = once.groupBy("entity", "term", "context").agg(F.count("*").alias("df")).groupBy("entity", "term").agg(F.sum("df").alias("together"), F.count("*").alias("n_contexts"))
    pairs = cut(pairs.where(F.col("n_contexts") >= support), "pii-pairs")
    entities = scanned.select(F.explode(F.array_distinct(F.col("contexts.entity"))).alias("entity")).groupBy("entity").agg(F.count("*").alias("with_entity"))
    terms = term_frequency(docs, pairs.select("term").distinct())
    joined = pairs.join(entities, "entity").join(terms, "term")
    rarity = F.log(F.lit(float(max(total, 1))) / F.col("with_entity"))
    share = F.least(F.lit(1.0), F.col("together") / F.col("df"))
    # log(N df(e,t) / (df(e) df(t))) / log(N / df(e)); an entity in every document has nothing to disclose
    value = F.when(rarity > 0, 1 + F.log(share) / rarity).otherwise(0.0)
    return joined.withColumn("disclosure", value).where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


_MARK = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.string()), *_PLACE])


def term_places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Every place of these terms in all texts. A bitmap of fixed size skips nearly all other words."""
    bits = key_bitmap(terms, F.crc32("term"))
    if bits is None:
        return docs.sparkSession.createDataFrame([], from_arrow_schema(_MARK))
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def of_batch(batch: pa.RecordBatch) -> dict[str, object] | None:
        out: dict[str, list] = {f.name: [] for f in _MARK}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            hits = {word for word in set(_TERM.findall(text)) if in_bitmap(shared.value, word.lower().encode())}
            if hits:
                found = _text_hash(text)
                for m in _TERM.finditer(text):
                    if m[0] in hits:
                        for column, value in zip(out.values(), (doc_id, found, m[0].lower(), m.start(), m.end()), strict=True):
                            column.append(value)
        return out if out["term"] else None

    return arrow_map(id_and_text(docs), _MARK, of_batch).join(terms, "term", "left_semi")


_FOUND = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.string()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def joined_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(set(spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def outside(terms: list[dict], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the terms that overlap no base span; both are swept in order of place."""
    out, at, end = [], 0, 0
    base = sorted((s, e) for _, s, e in spans)
    for start, stop in sorted((t["start"], t["end"]) for t in terms):
        while at < len(base) and base[at][0] < stop:
            end = max(end, base[at][1])
            at += 1
        if end <= start:
            out.append(("term", start, stop))
    return out


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """One row a document: counts by kind, a digest of the base spans, all spans, and text_hash."""
    scanned = cut(arrow_map(id_and_text(docs), _SCAN, _scan), "pii-scan")
    pairs = disclosing_pairs(docs, scanned, threshold, support)
    terms = term_places(docs, cut(pairs.select("term").distinct(), "pii-terms")).select("doc_id", "text_hash", "start", "end").distinct()
    terms = terms.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("terms"))  # bounded by the text
    rows = scanned.select("doc_id", "text_hash", "base")
    marked = rows.join(terms.withColumnRenamed("doc_id", "_id").withColumnRenamed("text_hash", "_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").drop("_id", "_hash")

    def of_batch(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {f.name: [] for f in _FOUND}
        for base, more in zip(batch.column("base").to_pylist(), batch.column("terms").to_pylist(), strict=True):
            spans = [(b["kind"], b["start"], b["end"]) for b in base]
            for kind in KINDS[:4]:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
            out["base_sha256"].append(hashlib.sha256(joined_spans(spans).encode()).hexdigest())
            out["spans"].append(joined_spans(spans + outside(more or [], spans)))
        return out | {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash")}

    return arrow_map(marked, _FOUND, of_batch)


def sanitised_text(text: str, spans: str) -> str:
    """The text with every span replaced; where spans overlap, the one of the first kind as listed stands for all."""
    found = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(",") if x)]
    merged: list[list] = []
    for kind, start, end in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]))):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
            merged[-1][0] = min(merged[-1][0], kind, key=KINDS.index)
        else:
            merged.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in merged:
        out += [text[at:start], _REPLACE[kind]]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """The documents, all columns kept, with sanitised texts; a null text stays null, a row without spans stays as it is."""
    spans = find_personal_data(docs, threshold, support).where(F.col("spans") != "").select("doc_id", F.col("text_hash").alias("hash"), "spans").dropDuplicates(["doc_id", "hash"])
    spans = cut(spans, "pii-spans")
    # md5 of the text tells rows of one doc_id apart; the row itself travels as one column, whatever its names are
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*docs.columns).alias("row"))
    perhaps, others = apart(rows, spans)
    # rows without an id are few by the contract of documents, and are looked up too
    perhaps, others = perhaps.union(rows.where("doc_id is null")), others.where("doc_id is not null")
    found = spans.withColumnRenamed("doc_id", "id")
    joined = perhaps.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.md5(F.col("row.text").cast("binary")) == F.col("hash")), "left")

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([sanitised_text(t, s) if s else t for t, s in zip(texts, found, strict=True)], dtype=object)

    clean = joined.withColumn("clean", cleaned("row.text", "spans")).select(F.col("row").withField("text", F.col("clean")).alias("row"))
    return others.select("row").union(clean).select("row.*")
