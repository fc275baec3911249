"""The SQL twins of operators whose whole result SQL can express, for DuckDB over the same tables.

They restate the rules row by row (every string, every pair that shares a shingle), and serve to check the operators on small tables.
"""

from __future__ import annotations

from ladderline.llm import infill, licenses, near_dups, quality_rules, secrets, source_audit, substring_dups

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def near_dedup_sql(words: int = 2, percent: int = near_dups.LINK_PERCENT) -> str:
    shingles = f"CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    lowered = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS.format(text=lowered)} AS w FROM documents),
 sets AS (SELECT doc_id, list_distinct({shingles}) AS found FROM docs),
 sized AS (SELECT doc_id, len(found) AS n FROM sets),
 rows AS (SELECT doc_id, unnest(found) AS s FROM sets),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM rows a JOIN rows b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * shared.n >= {percent} * (x.n + y.n - shared.n)),
 reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
 least AS (SELECT a, least(a, min(b)) AS component_id FROM reach GROUP BY a)
 SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM sized LEFT JOIN least ON a = doc_id"""


def substring_dedup_sql(length: int = substring_dups.LENGTH) -> str:
    return f"""WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 strings AS (SELECT doc_id, unnest(range(0, length(h) // 2 - {length - 1})) AS p, h FROM docs),
 first AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS least FROM (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * length}) AS s FROM strings)),
 steps AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM first WHERE least < doc_id),
 marked AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM steps),
 spans AS (SELECT doc_id, run, min(p) AS lo, max(p) + {length} AS hi FROM marked GROUP BY ALL),
 gaps AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS back FROM spans),
 kept AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * back + 1, 2 * (lo - back)), '' ORDER BY lo) AS head FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
 SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
 sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""


def _literals(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def quality_rules_sql() -> str:
    """Measures, references (trimmed means over the sources) and distances, as quality_rules has them."""
    q = quality_rules
    n_of = lambda pattern: "(length(t) - length(regexp_replace(t, '" + pattern.replace("'", "''") + "', '', 'g')))"
    classes = [n_of(p) for p in q._CLASSES.values()]
    chars = [f"(length(t) - ({' + '.join(['n_space', *classes])}))", "n_space", *classes]
    common = " ".join(f"WHEN '{lang}' THEN {_literals(own)}" for lang, own in q.COMMON_WORDS.items())
    entropy = lambda h: f"list_sum(list_transform({h}, lambda p: CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END))"
    whole = lambda h: f"list_append({h}, greatest(0, 1 - list_sum({h})))"

    def distance(shares: str, reference: str) -> str:
        p, r = whole(shares), whole(reference)
        middle = f"list_transform(list_zip({p}, {r}), lambda x: (x[1] + x[2]) / 2)"
        return f"sqrt(greatest(0, {entropy(middle)} - ({entropy(p)} + {entropy(r)}) / 2))"

    n_chars, n_common = len(q._CLASSES) + 2, len(q.COMMON_WORDS["en"])
    steps = lambda value, n: f"CAST(floor(({value}) * {n} + 0.5) AS BIGINT)"

    def over(rows: str, columns: dict[str, str], inner: str, outer: str) -> str:
        """Aggregates within each source, and then over the sources; v is a column's value."""
        within = ", ".join(f"{inner.replace('{v}', value)} AS {c}" for c, value in columns.items())
        return f"SELECT key, {', '.join(f'{outer.replace('{v}', c)} AS {c}' for c in columns)} FROM (SELECT key, source, {within} FROM {rows} GROUP BY ALL) GROUP BY key"

    median = lambda rows, columns: over(rows, columns, f"quantile_disc({steps('{v}', q.GRID)}, 0.5)", f"quantile_disc({{v}}, 0.5) / {q.GRID}")
    mean = lambda rows, columns: over(rows, columns, f"sum({steps('{v}', q.FINE)}) / count({{v}})", f"sum({steps('{v}', 1)}) / count({{v}}) / {q.FINE}")
    each_char = {f"c{i}": f"chars[{i + 1}]" for i in range(n_chars)}
    far = " + ".join(f"abs(chars[{i + 1}] - c{i})" for i in range(n_chars))
    means = {**{c: f"CASE WHEN {steps('far', q.GRID)} <= {steps('lim_far', q.GRID)} THEN {v} END" for c, v in each_char.items()}, **{f"w{i}": f"CASE WHEN {steps('off', q.GRID)} <= {steps('lim_off', q.GRID)} THEN shares[{i + 1}] END" for i in range(n_common)}}
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, lang, source, CASE WHEN lang IN ({', '.join(f"'{x}'" for x in q.COMMON_WORDS)}) THEN lang ELSE '{q.OTHER}' END AS language FROM documents),
 split AS (SELECT *, {_WORDS.format(text='t')} AS w, {n_of('[\\x20\\x09-\\x0D]')} AS n_space FROM docs),
 windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split))),
 again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
 lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
 measured AS (SELECT doc_id, coalesce(source, '') AS source, language, len(w) AS n_words, length(t) - n_space AS word_chars, {n_of('[#*$%&|<>]')} AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
  list_transform([{', '.join(chars)}], lambda x: x / greatest(length(t), 1)) AS chars,
  list_transform(CASE language {common} ELSE [] END, lambda c: len(list_filter(w, lambda x: lower(x) = c)) / greatest(len(w), 1)) AS shares
  FROM split LEFT JOIN again USING (doc_id) LEFT JOIN lines USING (doc_id)),
 failed AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM measured),
 used AS (SELECT *, coalesce(list_sum(shares), 0) AS share FROM (SELECT *, unnest(list_distinct([language, '{q.OTHER}'])) AS key FROM failed WHERE NOT base_failed)),
 middle AS ({median('used', {**each_char, 'mid': 'share'})}),
 apart AS (SELECT used.*, {far} AS far, abs(share - mid) AS off FROM used JOIN middle USING (key)),
 bounds AS ({median('apart', {'lim_far': 'far', 'lim_off': 'off'})}),
 means AS ({mean('(SELECT * FROM apart JOIN bounds USING (key))', means)}),
 refs AS (SELECT key, [{', '.join(f'c{i}' for i in range(n_chars))}] AS ref_chars, [{', '.join(f'w{i}' for i in range(n_common))}] AS ref_words FROM means),
 judged AS (SELECT f.*, {distance('chars', 'coalesce(own.ref_chars, other.ref_chars)')} AS char_distance,
  CASE WHEN language <> '{q.OTHER}' AND n_words >= {q.MIN_HISTOGRAM_WORDS} THEN {distance('shares', 'own.ref_words')} END AS word_distance
  FROM failed f LEFT JOIN refs own ON own.key = language AND language <> '{q.OTHER}' LEFT JOIN refs other ON other.key = '{q.OTHER}')
 SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
 NOT base_failed AND coalesce(char_distance, 0) <= {q.MAX_CHAR_DISTANCE} AND coalesce(word_distance, 0) <= {q.MAX_WORD_DISTANCE} AS kept FROM judged"""


def _template_regex(template: str) -> str:
    """The template as a regular expression over words with one space after each."""
    out = []
    for m in licenses._MARK.finditer(template):
        out.append("(?:" if m[0] == "[[" else ")?" if m[0] == "]]" else f"(?:[^ ]+ ){{0,{m[1]}}}" if m[1] else m[0].lower() + " ")
    return " " + "".join(out)


def license_scans_sql() -> str:
    phrases = " UNION ALL ".join(f"SELECT doc_id, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(p.split())}] = {_literals(p.split())})) AS place, '{label}' AS label FROM docs WHERE contains(t, '{p.split()[0]}')" for p, label in licenses.PHRASES.items())
    templates = " UNION ALL ".join(f"SELECT doc_id, '{label}' AS label FROM docs WHERE regexp_matches(joined, '{_template_regex(template)}')" for label, template in licenses.TEMPLATES.items())
    return f"""WITH low AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
 docs AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM (SELECT *, list_filter(string_split_regex(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM low)),
 places AS ({phrases}),
 base AS (SELECT doc_id, count(*) AS n, min(place) AS low_place, max(place) AS high_place, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
 own AS ({templates}),
 every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT * FROM own) GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(low_place AS BIGINT) AS first_word, CAST(high_place AS BIGINT) AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
 CAST(CASE WHEN doc_id IN (SELECT doc_id FROM own) THEN 1 WHEN n > 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)"""


def infill_sql(seed: int = infill.SEED) -> str:
    p, s, m = infill.PREFIX, infill.SUFFIX, infill.MIDDLE
    draw = lambda k: f"CAST('0x' || substr(digest, {1 + 8 * k}, 8) AS UBIGINT)"
    part = lambda first, last: f"array_to_string(units[{first} + 1:{last}], '')"
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
 drawn AS (SELECT *, len(units) AS n, {draw(0)} % (len(units) + 1) AS a, {draw(1)} % (len(units) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR {draw(2)} % 100 >= {infill.CUT_PERCENT} THEN 'plain' WHEN {draw(3)} % 100 < {infill.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM docs),
 parts AS (SELECT *, {part('0', 'least(a, b)')} AS pre, {part('least(a, b)', 'greatest(a, b)')} AS mid, {part('greatest(a, b)', 'n')} AS suf FROM drawn)
 SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""


def source_audit_sql(min_docs: int = source_audit.MIN_DOCS, top: int = source_audit.TOP_TERMS) -> str:
    """Every kept term of every group, zero counts included, and all pairs of groups over them."""
    share = lambda n, total: f"1 + (1000000000::HUGEINT * ({n} + 1)) // ({total} + v)"
    return f"""WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
 found AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
 kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY ALL HAVING count(DISTINCT row) >= {min_docs}),
 langs AS (SELECT d.lang, count(kept.term) AS v, coalesce(sum(kept.n), 0) AS total FROM (SELECT DISTINCT lang FROM docs) d LEFT JOIN kept USING (lang) GROUP BY ALL),
 own AS (SELECT lang, source, term, count(*) AS n FROM found JOIN kept USING (lang, term) GROUP BY ALL),
 groups AS (SELECT d.lang, d.source, coalesce(sum(own.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN own USING (lang, source) GROUP BY ALL),
 whole AS (SELECT lang, term, {share('kept.n', 'langs.total')} AS q FROM kept JOIN langs USING (lang)),
 every AS (SELECT lang, source, term, coalesce(own.n, 0) AS n, {share('coalesce(own.n, 0)', 'groups.total')} AS p FROM groups JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
 pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM every a JOIN every b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM every JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
 SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""


def edited_texts_sql() -> str:
    return """SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(following, 1, length(t) // 3)) AS edited_sha256
 FROM (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS following FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


def _spans_sql(kinds: dict[str, tuple[str, str]]) -> str:
    """Counts by kind and the hash of all spans. kinds: pattern and the condition on a match m; places follow from what stands between matches."""
    before = "list_sum(list_transform(pieces[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i], lambda x: length(x))), 0)"
    quoted = lambda pattern: pattern.replace("'", "''")
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS kind_no, '{kind}' AS kind, low, low + length(m) AS high FROM (SELECT doc_id, unnest(hits) AS m, unnest(list_transform(range(len(hits)), lambda i: {before})) AS low
 FROM (SELECT doc_id, regexp_extract_all(t, '{quoted(pattern)}') AS hits, string_split_regex(t, '{quoted(pattern)}') AS pieces FROM docs)) WHERE {condition}"""
        for k, (kind, (pattern, condition)) in enumerate(kinds.items())
    )
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{kind}') AS BIGINT) AS n_{kind}" for kind in kinds)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({found})
 SELECT docs.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || low || ':' || high, ',' ORDER BY low, kind_no), '')) AS base_sha256 FROM docs LEFT JOIN spans USING (doc_id) GROUP BY docs.doc_id"""


def secret_base_spans_sql() -> str:
    value = secrets._ASSIGN.pattern.replace("'", "''")
    return _spans_sql({"assign": (secrets._ASSIGN.pattern, f"length(regexp_extract(m, '{value}', 2)) >= 12"), "access": ("AKIA[A-Z0-9]+", "length(m) >= 18"), "hex": ("[0-9a-f]{16,}", "true")})


def personal_base_spans_sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(reverse({digits}), i + 1, 1) AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(reverse({digits}), i + 1, 1) AS INTEGER) + 1] END)) % 10 = 0"
    return _spans_sql(
        {
            "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(nullif(ltrim(p, '0'), '') AS INTEGER), 0) > 255)) = 0"),
            "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 12 AND 19 AND {luhn}"),
            "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15"),
        }
    )


ORACLE_SQL = {"edited_texts": edited_texts_sql(), "personal_base_spans": personal_base_spans_sql(), "secret_base_spans": secret_base_spans_sql(), "op5_license_scans": license_scans_sql(), "op7_suffix_dedup": substring_dedup_sql(), "op8_quality_rules": quality_rules_sql(), "op9_near_dedup": near_dedup_sql(), "op12_infill": infill_sql(), "op13_source_audit": source_audit_sql()}
