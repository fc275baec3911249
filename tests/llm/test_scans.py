"""PII, licence and secret scans against plain restatements of their rules."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ladderline.llm import licenses, pii, secrets
from tests.llm.conftest import SCHEMA, frame

BITS = ["a.b@c.de", "x@y", "@", "me@host.example.com.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+49 30", "+1.2.3.4.5.6.7.8.9.0", " ", "\n", "é", "word", "-", "0001.02.3.4", "99999999999999999999.1.1.1", "p%q+r@s-t.u"]


def brute_pii(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0:
            spans.append(("card", *m.span()))
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_of_personal_data():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == brute_pii(text), text


def seconds(f, *args):
    began = time.process_time()
    f(*args)
    return time.process_time() - began


@pytest.mark.parametrize("text", ["7" * 100_000, "1.2.3.4 " * 50_000, "a@b.cd " * 50_000, "+1 (" * 50_000, "1" * 50_000 + "." + "2" * 50_000, "a@" * 50_000, "x" * 100_000 + "@", "7 " * 50_000], ids=str.__len__)
def test_long_texts_of_personal_data_take_linear_time(text):
    assert seconds(lambda: pii.contexts(text, pii.base_spans(text))) < 2.5


@pytest.mark.parametrize("text", ["x = x + x\n" * 1000, 'x = "abc"\n' + 'x = x + "de"\n' * 20_000, "password=" * 50_000, "a=b=" * 50_000, "token = " + "a" * 500_000, '= "' * 50_000, " " * 200_000 + "=" * 50_000], ids=str.__len__)
def test_long_texts_of_secrets_take_linear_time(text):
    assert seconds(secrets.scan_text, text) < 2.5


@pytest.mark.parametrize("lines", ["x = x + x", "x{k} = x + x", "password = x + password", "token{k} = x + 'é{k}z'"])
def test_joins_of_values_of_many_characters_take_linear_time(lines):
    many = "".join(chr(0x4E00 + k) for k in range(20_000))
    text = f'x = "{many}"\n' + "".join(lines.format(k=k) + "\n" for k in range(10_000))
    assert seconds(secrets.scan_text, text) < 1.5


def disclosing_rows():
    rng = random.Random(4)
    # the name stands beside the address in different contexts, and nowhere else; "here" is everywhere
    rows = [(k, " ".join(rng.sample(["red", "green", "blue", "pink", "grey", "teal"], 4)) + " here Zebedee at zebedee@mail.example.com here " + rng.choice(["one", "two", "three", "four", "five", "six"])) for k in range(8)]
    rows += [(k, "plain text here at red green blue pink grey teal one two three four five six without anything " + str(k % 3)) for k in range(8, 40)]
    return [*rows, (40, None), (41, ""), (42, "x" * 50_000 + " zebedee"), (8, "a second row of a known id, zed@mail.example.com"), (None, "no id but 10.0.0.1")]


def test_terms_that_disclose_an_entity(spark):
    docs = frame(spark, disclosing_rows())
    scanned = pii.arrow_map(pii.id_and_text(docs), pii._SCAN, pii._scan)
    found = {(r.entity, r.term): r.disclosure for r in pii.disclosing_pairs(docs, scanned).collect()}
    assert set(found) == {("email:zebedee@mail.example.com", "zebedee")}
    total, with_entity, with_term = 45, 8, 9
    assert found["email:zebedee@mail.example.com", "zebedee"] == pytest.approx(math.log(total * 8 / (with_entity * with_term)) / math.log(total / with_entity))


def brute_disclosure(rows, threshold=0.8, support=3):
    """Spans of every row, by counting all terms of all texts."""
    word = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*")
    texts = [t or "" for _, t in rows]
    bases = [brute_pii(t) for t in texts]
    free = lambda m, base: not any(s < m.end() and m.start() < e for _, s, e in base)
    together, with_entity, df = {}, Counter(), Counter()
    for k, (text, base) in enumerate(zip(texts, bases, strict=True)):
        terms = list(word.finditer(text))
        df.update({m[0].lower() for m in terms})
        with_entity.update({f"{kind}:{text[s:e].lower()}" for kind, s, e in base})
        for kind, s, e in base:
            near = [m for m in [*[m for m in terms if m.end() <= s][-6:], *[m for m in terms if m.start() >= e][:6]] if free(m, base)]
            for m in near:
                together.setdefault((f"{kind}:{text[s:e].lower()}", m[0].lower()), {}).setdefault(k, set()).add(" ".join(x[0].lower() for x in near))
    # a document counts once for a pair, with the context of the smallest hash
    least = lambda contexts: min(hashlib.md5(c.encode()).hexdigest() for c in contexts)
    hits = set()
    for (entity, term), by in together.items():
        rarity = math.log(len(rows) / with_entity[entity])
        if len({least(c) for c in by.values()}) >= support and rarity > 0 and 1 + math.log(min(1, len(by) / df[term])) / rarity >= threshold:
            hits.add(term)
    return [sorted([*base, *(("term", *m.span()) for m in word.finditer(t) if m[0].lower() in hits and free(m, base))], key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2])) for t, base in zip(texts, bases, strict=True)], hits


def test_disclosure_over_a_corpus(spark):
    rng = random.Random(11)
    common = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    names = {"Anna-Lee": "anna@mail.example.com", "Borislav": "10.1.2.3", "Cleo": "+1 555 0100 123", "O'Dare": "4111 1111 1111 1111"}
    rows = []
    for k in range(240):
        words = [rng.choice(common) for _ in range(rng.randint(5, 60))]
        for name, entity in names.items():
            if rng.random() < 0.06:
                at = rng.randrange(len(words))
                words[at:at] = [name, rng.choice(common), entity] if rng.random() < 0.8 else [name] if rng.random() < 0.5 else [entity]
        rows.append((k, rng.choice([" ", "  ", "\n"]).join(words)))
    expected, hits = brute_disclosure(rows)
    assert hits
    found = {r.doc_id: r.spans for r in pii.find_personal_data(frame(spark, rows)).collect()}
    for (d, _), spans in zip(rows, expected, strict=True):
        assert found[d] == ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_personal_data_rows(spark):
    rows = disclosing_rows()
    found = pii.find_personal_data(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    by = sorted((str(r.doc_id), r.spans) for r in found)
    assert [x for x in by if x[0] == "8"] == [("8", ""), ("8", "email:28:48")]
    for r in found:
        if r.doc_id is not None and r.doc_id < 8:
            text = rows[r.doc_id][1]
            base = pii.joined_spans(brute_pii(text))
            assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.n_email == 1
            start = text.index("Zebedee")
            assert r.spans == f"term:{start}:{start + 7},{base}"


def test_sanitising_keeps_rows_and_columns(spark):
    docs = frame(spark, disclosing_rows()).withColumn("spans", F.lit("mine")).withColumn("_id", F.lit(1))
    out = pii.sanitise(docs)
    assert out.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert len(texts) == len(disclosing_rows()) and all("@" not in (t or "") and "10.0.0.1" not in (t or "") for _, t in texts)
    assert dict(texts)[40] is None and all("[...] at [EMAIL]" in t for d, t in texts if d is not None and d < 8)
    assert dict(texts)[20] == dict(disclosing_rows())[20]


def test_disclosing_terms_are_marked_everywhere(spark):
    far = "Zebedee is named here, " + "and much is said " * 20 + "before zebedee@mail.example.com"
    alone = "nobody's address, but ZEBEDEE, and zebedee again"
    more = [(100 + k, "in other words beside nothing " + str(k)) for k in range(40)]
    docs = frame(spark, [*disclosing_rows(), *more, (50, far), (51, alone), (51, "another text of the id")])
    spans = {(r.doc_id, r.n_email): r.spans for r in pii.find_personal_data(docs).where("spans != ''").collect()}
    at = far.index("zebedee@")
    assert spans[50, 1].split(",") == ["term:0:7", f"email:{at}:{at + 24}"]
    assert spans[51, 0] == "term:22:29,term:35:42"
    texts = {r.text for r in pii.sanitise(docs).where("doc_id = 51").collect()}
    assert texts == {"nobody's address, but [...], and [...] again", "another text of the id"}


def brute_secrets(text):
    spans = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 12]
    spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return spans


def test_base_spans_of_secrets():
    rng = random.Random(2)
    bits = ["password", "PassWD", "secret", "api_key", "ApiKey", "token", " ", "=", ":", '"', "'", "abcdefABCDEF012345", "0123456789abcdef", "AKIA", "ABCDEFGHIJ0123456", "\n", "é", "==", "x.y-z"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 10)))
        assert sorted(secrets.base_spans(text)) == sorted(brute_secrets(text)), text


def test_constants_reach_sensitive_names():
    text = 'seed = "tR4kq9Zx81LmWv02"\nother = seed\nDB_PASSWORD = other\nlabel = "tR4kq9Zx81LmWv0Z"\n"client-secret": "' + "a" * 20 + '"\n'
    scores = {text[s:e]: v for (s, e), v in secrets.scored_literals(text).items()}
    assert scores["tR4kq9Zx81LmWv02"] >= secrets.THRESHOLD > scores["tR4kq9Zx81LmWv0Z"]
    assert scores["a" * 20] < secrets.THRESHOLD  # a sensitive name, but nothing random


def test_a_name_set_again_loses_its_value():
    text = 'a = "tR4kq9Zx81LmWv02"\na = "plain"\nsecret = a'
    scores = {text[s:e]: v for (s, e), v in secrets.scored_literals(text).items()}
    assert scores["tR4kq9Zx81LmWv02"] == 0


def test_joined_literals():
    text = 'half = "tR4kq9Zx81"\ntoken = half + "LmWv02qqX7"'
    scores = {text[s:e]: v for (s, e), v in secrets.scored_literals(text).items()}
    assert min(scores["tR4kq9Zx81"], scores["LmWv02qqX7"]) >= secrets.THRESHOLD


def brute_literals(lines):
    """Scores of the literals of a program given as (name, parts), a part being a literal or a name, by writing every value out."""
    text, scores, known = "", {}, {}
    random_of = lambda v: 0.0 if len(v) < 8 or " " in v else min(1.0, -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()) / 3.5)
    for name, parts in lines:
        text += f"{name} = "
        value, spans = "", {}
        for k, (is_name, part) in enumerate(parts):
            text += " + " * (k > 0)
            if is_name and part in known:
                value, spans = value + known[part][0], spans | known[part][1]
            else:
                at = len(text) + (not is_name)
                value, spans = value + part, spans | {(at, at + len(part)): part}
            text += part if is_name else f'"{part}"'
        text += "\n"
        known[name] = value, spans
        for span, literal in spans.items():
            scores[span] = max(scores.get(span, 0.0), secrets.name_weight(name) * max(random_of(value), random_of(literal)))
    return text, scores


def test_literals_of_random_programs(spark):
    rng = random.Random(7)
    names, rows, expected = ["a", "b", "seed", "dbPassword", "api_key", "label", "auth_x"], [], []
    for k in range(60):
        literal = lambda: "".join(rng.choice("abcXYZ0189_/ " if rng.random() < 0.1 else "abcdefXYZ0123456789") for _ in range(rng.randint(1, 14)))
        lines = [(rng.choice(names), [(True, rng.choice(names)) if rng.random() < 0.4 else (False, literal()) for _ in range(rng.randint(1, 3))]) for _ in range(rng.randint(1, 9))]
        text, scores = brute_literals(lines)
        assert secrets.scored_literals(text) == pytest.approx(scores), text
        rows.append((k, text))
        expected.append(sorted(f"literal:{s}:{e}" for (s, e), v in scores.items() if v >= secrets.THRESHOLD))
    found = {r.doc_id: r.spans for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    for (d, _), spans in zip(rows, expected, strict=True):
        assert sorted(x for x in found[d].split(",") if x.startswith("literal")) == spans
    assert any(expected)


def test_short_pieces_of_a_secret_are_found():
    text = 'a = "tR4k"\nb = "q9Zx8" + "1Lm"\nsecret = a + b + "Wv02"\nlabel = "abcd"'
    scores = {text[s:e]: v for (s, e), v in secrets.scored_literals(text).items()}
    assert min(scores[x] for x in ("tR4k", "q9Zx8", "1Lm", "Wv02")) >= secrets.THRESHOLD and scores["abcd"] == 0


def test_passphrases_may_have_spaces():
    text = 'wallet_passphrase = "correct horse battery staple"\npassword = "please enter your password"'
    scores = {text[s:e]: v for (s, e), v in secrets.scored_literals(text).items()}
    assert scores["correct horse battery staple"] >= secrets.THRESHOLD > scores["please enter your password"]


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def test_license_phrases():
    rng = random.Random(5)
    bits = ["gnu general", "public license", "Apache", "License", "CC-BY", "cc by", "mit license", "mit", " ", ", ", "é", "x", "-nc", "\n"]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 10)))
        words = brute_words(text)
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        n_words, n_base, first, last, base, labels, score = licenses.scan_text(text)
        assert (n_words, n_base, base) == (len(words), len(places), ",".join(sorted({x for _, x in places}))), text
        assert (first, last) == ((min(places)[0], max(places)[0]) if places else (None, None)), text
        assert set(filter(None, base.split(","))) <= set(filter(None, labels.split(","))) and 0 <= score <= 1


@pytest.mark.parametrize(
    ("template", "text", "hit"),
    [
        ("a [[b c]] d", "x a b c d y", True),
        ("a [[b c]] d", "a d", True),
        ("a [[b c]] d", "a b d", False),
        ("a {{2}} d", "a d", True),
        ("a {{2}} d", "a p q d", True),
        ("a {{2}} d", "a p q r d", False),
        ("a [[b [[c]]]] d", "a a b d", True),
    ],
)
def test_template_automata(template, text, hit):
    assert licenses.Automaton(template).accepts(text.encode().split()) is hit


def test_license_notices():
    label = lambda t: licenses.scan_text(t)[5].split(",")
    assert "gpl-notice" in label("This work is licensed under the GNU General Public License, version 3.")
    assert "cc-by-nc-notice" in label("Licensed under CC BY-NC 4.0.") and "cc-by-4.0-notice" not in label("Licensed under CC BY-NC 4.0.")
    assert label("We met a public license of the general") == [""]


def filled(template, rng, options):
    """The template's wording with replaceable regions filled, and optional ones kept or left out."""
    words, kept = [], [True]
    for m in licenses._MARK.finditer(template):
        if m[0] == "[[":
            kept.append(kept[-1] and (rng.random() < 0.5 if options is None else options))
        elif m[0] == "]]":
            kept.pop()
        elif kept[-1]:
            words += [rng.choice(["acme", "2024", "jane", "software"]) for _ in range(rng.randint(0, int(m[1])))] if m[1] else [m[0]]
    return words


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_whole_licences_and_near_misses(label):
    rng = random.Random(label)
    automaton = licenses._AUTOMATA[label]
    for options in (True, False, None, None):
        words = filled(licenses.TEMPLATES[label], rng, options)
        text = "".join(w + rng.choice([" ", ", ", "\n   ", " - "]) for w in words)
        assert label in licenses.whole_licenses(text) and label in licenses.scan_text("before, " + text + " after")[5].split(",")
        plain = [w.lower().encode() for w in words]
        assert automaton.accepts(plain, whole=True) and not automaton.accepts([*plain, *[b"zzz"] * 60], whole=True)
    # any mandatory word left out or changed: no match, anywhere in the text
    bare = [w.lower().encode() for w in filled(licenses.TEMPLATES[label], rng, False) if w not in ("acme", "2024", "jane")]
    for k in rng.sample(range(len(bare)), min(12, len(bare))):
        missing = bare[:k] + [b"\xc3\xa9" * 3] * 60 + bare[k + 1 :]
        assert brute_accepts(licenses.TEMPLATES[label], missing) == automaton.accepts(missing), bare[k]


def brute_accepts(template, words):
    """Whether the template's words stand somewhere, by search over all choices of its regions."""
    marks = [(m[0], m[1]) for m in licenses._MARK.finditer(template)]
    close, opened = {}, []
    for k, (mark, _) in enumerate(marks):
        if mark == "[[":
            opened.append(k)
        elif mark == "]]":
            close[opened.pop()] = k
    seen, todo = set(), [(0, at) for at in range(len(words) + 1)]
    while todo:
        k, at = state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        if k == len(marks):
            return True
        mark, most = marks[k]
        if mark == "[[":
            todo += [(k + 1, at), (close[k] + 1, at)]
        elif mark == "]]":
            todo.append((k + 1, at))
        elif most:
            todo += [(k + 1, at + n) for n in range(min(int(most), len(words) - at) + 1)]
        elif at < len(words) and words[at] == mark.lower().encode():
            todo.append((k + 1, at + 1))
    return False


def test_labels_over_a_corpus(spark, corpus):
    """Phrases and templates over whole texts, some with licences in them, against the search."""
    rng = random.Random(6)
    rows = [(d, t) for d, t in corpus if t is not None and len(t) < 3000][:60]
    for k, (label, template) in enumerate(sorted(licenses.TEMPLATES.items())):
        rows.append((1000 + k, rows[k][1] + "\n" + " ".join(filled(template, rng, None)) + "\n" + rows[k + 1][1]))
        rows.append((2000 + k, " ".join(filled(template, rng, None)[:-1])))
    found = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    texts = dict(rows)
    for d, r in found.items():
        words = [w.encode() for w in brute_words(texts[d])]
        base = {label for phrase, label in licenses.PHRASES.items() if any(words[k : k + len(phrase.split())] == phrase.encode().split() for k in range(len(words)))}
        expected = base | {label for label, template in licenses.TEMPLATES.items() if brute_accepts(template, words)}
        assert r.labels == ",".join(sorted(expected)) and (r.score == 1.0) == bool(expected - base)


@pytest.mark.parametrize("operator", [pii.find_personal_data, pii.sanitise, secrets.scan_secrets, licenses.scan_licenses])
def test_odd_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None), (2, ""), (2, ""), (None, "a@b.cd"), (3, "token=" + "a1" * 40_000)]
    docs = frame(spark, rows)
    assert operator(docs).count() == len(rows)
    clash = docs.withColumns({c: F.lit("mine") for c in operator(docs).columns if c not in docs.columns})
    assert operator(clash).count() == len(rows)
