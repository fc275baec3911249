"""Fingerprints, near-dedup and substring dedup against brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderline.llm import near_dups, substring_dups
from ladderline.llm.fingerprints import _HASH, _TRIPLETS, compare_with_next, edited_text, fingerprint, likeness
from ladderline.llm.kernels import RangeHashes, grouped_arrow, sliding_min
from tests.llm.conftest import SCHEMA, frame

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, n=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n=2):
    sets = defaultdict(list)
    for d, t in rows:
        if d is not None:
            sets[d].append(shingles(t, n))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_near_duplicates_are_those_of_brute_force(spark, corpus):
    found = near_dups.near_duplicates(frame(spark, corpus)).collect()
    expected = brute_components(corpus)
    assert len(found) == len(corpus)
    for r in found:
        assert r.component_id == (None if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = sorted(len(shingles(t)) for _, t in corpus)
    assert sorted(r.n_shingles for r in found) == sizes


@pytest.mark.parametrize("block", [4, 16, 2048])
@pytest.mark.parametrize("changed", [2, 3])
def test_a_hot_group_in_small_blocks_loses_no_link(spark, monkeypatch, block, changed):
    """With 3 of 80 words changed, members are 0.7 to 0.8 similar: most pairs pass the sketch and are no links."""
    monkeypatch.setattr(near_dups, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for d in range(60):
        own = list(base)
        for _ in range(changed):
            own[rng.integers(80)] = f"x{rng.integers(1000)}"
        rows.append((d, " ".join(own)))
    found = {r.doc_id: r.component_id for r in near_dups.near_duplicates(frame(spark, rows)).collect()}
    assert found == brute_components(rows)
    assert changed == 2 or 10 < len(set(found.values())) < 60


def test_blocks_hand_on_a_forest():
    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([np.arange(80, dtype=np.uint64), rng.integers(100, 10_000, 5, dtype=np.uint64)])) for _ in range(50)]
    links = near_dups.forest(np.arange(50), np.arange(50), sets, 80)
    assert len(links) == 49 and {x for link in links for x in link} == set(range(50))


def test_rows_of_one_id_are_one_document(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(3, a), (5, a), (5, b), (6, b), (8, a + " more"), (9, "quite another text")]
    found = near_dups.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(3, 3, True), (5, 3, False), (5, 3, False), (6, 3, False), (8, 3, False), (9, 9, True)]


def test_components_follow_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101)], "a long, b long")
    found = {r.node: r.component for r in near_dups.components(links).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_keep_one_keeps_columns_and_one_of_each_group(spark, corpus):
    docs = frame(spark, [r for r in corpus if r[0] is not None and r[0] not in (7, 8)]).withColumn("component_id", F.lit("mine"))
    kept = near_dups.keep_one(docs, words=5)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    components = brute_components([r for r in corpus if r[0] is not None and r[0] not in (7, 8)], 5)
    assert ids == set(components.values())


def test_odd_sketches_estimate_similarity():
    a, b = near_dups.shingle_set(" ".join(f"w{k}" for k in range(400))), near_dups.shingle_set(" ".join(f"w{k}" for k in range(40, 400)))
    far = near_dups.shingle_set(" ".join(f"v{k}" for k in range(400)))
    sketch = {n: np.frombuffer(near_dups.odd_sketch(near_dups.min_samples(s)), np.uint64) for n, s in (("a", a), ("b", b), ("far", far))}
    differ = lambda x, y: int(np.bitwise_count(sketch[x] ^ sketch[y]).sum())
    assert differ("a", "a") == 0
    assert differ("a", "b") <= near_dups.MAX_XOR < differ("a", "far")


def brute_removed(rows, length=50):
    first = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        if d is not None:
            for i in range(len(b) - length + 1):
                g = b[i : i + length]
                first[g] = min(d, first.get(g, d))
    out = []
    for d, b in data:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1 if d is not None else 0):
            if first[b[i : i + length]] < d:
                mask[i : i + length] = b"\1" * length
        kept = bytes(x for x, gone in zip(b, mask, strict=True) if not gone)
        spans = sum(1 for i in range(len(b)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((-1 if d is None else d, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("chunk", "many"), [(1 << 19, 1024), (700, 1024), (1 << 19, 3)])
def test_removed_bytes_are_those_of_brute_force(spark, corpus, monkeypatch, chunk, many):
    monkeypatch.setattr(substring_dups, "CHUNK", chunk)
    monkeypatch.setattr(substring_dups, "MANY", many)
    monkeypatch.setattr(substring_dups, "MANY_OPEN", many)
    monkeypatch.setattr(substring_dups, "SHARD", 4000)
    monkeypatch.setattr(substring_dups, "BATCH", 3000)
    found = substring_dups.without_copies(frame(spark, corpus)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == brute_removed(corpus)
    assert sum(r.n_removed for r in found) > 1000


def test_levels_merge_geometrically():
    rng = np.random.default_rng(1)
    family = substring_dups.LevelFamily()
    batches = []
    for k in range(40):
        batch = np.zeros(100, substring_dups.UNIT)
        batch["u"], batch["a"], batch["d"] = rng.integers(0, 500, 100), 1, k
        batches.append(batch)
        family.add(batch)
    assert len(family.levels) <= 8
    whole = np.concatenate(batches)
    smallest = {u: whole["d"][whole["u"] == u].min() for u in np.unique(whole["u"])}
    assert all((family.smallest(b) == [smallest[u] for u in b["u"]]).all() for b in batches)


def test_packed_units_come_back():
    units, _ = substring_dups.units([5, 3], [b"some text that is long enough to have a unit or two in it, yes", b"y" * 200], [0, -7])
    assert (substring_dups._unpacked(substring_dups._packed(units)) == units).all()


def test_range_hashes_depend_on_bytes_alone():
    b = np.frombuffer(b"abcabcabd", np.uint8)
    h = RangeHashes(b).of(np.array([0, 3, 6, 0]), np.array([3, 6, 9, 6]))
    assert h[0] == h[1] != h[2] and len(set(h.tolist())) == 3


def test_sliding_min():
    x = np.array([5, 3, 9, 1, 7, 7, 2])
    assert [sliding_min(x, w).tolist() for w in (1, 3, 5)] == [x.tolist(), [3, 1, 1, 1, 2], [1, 1, 1]]


def test_grouped_arrow_sees_each_key_whole(spark):
    import pyarrow as pa

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.range(100).select((F.col("id") % 7).alias("k"), "id")
        out = grouped_arrow(df, ["k"], [F.col("id")], pa.schema([("k", pa.int64()), ("n", pa.int64())]), lambda t, e: {"k": t.column("k").to_numpy()[e[:-1]], "n": np.diff(e)}).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.k, r.n) for r in out) == [(k, len(range(k, 100, 7))) for k in range(7)]


def brute_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(d, t or "", order[(k + 1) % len(order)][1] or "") for k, (d, t) in enumerate(order)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_meet_the_next_document(spark, corpus, parts):
    rows = [r for r in corpus if r[0] not in (7, 8)]
    found = {r.doc_id: r for r in compare_with_next(frame(spark, rows), parts).collect()}
    assert len(found) == len(rows)
    for d, text, following in brute_next(rows):
        r, edited = found[d], edited_text(text, following)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint(text), fingerprint(edited))
        assert r.near_next == likeness(fingerprint(text), fingerprint(following)) and 0 <= r.near_edited <= 1


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_fingerprints_of_ids_at_both_ends_and_without_ids(spark, parts):
    """Ids that doubles cannot tell apart, among rows without one."""
    ids = [*range(2**60, 2**60 + 300), *range(2**63 - 40, 2**63), *range(-(2**63), -(2**63) + 40), 0, 1, -1, 2**53, 2**53 + 1]
    rows = [(d, f"text of number {d} " * 3) for d in ids]
    nulls = [(None, f"{k} is not the number of this text {k * k}") for k in range(20)]
    found = compare_with_next(frame(spark, [x for pair in zip(rows, nulls * 20, strict=False) for x in pair][: 2 * len(nulls)] + rows[len(nulls) :]), parts).collect()
    assert len(found) == len(ids) + len(nulls)
    sha = lambda text, following: hashlib.sha256(edited_text(text, following).encode()).hexdigest()
    by = {r.doc_id: r.edited_sha256 for r in found if r.doc_id is not None}
    order = sorted(rows, reverse=True)
    assert [by[d] for d, _ in order[:-1]] == [sha(t, following) for (_, t), (_, following) in zip(order, order[1:], strict=False)]
    assert by[order[-1][0]] in {sha(order[-1][1], t) for _, t in nulls}
    # rows without an id follow one another, and the first document follows the last of them
    chain = sorted(r.edited_sha256 for r in found if r.doc_id is None)
    assert sum(sha(t, order[0][1]) in chain for _, t in nulls) == 1
    assert all(any(x == sha(t, u) for _, t in nulls for u in [order[0][1], *(y for _, y in nulls)]) for x in chain) and len(set(chain)) == len(nulls)


def naive_codes(text):
    """Quartile codes and length, byte by byte."""
    data = text.encode()
    data += bytes(max(0, 14 - len(data)) and 13)
    counts = [0] * 256
    for table, (i, j) in zip(_HASH.tolist(), _TRIPLETS, strict=True):
        for k in range(len(data) - j):
            counts[table[0][data[k]] ^ table[1][data[k + i]] ^ table[2][data[k + j]]] += 1
    ranked = sorted(counts)
    return [sum(c > ranked[q] for q in (64, 128, 192)) for c in counts], min(255, round(4 * math.log2(1 + len(text.encode()))))


def test_digests_and_likeness_are_those_of_the_naive_form(corpus):
    texts = [t for _, t in corpus if t is not None][:70] + ["", "a", "é" * 40]
    for text, other in zip(texts, texts[1:] + texts[:1], strict=True):
        (qa, la), (qb, lb) = naive_codes(text), naive_codes(other)
        digest = bytes.fromhex(fingerprint(text))
        assert digest[0] == la and [digest[2 + k // 4] >> 2 * (k % 4) & 3 for k in range(256)] == qa
        steps = [abs(x - y) for x, y in zip(qa, qb, strict=True)]
        score = sum(steps) + 2 * sum(s == 3 for s in steps) + 2 * abs(la - lb) + (zlib.crc32(text.encode()) & 255 != zlib.crc32(other.encode()) & 255)
        assert likeness(fingerprint(text), fingerprint(other)) == pytest.approx(1 - score / (5 * 256 + 2 * 255 + 1))


def test_fingerprints_of_one_or_repeated_rows(spark):
    one = compare_with_next(frame(spark, [(1, "abcdef")])).collect()
    assert [(r.n_chars, r.edited_sha256) for r in one] == [(6, hashlib.sha256(b"abcdab").hexdigest())]
    many = compare_with_next(frame(spark, [(1, "abc def ghi")] * 5 + [(None, "x")] * 4)).collect()
    assert len(many) == 9 and len({r.fingerprint for r in many if r.doc_id == 1}) == 1


def test_likeness_tells_edits_from_other_texts(corpus):
    texts = [t for d, t in corpus if t and len(t) > 300]
    same = [likeness(fingerprint(t), fingerprint(edited_text(t, "zz " * 400))) for t in texts]
    other = [likeness(fingerprint(a), fingerprint(b)) for a, b in zip(texts, texts[::-1], strict=True) if a != b]
    assert np.median(same) > np.median(other)


@pytest.mark.parametrize("operator", [near_dups.near_duplicates, substring_dups.without_copies, compare_with_next, near_dups.keep_one])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("operator", [near_dups.near_duplicates, substring_dups.without_copies, compare_with_next])
def test_clashing_columns_are_ignored(spark, operator):
    docs = frame(spark, [(1, "a b c"), (2, "a b c")])
    clash = docs.withColumns({c: F.lit("mine") for c in operator(docs).columns if c != "doc_id"})
    assert sorted(map(str, operator(clash).collect())) == sorted(map(str, operator(docs).collect()))
