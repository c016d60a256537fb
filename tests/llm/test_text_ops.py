"""Suffix-array and substring deduplication, SimHash and quality rules against brute force."""
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from patchlens.llm import quality, simhash, substrings, suffix_dedup, suffixes
from patchlens.llm.queries import QUALITY_SQL


def words_of(text):
    return (text or "").encode().split()


def without_windows(units, window, joiner):
    """Brute force over lists of units: (kept, removed, spans) of each."""
    count = Counter(tuple(u[i:i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if count[tuple(u[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((joiner([x for x, g in zip(u, gone) if not g]), sum(gone), spans))
    return out


def sample_texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "ccc", "é", "dd", "e"]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if texts and rng.random() < 0.4:
            other = rng.choice(texts).split()
            at = rng.randint(0, len(words))
            words[at:at] = other[rng.randint(0, 3):]
        texts.append(" ".join(words * (3 if rng.random() < 0.1 else 1)))
    return texts + [texts[0], texts[1], None, ""]


@pytest.mark.parametrize("window", [3, 9, 35])
def test_repeated_words(spark, work, window):
    texts = sample_texts(window) + [" ".join(f"w{i}" for i in range(50)), "x " + " ".join(f"w{i}" for i in range(5, 50))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in substrings.summary(docs, work, window).collect()}
    units = [words_of(t) for t in texts]
    for i, (kept, removed, _) in enumerate(without_windows(units, window, b" ".join)):
        assert got[i]["n_words"] == len(units[i])
        assert got[i]["n_removed"] == removed
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_levels_double():
    assert substrings.levels(35) == [9, 18, 35]
    for window in range(1, 100):
        sizes = substrings.levels(window)
        assert sizes[-1] == window and all(b <= 2 * a for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("window,memory", [(8, 1 << 27), (20, 1 << 12)])
def test_repeated_bytes(spark, work, window, memory):
    texts = sample_texts(window, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix_dedup.summary(docs, work, window, memory).collect()}
    units = [(t or "").encode() for t in texts]
    for i, (kept, removed, spans) in enumerate(without_windows(units, window, bytes)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(units[i]), removed, spans)
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("op", [substrings.summary, suffix_dedup.summary])
def test_repeats_edge_rows(edge, empty, work, op):
    rows = op(edge, work).collect()
    source = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in source)
    assert op(empty, work).collect() == []


def test_without_repeats_keeps_rows_and_columns(edge, empty, work):
    out = substrings.without_repeats(edge, work)
    assert out.columns == edge.columns
    rows = out.collect()
    assert len(rows) == edge.count()
    passage = " ".join(f"w{i}" for i in range(60))
    assert not any(passage in (r["text"] or "") for r in rows)
    assert {"tail a", "head", "one", None} <= {r["text"] for r in rows}
    assert substrings.without_repeats(empty, work).collect() == []


def suffix_neighbours(text, cap, space):
    order, lcp = [], []
    for _, pos, common in suffixes.SuffixOrder(np.asarray(text + [0], np.uint32), cap, space).neighbours():
        order += pos.tolist()
        lcp += common.tolist()
    return order, lcp


@pytest.mark.parametrize("seed", range(4))
def test_suffix_order(seed, monkeypatch):
    rng = random.Random(seed)
    for _ in range(150):
        n, letters = rng.randint(0, 80), rng.choice([1, 2, 3, 200])
        text = [rng.randint(1, letters) for _ in range(n)] * rng.choice([1, 1, 3])
        cap, memory = rng.choice([3, 10, 400]), rng.choice([1 << 10, 1 << 14, 1 << 27])
        monkeypatch.setattr(suffixes, "STEP", rng.choice([7, 64, 1 << 18]))
        order, lcp = suffix_neighbours(text, cap, suffixes.Space(memory))
        whole = text + [0]
        assert sorted(order) == list(range(len(whole)))
        assert [whole[i:i + cap] for i in order] == sorted(whole[i:i + cap] for i in range(len(whole)))
        for k in range(1, len(whole)):
            a, b = whole[order[k - 1]:][:cap], whole[order[k]:][:cap]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_suffix_order_of_some_positions(monkeypatch):
    rng, sorted_rows = random.Random(7), []
    push = suffixes.DiskQueue.push
    monkeypatch.setattr(suffixes.DiskQueue, "push", lambda self, *c: sorted_rows.append(len(c[0])) or push(self, *c))
    for _ in range(150):
        n, letters = rng.randint(0, 80), rng.choice([1, 2, 3, 200])
        whole = [rng.randint(1, letters) for _ in range(n)] * rng.choice([1, 1, 3]) + [0]
        cap, memory = rng.choice([3, 10, 400]), rng.choice([1 << 10, 1 << 14, 1 << 27])
        monkeypatch.setattr(suffixes, "STEP", rng.choice([7, 64, 1 << 18]))
        wanted = np.array([rng.random() < 0.3 for _ in whole], bool)
        order = suffixes.SuffixOrder(np.asarray(whole, np.uint32), cap, suffixes.Space(memory))
        order._samples_ranked()
        samples = sum(sorted_rows)
        sorted_rows.clear()
        found = [(int(p), int(c)) for _, pos, common in order.neighbours(wanted) for p, c in zip(pos, common)]
        # Besides the samples only the wanted positions are sorted.
        assert sum(sorted_rows) == samples + wanted.sum()
        sorted_rows.clear()
        at = [p for p, _ in found]
        assert sorted(at) == np.flatnonzero(wanted).tolist()
        assert [whole[i:i + cap] for i in at] == sorted(whole[i:i + cap] for i in at)
        for (a, _), (b, c) in zip(found, found[1:]):
            a, b = whole[a:][:cap], whole[b:][:cap]
            assert c == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def simple_fingerprint(text, shingle=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [words[i:i + shingle] for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(fps, radius):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_fingerprint_against_definition(edge):
    got = simhash.fingerprints(edge.select("doc_id", "text"), keep=("doc_id", "text")).collect()
    for r in got:
        if r["text"] is None or len(r["text"]) < 1000:
            assert r["fp"] % 2 ** 64 == simple_fingerprint(r["text"])


@pytest.mark.parametrize("prefix_bits", [6, 13])
def test_ball_hashing_finds_all_components(spark, work, prefix_bits):
    rng = random.Random(prefix_bits)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(8)]
    fps += [0, 0, 2 ** 64 - 1, 1 << 63]
    frame = spark.createDataFrame([(f - 2 ** 64 if f >> 63 else f,) for f in fps], "fp long")
    found = simhash.connected_components(simhash.links(frame, work, radius=4, prefix_bits=prefix_bits), work).collect()
    comp = {r["node"] % 2 ** 64: r["component"] for r in found}
    want = defaultdict(set)
    for f, root in zip(fps, components(fps, 4)):
        want[root].add(f)
    for members in want.values():
        if len(members) > 1:
            assert len({comp[f] for f in members}) == 1
            assert sum(c == comp[next(iter(members))] for c in comp.values()) == len(members)
        else:
            assert next(iter(members)) not in comp


def test_a_slice_is_split_when_it_holds_too_many_variants(monkeypatch):
    rng = random.Random(1)
    fps = np.array([rng.getrandbits(8) for _ in range(300)], np.uint64)
    left = np.full(len(fps), 2)
    whole = {tuple(e) for part in simhash._stars(fps, left, 58, 2, simhash.ball(58, 2), 4) for e in part.tolist()}
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 1 << 15)
    split = {tuple(e) for part in simhash._stars(fps, left, 58, 2, simhash.ball(58, 2), 4) for e in part.tolist()}

    def classes(edges):
        nodes = sorted({x for e in edges for x in e})
        low = {x: x for x in nodes}
        for _ in nodes:
            for a, b in edges:
                low[a] = low[b] = min(low[a], low[b])
        return low
    assert classes(whole) == classes(split)


def test_near_duplicates_edge_rows(edge, empty, work):
    rows = simhash.near_duplicates(edge, work).collect()
    assert len(rows) == edge.count()
    one = [r for r in rows if r["doc_id"] == 3]
    assert len(one) == 3 and {r["component_id"] for r in one} == {3}
    blank = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert blank == {0}
    assert simhash.near_duplicates(empty, work).collect() == []


def test_deduplicated_keeps_one_row_of_each_component(edge, empty, work):
    out = simhash.deduplicated(edge, work)
    assert out.columns == edge.columns
    rows = edge.select("doc_id", "text").collect()
    groups = components([simple_fingerprint((r["text"] or "")) if len(r["text"] or "") < 1000 else 12345 for r in rows], 4)
    kept = out.collect()
    assert len(kept) == len(set(groups))
    assert sum(r["doc_id"] == 7 for r in kept) == 2 and sum(r["text"] == "one" for r in kept) == 1
    assert simhash.deduplicated(empty, work).collect() == []


def test_quality_ledger_against_sql(spark, edge, empty):
    con = duckdb.connect()
    rows = edge.select("doc_id", "text").toPandas()
    con.register("documents", rows)
    want = sorted(con.execute(QUALITY_SQL).fetchall(), key=repr)
    got = quality.ledger(edge).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        quality.rejected(quality.BASE).alias("b"), (~quality.rejected(quality.PRODUCTION)).alias("k")).collect()
    assert sorted([tuple(r) for r in got], key=repr) == [tuple(None if isinstance(v, float) and v != v else int(v) if isinstance(v, float) else v for v in r) for r in want]
    assert quality.ledger(empty).collect() == []


def test_policies_and_ablations_read_the_same_bits(spark):
    rng = random.Random(2)
    bits = [rng.getrandbits(6) for _ in range(500)]
    frame = spark.createDataFrame([(b,) for b in bits], "failed long")
    for policy in (quality.BASE, quality.PRODUCTION, quality.STRICT):
        names = list(quality.RULES)
        got = {r["rule"]: r for r in quality.ablations(frame, policy).collect()}
        assert set(got) == set(policy.rules)
        for rule in policy.rules:
            bit = 1 << names.index(rule)
            assert got[rule]["n_failed"] == sum(1 for b in bits if b & bit)
            assert got[rule]["n_only"] == sum(1 for b in bits if b & policy.mask == bit)
            assert got[rule]["n_rejected"] == sum(1 for b in bits if b & policy.mask)


def test_kept_documents_keep_their_columns(edge, empty):
    out = quality.kept(edge)
    assert out.columns == edge.columns and 0 < out.count() < edge.count()
    assert quality.kept(empty).collect() == []
    with pytest.raises(ValueError):
        quality.measured(edge)  # n_words is there already
