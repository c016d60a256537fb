"""Sharding, vectors, chat, WARC, tokens and packing against brute force and round trips."""
import base64
import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from patchlens.llm import bpe, chat, embeddings, packing, sharding, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# ---------------------------------------------------------------- sharding

def smallest_capacity(sizes, n):
    def shards(c):
        used, room = 1, c
        for s in sizes:
            if s > c:
                return n + 1
            if s > room:
                used, room = used + 1, c
            room -= s
        return used
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if shards(mid) <= n else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("seed", range(3))
def test_shards_are_minimax(spark, work, seed):
    rng = random.Random(seed)
    texts = ["x" * rng.randint(0, 400) + str(i) for i in range(rng.choice([5, 40, 700]))]
    texts += [rng.choice(texts) for _ in range(200)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard(docs, work, 16).collect()
    load, slots, place, groups = defaultdict(int), defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        place[texts[r["doc_id"]] or ""].add(r["shard"])
        groups[r["key"]] += r["size"]
        assert r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in place.values())
    ordered = sorted(groups.items())
    alone, left, rest = [], 16, sum(groups.values())
    for key, size in sorted(ordered, key=lambda g: (-g[1], g[0])):
        if left > 1 and size * left > rest:
            alone.append(key)
            left, rest = left - 1, rest - size
        else:
            break
    others = [s for k, s in ordered if k not in alone]
    if others:
        assert max(load[s] for s in load if s >= len(alone)) == smallest_capacity(others, left)


def test_shard_edge_rows(edge, empty, work):
    rows = sharding.shard(edge, work, 16).collect()
    assert len(rows) == edge.count() and {r["shard"] for r in rows} <= set(range(16))
    assert sharding.shard(empty, work, 16).collect() == []


# ---------------------------------------------------------------- vectors

def test_vectors_against_brute_force(spark, work, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = []
    for i, v in enumerate(base):
        for _ in range(rng.integers(1, 6)):
            rows.append((v + rng.standard_normal(16) * rng.choice([0, 0.05, 0.15]), int(i % 3)))
    near = rng.standard_normal(16)
    rows += [(near + rng.standard_normal(16) * 0.02, 1) for _ in range(150)]
    rows = [(i, [float(np.float32(x)) for x in v], l) for i, (v, l) in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, rows[0][1], None), (n + 4, [], 1),
             (n + 5, [1.0, None], 1), (n + 6, [float("inf")] * 16, 0), (n + 7, [-0.0, 1.0], 1), (n + 8, [0.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    monkeypatch.setattr(embeddings, "BATCH", 16)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(frame, work).collect()}
    ok = [r for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) and r[2] is not None]
    links = defaultdict(set)
    for i, v, l in ok:
        for j, w, m in ok:
            if i != j and l == m and len(v) == len(w):
                a, b = np.array(v), np.array(w)
                if a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)) >= 0.98:
                    links[i].add(j)
    low = {r[0]: r[0] for r in rows}
    for _ in rows:
        for i, js in links.items():
            low[i] = min([low[i], *(low[j] for j in js)])
    assert len(got) == len(rows)
    for i in low:
        assert got[i]["n_links"] == len(links[i])
        assert got[i]["component_id"] == low[i] and got[i]["kept"] == (i == low[i])


def test_recall_is_calibrated():
    for recall in (0.9, 0.99, 0.9999):
        k = embeddings.calibrate(recall)
        miss = 1 - math.erf(embeddings.DEVIATIONS / math.sqrt(2))
        m = embeddings.PROJECTIONS - embeddings.SORTED
        assert sum(math.comb(m, i) * miss ** i * (1 - miss) ** (m - i) for i in range(k + 1)) >= recall


def test_vectors_empty_and_repeated(spark, work):
    schema = "vec_id long, embedding array<float>, label int, key string"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema), work).collect() == []
    rows = [(1, [1.0, 0.0], 0, "k"), (1, [1.0, 0.0], 0, "k"), (None, [1.0, 0.0], 0, "k")]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, schema), work).collect()
    assert sorted((r["n_links"], r["component_id"]) for r in got) == [(2, 1)] * 3


# ---------------------------------------------------------------- chat

def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["\\", "<|", "|", "<", "|>", "<|end|>", "<|turn|>", "\n", "user", "\\n", "n", "é", "😀", "", "</turn>", "### "]
    turns = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", None, "odd\nrole", "a\\n<|", ""])
            turns.append((c, t, role, rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))]), 1))
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, segments int")
    out = chat.format_conversations(frame)
    got = {r["conv_id"]: r for r in out.select(
        "*", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for c in range(60):
        mine = [(r or "", x or "") for i, t, r, x, _ in turns if i == c]
        assert [(b["role"], b["text"]) for b in got[c]["back"]] == mine
        assert got[c]["loss"] == "".join(x for r, x in mine if r == "assistant")
        assert got[c]["n_turns"] == len(mine)
        assert got[c]["formatted"] == "".join(s["text"] for s in got[c]["segments"])


def test_role_machine(spark):
    cases = {("user", "assistant"): (True, None), ("system", "user", "assistant", "user", "assistant"): (True, None),
             ("user",): (False, None), ("assistant", "user"): (False, 0), ("user", "user", "assistant"): (False, 1),
             ("system", "assistant"): (False, 1), ("user", "assistant", "system"): (False, 2)}
    rows = [(i, t, r, "x") for i, roles in enumerate(cases) for t, r in enumerate(roles)]
    rows += [(None, 0, "user", "x"), (None, None, None, None)]
    got = {r["conv_id"]: r for r in chat.format_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for i, want in enumerate(cases.values()):
        assert (got[i]["valid"], got[i]["bad_turn"]) == want
    assert got[None]["n_turns"] == 2 and got[None]["bad_turn"] == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(none).collect() == []


def test_chat_stays_native(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.format_conversations(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# ---------------------------------------------------------------- WARC

def test_audit_locates_every_difference(spark, work):
    rng = random.Random(6)
    pages = [(i // 300, i, f"http://h/{i}", "b" * rng.randint(0, 50)) for i in range(1000)]
    pages += [(None, None, None, None), (9, 5, "u", "same"), (9, 5, "u", "same")]
    frame = spark.createDataFrame(pages, "file long, page_id long, url string, html string")
    recs = warc.records(frame)
    bad = {(0, 0), (0, 17), (1, 299), (2, 5), (None, 0), (9, 1)}
    cut = {(3, 99)}
    broken = recs.withColumn("record", F.when(
        F.struct("file", "ordinal").isin([]) | F.lit(False), F.col("record")).otherwise(F.col("record")))
    cond = F.lit(False)
    for f, o in bad:
        cond = cond | (F.col("file").eqNullSafe(F.lit(f)) & (F.col("ordinal") == o))
    broken = broken.withColumn("record", F.when(cond, F.concat(F.lit("!").cast("binary"), F.col("record"))).otherwise(F.col("record")))
    broken = broken.where("not (file <=> 3 and ordinal = 99)")
    one, other = warc.tree(recs, work), warc.tree(broken, work)
    found = {(r["file"], r["ordinal"]): r["status"] for r in warc.audit(one, other, work).collect()}
    assert found == {**dict.fromkeys(bad, "changed"), **dict.fromkeys(cut, "missing")}
    assert {(r["file"], r["ordinal"]): r["status"] for r in warc.audit(other, one, work).collect()}[3, 99] == "extra"
    assert warc.audit(one, one, work).collect() == []
    assert one[-1].groupBy("file").count().where("count > 1").count() == 0  # one root each
    rows = recs.where("file = 0").orderBy("ordinal").collect()
    assert [r["offset"] for r in rows] == [sum(len(x["record"]) for x in rows[:i]) for i in range(len(rows))]


def test_audit_of_empty_tables(spark, work):
    frame = spark.createDataFrame([], "file long, page_id long, url string, html string")
    tree = warc.tree(warc.records(frame), work)
    assert warc.audit(tree, tree, work).collect() == []


# ---------------------------------------------------------------- tokens

BITS = ["a", "e", " ", "  ", "\n", "the", "ing", "é", "中", "!!", "'s", "12", "\t", "x", "　", " \n", "😀", "ABC", "----",
        "\x1c", "\x85", "<|endoftext|>", " ", " "]


def fuzz_texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 60))) for _ in range(n)] + [
        "", None, " ", "a", " a", "a ", "  a", "word " * 5000, "x" * 3000, " " * 500]


def test_encode_like_the_library(spark, reference):
    texts = fuzz_texts(1)
    docs = spark.createDataFrame([(i, t, "d") for i, t in enumerate(texts)], "doc_id long, text string, decoded2 string")
    rows = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert len(rows) == len(texts)
    assert sorted(rows) == sorted(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect())
    for r in rows:
        text = texts[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_encode_edge_rows(edge, empty):
    assert bpe.encode(edge, RANKS, public_tokenizers.PATTERN).count() == edge.count()
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).collect() == []


def test_prefix_table_appends_and_edits(reference):
    voc, rng = bpe._vocabulary(RANKS), random.Random(2)
    for _ in range(150):
        piece = bytes(rng.choice(b"abetinghr") for _ in range(rng.randint(1, 300)))
        table = bpe.Prefixes(voc)
        at = rng.randint(0, len(piece))
        table.append(piece[:at])
        before = list(table.last)
        table.append(piece[at:])
        assert table.last[:at] == before
        assert table.ids() == reference._core_bpe.encode_single_piece(piece)
        at, remove = rng.randint(0, len(piece)), rng.randint(0, 4)
        new = piece[:at] + b"in" + piece[at + remove:]
        table.edit(at, remove, b"in")
        assert table.piece == new and table.ids() == reference._core_bpe.encode_single_piece(new)


# ---------------------------------------------------------------- packing

def check_pieces(rows, ids_of, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids_of)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == ids_of[d].tobytes()
        assert [r["start"] for r in pieces] == [sum(x["length"] for x in pieces[:i]) for i in range(len(pieces))]
        assert all(r["length"] * 4 == len(r["ids"]) and r["doc_tokens"] == len(ids_of[d]) for r in pieces)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [sum(x["length"] for x in pieces[:i]) for i in range(len(pieces))]
        assert sum(r["length"] for r in pieces) <= window
    return sum(len(v) for v in ids_of.values()) / (window * len(by_seq))


def test_pack_every_id_once(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(VOCABULARY)
    tok.encode_special_tokens = True
    texts = fuzz_texts(3) + ["A sentence here. Another one there.\n" * 400]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids int").coalesce(1)
    ids_of = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for i, t in enumerate(texts)}
    assert check_pieces(packing.pack(docs, VOCABULARY).collect(), ids_of, 1024) > 0.93
    check_pieces(packing.pack(docs, VOCABULARY, window=64).collect(), ids_of, 64)


def test_pack_edge_rows(edge, empty):
    rows = packing.pack(edge, VOCABULARY).collect()
    starts = [r for r in rows if r["start"] == 0]
    assert len(starts) == edge.count()
    assert packing.pack(empty, VOCABULARY).collect() == []


def test_cuts_are_the_best(seed=0):
    rng = random.Random(seed)
    for _ in range(200):
        window = rng.randint(3, 20)
        at, here = [], 0
        for _ in range(rng.randint(1, 25)):
            here += rng.randint(1, window)
            at.append(here)
        penalty = [rng.choice([0, 4, 9]) for _ in at]
        best = {0: 0}
        for a, p in zip(at, penalty):
            best[a] = min(best[b] + window - (a - b) + p for b in best if a - b <= window)
        cuts = packing.best_cuts(np.array(at), np.array(penalty), window)
        assert cuts[-1] == at[-1] and set(cuts) <= set(at)
        cost = sum(window - (b - a) + penalty[at.index(b)] for a, b in zip([0, *cuts], cuts))
        assert all(0 < b - a <= window for a, b in zip([0, *cuts], cuts)) and cost == best[at[-1]]
