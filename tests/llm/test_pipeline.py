"""The pipeline's stages against brute force on the smallest tables, and the registered queries' columns."""
import importlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from patchlens.llm import quality, registry
from patchlens.llm.common import new_path

from test_text_ops import components, simple_fingerprint, without_windows, words_of

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_": "vec_id n_links component_id kept",
    "op4_": "doc_id n_words n_removed kept_sha256",
    "op5_": "doc_id fingerprint component_id",
    "op6_": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op9_": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op11_": "lang source part item value rank",
    "op12_": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13_": "doc_id held_out score predicted",
}


def test_contract_columns(spark):
    queries, oracles = registry.load()
    assert {int(n[2:].split("_")[0]) for n in queries if n.startswith("op")} == set(range(1, 14)) and set(oracles) <= set(queries)
    for prefix, columns in COLUMNS.items():
        name = next(n for n in queries if n.startswith(prefix))
        want = columns.split()  # more columns may follow
        assert queries[name](spark, SF).columns[:len(want)] == want


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows before, rows after) of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, f"test-{name}")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return {s[0]: s[1:] for s in out}


def test_stage_order_and_columns(stages):
    assert list(stages) == ["quality_rules", "simhash_near_dedup", "substring_dedup", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][2] == stages[name][3]


def test_quality_stage(stages):
    before, after, _, _ = stages["quality_rules"]

    def bad(text):
        words = words_of(text)
        n = len(words)
        windows = [tuple(words[i:i + 5]) for i in range(n - 4)]
        count = Counter(windows)
        repeat = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
        symbols = sum(text.count(c) for c in "#*$%&|<>")
        shout = sum(any(65 <= b <= 90 for b in w) and not any(97 <= b <= 122 for b in w) for w in words)
        return n < 10 or 100 * len(repeat) > 20 * n or 100 * symbols > 10 * n or 100 * shout > 50 * n
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if not bad(r["text"]))
    assert quality.PRODUCTION.mask & quality.BASE.mask == quality.BASE.mask


def test_simhash_stage(stages):
    before, after, _, _ = stages["simhash_near_dedup"]
    groups = defaultdict(list)
    for r, g in zip(before, components([simple_fingerprint(r["text"]) for r in before], 4)):
        groups[g].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(min(g) for g in groups.values())


def test_substring_stage(stages):
    before, after, _, _ = stages["substring_dedup"]
    text = {r["doc_id"]: r for r in after}
    assert len(after) == len(before)
    for r, (kept, removed, _) in zip(before, without_windows([words_of(r["text"]) for r in before], 35, b" ".join)):
        got = text[r["doc_id"]]
        assert got["text"] == (kept.decode() if removed else r["text"]) and got["n_chars"] == len(got["text"])


def test_packing_stage(stages):
    before, after, _, _ = stages["packing"]
    whole = defaultdict(int)
    for r in after:
        whole[r["doc_id"]] += r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in after}
    assert whole == tokens and set(tokens) == {r["doc_id"] for r in before}
    load = defaultdict(int)
    for r in after:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 1024


def test_the_whole_pipeline_takes_awkward_and_no_rows(spark, edge, empty, tmp_path):
    """Null and repeated ids and texts, an empty table, and columns with clashing names, stage after stage."""
    for name, table in (("edge", edge), ("empty", empty)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        pieces = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        load = defaultdict(int)
        for r in pieces:
            load[r["sequence_id"]] += r["length"]
        assert all(v <= 1024 for v in load.values()) and bool(pieces) == (name == "edge")


def test_entry_works_without_the_subpackage(monkeypatch):
    import builtins
    import sys
    import __spark_entry__ as entry
    real = builtins.__import__

    def missing(name, *a, **k):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError(name=name)
        return real(name, *a, **k)
    monkeypatch.setattr(builtins, "__import__", missing)
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    try:
        assert not any(n.startswith("op") or n == "pipeline" for n in importlib.reload(entry).queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
