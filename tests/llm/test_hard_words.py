"""Words and lines that polynomial hashes modulo a power of two cannot tell apart; vectors of extreme length; planted vector pairs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from patchlens.llm import embeddings, quality, substrings


def thue_morse(n):
    """The sequence of length n over a and b, and its complement: equal sums of powers for every odd base modulo 2**64 from 1,024 on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


LENGTHS = (1024, 2048, 4096, 65536)


def test_long_words_of_one_pattern_are_different_words(spark, work):
    rest = " ".join(f"w{i}" for i in range(34))
    rows = [(2 * k + j, f"{word} {rest}") for k, n in enumerate(LENGTHS) for j, word in enumerate(thue_morse(n))]
    docs = spark.createDataFrame([(i, t) for i, t in rows if i < 2] + [(i, t.replace("w", f"v{i // 2}")) for i, t in rows if i > 1], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.summary(docs, work, 35).collect()}
    assert got == {i: 0 for i, _ in rows}
    same = docs.unionByName(docs.where("doc_id in (0, 5)").withColumn("text", F.concat("text", F.lit(" tail"))).withColumn("doc_id", F.col("doc_id") + 100))
    got = {r["doc_id"]: r["n_removed"] for r in substrings.summary(same, work, 35).collect()}
    assert {i: n for i, n in got.items() if n} == {0: 35, 100: 35, 5: 35, 105: 35}
    kept = {r["doc_id"]: r["text"] for r in substrings.without_repeats(docs, work, 35).collect()}
    assert kept == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_long_lines_of_one_pattern_are_different_lines(spark):
    rows = [(n, "\n".join(thue_morse(n))) for n in LENGTHS] + [(-n, "\n".join([thue_morse(n)[0]] * 3)) for n in LENGTHS]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_dup_lines"] for r in quality.ledger(docs).collect()}
    assert got == {i: 2 if i < 0 else 0 for i, _ in rows}


def test_long_words_repeat_only_as_themselves(spark):
    a, b = thue_morse(4096)
    rows = [(1, f"{a} x y z u {b} x y z u"), (2, f"{a} x y z u {a} x y z u")]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 10}


@pytest.mark.parametrize("scale", [1e-200, 1.0, 1e200, 5e-324])
def test_vectors_of_any_length_are_linked(spark, work, scale):
    rows = [(1, [1.0 * scale, 2.0 * scale, 0.0], 0), (2, [1.0 * scale, 2.0 * scale, 0.0], 0), (3, [2.0, 4.0, 0.0], 0), (4, [-1.0, 2.0, 0.0], 0), (5, [0.0] * 3, 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in
           embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), work).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5)}


def test_planted_pairs_are_found(spark, work):
    """Recall against brute force: every pair at 0.98 or more of 2,400 vectors, a third of them in one label's cluster."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((500, 64))
    which = np.concatenate([np.zeros(800, int), rng.integers(0, 500, 1600)])
    spread = rng.choice([0.05, 0.1, 0.15, 0.2], (2400, 1))
    vectors = (centres[which] + spread * rng.standard_normal((2400, 64))).astype(np.float32)
    label = which % 7
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(vectors, label))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in
           embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), work).collect()}
    v = vectors.astype(float)
    norm = np.sqrt((v * v).sum(1))
    linked = (v @ v.T / np.outer(norm, norm) >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    found, there = sum(n for n, _ in got.values()), int(linked.sum())
    assert there > 10_000 and found <= there and found >= 0.9999 * there
    assert sum(n != linked[i].sum() for i, (n, _) in got.items()) <= 0.0002 * there


def test_ids_by_ranks_are_the_librarys(spark):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from patchlens.llm import packing
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400).collect()]
    texts += ["", "<|endoftext|> a", "it's we'll I'M 12,345 x²", "Straße  naïve b  c", "日本語 テキスト", "a\tb\r\n c \n", "😀 emoji 👩‍👩‍👧", "ʰ ɐ ſ ß", " lead", "trail ",
              "x" * 5000 + " y", "ɐa bɏ", "Ⅷ ½ ① 𝟘", "\x1c \x85 ᠎", "א ب" * 30]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for pattern in (None, public_tokenizers.PATTERN):
        encoder, _ = packing._encoder(path, pattern)
        flat, begin = encoder.batch(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == want
    assert len(packing._ranks(path)) == 50256
