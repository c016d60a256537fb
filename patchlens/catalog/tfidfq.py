"""TF-IDF and token-encoding queries (M9-M11, M15) on all documents, split
by source project."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens import oracle as O
from patchlens.catalog import register
from patchlens.operators import sampling as W
from patchlens.operators import subwords as SW
from patchlens.operators import tfidf as TF
from patchlens.sources.fixtures import corpus_rows

CORPUS = """
text_rows AS (SELECT doc_id AS row_id, text, source AS project FROM documents)"""

SPLIT = O.with_(CORPUS).rstrip() + f""",
projects AS (SELECT DISTINCT project FROM text_rows),
ranked AS (SELECT project, row_number() OVER (ORDER BY {O.md5_key('project')}) AS r,
                  count(*) OVER () AS n FROM projects),
assign AS (SELECT project, CASE WHEN r <= greatest(1, floor(n * 0.25)) THEN 'test' ELSE 'train' END AS split
           FROM ranked),
train_docs AS (SELECT t.* FROM text_rows t JOIN assign a ON t.project IS NOT DISTINCT FROM a.project
               WHERE a.split = 'train'),
test_docs AS (SELECT t.* FROM text_rows t JOIN assign a ON t.project IS NOT DISTINCT FROM a.project
              WHERE a.split = 'test')"""

IDENT = O.lit(r"[a-zA-Z_][a-zA-Z0-9_]*")
WORD_TERMS = f"""list_concat(toks, CASE WHEN len(toks) >= 2
      THEN list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]) ELSE [] END)"""


def _char_terms() -> str:
    p = "(' ' || w || ' ')"
    per = [f"CASE WHEN length({p}) >= {k} THEN list_transform(range(1, length({p}) - {k} + 2), "
           f"lambda i: substring({p}, i, {k})) ELSE [] END" for k in (3, 4, 5)]
    return (f"flatten(list_transform(list_filter(string_split_regex(lower(coalesce(text, '')), "
            f"{O.lit(O.WS + '+')}), lambda w: w <> ''), lambda w: list_concat({', '.join(per)})))")


def _terms_cte(src: str, name: str, analyzer: str) -> str:
    if analyzer == "word":
        return (f"{name} AS (SELECT row_id, unnest({WORD_TERMS}) AS term FROM "
                f"(SELECT row_id, regexp_extract_all(lower(coalesce(text, '')), {IDENT}) AS toks FROM {src}) x)")
    return f"{name} AS (SELECT row_id, unnest({_char_terms()}) AS term FROM {src})"


def tfidf_sql(params: TF.TfidfParams, apply_to: str = "train") -> str:
    ctes = [_terms_cte("train_docs", "tr_terms", params.analyzer),
            "tr_tc AS (SELECT row_id, term, count(*) AS tf FROM tr_terms GROUP BY row_id, term)",
            "ndocs AS (SELECT count(*) AS n FROM train_docs)",
            "stats AS (SELECT term, count(*) AS df, sum(tf) AS cnt FROM tr_tc GROUP BY term)",
            f"""vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx,
                         ln((1 + n) / (1 + df)) + 1 AS idf
                  FROM (SELECT * FROM stats, ndocs WHERE df >= {params.min_df} AND df <= {params.max_df} * n
                        ORDER BY cnt DESC, term ASC LIMIT {params.max_features}) v)"""]
    src = "tr_tc"
    if apply_to == "test":
        ctes += [_terms_cte("test_docs", "te_terms", params.analyzer),
                 "te_tc AS (SELECT row_id, term, count(*) AS tf FROM te_terms GROUP BY row_id, term)"]
        src = "te_tc"
    ctes.append(f"weighted AS (SELECT row_id, term, idx, (1 + ln(tf)) * idf AS w FROM {src} JOIN vocab USING (term))")
    return (SPLIT + ",\n" + ",\n".join(ctes) +
            "\nSELECT row_id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS weight FROM weighted")


def _split(spark, sf):
    return W.project_wise_split(corpus_rows(spark, sf))


def _fit(spark, sf, params):
    s = _split(spark, sf)
    train = s.filter(F.col("split") == "train")
    return s, TF.fit_transform(train, params)


@register("tfidf_word", tfidf_sql(TF.WORD), ints=("idx",), doubles=("weight",))
def tfidf_word(spark, sf):
    """M9: word 1-2-gram TF-IDF of the training documents (long form)."""
    _, (vocab, weights) = _fit(spark, sf, TF.WORD)
    return weights.select("row_id", "term", "idx", "weight")


@register("tfidf_char", tfidf_sql(TF.CHAR), ints=("idx",), doubles=("weight",))
def tfidf_char(spark, sf):
    """char_wb 3-5-gram TF-IDF of the training documents (long form)."""
    _, (vocab, weights) = _fit(spark, sf, TF.CHAR)
    return weights.select("row_id", "term", "idx", "weight")


@register("tfidf_transform", tfidf_sql(TF.WORD, "test"), ints=("idx",), doubles=("weight",))
def tfidf_transform(spark, sf):
    """Test documents with the training vocabulary and idf; unseen terms dropped."""
    s, (vocab, _) = _fit(spark, sf, TF.WORD)
    test = s.filter(F.col("split") == "test")
    return TF.transform(TF.term_counts(test, TF.WORD), vocab).select("row_id", "term", "idx", "weight")


ENCODE_SQL = SPLIT + f""",
toks AS (SELECT row_id, regexp_extract_all(lower(coalesce(text, '')), {IDENT}) AS t FROM text_rows),
tr_toks AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), {IDENT})) AS token FROM train_docs),
vocab AS (SELECT token, row_number() OVER (ORDER BY {O.md5_key('token')}, token) - 1 + {TF.FIRST_TOKEN_ID} AS token_id
          FROM (SELECT DISTINCT token FROM tr_toks) v),
head AS (SELECT row_id, unnest(list_slice(t, 1, {TF.MAX_LENGTH - 2})) AS token,
                generate_subscripts(list_slice(t, 1, {TF.MAX_LENGTH - 2}), 1) AS pos FROM toks),
ids AS (SELECT h.row_id, string_agg(CAST(coalesce(v.token_id, {TF.UNK_ID}) AS VARCHAR), ',' ORDER BY h.pos) AS body
        FROM head h LEFT JOIN vocab v ON h.token = v.token GROUP BY h.row_id),
enc AS (SELECT k.row_id, len(k.t) AS n_tokens, i.body,
               least(len(k.t), {TF.MAX_LENGTH - 2}) + 2 AS used FROM toks k LEFT JOIN ids i ON k.row_id = i.row_id)
SELECT row_id, n_tokens,
       '{TF.START_ID}' || CASE WHEN body IS NULL THEN '' ELSE ',' || body END || ',{TF.END_ID}'
         || repeat(',{TF.PAD_ID}', {TF.MAX_LENGTH} - used) AS ids_csv,
       used AS mask_sum
FROM enc"""


@register("encode_fixed_length", ENCODE_SQL, ints=("n_tokens", "mask_sum"))
def encode_fixed_length(spark, sf):
    """Ids from the training token vocabulary, truncated / padded to 256, with mask."""
    s = _split(spark, sf)
    vocab = TF.fit_token_vocabulary(s.filter(F.col("split") == "train"))
    enc = TF.encode_fixed_length(corpus_rows(spark, sf), vocab)
    return enc.select("row_id", F.col("n_tokens").cast("long").alias("n_tokens"),
                      F.array_join("input_ids", ",").alias("ids_csv"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("mask_sum"))


@register("encode_subwords")
def encode_subwords(spark, sf):
    """All documents as sub-word ids of a public byte-level vocabulary, truncated / padded to 256, with mask."""
    import public_tokenizers
    enc = SW.encode_subwords(corpus_rows(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))
    return enc.select("row_id", "n_tokens", F.array_join("input_ids", ",").alias("ids_csv"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("mask_sum"))
