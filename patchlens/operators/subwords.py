"""Fixed-length encoding with a public sub-word vocabulary.

The vocabulary is a file of the tokenizers library, given by its path; it is not trained here. Whole texts are
encoded in Arrow batches, one tokenizer per worker, and every row becomes as long as the model's input.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.operators.tfidf import END_ID, FIRST_TOKEN_ID, MAX_LENGTH, PAD_ID, START_ID

#: Characters that the tokenizer gets at once: it holds a few hundred bytes for each.
STEP_CHARS = 1 << 20


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # such strings in a text are ordinary text
    tok.no_truncation()
    tok.no_padding()
    return tok


def _slices(texts: list[str]):
    """Runs of texts of about ``STEP_CHARS`` characters; a longer text is a run of its own."""
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= STEP_CHARS:
            size += len(texts[j])
            j += 1
        yield texts[i:j]
        i = j


def encode_subwords(docs: DataFrame, path: str, id_col: str = "row_id", text_col: str = "text",
                    max_length: int = MAX_LENGTH) -> DataFrame:
    """(id, n_tokens, input_ids[max_length], attention_mask[max_length]).

    Layout as in ``encode_fixed_length``: start id, the first ``max_length - 2`` sub-word ids (raised by the number of special ids), end id,
    then padding; mask 1 on real positions. n_tokens counts the whole text. Null texts count as empty.
    """
    body = max_length - 2

    def run(batches):
        tok = _tokenizer(path)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            ids = np.full((len(texts), max_length), PAD_ID, np.int32)
            total = np.zeros(len(texts), np.int64)
            row = 0
            for part in _slices(texts):
                for coded in tok.encode_batch_fast(part, add_special_tokens=False):
                    mine = coded.ids
                    head = mine[:body]
                    total[row] = len(mine)
                    ids[row, 0], ids[row, 1:len(head) + 1], ids[row, len(head) + 1] = START_ID, np.array(head, np.int32) + FIRST_TOKEN_ID, END_ID
                    row += 1
            used = np.minimum(total, body) + 2
            mask = (np.arange(max_length) < used[:, None]).astype(np.int32)
            off = pa.array(np.arange(0, ids.size + 1, max_length, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(x.reshape(-1))) for x in (ids, mask)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total), *lists], [id_col, "n_tokens", "input_ids", "attention_mask"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_tokens long, input_ids array<int>, attention_mask array<int>")
