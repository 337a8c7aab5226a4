"""op7 measures pieces in tokens of the tokenizer file."""

import os
import random

import pytest

from impressa.llm import packing, queries


@pytest.mark.skipif(not os.path.exists(queries.TOKENIZER), reason="no tokenizer file")
def test_op7_counts_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.TOKENIZER)
    t.encode_special_tokens = True
    r = random.Random(7)
    odd = ["".join(r.choices(list("ab's1. \n\t\0\u00a0\u3000\u200bé中\x1c<|"), k=r.randrange(60))) for _ in range(300)]
    docs = dict(enumerate([None, "", "中文" * 3000, "x9Q+" * 4000, "it's  two  spaces ", " <|endoftext|> a", *odd, *odd[:5]]))
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got, rows = {}, queries.op7_packing(spark, str(tmp_path)).collect()
    for x in rows:
        got[x.doc_id] = got.get(x.doc_id, 0) + x.n_tokens
        assert x.n_tokens <= x.bucket_len <= packing.MAX_LEN
    assert got == {i: len(t.encode(x or "", add_special_tokens=False)) for i, x in docs.items()}
    assert max(got.values()) > packing.MAX_LEN
