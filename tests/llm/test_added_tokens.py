import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keyscape.llm import token_files

TEXTS = ["a <|endoftext|> b", "a <|ENDOFTEXT|> b", "<|EndOfText|>", "<|endoftext|>", "A <|startoftext|>x",
         "a <|STARTOFTEXT|>x", "Plain text", "plain TEXT", "<| odd", "x" * 90 + "<|endoftext|>", None]


@pytest.mark.parametrize("turned", [False, True])
def test_added_tokens_keep_their_case(spark, documents, tmp_path, turned):
    """Both spellings of an added token in one batch, either one first."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = list(enumerate(TEXTS[::-1] if turned else TEXTS))
    out = f"{tmp_path}/files"
    token_files.write_token_files(documents(rows).coalesce(1), out, path, 1, folds=True)
    got = token_files.read_token_files(spark, out, ids=True).collect()
    ids = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in got}
    assert ids == {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
