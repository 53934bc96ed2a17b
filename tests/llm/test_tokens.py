"""Ids against a tokenizer that is loaded from the file and left as it is."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from tracelake.llm import packing, tokens
from tracelake.llm.tokens import WordBPE

TEXTS = [
    "hello <|endoftext|> world", "<|startoftext|>a<|endoftext|>", "don't<|endoftext|>'s", "x<|endoftext|>\u0338 y", "<|ENDOFTEXT|> <|EndOfText|>", "<|endoftext|", "<|<|endoftext|>|>",
    "<|endo\nftext|>", "cafe\u0301 <|endoftext|>\u0301e", "日 <|startoftext|>", "z" * 60 + "<|endoftext|>" + "z" * 60, "<|endoftext|>" * 5000, "a b\n" * 3000 + "<|startoftext|>", "",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(packing.vocabulary_path())


def test_special_tokens_are_the_librarys(plain):
    mine = WordBPE(packing.vocabulary_path())
    got = [np.frombuffer(b, "<u4").tolist() for b in mine.encode_bytes(TEXTS)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert got[0] == [3306, 49407, 1002]


def test_pieces_of_texts_with_special_tokens(spark, plain):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = packing.pack(df).toPandas().groupby("doc_id").length.sum()
    assert got.tolist() == [len(plain.encode(t, add_special_tokens=False).ids) + 1 for t in TEXTS]


def test_known_chunks_are_not_encoded_again(monkeypatch):
    """Each run goes to the encoder once, also when others are forgotten; marks and odd blanks as the library has them."""
    mine, asked = WordBPE(packing.vocabulary_path()), []
    encode = mine.encode_runs
    monkeypatch.setattr(mine, "encode_runs", lambda runs: asked.append(sorted(runs)) or encode(runs))
    monkeypatch.setattr(tokens, "KNOWN", 4)
    texts = ["one two three four", "one two, three four's five", "!'s a\x1cb !\x1d! x\x85y　z 3.14"]
    got = [np.frombuffer(mine.encode_bytes([t])[0], "<u4").tolist() for t in texts]
    assert got == [mine.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not {"one", "three"} & set(asked[1]) and "five" in asked[1]
