"""Ids of whole tables and of words that end in symbols, by the tokenizer itself."""

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from lamella.llm import packing

SYMBOLS = ['(see this).', 'foo),', '"end".', "x]:", "dogs'.", '"###', '"!!', "İ. i̇, יִ! é? é.", "<|ENDOFTEXT|> <|endoftext|>. <|EndOfText|>, <|endoftext|>A.", "... a... 5%, ²; ٣: 漢, [.", "''. 'S. don't! '.'"]


def check(texts):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids, at = packing.WordIds(packing.tokenizer_text()).encode(texts, 1)
    wrong = [t[:60] for t, a, z in zip(texts, at[:-1], at[1:], strict=True) if not np.array_equal(ids[a:z], [*model.encode(t, add_special_tokens=False).ids, 1])]
    assert not wrong, (len(wrong), wrong[:9])


def test_symbols_before_sentence_marks():
    check(SYMBOLS)


def test_every_document():
    check([t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].to_pylist()])
