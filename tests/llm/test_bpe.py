"""The encoder against the tokenizers library."""

import random
import sys

import numpy as np
import pytest

sys.path.insert(0, "/opt/tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from cohortspark.llm.bpe import decode_ids, encode_digests, encode_ids, tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
HAND = [
    "", " ", "Hello, World!", "it's we'll I'd", "<|endoftext|>a<|startoftext|>", "<|ENDOFTEXT|>", "ΟΔΟΣ Σ ΑΣ", "İstanbul",
    "é́ ﬁ ½ Ⅷ 一二三", "a\x1cb \x1f\x00", "x y　z w​v", "😀😀 👩‍👩‍👧", "aaaaaaaaaaaaaaaa", "a" * 500,
    "</w> w</w>", "''''s 'S 'LL", "12345 x1y2", "thnt, er.!! $$$ %%% | ",
]


def test_equals_library():
    library, own = Tokenizer.from_file(PATH), tokenizer(PATH)
    rng = random.Random(1)
    words = "the er ing tion ción enheit êtreaux lowei th nd A! B? &&& ... 9 é İ \n \t ".split(" ")
    cases = HAND + ["".join(rng.choice(words) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    cases += ["".join(chr(rng.choice([rng.randrange(1, 128), rng.randrange(128, 0xD000)])) for _ in range(20)) for _ in range(400)]
    for text in cases:
        ids = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert b"".join(own.decode(got)).decode() == library.decode(ids, skip_special_tokens=False)


def test_frames(spark):
    rows = [(1, "Hello there", 5), (1, "Hello there", 5), (2, None, 6), (3, "", 7), (None, "x " * 40000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.n_tokens) for r in encode_digests(docs, PATH).collect()))
    assert got == [(0, 40000), (1, 2), (1, 2), (2, 0), (3, 0)]
    back = decode_ids(encode_ids(docs, PATH), PATH).where("doc_id = 1").first()
    assert back.decoded == "hello</w> there</w>"
    assert encode_digests(docs.limit(0), PATH).count() == 0
