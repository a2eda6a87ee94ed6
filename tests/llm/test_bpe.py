import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wanderframe.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello, World!", "don't I'LL we'Ve 's", "ΑΣ ΣΑΣ Ὀδυσσεύς", "İstanbul <|endoftext|>x<|startoftext|>", "á é 가", "\x00\x01\x7f\x85", "a" * 3000 + " " + "ab" * 900 + "é" * 700, "日本語 😀😀 ¼½ ٣", "x y​z", "1234567", "###!!!" * 200, "ß ẞ ﬁ ǅ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_the_library(spark, docs_of, library):
    got = {r.doc_id: r for r in bpe.encode_documents(docs_of(list(enumerate(TEXTS))), PATH).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].token_ids == ids and got[i].n_tokens == len(ids), t
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert got[i].kept == "k"


def test_digests(spark, docs_of, library):
    pairs = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "null id")]
    got = bpe.digest_documents(docs_of(pairs), PATH).collect()
    assert len(got) == len(pairs) and got[0].__fields__ == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in got:
        t = dict(pairs)[r.doc_id] or ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest_documents(docs_of([]), PATH).count() == 0


def test_long_words_equal_short_ones():
    v = bpe.load(PATH)
    for w in ("banana", "x", "zzzzzzzzzzzz", "internationalisation"):
        assert v._long(w.encode()) == v.merge([w.encode()])[0]
