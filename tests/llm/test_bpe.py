import hashlib
import random
import struct

import pytest

from tessella.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    reference = tokenizers.Tokenizer.from_file(bpe.default_path())
    reference.no_truncation()
    return reference, bpe.Vocabulary(bpe.default_path())


def texts():
    rng = random.Random(3)
    alphabet = "aàâ bcdeéfgh ijlmnoprst uvxyz''.,;!?#$%&<>|0123456789\n\t ΣσßİǺ中文字 にほ​\xa0\x85\x1c😀👍🏽"
    yield from ("", "Hello world", "don't we're I'll 'tis !!'s", "ΑΣ ΣΑΣ", "a" * 5000, "ab" * 900 + "!" * 400, "<|endoftext|>x <|startoftext|>", "é Å")
    for _ in range(400):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120)))


def test_like_the_library(pair):
    reference, ours = pair
    for text in texts():
        encoding = reference.encode(text, add_special_tokens=False)
        ids, decoded = ours.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == encoding.ids, text
        assert decoded == reference.decode(encoding.ids, skip_special_tokens=False), text
        assert decoded == ours.decode(ids)


def test_short_and_long_words_alike(pair):
    ours = pair[1]
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 60)))
        assert ours.merge(word) == bpe._merge_long([*word[:-1], word[-1] + ours.suffix], ours.ranks)


def test_digests(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Some words, some more.", "x"), (3, "Some words, some more.", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = sorted(bpe.digests(docs).collect())
    assert [r.n_tokens for r in out][:2] == [0, 0]
    assert out[0].ids_sha256 == out[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[2] == out[3]
    assert bpe.digests(docs.limit(0)).count() == 0
    one = bpe.encoded(docs.where("doc_id = 3")).first()
    assert hashlib.sha256(struct.pack(f"<{len(one.ids)}I", *one.ids)).hexdigest() == out[2].ids_sha256
