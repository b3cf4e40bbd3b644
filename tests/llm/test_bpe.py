import hashlib
import random

import public_tokenizers as P
import pytest

from tidemark.llm import bpe

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "\n\n  ", "it's we're they'll I'd", "a" * 300, "  x   y\n\n\nz  ", "émigré ß 12345 ½ ²", "'" * 40 + "re", "x'r e's 're", "…—“”", "日本語 テスト", " ?!?! \t\t a", "🙂🙂 ok"]


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(VOCAB, P.PATTERN)


@pytest.mark.parametrize("size", [2, 3, 5, 17, 64])
def test_tree_equals_plain_encoding(enc, size):
    rng = random.Random(size)
    coder = bpe.Coder(enc[0], enc[1], size)
    texts = ODD + ["".join(rng.choice("ab're 'stvdlm\n\t1é½ !?ſ\x1c 　") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for t in texts:
        ids = coder.text(t)
        assert ids == enc[0].encode_ordinary(t), repr(t)
        assert bpe.decode_tree(ids, enc[1], size) == t.encode()


def test_round_trip_rows(spark, enc):
    texts = [*ODD, None, "word " * 30_000, "q" * 70_000, "same text", "same text"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in bpe.round_trip(df, VOCAB, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = enc[0].encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), VOCAB, P.PATTERN).count() == 0


@pytest.mark.parametrize("size", [4, 16, 100])
def test_runs_without_a_stable_place(enc, size):
    """One long match: halves joined by token windows equal the encoding of the whole."""
    rng = random.Random(size)
    coder = bpe.Coder(enc[0], enc[1], size)
    for letters in ("a", "ab", "the", "etaoinshr", "etaoinshrdlcumwfgypbvk", "語言本日", "0123456789", "=-", " ", "çéa"):
        for n in (size + 1, 50, 777):
            t = "".join(rng.choice(letters) for _ in range(n))
            if bpe.ONE_MATCH.fullmatch(t):
                assert coder.run(t.encode()) == enc[0]._encode_single_piece(t.encode()), (letters, n)
            assert coder.text(t) == enc[0].encode_ordinary(t)


def test_stable_places_are_borders(enc):
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice("ab're 'st\n1é½ !?  。语7\t\x1c") for _ in range(rng.randint(1, 30)))
        for m in bpe.STABLE.finditer(t):
            i = m.start()
            assert enc[0].encode_ordinary(t[:i]) + enc[0].encode_ordinary(t[i:]) == enc[0].encode_ordinary(t), (t, i)


def test_every_text_goes_through_the_tree(enc, monkeypatch):
    seen = []
    join = bpe.Coder.join
    monkeypatch.setattr(bpe.Coder, "join", lambda self, a, b: (seen.append(1), join(self, a, b))[1])
    t = "Some words, and 12 more. " * 60
    assert bpe.Coder(enc[0], enc[1]).text(t) == enc[0].encode_ordinary(t) and len(seen) >= 2
