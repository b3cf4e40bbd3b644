import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from tidemark.llm import packing

VOCAB = P.path("word_bpe_49k.json")


def test_pieces_rebuild_all_ids(spark):
    texts = ["A first text, isn't it?", "", None, "ÉTÉ naïve\tx\x0by <|endoftext|> 12 345", "word\n" * 9000, "été ΣΑΣ", "dup", "dup"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    tok = Tokenizer.from_file(VOCAB)
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    rows = packing.pack(df, VOCAB, keep_ids=True).collect()
    for i, ids in want.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum((r["ids"] for r in own), []) == ids
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["ids"] == ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    at = 0
    for s, o, n in places:
        assert s * 2048 + o == at and o + n <= 2048
        at += n
    assert at == sum(map(len, want.values()))
    assert packing.pack(df.limit(0), VOCAB).count() == 0


def test_every_character_as_the_tokenizer_has_it():
    """All assigned characters, alone and after letters, with punctuation and contractions behind, and special strings."""
    tok = Tokenizer.from_file(VOCAB)
    chars = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    words = [c + t for c in chars for t in (".", "!", "'s")] + ["ab" + c + "." for c in chars]
    words += ["a<|endoftext|>b", "<|startoftext|>.", "<|endoftext|>", "<|endoftext|", "İstanbul.", "क़लम, ड़क।", "बाड़."]
    for i in range(0, len(words), 50_000):
        part = words[i : i + 50_000]
        want = [e.ids for e in tok.encode_batch(part, add_special_tokens=False)]
        got = [np.frombuffer(x, "<u2").tolist() for x in packing.encode_texts(part, VOCAB, "<u2")]
        assert [w for w, a, b in zip(part, got, want, strict=True) if a != b] == []


def test_forgetting_words_changes_nothing(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["été", "word", "x1,", "क़लम.", "it's"]) + str(rng.randint(0, 30)) * rng.randint(0, 1) for _ in range(40)) for _ in range(60)]
    want = [e.ids for e in Tokenizer.from_file(VOCAB).encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    got = [packing.encode_texts([t], VOCAB, "<u2")[0] for t in texts]
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == want


def test_null_ids_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "one two", 1), (None, "one two", 1), (5, "", 2)], "doc_id long, text string, part int")
    rows = packing.pack(df, VOCAB).collect()
    assert sorted((r["doc_id"] is None, r["doc_tokens"]) for r in rows) == [(False, 1), (True, 3), (True, 3)]


def test_words_in_use_outlive_a_full_memory(monkeypatch):
    """When the memory is full, words that texts share with former ones aren't encoded again; the ids are the same."""
    vocab = P.path("word_bpe_49k.json")
    tok, known, *_ = packing.tokenizer(vocab)
    monkeypatch.setattr(packing, "REMEMBERED", 60)
    known.clear()
    made, encode = [], packing.encode_cores
    monkeypatch.setattr(packing, "encode_cores", lambda tok, last, cores, width: made.extend(cores) or encode(tok, last, cores, width))
    name = lambda i: "".join(chr(97 + int(d)) for d in str(i))
    texts = [f"the same words, Come again. {' '.join(name(100 * k + i) for i in range(20))}" for k in range(8)]
    got = [packing.encode_texts([t], vocab, "<u2")[0] for t in texts]
    known.clear()
    assert got == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert made.count("the") == 1 and made.count("words") <= 2
