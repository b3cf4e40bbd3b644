"""Operator 9: concatenate and cut.

Pass one tokenises each text, ends it with the end id and writes the ids (two bytes each) together
with the running total inside its partition. The partition totals are summed to prefix sums, which
give each partition its global offset. Pass two cuts the one long sequence of all ids into fixed
windows: a document that crosses a border gets one boundary record for each window it touches. Only
the very last window is not full.

The order of documents is that of the written table; no row is moved between the passes. Null and
empty texts are the end id alone, and an empty table has no pieces. Repeated rows are packed as often
as they come, rows with a null id like others. A long text is one row of ids and as many pieces as it
needs. Special tokens that a text spells out are those tokens, as in the tokenizer's plain call. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WINDOW = 2048
END_ID = 1
#: Words whose ids a worker remembers; a memory bound, without effect on the result.
REMEMBERED = 500_000
#: Punctuation that may follow a word's letters and is a piece of its own.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer, the words known so far, which ids end a word, and which characters are letters."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    last = np.zeros(t.get_vocab_size(), bool)
    last[[i for w, i in t.get_vocab().items() if w.endswith("</w>")]] = True
    return t, {}, last, Letters(t)


class Letters(dict):
    """Character: whether it is a letter to the tokenizer once normalised, and one character. A word of
    such characters is one piece, whatever punctuation follows. İ and the composed nukta letters
    aren't: normalised, they end in a mark, which the pattern takes with the punctuation."""

    def __init__(self, tok):
        self.tok = tok

    def __missing__(self, c: str) -> bool:
        n = self.tok.normalizer.normalize_str(c)
        pieces = self.tok.pre_tokenizer.pre_tokenize_str
        self[c] = len(n) == 1 and len(pieces(n + ".")) == 2 and len(pieces("a" + n)) == 1
        return self[c]


def encode_cores(tok, last: np.ndarray, cores: list[str], width: str) -> list[bytes]:
    """The ids of words that are one piece each, encoded as one text; each word's last id ends a word."""
    ids = np.array(tok.encode(" ".join(cores), add_special_tokens=False).ids, width)
    ends = np.flatnonzero(last[ids]) + 1
    if len(ends) != len(cores):
        raise ValueError("a word that should be one piece to the tokenizer isn't")
    size, raw = ids.itemsize, ids.tobytes()
    at = [0, *(ends * size).tolist()]
    return [raw[i:j] for i, j in zip(at, at[1:], strict=False)]


def encode_texts(texts: list[str], path: str, width: str) -> list[bytes]:
    """The ids of each text as bytes of little-endian numbers.

    This vocabulary drops white space and never merges over it, so the ids of a text are those of
    its words one after the other; each worker remembers words it has met. A word of letters with
    punctuation behind is two pieces to the tokenizer's pattern (but for an apostrophe, which may
    start a contraction), and capitals A-Z are folded by it, so such words share their core.
    """
    tok, known, last, letters = tokenizer(path)
    split = [t.replace("\n", " ").split(" ") for t in texts]
    words_here = set().union(*split)
    new = words_here.difference(known)
    if not new:
        return [b"".join(map(known.__getitem__, words)) for words in split]
    if len(known) + len(new) > REMEMBERED:
        # most words come once, so those that these texts share with former ones are what is worth keeping
        kept = {w: known[w] for w in words_here.difference(new)}
        known.clear()
        known.update(kept)
    plain, odd, cores = [], [], set()
    for w in new:
        core = w.rstrip(TAIL)
        if core.isascii() and core.isalpha():
            low = core.lower()
            if low == w:
                cores.add(w)
            else:
                plain.append((w, low, w[len(core) :]))
        elif core.isalpha() and all(map(letters.__getitem__, core)):
            plain.append((w, core, w[len(core) :]))
        else:
            odd.append(w)
    cores = list(cores.union(c for _, c, _ in plain if c not in known))
    odd = list(set(odd).union(t for _, _, t in plain if t not in known))
    for i in range(0, len(cores), 4096):
        known.update(zip(cores[i : i + 4096], encode_cores(tok, last, cores[i : i + 4096], width), strict=True))
    for i in range(0, len(odd), 4096):
        for word, e in zip(odd[i : i + 4096], tok.encode_batch(odd[i : i + 4096], add_special_tokens=False), strict=True):
            known[word] = np.array(e.ids, width).tobytes()
    for w, core, tail in plain:
        known[w] = known[core] + known[tail] if tail else known[core]
    return [b"".join(map(known.__getitem__, words)) for words in split]


def tokens(docs: DataFrame, vocab: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """Pass one: (key, ids, n, part, start): ids with the end id, n of them, start inside the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                ids = [x + end for x in encode_texts(piece.column("t").to_pylist(), vocab, "<u2")]
                n = np.array([len(x) // 2 for x in ids], "i8")
                start = total + np.cumsum(n) - n
                total += int(n.sum())
                yield pa.RecordBatch.from_arrays([piece.column("k"), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, "i4")), pa.array(start)], [key, "ids", "n", "part", "start"])

    return docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, f"{key} long, ids binary, n long, part int, start long")


def pack(docs: DataFrame, vocab: str, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence; with keep_ids also the piece's ids."""
    encoded = written(tokens(docs, vocab, key=key, text=text, end_id=end_id), "tokens")
    # one row for each task of pass one, so this window is small however large the input is
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    placed = encoded.join(F.broadcast(offsets), "part").select(key, "ids", (F.coalesce("before", F.lit(0)) + F.col("start")).cast("long").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for k, raw, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                wide, n, start = ids.tobytes(), len(ids), 0
                while start < n:
                    offset = (at + start) % window
                    length = min(window - offset, n - start)
                    for col, v in zip(out, (k, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), n, (at + start) // window, offset, ids[start : start + length] if keep_ids else None), strict=True):
                        col.append(v)
                    start += length
            cols = [pa.array(c, pa.int64()) for c in out[:7]] + ([pa.array(out[7], pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(cols, [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(cols)])

    schema = f"{key} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return placed.mapInArrow(run, schema)
