"""Operator 7: byte-level BPE as a monoid tree reduction.

A piece of text is an element (head, ids, tail): head and tail are the text at its two open edges,
ids are the tokens between them, which no neighbour can change any more. Two neighbours are joined
by encoding the window tail + head between them; if that window holds no stable place it stays
open and grows with the next join. A place is stable where the split pattern has a border whatever
stands further off: before white space behind another character, before the last of several white
spaces, and between letters, digits and signs (not behind an apostrophe, which may start a
contraction). Every text is halved recursively down to leaves of LEAF characters, and the elements
are joined up the tree; the decoder concatenates bytes up the same kind of tree.

A match of the pattern longer than a leaf (a run of letters, say) is reduced by a tree over its bytes:
two halves are encoded apart and joined by encoding a window of tokens around the seam again, which
grows until its first and last token stand next to their neighbours as they would if only these two
were encoded. A row of tokens in which that holds for all neighbours is the encoding of the whole, so
the tokens outside the window are then final.

Nulls and empty texts have no tokens (the digests are those of the empty string). Repeated rows and
rows with null ids give rows like others, an empty table none; memory is that of one text and its ids.
Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters (or bytes, or ids to decode) of a leaf.
LEAF = 512
#: Some letters and signs, of which every version of Unicode says that they are such.
LETTER, SIGN = "A-Za-zà-öø-ÿ\u0430-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", "!-&(-/:-@\\[-`{-~\u2013\u2014\u3001\u3002\uff0c"
SOLID = LETTER + SIGN + "0-9'"
#: Stable places; a subset of those that there are.
STABLE = re.compile(rf"(?<=\S)(?=[ \n])|(?<=[ \n])(?=[ \n][{SOLID}])|(?<=[{LETTER}])(?=[{SIGN}0-9'])|(?<=[0-9])(?=[{LETTER}{SIGN}'])|(?<=[{SIGN}'])(?=[0-9])|(?<=[{SIGN}])(?=[{LETTER}])")
#: Texts that are one match of the pattern.
ONE_MATCH = re.compile(rf" ?(?:[{LETTER}]+|[0-9]+|[{SIGN}]+)|[ \n]+")


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("tidemark", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    top = max(ranks.values()) + 1
    words = [b""] * top
    for word, rank in ranks.items():
        words[rank] = word
    return enc, words, [str(i) for i in range(top)]


class Element:
    """A piece of text: final ids between two open edges; ids None: no stable place, all is head."""

    __slots__ = ("head", "ids", "tail")

    def __init__(self, head: str, ids: list[int] | None = None, tail: str = ""):
        self.head, self.ids, self.tail = head, ids, tail


class Coder:
    """The tree over an encoding, with leaves of `size`."""

    def __init__(self, enc, words: list[bytes], size: int = LEAF):
        self.enc, self.words, self.size = enc, words, size

    def encode(self, text: str) -> list[int]:
        """A window between stable places: by a tree over its bytes if it is one long match."""
        if len(text) > self.size and ONE_MATCH.fullmatch(text):
            return self.run(text.encode())
        return self.enc.encode_ordinary(text)

    def leaf(self, text: str) -> Element:
        first = STABLE.search(text)
        if not first:
            return Element(text)
        start = last = first.start()
        back = 32
        while True:  # the last stable place: looked for from the end
            at = max(start, len(text) - back)
            found = [m.start() for m in STABLE.finditer(text, at)]
            if found or at == start:
                last = max([last, *found])
                return Element(text[:start], self.encode(text[start:last]), text[last:])
            back *= 4

    def join(self, a: Element, b: Element) -> Element:
        if a.ids is not None and b.ids is not None:
            return Element(a.head, a.ids + self.encode(a.tail + b.head) + b.ids, b.tail)
        # an open element: the window may hold the first stable place, at the seam itself
        inner = self.leaf((a.head if a.ids is None else a.tail) + b.head)
        if inner.ids is None:
            if a.ids is None:
                return inner if b.ids is None else Element(inner.head, b.ids, b.tail)
            return Element(a.head, a.ids, inner.head)
        if a.ids is not None:
            return Element(a.head, a.ids + self.encode(inner.head) + inner.ids, inner.tail)
        if b.ids is not None:
            return Element(inner.head, inner.ids + self.encode(inner.tail) + b.ids, b.tail)
        return inner

    def reduce(self, text: str) -> Element:
        if len(text) <= self.size:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.reduce(text[:half]), self.reduce(text[half:]))

    def text(self, text: str) -> list[int]:
        """The ids of a whole text."""
        e = self.reduce(text)
        return self.encode(e.head) if e.ids is None else self.encode(e.head) + e.ids + self.encode(e.tail)

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes together."""
        return self.enc._encode_single_piece(self.words[a] + self.words[b]) == [a, b]

    def run(self, raw: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if len(raw) <= self.size:
            return self.enc._encode_single_piece(raw) if raw else []
        half = len(raw) // 2
        a, b = self.run(raw[:half]), self.run(raw[half:])
        i = j = 1
        while True:
            i, j = min(i, len(a)), min(j, len(b))
            window = self.enc._encode_single_piece(b"".join([self.words[x] for x in a[len(a) - i :] + b[:j]]))
            left = i == len(a) or self.apart(a[-i - 1], window[0])
            right = j == len(b) or self.apart(window[-1], b[j])
            if left and right:
                return a[: len(a) - i] + window + b[j:]
            i, j = (i if left else 2 * i), (j if right else 2 * j)


def decode_tree(ids: list[int], words: list[bytes], size: int = LEAF) -> bytes:
    if len(ids) <= size:
        return b"".join([words[i] for i in ids])
    half = len(ids) // 2
    return decode_tree(ids[:half], words, size) + decode_tree(ids[half:], words, size)


def ids_digest(ids: list[int], names: list[str], step: int = 1 << 16) -> str:
    h = hashlib.sha256()
    for i in range(0, len(ids), step):
        h.update(((",") * bool(i) + ",".join([names[x] for x in ids[i : i + step]])).encode())
    return h.hexdigest()


def round_trip(docs: DataFrame, vocab: str, pattern: str, *, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode each text, decode the ids again and return digests of both; with keep_ids also the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, words, names = encoder(vocab, pattern)
        coder = Coder(enc, words)
        for batch in batches:
            counts, left, right, kept = [], [], [], []
            for t in batch.column("t").to_pylist():
                ids = coder.text(t)
                counts.append(len(ids))
                left.append(ids_digest(ids, names))
                right.append(hashlib.sha256(decode_tree(ids, words)).hexdigest())
                if keep_ids:
                    kept.append(ids)
            cols = [batch.column("k"), pa.array(counts, pa.int64()), pa.array(left), pa.array(right)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.list_(pa.int32()))] * keep_ids, [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids])

    schema = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, schema)
