"""Problem 7: encoding a corpus with a public tokenizer.

A text is encoded as a tree: halves down to leaves of ``LEAF`` characters are
encoded by themselves, and neighbours are joined by re-encoding a window round
their seam that grows until the tokens outside of it provably stay the same.
The proof rests on two properties of the tokenizer: it first cuts a text into
words with a pattern that looks at most ``AHEAD`` characters past a cut and
never back, and it encodes each word by itself. So a cut of the left half at
least ``AHEAD`` before the seam is a cut of the whole, and where the window's
cuts meet a cut of the right half (again ``AHEAD`` before the window's own end)
all later cuts are those of the right half. Joining is associative, so the tree
may have any shape. Decoding goes up the tree, too: the bytes of both halves of
the ids one after the other. Both properties are checked when a tokenizer is
loaded; one that normalizes, or cuts words in another way, is refused.

The vocabulary may also lie beside the file as ranks; after a check that both
agree they are used, as that is several times faster.

Null and empty texts get the empty list of ids.
"""

from __future__ import annotations

import base64
import functools
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizers' files; the same path on every executor.
TOKENIZERS = os.environ.get("FOLIOGRAPH_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
LEAF = 2048
WINDOW = 64
AHEAD = 4
#: Words whose ids are kept; beyond that they are worked out again.
KEPT = 200_000
# --- Fixed value: the public pattern that byte-level tokenizers of this kind cut words with. ---
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A tree node: where each word begins, and the ids of each word.
Node = tuple[list[int], list[list[int]]]


def _byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level token stands for: printable Latin-1 characters for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class TreeEncoder:
    """Encodes by the tree; ``leaf`` and ``window`` are its smallest pieces."""

    def __init__(self, path: str = BYTE_BPE, leaf: int = LEAF, window: int = WINDOW):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        cutter, model = stated.get("pre_tokenizer") or {}, stated["model"]
        if stated.get("normalizer") or stated.get("post_processor") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level tokenizers that take texts as they are can be joined at seams")
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path}: words must be encoded by merges alone")
        self.path, self.leaf, self.window = path, max(1, leaf), max(AHEAD + 1, window)
        signs = _byte_signs()
        self.token_bytes: dict[int, bytes] = {i: bytes(signs[ch] for ch in token) for token, i in model["vocab"].items()}
        self.token_bytes |= {t["id"]: t["content"].encode() for t in stated.get("added_tokens", [])}
        self.words = regex.compile(PATTERN)
        self.ids_of: dict[str, list[int]] = {}
        self.ranked = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if known == {self.token_bytes[i]: i for i in model["vocab"].values()}:
                self.ranked = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})

    @functools.cached_property
    def tokenizer(self):
        """The tokenizer of the file itself."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    @functools.cached_property
    def byte_lengths(self) -> np.ndarray:
        """How many bytes each id stands for."""
        out = np.zeros(max(self.token_bytes) + 1, dtype=np.int64)
        for i, raw in self.token_bytes.items():
            out[i] = len(raw)
        return out

    def _word(self, word: str) -> list[int]:
        ids = self.ids_of.get(word)
        if ids is None:
            if len(self.ids_of) >= KEPT:
                self.ids_of.clear()
            ids = self.ids_of[word] = self._whole(word)
        return ids

    def _whole(self, text: str) -> list[int]:
        return self.ranked.encode_ordinary(text) if self.ranked else self.tokenizer.encode(text, add_special_tokens=False).ids

    def plain(self, text: str, at: int) -> Node:
        """A stretch of text that begins at ``at``, encoded by itself."""
        words, get = self.words.findall(text), self.ids_of.get  # the pattern leaves nothing out, so words follow each other
        return list(itertools.accumulate(map(len, words[:-1]), initial=at)) if words else [], [get(w) or self._word(w) for w in words]

    def join(self, text: str, left: Node, right: Node, begin: int, seam: int, end: int) -> Node:
        """The node of text[begin:end] from those of text[begin:seam] and text[seam:end]."""
        if not left[0] or not right[0]:
            return left if left[0] else right
        keep = len(left[0])
        while keep > 1 and left[0][keep - 1] > seam - AHEAD:
            keep -= 1
        keep -= 1  # the last cut that is certain; what follows it is encoded again
        start = left[0][keep]
        place = {cut: k for k, cut in enumerate(right[0])}
        width = self.window
        while True:
            stop = min(end, seam + width)
            cuts, words = self.plain(text[start:stop], start)
            for k, cut in enumerate(cuts):
                if cut >= seam and cut in place and (stop == end or cut <= stop - AHEAD):
                    r = place[cut]
                    return left[0][:keep] + cuts[:k] + right[0][r:], left[1][:keep] + words[:k] + right[1][r:]
            if stop == end:
                return left[0][:keep] + cuts, left[1][:keep] + words
            width *= 2

    def node(self, text: str, begin: int, end: int) -> Node:
        if end - begin <= self.leaf:
            return self.plain(text[begin:end], begin)
        seam = (begin + end) // 2
        return self.join(text, self.node(text, begin, seam), self.node(text, seam, end), begin, seam, end)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return [i for word in self.node(text, 0, len(text))[1] for i in word]

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Texts of one leaf need no join."""
        return [[] if not t else self._whole(t) if len(t) <= self.leaf else self.encode(t) for t in texts]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes of ids: those of both halves, one after the other."""
        if len(ids) <= self.leaf:
            return b"".join([self.token_bytes[i] for i in ids])
        half = len(ids) // 2
        return self.decode_bytes(ids[:half]) + self.decode_bytes(ids[half:])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(list(ids)).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str = BYTE_BPE, leaf: int = LEAF, window: int = WINDOW) -> TreeEncoder:
    """One encoder for each Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return TreeEncoder(path, leaf, window)


def _texts(part: pd.Series) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in part]


def ids(text: Column, path: str = BYTE_BPE) -> Column:
    """The token ids of a text column."""

    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for part in parts:
            yield pd.Series(e.encode_all(_texts(part)), dtype=object)

    return encode(text)


def size(text: Column, path: str = BYTE_BPE) -> Column:
    """The number of tokens of a text column; 0 for null and empty texts."""

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for part in parts:
            yield pd.Series([len(x) for x in e.encode_all(_texts(part))], dtype="int32")

    return count(text)


def text_of(token_ids: Column, path: str = BYTE_BPE) -> Column:
    """The text of a column of token ids; null for null."""

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for part in parts:
            yield part.map(lambda x: e.decode([int(i) for i in x]), na_action="ignore")

    return decode(token_ids)


def encoded(documents: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """doc_id and ids of each document."""

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for part in parts:
            listed = e.encode_all(part.column("text").to_pylist())
            ends = np.cumsum([0, *map(len, listed)])
            flat = np.fromiter(itertools.chain.from_iterable(listed), dtype=np.int32, count=int(ends[-1]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat))], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(encode, "doc_id bigint, ids array<int>")


def decoded(ids: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """doc_id and text of each row of ids; an empty list gives the empty text."""
    return ids.select("doc_id", text_of(F.col("ids"), path).alias("text"))
