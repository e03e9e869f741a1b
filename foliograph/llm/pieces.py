"""Problem 9: cutting oversized texts into balanced pieces at natural boundaries.

Of a text of n tokens over a limit, the least number of pieces is computed from
the limit and the overlap, equal-length targets are placed, and each is snapped
to the strongest boundary near it that leaves every later piece possible. The
size that counts is that of the piece encoded by itself; if any piece is over
the limit, one more piece is tried. A piece has the words of the whole text but
at its two ends, so only windows there are encoded again. One task handles a
text at a time, so texts of any length only cost memory in proportion to
themselves.

Every text that is neither null nor empty comes out; one within the limit is
its own only piece. Null and empty texts have nothing to cut and give no row.
The overlap is counted in tokens of the whole text; where a token begins within
a character, the piece begins at the character, so it may be a token or two
longer there.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import encode

#: Kinds of boundary from weak to strong.
KINDS = ["none", "blank", "clause", "sentence", "line", "paragraph"]
#: How far from its target a cut may move, as a share of a piece's length.
REACH = 0.25
#: More profiles than this are no parameter any more.
MAX_PROFILES = 1000
# --- Fixed values: signs that end sentences and clauses, and signs that may stand after them. ---
_SENTENCE = ".!?…。！？"
_CLAUSE = ",;:–—)、，；："
_CLOSING = "\"'”’»)]"
_BLANK, _ENDS_SENTENCE, _ENDS_CLAUSE, _CLOSES = 1, 2, 4, 8
_CLASSES = np.zeros(0x10000, dtype=np.uint8)
for _signs, _bit in (("".join(chr(p) for p in range(0x3001) if chr(p).isspace()), _BLANK), (_SENTENCE, _ENDS_SENTENCE), (_CLAUSE, _ENDS_CLAUSE), (_CLOSING, _CLOSES)):
    _CLASSES[[ord(ch) for ch in _signs]] |= _bit


def boundary_strengths(points: np.ndarray) -> np.ndarray:
    """Of each place of a text, given as its code points: how strong a boundary it is; 0 for a place not next to white space."""
    n = len(points)
    strengths = np.zeros(n + 1, dtype=np.int8)
    kinds = _CLASSES[np.minimum(points, 0xFFFF)]
    blank = np.concatenate([[0], kinds & _BLANK, [0]]).astype(np.int8)
    edges = np.diff(blank)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    inner = (starts > 0) & (ends < n)
    starts, ends = starts[inner], ends[inner]
    if not len(starts):
        return strengths
    before = starts - 1  # the sign before the gap, behind at most two that close
    for _ in range(2):
        back = (kinds[before] & _CLOSES > 0) & (before > 0) & (starts - before < 3)
        before = before - back
    closed = kinds[before] & _CLOSES > 0
    before = np.where(closed, starts - 1, before)
    kind = kinds[before]
    lines = np.cumsum(np.concatenate([[0], (points == 10) | (points == 13)])) - np.cumsum(np.concatenate([[0, 0], (points[:-1] == 13) & (points[1:] == 10)]))
    lines = lines[ends] - lines[starts]
    feeds = np.cumsum(np.concatenate([[0], points == 12]))
    strong = np.where((lines > 1) | (feeds[ends] > feeds[starts]), 5, np.where(lines > 0, 4, np.where(kind & _ENDS_SENTENCE > 0, 3, np.where(kind & _ENDS_CLAUSE > 0, 2, 1))))
    for a, b, x in zip(starts.tolist(), ends.tolist(), strong.tolist()):
        strengths[a : b + 1] = x  # a token takes along the last blank before it
    return strengths


class Text:
    """A text with its tokens, its words and its boundaries."""

    def __init__(self, text: str, e: encode.TreeEncoder):
        self.text, self.e = text, e
        self.cut_list, self.words = e.node(text, 0, len(text))
        self.n = sum(map(len, self.words))

    @functools.cached_property
    def place(self) -> dict[int, int]:
        return {c: k for k, c in enumerate(self.cut_list)}

    def place_tokens(self) -> None:
        """Where tokens begin, and how strong a boundary that is; of no use for a text within all limits."""
        if hasattr(self, "before"):
            return
        text, e = self.text, self.e
        self.cuts = np.array(self.cut_list, dtype=np.int64)
        self.before = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)  # tokens before each word
        ids = list(itertools.chain.from_iterable(self.words))
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        token_bytes = np.concatenate([[0], np.cumsum(e.byte_lengths[ids])])
        char_bytes = np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))])
        self.char_at = np.searchsorted(char_bytes, token_bytes, side="right") - 1  # the character a token begins in
        self.whole = char_bytes[self.char_at] == token_bytes
        self.strength = np.where(self.whole, boundary_strengths(points)[self.char_at], -1)

    def size(self, a: int, b: int) -> int:
        """The tokens of text[a:b] by itself: windows at both ends are encoded, what lies between has the words of the whole."""
        width = self.e.window
        while True:
            stop = min(b, a + width)
            cuts, words = self.e.plain(self.text[a:stop], a)
            if stop == b:
                return sum(map(len, words))
            first = next((k for k, c in enumerate(cuts) if c <= stop - encode.AHEAD and c in self.place), None)
            if first is not None:
                break
            width *= 2
        begin = self.place[cuts[first]]
        last = int(np.searchsorted(self.cuts, b - encode.AHEAD, side="right")) - 1
        last = max(last, begin)
        tail = sum(map(len, self.e.plain(self.text[int(self.cuts[last]) : b], 0)[1]))
        return sum(map(len, words[:first])) + int(self.before[last] - self.before[begin]) + tail


def _cuts(n: int, limit: int, overlap: int, k: int, strength: np.ndarray) -> list[int] | None:
    """Ends of k pieces as token numbers, or None if there are no such. strength: -1 for a token that begins within a character."""
    ends: list[int] = []
    start, share = 0, (n - overlap) / k
    # the more pieces, the shorter each may be: so that one more piece does help where a piece by itself is over the limit
    limit = min(limit, int(share) + overlap + 1 + max(1, int(REACH * share)))
    reach = max(1, int(REACH * share))
    for i in range(1, k):
        lo = max(start + overlap + 1, n - (k - i) * (limit - overlap))
        hi = min(start + limit, n - 1)
        target = overlap + round(i * share)
        a, b = max(lo, target - reach), min(hi, target + reach)
        if a > b or strength[a : b + 1].max() < 1:  # no boundary near: any that is possible
            a, b = lo, hi
            if a > b:
                return None
        near = strength[a : b + 1]
        best = near.max()
        if best < 0:
            return None
        at = np.flatnonzero(near == best) + a
        end = int(at[np.argmin(np.abs(at - target))])
        ends.append(end)
        start = end - overlap
    return [*ends, n] if n - start <= limit else None


def split(text: str, limit: int, overlap: int, e: encode.TreeEncoder, known: Text | None = None) -> list[tuple[int, int, int, int, str]]:
    """Pieces (first character, end, tokens, tokens shared with the piece before, kind of the cut before it)."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("a limit must be at least 1 and larger than the overlap")
    t = known or Text(text, e)
    n = t.n
    if n <= limit:
        return [(0, len(text), n, 0, "none")]
    t.place_tokens()
    k = -(-(n - overlap) // (limit - overlap))
    while True:
        ends = _cuts(n, limit, overlap, k, t.strength)
        if ends:
            spans, start = [], 0
            for end in ends:
                spans.append((start, end))
                start = end - overlap
                while start > 0 and not t.whole[start]:
                    start -= 1
            places = [(int(t.char_at[a]), int(t.char_at[b])) for a, b in spans]
            sizes: list[int] = []
            for a, b in places:
                sizes.append(t.size(a, b))
                if sizes[-1] > limit:
                    break
            else:
                shared = [0, *(spans[i - 1][1] - spans[i][0] for i in range(1, len(spans)))]
                return [(a, b, size, share, KINDS[max(0, int(t.strength[spans[i - 1][1]]))] if i else "none") for i, ((a, b), size, share) in enumerate(zip(places, sizes, shared))]
        k += 1
        if k > n:
            raise ValueError("the limit is smaller than a character")


SCHEMA = "doc_id bigint, profile string, piece int, pieces int, first_char int, end_char int, tokens int, shared_tokens int, cut string, text string"
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def split_all(documents: DataFrame, limits: DataFrame, path: str = encode.BYTE_BPE) -> DataFrame:
    """Pieces of every text by every profile of ``limits`` (profile, max_tokens, overlap_tokens), a parameter table."""
    profiles = [(r[0], int(r[1]), int(r[2] or 0)) for r in limits.select("profile", "max_tokens", "overlap_tokens").where("profile is not null and max_tokens is not null").distinct().limit(MAX_PROFILES + 1).collect()]
    if len(profiles) > MAX_PROFILES:
        raise ValueError("too many profiles for a parameter")
    profiles.sort()
    fields = pa.schema([pa.field(c.split()[0], _TYPES[c.split()[1]]) for c in SCHEMA.split(", ")])

    def pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encode.encoder(path)
        for part in parts:
            doc_ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                rows = []
                group = texts[at : at + 256]
                for doc_id, text in zip(doc_ids[at : at + 256], group):
                    known = Text(text, e)
                    for profile, limit, overlap in profiles:
                        cut = split(text, limit, overlap, e, known)
                        rows += [(doc_id, profile, i, len(cut), a, b, size, shared, kind, text[a:b]) for i, (a, b, size, shared, kind) in enumerate(cut)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return documents.select("doc_id", "text").where("text is not null and text <> ''").mapInArrow(pieces, SCHEMA)


def summary(pieces: DataFrame) -> DataFrame:
    """Per profile: texts, texts cut, pieces, largest piece and how the cuts fell."""
    return pieces.groupBy("profile").agg(
        F.count_if(F.col("piece") == 0).alias("texts"),
        F.count_if((F.col("piece") == 0) & (F.col("pieces") > 1)).alias("texts_cut"),
        F.count("*").alias("pieces"),
        F.max("tokens").alias("largest"),
        F.count_if((F.col("piece") > 0) & (F.col("cut") == "none")).alias("cuts_within_words"),
        F.count_if((F.col("piece") > 0) & F.col("cut").isin("sentence", "line", "paragraph")).alias("cuts_at_sentences"),
    )
