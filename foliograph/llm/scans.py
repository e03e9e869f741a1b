"""Problem 3: noise in text from scanned pages.

Words are counted over all blocks (partial counts before the shuffle) together
with an anagram hash, the sum of a power of each letter. Equal differences of
hashes mean equal changes of letters, so a rare word of scanned blocks meets
the frequent words that a known confusion of characters turns it into by an
equi-join on hash plus difference; a word run into the next meets its two
halves in the same way, as do the halves of a word split in two. The true
alignment of both words confirms a candidate, and the best ranked one (fewest
confusions, then most frequent) is the correction.

Running headers and footers and page numbers are edge lines of pages whose
skeleton (digits, names and case aside) recurs at edges and not within bodies.
A word is cut at a block's end if it and the next block's first word make a
known word, by hyphen evidence if there is a hyphen.

Nothing is collected for a key: blocks are handled by windows over one upload,
which spill, and by joins of words.
"""

from __future__ import annotations

import functools
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import cut
from . import same_looks

# --- Fixed values: characters misread by scanners, and what they stand for. ---
_SINGLE: list[tuple[str, str]] = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("o", "a"), ("a", "o"), ("b", "h"), ("h", "b"), ("v", "y"), ("y", "v"), ("l", "i"), ("i", "l"), ("n", "u"), ("u", "n"), ("q", "g"), ("g", "q"), ("i", "t"),
    ("1", "i"), ("1", "l"), ("l", "1"), ("0", "o"), ("0", "a"), ("4", "a"), ("4", "o"), ("5", "s"), ("s", "5"), ("9", "g"), ("6", "b"), ("8", "b"), ("2", "z"), ("7", "t"), ("3", "e"),
]
_STROKES: list[tuple[str, str]] = [
    ("ri", "n"), ("n", "ri"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("rn", "m"), ("m", "rn"), ("in", "m"), ("m", "in"), ("lvi", "m"), ("tn", "m"), ("vv", "w"), ("w", "vv"), ("lc", "k"), ("k", "lc"), ("lo", "k"),
    ("li", "h"), ("h", "li"), ("l2", "r"), ("i2", "r"), ("nn", "rm"), ("rm", "nn"),
]


def _composed() -> list[tuple[str, str]]:
    """Every confusion, and those of several strokes in which a stroke is itself read as the digit one."""
    digits = [("".join(x), b) for a, b in _STROKES if len(a) > 1 for x in itertools.product(*[(ch, "1") if ch in "il" else (ch,) for ch in a])]
    return list(dict.fromkeys([*_SINGLE, *_STROKES, *digits]))


CONFUSIONS = _composed()
#: How many confusions a word may hold.
MOST = 3
#: A word is rare if it is so many times rarer among words that are no scan, or in scans against its correction.
RATIO = 8
#: A word counts as known from this number of times on outside of scans.
KNOWN_FROM = 3
#: A part of a word that is so many times rarer than the whole is no word by itself, however often it stands in a large corpus.
PART_RATIO = 200
#: The commonest known words are told apart from the rest before joining: at most so many are broadcast.
COMMON_WORDS = 2_000
RUNNING = ("RESPONSIBILITY", "PROFILE_SUMMARY")
HYPHENS = "-¬‐–—_~­"
# --- Fixed values: marks that stand between words. ---
_MARK = r"\s.,;:!?\"()\[\]{}<>|/\\=*#%&+@~_^`´¬·«»\x{2010}-\x{2017}\x{201a}-\x{203a}\x{2190}-\x{27bf}"
_MARKS = rf"[{_MARK}]+"
_AROUND = "-'’"
_PAGE_NUMBER = (
    r"(?i)^[\s\[\](){}~\-–—.|_*]*(?:(?:page|pa[g9q][ec]|seite|se[i1l]te|pagina|página|p|s|pg|pag)\b\.?\s*)?(?:\d{1,3}|[0-9oOlIiSsBz]{1,2}|x{0,3}(?:ix|iv|v?i{0,3}))"
    r"\s*(?:(?:of|o[ft]|von|de|sur|/)\s*[0-9oOlI]{1,3})?[\s\[\](){}~\-–—.|_*]*$"
)
#: Codes count by their lowest bits, so that a fifth power fits.
_CODES = 1023


def anagram_hash(word: Column) -> Column:
    """Sum of the fifth power of each character's code: the same for anagrams, and differences add up."""
    codes = F.transform(F.split(word, ""), lambda ch: F.ascii(ch).bitwiseAND(_CODES).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x * x * x * x * x)


def _hash(word: str) -> int:
    return sum((ord(ch) & _CODES) ** 5 for ch in word)


@functools.lru_cache(maxsize=100_000)
def aligned(wrong: str, right: str, budget: int = MOST) -> int | None:
    """The least number of confusions that turn one word into the other, or None if more than the budget are needed."""
    if wrong == right:
        return 0
    k = 0
    while k < min(len(wrong), len(right)) and wrong[k] == right[k]:
        k += 1
    best = None
    if budget:
        for i in range(max(0, k - 1), k + 1):
            for a, b in CONFUSIONS:
                if wrong.startswith(a, i) and right.startswith(b, i):
                    rest = aligned(wrong[i + len(a) :], right[i + len(b) :], budget - 1)
                    if rest is not None and (best is None or rest + 1 < best):
                        best = rest + 1
    return best


@F.pandas_udf(T.IntegerType())
def _aligned(wrong: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([aligned(a, b) for a, b in zip(wrong, right)], dtype="Int32")


def words_of(text: Column) -> Column:
    """The words of a text in small letters; hyphens and apostrophes within a word belong to it."""
    return F.filter(F.transform(F.split(F.lower(text), _MARKS), lambda w: F.trim(w, F.lit(_AROUND))), lambda w: w != "")


def lines_of(blocks: DataFrame) -> DataFrame:
    """The blocks with text that is not blank, in its one form."""
    order = F.coalesce("reading_order", "line_index")
    rows = blocks.where("text is not null and trim(text) <> ''").select("block_id", "upload_id", "page", order.alias("place"), "block_type", "section", "row_id", "text")
    return same_looks.in_one_form(rows)


def vocabulary(lines: DataFrame) -> DataFrame:
    """word, clean, scanned: how often each word stands outside of scans and in them."""
    # first what stands between blanks is counted, then each distinct piece is taken apart
    pieces = lines.select("ocr", F.explode(F.split("text", " ")).alias("piece")).groupBy("piece").agg(F.count_if(~F.col("ocr")).alias("clean"), F.count_if("ocr").alias("scanned"))
    words = pieces.select("clean", "scanned", F.explode(words_of(F.col("piece"))).alias("word"))
    return words.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned"))


def corrections(words: DataFrame) -> DataFrame:
    """word, right, confusions: the best correction of each rare word of scans that has one.

    ``right`` is a known word, or two with a blank between them for a word run into the next.
    """
    known = words.where(F.col("clean") >= KNOWN_FROM).where(F.length("word") >= 2)
    rare = words.where((F.col("scanned") > 0) & (F.col("clean") * RATIO <= F.col("scanned")) & (F.length("word") >= 3) & F.col("word").rlike(r"\p{L}"))
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(_hash(b) - _hash(a)).cast("long").alias("d")) for a, b in CONFUSIONS])
    fitting = F.transform(F.filter(table, lambda c: F.contains(F.col("word"), c["a"])), lambda c: c["d"])
    once = rare.withColumn("hash", anagram_hash(F.col("word"))).withColumn("d", F.array_distinct(fitting))
    # differences of two and three confusions; the sums are of those that the word can hold
    twice = F.array_distinct(F.flatten(F.transform("d", lambda x: F.transform("d", lambda y: x + y))))
    once = once.withColumn("dd", twice)
    thrice = F.array_distinct(F.flatten(F.transform("dd", lambda x: F.transform("d", lambda y: x + y))))
    shifted = once.select("word", "scanned", "clean", F.explode(F.array_distinct(F.concat("d", "dd", thrice))).alias("diff"), "hash").select("word", "scanned", "clean", (F.col("hash") + F.col("diff")).alias("hash"))
    frequent = known.select(F.col("word").alias("right"), F.col("clean").alias("right_clean"), F.col("scanned").alias("right_scanned"), anagram_hash(F.col("word")).alias("hash"))
    met = shifted.join(frequent, "hash").where("right <> word and right_clean + right_scanned >= {0} * (scanned + clean)".format(RATIO)).select("word", "right", "right_clean").distinct()
    single = met.withColumn("confusions", _aligned("word", "right")).where("confusions is not null")

    # a word run into the next: its halves are known words; their hashes add up to its own
    ends = rare.where(F.length("word") >= 6).select("word", (F.col("clean") + F.col("scanned")).alias("often"), F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("k"))
    halves = ends.select("word", "often", F.substring("word", F.lit(1), F.col("k")).alias("a"), F.expr("substring(word, k + 1)").alias("b"))
    left = known.select(F.col("word").alias("a"), F.col("clean").alias("a_clean"))
    right = known.select(F.col("word").alias("b"), F.col("clean").alias("b_clean"))
    run_on = halves.join(left, "a").join(right, "b").where((F.least("a_clean", "b_clean") >= KNOWN_FROM * RATIO) & (F.least("a_clean", "b_clean") >= F.col("often") * RATIO))
    run_on = run_on.where(~(F.length("a") < 3) | F.col("a").isin("a", "an", "as", "at", "by", "in", "is", "it", "of", "on", "or", "to", "us", "we", "c#")).where(
        ~(F.length("b") < 3) | F.col("b").isin("a", "an", "as", "at", "by", "in", "is", "it", "of", "on", "or", "to", "us", "we")
    )
    double = run_on.select("word", F.concat_ws(" ", "a", "b").alias("right"), F.least("a_clean", "b_clean").alias("right_clean"), F.lit(0).alias("confusions"))
    rank = F.struct(-F.col("confusions"), F.col("right_clean"), F.col("right"))
    return single.unionByName(double).groupBy("word").agg(F.max_by(F.struct("right", "confusions"), rank).alias("best")).select("word", "best.right", "best.confusions")


def skeleton(text: Column) -> Column:
    """A line without what changes from page to page: numbers, a page number at its end, case, and names."""
    line = F.lower(F.trim(text))
    wide = functools.reduce(lambda x, y: x | y, [F.contains(line, F.lit(w)) for w in ("  ", "\t", "\n", "\r", "\f", "\v")])
    bare = F.when(wide, F.regexp_replace(F.regexp_replace(line, r"\s{2,}\S{1,4}$", ""), r"\s+", " ")).otherwise(line)
    return F.regexp_replace(bare, r"\d+", "9")


def margins(scanned: DataFrame) -> DataFrame:
    """block_id of running headers, footers and page numbers, of scanned lines with place and page."""
    # only what the windows need is shuffled: skeletons as hashes
    light = scanned.select(
        "block_id", "upload_id", "page", "place", F.xxhash64(skeleton(F.col("text"))).alias("skeleton"),
        (F.col("text").rlike(_PAGE_NUMBER) & F.col("text").rlike(r"[\p{L}\p{N}]") & ~F.trim("text").rlike(r"^(19|20)\d\d$")).alias("number"),
        F.coalesce(F.col("block_type").isin("UNKNOWN", "PAGE_ARTIFACT"), F.lit(True)).alias("unknown"),
        (F.coalesce(F.col("section"), F.lit("")) == "References").alias("references"),
        F.lower("text").rlike(r"^\W*(refer|rcfer|refcr|ref[e3]r|rel[e3]r)").alias("referee"),
    ).repartition("upload_id")
    page = Window.partitionBy("upload_id", "page")
    down, up = F.row_number().over(page.orderBy("place", "block_id")), F.row_number().over(page.orderBy(F.desc("place"), F.desc("block_id")))
    lines = light.withColumn("edge", (down <= 2) | (up <= 4)).select("block_id", "skeleton", "number", "unknown", "references", "referee", "edge")
    lines = cut(lines)
    # how often lines of a skeleton stand at edges, within bodies, among lines of no known kind and among references
    known = lines.groupBy("skeleton").agg(F.count_if("edge").alias("at_edge"), F.count_if(~F.col("edge")).alias("in_body"), F.count_if("unknown").alias("n_unknown"), F.count_if("references").alias("n_references"))
    candidates = lines.where("edge and unknown").select("block_id", "skeleton", "number", "referee")
    n = F.col("at_edge") + F.col("in_body")
    at_edges, odd = F.col("in_body") * 4 <= F.col("at_edge"), F.col("n_unknown") * 2 >= n
    of_references = (F.col("n_references") * 10 >= n * 9) & F.col("referee")
    sure = candidates.where("number").select("block_id")
    others = candidates.where("not number").join(known, "skeleton").where(~of_references & at_edges & odd).select("block_id")
    return sure.unionByName(others)


def ends_of(scanned: DataFrame) -> DataFrame:
    """Of each line: its first and last word and how it begins and ends; what the search for cut words needs of it."""
    # from both ends inwards, so that no line is read through
    first = F.nullif(F.regexp_extract("text", rf"^[{_MARK}\-'’]*([^{_MARK}]*[^{_MARK}\-'’])", 1), F.lit(""))
    last = F.nullif(F.regexp_extract("back", rf"^[{_MARK}\-'’]*([^{_MARK}]*[^{_MARK}\-'’])", 1), F.lit(""))
    return scanned.withColumn("back", F.reverse("text")).select(
        "block_id", "upload_id", "page", "place", F.xxhash64("text").alias("same"), F.col("row_id").endswith(":layer").alias("layer"),
        F.lower(first).alias("b"), F.lower(F.reverse(last)).alias("a"),
        F.col("back").rlike(rf"^\s*[{HYPHENS}]\p{{L}}").alias("hyphen"), F.col("back").rlike(rf"^\s*[{HYPHENS}] \p{{L}}").alias("apart"), F.col("back").rlike(r"^\s*\p{L}").alias("open"),
        F.col("text").rlike(r"^\p{Ll}").alias("small"), F.col("text").rlike(r"^\p{L}").alias("letter"),
    )


def no_word(n: Column, whole: Column, few: int) -> Column:
    """Is a part that stands n times by itself no word: hardly there at all, or far rarer than the whole?"""
    return (n < few) | (n * PART_RATIO <= whole)


def cut_words(body: DataFrame, words: DataFrame) -> DataFrame:
    """block_id, next_id, first, rest, hyphen of each body line whose last word goes on in the next line.

    ``body`` is ``ends_of`` lines of text bodies, without margins and without rows of a doubled text layer.
    """
    line = Window.partitionBy("upload_id").orderBy("place", "block_id")
    nxt = lambda c: F.lead(c).over(line)
    ends = body.select("block_id", "a", "hyphen", "apart", "open", nxt("block_id").alias("next_id"), nxt("b").alias("b"), nxt("small").alias("small"), nxt("letter").alias("letter"))
    ends = ends.where("a is not null and b is not null and (small and (hyphen or apart or open) or letter and (hyphen or apart))")
    parts = ends.select("block_id", "next_id", (F.col("hyphen") | F.col("apart")).alias("hyphen"), "apart", "small", "a", "b").withColumn("whole", F.concat("a", "b")).withColumn("hyphened", F.concat_ws("-", "a", "b"))

    def counted(frame: DataFrame, column: str, name: str) -> DataFrame:
        return frame.join(words.select(F.col("word").alias(column), F.col("clean").alias(name)), column, "left").fillna(0, [name])

    # only hyphened ends, and those whose join is a known word, go on
    sure = words.where(F.col("clean") >= KNOWN_FROM).select(F.col("word").alias("whole"), F.col("clean").alias("n_whole"))
    parts = parts.join(sure, "whole", "left").where("hyphen or n_whole is not null").fillna(0, ["n_whole"])
    parts = counted(counted(counted(parts, "hyphened", "n_hyphened"), "a", "n_a"), "b", "n_b")
    least = F.least("n_a", "n_b")
    own_hyphen = (F.col("n_hyphened") > 0) & (F.col("n_hyphened") >= F.col("n_whole"))
    with_hyphen = F.col("hyphen") & ~own_hyphen & (~F.col("apart") & F.col("small") | (F.col("n_whole") > 0)) & ((F.col("n_whole") > 0) | no_word(least, F.greatest("n_a", "n_b"), KNOWN_FROM))
    without = ~F.col("hyphen") & (F.col("n_whole") > 0) & (least * RATIO <= F.col("n_whole")) & no_word(least, F.col("n_whole"), KNOWN_FROM * RATIO)
    return parts.where(with_hyphen | without).select("block_id", "next_id", F.col("a").alias("first"), F.col("b").alias("rest"), "hyphen")


def split_words(rare: DataFrame, words: DataFrame) -> DataFrame:
    """block_id, a, b of words split in two within a line: neighbours of which one is no known word and that together are one.

    ``rare`` has block_id, word, before and after of the words that are not among the commonest: one half at least is one of these.
    """
    pairs = rare.select("block_id", F.col("before").alias("a"), F.col("word").alias("b")).unionByName(rare.select("block_id", F.col("word").alias("a"), F.col("after").alias("b"))).where("a is not null and b is not null")
    whole = words.where(F.col("clean") >= KNOWN_FROM).select(F.col("word").alias("whole"), F.col("clean").alias("n_whole"))
    met = pairs.where(F.col("a").rlike(r"^\p{L}+$") & F.col("b").rlike(r"^[\p{L}-]+$")).withColumn("whole", F.concat("a", "b")).join(whole, "whole")
    n_a, n_b = words.select(F.col("word").alias("a"), F.col("clean").alias("n_a")), words.select(F.col("word").alias("b"), F.col("clean").alias("n_b"))
    least = F.least("n_a", "n_b")
    return met.join(n_a, "a").join(n_b, "b").where((least * RATIO <= F.col("n_whole")) & no_word(least, F.col("n_whole"), KNOWN_FROM)).select("block_id", "a", "b").distinct()


def common_words(words: DataFrame) -> DataFrame:
    """The commonest known words, at most COMMON_WORDS: only to keep them out of joins that they have no part in.

    None of them has a correction, as none is rarer outside of scans; two of them next to each other are two words.
    """
    return words.where((F.col("clean") >= KNOWN_FROM * RATIO) & (F.col("clean") * RATIO > F.col("scanned"))).orderBy(F.desc("clean"), "word").limit(COMMON_WORDS).select("word")


class Scans:
    """What problem 3 finds in blocks; each part is a DataFrame."""

    def __init__(self, blocks: DataFrame):
        ocr = F.col("extraction").eqNullSafe("ocr")
        self.scanned = cut(lines_of(blocks.where(ocr)))
        of_scans, others = self.scanned.select(F.lit(True).alias("ocr"), "text"), lines_of(blocks.where(~ocr)).select(F.lit(False).alias("ocr"), "text")
        self.words = cut(vocabulary(of_scans.unionByName(others)))
        self.margins = cut(margins(self.scanned).distinct())
        inner = ends_of(self.scanned).join(self.margins, "block_id", "left_anti")
        # rows of a doubled text layer: the original is the row of the page with the same text beside it
        beside = Window.partitionBy("upload_id").orderBy("place", "layer", "block_id")
        original = F.when(F.col("layer") & (F.lag("same").over(beside) == F.col("same")) & (F.lag("page").over(beside) == F.col("page")), F.lag("block_id").over(beside))
        marked = inner.repartition("upload_id").withColumn("original", original)
        self.inner = cut(marked)
        self.layers = self.inner.where("original is not null").select("block_id", "original")
        self.body = self.inner.where("original is null")
        self.cut_words = cut(cut_words(self.body, self.words))
        self.corrections = cut(corrections(self.words))

    def misread(self) -> DataFrame:
        """block_id, word, right of each misread word in running text; for halves of a split word ``word`` is both of them."""
        running = self.scanned.where(F.col("block_type").isin(*RUNNING)).select("block_id", words_of(F.col("text")).alias("words"))
        placed = running.select("block_id", "words", F.posexplode("words").alias("at", "word"))
        beside = lambda k: F.get("words", F.col("at") + k)
        placed = placed.select("block_id", "at", "word", F.size("words").alias("n"), beside(-1).alias("before"), beside(1).alias("after"))
        rare = cut(placed.join(F.broadcast(common_words(self.words)), "word", "left_anti"))
        wrong = rare.select("block_id", "at", "word", "n").join(self.corrections, "word")
        # the parts of a word cut at a line's end are no words
        firsts = self.cut_words.select("block_id", F.col("first").alias("word"), F.lit(True).alias("is_first"))
        rests = self.cut_words.select(F.col("next_id").alias("block_id"), F.col("rest").alias("word"), F.lit(True).alias("is_rest"))
        wrong = wrong.join(firsts, ["block_id", "word"], "left").join(rests, ["block_id", "word"], "left")
        wrong = wrong.where("not (is_first is not null and at = n - 1) and not (is_rest is not null and at = 0)").select("block_id", "word", "right")
        halves = split_words(rare, self.words).select("block_id", F.concat_ws(" ", "a", "b").alias("word"), F.concat("a", "b").alias("right"))
        return wrong.unionByName(halves).distinct()

    def found(self) -> DataFrame:
        """block_id, kind of margins, cut words and misread words; rows of a doubled text layer have what their originals have."""
        of_body = self.cut_words.select("block_id", F.lit("cut_word").alias("kind")).unionByName(self.misread().select("block_id", F.lit("misread").alias("kind")))
        of_copies = self.layers.join(of_body.withColumnRenamed("block_id", "original"), "original").select("block_id", "kind")
        return self.margins.select("block_id", F.lit("margin").alias("kind")).unionByName(of_body).unionByName(of_copies).distinct()

    def paragraphs(self) -> DataFrame:
        """upload_id, paragraph (from 0), text: the bodies of scanned uploads, repaired."""
        return self._joined(self.scanned.join(self.body.select("block_id"), "block_id", "left_semi"))

    def _joined(self, kept: DataFrame) -> DataFrame:
        """upload_id, paragraph, text of the lines that stay: upload_id, place, text, and block_id and block_type of the block with that text."""
        # block by block: its corrections as a map, applied to its words; a block has few
        fixes = self.misread().groupBy("block_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "right")))).alias("fixes"))
        ends = self.cut_words.select("block_id", F.lit(True).alias("goes_on"), "next_id")
        line = Window.partitionBy("upload_id").orderBy("place", "block_id")
        rows = kept.join(fixes, "block_id", "left").join(ends, "block_id", "left")
        # a word goes on only in the line that it was found to go on in
        rows = rows.withColumn("goes_on", F.col("goes_on") & (F.lead("block_id").over(line) == F.col("next_id")))

        @F.pandas_udf("string")
        def repair(text: pd.Series, fixes: pd.Series) -> pd.Series:
            import re

            out = []
            for t, pairs in zip(text, fixes):
                pairs = () if pairs is None or t is None else pairs
                for wrong, right in sorted(dict(pairs).items(), key=lambda x: -len(x[0])):
                    t = re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", lambda m: right.capitalize() if m[0][:1].isupper() else right, t, flags=re.I)
                out.append(t)
            return pd.Series(out, dtype=object)

        fixed = F.when(F.col("fixes").isNull(), F.col("text")).otherwise(repair("text", "fixes"))
        clean = F.trim(fixed)
        clean = F.when(F.col("goes_on"), F.regexp_replace(clean, rf"\s?[{HYPHENS}]$", "")).otherwise(F.concat(clean, F.lit(" ")))
        continued = F.coalesce(F.lag("goes_on").over(line), F.lit(False)) | (
            F.col("block_type").isin(*RUNNING) & (F.lag("block_type").over(line) == F.col("block_type")) & F.col("text").rlike(r"^[\p{Ll}\p{N}(]") & ~F.lag("text").over(line).rlike(r"[.!?:]\s*$")
        ) | ((F.col("block_type") == "PROFILE_SUMMARY") & (F.lag("block_type").over(line) == "PROFILE_SUMMARY"))
        marked = rows.select("upload_id", "place", "block_id", clean.alias("piece"), F.when(continued, 0).otherwise(1).alias("opens"))
        numbered = marked.withColumn("paragraph", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
        pieces = numbered.groupBy("upload_id", "paragraph").agg(F.sort_array(F.collect_list(F.struct("place", "block_id", "piece"))).alias("pieces"))
        return pieces.select("upload_id", "paragraph", F.trim(F.array_join(F.transform("pieces", lambda p: p["piece"]), "")).alias("text"))


def found(blocks: DataFrame) -> DataFrame:
    return Scans(blocks).found()


def raw_repaired(raw_text: DataFrame, blocks: DataFrame) -> DataFrame:
    """upload_id, paragraph, text of the raw texts of scanned uploads: lines that are margins of the upload's pages left out, the rest as ``paragraphs``.

    A raw text of a scanned upload holds the lines of its blocks; its lines take the decisions on the block with the same text and rank.
    A line without such a block stays as it is, as a paragraph of its own.
    """
    scans = Scans(blocks)
    texts = raw_text.where("raw_text is not null").join(scans.scanned.select("upload_id").distinct(), "upload_id", "left_semi")
    lines = texts.select("upload_id", F.posexplode(F.split(same_looks.one_form(F.col("raw_text")), r"\r\n?|[\n\f]+")).alias("place", "text")).where("trim(text) <> ''")

    def ranked(frame: DataFrame, *by: str) -> DataFrame:
        same = frame.withColumn("same", F.xxhash64(F.regexp_replace("text", r"^\s+|\s+$", "")))
        return same.withColumn("nth", F.row_number().over(Window.partitionBy("upload_id", "same").orderBy(*by)))

    of_blocks = ranked(scans.scanned, "place", "block_id").select("upload_id", "same", "nth", "block_id", "block_type")
    kept = of_blocks.join(scans.body.select("block_id", F.lit(True).alias("body")), "block_id", "left")
    rows = ranked(lines, "place").join(kept, ["upload_id", "same", "nth"], "left").where("block_id is null or body")
    return scans._joined(rows.select("upload_id", "place", "text", "block_id", "block_type"))
