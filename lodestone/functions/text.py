"""Text functions (T1-T17) as column expressions; only stemming needs Python."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.porter import stem_word

PUNCTUATION = r"[!-/:-@\[-`{-~]"  # the 32 ASCII marks: deleted, not replaced by a space
SPACE = r"[\s\x0B\x{85}\p{Z}]+"
LETTERS = r"^\p{L}+$"
# English stop words (fixed values): the public default English list of Spark ML, without its contractions.
STOP_WORDS = tuple(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because "
    "as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further "
    "then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don "
    "should now cannot could ought would".split())


def tokens(text: Column, lowercase: bool = True, remove_punctuation: bool = True, stop_words: tuple[str, ...] | None = None) -> Column:
    """Lower case, punctuation deleted, split at blanks, tokens with anything but letters dropped whole, stop words dropped.
    A null or empty text gives an empty array."""
    t = F.lower(text) if lowercase else text
    t = F.regexp_replace(t, PUNCTUATION, "") if remove_punctuation else t
    parts = F.filter(F.split(t, SPACE), lambda w: w.rlike(LETTERS))
    if stop_words:
        parts = F.filter(parts, lambda w: ~w.isin(list(stop_words)))
    return F.coalesce(parts, F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def stem(words: pd.Series) -> pd.Series:
    """The Porter stem of each word."""
    known = {w: stem_word(w) for w in words.dropna().unique()}
    return words.map(known)


def stemmed(rows: DataFrame, col: str = "term") -> DataFrame:
    """Stems a column of words: each distinct word once, then joined back. A null stays null."""
    words = rows.select(F.col(col).alias("__w")).where("__w is not null").distinct().withColumn("__s", stem("__w"))
    return rows.join(words, F.col(col) == F.col("__w"), "left").withColumn(col, F.col("__s")).drop("__w", "__s")


def stemmed_tokens(rows: DataFrame, stemmer: Callable[[DataFrame], DataFrame] = stemmed) -> DataFrame:
    """Stems the column ``tokens`` in place, in order; ``stemmer`` maps a column ``term``. Equal arrays are stemmed once."""
    each = stemmer(rows.select("tokens").distinct().select("tokens", F.posexplode("tokens").alias("__i", "term")))
    lists = each.groupBy("tokens").agg(F.array_sort(F.collect_list(F.struct("__i", "term"))).alias("__s"))
    stems = F.coalesce(F.transform("__s", lambda x: x["term"]), F.col("tokens"))
    return rows.join(lists, "tokens", "left").withColumn("tokens", stems).select(rows.columns)


@dataclass(frozen=True)
class Analyser:
    """How texts become terms, kept with an index so that its queries are treated alike: lower case, punctuation deleted, split,
    words of letters only, stop words, stems, in that order."""

    lowercase: bool = True
    remove_punctuation: bool = True
    stop_words: tuple[str, ...] = ()
    stem: bool = False

    def tokens(self, text: Column) -> Column:
        return tokens(text, self.lowercase, self.remove_punctuation, self.stop_words or None)

    @property
    def stemmer(self) -> Callable[[DataFrame], DataFrame] | None:
        return stemmed if self.stem else None

    def add(self, rows: DataFrame, text: str) -> DataFrame:
        """Rows with a column ``tokens`` made of the column ``text``."""
        rows = rows.withColumn("tokens", self.tokens(F.col(text)))
        return stemmed_tokens(rows) if self.stem else rows

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str | None) -> Analyser:
        got = json.loads(text) if text else {}
        return cls(**{**got, "stop_words": tuple(got.get("stop_words", ()))})


STANDARD = Analyser(stop_words=STOP_WORDS, stem=True)  # the usual treatment of documents and queries


def preprocessed(rows: DataFrame, text: str, lexicon: DataFrame | None = None, common: DataFrame | None = None, analyser: Analyser = Analyser(stop_words=STOP_WORDS)) -> DataFrame:
    """T9, T10 (with ``STANDARD``): rows with lang, tokens and pos_tags.

    lang is the language of ``common`` (lang, word) of which most words of the text are common words (ties: the first by name), null
    where none is; ``lexicon`` (form, pos) gives the tag of each token before stemming, by default NN. Without these tables lang and
    pos_tags are null. No text gives no tokens.
    """
    bare = Analyser(analyser.lowercase, analyser.remove_punctuation, analyser.stop_words)
    rows = bare.add(rows.withColumn("__id", F.xxhash64(text)), text).withColumn("__words", tokens(F.col(text)))
    each = rows.select("__id", "__words", F.col("tokens").alias("__t")).dropDuplicates(["__id"])
    if common is None:
        rows = rows.withColumn("lang", F.lit(None).cast("string"))
    else:
        known = common.where("lang is not null and word is not null").select(F.lower("lang").alias("lang"), F.lower("word").alias("w")).distinct()
        hits = each.select("__id", F.explode("__words").alias("w")).join(known, "w").groupBy("__id", "lang").agg(F.count(F.lit(1)).alias("n"))
        best = hits.groupBy("__id").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("b")).select("__id", F.col("b.lang").alias("lang"))
        rows = rows.join(best, "__id", "left")
    if lexicon is None:
        rows = rows.withColumn("pos_tags", F.lit(None).cast("array<string>"))
    else:
        one = lexicon.groupBy(F.col("form").alias("w")).agg(F.min("pos").alias("pos"))
        tagged = each.select("__id", F.posexplode("__t").alias("i", "w")).join(one, "w", "left").withColumn("pos", F.coalesce("pos", F.lit("NN")))
        tags = tagged.groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "pos"))), lambda x: x["pos"]).alias("pos_tags"))
        rows = rows.join(tags, "__id", "left").withColumn("pos_tags", F.coalesce("pos_tags", F.array().cast("array<string>")))
    rows = rows.drop("__id", "__words")
    return stemmed_tokens(rows) if analyser.stem else rows


def lemmatised(rows: DataFrame, lemmas: DataFrame, col: str = "term", pos: str = "pos") -> DataFrame:
    """The lemma of (form, pos) from a table (form, pos, lemma) unique per (form, pos); a form that isn't in it stays.
    Tags: J, N, V and R in front give a, n, v and r; any other is a noun."""
    kind = F.substring(F.coalesce(F.col(pos), F.lit("")), 1, 1)
    code = F.when(kind == "J", "a").when(kind == "V", "v").when(kind == "R", "r").otherwise("n")
    table = lemmas.select(F.col("form").alias("__f"), F.col("pos").alias("__p"), F.col("lemma").alias("__l"))
    got = rows.withColumn("__code", code).join(table, (F.col(col) == F.col("__f")) & (F.col("__code") == F.col("__p")), "left")
    return got.withColumn(col, F.coalesce("__l", col)).drop("__f", "__p", "__l", "__code")


def words(text: Column) -> Column:
    """Runs of a-z and A-Z."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("([a-zA-Z]+)"), F.lit(1)), F.array().cast("array<string>"))


def snippet(text: Column, limit: int | None = 600) -> Column:
    """The first ``limit`` characters with an ellipsis if there are more, HTML-escaped, with line ends as <br>."""
    cut = text if limit is None else F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)
    safe = cut
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    return F.when((text.isNull()) | (text == ""), F.lit("<em>(this document has no text)</em>")).otherwise(safe)


def highlighted(safe: Column, terms: Column) -> Column:
    """Whole words of the array ``terms`` (two letters or more, longest first) marked in an escaped text, whatever their case.
    All are looked for at once, so no mark falls inside a mark, and entities and tags of the escaping are left alone."""
    usable = F.array_distinct(F.filter(terms, lambda w: F.length(w) >= 2))
    by_length = F.transform(F.array_sort(F.transform(usable, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), lambda x: F.concat(F.lit(r"\Q"), x["w"], F.lit(r"\E")))
    pattern = F.concat(F.lit(r"(?i)(?<![&<])(?<!&#)\b("), F.array_join(by_length, "|"), F.lit(r")\b"))
    return F.when(F.size(usable) > 0, F.regexp_replace(safe, pattern, F.lit("<mark>$1</mark>"))).otherwise(safe)


def highlight_terms(query: Column, expansions: Column, corrections: Column) -> Column:
    """Words of the query, of the expansions and the corrected words."""
    return F.concat(words(query), F.flatten(F.transform(expansions, lambda e: F.split(e, SPACE))), F.map_values(corrections))


def score_bar(score: Column, largest: Column) -> Column:
    """|score| in percent of the largest |score| (1 if that is 0), between 2 and 100."""
    return F.greatest(F.lit(2.0), F.least(F.lit(100.0), F.abs(score) / F.when(largest == 0, 1.0).otherwise(largest) * 100))


def percent_change(before: Column, after: Column) -> Column:
    """(after - before) / before in percent, 0 if before is 0."""
    return F.when(before == 0, 0.0).otherwise((after - before) / before * 100)
