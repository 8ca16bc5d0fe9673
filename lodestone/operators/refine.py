"""Query refinement (T13, R1-R6): spelling, synonyms, suggestions and history, for batches of queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import stemmed_tokens, tokens, words
from lodestone.operators.index import Index


SHORT = 24  # letters up to which a word is matched by what deletions leave; longer ones by unchanged segments
_SEGMENTS = 5  # two edits touch at most four of them


def _shorter(word: str, n: int) -> set[str]:
    """The word and what is left of it after up to n deletions."""
    level, out = {word}, {word}
    for _ in range(n):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


def _segments(n: int) -> list[tuple[int, int]]:
    return [(n * i // _SEGMENTS, n * (i + 1) // _SEGMENTS) for i in range(_SEGMENTS)]


def asked_keys(word: str) -> list[str]:
    """Keys of which a word shares one with every dictionary word (see ``known_keys``) up to two edits away."""
    if len(word) <= SHORT:
        return sorted(_shorter(word, 2))
    n = len(word)
    return sorted({f"{m}:{i}:{word[a + s : b + s]}" for m in range(n - 2, n + 3) for i, (a, b) in enumerate(_segments(m)) for s in range(-2, 3) if a + s >= 0 and b + s <= n})


def known_keys(word: str) -> list[str]:
    n = len(word)
    out = list(_shorter(word, 2)) if n <= SHORT + 2 else []
    return out + ([f"{n}:{i}:{word[a:b]}" for i, (a, b) in enumerate(_segments(n))] if n > SHORT - 2 else [])


def within(a: str, b: str, most: int) -> bool:
    """Whether ``most`` edits lead from a to b: what both begin and end with is left out, then each edit is tried where they
    begin to differ, from either side."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a and not b:
        return True
    if most == 0 or abs(len(a) - len(b)) > most:
        return False
    tries = [(a[1:], b), (a, b[1:]), (a[1:], b[1:])] if a and b else [(a[1:], b[1:])]
    tries += [(a[1] + a[0] + a[2:], b)] if len(a) > 1 else []
    tries += [(a, b[1] + b[0] + b[2:])] if len(b) > 1 else []
    return any(within(x, y, most - 1) for x, y in tries)


def candidates(asked: DataFrame, dictionary: DataFrame, df_of: DataFrame, stemmer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(word, cand, d): dictionary words one or two edits (d) away from each word (column word) that isn't in the dictionary, has
    more than three letters and a stem of df 0.

    Words are matched by what both leave after up to two deletions, long ones by segments that two edits can't all touch, so
    no list of all strings two edits away is made.
    """
    dictionary = dictionary.select(F.lower("word").alias("cand")).where("cand rlike '^[a-z]+$'").distinct()
    open_ = asked.select(F.lower("word").alias("word")).distinct().where("length(word) > 3").join(dictionary, F.col("word") == F.col("cand"), "left_anti")
    open_ = _with_df(open_, "word", df_of, stemmer).where("df = 0").select("word")

    @F.pandas_udf("array<string>")
    def left_keys(s: pd.Series) -> pd.Series:
        return s.map(asked_keys)

    @F.pandas_udf("array<string>")
    def right_keys(s: pd.Series) -> pd.Series:
        return s.map(known_keys)

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1 if within(x, y, 1) else 2 if within(x, y, 2) else 3 for x, y in zip(a, b)])

    left = open_.select("word", F.explode(left_keys("word")).alias("part"))
    right = dictionary.select("cand", F.explode(right_keys("cand")).alias("part"))
    pairs = left.join(right, "part").where(F.abs(F.length("word") - F.length("cand")) <= 2).select("word", "cand").distinct()
    # most pairs differ by the JVM's own count of edits; a swap of neighbours counts two there, so two swaps count four
    pairs = pairs.where(F.levenshtein("word", "cand", 4) >= 0)
    return pairs.withColumn("d", distance("word", "cand")).where("d <= 2")


def _with_df(d: DataFrame, c: str, df_of: DataFrame, stemmer: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    terms = d.withColumn("term", F.col(c))
    return (stemmer(terms) if stemmer else terms).join(df_of.select("term", "df"), "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).drop("term")


def corrections(asked: DataFrame, dictionary: DataFrame, df_of: DataFrame, stemmer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(word, best) for words (column word) that have a correction.

    Of the ``candidates`` one edit away, else of those two away, the one with the greatest df of its stem wins (ties: first by
    letters), if that is > 0. df_of is (term, df); stemmer maps the column term, by default not at all.
    """
    near = candidates(asked, dictionary, df_of, stemmer)
    nearest = near.withColumn("m", F.min("d").over(Window.partitionBy("word"))).where("d = m")
    order = Window.partitionBy("word").orderBy(F.col("df").desc(), "cand")
    return _with_df(nearest, "cand", df_of, stemmer).withColumn("i", F.row_number().over(order)).where("i = 1 and df > 0").select("word", F.col("cand").alias("best"))


def correct_queries(queries: DataFrame, fixes: DataFrame) -> DataFrame:
    """R2: (qid, text, corrected, corrections): each word replaced in place, other characters kept; the map is keyed by the
    spelling in the query."""
    parts = queries.select("qid", "text", F.posexplode(F.regexp_extract_all("text", F.lit("([a-zA-Z]+|[^a-zA-Z]+)"), F.lit(1))).alias("pos", "part"))
    got = parts.join(fixes.withColumnRenamed("word", "low"), F.lower("part") == F.col("low"), "left").withColumn("best", F.when(F.col("best") != F.lower("part"), F.col("best")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("best", "part").alias("s")))), lambda x: x["s"]), "")
    changed = F.array_distinct(F.collect_list(F.when(F.col("best").isNotNull(), F.struct("part", "best"))))
    done = got.groupBy("qid").agg(whole.alias("corrected"), F.map_from_entries(F.array_sort(changed)).alias("corrections"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return queries.select("qid", "text").join(done, "qid", "left").select("qid", "text", F.coalesce("corrected", "text").alias("corrected"), F.coalesce("corrections", none).alias("corrections"))


def _analysed(rows: DataFrame, text: str, stemmer: Callable[[DataFrame], DataFrame] | None, analyse: Callable[[Column], Column]) -> DataFrame:
    """Adds ``tokens``, made of the column ``text`` as the index's terms are."""
    rows = rows.withColumn("tokens", analyse(F.col(text)))
    return stemmed_tokens(rows, stemmer) if stemmer else rows


def expand(queries: DataFrame, synonyms: DataFrame, df_of: DataFrame, most_per_word: int = 1, stemmer: Callable[[DataFrame], DataFrame] | None = None,
           analyse: Callable[[Column], Column] = tokens) -> DataFrame:
    """(qid, expansions array, stems array): synonyms of each word's first sense, in the order of the words.

    synonyms is (word, sense, pos, lemma). Skipped: several words, the word itself, stems of the query or of an expansion
    already taken, and stems with df 0. At most ``most_per_word`` for each word.
    """
    stem_of = stemmer or (lambda d: d)
    base = queries.select("qid", analyse(F.col("text")).alias("toks"), words(F.lower("text")).alias("ws"))
    own = stem_of(base.select("qid", F.explode("toks").alias("term"))).groupBy("qid").agg(F.collect_set("term").alias("own"))
    first = synonyms.join(synonyms.groupBy("word").agg(F.min("sense").alias("sense")), ["word", "sense"])
    cands = base.select("qid", F.posexplode("ws").alias("at", "word")).join(first, "word").select("qid", "at", "word", F.col("pos").alias("no"), F.lower(F.replace("lemma", F.lit("_"), F.lit(" "))).alias("cand"))
    cands = stem_of(cands.where("not contains(cand, ' ') and cand <> word").withColumn("term", F.col("cand"))).join(df_of.where("df > 0").select("term"), "term", "left_semi")
    rows = cands.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("at", "no", "cand", F.col("term").alias("stem")))).alias("c"))
    rows = rows.join(own, "qid", "left").withColumn("own", F.coalesce("own", F.array().cast("array<string>")))

    def take(taken: Column, x: Column) -> Column:
        known = F.array_contains("own", x["stem"]) | F.exists(taken, lambda y: y["stem"] == x["stem"])
        full = F.size(F.filter(taken, lambda y: y["at"] == x["at"])) >= most_per_word
        return F.when(known | full, taken).otherwise(F.array_append(taken, x))

    taken = rows.select("qid", F.aggregate("c", F.slice("c", 1, 0), take).alias("t"))
    return taken.select("qid", F.col("t.cand").alias("expansions"), F.col("t.stem").alias("stems"))


def history_terms(queries: DataFrame, history: DataFrame, df_of: DataFrame, most: int = 3, stemmer: Callable[[DataFrame], DataFrame] | None = None,
                  analyse: Callable[[Column], Column] = tokens) -> DataFrame:
    """(qid, pos, term): up to ``most`` new terms of past queries that share a token, the latest query first.
    history is (qid, pos, query), pos rising with time. Terms are made of texts as those of the index are."""
    own = _analysed(queries.select("qid", "text"), "text", stemmer, analyse).select("qid", F.array_distinct("tokens").alias("own"))
    past = _analysed(history.select("qid", F.col("pos").alias("past"), "query"), "query", stemmer, analyse).select("qid", "past", F.col("tokens").alias("toks"))
    past = past.join(own, "qid").where(F.arrays_overlap("own", "toks"))
    rows = past.select("qid", "past", "own", F.posexplode("toks").alias("i", "term")).where("not array_contains(own, term)").join(df_of.where("df > 0").select("term"), "term", "left_semi")
    first = rows.groupBy("qid", "term").agg(F.min(F.struct((-F.col("past")).alias("p"), "i")).alias("f"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("f"))).where(F.col("pos") <= most).select("qid", "pos", "term")


def suggest(queries: DataFrame, history: DataFrame, terms: DataFrame, limit: int = 5, stemmer: Callable[[DataFrame], DataFrame] | None = None,
            analyse: Callable[[Column], Column] = tokens) -> DataFrame:
    """(qid, pos, suggestion): past queries that share a token, in their order, then the last word completed by terms
    (term, df) with it (its stem, with a stemmer) as prefix, by df downwards; repeats dropped, the first ``limit``."""
    base = _analysed(queries.select("qid", "text"), "text", stemmer, analyse).select("qid", "text", F.array_distinct("tokens").alias("own"), words(F.lower("text")).alias("ws"))
    past = _analysed(history.select("qid", "pos", "query"), "query", stemmer, analyse).join(base, "qid")
    past = past.where(F.arrays_overlap("own", "tokens") & (F.lower(F.trim("query")) != F.lower(F.trim("text"))))
    past = past.select("qid", F.lit(0).alias("kind"), F.col("pos").cast("long").alias("at"), F.col("query").alias("suggestion"))
    last = base.where("size(ws) > 0").select("qid", "text", "ws", F.element_at("ws", -1).alias("term"))
    last = (stemmer(last) if stemmer else last).select("qid", "text", "ws", F.col("term").alias("prefix"))
    prefixes = last.select("prefix").distinct()
    # terms meet prefixes by equality: each term once per length up to the longest prefix asked for
    longest = F.coalesce(prefixes.agg(F.max(F.length("prefix"))).scalar(), F.lit(0))
    starts = terms.select("term", "df", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("term"), longest)))).alias("n")).select("term", "df", F.expr("substring(term, 1, n)").alias("prefix"))
    order = Window.partitionBy("prefix").orderBy(F.col("df").desc(), "term")
    best = starts.join(prefixes, "prefix", "left_semi").withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit)
    done = last.join(best, "prefix").select("qid", F.lit(1).alias("kind"), F.col("at").cast("long").alias("at"), F.array_join(F.concat(F.slice("ws", 1, F.size("ws") - 1), F.array("term")), " ").alias("suggestion"), "text")
    done = done.where(F.col("suggestion") != F.lower("text")).drop("text")
    first = past.unionByName(done).groupBy("qid", "suggestion").agg(F.min(F.struct("kind", "at")).alias("f"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("f"))).where(F.col("pos") <= limit).select("qid", "pos", "suggestion")


def refine(queries: DataFrame, index: Index, dictionary: DataFrame, synonyms: DataFrame, history: DataFrame | None = None, spell: bool = True, use_synonyms: bool = True,
           use_history: bool = True, stemmer: Callable[[DataFrame], DataFrame] | None = None, analyse: Callable[[Column], Column] = tokens) -> DataFrame:
    """(qid, text, corrected, tokens, exp_terms, hist_terms). Dense models get ``corrected``; lexical ones get tokens: the
    corrected query's, then the expansion stems, then history terms."""
    asked = queries.select(F.explode(words(F.col("text"))).alias("word"))
    empty = F.array().cast("array<string>")
    if spell:
        fixed = correct_queries(queries, corrections(asked, dictionary, index.terms, stemmer)).select("qid", "text", "corrected")
    else:
        fixed = queries.select("qid", "text", F.col("text").alias("corrected"))
    now = fixed.select("qid", F.col("corrected").alias("text"))
    out = fixed
    if use_synonyms:
        out = out.join(expand(now, synonyms, index.terms, stemmer=stemmer, analyse=analyse).select("qid", F.col("stems").alias("exp_terms")), "qid", "left")
    else:
        out = out.withColumn("exp_terms", empty)
    if use_history and history is not None:
        got = history_terms(now, history, index.terms, stemmer=stemmer, analyse=analyse).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("hist_terms"))
        out = out.join(got, "qid", "left")
    else:
        out = out.withColumn("hist_terms", empty)
    out = _analysed(out, "corrected", stemmer, analyse).withColumnRenamed("tokens", "own")
    return out.select("qid", "text", "corrected", F.concat("own", F.coalesce("exp_terms", empty), F.coalesce("hist_terms", empty)).alias("tokens"),
                      F.coalesce("exp_terms", empty).alias("exp_terms"), F.coalesce("hist_terms", empty).alias("hist_terms"))
