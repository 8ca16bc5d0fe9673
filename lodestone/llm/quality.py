"""Problem 10: text statistics per document, and boosted trees that tell natural prose from lists, tables and junk.

The trees learn from weak labels that owe nothing to the five signs or their limits: texts whose form is that of a table, list,
menu, code, encoded data or spam are junk, texts of sentences are prose, and each prose sample also comes in spoilt versions
(cut short, made a list, sprinkled with symbols, with letters mixed, words glued or taken apart), which are junk too.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.holdout import HELD, HOLDOUT
from lodestone.session import spread
from lodestone.sources.tables import table

FEATURES = ("n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_share")
TRAIN_ROWS = 20_000  # bound of the sample that the trees are fitted on
MAX_COMMON_WORDS = 100_000  # bound of the word list that reaches every task
MARGIN = 0.04  # share of the least probability of a junk text of the holdout from which a document is looked at
_BLANKS = " \t\n\r"


def text_stats(docs: DataFrame, common: list[str], text_col: str = "text") -> DataFrame:
    """Adds FEATURES to rows with a text; shares and means are 0 where there is nothing to divide by.

    A null text gives no row, an empty or blank one zeros. All of each text counts. Columns of the same names are replaced.
    """
    # Each step is used more than once by the next, so the optimizer keeps them apart and nothing is computed twice.
    t, keep = F.col(text_col), [c for c in docs.columns if c not in FEATURES]
    blanks = "[ \t\n\r]+"
    parts = docs.where(t.isNotNull()).select(
        *keep, t.alias("__text"), F.array_remove(F.split(t, blanks), "").alias("__words"),
        F.array_remove(F.transform(F.split(t, "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), "").alias("__lines"))
    letters = F.split(F.regexp_replace(F.lower("__text"), "[^\\p{L} \t\n\r]+", ""), blanks)
    known = F.size(F.filter(letters, lambda w: w.isin(common))) if common else F.lit(0)
    counts = parts.select(
        *keep, F.length(F.array_join("__words", "")).alias("__chars"), F.length(F.regexp_replace("__text", "[\\p{L}\\p{N} \t\n\r]+", "")).alias("__symbols"), F.size("__words").alias("n_words"),
        F.size("__lines").alias("__n_lines"), F.size(F.filter("__lines", lambda x: F.substring(x, -1, 1).isin(".", "!", "?"))).alias("__ended"), known.alias("__known"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return counts.select(
        *keep, "n_words", share("__chars", "n_words").alias("mean_word_length"), share("__symbols", "__chars").alias("symbol_ratio"),
        share("__ended", "__n_lines").alias("line_end_share"), share("__known", "n_words").alias("common_share"))


def stats_of(text: str, common: set[str]) -> tuple:
    """The same statistics of one text, in plain Python."""
    words = [w for w in re.split("[ \t\n\r]+", text) if w]
    solid = "".join(words)
    kinds = [unicodedata.category(c)[0] for c in solid]
    lines = [x for x in (y.strip(" \t\r") for y in text.split("\n")) if x]
    known = sum("".join(c for c in w.lower() if unicodedata.category(c)[0] == "L") in common for w in words)
    div = lambda a, b: a / b if b else 0.0
    return (len(words), div(len(solid), len(words)), div(sum(k not in "LN" for k in kinds), len(solid)), div(sum(x[-1] in ".!?" for x in lines), len(lines)), div(known, len(words)))


def signs(x) -> np.ndarray:
    """How many of the five signs (fixed values) each row of FEATURES shows; two or more make a case."""
    n, length, symbol, line, common = np.asarray(x, float).reshape(-1, 5).T
    return (n < 20).astype(int) + ((length < 3) | (length > 8)) + (symbol > 0.12) + (line < 0.5) + (common < 0.2)


class BoostedTrees:
    """Gradient-boosted trees for two classes: Newton steps on the logistic loss, splits at quantiles of the sample, and
    probabilities calibrated on a holdout (Platt's sigmoid)."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, splits: int = 32):
        self.rounds, self.depth, self.rate, self.ridge, self.splits = rounds, depth, rate, ridge, splits
        self.trees: list[list[tuple[tuple[int, float] | None, float]]] = []
        self.base, self.scale, self.shift, self.gate = 0.0, 1.0, 0.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        self.base = float(np.log(p / (1 - p)))
        splits = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.splits + 1)[1:])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        masks = [x[:, j] < s[:, None] for j, s in enumerate(splits)]
        masks = [m.astype(np.float32) for m in masks]
        f = np.full(len(x), self.base)
        for _ in range(self.rounds if len(x) else 0):
            p = 1 / (1 + np.exp(-f))
            grad, hess = y - p, p * (1 - p)
            nodes, leaf = [None] * (2 ** (self.depth + 1)), np.ones(len(x), int)
            for node in range(1, 2**self.depth):
                at = leaf == node
                both = np.stack([grad * at, hess * at], 1).astype(np.float32)
                total_g, total_h = both.sum(0)
                best = (1e-9, 0, 0)
                for j, m in enumerate(masks):
                    gl, hl = (m @ both).T
                    gain = gl**2 / (hl + self.ridge) + (total_g - gl) ** 2 / (total_h - hl + self.ridge) - total_g**2 / (total_h + self.ridge)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
                if best[0] <= 1e-9:
                    continue
                _, j, k = best
                nodes[node] = (j, float(splits[j][k]))
                leaf = np.where(at, np.where(masks[j][k] > 0, 2 * node, 2 * node + 1), leaf)
            sums_g, sums_h = np.bincount(leaf, grad, 2 ** (self.depth + 1)), np.bincount(leaf, hess, 2 ** (self.depth + 1))
            values = self.rate * sums_g / (sums_h + self.ridge)
            self.trees.append([(n, float(v)) for n, v in zip(nodes, values)])
            f += values[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for tree in self.trees:
            leaf = np.ones(len(x), int)
            for node, (split, _) in enumerate(tree):
                if split is not None:
                    j, cut = split
                    leaf = np.where(leaf == node, np.where(x[:, j] < cut, 2 * node, 2 * node + 1), leaf)
            f += np.array([v for _, v in tree])[leaf]
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        f, up, down = self.margin(x), y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        f = f / (spread := max(1.0, float(np.abs(f).max(initial=0))))

        def loss(a: float, b: float) -> float:
            z = a * f + b
            return float((np.logaddexp(0, z) - target * z).sum() + 5e-4 * a * a)

        a, b = 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * f + b, -50, 50)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - target) * f).sum() + 1e-3 * a, (p - target).sum()])
            h = np.array([[(w * f * f).sum() + 1e-3, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-9]])
            step, scale = np.linalg.solve(h, g), 1.0
            while scale > 1e-6 and loss(a - scale * step[0], b - scale * step[1]) > loss(a, b):
                scale /= 2
            a, b = a - scale * step[0], b - scale * step[1]
        a = a / spread
        self.scale, self.shift = float(max(a, 1e-3)), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.margin(x) + self.shift)))


def common_words(words: DataFrame) -> list[str]:
    got = [r[0] for r in words.select(F.lower("word")).where("word is not null and word <> ''").distinct().limit(MAX_COMMON_WORDS + 1).collect()]
    if len(got) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    return sorted(got)


def with_form(docs: DataFrame) -> DataFrame:
    """Adds ``label`` to rows with a ``text``, the weak label by its form: 1 for tables, lists, menus, code, encoded data, symbols and
    spam, 0 for sentences, null where the form doesn't tell. Sentences repeat some word: a text in which none comes twice
    isn't taken for prose."""
    t = F.col("text")
    staged = docs.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(_BLANKS)) != "")).withColumn("__words", F.array_remove(F.split(t, "[ \t\n\r]+"), ""))
    how_many = lambda test: F.size(F.filter("__lines", test))
    counted = staged.withColumn("__n", F.size("__words")).withColumn("__distinct", F.size(F.array_distinct("__words"))).withColumn("__most", F.size("__lines") * 0.6)
    cells = how_many(lambda x: x.rlike("[|;\t].*[|;\t]"))
    entries = how_many(lambda x: x.rlike(r"^\s*(?:[-*+•]|\d+[.)]|\w+:)") & (F.size(F.split(x, " ")) < 7))
    marks, long = F.length(t) - F.length(F.translate(t, ">·|»", "")), F.size(F.filter("__words", lambda w: F.length(w) >= 60))
    n, distinct = F.col("__n"), F.col("__distinct")
    junk = ((cells > F.col("__most")) | (entries > F.col("__most")) | (how_many(lambda x: x.rlike("[{}<>=]")) > F.col("__most")) | (marks * 3 > n) | (long * 4 > n)
            | (F.length(F.regexp_replace(t, r"\P{L}+", "")) * 2 < F.length(t)) | (distinct * 3 < n))
    labelled = counted.withColumn("__junk", junk).withColumn("__ends", F.regexp_count(t, F.lit(r"\p{L}[.!?…][\"')\]”]*(?:\s|$)")))
    ends = F.col("__ends")
    prose = (distinct < n) & (ends >= 1) & (n <= 60 * ends) & (n >= 8 * ends)
    return labelled.select(*docs.columns, F.when(F.col("__junk"), 1).when(prose, 0).alias("label"))


def spoilt(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """FEATURES of prose as they would be after one to three kinds of damage, from slight to total."""
    out, n = x.copy(), len(x)
    down, up = (lambda most: rng.uniform(0, most, n)), (lambda a, b: rng.uniform(a, b, n))
    damage = [
        {0: np.floor(out[:, 0] * down(0.2))},  # cut short
        {3: out[:, 3] * down(0.7)},  # lines without an end
        {2: out[:, 2] + up(0.04, 0.8)},  # symbols
        {4: out[:, 4] * down(0.7)},  # letters mixed, other words
        {1: out[:, 1] * up(1.4, 5), 4: out[:, 4] * down(0.7)},  # words glued
        {1: out[:, 1] * up(0.15, 0.75), 4: out[:, 4] * down(0.9)},  # words taken apart
    ]
    kinds = rng.random((n, len(damage))).argsort(1)[:, :3]
    many = rng.integers(1, 4, n)
    for k, columns in enumerate(damage):
        hit = ((kinds == k) & (np.arange(3) < many[:, None])).any(1)
        for j, values in columns.items():
            out[hit, j] = values[hit]
    return out


def train_on(x: np.ndarray, label: np.ndarray, common: set[str], seed: int = 5) -> BoostedTrees:
    """Trees fitted on weakly labelled statistics and spoilt prose, calibrated on the holdout, with a gate: the probability from
    which a document is looked at, MARGIN of the least one of a junk text of the holdout, so that none of those is lost."""
    prose = x[label == 0]
    bad = np.concatenate([x[label == 1], spoilt(prose, np.random.default_rng(seed))])
    model = BoostedTrees().fit(np.concatenate([prose, bad]), np.repeat([0.0, 1.0], [len(prose), len(bad)]))
    held = np.array([stats_of(t, common) for t, _ in HOLDOUT] + [h[:5] for h in HELD], float)
    y = np.array([j for _, j in HOLDOUT] + [h[5] for h in HELD], float)
    model.calibrate(held, y)
    model.gate = MARGIN * float(model.probability(held)[y == 1].min())
    return model


def train(docs: DataFrame, common: list[str], rows: int = TRAIN_ROWS) -> BoostedTrees:
    """``train_on`` about ``rows`` documents at most, chosen by a hash of doc_id and text (repeated ones count once), with the
    weak label of their form."""
    share = min(1.0, rows / max(1, docs.count()))
    some = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))).dropDuplicates(["h"])
    sample = text_stats(with_form(some.select("text")), common).where("label is not null").select(*FEATURES, "label").toPandas().to_numpy(float)
    return train_on(sample[:, :5], sample[:, 5], set(common))


def quality(docs: DataFrame, words: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """(doc_id, FEATURES, junk_probability, looked_at) of every text that isn't null; looked_at tells whether the trees hold it
    for possible junk (``model.gate``). An empty or blank text has zeros and is looked at."""
    common = common_words(words)
    rows = spread(docs.select("doc_id", "text"))
    model = model or train(rows, common)

    @F.pandas_udf("double")
    def junk(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series(model.probability(np.column_stack([a, b, c, d, e]).astype(float)))

    stats = text_stats(rows, common).select("doc_id", *FEATURES)
    return stats.withColumn("junk_probability", junk(*FEATURES)).withColumn("looked_at", (F.col("junk_probability") >= model.gate) | (F.col("n_words") == 0))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document."""
    stats = text_stats(table(spark, d, "documents").select("doc_id", "text"), common_words(table(spark, d, "common_words")))
    return stats.select("doc_id", "n_words", *[F.round(f, 6).alias(f) for f in FEATURES[1:]])


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    """The statistics and the calibrated probability of junk of every document."""
    return quality(table(spark, d, "documents"), table(spark, d, "common_words")).drop("looked_at")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that aren't natural prose: what the trees hold for possible junk, checked exactly by the signs."""
    got = quality(table(spark, d, "documents"), table(spark, d, "common_words")).where("looked_at")
    shown = [F.col("n_words") < 20, (F.col("mean_word_length") < 3.0) | (F.col("mean_word_length") > 8.0), F.col("symbol_ratio") > 0.12, F.col("line_end_share") < 0.5, F.col("common_share") < 0.2]
    total = shown[0].cast("int")
    for s in shown[1:]:
        total = total + s.cast("int")
    return got.where((F.col("n_words") == 0) | (total >= 2)).select("doc_id")


QUERIES = {"p10_found": p10_found, "p10_stats": p10_stats, "p10_quality": p10_quality}
_STATS = r"""WITH a AS (
  SELECT doc_id, regexp_replace(text, '[ \t\n\r]', '', 'g') AS solid, list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '') AS words,
    list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, chr(32) || chr(9) || chr(13))), lambda l: l <> '') AS lines FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT doc_id, length(solid) AS chars, length(regexp_replace(solid, '[\p{L}\p{N}]', '', 'g')) AS symbols, len(words) AS n, len(lines) AS n_lines,
    len(list_filter(lines, lambda l: right(l, 1) IN ('.', '!', '?'))) AS ended,
    len(list_filter(list_transform(words, lambda w: regexp_replace(lower(w), '[^\p{L}]', '', 'g')), lambda w: list_contains(cw, w))) AS known
  FROM a, (SELECT list(DISTINCT lower(word)) AS cw FROM common_words)),
c AS (
  SELECT doc_id, n::INTEGER AS n_words, CASE WHEN n > 0 THEN chars / n ELSE 0 END AS mean_word_length, CASE WHEN chars > 0 THEN symbols / chars ELSE 0 END AS symbol_ratio,
    CASE WHEN n_lines > 0 THEN ended / n_lines ELSE 0 END AS line_end_share, CASE WHEN n > 0 THEN known / n ELSE 0 END AS common_share FROM b)"""
SQL = {
    "p10_stats": f"{_STATS} SELECT doc_id, n_words, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES[1:])} FROM c",
    "p10_found": f"""{_STATS} SELECT doc_id FROM c WHERE n_words = 0 OR (n_words < 20)::INT + (mean_word_length < 3.0 OR mean_word_length > 8.0)::INT
  + (symbol_ratio > 0.12)::INT + (line_end_share < 0.5)::INT + (common_share < 0.2)::INT >= 2""",
}
