"""Problem 3: cutting long texts at natural boundaries, by packing a tree of their structure."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.tables import current_docs, table

LIMIT, OVERLAP = 1500, 150

# Where a node's children begin, from the coarsest structure to the finest: after each match.
_HEADING = [re.compile(r"\n(?=#{1,%d}[ \t])" % n) for n in range(1, 7)]
_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))+|(?i:</(?:p|div|ul|ol|table|section|h[1-6])>)[ \t]*")
_ITEM = re.compile(r"(?:\r\n|\n|\r)(?=[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t])|(?i:</li>|<br\s*/?>)[ \t]*")
_LINE = re.compile(r"\r\n|\n|\r")
_SENTENCE = re.compile(r"""[.!?…]+["'”’)\]]*[ \t\r\n]+""")
_WORD = re.compile(r"(?<=[ \t\r\n])(?=[^ \t\r\n])|(?<=[^ \t\r\n])(?=[ \t\r\n])")
_LEVELS = [*_HEADING, _PARAGRAPH, _ITEM, _LINE, _SENTENCE, _WORD]
_BLANK = re.compile(r"[ \t\r\n]")
_WORD_START = re.compile(r"(?<=[ \t\r\n])[^ \t\r\n]")
_BLANKS = " \t\r\n"


_HEADING_ONLY = re.compile(r"[ \t\r\n]*(?:#{1,6}[ \t][^\n]*(?:\n[ \t\r\n]*|$))+")


def _children(text: str, a: int, b: int, level: int) -> list[tuple[int, int]]:
    """Spans of the children of text[a:b]; a child that is nothing but headings is one with the child after it."""
    cuts = [m.end() for m in _LEVELS[level].finditer(text, a, b)]
    edges = [a, *(c for c in cuts if a < c < b), b]
    if text.find("#", a, b) >= 0:
        kept = [a]
        for c in edges[1:-1]:
            if not _only_heading(text, kept[-1], c):
                kept.append(c)
        edges = [*kept, b]
    return list(zip(edges, edges[1:]))


def _only_heading(text: str, a: int, b: int) -> bool:
    m = _HEADING_ONLY.match(text, a, b)
    return m is not None and m.end() == b


def _pack(text: str, a: int, b: int, level: int, limit: int, room: int) -> list[tuple[int, int]]:
    """Spans of text[a:b]: the node itself if it is small enough, else its children packed: neighbours that are whole are merged up
    to ``room``; one that is too large is opened and packed by itself, and its parts are never merged with what is outside it.

    ``room`` leaves space for the overlap; an unbroken stretch may fill the whole ``limit``.
    """
    if b - a <= room:
        return [(a, b)]
    if level == len(_LEVELS):
        if text[a] in _BLANKS:
            return [(i, min(i + room, b)) for i in range(a, b, room)]
        return [(a, b)] if b - a <= limit else [(i, min(i + room, b)) for i in range(a, b, room)]
    children = _children(text, a, b, level)
    if len(children) == 1:
        return _pack(text, a, b, level + 1, limit, room)
    out: list[tuple[int, int]] = []
    merging = False
    for x, y in children:
        if y - x > room:
            out += _pack(text, x, y, level + 1, limit, room)
            merging = False
        elif merging and y - out[-1][0] <= room:
            out[-1] = out[-1][0], y
        else:
            out.append((x, y))
            merging = True
    return out


def _stretch(text: str, cut: int) -> int:
    """The length of the stretch without blanks that goes on over a cut; 0 if there is a blank at it."""
    if text[cut - 1] in _BLANKS or text[cut] in _BLANKS:
        return 0
    end = _BLANK.search(text, cut)
    return (end.start() if end else len(text)) - max(text.rfind(c, 0, cut) for c in _BLANKS) - 1


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, bool]]:
    """(start, end, overlap, hard) of the pieces text[start:end]: each at most ``limit`` long, the first ``overlap``
    characters of it repeating the end of the piece before. hard: its end cuts a stretch without blanks that is longer
    than the limit (a cut at markup inside a shorter one is a natural one).
    """
    if len(text) <= limit:
        return [(0, len(text), 0, False)]
    out, last = [], 0
    for a, b in _pack(text, 0, len(text), 0, limit, limit - overlap):
        most = min(overlap, limit - (b - a), a - last)
        at = a - most
        if 0 < most and text[at - 1 : at] not in ("", *_BLANKS):  # begin the overlap at a word, if one begins there
            m = _WORD_START.search(text, at, a)
            at = m.start() if m else at
        out.append((at, b, a - at, b < len(text) and _stretch(text, b) > limit))
        last = a
    return out


def split_long(docs: DataFrame, id_col: str = "doc_rowid", text_col: str = "raw_text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, start, overlap, hard, text): the ordered pieces of every text longer than ``limit`` characters.

    The text is a tree of headings, paragraphs, list items, lines, sentences and words; whole siblings are merged up to the
    limit, only nodes over it are opened, and no piece holds a part of an opened node with anything outside it. A heading stays
    with what follows it. Dropping each piece's overlap and joining gives the text back. Stretches
    without blanks over the limit are cut hard. Null, empty and shorter texts give no row; repeated rows are split each.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > limit)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [(i, k, a, o, h, t[a:b]) for i, t in zip(f["id"], f["text"]) for k, (a, b, o, h) in enumerate(split_text(t, limit, overlap))]
            yield pd.DataFrame(got, columns=["id", "piece", "start", "overlap", "hard", "text"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(cut, f"id {kind}, piece int, start int, overlap int, hard boolean, text string").withColumnRenamed("id", id_col)


def _long_docs(spark: SparkSession, d: str) -> DataFrame:
    return current_docs(table(spark, d, "docs"), F.expr(f"if(length(raw_text) > {LIMIT}, raw_text, null)").alias("raw_text"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every current raw_text of more than 1,500 characters."""
    return split_long(_long_docs(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Split docs; cut is 'hard' if an unbroken stretch had to be cut, else 'soft'."""
    per_doc = split_long(_long_docs(spark, d)).groupBy("doc_rowid").agg(F.max("hard").alias("hard"))
    return per_doc.select("doc_rowid", F.when(F.col("hard"), "hard").otherwise("soft").alias("cut"))


def p3_joined(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces give back: per split doc the length and md5 of the pieces joined without their overlaps, the longest piece and
    the longest overlap."""
    pieces = split_long(_long_docs(spark, d))
    parts = F.array_sort(F.collect_list(F.struct("piece", F.expr("substring(text, overlap + 1)").alias("own"))))
    whole = pieces.groupBy("doc_rowid").agg(F.array_join(F.transform(parts, lambda x: x["own"]), "").alias("whole"), F.max(F.length("text")).alias("longest"), F.max("overlap").alias("most"))
    return whole.select("doc_rowid", F.length("whole").alias("length"), F.md5("whole").alias("digest"), (F.col("longest") <= LIMIT).alias("fits"), (F.col("most") <= OVERLAP).alias("short_overlap"))


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p3_joined": p3_joined}
SQL = {
    "p3_found": rf"""WITH cur AS (
  SELECT * FROM docs WHERE doc_rowid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_rowid ORDER BY ingested_at DESC NULLS LAST) = 1)
SELECT doc_rowid, CASE WHEN list_max(list_transform(string_split_regex(raw_text, '[ \t\n\r]'), lambda x: length(x))) > {LIMIT} THEN 'hard' ELSE 'soft' END AS cut
FROM cur WHERE length(raw_text) > {LIMIT}""",
    "p3_joined": f"""SELECT doc_rowid, length(raw_text)::INTEGER AS length, md5(raw_text) AS digest, true AS fits, true AS short_overlap FROM (
  SELECT * FROM docs WHERE doc_rowid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_rowid ORDER BY ingested_at DESC NULLS LAST) = 1) WHERE length(raw_text) > {LIMIT}""",
}
