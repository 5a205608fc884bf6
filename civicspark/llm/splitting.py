"""Splitting long texts into overlapping pieces at natural boundaries.

Bounded regular expressions consume the text: each alternative takes as many
words as the limit allows and must end at a boundary, the strongest first.
Everything is done with SQL functions on strings and arrays, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.functions.dedup import latest

#: A word of more characters than this is cut.
WORD_CHARS = 10_000


def boundary_pattern(words: int, least: float = 0.5) -> str:
    """A pattern that takes at most ``words`` words from where it stands.

    Its alternatives, by strength of the boundary at the end: a blank line, a
    line end after a sentence, the end of a sentence, a clause or line end,
    any word end; and, for a word longer than ``WORD_CHARS``, a character.  The
    stronger boundaries count only beyond the share ``least`` of the words.
    White space after the boundary belongs to the match, so matches join up to
    the text.
    """
    low, high = max(0, int(words * least) - 1), words - 1
    run = r"(?:\S++\s++)"
    end = r"\S*[.!?…][»”\"’')\]]{0,3}"
    words_first = "|".join(
        [
            rf"{run}{{0,{high}}}\S++\s*+\z",  # the rest
            rf"{run}{{{low},{high}}}\S++[^\S\n]*+\n[^\S\n]*+\n\s*+",
            rf"{run}{{{low},{high}}}{end}[^\S\n]*+\n\s*+",
            rf"{run}{{{low},{high}}}{end}\s++",
            rf"{run}{{{low},{high}}}(?:\S*[,;:–—]\s++|\S++[^\S\n]*+\n\s*+)",
            rf"{run}{{1,{words}}}",
            rf"\S{{1,{WORD_CHARS}}}+\s*+",
        ]
    )
    return rf"\s*+(?:{words_first})|\s++"


def word_count(text: Column) -> Column:
    """Runs of characters other than white space; no-break spaces and line ends are white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def split_text(text: Column, limit: int = 450, overlap: int = 60) -> Column:
    """The pieces of ``text``: an array of structs ``piece`` and ``new_chars``.

    A text of at most ``limit`` words is one piece, unchanged.  Otherwise
    every piece has at most ``limit`` words and, but for the first, begins with
    the last ``overlap`` words of the text before it; ``new_chars`` counts the
    characters after that overlap, so the new parts join up to the text.  Null
    stays null; an empty text has no pieces.
    """
    first = F.regexp_extract(text, f"(?U)^(?:{boundary_pattern(limit)})", 0)
    rest = F.substring(text, F.length(first) + 1, F.length(text))
    parts = F.concat(F.array(first), F.regexp_extract_all(rest, F.lit(f"(?U)(?:{boundary_pattern(limit - overlap)})"), F.lit(0)))
    parts = F.filter(parts, lambda p: p != "")

    def lookback(before: Column) -> Column:
        return F.array_join(F.slice(before, -overlap, overlap), "")

    def piece(part: Column, i: Column) -> Column:
        # at most two parts hold the overlap, but for parts cut inside a word
        behind = F.regexp_extract_all(F.array_join(F.slice(parts, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), ""), F.lit(r"(?U)\S+\s*"), F.lit(0))
        back = F.when(i == 0, "").when(F.size(behind) > overlap, lookback(behind)).otherwise(F.array_join(behind, ""))
        return F.struct(F.concat(back, part).alias("piece"), F.length(part).alias("new_chars"))

    whole = F.filter(F.array(F.struct(text.alias("piece"), F.length(text).alias("new_chars"))), lambda x: x["piece"] != "")
    return F.when(text.isNull(), None).when(word_count(text) <= limit, whole).otherwise(F.transform(parts, piece))


def split_chunks(chunks: DataFrame, limit: int = 450, overlap: int = 60) -> DataFrame:
    """Consecutively numbered pieces of the chunks that exceed ``limit`` words, with their section title.

    Rows with the same ``chunk_id`` count once, the one loaded last.  A text
    below ``2 * limit - 1`` characters can't exceed the limit and isn't looked
    at.  Null ids and null contents give no rows.
    """
    long = chunks.where((F.length("content") >= 2 * limit - 1) & F.col("chunk_id").isNotNull()).where(word_count(F.col("content")) > limit)
    once = latest(long.select("chunk_id", "document_id", "chunk_index", "section_title", "content", "loaded_at"), ["chunk_id"], "loaded_at")
    pieces = once.select("chunk_id", "document_id", "chunk_index", "section_title", F.posexplode(split_text(F.col("content"), limit, overlap)).alias("piece_no", "p"))
    return pieces.select(
        "chunk_id", "document_id", "chunk_index", "piece_no", "section_title",
        F.col("p.piece").alias("content"), F.col("p.new_chars").alias("new_chars"), word_count(F.col("p.piece")).alias("word_count"),
    )


def oversized_chunks(chunks: DataFrame, limit: int = 450, overlap: int = 60) -> DataFrame:
    """The chunks that had to be split (p2_found): those that have a second piece."""
    return split_chunks(chunks, limit, overlap).where("piece_no = 1").select("chunk_id")
