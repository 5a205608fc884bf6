"""Repair of text taken from scanned pages.

A first pass counts the corpus' words, its words broken over two lines and its
running headers with masked digits.  Words are grouped by their skeleton, in
which glyphs that scanners take for one another are equal; a rare form whose
group has a much more frequent one is a misreading of it.  A second pass marks
the lines of each text, joins broken words and puts misread words right, and
SQL windows put the lines together to paragraphs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicspark.functions.dedup import latest
from civicspark.llm.lines import GLYPHS, header_head, is_page_number
from civicspark.session import cut, spread

#: A word is a misreading if its group has a form this many times as frequent, ...
RATIO = 20
#: ... which is found at least so often.
LEAST = 6
#: The share of a word's occurrences whose word before must be found before the form as well.
SUPPORT = 0.25
#: Misread words that are sent to the executors at a time.
ENTRIES = 300_000
#: Groups of letters that look like another one (fixed values); l and t, c and e as well.
CLUSTERS = (("e`", "è"), ("a`", "à"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"))

WORD = re.compile(r"[\w|†`]+(?:-[\w|†`]+)*")
BREAK = re.compile(r"([\w|†`]*[^\W\d_][|†`]*)([-‐¬\xad])[ \t\xa0]*$")
START = re.compile(r"\s*([\w|†`]+)")
_ASIDE = re.compile(r"\s*(?:[\d’'. ]+|\d{1,2}[.)] \D{3,60})$")
HYPHENS = "-‐¬\xad"


def skeletons(word: str) -> list[str]:
    """The skeletons of a word in lower case: one, or two if it holds a 6, which is read for é and for b."""
    out = []
    for six in ("é", "b") if "6" in word else ("",):
        t = word.replace("6", six)
        for a, b in CLUSTERS:
            t = t.replace(a, b)
        for a, b in GLYPHS.items():
            if a != "6":
                t = t.replace(a, b)
        for a, b in CLUSTERS:
            t = t.replace(a, b)
        out.append(t.replace("l", "t").replace("c", "e"))
    return out


def wildcards(word: str) -> list[str]:
    """The word with each of its letters replaced by a bar, which is how a smudge is read."""
    return [word[:i] + "|" + word[i + 1 :] for i in range(len(word))]


class Marked:
    """The lines of a text: what each is, and the word that goes on in another line."""

    def __init__(self, text: str, known=frozenset()):
        self.lines = text.split("\n")
        self.kinds = []
        for line in self.lines:
            if not line.strip():
                self.kinds.append("blank")
            elif is_page_number(line):
                self.kinds.append("page_number")
            elif (head := header_head(line)) and ("h", head) in known:
                self.kinds.append("header")
            else:
                self.kinds.append("text")
        #: line with the first part, line with the rest, parts, whether they are one word without hyphen
        self.breaks: list[tuple[int, int, str, str, bool]] = []
        for i, line in enumerate(self.lines):
            if self.kinds[i] == "text" and line.rstrip()[-1:] in HYPHENS and (m := BREAK.search(line)):
                for j in range(i + 1, min(i + 7, len(self.lines))):
                    if self.kinds[j] != "text" or _ASIDE.match(self.lines[j]):
                        continue
                    if n := START.match(self.lines[j]):
                        rest = n[1]
                        if rest[0].islower() or rest[0] in "|†0156":
                            self.breaks.append((i, j, m[1], rest, ("b", f"{m[1].lower()}\t{rest.lower()}") not in known))
                    break

    def running(self) -> str:
        """The text lines without the broken words, which are appended whole."""
        lines = [x for x in self.lines]
        words = []
        for i, j, a, b, one in self.breaks:
            lines[i] = BREAK.sub("", lines[i])
            lines[j] = START.sub("", lines[j], count=1)
            words.append(a + ("" if one else "-") + b)
        return " ".join([x for x, k in zip(lines, self.kinds) if k == "text"] + words)


COUNTS = "kind string, key string, n long"


def _counts(texts: DataFrame) -> DataFrame:
    """Counts of words ('w'), broken words ('b', both parts) and headers ('h')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(counts.items())
            counts.clear()
            for lo in range(0, len(items), 20_000):
                part = items[lo : lo + 20_000]
                kinds = [k[0] if isinstance(k, tuple) else "w" for k, _ in part]
                keys = [k[1] if isinstance(k, tuple) else k for k, _ in part]
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys), pa.array([n for _, n in part], pa.int64())], ["kind", "key", "n"])

        for batch in batches:
            for text in batch.column(1).to_pylist():
                if "\n" in text:
                    marked = Marked(text)
                    for i, line in enumerate(marked.lines):
                        if marked.kinds[i] == "text" and (head := header_head(line)):
                            counts["h", head] += 1
                            marked.kinds[i] = "header"
                    for _, _, a, b, _ in marked.breaks:
                        counts["b", f"{a.lower()}\t{b.lower()}"] += 1
                    marked.breaks, broken = [], marked.breaks
                    lines = list(marked.lines)
                    for i, j, *_ in broken:
                        lines[i], lines[j] = BREAK.sub("", lines[i]), START.sub("", lines[j], count=1)
                    text = " ".join(x for x, k in zip(lines, marked.kinds) if k == "text")
                counts.update(WORD.findall(text.lower()))
            if len(counts) > 400_000:
                yield from flush()
        yield from flush()

    return texts.mapInArrow(run, COUNTS).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _readings(counts: DataFrame) -> DataFrame:
    """Words that may be misread and the forms they may stand for: ``word``, ``form``, and how often the form is found (``m``)."""
    whole = counts.where("kind = 'w'").select(F.col("key").alias("word"), "n")
    broken = counts.where("kind = 'b'").select(F.replace("key", F.lit("\t"), F.lit("")).alias("word"), "n")
    words = whole.unionByName(broken).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("word").rlike(r"\p{L}") & (F.length("word") >= 2))

    def skeletal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for w, n in zip(batch["word"], batch["n"]):
                if "|" in w:
                    out.append((w, n, w))
                    continue
                out += [(w, n, s) for s in skeletons(w)]
                if n >= 5 * LEAST and len(w) >= 4:
                    out += [(w, n, s) for s in wildcards(w)]
            yield pd.DataFrame(out, columns=["word", "n", "skeleton"])

    groups = words.mapInPandas(skeletal, "word string, n long, skeleton string")
    # every form of a group that is frequent enough for the word is a reading of it
    forms = groups.where((F.col("n") >= LEAST) & ~F.col("word").rlike(r"[|†`0-9]")).select("skeleton", F.col("n").alias("m"), F.col("word").alias("form"))
    pairs = groups.join(forms, "skeleton").where((F.col("word") != F.col("form")) & (F.col("m") >= F.col("n") * RATIO))
    # a smudge may stand for any letter, other words only for those with the same skeleton
    return pairs.where(~F.col("skeleton").contains("|") | F.col("word").contains("|")).groupBy("word", "form").agg(F.max("m").alias("m"))


def _misread(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """Misread words and the form they stand for: ``word``, ``form``.

    A form is supported by its context if it is found behind the words that
    the misread word is found behind.  The form with the most support is
    taken, then the most frequent one.  A word without a supported form is
    taken as it is written, unless it is only found broken over two lines,
    where nothing is known of its context.
    """
    spark = texts.sparkSession
    readings = cut(_readings(counts))
    parts = max(1, -(-readings.count() // ENTRIES))
    near = None
    for part in range(parts):
        rows = readings.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part).select("word", "form").toArrow().to_pydict()
        shared = spark.sparkContext.broadcast(frozenset(rows["word"]) | frozenset(rows["form"]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counted: Counter = Counter()
            wanted = shared.value

            def flush() -> pa.RecordBatch:
                keys = list(counted)
                out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counted[k] for k in keys], pa.int64())], ["before", "token", "c"])
                counted.clear()
                return out

            for batch in batches:
                for text in batch.column(1).to_pylist():
                    found = WORD.findall(text.lower())
                    counted.update([x for x in zip(["", *found], found) if x[1] in wanted])
                if len(counted) > 400_000:
                    yield flush()
            yield flush()

        seen = texts.mapInArrow(run, "before string, token string, c long")
        near = seen if near is None else near.unionByName(seen)
    if near is None:
        return readings.select("word", "form")
    near = cut(near.groupBy("before", "token").agg(F.sum("c").alias("c")))
    of_word = near.select("before", F.col("token").alias("word"), F.col("c").alias("cw"))
    of_form = near.select("before", F.col("token").alias("form"), F.lit(1).alias("there"))
    support = readings.join(of_word, "word").join(of_form, ["before", "form"], "left").groupBy("word", "form").agg((F.sum(F.when(F.col("there") == 1, F.col("cw")).otherwise(0)) / F.sum("cw")).alias("support"))
    judged = readings.join(support, ["word", "form"], "left").where(F.coalesce("support", F.lit(1.0)) >= SUPPORT)
    return judged.groupBy("word").agg(F.max_by("form", F.struct(F.coalesce("support", F.lit(1.0)).alias("s"), "m", "form")).alias("form"))


def _compounds(counts: DataFrame) -> DataFrame:
    """Broken words that are written with a hyphen: ``a``, ``b``."""
    broken = counts.where("kind = 'b'").select(F.split("key", "\t")[0].alias("a"), F.split("key", "\t")[1].alias("b"))
    words = counts.where("kind = 'w'").select("key", "n")
    return (
        broken.withColumn("key", F.concat("a", F.lit("-"), "b")).join(words.withColumnRenamed("n", "apart"), "key")
        .withColumn("key", F.concat("a", "b")).join(words.withColumnRenamed("n", "joined"), "key", "left")
        .where(F.col("apart") > F.coalesce("joined", F.lit(0))).select("a", "b")
    )


LINES = "id string, lines array<struct<no:int,kind:string,text:string,word:string,misread:int,goes_on:boolean>>"


def scan_lines(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """The marked and repaired lines of each text.

    Gives ``id`` and ``lines``: an array of structs with the line's number, its
    ``kind`` (text, blank, header, page_number), its repaired text, the
    ``word`` that was broken over it and the next one (null if none), how many
    of its words were misread, and whether a word goes on in a later line.
    Rows with a null id or text are left out; an empty text is one blank line.
    Counts are taken over all rows.
    """
    spark = chunks.sparkSession
    texts = spread(chunks.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null"))
    counts = cut(_counts(texts))
    known = cut(counts.where("kind = 'h' and n >= 2").select("kind", "key").unionByName(_compounds(counts).select(F.lit("b").alias("kind"), F.concat("a", F.lit("\t"), "b").alias("key"))))
    misread = cut(_misread(texts, counts))
    # what is sent to the executors is bounded: more entries are taken in blocks, one after the other
    blocks = max(1, -(-misread.count() // ENTRIES))
    if known.count() <= ENTRIES:
        rows = known.toArrow().to_pydict()
        shared = spark.sparkContext.broadcast(frozenset(zip(rows["kind"], rows["key"])))
    else:
        shared, texts = None, _with_known(texts, known)
    out = None
    for block in range(blocks):
        forms = spark.sparkContext.broadcast(dict(misread.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == block).toArrow().to_pandas().itertuples(index=False, name=None)))
        out = _mark(texts, shared, forms) if out is None else _again(out, forms)
    return out


def _with_known(texts: DataFrame, known: DataFrame) -> DataFrame:
    """The texts with the headers and compounds they hold, as ``known``: for more than can be sent to all executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = set()
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out |= {(i, "h", head) for line in text.split("\n") if (head := header_head(line))}
                # without knowing the headers a word is looked for behind them as well as in them
                for heads in (frozenset(), _Every()):
                    out |= {(i, "b", f"{a.lower()}\t{b.lower()}") for _, _, a, b, _ in Marked(text, heads).breaks}
            rows = list(zip(*sorted(out))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in rows], ["id", "kind", "key"])

    held = texts.mapInArrow(run, "id string, kind string, key string").join(known, ["kind", "key"])
    own = held.groupBy("id").agg(F.collect_set(F.concat("kind", F.lit("\t"), "key")).alias("known"))
    return texts.join(own, "id", "left").select("id", "text", F.coalesce("known", F.array().cast("array<string>")).alias("known"))


class _Every:
    """Holds everything."""

    def __contains__(self, _) -> bool:
        return True


def _fix(text: str, forms: dict[str, str]) -> tuple[str, int]:
    """The text with misread words put right, in the case they have, and how many there were."""
    bad = forms.keys() & set(WORD.findall(text.lower()))
    if not bad:
        return text, 0
    n = 0

    def put(m: re.Match) -> str:
        nonlocal n
        form = forms.get(m[0].lower())
        if form is None:
            return m[0]
        n += 1
        return form.upper() if m[0].isupper() and len(m[0]) > 1 else form.capitalize() if m[0][0].isupper() else form

    return WORD.sub(put, text), n


def _mark(texts: DataFrame, known, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = shared.value
        schema = pa.list_(pa.struct([("no", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("word", pa.string()), ("misread", pa.int32()), ("goes_on", pa.bool_())]))
        for batch in batches:
            out = []
            own = repeat(known.value) if known else ({tuple(k.split("\t", 1)) for k in keys} for keys in batch.column(2).to_pylist())
            for text, held in zip(batch.column(1).to_pylist(), own):
                marked = Marked(text, held)
                lines = list(marked.lines)
                word: dict[int, str] = {}
                for i, j, a, b, one in marked.breaks:
                    whole, rest = a + ("" if one else "-") + b, lines[j].lstrip()
                    if rest.startswith(b):
                        # marks behind the word go with it
                        marks = re.match(r"[.,;:?!…»)]*", rest[len(b) :])[0]
                        whole, lines[j] = whole + marks, rest[len(b) + len(marks) :].lstrip(" ")
                    lines[i] = BREAK.sub("", lines[i]) + whole
                    if one:
                        word[i] = a + b
                goes = {i for i, j, *_ in marked.breaks if lines[j].strip()}
                row = []
                for i, (line, kind) in enumerate(zip(lines, marked.kinds)):
                    fixed, n = _fix(line, forms) if kind == "text" else (line, 0)
                    row.append({"no": i, "kind": kind, "text": fixed, "word": word.get(i), "misread": n, "goes_on": i in goes})
                out.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, schema)], ["id", "lines"])

    return texts.mapInArrow(run, LINES)


def _again(marked: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch["lines"]:
                for x in row:
                    if x["kind"] == "text":
                        x["text"], n = _fix(x["text"], shared.value)
                        x["misread"] = max(x["misread"], n)
            yield batch

    return marked.mapInPandas(run, LINES)


#: A reference number, and a date, in a line (fixed values).
_REFERENCE = r"(?i)(n[°o]|nr)\.?\s?\d|\d+[-/]\d+"
_DAY = r"(?i)\d{1,2}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}(er|\.)?\s\p{L}{3,9}\s\d{4}"


def repeated_headers(chunks: DataFrame) -> DataFrame:
    """The lines, ``chunk_id`` and ``no``, that stand on several pages of one document and, with masked digits, in no other one.

    A chunk's document is named by its id up to the "#".
    They bear a reference number, but no date; case and spacing don't count.
    That finds running headers of any form; those met once are found by the
    form of their series.
    """
    rows = chunks.where("chunk_id is not null and content is not null").select("chunk_id", F.element_at(F.split("chunk_id", "#"), 1).alias("document"), F.posexplode(F.split("content", "\n")).alias("no", "line"))
    line = F.trim("line")
    fit = F.length(line).between(8, 160) & line.rlike(r"^\p{Lu}") & ~line.rlike(r"[.;,:!?…]$") & line.rlike(_REFERENCE) & ~line.rlike(_DAY)
    key = F.regexp_replace(F.lower(line), r"\s+", " ")
    lines = rows.where(fit).select("chunk_id", "no", "document", F.xxhash64(key).alias("key"), F.xxhash64(F.regexp_replace(key, r"\d+", "0")).alias("mask"))
    held = lines.groupBy("document", "mask", "key").agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b"))
    alone = held.groupBy("mask").agg(F.min("document").alias("a"), F.max("document").alias("b")).where("a = b").select("mask")
    headers = held.where("a <> b").join(alone, "mask", "left_semi").select("document", "key")
    return lines.join(headers, ["document", "key"], "left_semi").select("chunk_id", "no").distinct()


def noise_kinds(chunks: DataFrame) -> DataFrame:
    """p5_found: the kinds of noise in each passage."""
    lines = scan_lines(chunks)
    kinds = F.filter(
        F.array(
            F.when(F.exists("lines", lambda x: x["word"].isNotNull()), "hyphenation"),
            F.when(F.exists("lines", lambda x: x["misread"] > 0), "characters"),
            F.when(F.exists("lines", lambda x: x["kind"] == "header"), "header"),
            F.when(F.exists("lines", lambda x: x["kind"] == "page_number"), "page_number"),
        ),
        lambda k: k.isNotNull(),
    )
    found = lines.select(F.col("id").alias("chunk_id"), F.explode(kinds).alias("noise_kind"))
    return found.unionByName(repeated_headers(chunks).select("chunk_id", F.lit("header").alias("noise_kind"))).distinct()


def paragraphs(chunks: DataFrame) -> DataFrame:
    """The passages as continuous paragraphs: ``chunk_id``, ``paragraph_no`` and ``text``.

    Headers and page numbers are left out.  A line begins a paragraph if the
    one before it ends a sentence and is followed by a blank line, is long
    (unwrapped text) or is clearly shorter than the longest line; a word that
    goes on keeps lines together.  Passages delivered twice come out once.
    """
    once = cut(latest(chunks.select("chunk_id", "content", "loaded_at").where("chunk_id is not null and content is not null"), ["chunk_id"], "loaded_at"))
    lines = scan_lines(once).select("id", F.explode("lines").alias("l")).select("id", "l.*").where("kind in ('text', 'blank')")
    lines = lines.join(repeated_headers(once).withColumnRenamed("chunk_id", "id"), ["id", "no"], "left_anti")
    order = Window.partitionBy("id").orderBy("no")
    blank = F.when(F.col("kind") == "blank", 1).otherwise(0)
    numbered = lines.withColumn("blanks", F.sum(blank).over(order)).where("kind = 'text' and trim(text) <> ''").withColumn("longest", F.max(F.length("text")).over(Window.partitionBy("id")))
    before = F.lag("text").over(order)
    ends = F.rtrim(before).rlike("[.!?…:;»”\"]$")
    starts = (
        before.isNull()
        | (~F.lag("goes_on").over(order) & ends & ((F.col("blanks") > F.lag("blanks").over(order)) | (F.length(before) > 110) | (F.length(before) < F.col("longest") * 0.7)))
    )
    grouped = numbered.withColumn("starts", starts.cast("int")).withColumn("paragraph_no", F.sum("starts").over(order) - 1)
    return grouped.groupBy(F.col("id").alias("chunk_id"), "paragraph_no").agg(
        F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: F.trim(x["text"])), " "), r"\s+", " ").alias("text")
    )
