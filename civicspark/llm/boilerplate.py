"""Lines that a website repeats in its documents.

A first pass builds a mergeable summary of heavy hitters for each source: in
every partition a table of bounded size counts masked lines; when it is full,
a common amount is taken off all counts and dropped lines are forgotten, so a
count is too low by at most the amounts taken off.  Summaries are merged by
adding up counts and amounts.  Lines that may reach the wanted share are
candidates, sent to the executors in blocks of bounded size; a second pass
counts the documents that hold them exactly and confirms them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.functions.dedup import latest
from civicspark.llm.lines import header_head, is_page_number, masked
from civicspark.session import cut, spread

#: Counters of a source in a partition's summaries, tried one after the other; None counts everything.
COUNTERS = (4096, 32_768, 262_144, None)
#: Counters of all sources that a worker holds before it hands them on.
HELD = 1_000_000
#: Candidates that are sent to the executors at a time; sources with more are taken in blocks.
CANDIDATES = 200_000
#: A line has so many letters at least; the masked forms of a cut-off line and of the whole one begin with so many equal characters.
LETTERS, CUT = 3, 12
#: Lines up to this length are remembered, as they may be met again.
REMEMBERED = 400

_NUMBERED = re.compile(r"^\W*(?:\d+|[ivx]+|[a-z])[.)]\s", re.I)


def line_key(line: str) -> tuple[str, bool] | None:
    """The masked line, whatever its length, and whether its end is cut off; None for lines that no website repeats.

    Those are page numbers, running headers, numbered headings and lines
    without words.
    """
    text = line.strip()
    if len(text) < LETTERS or is_page_number(text) or _NUMBERED.match(text) or header_head(text):
        return None
    key = masked(text)
    if sum(map(str.isalpha, key[:40])) < LETTERS:
        return None
    return key, text.endswith(("…", "..."))


def begins_upper(line: str) -> bool:
    """Whether the line, without a leading mark or sign, begins with a capital letter."""
    text = line.lstrip()
    if not text[:1].isalnum():
        text = next((text[i:] for i, c in enumerate(text) if c.isalpha()), "")
    return text[:1].isupper()


class Summary:
    """Counts of the most frequent keys, too low by at most ``off``; without a size all keys are counted."""

    def __init__(self, size: int | None):
        self.size, self.counts, self.off = size, defaultdict(int), 0

    def add(self, key: str, n: int = 1) -> None:
        self.counts[key] += n
        if self.size and len(self.counts) > 2 * self.size:
            self.shrink()

    def shrink(self) -> None:
        take = sorted(self.counts.values(), reverse=True)[self.size]
        self.off += take
        self.counts = defaultdict(int, {k: n - take for k, n in self.counts.items() if n > take})


SUMMARY = "source string, key string, n long, off long"
SUMMARY_NAMES = ["source", "key", "n", "off"]


def _summaries(rows: DataFrame, size: int | None) -> DataFrame:
    """The summaries of all partitions, one row for each source and key, and one with a null key for what was taken off.

    A worker that holds too many counters hands its summaries on and begins new
    ones; as summaries are merged by adding up, that changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, Summary] = {}
        memo: dict[str, str | None] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            # lines that a partition has once are sent too: others may have them as well
            out = [(s, k, n, 0) for s, x in of.items() for k, n in x.counts.items()]
            out += [(s, None, 0, x.off) for s, x in of.items()]
            of.clear()
            for lo in range(0, len(out), 10_000):
                part = list(zip(*out[lo : lo + 10_000]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.string()), pa.array(part[1], pa.string()), pa.array(part[2], pa.int64()), pa.array(part[3], pa.int64())], SUMMARY_NAMES)

        for batch in batches:
            for source, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                summary = of.get(source)
                if summary is None:
                    summary = of[source] = Summary(size)
                for line in set(text.split("\n")):
                    if len(line) > REMEMBERED:
                        found = line_key(line)
                        if found:
                            summary.add(found[0])
                        continue
                    if line not in memo:
                        if len(memo) > 50_000:
                            memo.clear()
                        found = line_key(line)
                        memo[line] = found[0] if found else None
                    if (key := memo[line]) is not None:
                        summary.add(key)
            if sum(len(x.counts) for x in of.values()) > HELD:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, SUMMARY)


class Confirmable:
    """The candidates of each source, found by whole key or, for cut-off lines, by their beginning."""

    def __init__(self, keys: list[tuple[str, str]]):
        self.keys: dict[str, dict[str, str]] = defaultdict(dict)
        self.heads: dict[tuple[str, str], list[str]] = defaultdict(list)
        for source, key in keys:
            self.keys[source][key] = key
        for source, keys_ in self.keys.items():
            # a candidate that is itself the beginning of a longer one belongs to that one
            ordered = sorted(keys_)
            for a, b in zip(ordered, ordered[1:]):
                if len(a) >= CUT and b.startswith(a):
                    keys_[a] = b
            for a in reversed(ordered):
                keys_[a] = keys_[keys_[a]]
            for k in set(keys_.values()):
                self.heads[source, k[:CUT]].append(k)

    def match(self, source: str, key: str, end: bool) -> str | None:
        whole = self.keys.get(source)
        if not whole:
            return None
        if key in whole:
            return whole[key]
        if len(key) >= CUT:
            for k in self.heads.get((source, key[:CUT]), ()):
                if k.startswith(key):
                    return k
                if end and len(key) > len(k) and key.startswith(k):
                    return k
        return None


HITS = "source string, document string, piece string, line_no int, key string, upper boolean"


def _hits(rows: DataFrame, candidates: list[tuple[str, str]]) -> DataFrame:
    """The lines that match a candidate of their source."""
    shared = rows.sparkSession.sparkContext.broadcast(Confirmable(candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str], str | None] = {}
        for batch in batches:
            out = []
            for s, d, t, p in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if s not in shared.value.keys:
                    continue
                for no, line in enumerate(t.split("\n")):
                    if len(line) > REMEMBERED:
                        found = line_key(line)
                        key = shared.value.match(s, *found) if found else None
                    else:
                        if (s, line) not in memo:
                            if len(memo) > 50_000:
                                memo.clear()
                            found = line_key(line)
                            memo[s, line] = shared.value.match(s, *found) if found else None
                        key = memo[s, line]
                    if key is not None:
                        out.append((s, d, p, no, key, begins_upper(line)))
            if out:
                part = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[0]), pa.array(part[1]), pa.array(part[2]), pa.array(part[3], pa.int32()), pa.array(part[4]), pa.array(part[5])],
                    ["source", "document", "piece", "line_no", "key", "upper"],
                )

    return rows.mapInArrow(run, HITS)


def repeated_lines(rows: DataFrame, source: str, document: str, piece: str, text: str, documents: int = 4, share: float = 0.02) -> DataFrame:
    """The lines of each piece of text that their source repeats.

    A line, split at line feeds and numbered from 0 (``line_no``), counts if
    lines that differ from it only in dates, numbers, case, accents, spacing, a
    leading mark or a cut-off end are found in at least ``documents`` documents
    of the source and in at least ``share`` of its documents.  Gives ``piece``,
    ``source``, ``line_no`` and ``key``, one row for each line.  Pieces that
    are delivered twice count once.  Rows with a null id, source or text have
    no lines.
    """
    given = spread(rows.select(F.col(source).alias("source"), F.col(document).cast("string").alias("document"), F.col(text).cast("string").alias("text"), F.col(piece).cast("string").alias("piece")).where(
        "source is not null and document is not null and text is not null and piece is not null"
    ))
    spark = rows.sparkSession
    sizes = cut(given.groupBy("source").agg(F.count_distinct("document").alias("documents")))
    wanted = F.greatest(F.lit(documents), F.ceil(F.col("documents") * share))
    for size in COUNTERS:
        keys = _summaries(given, size).groupBy("source", "key").agg(F.sum("n").alias("n"), F.sum("off").alias("off"))
        # cut-off lines are counted on their own, but a line and its cut-off forms begin alike: their sum tells whether the line may be one
        heads = keys.groupBy("source", F.left("key", F.lit(CUT)).alias("head")).agg(F.sum("n").alias("n"), F.sum("off").alias("off"), F.collect_list(F.when(F.col("n") >= 2, F.col("key"))).alias("keys"))
        summaries = cut(heads.where("head is null or size(keys) > 0"))
        lost = summaries.where("head is null").select("source", F.col("off").alias("lost")).join(sizes, "source").withColumn("wanted", wanted)
        # a count may be too low by what its partitions took off; where that is more than a quarter of what is wanted, summaries are enlarged
        if lost.where(F.col("lost") > F.col("wanted") / 4).isEmpty():
            break
    # every form loses on its own: where anything was taken off, half of what is wanted is enough
    enough = F.col("wanted") / F.when(F.col("lost") > 0, 2).otherwise(1)
    candidates = cut(summaries.where("head is not null").join(lost, "source").where(F.col("n") + F.col("lost") >= enough).select("source", F.explode("keys").alias("key")))
    # of a source at most (lines of its documents) / wanted lines can reach what is wanted; many sources are taken in blocks
    blocks = max(1, -(-candidates.count() // CANDIDATES))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks))
    found = None
    for no in range(blocks):
        part = _hits(given.where(block == no) if blocks > 1 else given, [tuple(r) for r in candidates.where(block == no).toLocalIterator()])
        found = part if found is None else found.unionByName(part)
    found = cut(found)
    counted = found.groupBy("source", "key").agg(F.count_distinct("document").alias("holding"), F.avg(F.col("upper").cast("double")).alias("upper"))
    # lines inside a paragraph mostly begin in lower case or with a figure
    confirmed = counted.join(sizes, "source").where((F.col("holding") >= wanted) & (F.col("upper") >= 0.5)).select("source", "key")
    return found.join(confirmed, ["source", "key"]).select("piece", "source", "line_no", "key").distinct()


def _by_commune(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "document_id", "content", F.coalesce("commune_key", F.regexp_extract("document_id", r"^(.*)_\D+_\d+", 1)).alias("commune_key"))


def site_lines(chunks: DataFrame) -> DataFrame:
    """p7_found: the lines of the municipality's website in council passages."""
    return repeated_lines(_by_commune(chunks), "commune_key", "document_id", "chunk_id", "content").select(F.col("piece").alias("chunk_id"), "line_no").distinct()


def without_site_lines(chunks: DataFrame) -> DataFrame:
    """The passages without the lines of the website: ``chunk_id``, ``content`` and the number of lines taken out.

    Of passages delivered twice the latest version comes out, once.  Lines that
    are left keep their order and text.
    """
    known = chunks.where("chunk_id is not null")
    once = cut(latest(known, ["chunk_id"], "loaded_at" if "loaded_at" in chunks.columns else "content"))
    lines = repeated_lines(_by_commune(once), "commune_key", "document_id", "chunk_id", "content")
    drop = lines.groupBy(F.col("piece").alias("chunk_id")).agg(F.collect_set("line_no").alias("drop"))
    kept = F.filter(F.split("content", "\n"), lambda _, i: ~F.array_contains(F.coalesce("drop", F.array().cast("array<int>")), i))
    return once.join(drop, "chunk_id", "left").select("chunk_id", F.array_join(kept, "\n").alias("content"), F.coalesce(F.size("drop"), F.lit(0)).alias("removed"))
