"""Text that was decoded with the wrong character encoding.

Adjacent pairs of characters are scored by the information they carry in the
corpus; runs of improbable pairs are isolated as maximum-scoring segments.
Only inside those runs wrong decodings are undone: for each pair of a wrong and
a right encoding the run is encoded and decoded again, and the result is taken
if it makes the run and its surroundings more probable.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.session import cut

#: Encodings that bytes in UTF-8 may have been read with.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "iso8859_15", "koi8_r", "cp866")
#: Pairs of single-byte encodings: (read as, written in).
SINGLE = tuple((a, b) for a in ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250") for b in ("cp1252", "mac_roman", "cp850", "cp437") if a != b and {a, b} != {"latin-1", "cp1252"})
#: Natural logarithm of how much more probable a repaired run must be.
LEAST_GAIN = 3.0
#: The same for further runs of a value in which another run was repaired in the same way.
SAME_GAIN = -1.0
#: A pair carries information if it does so this often in a million pairs.
COMMON = 4000.0
#: Pairs rarer than this share of all pairs count as unseen; so there are at most 1 / SHARE of them on the driver.
SHARE = 1e-7

LOST = "�"
_BROKEN = re.compile("[\x80-\x9f\ufffd]")
_CLUSTER = re.compile(r"[^\x00-\x7f]+")


def _tables() -> tuple[dict[str, dict[str, int]], dict[tuple[str, str], dict[str, str]]]:
    to_byte: dict[str, dict[str, int]] = {}
    for name in {*READ_AS, *(a for a, _ in SINGLE)}:
        table = {}
        for b in range(128, 256):
            try:
                table[bytes([b]).decode(name)] = b
            except UnicodeDecodeError:
                table[chr(b)] = b  # left as a control character
        to_byte[name] = table
    single = {}
    for a, b in SINGLE:
        single[a, b] = {}
        for char, byte in to_byte[a].items():
            try:
                single[a, b][char] = bytes([byte]).decode(b)
            except UnicodeDecodeError:
                pass
    return to_byte, single


class PairModel:
    """Counts of adjacent characters; a text is bounded by the character 0 on both sides."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        self.pairs = counts
        self.left: dict[str, int] = {}
        self.right: dict[str, int] = {}
        for (a, b), n in counts.items():
            self.left[a] = self.left.get(a, 0) + n
            self.right[b] = self.right.get(b, 0) + n
        self.total = max(1, sum(counts.values()))
        self.to_byte, self.single = _tables()
        self.memo: dict[tuple[str, str, str], list] = {}

    def information(self, a: str, b: str) -> float:
        """The pair's share of the corpus' mutual information, per million pairs, less what is common; in logarithms.

        Negative for improbable pairs.  Control and replacement characters are
        no text, so pairs with them carry none.
        """
        n = self.pairs.get((a, b), 0)
        if not n or _BROKEN.match(a) or _BROKEN.match(b):
            return -4.0
        mutual = math.log2(n * self.total / (self.left[a] * self.right[b]))
        return max(-4.0, min(4.0, math.log2((1 + n * max(mutual, 0.0) * 1e6 / self.total) / COMMON)))

    def runs(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """For each text the maximum-scoring segments of improbable pairs (Ruzzo and Tompa), as [start, end) in characters.

        A pair scores by the information it lacks; pairs of two ASCII
        characters, which no wrong decoding makes, score 1 below.  All pairs of
        the batch are scored at once, each different one once.
        """
        joined = "\0" + "\0".join(texts) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        kinds, where = np.unique((codes[:-1] << 21) | codes[1:], return_inverse=True)
        scored = np.array([-1.0 if a < 128 and b < 128 else -self.information(chr(a), chr(b)) for a, b in zip((kinds >> 21).tolist(), (kinds & ((1 << 21) - 1)).tolist())])
        scores = scored[where]
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        up = np.flatnonzero(scores > 0)
        of = np.searchsorted(bounds, up, "right") - 1
        for k in np.unique(of):
            first = int(bounds[k])
            sums = np.concatenate([[0.0], np.cumsum(scores[first : int(bounds[k + 1])])])
            stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
            for i in (up[of == k] - first).tolist():
                cur = (i, i + 1, sums[i], sums[i + 1])
                while True:
                    j = len(stack) - 1
                    while j >= 0 and stack[j][2] >= cur[2]:
                        j -= 1
                    if j < 0 or stack[j][3] >= cur[3]:
                        break
                    cur = (stack[j][0], cur[1], stack[j][2], cur[3])
                    del stack[j:]
                stack.append(cur)
            out[k] = [(max(0, s - 1), min(len(texts[k]), e)) for s, e, _, _ in stack]
        return out

    def log(self, a: str, b: str) -> float:
        return math.log((self.pairs.get((a, b), 0) + 0.02) / (self.left.get(a, 0) + 4.0))

    def likelihood(self, text: str, start: int, end: int) -> float:
        """Log-probability of text[start:end] and of the characters at its sides."""
        padded = "\0" + text + "\0"
        return sum(self.log(padded[i], padded[i + 1]) for i in range(start, end + 1)) - sum(self.rare(c) for c in text[start:end])

    def rare(self, c: str) -> float:
        """A cost for each character; a shorter text isn't better for being shorter."""
        return 0.0 if c.isascii() else 0.5

    def utf8(self, run: str, read_as: str) -> str | None:
        """``run`` with every sequence that is UTF-8 read as ``read_as`` decoded; None if there is none."""
        table, out, i, any_found = self.to_byte[read_as], [], 0, False
        while i < len(run):
            lead = table.get(run[i], 0)
            size = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            tail = run[i + 1 : i + size]
            got = None
            if size and len(tail) == size - 1:
                # a no-break space that became a space
                codes = [0xA0 if c == " " else table.get(c, 0) for c in tail]
                try:
                    got = bytes([lead, *codes]).decode("utf-8")
                except (UnicodeDecodeError, ValueError):
                    got = None
            if got is None:
                out.append(run[i])
                i += 1
            else:
                out.append(got)
                i += size
                any_found = True
        return "".join(out) if any_found else None

    def undone(self, before: str, run: str, after: str) -> list[tuple[int, str, float]]:
        """The inverse mappings that make the run between its neighbours no less probable: number of the mapping, result, gain."""
        key = before, run, after
        if (known := self.memo.get(key)) is not None:
            return known
        out, was = [], self.likelihood(before + run + after, len(before), len(before) + len(run))
        for k, kind in enumerate((*READ_AS, *SINGLE)):
            fixed = self.utf8(run, kind) if isinstance(kind, str) else "".join(self.single[kind].get(c, c) for c in run)
            if fixed is None or fixed == run:
                continue
            gain = self.likelihood(before + fixed + after, len(before), len(before) + len(fixed)) - was
            if gain >= SAME_GAIN:
                out.append((k, fixed, gain))
        if len(self.memo) > 100_000:
            self.memo.clear()
        self.memo[key] = out
        return out

    def repair(self, texts: list[str]) -> list[tuple[str, bool]]:
        """Each text with wrong decodings undone, and whether it was damaged.

        One mapping is chosen for a text: the one with the largest gain over
        all of its runs.  That is repeated until nothing gains, as text may be
        damaged more than once.
        """
        done, damaged = list(texts), [False] * len(texts)
        left = list(range(len(texts)))
        while left:
            again = []
            for i, runs in zip(left, self.runs([done[i] for i in left])):
                text = done[i]
                damaged[i] |= any(_BROKEN.search(text, s, e) for s, e in runs)
                pieces = []
                for m in _CLUSTER.finditer(text) if runs else ():
                    for s, e in runs:
                        lo, hi = max(s, m.start()), min(e, m.end())
                        if lo < hi and text[lo:hi].strip(LOST):
                            hi += hi < len(text) and text[hi] == " " and text[hi - 1] in "ÃÂГ"
                            pieces.append((lo, hi))
                gains: dict[int, list] = {}
                for lo, hi in pieces:
                    for k, fixed, gain in self.undone(text[max(0, lo - 1) : lo], text[lo:hi], text[hi : hi + 1]):
                        gains.setdefault(k, []).append((gain, lo, hi, fixed))
                sure = {k: sum(g[0] for g in found) for k, found in gains.items() if max(found)[0] >= LEAST_GAIN}
                best = max(sure, key=lambda k: (sure[k], -k), default=None)
                if best is None or sure[best] <= 0:
                    continue
                for _, lo, hi, fixed in reversed(gains[best]):
                    text = text[:lo] + fixed + text[hi:]
                done[i], damaged[i] = text, True
                again.append(i)
            left = again
        return list(zip(done, damaged))


def _values(table: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    return table.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.explode(F.array(*pairs)).alias("x")).select("id", "x.field", "x.value").where("value is not null")


def pair_model(values: DataFrame) -> PairModel:
    """The model of the ``value`` column, counted over all rows.

    What comes to the driver are counts of pairs of characters, at most
    1 / SHARE of them whatever the size of the corpus; rarer pairs carry as
    little information as unseen ones.
    """
    counts = cut(
        values.groupBy("value").agg(F.count("*").alias("n"))
        .select("n", F.concat(F.lit("\0"), "value", F.lit("\0")).alias("v"))
        .select("n", F.explode(F.expr("transform(sequence(1, length(v) - 1), i -> substring(v, i, 2))")).alias("pair"))
        .groupBy("pair").agg(F.sum("n").alias("n"))
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    return PairModel({(r[0][0], r[0][1]): r[1] for r in counts.where(F.col("n") >= total * SHARE).toLocalIterator() if len(r[0]) == 2})


def _repaired(distinct: DataFrame, fitted: PairModel) -> DataFrame:
    model = distinct.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            found = [(v, r) for v, (r, damaged) in zip(values, model.value.repair(values)) if damaged]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in found], pa.string()), pa.array([r for _, r in found], pa.string())], ["value", "repaired"])

    # values are few bytes but much work: their number of tasks isn't left to their size
    tasks = 3 * distinct.sparkSession.sparkContext.defaultParallelism
    return distinct.repartition(tasks, "value").mapInArrow(run, "value string, repaired string")


def repair_fields(table: DataFrame, key: str = "document_id", fields: tuple[str, ...] = ("title", "commune")) -> DataFrame:
    """The damaged values of ``fields`` and their original text where it can be recovered.

    Gives ``id``, ``field``, ``value``, ``repaired`` and ``recovered`` (false
    where a replacement or control character is left), one row for each
    distinct combination.  Characters lost for good are filled in from the most
    frequent word of the corpus that agrees in all others.  Nulls and empty
    texts aren't damaged.  Every distinct value is looked at once.
    """
    values = _values(table, key, fields)
    distinct = values.where(F.col("value").rlike(r"[^\x00-\x7F]")).select("value").distinct()
    # frequent damage looks probable; so the model is fitted again on what the first one repaired
    first = cut(_repaired(distinct, pair_model(values)))
    text = values.join(first, "value", "left").select(F.coalesce("repaired", "value").alias("value"))
    damaged = cut(_repaired(distinct, pair_model(text)))
    word = F.explode(F.split("text", " ")).alias("word")
    masked = F.regexp_replace("word", r"[^\x00-\x7F]", LOST).alias("mask")
    lost = damaged.where(F.col("repaired").contains(LOST)).select("value", F.posexplode(F.split("repaired", " ")).alias("i", "word"))
    known = (
        values.where(~F.col("value").contains(LOST)).select(F.col("value").alias("text")).select(word)
        .where(F.col("word").rlike(r"[^\x00-\x7F]")).groupBy("word").agg(F.count("*").alias("n"))
        .select("word", "n", masked).groupBy("mask").agg(F.max_by("word", F.struct("n", "word")).alias("best"))
    )
    filled = (
        lost.select("value", "i", "word", F.when(F.col("word").contains(LOST), F.col("word")).alias("mask"))
        .join(known, "mask", "left")
        .groupBy("value").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("best", "word").alias("w")))).alias("ws"))
        .select("value", F.array_join("ws.w", " ").alias("filled"))
    )
    done = damaged.join(filled, "value", "left").select("value", F.coalesce("filled", "repaired").alias("repaired"))
    return (
        values.distinct().join(done, "value")
        .select("id", "field", "value", "repaired", (~F.col("repaired").rlike("[�\u0080-\u009f]")).alias("recovered"))
    )


def damaged_fields(metadata: DataFrame) -> DataFrame:
    """p1_found: the damaged titles and municipality names."""
    return repair_fields(metadata).select(F.col("id").alias("document_id"), "field").distinct()
