"""Passages of evaluation items inside a corpus.

Texts are reduced to streams of letters and digits.  The character q-grams a
text shares with an item are counted in overlapping diagonal bands; by the
q-gram lemma a region that holds the wanted words with at most ``edits``
errors shares at least ``length - q + 1 - q * edits`` of them in one band.
Windows of words below that bound are dropped, the others are verified by
banded alignment, all windows of a batch together.  Where the words have to be
the same, runs of equal words are taken from the windows that were verified.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.session import spread

#: Length of the q-grams.
Q = 14
#: Characters of items that are held against the corpus at a time; more are taken in blocks.
BLOCK_CHARS = 4_000_000
#: Errors that a window of words may hold for the filter and the alignment; where changed passages are asked for, NEAR.
EDITS, NEAR = 1, 2
#: Shared q-grams that are looked at at a time; batches with more are cut in halves, by documents and then by items.
MOST_HITS = 4_000_000
#: Bits of the table that sorts out q-grams no item has.
FILTER_BITS = 22

_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u20d0-\u20ff]+")
_WORD = re.compile(r"[^\W_]+")
_LETTERS = {"œ": "oe", "æ": "ae", "ß": "ss", "ø": "o", "đ": "d", "ł": "l", "ı": "i"}


def stream(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The letters and digits of ``text`` in lower case without accents, and where its words begin and end.

    Words are runs of letters and digits; letters outside ASCII that have no
    base letter are kept as their UTF-8 bytes.
    """
    plain = text.lower()
    if not plain.isascii():
        for letter, base in _LETTERS.items():
            plain = plain.replace(letter, base)
        plain = _MARKS.sub("", unicodedata.normalize("NFKD", plain))
    words = _WORD.findall(plain)
    joined = "".join(words)
    if not joined.isascii():
        words = [w.encode() for w in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    return joined.encode(), ends - sizes, ends


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q-gram at each position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(q):
            out = out * np.uint64(0x9E3779B97F4A7C15) + wide[i : i + n]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def banded_distances(a: list[bytes], b: list[bytes], width: int, edits: int) -> np.ndarray:
    """For each i the least number of edits between ``a[i]`` and a part of ``b[i]``, or ``edits + 1`` if there are more.

    Only cells up to ``width`` beyond the diagonal are computed: ``b[i]`` holds
    what may align with ``a[i]``, from ``edits`` before its first character to
    ``width - edits`` behind its last one.
    """
    n, long = len(a), max(map(len, a), default=0)
    far = edits + 1
    pattern = np.zeros((n, long), np.uint8)
    text = np.full((n, long + width + 1), 255, np.uint8)
    for i, (x, y) in enumerate(zip(a, b)):
        pattern[i, : len(x)] = np.frombuffer(x, np.uint8)
        y = y[: long + width + 1]
        text[i, : len(y)] = np.frombuffer(y, np.uint8)
    sizes, steps = np.array([len(x) for x in a]), np.arange(width + 1)
    # row[i, k] is the cost of aligning the first r characters of a[i] with a part of b[i] that ends before character r + k
    row = np.zeros((n, width + 1), np.int16)
    out = np.full(n, far)
    for r in range(long):
        out[sizes == r] = row[sizes == r].min(1) if (sizes == r).any() else 0
        best = row + (text[:, r : r + width + 1] != pattern[:, r : r + 1])
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(best - steps, 1) + steps
    out[sizes == long] = row[sizes == long].min(1)
    return np.minimum(out, far)


class Items:
    """The q-grams of all parts of the items, sorted by their hash."""

    def __init__(self, parts: list[tuple[int, str]], words: int, edits: int):
        self.words, self.edits = words, edits
        self.ids, self.texts, self.starts, self.ends, self.bound = [], [], [], [], []
        offsets, at = [], 0
        for item, text in parts:
            s, start, end = stream(text)
            if len(start) < words:
                continue
            least = int((end[words - 1 :] - start[: len(start) - words + 1]).min())
            self.ids.append(item)
            self.texts.append(s)
            self.starts.append(start)
            self.ends.append(end)
            self.bound.append(max(1, least - Q + 1 - Q * edits))
            offsets.append(at)
            at += len(s) + 1
        self.offsets = np.array(offsets, np.int64)
        hashes = _grams(np.frombuffer(b"\0".join(self.texts), np.uint8), Q) if self.texts else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], order.astype(np.int64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray, parts: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the texts hold a q-gram of the parts, the first of its places in the sorted q-grams, and how many there are."""
        at = np.flatnonzero(self.filter[(grams & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        low, high = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
        if parts != (0, len(self.ids)):
            # places of a q-gram are in order
            first, last = self.offsets[parts[0]], self.offsets[parts[1]] if parts[1] < len(self.ids) else len(self.places)
            inside = np.concatenate([[0], np.cumsum((self.places >= first) & (self.places < last))])
            before = np.concatenate([[0], np.cumsum(self.places < first)])
            skip = before[high] - before[low]
            low, high = low + skip, low + skip + inside[high] - inside[low]
        keep = high > low
        return at[keep], low[keep], (high - low)[keep]

    def find(self, texts: list[str], exact: bool = True, parts: tuple[int, int] | None = None) -> list[tuple[int, int, int]]:
        """(text number, item id, words) of the passages found; words is the length of the longest, or the number asked for where errors are permitted."""
        if not len(self.hashes) or not texts:
            return []
        parts = parts or (0, len(self.ids))
        streams = [stream(t) for t in texts]
        codes = np.frombuffer(b"\0".join(s for s, _, _ in streams), np.uint8)
        begin = np.cumsum([0] + [len(s) + 1 for s, _, _ in streams])[:-1]
        at, low, many = self.hits(_grams(codes, Q), parts)
        if not len(at):
            return []
        if many.sum() > MOST_HITS and (len(texts) > 1 or parts[1] - parts[0] > 1):
            half, middle = len(texts) // 2, sum(parts) // 2
            if half:
                return self.find(texts[:half], exact, parts) + [(d + half, i, w) for d, i, w in self.find(texts[half:], exact, parts)]
            found = self.find(texts, exact, (parts[0], middle)) + self.find(texts, exact, (middle, parts[1]))
            return [(0, i, max(w for _, j, w in found if j == i)) for i in {j for _, j, _ in found}]
        pos = np.repeat(at, many)
        place = self.places[np.repeat(low, many) + np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many)]
        doc = np.searchsorted(begin, pos, "right") - 1
        part = np.searchsorted(self.offsets, place, "right") - 1
        # documents and parts that share too few q-grams in all
        pair = doc * len(self.ids) + part
        _, of, shared = np.unique(pair, return_inverse=True, return_counts=True)
        keep = shared[of] >= np.array(self.bound)[part]
        if not keep.any():
            return []
        pos, place, doc, part = pos[keep], place[keep], doc[keep], part[keep]
        pos, place = pos - begin[doc], place - self.offsets[part]
        # bands as wide as two times the edits, overlapping by half
        diagonal = pos - place
        step = max(1, self.edits)
        shift = diagonal.min()
        windows: list[tuple] = []
        bands: dict[tuple, np.ndarray] = {}
        for half in range(2 if self.edits else 1):
            band = (diagonal - shift + half * step) // (2 * step if self.edits else 1)
            order = np.lexsort((place, band, part, doc))
            key = np.stack([doc[order], part[order], band[order]])
            edge = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
            size = np.diff(np.r_[edge, len(order)])
            bound = np.array(self.bound)[key[1, edge]]
            for e, n in zip(edge[size >= bound], size[size >= bound]):
                d, p, rows = int(key[0, e]), int(key[1, e]), order[e : e + n]
                shared = np.unique(place[rows])
                a, b = self.starts[p][: len(self.starts[p]) - self.words + 1], self.ends[p][self.words - 1 :]
                # q-grams shared within each window of words
                count = np.searchsorted(shared, b - Q, "right") - np.searchsorted(shared, a, "left")
                kept = np.flatnonzero(count >= np.maximum(1, b - a - Q + 1 - Q * self.edits))
                if len(kept):
                    bands[d, p, half, int(key[2, e])] = rows
                    windows += [(d, p, half, int(key[2, e]), int(a[i]), int(b[i]), int(diagonal[rows].min()), int(diagonal[rows].max())) for i in kept]
        out: dict[tuple[int, int], int] = {}
        for lo in range(0, len(windows), 4000):
            some = windows[lo : lo + 4000]
            width = 2 * self.edits + max(w[7] - w[6] for w in some)
            near = [streams[w[0]][0][max(0, w[4] + w[6] - self.edits) : w[5] + w[7] + self.edits] for w in some]
            # a window that would begin before the text is moved to its beginning
            near = [b"\xfe" * max(0, self.edits - w[4] - w[6]) + x for w, x in zip(some, near)]
            distance = banded_distances([self.texts[w[1]][w[4] : w[5]] for w in some], near, width, self.edits)
            for key in {w[:4] for w, x in zip(some, distance) if x <= self.edits}:
                d, p, rows = key[0], key[1], bands[key]
                words = max(self._equal(streams[d], p, int(x), pos[rows[diagonal[rows] == x]]) for x in np.unique(diagonal[rows])) if exact else self.words
                if words >= self.words:
                    k = (d, self.ids[p])
                    out[k] = max(out.get(k, 0), words)
        return [(d, i, w) for (d, i), w in out.items()]

    def _equal(self, text: tuple, part: int, diagonal: int, pos: np.ndarray) -> int:
        """Whole words of the longest run that is equal along the diagonal."""
        _, text_start, text_end = text
        best = 0
        pos = np.unique(pos)
        for run in np.split(pos, np.flatnonzero(np.diff(pos) > 1) + 1):
            a, b = run[0], run[-1] + Q
            start, end = self.starts[part] + diagonal, self.ends[part] + diagonal
            first = np.flatnonzero((start >= a) & np.isin(start, text_start))
            last = np.flatnonzero((end <= b) & np.isin(end, text_end))
            if len(first) and len(last):
                best = max(best, int(last[-1] - first[0] + 1))
        return best


def leaked_items(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    parts: tuple[str, ...] = ("question", "passage"), words: int = 16, edits: int = EDITS, exact: bool = True,
) -> DataFrame:
    """The documents that contain ``words`` consecutive words of a part of an item.

    Gives ``doc_id``, ``item_id`` and ``words``, one row for each pair.  Passages
    are searched with at most ``edits`` inserted, left out or replaced
    characters in ``words`` words.  With ``exact`` those are kept that hold so
    many equal words in a row, and ``words`` is the length of the longest run;
    without, ``words`` is the number asked for.
    Case, accents, punctuation, spacing and line breaks don't count.  Null and
    empty texts and parts contain nothing; a part shorter than ``words`` can't
    be found.  Items are held against the corpus in blocks of bounded size, so
    any number of them can be given; all of a document's text is looked at.
    """
    spark = documents.sparkSession
    given = items.select(F.col(item_id).cast("long").alias("item_id"), *[F.col(p).cast("string").alias(f"p{i}") for i, p in enumerate(parts)]).where("item_id is not null")
    size = given.agg(F.sum(sum((F.coalesce(F.length(f"p{i}"), F.lit(0)) for i in range(len(parts))), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    texts = spread(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null"))
    out = None
    for block in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Items([(r[0], t) for r in rows for t in r[1:] if t], words, edits))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    part = batch.slice(lo, 1000)
                    found = shared.value.find(part.column(1).to_pylist(), exact)
                    ids = part.column(0)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32())],
                        ["doc_id", "item_id", "words"],
                    )

        part = texts.mapInArrow(run, "doc_id long, item_id long, words int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def leaked_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p8_found: the pairs of document and item."""
    return leaked_items(documents, items).select("doc_id", "item_id")


def near_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs of document and item where 16 words agree up to ``NEAR`` characters: passages that were changed a little."""
    return leaked_items(documents, items, edits=NEAR, exact=False).select("doc_id", "item_id")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """For each item that leaked: in how many documents, and the longest passage in words."""
    found = leaked_items(documents, items)
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))
