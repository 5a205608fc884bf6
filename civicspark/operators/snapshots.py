"""Differences between consecutive full snapshots of a keyed table.

The difference is found with invertible Bloom lookup tables.  Every row of a
snapshot becomes a pair (key hash, state hash) that is put into a few cells of
the table of its hash bucket; a snapshot counts ``+1`` against the snapshot
before it and ``-1`` against the one after it, so rows that did not change
cancel out in the map-side combine.  What is shuffled is therefore as large as
the cell tables, not as the snapshots.  Buckets whose difference can be peeled
are done; the others are built again with more cells, until none is left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicspark.session import cut

#: A key sits in this many cells of its bucket's table, one in each third.
HASHES = 3
#: Keys of one snapshot that share a bucket, on average.
BUCKET_KEYS = 2048
#: Cells of each third in the first attempt; every further attempt has four times as many.
FIRST_CELLS = 256


def etag_value(tag: Column) -> Column:
    """An entity tag without weak mark, quotes and compression suffix; blank becomes null."""
    bare = F.regexp_replace(F.trim(tag), r"^(?i:w/)", "")
    bare = F.regexp_replace(bare, r'^"+|"+$', "")
    bare = F.regexp_replace(bare, r"(?i)[-;:](gzip|br|deflate|zstd|df)$", "")
    bare = F.regexp_replace(bare, r'^"+|"+$', "")
    return F.when(F.trim(bare) != "", F.trim(bare))


def http_instant(text: Column) -> Column:
    """The instant in ``text`` in epoch seconds, null where it can't be read.

    Reads the three HTTP date forms and ISO 8601 with any offset.  The parts
    are picked out by pattern and put together again, so neither the session's
    time zone nor its parser policy matters.
    """
    value = F.regexp_replace(F.trim(text), r"\s+", " ")
    months = F.create_map(
        *[x for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1) for x in (F.lit(m), F.lit(f"{i:02d}"))]
    )
    http = r"^(?:\w+, )?(\d{1,2})[ -](\w{3})\w*[ -](\d{2,4}) (\d{2}):(\d{2}):(\d{2})(?: (?:GMT|UTC|Z))?$"
    ansi = r"^\w{3} (\w{3}) (\d{1,2}) (\d{2}):(\d{2}):(\d{2})(?: (?:GMT|UTC))? (\d{4})$"
    iso = r"^(\d{4})-(\d{2})-(\d{2})[Tt ](\d{2}):(\d{2}):(\d{2})(?:\.\d+)? ?(Z|z|[+-]\d{2}:?\d{2}|GMT|UTC)?$"
    part = F.regexp_extract

    def seconds(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
        day = F.try_to_date(F.concat_ws("-", y, mo, F.lpad(d, 2, "0")), "yyyy-MM-dd")
        return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400 + h.cast("long") * 3600 + mi.cast("long") * 60 + s.cast("long")

    year = part(value, http, 3)
    year = F.when(F.length(year) == 2, F.concat(F.when(year.cast("int") < 70, "20").otherwise("19"), year)).otherwise(year)
    zone = part(value, iso, 7)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    offset = F.when(
        F.length(digits) == 4,
        F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1)) * (F.substring(digits, 1, 2).cast("long") * 3600 + F.substring(digits, 3, 2).cast("long") * 60),
    ).otherwise(F.lit(0))
    return (
        F.when(value.rlike(http), seconds(year, months[F.lower(part(value, http, 2))], part(value, http, 1), part(value, http, 4), part(value, http, 5), part(value, http, 6)))
        .when(value.rlike(ansi), seconds(part(value, ansi, 6), months[F.lower(part(value, ansi, 1))], part(value, ansi, 2), part(value, ansi, 3), part(value, ansi, 4), part(value, ansi, 5)))
        .when(value.rlike(iso), seconds(part(value, iso, 1), part(value, iso, 2), part(value, iso, 3), part(value, iso, 4), part(value, iso, 5), part(value, iso, 6)) - offset)
    )


def snapshot_states(rows: DataFrame, snapshot: str, key: str, values: dict[str, Column], order: Column) -> DataFrame:
    """One row for each snapshot and key, with the last known value of each column.

    ``values`` names the compared columns.  Rows repeated in a snapshot count
    once: of each column the value seen last, by ``order``, that isn't null.
    A null says nothing: within a run of snapshots that hold the key without a
    gap, the value known before is carried on, and the first value known holds
    for the snapshots before it.  A key that comes back after a gap starts anew.
    Rows with a null snapshot or key are left out.

    This is the one grouping by key that can't be saved: repeated rows would
    not cancel out in the tables of ``snapshot_changes``, and a missing value
    is only known from the key's other snapshots.  A window holds no more than
    a key's history, as long as the number of snapshots.
    """
    names = list(values)
    seen = rows.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull()).select(
        F.col(snapshot).alias("snapshot"), F.col(key).alias("key"), order.alias("at"), *[values[n].alias(n) for n in names]
    )
    once = seen.groupBy("key", "snapshot").agg(
        *[F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.struct("at", n))).alias(n) for n in names]
    )
    by_key = Window.partitionBy("key").orderBy("snapshot")
    runs = once.withColumn("run", F.col("snapshot") - F.row_number().over(by_key))
    before = Window.partitionBy("key", "run").orderBy("snapshot").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("key", "run").orderBy("snapshot").rowsBetween(0, Window.unboundedFollowing)
    filled = [F.coalesce(F.last(n, ignorenulls=True).over(before), F.first(n, ignorenulls=True).over(after)).alias(n) for n in names]
    return runs.select("snapshot", "key", *filled)


def _place(i: int, cells: int) -> Column:
    """The cell of a pair in the i-th third: twenty bits of its hash each.

    The state counts too: else the two states of a changed key would share
    their cells, where no pair is ever alone.
    """
    return (F.shiftrightunsigned(F.col("key_hash").bitwiseXOR(F.col("state_hash")), 20 * i).bitwiseAND(F.lit(0xFFFFF)) % cells + i * cells).cast("int")


def _check(key: Column, state: Column) -> Column:
    """A digest of a key-hash pair that isn't linear under exclusive or; products stay below 2^62."""
    low = F.lit(0x7FFFFFFF)
    return (key.bitwiseAND(low) * state.bitwiseAND(low)).bitwiseXOR(F.shiftrightunsigned(key, 33) * F.shiftrightunsigned(state, 33))


def _cells(states: DataFrame, cells: int) -> DataFrame:
    """The cell tables of all pairs of consecutive snapshots, already subtracted."""
    return (
        states.select("pair", "sign", "bucket", "key_hash", "state_hash", F.explode(F.array(*[_place(i, cells) for i in range(HASHES)])).alias("cell"))
        .groupBy("pair", "bucket", "cell")
        .agg(
            F.sum("sign").cast("int").alias("n"),
            F.bit_xor("key_hash").alias("keys"),
            F.bit_xor("state_hash").alias("states"),
            F.bit_xor(_check(F.col("key_hash"), F.col("state_hash"))).alias("checks"),
        )
        .where("n <> 0 or keys <> 0 or states <> 0 or checks <> 0")
    )


def _peeler(cells: int):
    """A function that peels the cell table of one bucket of one pair.

    It gives a row for each recovered key-hash pair, or a single one with
    ``ok`` false if cells are left over.
    """

    def places(pair: int) -> list[int]:
        return [((pair & (2**64 - 1)) >> (20 * i) & 0xFFFFF) % cells + i * cells for i in range(HASHES)]

    def digest(key: int, state: int) -> int:
        low = 0x7FFFFFFF
        return ((key & low) * (state & low)) ^ (((key & (2**64 - 1)) >> 33) * ((state & (2**64 - 1)) >> 33))

    def peel(table: pd.DataFrame) -> pd.DataFrame:
        pair, bucket = int(table["pair"].iat[0]), int(table["bucket"].iat[0])
        left = {c: x for c, *x in zip(*[table[k].tolist() for k in ("cell", "n", "keys", "states", "checks")])}
        out, queue = [], list(left)
        while queue:
            cell = left.get(queue.pop())
            if cell is None or cell[0] not in (1, -1) or digest(cell[1], cell[2]) != cell[3]:
                continue
            n, key, state, check = cell
            out.append((pair, bucket, key, state, n, True))
            for p in places(key ^ state):
                c = left.setdefault(p, [0, 0, 0, 0])
                c[:] = [c[0] - n, c[1] ^ key, c[2] ^ state, c[3] ^ check]
                if any(c):
                    queue.append(p)
                else:
                    del left[p]
        if left:
            out = [(pair, bucket, 0, 0, 0, False)]
        return pd.DataFrame(out, columns=["pair", "bucket", "key_hash", "state_hash", "sign", "ok"])

    return peel


PEELED = "pair int, bucket long, key_hash long, state_hash long, sign int, ok boolean"
#: Recovered pairs are sent to the states they belong to if there are at most so many (about 40 bytes each).
BROADCAST_PAIRS = 200_000


def snapshot_changes(states: DataFrame, first_cells: int = FIRST_CELLS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Added, removed and changed keys between consecutive snapshots.

    ``states`` has one row for each ``snapshot`` (integers) and ``key``; its
    other columns are the compared state (see ``snapshot_states``).  The result
    has ``snapshot`` (the later of the two), ``key`` and ``change_type``.
    Snapshots count as consecutive if their numbers are; the first one has no
    changes.  An empty table gives no rows.
    """
    values = [c for c in states.columns if c not in ("snapshot", "key")]
    hashed = cut(
        states.select(
            F.col("snapshot").cast("int").alias("snapshot"), "key",
            F.xxhash64("key").alias("key_hash"),
            F.xxhash64(F.lit(0), *[F.struct(F.col(c).isNull(), F.col(c)) for c in values]).alias("state_hash"),
        )
    )
    sizes = hashed.agg(F.min("snapshot"), F.max("snapshot"), F.count("*")).first()
    low, high, rows = sizes
    buckets = 1 if not rows else max(1, -(-rows // ((high - low + 1) * bucket_keys)))
    signed = hashed.select(
        F.explode(
            F.array(
                F.struct(F.col("snapshot").alias("pair"), F.lit(1).alias("sign")),
                F.struct((F.col("snapshot") + 1).alias("pair"), F.lit(-1).alias("sign")),
            )
        ).alias("x"),
        F.pmod(F.xxhash64("key_hash", F.lit("bucket")), F.lit(buckets)).alias("bucket"),
        "key_hash", "state_hash",
    ).select("x.*", "bucket", "key_hash", "state_hash").where(F.col("pair").between(F.lit((low or 0) + 1), F.lit(high or 0)))
    cells, parts = first_cells + 1, []
    while True:
        peeled = cut(_cells(signed, cells).groupBy("pair", "bucket").applyInPandas(_peeler(cells), PEELED))
        parts.append(peeled.where("ok"))
        failed = peeled.where("not ok").select("pair", "bucket")
        if failed.isEmpty():
            break
        if cells > 1 << 18:
            raise RuntimeError("a bucket's difference can't be peeled; raise the number of buckets")
        signed, cells = signed.join(failed, ["pair", "bucket"], "left_semi"), cells * 4 + 1
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.select("pair", "sign", "key_hash", "state_hash", (F.col("pair") - F.when(F.col("sign") < 0, 1).otherwise(0)).alias("snapshot"))
    recovered = found.count()
    if recovered <= BROADCAST_PAIRS:
        found = F.broadcast(found)
    known = cut(hashed.join(found, ["snapshot", "key_hash", "state_hash"]))
    if known.count() < recovered:
        raise RuntimeError("a recovered pair of hashes belongs to no row")
    return (
        known.groupBy(F.col("pair").alias("snapshot"), "key")
        .agg(F.max("sign").alias("last"), F.min("sign").alias("first"))
        .select(
            "snapshot", "key",
            F.when(F.col("first") > 0, "added").when(F.col("last") < 0, "removed").otherwise("changed").alias("change_type"),
        )
    )


def inventory_changes(inventory: DataFrame) -> DataFrame:
    """Changes between the listings of ``site_inventory``, see ``snapshot_changes``.

    A document changed if its entity tag or its modification instant differs
    from the last known one; spellings of the same tag or instant are equal.
    """
    states = snapshot_states(
        inventory, "snapshot_no", "pdf_url",
        {"tag": etag_value(F.col("etag")), "modified": http_instant(F.col("last_modified"))},
        F.col("last_checked"),
    )
    return snapshot_changes(states).select(F.col("snapshot").alias("snapshot_no"), F.col("key").alias("pdf_url"), "change_type")
