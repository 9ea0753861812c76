"""Request logs: client address, network allowlist, sliding-window rate limit."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.times import micros
from alertloom import fixed_values as fixed
from alertloom.functions import net
from alertloom.functions.bind import let
from alertloom.operators import series
from alertloom.operators.ordered import part_of

# Intervals of a network table that are sent to every task at most: 80 bytes each.
MAP_INTERVALS = 65_536


def client_address(forwarded_for: Column, real_ip: Column, peer: Column) -> Column:
    """First forwarded address, else the real-address header, else the peer.

    An empty header counts as missing; a header with an empty first item does not.
    """
    blank = F.lit(fixed.STRIPPED_CHARACTERS)
    return (
        F.when(F.length(forwarded_for) > 0, F.btrim(F.split(forwarded_for, ",")[0], blank))
        .when(F.length(real_ip) > 0, F.btrim(real_ip, blank))
        .when(F.length(peer) > 0, peer)
        .otherwise("127.0.0.1")
    )


def is_allowed(address: Column, networks: Sequence[str]) -> Column:
    """Allowlist from job parameters: an expression, no join.

    An empty list, or exactly the two localhost addresses, allows everyone.  An
    unreadable network denies whoever matched none before it.
    """
    if not networks or set(networks) == fixed.LOCALHOST_ONLY:
        return F.lit(True)
    readable, _ = net.valid_networks(networks)
    return net.in_networks(address, readable)


def _numbered(rows: DataFrame, text: Column) -> DataFrame:
    """Adds ``_n`` (IPv4 number), ``_hex`` (IPv6 digits) and ``_family`` of an address; other rows go."""
    rows = rows.withColumns({"_n": net.ipv4_number(text), "_hex": net.ipv6_hex(text)})
    family = F.when(F.col("_n").isNotNull(), 4).when(F.col("_hex").isNotNull(), 6)
    return rows.withColumn("_family", family).where(F.col("_family").isNotNull())


def _ranges_of_networks(networks: DataFrame) -> DataFrame:
    """``_lo`` and ``_hi`` of the readable networks, each once: family and hex digits, ordered as texts."""
    parts = F.split("network", "/")
    rows = _numbered(networks.where(F.size(parts) <= 2).select(parts.alias("_parts")), F.col("_parts")[0])
    stated = F.try_element_at("_parts", F.lit(2))
    longest = F.when(F.col("_family") == 4, 32).otherwise(128)
    # A mask has its ones in front, or all of them at the end.
    mask = net.ipv4_number(stated)
    rest = F.lit(2**32 - 1) - mask
    by_mask = F.when(rest.bitwiseAND(rest + 1) == 0, 32 - F.bit_count(rest)).when(
        mask.bitwiseAND(mask + 1) == 0, 32 - F.bit_count(mask)
    )
    length = (
        F.when(stated.isNull(), longest)
        .when(stated.rlike(r"^[0-9]{1,9}\z"), stated.try_cast("int"))
        .when(F.col("_family") == 4, by_mask)
    )
    rows = rows.withColumn("_length", length.cast("int")).where(F.col("_length").between(0, longest))
    # All digits up to the length as they are, the digit that it cuts by its bits, and the lowest or highest digits behind.
    digits, whole, cut = _digits(), F.floor(F.col("_length") / 4).cast("int"), F.col("_length") % 4
    digit = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    low_bits = F.call_function("shiftleft", F.lit(1), 4 - cut) - 1
    first = digit.bitwiseAND(F.lit(15) - low_bits)

    def end(last: Column, fill: str) -> Column:
        middle = F.when(cut > 0, F.lower(F.hex(last.cast("bigint")))).otherwise("")
        text = F.concat(F.substr(digits, F.lit(1), whole), middle)
        return F.concat(F.col("_family").cast("string"), F.rpad(text, F.length(digits), F.lit(fill)))

    return rows.select(end(first, "0").alias("_lo"), end(first.bitwiseOR(low_bits), "f").alias("_hi")).distinct()


def _digits() -> Column:
    """``_n`` or ``_hex`` as hex digits: 8 or 32."""
    return F.when(F.col("_family") == 4, F.lpad(F.lower(F.hex("_n")), 8, "0")).otherwise(F.col("_hex"))


def interval_map(networks: DataFrame) -> DataFrame:
    """``_lo`` and ``_hi``: disjoint intervals that hold the addresses of all readable networks.

    A sweep along the starts, wide networks first, drops every network that ends within one
    before it.  It runs in parts of equal depth; the furthest end of a part is handed to the
    parts behind it.
    """
    return _swept(_ranges_of_networks(networks))


def _swept(ranges: DataFrame) -> DataFrame:
    rows = ranges.withColumn("_part", part_of(ranges, [F.col("_lo")]))
    ahead = Window.partitionBy("_part").orderBy("_lo", F.desc("_hi")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_reach", F.max("_hi").over(ahead))
    ends = rows.groupBy("_part").agg(F.max("_hi").alias("_end"))
    # A row for each part, 4,096 at most.
    before = F.max("_end").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("_part", before.alias("_before"))
    inside = F.coalesce(F.greatest("_reach", "_before") >= F.col("_hi"), F.lit(False))
    return rows.join(F.broadcast(carried), "_part").where(~inside).select("_lo", "_hi")


def allowed_by_table(requests: DataFrame, networks: DataFrame, address: str) -> DataFrame:
    """Mark requests whose address lies in a network of a table: ``allowed``.

    ``networks``: ``network`` as an IPv4 or IPv6 address with or without a prefix
    length, or an IPv4 one with a mask.  They are flattened into disjoint intervals.  Those of
    up to ``MAP_INTERVALS`` networks go to the tasks as sorted arrays and are found by binary
    search, without a shuffle of requests; those of more are met along the order of addresses,
    in parts of equal depth, where each address looks back to the last start.  An unreadable
    network matches no one, as at the end of the list form; an empty table allows no one.
    """
    ranges = _ranges_of_networks(networks)
    few = ranges.limit(MAP_INTERVALS + 1).collect()
    number, six = net.ipv4_number(F.col(address)), net.ipv6_hex(F.col(address))
    four = F.concat(F.lit("4"), F.lpad(F.lower(F.hex(number)), 8, "0"))
    key = F.when(F.contains(F.col(address), F.lit(":")), F.concat(F.lit("6"), six)).otherwise(four)
    if len(few) <= MAP_INTERVALS:
        spans: list[tuple[str, str]] = []
        for lo, hi in sorted(map(tuple, few), key=lambda r: (r[0], -int(r[1], 16))):
            if not spans or hi > spans[-1][1]:
                spans.append((lo, hi))
        return requests.withColumn("allowed", F.coalesce(let(key, lambda k: _in_map(spans, k)), F.lit(False)))
    asked = requests.select(F.col(address).alias("_address"), key.alias("_at")).where(F.col("_at").isNotNull()).distinct()
    sides = asked.withColumn("_side", F.lit(1)).unionByName(
        _swept(ranges).select(F.col("_lo").alias("_at"), "_hi", F.lit(0).alias("_side")), allowMissingColumns=True
    )
    met = series.carry_forward(sides, [], ["_at", "_side"], F.col("_hi"), "_end")
    found = met.where((F.col("_side") == 1) & (F.col("_at") <= F.col("_end"))).select("_address", F.lit(True).alias("allowed"))
    marked = requests.join(found, F.col(address) == F.col("_address"), "left").drop("_address")
    return marked.withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def _in_map(intervals: list[tuple[str, str]], key: Column) -> Column:
    """Whether ``key`` lies in one of the sorted, disjoint ``intervals``."""
    if not intervals:
        return F.lit(False)
    # One text per side, which Spark turns into an array when it plans.
    los, his = (F.split(F.lit(",".join(side)), ",") for side in zip(*intervals))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(intervals).bit_length()))])
    # How many starts are not behind the key.
    count = F.aggregate(steps, F.lit(0), lambda at, by: F.when(F.get(los, at + by - 1) <= key, at + by).otherwise(at))
    return F.get(his, count - 1) >= key


# --- rate limit --------------------------------------------------------------
#
# A request is accepted if fewer than `limit` requests of its client were
# accepted within the window before it.  Only accepted ones count, so the
# decision depends on earlier decisions.  But a request with fewer than `limit`
# requests of any kind before it in its window is accepted whatever happened.
# Only requests within a window of another ("saturated") one enter the ordered fold;
# they form separate episodes.  A request with no saturated one in its own window
# has only accepted requests there and is decided by window expressions.

DECISION_SCHEMA = "accepted boolean, used bigint, oldest_us bigint"
_CHUNK_WINDOWS = 32


def _near_saturation(requests: DataFrame, client: str, limit: int, window_us: int) -> DataFrame:
    """Mark what the fold must see.

    Adds ``_us``, ``_saturated`` (``limit`` requests stand before it in its
    window), ``_open`` (a saturated one stands in its window: the fold decides),
    ``_busy`` (enters the fold), ``_starts`` (opens an episode) and ``_own``.
    Rows are compared inside time chunks that also hold the rows of three
    windows before and one window after, so a hot client is spread over tasks;
    ``_own`` marks the chunk a row belongs to.  Frames are running or look one
    row back, so the cost of a row does not depend on how busy its client is.
    """
    width = F.lit(_CHUNK_WINDOWS * window_us)
    us = micros("request_ts")
    first, last = F.floor((us - window_us) / width), F.floor((us + 3 * window_us) / width)
    rows = requests.withColumn("_us", us).withColumn("_chunk", F.explode(F.sequence(first, last)))
    rows = rows.withColumn("_own", F.col("_chunk") == F.floor(F.col("_us") / width))
    part = Window.partitionBy(client, "_chunk")
    back = part.orderBy(F.col("_us").desc(), F.col("request_id").desc())
    forth = part.orderBy("_us", "request_id")
    running = (Window.unboundedPreceding, 0)
    saturated_at = F.when(F.col("_saturated"), F.col("_us"))
    rows = rows.withColumn("_saturated", F.coalesce(F.lead("_us", limit).over(back) > F.col("_us") - window_us, F.lit(False)))
    rows = rows.withColumn("_next", F.last(saturated_at, ignorenulls=True).over(back.rowsBetween(*running)))
    rows = rows.withColumn("_past", F.last(saturated_at, ignorenulls=True).over(forth.rowsBetween(*running)))
    rows = rows.withColumn("_open", F.coalesce(F.col("_past") > F.col("_us") - window_us, F.lit(False)))
    rows = rows.withColumn("_busy", F.col("_open") | F.coalesce(F.col("_next") < F.col("_us") + window_us, F.lit(False)))
    before = F.lag(F.struct("_us", "_busy")).over(forth)
    detached = before.isNull() | ~before["_busy"] | (F.col("_us") - before["_us"] >= window_us)
    return rows.withColumn("_starts", F.col("_busy") & detached).drop("_next", "_past")


def _decided_by_counting(rows: DataFrame, client: str, window_us: int) -> DataFrame:
    """``used`` and ``oldest_us`` of requests without a saturated one in their window.

    Among unsaturated requests a window never holds more than the limit.
    """
    part = Window.partitionBy(client, "_chunk")
    in_window = part.orderBy("_us").rangeBetween(-(window_us - 1), 0)
    calm = rows.where(~F.col("_saturated"))
    calm = calm.withColumn("_row", F.row_number().over(part.orderBy("_us", "request_id")))
    calm = calm.withColumn("used", F.col("_row") - F.min("_row").over(in_window) + 1)
    calm = calm.withColumn("oldest_us", F.min("_us").over(in_window))
    return calm.where(F.col("_own") & ~F.col("_open"))


def _fold(client: str, limit: int, window_us: int):
    """Batch iterator that decides rows sorted by client, episode and time.

    State between rows is the accepted times of the window, at most ``limit``.
    """

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, times = None, deque()
        for batch in batches:
            accepted, used, oldest = [], [], []
            for owner, episode, now in zip(batch[client], batch["_episode"], batch["_us"]):
                if (owner, episode) != current:
                    current, times = (owner, episode), deque()
                while times and times[0] <= now - window_us:
                    times.popleft()
                ok = len(times) < limit
                if ok:
                    times.append(now)
                accepted.append(ok)
                used.append(len(times))
                oldest.append(times[0])
            yield batch.assign(accepted=accepted, used=used, oldest_us=oldest)

    return decide


def rate_limit(
    requests: DataFrame, limit: int, window_seconds: int, client: str = "client"
) -> DataFrame:
    """Decide every request: ``accepted``, ``remaining`` and ``reset_at``.

    Input: ``client``, ``request_ts``, unique ``request_id``.  ``remaining`` and
    ``reset_at`` describe the client right after the request.  A limit of 0
    accepts nothing.
    """
    columns = requests.columns
    if limit <= 0:
        return requests.select(
            *columns, F.lit(False).alias("accepted"), F.lit(0).cast("bigint").alias("remaining"),
            F.col("request_ts").alias("reset_at"),
        )
    window_us = window_seconds * 1_000_000
    rows = _near_saturation(requests, client, limit, window_us)
    calm = _decided_by_counting(rows, client, window_us).select(
        *columns, F.lit(True).alias("accepted"), "used", "oldest_us"
    )
    busy = rows.where(F.col("_own") & F.col("_busy")).select(*columns, "_us", "_starts", "_open").withColumn("ts", F.col("request_ts"))
    start = F.when(F.col("_starts"), F.col("request_id"))
    busy = series.carry_forward(busy, [client], ["ts", "request_id"], start, "_episode").drop("ts", "_starts")
    ordered = busy.repartition(client, "_episode").sortWithinPartitions(client, "_episode", "_us", "request_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    decided = ordered.mapInPandas(_fold(client, limit, window_us), f"{schema}, {DECISION_SCHEMA}")
    every = calm.unionByName(decided.where("_open").select(*calm.columns))
    return every.select(
        *columns,
        "accepted",
        (F.lit(limit) - F.col("used")).cast("bigint").alias("remaining"),
        F.timestamp_micros(F.col("oldest_us") + window_us).alias("reset_at"),
    )


def allowlisted(requests: DataFrame, networks: Iterable[str]) -> DataFrame:
    """Split mark for a request log: ``client`` and ``allowed``."""
    address = client_address(F.col("x_forwarded_for"), F.col("x_real_ip"), F.col("peer"))
    return requests.withColumn("client", address).withColumn("allowed", is_allowed(F.col("client"), list(networks)))
