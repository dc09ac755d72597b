"""Documents packed into containers of a fixed number of tokens: dominance reduction, then best fit.

Packing depends only on sizes, and a size is one of ``capacity`` numbers, so the plan is made on the histogram of
sizes: at most ``capacity`` rows whatever the corpus holds. The documents are then dealt to the planned containers by
their rank among those of their size.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.session import cut, written


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Containers that some optimal packing holds, with multiplicities, and the sizes left over.

    A set with the largest item ``j`` dominates every other feasible set with ``j`` when the others' items can be split
    into groups each no larger than one of its own (Martello and Toth). Sets of up to three items are tried:
    ``{j}`` if nothing fits beside it; ``{j, k}`` with ``k`` the largest that fits, if ``k`` fills the container or no two items
    fit beside ``j``; ``{j, a, b}`` with ``a`` the largest that fits and ``b`` the largest beside both, if no three items fit beside
    ``j`` and every pair that fits has its smaller item within ``b`` or its sum within ``a``.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(*items: int) -> None:
        need: dict[int, int] = defaultdict(int)
        for s in items:
            need[s] += 1
        times = min(left[s] // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))
        fixed.append((items, times))

    def largest(limit: int, used: tuple[int, ...]) -> int | None:
        """The largest size within ``limit`` that is left when ``used`` are taken."""
        i = bisect.bisect_right(sizes, limit) - 1
        while i >= 0 and left[sizes[i]] <= used.count(sizes[i]):
            i -= 1
        return sizes[i] if i >= 0 else None

    def smallest(k: int, used: tuple[int, ...]) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(k - len(out), left[s] - used.count(s))
            if len(out) >= k:
                break
        return out

    at = len(sizes) - 1
    while at >= 0:
        at = min(at, len(sizes) - 1)
        if at < 0:
            break
        j = sizes[at]
        room = capacity - j
        a = largest(room, (j,))
        if a is None:
            take(j)
            continue
        low = smallest(3, (j,))
        two = len(low) >= 2 and low[0] + low[1] <= room
        three = len(low) >= 3 and sum(low) <= room
        if a == room or not two:
            take(j, a)
            continue
        b = largest(room - a, (j, a)) if not three else None
        if not three and b is not None:
            # the largest smaller item of any pair that fits: it has a partner at least as large
            top, y = None, bisect.bisect_right(sizes, room // 2) - 1
            while y >= 0 and top is None:
                s = sizes[y]
                partner = largest(room - s, (j, s))
                if partner is not None and partner >= s:
                    top = s, partner
                y -= 1
            if top is None or top[0] <= b or top[0] + top[1] <= a and all(x <= b or x + (largest(room - x, (j, x)) or 0) <= a for x in sizes[: bisect.bisect_right(sizes, room // 2)]):
                take(j, a, b)
                continue
        at -= 1
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing with multiplicities: equal items meet equal containers together."""
    by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, items: tuple[int, ...], n: int) -> None:
        if n <= 0:
            return
        if room not in by_room or not by_room[room]:
            bisect.insort(rooms, room)
        by_room[room].append((items, n))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n > 0:
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                items, m = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(i)
                fill = min(room // s, n)  # the fullest container stays the fullest while it has room
                used = min(m, n // fill)
                put(room - fill * s, items + (s,) * fill, used)
                put(room, items, m - used)
                n -= used * fill
            else:
                fill = min(capacity // s, n)
                used = n // fill
                put(capacity - fill * s, (s,) * fill, used)
                n -= used * fill
    return [x for group in by_room.values() for x in group]


def plan_rows(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first_rank, last_rank, first_container, containers): documents of a size, by rank, to containers from 1 on."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    rows, start, container = [], defaultdict(int), 1
    for items, n in fixed + best_fit(rest, capacity):
        for s in set(items):
            k = items.count(s) * n
            rows.append((s, start[s], start[s] + k - 1, container, n))
            start[s] += k
        container += n
    return rows


def token_counter(path: str):
    """A function from texts to token counts, by the public byte-level vocabulary at ``path`` (a ranks file)."""
    import base64

    import tiktoken

    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("plinth", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(enc.encode_ordinary(text))


def token_counts(documents: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens of each document's whole text; NULL and empty texts have 0 tokens. ``tokenizer`` is a path on the driver, whose file Spark gives to the executors."""
    import os

    documents.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import SparkFiles

        n = None
        for b in batches:
            n = n or token_counter(SparkFiles.get(name))
            yield pd.DataFrame({"doc_id": b["i"], "n_tokens": [n(t) if t else 0 for t in b["t"]]})

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(F.col(id_column).alias("i"), F.col(text_column).alias("t")).mapInPandas(count, f"doc_id {kind}, n_tokens long")


def pack(sizes: DataFrame, *, capacity: int = 2048, most_rows: int = 200_000) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, container_id of documents in containers of ``capacity`` tokens.

    ``sizes``: doc_id, n_tokens. A document longer than a container is split into full containers and a remainder, the others
    stay whole. The plan fixes dominating sets and best-fits the rest on the histogram of sizes, at most ``capacity`` rows
    on the driver; the plan goes to every task while it has at most ``most_rows`` rows, else it is joined. NULL, zero and negative sizes come out with one piece of 0 tokens and no container. Documents that occur
    twice are packed twice. Empty input gives an empty result. Runs jobs.
    """
    spark = sizes.sparkSession
    n = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0))
    pieces = sizes.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / capacity).cast("int") - 1))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.least(F.lit(capacity), F.col("n") - F.col("piece").cast("long") * capacity).cast("int").alias("n_tokens"), F.spark_partition_id().alias("part"))
    pieces = cut(pieces)  # ranks below count within these partitions
    per_part = written(pieces.where("n_tokens > 0").groupBy("part", "n_tokens").agg(F.count("*").alias("n")), "sizes")
    histogram = {r[0]: r[1] for r in per_part.groupBy("n_tokens").agg(F.sum("n")).collect()}  # at most `capacity` rows
    made = plan_rows(histogram, capacity) or [(0, 0, -1, 0, 1)]
    plan = spark.createDataFrame(made, "size int, lo long, hi long, container long, n long")
    from pyspark.sql import Window as W

    before = per_part.withColumn("before", F.sum("n").over(W.partitionBy("n_tokens").orderBy("part")) - F.col("n")).select("part", "n_tokens", "before")
    ranked = pieces.withColumn("r", F.row_number().over(W.partitionBy("part", "n_tokens").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["part", "n_tokens"], "left").withColumn("rank", F.col("before") + F.col("r"))
    # a plan row for every block of ranks would be as long as the corpus; a size has a handful of rows, kept in order for one search
    spans = plan.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "container", "n"))).alias("spans"))
    hit = F.element_at(F.filter("spans", lambda s: (s["lo"] <= F.col("rank")) & (s["hi"] >= F.col("rank"))), 1)
    out = ranked.join(F.broadcast(spans) if len(made) <= most_rows else spans, F.col("n_tokens") == F.col("size"), "left").withColumn("s", F.when(F.col("spans").isNotNull(), hit))
    return out.select("doc_id", "piece", "first_token", "n_tokens", (F.col("s.container") + (F.col("rank") - F.col("s.lo")) % F.col("s.n")).alias("container_id"))
