"""Missing values filled by label propagation over group and similarity edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.session import written

#: The compass directions, in the order used for distributions.
COMPASS = ["North", "North-East", "East", "South-East", "South", "South-West", "West", "North-West"]


def compass(c: Column) -> Column:
    """A compass direction in any spelling as one of ``COMPASS``; NULL for anything else ('No Info', '?', 'nan')."""
    t = F.regexp_replace(F.lower(c), r"facing|direction|[^a-zऀ-ॿ]", "")
    short = {"n": "North", "ne": "North-East", "e": "East", "se": "South-East", "s": "South", "sw": "South-West", "w": "West", "nw": "North-West"}
    hindi = {"उत्तर": "North", "पूर्व": "East", "दक्षिण": "South", "पश्चिम": "West"}
    names = {d.lower().replace("-", ""): d for d in COMPASS} | short | hindi
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.create_map(*pairs)[t]


@dataclass(frozen=True)
class Field:
    """A column to fill. ``valid`` gives its usable value (NULL if missing); ``labels`` are the classes of a categorical field; ``weights`` are the hubs that it takes averages from (all with their own weights if not given)."""

    name: str
    valid: Column
    applies: Column
    labels: tuple[str, ...] = ()
    weights: tuple[tuple[str, float], ...] = ()


def propagate_labels(
    df: DataFrame, key: str, fields: list[Field], hubs: dict[str, tuple[list[Column], float]], *, tolerance: float = 1e-3, rounds: int | None = None, salts: int = 16, small: int = 4 << 20
) -> DataFrame:
    """key, field_name, value_num, value_cat, filled: each field of each row of ``df`` to which it applies.

    Rows are the nodes; rows with equal values of a hub's columns are linked through that hub, so a group of any
    size costs one hub and not its pairs. In each round a hub takes the average of its rows (the
    mean of a numeric field, the class distribution of a categorical one) and each unlabelled row the average of
    its hubs, by weight; observed values stay as they are. Hubs hold observed values and fills alike, so values
    reach groups without any observed row. Rounds go on until a round reaches no further hub and the
    averages that missing values take move by no more than ``tolerance``, relatively and on the mean (or for ``rounds``, if given); a fixed
    share of the distance is left after each round, so both come to an end. What no hub reaches takes the average of all rows.

    ``hubs``: name -> (columns, weight); a hub with a null among its columns does not link its row. The state that rounds work on is the
    table of hubs: sums of observed values are made once, and a round reads only the rows with something missing, looks up their hubs'
    averages (each kind of hub for itself: by broadcast while its averages take at most ``small`` bytes, else by a join salted ``salts``
    times, so that a hub with a third of all rows is no hot key) and adds up their estimates for each hub, partly before the shuffle. Duplicate rows count as often as they
    occur, and a null ``key`` is kept. Fields that are null everywhere come out with filled true and null values. Empty input
    gives an empty result. The names beginning with ``__`` are reserved. Runs jobs.
    """
    fields = [*[f for f in fields if not f.labels], *[f for f in fields if f.labels]]
    names, at = list(hubs), {h: i for i, h in enumerate(hubs)}
    weight = {(f.name, at[h]): w for f in fields for h, w in (f.weights or [(h, w) for h, (_, w) in hubs.items()])}
    rows = df.select(
        F.col(key).alias("__key"),
        *[F.when(~_any_null(cols), F.xxhash64(F.lit(h), *cols)).alias(f"__h{at[h]}") for h, (cols, _) in hubs.items()],
        *[f.valid.alias(f"__v_{f.name}") for f in fields],
        *[F.coalesce(f.applies, F.lit(False)).alias(f"__a_{f.name}") for f in fields],
    )
    rows = written(rows, "fill-rows")
    on = lambda f: F.col(f"__a_{f.name}")
    gone = lambda f: on(f) & F.col(f"__v_{f.name}").isNull()
    #: one slot per number that is averaged: a numeric field has one, a categorical field one per class
    slots = [(f, None) for f in fields if not f.labels] + [(f, x) for f in fields for x in f.labels]
    seen = lambda f, x: F.when(on(f), F.col(f"__v_{f.name}").cast("double") if x is None else F.when(F.col(f"__v_{f.name}").isNotNull(), (F.col(f"__v_{f.name}") == x).cast("double")))

    def totals(x: DataFrame, value: list[Column], s: str, n: str) -> DataFrame:
        """For each hub the sum of each slot (``s``) and the number of values of each field (``n``) that it serves."""
        link = lambda i: F.when(F.col(f"__h{i}").isNotNull(), F.struct(F.col(f"__h{i}").alias("hub"), F.lit(i).alias("i")))
        x = x.select(*[v.alias(f"__x{k}") for k, v in enumerate(value)], F.explode(F.filter(F.array(*[link(i) for i in range(len(names))]), lambda z: z.isNotNull())).alias("__l"))
        serves = lambda f: F.col("__l.i").isin(*[i for i in range(len(names)) if (f.name, i) in weight])
        first = {f.name: k for k, (f, _) in reversed(list(enumerate(slots)))}
        return x.groupBy(F.col("__l.hub").alias("hub"), F.col("__l.i").alias("i")).agg(
            *[F.coalesce(F.sum(F.when(serves(f), F.col(f"__x{k}"))), F.lit(0.0)).alias(f"{s}{k}") for k, (f, _) in enumerate(slots)],
            *[F.count(F.when(serves(f), F.col(f"__x{first[f.name]}"))).alias(f"{n}_{f.name}") for f in fields],
        )

    def estimated(x: DataFrame, state: DataFrame) -> DataFrame:
        """Rows with ``__e<k>``, the weighted average of their hubs in each slot."""
        if len(near) < len(names):
            x = x.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
        for i in sorted(range(len(names)), key=lambda i: i in near):  # the joins that shuffle come first, while rows are narrow
            mine = [k for k, (f, _) in enumerate(slots) if (f.name, i) in weight]
            m = state.where(F.col("i") == i).select(F.col("hub").alias(f"__hub{i}"), *[F.col(f"m{k}").alias(f"__m{i}_{k}") for k in mine])
            same = F.col(f"__h{i}") == F.col(f"__hub{i}")
            if i in near:
                x = x.join(F.broadcast(m), same, "left")
            else:
                m = m.withColumn(f"__at{i}", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
                x = x.join(m, same & (F.col("__salt") == F.col(f"__at{i}")), "left")
        out = {}
        for k, (f, _) in enumerate(slots):
            mine = [(F.col(f"__m{i}_{k}"), w) for (name, i), w in weight.items() if name == f.name]
            top = sum((F.coalesce(m, F.lit(0.0)) * w for m, w in mine), F.lit(0.0))
            out[f"__e{k}"] = F.try_divide(top, F.nullif(sum((F.when(m.isNotNull(), F.lit(float(w))).otherwise(0.0) for m, w in mine), F.lit(0.0)), F.lit(0.0)))
        return x.withColumns(out)

    base = written(totals(rows, [seen(f, x) for f, x in slots], "s", "n"), "fill-observed")
    mean = lambda s, n: F.when(n > 0, s / n)
    #: the kinds of hubs whose averages are broadcast; a hub takes a row of 8 bytes for each slot it serves and for its key, sizes and place in the map
    near = set(range(len(names))) - {i for i, n in base.groupBy("i").count().collect() if n * 8 * (5 + sum((f.name, i) in weight for f, _ in slots)) > small}
    state = written(base.select("hub", "i", *[mean(F.col(f"s{k}"), F.col(f"n_{f.name}")).alias(f"m{k}") for k, (f, _) in enumerate(slots)]), "fill-hubs")
    any_gone = F.lit(False)
    for f in fields:
        any_gone = any_gone | gone(f)
    need, done = rows.where(any_gone), 0
    while rounds is None or done < rounds:
        done += 1
        e = estimated(need, state)
        part = totals(e, [F.when(gone(f), F.col(f"__e{k}")) for k, (f, _) in enumerate(slots)], "t", "c")
        old = state.select("hub", "i", *[F.col(f"m{k}").alias(f"o{k}") for k in range(len(slots))])
        new = base.join(part, ["hub", "i"], "left").join(old, ["hub", "i"])
        now = {k: mean(F.col(f"s{k}") + F.coalesce(f"t{k}", F.lit(0.0)), F.col(f"n_{f.name}") + F.coalesce(f"c_{f.name}", F.lit(0))) for k, (f, _) in enumerate(slots)}
        gaps = [F.when(F.col(f"m{k}").isNull() | F.col(f"o{k}").isNull(), 0.0).otherwise(F.abs(F.col(f"m{k}") - F.col(f"o{k}")) / F.greatest(F.abs(F.col(f"o{k}")), F.lit(0.01))) for k in now]
        waiting = [F.coalesce(f"c_{f.name}", F.lit(0)) for f, _ in slots]  # the missing values that take a hub's average
        reached = sum((F.when(F.col(f"o{k}").isNull() & F.col(f"m{k}").isNotNull(), 1).otherwise(0) for k in now), F.lit(0))
        state = written(new.withColumns({f"m{k}": v for k, v in now.items()}).select("hub", "i", *[f"m{k}" for k in now], sum((g * n for g, n in zip(gaps, waiting, strict=True)), F.lit(0.0)).alias("moved"), sum(waiting, F.lit(0)).alias("waiting"), reached.alias("reached")), "fill-hubs")
        moved, held, first_time = state.agg(F.sum("moved"), F.sum("waiting"), F.sum("reached")).first()
        if not first_time and (moved or 0.0) <= tolerance * (held or 0):
            break
    overall = rows.agg(*[F.avg(seen(f, x)) for f, x in slots]).first()  # one row
    est = [F.coalesce(F.col(f"__e{k}"), F.lit(overall[k]).cast("double")) for k in range(len(slots))]
    k, out = 0, []
    for f in fields:
        v, width = F.col(f"__v_{f.name}"), max(1, len(f.labels))
        if f.labels:
            share = F.array(*est[k : k + width])
            best = F.get(F.array(*[F.lit(x) for x in f.labels]), (F.array_position(share, F.array_max(share)) - 1).cast("int"))
            pair = F.lit(None).cast("double"), F.coalesce(v.cast("string"), best)
        else:
            pair = F.coalesce(v.cast("double"), est[k]), F.lit(None).cast("string")
        out.append(F.when(on(f), F.struct(F.lit(f.name).alias("field_name"), pair[0].alias("value_num"), pair[1].alias("value_cat"), v.isNull().alias("filled"))))
        k += width
    return estimated(rows, state).select(F.col("__key").alias(key), F.inline(F.filter(F.array(*out), lambda x: x.isNotNull())))


def _any_null(cols: list[Column]) -> Column:
    c = F.lit(False)
    for x in cols:
        c = c | x.isNull()
    return c


def fill_property_master(master: DataFrame, **options) -> DataFrame:
    """property_id, field_name, value_num, value_cat, filled for bathrooms, balconies, facing_direction and circle_rate.

    Valid are bathrooms 1 to 12, balconies 0 to 12, a compass direction in any spelling and a positive finite
    circle_rate; anything else is missing. Residential Plots have no bathrooms or balconies. Fills of bathrooms and
    balconies are rounded to whole numbers within their limits. Linked are properties of the same place and kind
    (city, locality, type, bhk), of the same place and time, of one society, and of the same kind and bhk anywhere. Counts of rooms follow
    the last, with a little from their place; rates follow their place and time; directions, which nothing predicts, only the kind.
    """
    ok = lambda c, lo, hi: F.when(~F.isnan(c) & c.between(lo, hi), c)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    built = ~F.coalesce(F.col("property_type") == "Residential Plot", F.lit(False))
    rate = F.col("circle_rate").cast("double")
    rooms = (("kind, bhk", 4.0), ("place, kind, bhk", 1.0))
    fields = [
        Field("bathrooms", ok(F.col("bathrooms").cast("double"), 1, 12), built, (), rooms),
        Field("balconies", ok(F.col("balconies").cast("double"), 0, 12), built, (), rooms),
        Field("circle_rate", F.when(~F.isnan(rate) & (rate > 0) & (rate < float("inf")), rate), F.lit(True), (), (("place, kind, bhk", 4.0), ("place, time", 3.0), ("place", 1.0), ("society", 2.0), ("kind, bhk", 0.1))),
        Field("facing_direction", compass(F.col("facing_direction")), F.lit(True), tuple(COMPASS), (("kind, bhk", 1.0),)),
    ]
    city, loc, kind = blank("city"), blank("locality"), F.col("property_type")
    bhk = F.coalesce(F.col("bhk").cast("string"), F.lit("-"))
    hubs = {
        "place, kind, bhk": ([city, loc, kind, bhk], 4.0),
        "place, time": ([city, loc, F.col("as_of")], 3.0),
        "place": ([city, loc], 1.0),
        "society": ([city, blank("project_society_name")], 2.0),
        "kind, bhk": ([kind, bhk], 0.5),
    }
    out = propagate_labels(master, "property_id", fields, hubs, **options)
    whole = F.least(F.lit(12.0), F.greatest(F.when(F.col("field_name") == "bathrooms", 1.0).otherwise(0.0), F.round("value_num")))
    return out.withColumn("value_num", F.when(F.col("filled") & F.col("value_num").isNotNull() & F.col("field_name").isin("bathrooms", "balconies"), whole).otherwise(F.col("value_num")))
