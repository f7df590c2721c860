"""Order books and trades folded from events by windows and aggregates.

A book is a table of live orders or price levels per ``BOOK`` columns and side
(``B`` or ``S``); null prices are market orders. Folds that need an order of
events use ``seq``, which is unique within a book.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOOK = ("book",)


# -- reference data


def bands(ticks: DataFrame, prices: DataFrame, price: str, table: str = "tbl") -> DataFrame:
    """``prices`` with the tick size of the band that holds each price, both ends included; the lowest of several.

    A table's bands are one sorted row of reference data, so prices meet them by
    equality of the table, and the band is found within the row. A band without
    an upper end has no limit. A null price, or one that no band holds, has no
    tick size.
    """
    band = F.struct("min_price", "max_price", "tick_size")
    own = ticks.where("min_price is not null").groupBy(F.col(table).alias("_tbl")).agg(F.array_sort(F.collect_list(band)).alias("_bands"))
    holds = lambda b: (F.col(price) >= b["min_price"]) & (b["max_price"].isNull() | (F.col(price) <= b["max_price"]))
    found = prices.join(own, prices[table] == own["_tbl"], "left")
    return found.select(*prices.columns, F.try_element_at(F.filter("_bands", holds), F.lit(1))["tick_size"].alias("tick_size"))


def by_any_name(rows: DataFrame, named: DataFrame, probe: str, names: Sequence[str]) -> DataFrame:
    """``rows`` with what is known under any of several names, the first name winning."""
    names_of = F.array(*[F.struct(F.lit(i).alias("_rank"), F.col(n).alias("_name")) for i, n in enumerate(names)])
    aliases = named.select("*", F.explode(names_of).alias("_n")).where("_n._name is not null")
    best = aliases.groupBy(F.col("_n._name").alias("_name")).agg(F.min_by(F.struct(*named.columns), "_n._rank").alias("_row"))
    return rows.join(best, rows[probe] == best["_name"]).select(*rows.columns, "_row.*")


def derivatives(instruments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instruments with an underlying joined with it, underlyings that are missing, as non-tradeable instruments)."""
    own = instruments.where("underlying is not null")
    under = instruments.select(F.col("id").alias("underlying"), F.col("symbol").alias("underlying_symbol"))
    missing = own.select(F.col("underlying").alias("id")).distinct().join(instruments.select("id"), "id", "left_anti").withColumn("tradeable", F.lit(False))
    return own.join(under, "underlying", "left"), missing


def find_derivatives(probes: DataFrame, instruments: DataFrame, by: Sequence[str] = ("underlying", "mat", "put_call", "strike")) -> DataFrame:
    """``probes`` with the instruments that have each probe's underlying and maturity, and for options put or call and strike; a null equals itself."""
    left, right = probes.alias("probe"), instruments.alias("row")
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"probe.{c}").eqNullSafe(F.col(f"row.{c}"))
    return left.join(right, same, "left").select("probe.*", *[F.col(f"row.{c}") for c in instruments.columns if c not in probes.columns])


def rescaled(rows: DataFrame, columns: Sequence[str], ndp: str, new_ndp: str) -> DataFrame:
    """Mantissas brought from ``ndp`` to ``new_ndp`` places, cut where those are fewer; ``ndp`` then holds the new number. A null keeps the old one."""
    to = F.coalesce(F.col(new_ndp), F.col(ndp))
    step = F.pow(F.lit(10.0), F.abs(to - F.col(ndp))).cast("bigint")
    change = lambda c: F.when(to >= F.col(ndp), F.col(c) * step).otherwise(F.call_function("div", F.col(c), step))
    return rows.withColumns({c: change(c).cast("bigint") for c in columns}).withColumn(ndp, to).drop(new_ndp)


def exposure(positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long, short, net and gross quantity of positions (side, qty) rolled up to ``keys``."""
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("qty"))), F.lit(0))
    sums = positions.groupBy(*keys).agg(of("B").alias("long_qty"), of("S").alias("short_qty"))
    return sums.withColumn("net_qty", F.col("long_qty") - F.col("short_qty")).withColumn("gross_qty", F.col("long_qty") + F.col("short_qty"))


def order_key(scope: str = "scope", order_id: str = "order_id", book: str = "book", side: str = "side") -> Column:
    """The key of an order under its venue's scope of ids: venue, order book, or side of one."""
    return F.when(F.col(scope) == "venue", F.concat_ws("/", "venue", order_id)).when(F.col(scope) == "book", F.concat_ws("/", "venue", book, order_id)).otherwise(F.concat_ws("/", "venue", book, side, order_id))


def legs(combinations: DataFrame, instruments: DataFrame) -> DataFrame:
    """One row per leg of each combination (arrays ``leg_ids``, ``sides``, ``ratios``), joined with its instrument."""
    each = combinations.select(*[c for c in combinations.columns if c not in ("leg_ids", "sides", "ratios")], F.posexplode(F.arrays_zip("leg_ids", "sides", "ratios")).alias("leg", "_z"))
    flat = each.select("*", F.col("_z.leg_ids").alias("leg_id"), F.col("_z.sides").alias("side"), F.col("_z.ratios").alias("ratio")).drop("_z")
    return flat.join(instruments.withColumnRenamed("id", "leg_id"), "leg_id", "left")


def hierarchical(rows: DataFrame, wanted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that an entry of ``wanted`` names; nulls on an entry's right stand for any value, and no entries let all pass.

    Each depth of entry is one semi-join by equality; a row that several depths
    name is kept once, as the shallower depths see what the deeper ones left.
    """
    if wanted.isEmpty():
        return rows
    kept, rest = None, rows
    for n in range(len(columns), 0, -1):
        named = F.lit(True)
        for i, c in enumerate(columns):
            named = named & (F.col(c).isNotNull() if i < n else F.col(c).isNull())
        level = wanted.where(named).select(*columns[:n]).distinct()
        part = rest.join(level, list(columns[:n]), "left_semi")
        kept = part if kept is None else kept.unionByName(part)
        rest = rest.join(level, list(columns[:n]), "left_anti")
    return kept


# -- level one


def l1(df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], reset: str | None = None) -> DataFrame:
    """Fields carried forward: a null keeps the last value, a name in the array ``reset`` clears it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    def carried(c: str) -> Column:
        kind = df.schema[c].dataType
        mark = F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v")))
        if reset is not None:
            mark = F.when(F.array_contains(F.coalesce(F.col(reset), F.array().cast("array<string>")), c), F.struct(F.lit(None).cast(kind).alias("v"))).otherwise(mark)
        return F.last(mark, ignorenulls=True).over(w)["v"].alias(c)

    return df.select(*[carried(c) if c in fields else F.col(c) for c in df.columns])


def tick_direction(df: DataFrame, keys: Sequence[str], order: str, price: str) -> DataFrame:
    """Adds ``tick``: Up, Down, LevelUp or LevelDown against the price before; null until a price differs."""
    w = Window.partitionBy(*keys).orderBy(order)
    moved = df.withColumn("_sign", F.signum(F.col(price) - F.lag(price).over(w)))
    last = F.last(F.when(F.col("_sign") != 0, F.col("_sign")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    tick = F.when(F.col("_sign") > 0, "Up").when(F.col("_sign") < 0, "Down").when(last > 0, "LevelUp").when(last < 0, "LevelDown")
    return moved.withColumn("tick", tick).drop("_sign")


def high_low(df: DataFrame, keys: Sequence[str], order: str, price: str) -> DataFrame:
    """Adds the running ``high`` and ``low``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("high", F.max(price).over(w)).withColumn("low", F.min(price).over(w))


def accumulate(trades: DataFrame, keys: Sequence[str], order: str, price: str, qty: str) -> DataFrame:
    """Adds acc_vol (notional), acc_vol_qty and the running vwap."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    vol, n = F.sum(F.col(price) * F.col(qty)).over(w), F.sum(qty).over(w)
    return trades.withColumn("acc_vol", vol).withColumn("acc_vol_qty", n).withColumn("vwap", F.when(F.col("acc_vol_qty") != 0, F.col("acc_vol") / F.col("acc_vol_qty")))


def side_totals(levels: DataFrame, keys: Sequence[str], price: str = "price", qty: str = "qty") -> DataFrame:
    """nv, qty and vwap of each side; levels without a price count in qty alone."""
    return levels.groupBy(*keys).agg(F.coalesce(F.sum(F.col(price) * F.col(qty)), F.lit(0)).alias("nv"), F.sum(qty).alias("total_qty")).withColumn("vwap", F.when(F.col("total_qty") != 0, F.col("nv") / F.col("total_qty")))


# -- orders and levels


def live_orders(events: DataFrame, keys: Sequence[str] = BOOK, seq: str = "seq") -> DataFrame:
    """Orders that are in the book after all events.

    ``op`` is add, modify, reduce, cancel or reset. An add or modify sets price
    and quantity, a null keeping the old one; a reduce takes its quantity off; a
    quantity of nought or less, or a cancel, removes; a reset removes all that
    came before it in the book. What follows a removal is about an unknown order
    until an add with a quantity, and is left out. An add of a live order changes
    it and keeps its place in time.
    """
    book = list(keys)
    resets = events.where("op = 'reset'").groupBy(*book).agg(F.max(seq).alias("_reset"))
    since = events.where("op <> 'reset'").join(resets, book, "left").where(F.col("_reset").isNull() | (F.col(seq) > F.col("_reset"))).drop("_reset")
    order, upto = [*book, "side", "order_id"], (Window.unboundedPreceding, 0)
    begins = (F.col("op") == "add") & F.col("qty").isNotNull()
    sets = F.col("op").isin("add", "modify")
    # an epoch begins with an add; up to its first removal nothing in it depends on what was removed before
    epochs = since.withColumn("_epoch", F.sum(begins.cast("int")).over(Window.partitionBy(*order).orderBy(seq).rowsBetween(*upto))).where("_epoch > 0")
    own = [*order, "_epoch"]
    parts = epochs.withColumn("_part", F.sum((sets & F.col("qty").isNotNull()).cast("int")).over(Window.partitionBy(*own).orderBy(seq).rowsBetween(*upto)))
    walk = Window.partitionBy(*own, "_part").orderBy(seq).rowsBetween(*upto)
    off = F.coalesce(F.sum(F.when(F.col("op") == "reduce", F.col("qty"))).over(walk), F.lit(0))
    held = parts.withColumn("_held", F.first(F.when(sets, F.col("qty")), ignorenulls=True).over(walk) - off)
    gone = held.withColumn("_gone", F.min(F.when((F.col("op") == "cancel") | (F.col("_held") <= 0), F.col(seq))).over(Window.partitionBy(*own)))
    live = gone.where(F.col("_gone").isNull() | (F.col(seq) < F.col("_gone")) | (F.col(seq) == F.col("_gone")) & (F.col("op") == "add"))
    last = lambda c: F.max_by(c, F.when(sets & F.col(c).isNotNull(), F.col(seq))).alias(c)
    ends = live.groupBy(*own).agg(F.max_by("_held", seq).alias("qty"), last("price"), last("rank"), F.min(F.when(begins, F.col(seq))).alias("since"), F.max(F.col("_gone").isNotNull()).alias("_gone"))
    # a life goes on over the epochs until one is removed
    before = F.lag("_gone").over(Window.partitionBy(*order).orderBy("_epoch"))
    lives = ends.withColumn("_new", F.coalesce(before, F.lit(True)).cast("int")).withColumn("_life", F.sum("_new").over(Window.partitionBy(*order).orderBy("_epoch").rowsBetween(*upto)))
    carried = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_epoch"))).alias(c)
    whole = lives.groupBy(*order, "_life").agg(carried("price"), F.max_by("qty", "_epoch").alias("qty"), F.min("since").alias("since"), carried("rank"), F.max_by("_gone", "_epoch").alias("_gone"))
    newest = whole.groupBy(*order).agg(F.max_by(F.struct("price", "since", "rank", "qty", "_gone"), "_life").alias("_x"))
    return newest.where("not _x._gone").select(*order, "_x.price", "_x.since", "_x.rank", "_x.qty")


def levels(orders: DataFrame, keys: Sequence[str] = BOOK) -> DataFrame:
    """Quantity and number of orders at each price."""
    return orders.groupBy(*keys, "side", "price").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n_orders"))


def fold_levels(updates: DataFrame, keys: Sequence[str] = BOOK, seq: str = "seq") -> DataFrame:
    """Levels after updates (price, qty, delta): absolute ones set the quantity, deltas add to the last; those over nought stay."""
    at = [*keys, "side", "price"]
    w = Window.partitionBy(*at).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    parts = updates.withColumn("_part", F.sum((~F.col("delta")).cast("int")).over(w))
    last = parts.groupBy(*at, "_part").agg(F.sum("qty").alias("qty"), F.max(seq).alias("last_seq"))
    return last.groupBy(*at).agg(F.max_by(F.struct("qty", "last_seq"), "_part").alias("_x")).select(*at, "_x.*").where("qty > 0")


def in_range(book: DataFrame, low: float, high: float) -> DataFrame:
    """Levels in a price range, best first: bids in (low, high], asks in [low, high)."""
    bid = (F.col("side") == "B") & (F.col("price") > low) & (F.col("price") <= high)
    ask = (F.col("side") == "S") & (F.col("price") >= low) & (F.col("price") < high)
    return best_first(book.where(bid | ask))


def best_first(book: DataFrame, keys: Sequence[str] = BOOK) -> DataFrame:
    """Levels from best to worst: market levels, then bids down and asks up."""
    return book.orderBy(*keys, "side", F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price")).asc_nulls_first())


def l2(book: DataFrame, keys: Sequence[str] = BOOK) -> DataFrame:
    """Best bid and ask of each book and their quantities; null for an empty side."""
    bid, ask = F.when((F.col("side") == "B"), F.col("price")), F.when((F.col("side") == "S"), F.col("price"))
    return book.where("price is not null").groupBy(*keys).agg(F.max(bid).alias("bid"), F.max_by("qty", bid).alias("bid_qty"), F.min(ask).alias("ask"), F.min_by("qty", ask).alias("ask_qty"))


def consolidated(book: DataFrame, mapping: DataFrame, keys: Sequence[str] = BOOK) -> DataFrame:
    """Levels of the books that input books map to (``book``, ``out_book``, ``rank``): quantities at a price are summed."""
    joined = book.join(mapping, list(keys))
    return joined.groupBy("out_book", "side", "price").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n_inputs"), F.min("rank").alias("best_rank"))


def ranked(orders: DataFrame, keys: Sequence[str] = BOOK) -> DataFrame:
    """Adds ``place``: each order's place at its price, by rank, then by when it came."""
    return orders.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "side", "price").orderBy(F.col("rank").asc_nulls_last(), "since")))


# -- matching


def _cumulated(book: DataFrame, keys: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    better = F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*keys, "side").orderBy(better.asc_nulls_first(), *more).rowsBetween(Window.unboundedPreceding, 0)
    return book.withColumn("_cum", F.sum("qty").over(w)).withColumn("_better", better)


def match_px(book: DataFrame, qty: float, keys: Sequence[str] = BOOK) -> DataFrame:
    """The price of the last level touched when ``qty`` is taken from each side; the worst where there is less."""
    summed = _cumulated(book.where("price is not null"), keys)
    return summed.groupBy(*keys, "side").agg(F.coalesce(F.min_by("price", F.when(F.col("_cum") >= qty, F.col("_better"))), F.max_by("price", "_better")).alias("match_px"))


def match_qty(book: DataFrame, price: float, keys: Sequence[str] = BOOK) -> DataFrame:
    """The quantity of each side at ``price`` or better."""
    good = F.when(F.col("side") == "B", F.col("price") >= price).otherwise(F.col("price") <= price)
    return book.groupBy(*keys, "side").agg(F.coalesce(F.sum(F.when(good | F.col("price").isNull(), F.col("qty"))), F.lit(0)).alias("match_qty"))


def match(orders: DataFrame, aggressors: DataFrame, keys: Sequence[str] = BOOK, seq: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(fills, leaves) of aggressive orders against their books' resting orders, by price, then time.

    An aggressor (side, qty, price; a null price is a market order) takes from
    the other side what is at its price or better; ``left`` is what it lacks and
    does not rest. Those of a book take turns by ``seq``, which the fills then
    name as well; without it the one that reaches further comes first. As each
    takes the best that is left, what a side has lost is always the front of its
    queue, so a turn needs its length alone.
    """
    at = [*keys, "side"]
    reach = F.when(F.col("price").isNull(), float("inf")).otherwise(F.when(F.col("side") == "B", F.col("price")).otherwise(-F.col("price")).cast("double"))
    turn = F.struct(*([F.col(seq).alias("t")] if seq else [(-reach).alias("t")]), (-F.col("qty")).alias("less"), F.col("price").alias("limit"), F.col("side").alias("from"))
    takers = aggressors.select(*keys, F.when(F.col("side") == "B", "S").otherwise("B").alias("side"), turn.alias("turn"))
    summed = _cumulated(orders, keys, [F.col("rank").asc_nulls_last(), F.col("since")])
    side = summed.groupBy(*at, "price").agg(F.max("_cum").alias("_cum")).groupBy(*at).agg(F.collect_list(F.struct("price", "_cum")).alias("_depth"))
    turns = takers.groupBy(*at).agg(F.array_sort(F.collect_list("turn")).alias("_turns")).join(side, at, "left")
    # of a side's levels those that a limit reaches
    good = lambda limit: lambda x: limit.isNull() | x["price"].isNull() | F.when(F.col("side") == "B", x["price"] >= limit).otherwise(x["price"] <= limit)
    within = lambda limit: F.coalesce(F.array_max(F.transform(F.filter("_depth", good(limit)), lambda x: x["_cum"])), F.lit(0))

    def take(acc: Column, t: Column) -> Column:
        end = F.greatest(acc["end"], F.least(acc["end"] - t["less"], within(t["limit"]))).cast("double")
        return F.struct(end.alias("end"), F.concat(acc["ends"], F.array(end)).alias("ends"))

    start = F.struct(F.lit(0.0).alias("end"), F.array().cast("array<double>").alias("ends"))
    done = turns.withColumn("_ends", F.aggregate("_turns", start, take)["ends"]).select(*at, F.posexplode(F.arrays_zip("_turns", "_ends")).alias("_n", "_z"))
    begin = F.coalesce(F.lag("_z._ends").over(Window.partitionBy(*at).orderBy("_n")), F.lit(0.0))
    kind = orders.schema["qty"].dataType
    took = done.select(*at, "_n", F.col("_z._turns").alias("_turn"), F.col("_z._ends").alias("_end"), (F.col("_z._ends") - begin).alias("_took"))
    # the queue's and the turns' ends cut the queue's front; each cut goes to the order and the turn that end next
    rows = F.struct("order_id", "price", "qty", F.col("_cum").alias("cum"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    taken = took.where("_took > 0").select(*at, "_end", F.struct("_turn").alias("_taker"))
    fronts = taken.groupBy(*at).agg(F.max("_end").alias("_front"))
    front = summed.where("qty > 0").join(fronts, at).where(F.col("_cum") - F.col("qty") < F.col("_front"))
    queue = front.select(*at, F.col("_cum").cast("double").alias("_end"), rows.alias("_row"))
    cuts = queue.withColumn("_taker", none(taken, "_taker")).unionByName(taken.withColumn("_row", none(queue, "_row")))
    # from the back, as a frame that begins with its row is read anew for each row
    next_ = Window.partitionBy(*at).orderBy(F.col("_end").desc()).rangeBetween(Window.unboundedPreceding, 0)
    size = F.col("_end") - F.coalesce(F.lag("_end").over(Window.partitionBy(*at).orderBy("_end")), F.lit(0.0))
    found = cuts.select(*at, F.last("_row", ignorenulls=True).over(next_).alias("_row"), F.last("_taker", ignorenulls=True).over(next_).alias("_taker"), F.col("_end"), size.alias("_size"))
    fill = found.where("_size > 0 and _taker is not null and _row is not null")
    fills = fill.select(
        *at, "_row.order_id", "_row.price", F.col("_size").cast(kind).alias("fill"), (F.col("_row.cum") - F.col("_end")).cast(kind).alias("rest"), *([F.col("_taker._turn.t").alias(seq)] if seq else [])
    )
    leaves = took.select(*keys, F.col("_turn.from").alias("side"), (-F.col("_turn.less")).alias("qty"), F.col("_turn.limit").alias("price"), *([F.col("_turn.t").alias(seq)] if seq else []), (-F.col("_turn.less") - F.col("_took")).cast(kind).alias("left"))
    return fills, leaves


def trades(events: DataFrame, keys: Sequence[str] = BOOK, seq: str = "seq") -> DataFrame:
    """Trades as last corrected; cancelled ones go."""
    row = F.struct(*[c for c in events.columns if c not in (*keys, "trade_id")])
    last = events.groupBy(*keys, "trade_id").agg(F.max_by(row, seq).alias("_x"))
    return last.select(*keys, "trade_id", "_x.*").where("op <> 'cancel'")


# -- what users ask for by name


def lookup(
    instruments: DataFrame, symbols: Sequence[str] = (), source: str | None = None, venue: str | None = None, segment: str | None = None,
    maturity: int | None = None, put_call: str | None = None, strike: float | None = None,
) -> DataFrame:
    """Instruments by symbol (all for none), each option that is given narrowing them; every option reaches the scan."""
    found = instruments.where(F.col("symbol").isin(*symbols)) if symbols else instruments
    for column, value in (("source", source), ("venue", venue), ("segment", segment), ("maturity", maturity), ("put_call", put_call), ("strike", strike)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found


def quotes(state: DataFrame, instruments: DataFrame, keys: Sequence[str] = BOOK, required: bool = True) -> DataFrame:
    """The state (level one, or levels) of the books of the instruments asked for, with their symbols; instruments without a book stay unless it is ``required``."""
    asked = instruments.select(*keys, "symbol").distinct()
    return asked.join(state, list(keys), "inner" if required else "left")


def sessions(events: DataFrame, keys: Sequence[str] = ("venue", "segment"), order: str = "seq") -> DataFrame:
    """Each venue's and segment's present trading session."""
    return events.groupBy(*keys).agg(F.max_by("session", order).alias("session"), F.max(order).alias("since"))
