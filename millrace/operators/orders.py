"""Life cycles of trading orders, folded from their events inside Spark's array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of an order's parts: unset, held, deferred, queued, sent, pending fill, acknowledged, rejected, closed.
UNSET, HELD, DEFERRED, QUEUED, SENT, PENDING, ACKED, REJECTED, CLOSED = "UHDQSPAXC"


def roll_up(fills: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders with cum_qty, cum_value, leaves_qty and the average price of their fills."""
    sums = fills.groupBy("order_id").agg(F.sum("last_qty").alias("cum_qty"), F.sum(F.col("last_qty") * F.col("last_px")).alias("cum_value"))
    joined = orders.join(sums, "order_id", "left")
    cum, value = F.coalesce("cum_qty", F.lit(0)), F.coalesce("cum_value", F.lit(0))
    return joined.select(*orders.columns, cum.alias("cum_qty"), value.alias("cum_value"), F.greatest(F.col("order_qty") - cum, F.lit(0)).alias("leaves_qty"), F.when(cum > 0, value / cum).alias("avg_px"))


def _next(s: Column, e: Column) -> Column:
    """The state after event ``e`` (kind, qty, px)."""
    kind = e["kind"]
    is_ = lambda *names: kind.isin(*names)
    new, mod, cxl = s["new"], s["mod"], s["cxl"]
    closed = new.isin(CLOSED, REJECTED)
    open_mod, open_cxl = mod.isin(DEFERRED, QUEUED, SENT, PENDING), cxl.isin(DEFERRED, QUEUED, SENT, PENDING)
    cum = s["cum"] + F.when(is_("fill"), F.coalesce(e["qty"], F.lit(0.0))).otherwise(0.0)
    value = s["value"] + F.when(is_("fill"), F.coalesce(e["qty"] * e["px"], F.lit(0.0))).otherwise(0.0)
    # an acknowledgement is implied by what can only follow one
    implied = (is_("ordered", "canceled", "fill") | (is_("modified") & open_mod)) & new.isin(HELD, QUEUED, SENT)
    may_modify = is_("modify") & new.isin(HELD, QUEUED, SENT, ACKED) & ~open_mod & ~open_cxl
    may_cancel = is_("cancel") & new.isin(SENT, QUEUED, ACKED, HELD) & ~open_cxl
    # a modify that the venue confirms before its fills waits for them
    waits = is_("modified") & open_mod & (F.coalesce(e["cum"], F.lit(0.0)) > cum)
    to_new = (
        F.when(is_("new") & (new == UNSET), QUEUED).when(is_("sent") & new.isin(QUEUED), SENT).when(is_("reject") & ~closed, REJECTED)
        .when(is_("closed"), CLOSED).when(is_("canceled") & ~closed, CLOSED).when(may_cancel & (new == HELD), CLOSED).when(implied, ACKED).otherwise(new)
    )
    to_mod = (
        F.when(may_modify, F.when(new.isin(QUEUED, SENT), DEFERRED).otherwise(QUEUED)).when(is_("mod_sent") & mod.isin(QUEUED), SENT)
        .when(is_("ordered") & (mod == DEFERRED), QUEUED).when(waits, PENDING).when(is_("modified") & open_mod, ACKED)
        .when(is_("fill") & (mod == PENDING) & (cum >= s["ack_cum"]), ACKED).when(is_("mod_reject") & open_mod, REJECTED)
        .when((is_("reject", "canceled", "closed") | may_cancel) & open_mod, REJECTED).otherwise(mod)
    )
    to_cxl = (
        F.when(may_cancel & (new != HELD), F.when(new.isin(QUEUED, SENT), DEFERRED).otherwise(QUEUED)).when(is_("cxl_sent") & (cxl == QUEUED), SENT)
        .when(is_("ordered") & (cxl == DEFERRED), QUEUED).when(is_("canceled") & open_cxl, ACKED).when(is_("cxl_reject") & open_cxl, REJECTED)
        .when(is_("reject", "closed") & open_cxl, REJECTED).otherwise(cxl)
    )
    applied = (is_("modified") & open_mod & ~waits) | (is_("fill") & (mod == PENDING) & (cum >= s["ack_cum"]))
    qty = F.when(is_("new") & (new == UNSET), e["qty"]).when(applied, F.coalesce(s["mod_qty"], s["qty"])).otherwise(s["qty"])
    odd = (
        (is_("new") & (new != UNSET)) | (is_("ordered") & ~new.isin(HELD, QUEUED, SENT)) | (is_("modify") & ~may_modify) | (is_("cancel") & ~may_cancel)
        | (is_("modified", "mod_reject") & ~open_mod) | (is_("cxl_reject") & ~open_cxl) | (is_("canceled", "reject") & closed)
    )
    ended = to_new.isin(CLOSED, REJECTED)
    return F.struct(
        to_new.alias("new"), to_mod.alias("mod"), to_cxl.alias("cxl"), qty.alias("qty"),
        F.when(may_modify, e["qty"]).otherwise(s["mod_qty"]).alias("mod_qty"), F.when(waits, e["cum"]).otherwise(s["ack_cum"]).alias("ack_cum"),
        cum.alias("cum"), value.alias("value"), F.when(ended, 0.0).otherwise(F.greatest(F.coalesce(qty, F.lit(0.0)) - cum, F.lit(0.0))).alias("leaves"), (s["odd"] + odd.cast("int")).alias("odd"),
    )


def life_cycles(events: DataFrame, keys: tuple[str, ...] = ("order_id",), seq: str = "seq") -> DataFrame:
    """The state of each order after its events (kind, qty, px, cum), in the order of ``seq``.

    Kinds: new, sent, ordered, reject, modify, mod_sent, modified, mod_reject,
    cancel, cxl_sent, canceled, cxl_reject, fill, closed. ``odd`` counts events
    that don't fit the state; a fill always counts. The group held together is
    one order's events.
    """
    row = F.struct(F.col(seq).alias("seq"), F.col("kind"), F.col("qty").cast("double").alias("qty"), F.col("px").cast("double").alias("px"), F.col("cum").cast("double").alias("cum"))
    none = F.lit(None).cast("double")
    start = F.struct(
        F.lit(UNSET).alias("new"), F.lit(UNSET).alias("mod"), F.lit(UNSET).alias("cxl"), none.alias("qty"), none.alias("mod_qty"), none.alias("ack_cum"),
        F.lit(0.0).alias("cum"), F.lit(0.0).alias("value"), F.lit(0.0).alias("leaves"), F.lit(0).alias("odd"),
    )
    ordered = events.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_events"))
    folded = ordered.select(*keys, F.aggregate("_events", start, _next).alias("s"))
    return folded.select(*keys, "s.new", "s.mod", "s.cxl", "s.qty", "s.cum", "s.value", "s.leaves", "s.odd")


def close(open_orders: DataFrame, states: DataFrame, keys: tuple[str, ...] = ("order_id",)) -> tuple[DataFrame, DataFrame]:
    """(orders still open, orders to move to the closed table)."""
    done = states.where(F.col("new").isin(CLOSED, REJECTED)).select(*keys)
    return open_orders.join(done, list(keys), "left_anti"), open_orders.join(done, list(keys), "left_semi")
