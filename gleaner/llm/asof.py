"""Point-in-time feature table of sales: cumulative change logs, merge_asof in time slices, opening balances.

Every click, sale and line is visible to its client from one moment (known and shipped) to
another (too old). The first moments make entry logs, the second ones expiry logs; a feature at
time t is the sum of its entry log up to t less that of its expiry log. Further logs carry the
latest click so far and the next sale. All logs and the sales' own times are dealt by (client,
time) into slices of about ``SLICE_ROWS`` rows, so a client with most rows has many slices.
Within a slice ``pandas.merge_asof`` reads every log at the sales' times, with sums that begin
at nought; what a client had before the slice, its opening balance, is added afterwards. A
slice's totals for its first and last client are all that balances need.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, python_batches

DAY = 86_400_000_000
MINUTE = 60_000_000
#: Rows of the logs that one slice holds, in one Python worker.
SLICE_ROWS = 800_000
#: Share of a table's rows from which a join key is spread; at most its inverse many keys have it.
HEAVY_SHARE, SPREAD = 1 / 256, 64
NEVER, ALWAYS = (1 << 62), -(1 << 62)
#: Kinds of rows of the logs; those of windows are numbered on.
CLICK_IN, SALE_IN, LINE_IN, SOLD, PROBE, CLICK_OUT, SALE_OUT = 0, 1, 2, 3, 4, 10, 40


@dataclass(frozen=True)
class Shape:
    """Windows in days, horizon of the label in days, minutes until an arrived row is known, spread of times in seconds."""

    windows: tuple[int, ...] = (2, 14)
    label_days: int = 7
    delay_minutes: int = 240
    jitter_seconds: int = 259_200

    @property
    def width(self) -> int:
        return max(5, 3 * len(self.windows))


def micros(df: DataFrame, name: str) -> Column:
    """Epoch microseconds of a timestamp column; one without a zone is UTC whatever the session's zone."""
    c = F.col(name)
    if dict(df.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    clock = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000
    return F.unix_date(c.cast("date")).cast("long") * DAY + clock + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def cents(x: Column) -> Column:
    """floor(100 x + 0.5); 0 for null, NaN and what isn't finite."""
    x = x.cast("double")
    return F.when(F.abs(x) < 9e15, F.floor(100 * x + 0.5)).otherwise(F.lit(0)).cast("long")


def heavy_keys(df: DataFrame, key: str) -> list:
    """The keys that hold over ``HEAVY_SHARE`` of the rows: fewer than its inverse, from counts made before the shuffle."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    least = HEAVY_SHARE * df.count()
    return [r[0] for r in counts.filter(F.col("count") > least).select(key).collect()]


def spread_join(many: DataFrame, one: DataFrame, key: str, by: Column) -> DataFrame:
    """Inner join on ``key``; rows of ``many`` under a heavy key go by ``by`` to SPREAD parts, each with its copy of ``one``'s rows."""
    heavy = heavy_keys(many, key)
    if not heavy:
        return many.join(one, key)
    is_heavy = F.col(key).isin(heavy)
    many = many.withColumn("_part", F.when(is_heavy, F.pmod(by, F.lit(SPREAD))).otherwise(F.lit(0)).cast("int"))
    parts = F.when(is_heavy, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    return many.join(one.withColumn("_part", F.explode(parts)), [key, "_part"]).drop("_part")


def _running_before(keys: list[str], value: str, columns: list[str]):
    """For mapInPandas over rows sorted by ``keys``: adds ``before``, the largest ``value`` of the key's earlier rows here."""

    def run(frames):
        pid, last, high = TaskContext.get().partitionId(), None, ALWAYS
        first = None
        for frame in frames:
            if not len(frame):
                continue
            ids = [frame[k].to_numpy() for k in keys]
            new = np.ones(len(frame), bool)
            new[1:] = np.any([x[1:] != x[:-1] for x in ids], axis=0)
            head = tuple(int(x[0]) for x in ids)
            new[0] = head != last
            group, values = np.cumsum(new), frame[value]
            peak = values.groupby(group).cummax().to_numpy()
            if not new[0]:
                peak = np.where(group == 0, np.maximum(peak, high), peak)
            before = np.where(new, ALWAYS, np.concatenate([[high], peak[:-1]]))
            first = head if first is None else first
            last, high = tuple(int(x[-1]) for x in ids), int(peak[-1])
            yield frame.assign(before=before, slice=pid, edge=0)
        if first is not None:  # the slice's first and last key; the last one's largest value
            edge = pd.DataFrame({c: [0, 0] for c in columns}, dtype="int64")
            for i, k in enumerate(keys):
                edge[k] = [first[i], last[i]]
            edge[value] = [ALWAYS, high]
            yield edge.assign(before=ALWAYS, slice=pid, edge=[1, 2])

    return run


def _sliced(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)


def first_holders(lines: DataFrame, n: int) -> DataFrame:
    """``lines`` (client, item, enter, sold, cents; longs) with ``before``: the latest sold of an earlier entry of the same client and item.

    The order is by entry within slices of (client, item, enter); what a pair had in the slices
    before is a running maximum over the slices' last pairs, a row or two a slice.
    """
    columns = ["client", "item", "enter", "sold", "cents"]
    order = [F.col("client"), F.col("item"), F.col("enter"), F.col("sold"), F.col("cents")]
    types = ", ".join(f"{c} long" for c in columns)
    run = _running_before(["client", "item"], "sold", columns)
    rows = materialize(_sliced(lines.select(*columns), order, n).mapInPandas(run, f"{types}, before long, slice int, edge int"), "asof-lines")
    earlier = Window.partitionBy("client", "item").orderBy("slice", "edge").rowsBetween(Window.unboundedPreceding, -1)
    opening = rows.filter("edge > 0").withColumn("opening", F.max("sold").over(earlier)).filter(f"edge = 1 and opening > {ALWAYS}")
    opening = materialize(opening.select("slice", "client", "item", "opening"), "asof-line-openings")
    out = rows.filter("edge = 0").join(opening, ["slice", "client", "item"], "left")
    return out.select(*columns, F.greatest("before", F.coalesce("opening", F.lit(ALWAYS))).alias("before"))


def _log(shape: Shape, client, at, kind: int, values: list[Column]) -> Column:
    padded = values + [F.lit(0)] * (shape.width - len(values))
    named = [client.alias("client"), at.alias("at"), F.lit(kind).cast("int").alias("kind")]
    return F.struct(*named, *[v.cast("long").alias(f"v{i}") for i, v in enumerate(padded)])


def _rows(df: DataFrame, logs: Column) -> DataFrame:
    return df.select(F.inline(logs))


def change_logs(sales: DataFrame, clicks: DataFrame, lines: DataFrame, shape: Shape, n_line_slices: int) -> DataFrame:
    """All logs and the sales' times as rows (client, at, kind, v0, v1, …), all longs."""
    spans = [d * DAY for d in shape.windows]
    delay = shape.delay_minutes * MINUTE
    c = F.col

    seen = clicks.select(
        "click_id", "client_id", micros(clicks, "ts").alias("ts"), micros(clicks, "arrived_at").alias("arrived"), "kind", "value", c("props").cast("string").alias("props")
    ).filter("client_id is not null and ts is not null and arrived is not null").distinct()
    enter = F.greatest(c("ts"), c("arrived") + delay)
    bought, paid = (F.coalesce(c("kind"), F.lit("")) == "purchase").cast("long"), cents(c("value"))
    client = c("client_id").cast("long")
    latest = [c("ts"), F.coalesce(c("click_id").cast("long"), F.lit(ALWAYS))]
    out_of = [_log(shape, client, F.greatest(c("ts") + s, enter), CLICK_OUT + i, [bought, paid]) for i, s in enumerate(spans)]
    click_rows = _rows(seen, F.array(_log(shape, client, enter, CLICK_IN, [bought, paid, *latest]), *out_of))

    base = sales.filter("client_id is not null and sold_at is not null").select(
        "sale_id", c("client_id").cast("long").alias("client"), micros(sales, "sold_at").alias("sold"), (micros(sales, "arrived_at") + delay).alias("known"), cents(c("total")).alias("total")
    )
    jitter = F.coalesce(F.crc32(c("sale_id").cast("string").cast("binary")), F.lit(0)) % shape.jitter_seconds * 1_000_000
    probe = _log(shape, c("client"), c("sold") + jitter, PROBE, [F.coalesce(c("sale_id").cast("long"), F.lit(0)), c("sale_id").isNull()])
    label = _log(shape, c("client"), c("sold"), SOLD, [])
    sale_enter = F.greatest("sold", "known")
    in_time = [(sale_enter < c("sold") + s).cast("long") for s in spans]
    entry = _log(shape, c("client"), sale_enter, SALE_IN, [x for ok in in_time for x in (ok, ok * c("total"))])
    sale_rows = _rows(base, F.filter(F.array(probe, label, entry), lambda x: x["at"].isNotNull() & ((x["kind"] != SALE_IN) | c("known").isNotNull())))

    goods = lines.filter("sale_id is not null and shipped_at is not null").select(
        "sale_id", c("item_id").cast("long").alias("item"), micros(lines, "shipped_at").alias("shipped"), cents(c("amount")).alias("cents")
    )
    owners = base.filter("known is not null").select("sale_id", "client", "sold", sale_enter.alias("enter"))
    goods = spread_join(goods, owners, "sale_id", F.xxhash64("item", "shipped", "cents")).withColumn("enter", F.greatest("enter", "shipped"))
    goods = goods.filter(c("enter") < c("sold") + max(spans))
    held = first_holders(goods.filter("item is not null"), n_line_slices)
    held = held.unionByName(goods.filter("item is null").withColumn("before", F.lit(NEVER)), allowMissingColumns=True)
    visible = [(c("enter") < c("sold") + s).cast("long") for s in spans]
    begins = [F.greatest(c("enter"), c("before") + s) for s in spans]  # of this line's share of the item's time
    adds = [((c("before") < c("sold")) & (b < c("sold") + s)).cast("long") for b, s in zip(begins, spans, strict=True)]
    at_once = [a * (b == c("enter")).cast("long") for a, b in zip(adds, begins, strict=True)]
    pair = lambda i, now: [F.lit(0)] * (3 * i + 2) + [now]
    shown = _log(shape, c("client"), c("enter"), LINE_IN, [x for v, a in zip(visible, at_once, strict=True) for x in (v, v * c("cents"), a)])
    later = [_log(shape, c("client"), b, LINE_IN, pair(i, a - o)) for i, (a, o, b) in enumerate(zip(adds, at_once, begins, strict=True))]
    line_rows = _rows(held, F.filter(F.array(shown, *later), lambda x: F.greatest(*[x[f"v{i}"] for i in range(shape.width) if i % 3 != 1]) > 0))

    zero = F.lit(0).cast("long")
    own = base.filter("known is not null").select("client", "sold", *[x for i, ok in enumerate(in_time) for x in _named(i, ok, ok * c("total"), zero, zero, zero)])
    theirs = held.select("client", "sold", *[x for i, (v, a) in enumerate(zip(visible, adds, strict=True)) for x in _named(i, zero, zero, v, v * c("cents"), a)])
    names = [f"e{i}_{k}" for i in range(len(spans)) for k in range(5)]
    sums = own.unionAll(theirs).groupBy("client", "sold").agg(*[F.sum(x).alias(x) for x in names])
    gone = [_log(shape, c("client"), c("sold") + s, SALE_OUT + i, [c(f"e{i}_{k}") for k in range(5)]) for i, s in enumerate(spans)]
    sale_ends = _rows(sums, F.filter(F.array(*gone), lambda x: (x["v0"] + x["v2"]) > 0))
    return click_rows.unionAll(sale_rows).unionAll(line_rows).unionAll(sale_ends)


def _named(i: int, *values: Column) -> list[Column]:
    return [v.alias(f"e{i}_{k}") for k, v in enumerate(values)]


FEATURES = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "line_cents", "n_items")


def _read_log(probes: pd.DataFrame, client: np.ndarray, at: np.ndarray, **how) -> np.ndarray:
    """For each probe the place in the log of the row that merge_asof finds, or -1. The log is sorted by (client, at)."""
    order = np.argsort(at, kind="stable")
    log = pd.DataFrame({"at": at[order], "client": client[order], "place": order})
    got = pd.merge_asof(probes, log, on="at", by="client", **how)["place"]
    return got.fillna(-1).to_numpy().astype(np.int64)


def _taken(values: np.ndarray, place: np.ndarray, none: int = 0) -> np.ndarray:
    return np.where(place < 0, none, values[np.maximum(place, 0)]) if len(values) else np.full(len(place), none, np.int64)


def read_slice(rows: pd.DataFrame, n_windows: int) -> pd.DataFrame:
    """The features of a slice's sales, from this slice alone, and its balances (balance 1).

    ``rows`` is sorted by (client, at), sales' times after all changes of the same moment. A
    balance is what the slice's first or last client has at its end: the sums, the latest click,
    and as ``next_at`` its first sale here.
    """
    kind, client, at = rows["kind"].to_numpy(), rows["client"].to_numpy(), rows["at"].to_numpy()
    value = lambda k, mask: rows[f"v{k}"].to_numpy()[mask]
    is_probe = kind == PROBE
    ends = sorted({int(client[0]), int(client[-1])})
    probes = pd.DataFrame({"client": np.concatenate([client[is_probe], ends]), "at": np.concatenate([at[is_probe], [NEVER] * len(ends)])})
    probes["row"] = np.arange(len(probes))
    probes = probes.sort_values("at", kind="stable")
    back = np.argsort(probes["row"].to_numpy())

    def sums(log: int, columns: list[int]) -> list[np.ndarray]:
        """Count and sums of a log up to each probe."""
        mask = kind == log
        held = pd.DataFrame({"client": client[mask], "n": 1} | {k: value(k, mask) for k in columns})
        running = held.groupby("client", sort=False).cumsum()
        place = _read_log(probes, client[mask], at[mask])[back]
        return [_taken(running[k].to_numpy(), place) for k in ("n", *columns)]

    out = {}
    n_in, bought_in, paid_in = sums(CLICK_IN, [0, 1])
    sale_in = sums(SALE_IN, list(range(2 * n_windows)))[1:]
    line_in = sums(LINE_IN, list(range(3 * n_windows)))[1:]
    for i in range(n_windows):
        n_out, bought_out, paid_out = sums(CLICK_OUT + i, [0, 1])
        gone = sums(SALE_OUT + i, list(range(5)))[1:]
        here = (n_in - n_out, bought_in - bought_out, paid_in - paid_out, *sale_in[2 * i : 2 * i + 2], *line_in[3 * i : 3 * i + 3])
        here = [*here[:3], *[a - b for a, b in zip(here[3:], gone, strict=True)]]
        out |= {f"{name}_{i}": x for name, x in zip(FEATURES, here, strict=True)}

    mask = kind == CLICK_IN
    ts, click = value(2, mask), value(3, mask)
    by_time = np.lexsort((click, ts))
    rank = np.empty(len(ts), np.int64)
    rank[by_time] = np.arange(len(ts))
    best = pd.Series(rank).groupby(client[mask], sort=False).cummax().to_numpy()
    place = _taken(best, _read_log(probes, client[mask], at[mask])[back], -1)
    row = _taken(by_time, place, -1)
    out |= {"last_ts": _taken(ts, row, ALWAYS), "last_click": _taken(click, row, ALWAYS)}

    mask = kind == SOLD
    sold_client, sold = client[mask], at[mask]
    coming = _taken(sold, _read_log(probes, sold_client, sold, direction="forward", allow_exact_matches=False)[back], NEVER)
    first = [int(sold[sold_client == k].min(initial=NEVER)) for k in ends]
    coming[len(coming) - len(ends) :] = first
    own = lambda k: np.concatenate([value(k, is_probe), [0] * len(ends)])
    balance = np.concatenate([np.zeros(int(is_probe.sum()), np.int64), np.ones(len(ends), np.int64)])
    both = probes.sort_values("row")
    return pd.DataFrame({"client": both["client"].to_numpy(), "t_us": both["at"].to_numpy(), "balance": balance, "sale": own(0), "no_sale": own(1), "next_at": coming} | out)


def feature_table(sales: DataFrame, clicks: DataFrame, lines: DataFrame, shape: Shape | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per sale and window the features that were known at the sale's time, and the label.

    A sale with a client and a time has t: sold_at plus crc32 of its decimal id modulo
    ``jitter_seconds``. Columns: sale_id, d, t_us, label, n_clicks, n_purchases, click_cents,
    last_click_id, n_sales, sale_cents, n_lines, n_items, line_cents.

    Sales without client_id or sold_at have no rows and are nobody's; those without arrived_at
    are never known but have rows and count for labels. Clicks without client, ts or arrived_at
    and lines without sale_id or shipped_at count nowhere. Clicks equal in all seven columns are
    one; columns beyond the named ones are ignored. Sales with the same sale_id are sales of
    their own, with the same lines each; a null sale_id stands for no delay and has no lines. A
    click without id counts, and as the last click gives null. Amounts that are null, NaN or
    infinite are 0 cents. Empty tables give no rows, or noughts.
    """
    shape = shape or Shape()
    python_batches(sales.sparkSession)
    n_sales, n_clicks, n_lines = sales.count(), clicks.count(), lines.count()
    k = len(shape.windows)
    logs = change_logs(sales, clicks, lines, shape, 1 + n_lines // (2 * slice_rows))
    after = (F.col("kind") == PROBE).cast("int")
    tie = F.xxhash64("kind", *[f"v{i}" for i in range(shape.width)])
    n = 1 + ((1 + k) * n_clicks + (3 + k) * n_sales + n_lines) // slice_rows
    names = [f"{name}_{i}" for i in range(k) for name in FEATURES]
    types = "client long, t_us long, balance long, sale long, no_sale long, next_at long, " + ", ".join(f"{x} long" for x in [*names, "last_ts", "last_click"])

    def run(frames):
        held = list(frames)  # a slice
        rows = pd.concat(held, ignore_index=True) if held else None
        del held
        if rows is not None and len(rows):
            columns = [x.split()[0] for x in types.split(", ")]
            yield read_slice(rows, k)[columns].assign(slice=TaskContext.get().partitionId())

    sliced = _sliced(logs, [F.col("client"), F.col("at"), after, tie], n)
    local = materialize(sliced.mapInPandas(run, f"{types}, slice int"), "asof-slices")
    before = Window.partitionBy("client").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("client").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    openings = local.filter("balance = 1").select(
        "client", "slice", *[F.sum(x).over(before).alias(f"o_{x}") for x in names],
        F.max(F.struct("last_ts", "last_click")).over(before).alias("o_last"), F.min("next_at").over(behind).alias("o_next"),
    ).filter("o_last is not null or o_next is not null")
    openings = materialize(openings, "asof-openings")
    got = local.filter("balance = 0").join(openings, ["client", "slice"], "left")
    zero = F.lit(0).cast("long")
    last = F.greatest(F.struct("last_ts", "last_click"), F.coalesce("o_last", F.struct(F.lit(ALWAYS).alias("last_ts"), F.lit(ALWAYS).alias("last_click"))))
    got = got.select(
        F.when(F.col("no_sale") == 0, F.col("sale")).alias("sale_id"), "t_us", last.alias("last"),
        F.coalesce(F.least("next_at", "o_next") <= F.col("t_us") + shape.label_days * DAY, F.lit(False)).alias("label"),
        *[(F.col(x) + F.coalesce(f"o_{x}", zero)).alias(x) for x in names],
    )
    recent = lambda d: (F.col("last.last_ts") > F.col("t_us") - d * DAY) & (F.col("last.last_click") > ALWAYS)
    each = [
        F.struct(F.lit(d).alias("d"), F.when(recent(d), F.col("last.last_click")).alias("last_click_id"), *[F.col(f"{x}_{i}").alias(x) for x in FEATURES])
        for i, d in enumerate(shape.windows)
    ]
    return got.select("sale_id", "t_us", "label", F.inline(F.array(*each)))
