"""Point-in-time trailing-window features (J1, J2, A1-A3 and their fusion).

For every anchor row (entity, as-of time) aggregate the facts of the same
entity whose time falls in a window ending at the anchor.  Four boundary rules
exist because the source queries used four different predicates:

* ``DD``   ``date(f) >= date(a) - N``  and ``date(f) <= date(a)``
* ``TT``   ``f >= a - N days``          and ``f <= date(a)`` (midnight: later same-day facts are out)
* ``DT``   ``date(f) >= a - N days``    and ``date(f) <= date(a)``
* ``OPEN`` ``date(f) <= date(a)``
* ``OPEN_TS`` ``f <= a`` (to the anchor instant)

Results follow SQL: SUM/AVG of an empty window are NULL, COUNT is 0, EXISTS is 0.

Plan:

``bucketed`` (the default)
  1. facts of one entity and day that pass the same filters become one narrow row: a bit
     per filter, the sum of each measure and the number of facts (partial aggregation
     happens map-side, before the shuffle);
  2. time is cut into buckets at least as long as the widest window.  A daily row goes to its
     own (entity, bucket), and to the next one where a window may still reach it, so an anchor
     meets all its daily rows in the one bucket it lies in, whatever the entity size,
     and a hot entity is spread over many (entity, bucket) keys;
  3. OPEN windows add one row per (entity, bucket) with the running totals of all earlier
     buckets, worked out from the facts that pass an OPEN filter alone;
  4. anchors LEFT JOIN these rows on (entity, bucket), with a day-range residual, and the
     anchor's sums are taken where the join leaves its rows: no further shuffle;
  5. time of day matters on one day per anchor only (TT: the first day of the
     window, for anchors not at midnight; OPEN_TS: the anchor's own day).  The facts of
     those days are reduced to distinct times, and running totals over the merged
     sequence of fact and anchor times give each anchor its part: work is linear in
     facts + anchors of an entity-day, pairs never appear; only these parts are
     unioned with the others and summed once more per anchor.

``prefix`` (for whole-number and decimal measures; the cost does not depend on the window length)
  Every rule is a difference C(end) - C(start) of running totals of the entity, C(x) over the
  facts before the instant x.  Facts become daily totals, the days that any anchor looks up
  are added once each, and one running sum per entity over those days gives the
  totals before each day: an entity has a row per day of the calendar at most, however
  many facts and anchors it has.  Anchors look their two or more instants up by an equi join
  on (entity, day); instants inside a day add that day's part as in step 4.

``direct`` (anchors LEFT JOIN facts ON entity AND window, GROUP BY anchor) emits every
(anchor, fact) pair of an entity; it exists as a plain second version for tests.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = ("DD", "TT", "DT", "OPEN", "OPEN_TS")
AGGS = ("sum", "avg", "count", "exists")


@dataclass(frozen=True)
class AnchorSpec:
    """Anchor rows: ``entity`` + as-of ``ts``; ``keys`` are extra columns that,
    with entity and ts, identify an anchor (kept in the output)."""
    entity: str
    ts: str
    keys: tuple[str, ...] = ()
    unique: bool = False   # the key columns are already unique (e.g. include a primary key)
    midnight: bool = False  # ts never has a time of day: steps for one are left out (checked, an error otherwise)

    @property
    def key_columns(self) -> list[str]:
        cols = [self.entity, self.ts]
        return cols + [k for k in self.keys if k not in cols]


@dataclass(frozen=True)
class FactSpec:
    entity: str
    ts: str


@dataclass(frozen=True)
class Feature:
    """One output column.

    agg      sum | avg | count | exists
    measure  Column/name summed or averaged; for ``count`` the column whose non-null
             values are counted (None = rows); unused for ``exists``
    where    fact-side filter (Column), applied inside the window
    days     window length N (ignored for OPEN)
    rule     DD | TT | DT | OPEN | OPEN_TS
    scale    sum/avg of an integer measure in units of 1/scale (e.g. cents, 100):
             sums stay exact integers and are divided once at the end
    """
    name: str
    agg: str
    measure: Column | str | None = None
    where: Column | None = None
    days: int | None = None
    rule: str = "DD"
    scale: float | None = None

    def __post_init__(self):
        if self.agg not in AGGS:
            raise ValueError(f"agg must be one of {AGGS}: {self.agg}")
        if self.rule not in RULES:
            raise ValueError(f"rule must be one of {RULES}: {self.rule}")
        if not self.rule.startswith("OPEN") and (self.days is None or self.days < 0):
            raise ValueError(f"{self.name}: rule {self.rule} needs days >= 0")
        if self.agg in ("sum", "avg") and self.measure is None:
            raise ValueError(f"{self.name}: {self.agg} needs a measure")


def _col(c: Column | str | None) -> Column | None:
    if c is None:
        return None
    return F.col(c) if isinstance(c, str) else c


def _epoch():
    return F.lit("1970-01-01").cast("date")


def _day_num(day: Column) -> Column:
    return F.datediff(day, _epoch())


def _minus_days(ts: Column, n: int) -> Column:
    return ts - F.make_dt_interval(F.lit(n))


# --------------------------------------------------------------------------- public


def trailing_features(anchors: DataFrame, facts: DataFrame, anchor: AnchorSpec,
                      fact: FactSpec, features: Sequence[Feature],
                      strategy: str = "bucketed", dedupe_anchors: bool = True,
                      open_bucket_days: int = 365, as_double: bool = True,
                      rows: DataFrame | None = None, times: str | None = None) -> DataFrame:
    """Anchor key columns + one column per feature, one row per distinct anchor key.

    ``dedupe_anchors`` drops duplicate anchor keys first (duplicates would
    otherwise multiply window sums, as in a plain join + GROUP BY); it is skipped,
    saving a shuffle, when the spec declares its key ``unique``.

    ``rows``: distinct rows of the anchors' keys and further columns.  They come back in place of the
    anchors, with their features, and are moved narrow, before these exist.  ``times`` names
    their column that tells how many anchors share the key (none: one)."""
    if not features:
        raise ValueError("no features")
    names = [f.name for f in features]
    if len(set(names)) != len(names):
        raise ValueError("duplicate feature names")
    keys = anchor.key_columns
    a = anchors.select(*[F.col(k) for k in keys])
    if dedupe_anchors and not anchor.unique:
        a = a.dropDuplicates(keys)
    a = _timed(a, anchor)
    plan = _Plan(features)
    f = _prepare_facts(facts, fact, plan)
    if strategy == "direct":
        agg = _direct(a, f, keys, plan)
    elif strategy == "bucketed":
        if rows is not None and not _by_time(plan, anchor.midnight):
            agg = _bucketed(a, f, rows.columns, plan, open_bucket_days, anchor.midnight, _timed(rows, anchor))
            return _finish(agg, rows.columns, plan, as_double, times)
        agg = _bucketed(a, f, keys, plan, open_bucket_days, anchor.midnight)
    elif strategy == "prefix":
        agg = _prefix(a, f, keys, plan, anchor.midnight)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    out = _finish(agg, keys, plan, as_double)
    if rows is None:
        return out
    r, o = rows.alias("r"), out.alias("o")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}"))
    return r.join(o, same).select("r.*", *[F.col(f"o.{n}") for n in names])


# ------------------------------------------------------------------------ internals


def _timed(a: DataFrame, anchor: AnchorSpec) -> DataFrame:
    """Anchors with their entity ``_e`` and time ``_a``."""
    a = (a.withColumn("_e", F.col(anchor.entity))
          .withColumn("_a", F.col(anchor.ts).cast("timestamp_ntz")))
    if anchor.midnight:
        a = a.withColumn("_a", F.when(F.col("_a") == F.date_trunc("day", "_a").cast("timestamp_ntz"), F.col("_a")).when(
            F.col("_a").isNotNull(), F.raise_error(F.lit(f"{anchor.ts} has a time of day")).cast("timestamp_ntz")))
    return a


class _Plan:
    """Shared work: features with the same measure and filter share one value column
    (``sig``); features with the same (value, rule, days) share one aggregate slot."""

    def __init__(self, features: Sequence[Feature]):
        self.features = list(features)
        self.sigs: list[tuple[str, Column, Column | None]] = []   # (kind, value expr, where)
        self.slots: list[tuple[int, str, int | None]] = []        # (sig, rule, days)
        self.feature_slot: list[int] = []
        self.measure: list[int | None] = []                       # per sig: number of its measure
        measures: dict[str, int] = {}
        sig_index: dict[str, int] = {}
        slot_index: dict[tuple, int] = {}
        for ft in self.features:
            cond = ft.where if ft.where is not None else F.lit(True)
            if ft.agg in ("sum", "avg"):
                kind, value = "sum", F.when(cond, _col(ft.measure))
            else:
                counted = cond if ft.agg == "exists" or ft.measure is None else (
                    cond & _col(ft.measure).isNotNull())
                kind, value = "count", F.when(counted, F.lit(1))
            key = f"{kind}|{value}"
            if key not in sig_index:
                sig_index[key] = len(self.sigs)
                self.sigs.append((kind, value, cond))
                self.measure.append(measures.setdefault(str(_col(ft.measure)), len(measures)) if kind == "sum" else None)
            sg = sig_index[key]
            days = None if ft.rule.startswith("OPEN") else ft.days
            skey = (sg, ft.rule, days)
            if skey not in slot_index:
                slot_index[skey] = len(self.slots)
                self.slots.append(skey)
            self.feature_slot.append(slot_index[skey])

    def kind(self, slot: int) -> str:
        return self.sigs[self.slots[slot][0]][0]

    def counted(self, slot: int) -> bool:
        """Whether a feature needs the number of values beside their sum."""
        return self.kind(slot) == "count" or any(k == slot and ft.agg == "avg" for k, ft in zip(self.feature_slot, self.features))

    def slots_where(self, pred) -> list[int]:
        return [k for k, (_, rule, _) in enumerate(self.slots) if pred(rule)]


def _prepare_facts(facts: DataFrame, fact: FactSpec, plan: _Plan) -> DataFrame:
    """(entity, ts, day) + one value column ``_v{sig}`` per distinct measure/filter:
    the measure when the fact passes the filter, else NULL (count kinds: 1/NULL).
    Rows passing no filter are dropped before any shuffle."""
    cols = [F.col(fact.entity).alias("_e"), F.col(fact.ts).cast("timestamp_ntz").alias("_t")]
    cols += [value.alias(f"_v{g}") for g, (_, value, _) in enumerate(plan.sigs)]
    any_cond = None
    for _, _, cond in plan.sigs:
        any_cond = cond if any_cond is None else any_cond | cond
    # a NULL condition already drops the row in WHERE; no coalesce, so simple
    # predicates on physical columns stay pushable into the Parquet scan
    out = facts.where(F.col(fact.entity).isNotNull() & F.col(fact.ts).isNotNull()
                      & any_cond).select(*cols)
    return out.withColumn("_d", F.to_date("_t"))


def _in_window(rule: str, n: int | None, a: Column, t: Column, d: Column) -> Column:
    """Row-level window predicate (direct strategy)."""
    a_day = F.to_date(a)
    if rule == "DD":
        return (d >= F.date_sub(a_day, n)) & (d <= a_day)
    if rule == "TT":
        return (t >= _minus_days(a, n)) & (t <= a_day.cast("timestamp_ntz"))
    if rule == "DT":
        return (d.cast("timestamp_ntz") >= _minus_days(a, n)) & (d <= a_day)
    if rule == "OPEN_TS":
        return t <= a
    return d <= a_day


def _direct(a: DataFrame, f: DataFrame, keys: list[str], plan: _Plan) -> DataFrame:
    a_ts, a_day = F.col("a._a"), F.to_date(F.col("a._a"))
    on = (F.col("a._e") == F.col("f._e")) & (F.col("f._d") <= a_day)
    if all(not rule.startswith("OPEN") for _, rule, _ in plan.slots):
        n_max = max(days for _, _, days in plan.slots)
        on = on & (F.col("f._t") >= _minus_days(a_ts, n_max + 1))
    j = a.alias("a").join(f.alias("f"), on, "left")
    aggs = []
    for k, (sg, rule, days) in enumerate(plan.slots):
        x = F.when(_in_window(rule, days, a_ts, F.col("f._t"), F.col("f._d")), F.col(f"f._v{sg}"))
        aggs += [F.sum(x).alias(f"_s{k}"), F.count(x).alias(f"_n{k}")]
    return j.groupBy(*[F.col(f"a.{c}") for c in keys]).agg(*aggs)


_BITS = 62                # filters per column of bits


def _by_time(plan: _Plan, midnight: bool) -> bool:
    """Whether some anchors have parts that depend on the time of day of the facts."""
    return any(rule == "OPEN_TS" or (rule == "TT" and days and not midnight) for _, rule, days in plan.slots)


def _daily(f: DataFrame, plan: _Plan, timed: bool) -> DataFrame:
    """One row per entity, day, set of passed filters and, where ``timed``, whether stamped at
    midnight: bits ``_k0``..., sum ``_m{measure}`` of each measure, number ``_n`` of facts."""
    bits = []
    for lo in range(0, len(plan.sigs), _BITS):
        here = [F.when(F.col(f"_v{g}").isNotNull(), F.lit(1 << (g - lo))).otherwise(F.lit(0)).cast("long")
                for g in range(lo, min(lo + _BITS, len(plan.sigs)))]
        mask = here[0]
        for b in here[1:]:
            mask = mask + b
        bits.append(mask.alias(f"_k{lo // _BITS}"))
    used = sorted({j for j in plan.measure if j is not None})
    # values of one measure are equal where they are not NULL
    values = [F.coalesce(*[F.col(f"_v{g}") for g, m in enumerate(plan.measure) if m == j]).alias(f"_m{j}") for j in used]
    mark = [(F.col("_t") == F.col("_d").cast("timestamp_ntz")).alias("_mn")] if timed else []
    d = f.select("_e", _day_num(F.col("_d")).alias("_dn"), *mark, *bits, *values)
    by = ["_e", "_dn", *(["_mn"] if timed else []), *[f"_k{i}" for i in range(len(bits))]]
    return d.groupBy(*by).agg(*[F.sum(f"_m{j}").alias(f"_m{j}") for j in used], F.count(F.lit(1)).alias("_n"))


def _earlier(a: DataFrame, f: DataFrame, plan: _Plan, sigs: list[int], bucket) -> DataFrame:
    """(_e, _b, _s{sig}, _c{sig}): totals over all buckets before ``_b``, for the buckets with anchors."""
    any_open = F.lit(False)
    for g in sigs:
        any_open = any_open | F.col(f"_v{g}").isNotNull()
    parts, sums = [], []
    for g in sigs:
        if plan.sigs[g][0] == "sum":
            parts.append(F.col(f"_v{g}").alias(f"_s{g}"))
            sums.append(f"_s{g}")
        parts.append(F.when(F.col(f"_v{g}").isNotNull(), F.lit(1).cast("long")).alias(f"_c{g}"))
        sums.append(f"_c{g}")
    had = f.where(any_open).select("_e", bucket(_day_num(F.col("_d"))).alias("_b"), *parts)
    asked = a.select("_e", bucket(_day_num(F.to_date("_a"))).alias("_b"), F.lit(1).alias("_ask")).where(
        F.col("_e").isNotNull() & F.col("_b").isNotNull())
    both = had.unionByName(asked, allowMissingColumns=True).groupBy("_e", "_b").agg(
        *[F.sum(c).alias(c) for c in sums], F.max("_ask").alias("_ask"))
    before = Window.partitionBy("_e").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    out = both.select("_e", "_b", "_ask", *[F.sum(c).over(before).alias(c) for c in sums])
    some = F.lit(False)
    for g in sigs:
        some = some | F.col(f"_c{g}").isNotNull()
    return out.where((F.col("_ask") == 1) & some).drop("_ask")


def _bucketed(a: DataFrame, f: DataFrame, keys: list[str], plan: _Plan, open_bucket_days: int, midnight: bool,
              rows: DataFrame | None = None) -> DataFrame:
    windowed = plan.slots_where(lambda r: not r.startswith("OPEN"))
    opened = plan.slots_where(lambda r: r.startswith("OPEN"))
    open_ts = plan.slots_where(lambda r: r == "OPEN_TS")
    tt = plan.slots_where(lambda r: r == "TT")
    nslot = len(plan.slots)
    osigs = sorted({plan.slots[k][0] for k in opened})
    wsigs = sorted({plan.slots[k][0] for k in windowed})
    n_max = max((plan.slots[k][2] for k in windowed), default=0)
    width = max(n_max + 1, open_bucket_days if opened else 1)

    def bucket(day: Column) -> Column:
        return F.floor(day / F.lit(width))

    def passed(sigs: list[int], side: str = "") -> Column:
        """Whether the row's facts pass one of the filters."""
        out = F.lit(False)
        for i in sorted({g // _BITS for g in sigs}):
            mask = sum(1 << (g - i * _BITS) for g in sigs if g // _BITS == i)
            out = out | (F.col(f"{side}_k{i}").bitwiseAND(F.lit(mask).cast("long")) != 0)
        return out

    # 1., 2. daily rows, in every bucket whose anchors they may reach
    daily = _daily(f, plan, bool(tt))
    own = bucket(F.col("_dn"))
    if windowed:
        reach = passed(wsigs) & (F.col("_dn") + F.lit(n_max) >= (own + 1) * F.lit(width))
        daily = daily.withColumn("_b", F.explode(F.when(reach, F.array(own, own + 1)).otherwise(F.array(own))))
    else:
        daily = daily.withColumn("_b", own)
    # 3. the buckets before
    if opened:
        daily = daily.unionByName(_earlier(a, f, plan, osigs, bucket), allowMissingColumns=True)

    # 4. every bound is a number of days before the anchor's: a time of day moves DT's by one
    at = (a if rows is None else rows).withColumn("_adn", _day_num(F.to_date("_a"))).withColumn("_b", bucket(F.col("_adn")))
    mid = F.lit(True)
    if not midnight:
        at = at.withColumn("_mid", F.col("_a") == F.to_date("_a").cast("timestamp_ntz"))
        mid = F.col("a._mid")
    at = at.drop("_a")
    dn, adn = F.col("d._dn"), F.col("a._adn")
    here = bucket(dn) == F.col("a._b")
    near = (dn >= adn - F.lit(n_max)) if windowed else F.lit(False)
    if opened:
        near = near | (here & passed(osigs, "d."))
    j = at.alias("a").join(daily.alias("d"), (F.col("a._e") == F.col("d._e")) & (F.col("a._b") == F.col("d._b"))
                           & (dn.isNull() | ((dn <= adn) & near)), "left")
    aggs = []
    for k, (g, rule, days) in enumerate(plan.slots):
        if rule == "DD":
            cond = dn >= adn - F.lit(days)
        elif rule == "DT":
            cond = dn >= adn - F.lit(days) + F.when(mid, 0).otherwise(1)
        elif rule == "TT":
            # whole days after the first day (the first day too when the anchor is at midnight);
            # on the anchor day only midnight facts
            lo = adn - F.lit(days)
            cond = ((((dn > lo) | ((dn == lo) & mid)) & (dn < adn))
                    | ((dn == adn) & F.col("d._mn") & (F.lit(days > 0) | mid)))
        else:
            cond = here & (dn <= adn if rule == "OPEN" else dn < adn)
        cond = passed([g], "d.") & cond
        if plan.kind(k) == "sum":
            s = F.when(cond, F.col(f"d._m{plan.measure[g]}"))
            if k in opened:
                s = F.when(dn.isNull(), F.col(f"d._s{g}")).otherwise(s)
            aggs.append(F.sum(s).alias(f"_s{k}"))
        if plan.counted(k):
            n = F.when(cond, F.col("d._n"))
            if k in opened:
                n = F.when(dn.isNull(), F.col(f"d._c{g}")).otherwise(n)
            aggs.append(F.sum(n).alias(f"_n{k}"))
    # grouped by the join's own keys beside: the rows lie as they should
    agg = j.groupBy(F.col("a._e"), F.col("a._b"), *[F.col(f"a.`{c}`") for c in keys]).agg(*aggs)
    agg = agg.select(*keys, *[F.col(f"_s{k}") for k in range(nslot) if plan.kind(k) == "sum"], *[
        (F.col(f"_n{k}") if plan.counted(k) else F.when(F.col(f"_s{k}").isNotNull(), F.lit(1)).cast("long")).alias(f"_n{k}")
        for k in range(nslot)])
    if not _by_time(plan, midnight):
        return agg

    # 5. parts by time of day
    def contrib(parts: dict[int, tuple[Column | None, Column | None]]) -> list[Column]:
        out = []
        for k in range(nslot):
            s, n = parts.get(k, (None, None))
            if plan.kind(k) == "sum":
                out.append((s if s is not None else F.lit(None)).cast(agg.schema[f"_s{k}"].dataType).alias(f"_s{k}"))
            out.append((n if n is not None else F.lit(None)).cast("long").alias(f"_n{k}"))
        return out

    a = a.withColumn("_mid", F.col("_a") == F.to_date("_a").cast("timestamp_ntz"))
    branches = [agg]
    if open_ts:  # OPEN_TS: the anchor's own day, up to its time
        sums = _day_prefix(a.withColumn("_day", F.to_date("_a")).withColumn("_at", F.col("_a")), f, plan,
                           sorted({plan.slots[k][0] for k in open_ts}), from_start=True)
        branches.append(sums.select(*keys, *contrib({
            k: (F.col(f"s{plan.slots[k][0]}") if plan.kind(k) == "sum" else None,
                F.col(f"n{plan.slots[k][0]}")) for k in open_ts})))
    # TT first-day facts, from the time of day on.  Only anchors with a time of day
    # need it; a window of 0 days has no such facts (its upper end is midnight).
    dist = sorted({plan.slots[k][2] for k in tt} - {0})
    if dist and not midnight:
        late = (a.where(~F.col("_mid"))
                 .withColumn("_N", F.explode(F.array(*[F.lit(n) for n in dist])))
                 .withColumn("_at", F.col("_a") - F.make_dt_interval(F.col("_N")))
                 .withColumn("_day", F.to_date("_at")))
        sums = _day_prefix(late, f, plan, sorted({plan.slots[k][0] for k in tt}), from_start=False)
        parts = {}
        for k in tt:
            g, _, days = plan.slots[k]
            it = F.col("_N") == F.lit(days)
            parts[k] = (F.when(it, F.col(f"s{g}")) if plan.kind(k) == "sum" else None, F.when(it, F.col(f"n{g}")))
        branches.append(sums.select(*keys, *contrib(parts)))
    u = branches[0]
    for b in branches[1:]:
        u = u.unionByName(b)
    return u.groupBy(*keys).agg(*[F.sum(c).alias(c) for k in range(nslot) for c in (
        (f"_s{k}", f"_n{k}") if plan.kind(k) == "sum" else (f"_n{k}",))])


def _prefix(a: DataFrame, f: DataFrame, keys: list[str], plan: _Plan, midnight: bool) -> DataFrame:
    for g, (kind, _, _) in enumerate(plan.sigs):
        if kind == "sum" and isinstance(f.schema[f"_v{g}"].dataType, (T.DoubleType, T.FloatType)):
            raise ValueError("prefix differences need whole-number or decimal measures")
    day = F.to_date("_a").cast("timestamp_ntz")
    tick, one = F.make_dt_interval(secs=F.lit(0.000001)), F.make_dt_interval(F.lit(1))
    # every window as two instants: facts before the end, but not before the start
    instants: list[Column] = []
    place: dict[tuple, int] = {}

    def instant(name: tuple, x: Column) -> int:
        if name not in place:
            place[name] = len(instants)
            instants.append(x)
        return place[name]

    ends, starts = [], []
    for _, rule, days in plan.slots:
        end = ("tt", day + tick) if rule == "TT" else ("ts", F.col("_a") + tick) if rule == "OPEN_TS" else ("day", day + one)
        ends.append(instant((end[0],), end[1]))
        if rule.startswith("OPEN"):
            starts.append(None)
            continue
        t0 = _minus_days(F.col("_a"), days)
        first = F.to_date(t0).cast("timestamp_ntz")
        start = {"DD": _minus_days(day, days), "TT": t0, "DT": F.when(t0 > first, first + one).otherwise(first)}[rule]
        starts.append(instant((rule, days), F.least(start, end[1])))

    looks = a.select(*keys, "_e", F.posexplode(F.array(*instants)).alias("_p", "_at"))
    looks = looks.withColumn("_d", F.to_date("_at")).withColumn("_off", F.col("_at") - F.col("_d").cast("timestamp_ntz"))
    zero = F.expr("INTERVAL '0' SECOND")
    at_midnight = F.col("_off") == tick            # the end of TT: what is stamped exactly at midnight still counts
    sums, mids = [], []
    for g, (kind, _, _) in enumerate(plan.sigs):
        v = F.col(f"_v{g}")
        vm = F.when(F.col("_t") == F.col("_d").cast("timestamp_ntz"), v)
        sums += ([F.sum(v).alias(f"s{g}")] if kind == "sum" else []) + [F.count(v).alias(f"n{g}")]
        mids += ([F.sum(vm).alias(f"ms{g}")] if kind == "sum" else []) + [F.count(vm).alias(f"mn{g}")]
    names = [x for g, (kind, _, _) in enumerate(plan.sigs) for x in ((f"s{g}", f"n{g}") if kind == "sum" else (f"n{g}",))]
    daily = f.groupBy("_e", "_d").agg(*sums, *mids)
    # the days looked up, once each, among the days with facts
    asked = looks.where(F.col("_e").isNotNull() & F.col("_d").isNotNull()).select("_e", "_d").distinct().withColumn("_ask", F.lit(1))
    days = daily.unionByName(asked, allowMissingColumns=True).groupBy("_e", "_d").agg(
        *[F.sum(c).alias(c) for c in [*names, *("m" + c for c in names)]], F.max("_ask").alias("_ask"))
    before = Window.partitionBy("_e").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    table = days.select("_e", "_d", "_ask", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in names],
                        *["m" + c for c in names]).where("_ask = 1")
    met = looks.join(table, ["_e", "_d"], "left")
    branches = [met.select(*keys, "_p", *[(F.coalesce(F.col(c), F.lit(0)) + F.when(at_midnight, F.coalesce("m" + c, F.lit(0)))
                                           .otherwise(0)).alias(c) for c in names])]
    if not midnight:
        inside = looks.where((F.col("_off") != zero) & ~at_midnight).withColumnRenamed("_d", "_day").withColumn("_at", F.col("_at") - tick)
        part = _day_prefix(inside, f, plan, list(range(len(plan.sigs))), from_start=True)
        branches.append(part.select(*keys, "_p", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]))
    u = branches[0]
    for b in branches[1:]:
        u = u.unionByName(b)
    aggs = []
    for k, (g, _, _) in enumerate(plan.slots):
        for kind in ("s", "n") if plan.kind(k) == "sum" else ("n",):
            x = F.sum(F.when(F.col("_p") == ends[k], F.col(f"{kind}{g}")))
            if starts[k] is not None:
                x = x - F.sum(F.when(F.col("_p") == starts[k], F.col(f"{kind}{g}")))
            aggs.append(x.alias(f"_{kind}{k}"))
    return u.groupBy(*keys).agg(*aggs)


def _day_prefix(at: DataFrame, f: DataFrame, plan: _Plan, sigs: list[int], from_start: bool) -> DataFrame:
    """``at`` rows (_e, _day, _at, ...) + totals ``s{sig}``, ``n{sig}`` of the facts of that entity
    and day with time <= ``_at`` (``from_start``) or >= ``_at``.

    Facts are reduced to distinct times, unioned with the anchors and summed in time
    order inside (entity, day): equal times are peers of the RANGE frame."""
    cols = at.columns
    days = at.select("_e", F.col("_day").alias("_d")).distinct()
    aggs = []
    for g in sigs:
        if plan.sigs[g][0] == "sum":
            aggs.append(F.sum(f"_v{g}").alias(f"_p{g}"))
        aggs.append(F.count(f"_v{g}").alias(f"_q{g}"))
    times = f.join(days, ["_e", "_d"], "left_semi").groupBy("_e", "_d", "_t").agg(*aggs)
    facts = times.select(F.col("_e"), F.col("_d").alias("_day"), F.col("_t").alias("_at"),
                         *[c for c in times.columns if c.startswith(("_p", "_q"))], F.lit(False).alias("_is"))
    both = facts.unionByName(at.withColumn("_is", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("_e", "_day").orderBy(F.col("_at").asc() if from_start else F.col("_at").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = []
    for g in sigs:
        if plan.sigs[g][0] == "sum":
            out.append(F.sum(f"_p{g}").over(w).alias(f"s{g}"))
        out.append(F.sum(f"_q{g}").over(w).alias(f"n{g}"))
    return both.select(*cols, "_is", *out).where("_is").drop("_is")


def _finish(agg: DataFrame, keys: list[str], plan: _Plan, as_double: bool, times: str | None = None) -> DataFrame:
    out = [F.col(c) for c in keys]
    many = (lambda c: c if times is None else c * F.col(times))
    for ft, k in zip(plan.features, plan.feature_slot):
        n = many(F.coalesce(F.col(f"_n{k}"), F.lit(0)))
        if ft.agg in ("sum", "avg"):
            s = many(F.col(f"_s{k}"))
            if ft.scale:
                s = s.cast("double") / F.lit(float(ft.scale))
            if ft.agg == "sum":
                v = F.when(n > 0, s)
                out.append((v.cast("double") if as_double else v).alias(ft.name))
            else:
                out.append(F.when(n > 0, s.cast("double") / n.cast("double")).alias(ft.name))
        elif ft.agg == "count":
            out.append(n.cast("long").alias(ft.name))
        else:
            out.append(F.when(n > 0, 1).otherwise(0).alias(ft.name))
    return agg.select(*out)
