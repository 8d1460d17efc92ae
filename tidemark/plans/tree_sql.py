"""DuckDB SQL of one boosted symmetric tree of depth 1 or 2 per model.

The tables that ``query`` offers to its last SELECT:

* ``models`` (m, depth, l2), ``edge`` (i, feature, edges): the features in order with their cut points
* ``marked`` (m, o_orderkey, y, is_test): the rows of every model, split by its seed
* ``b1``, ``b2`` (m, i, cut): the best cut of each level; ``leaf`` (m, leaf, g, h, n, value)
* ``scored`` (m, o_orderkey, y, is_test, leaf, score)
* ``auc`` (m, is_test, n, auc, ks)
"""

from __future__ import annotations

from tidemark.plans import constants as K
from tidemark.plans import fixtures as fx

BINS = 32
RATE = 0.05

_KIND = " ".join(f"WHEN '{k}' THEN {v}.0" for k, v in K.FX_BUSINESS_TYPE_ORDER.items())
_BASE = f"""
SELECT s.o_orderkey, s.y, CAST(s.o_totalprice AS DOUBLE) AS price, CAST(c.c_acctbal AS DOUBLE) AS balance,
       CAST(CASE c.c_mktsegment {_KIND} END AS DOUBLE) AS kind, CAST(s.o_orderkey * 7919 % 1000 AS DOUBLE) AS noise
FROM scored_orders s LEFT JOIN customer c ON c.c_custkey = s.o_custkey"""

_WIDE = """
SELECT o_orderkey, unnest(['price', 'balance', 'kind', 'noise']) AS feature, unnest([0, 1, 2, 3]) AS i,
       unnest([price, balance, kind, noise]) AS value FROM base"""

_PROBS = "[" + ", ".join(str(i / BINS) for i in range(1, BINS + 1)) + "]"
_EDGE = f"""
SELECT feature, i, list_sort(list_distinct([x for x in q if x < q[{BINS}]])) AS edges
FROM (SELECT feature, i, quantile_cont(value, {_PROBS}) AS q FROM wide WHERE value IS NOT NULL GROUP BY feature, i)"""

_BIN = """
SELECT w.o_orderkey, w.i, w.value, CASE WHEN w.value IS NULL THEN 0 ELSE len(list_filter(e.edges, lambda x: x < w.value)) END AS bin
FROM wide w JOIN edge e USING (i)"""

_CUTS = "SELECT i, unnest(range(len(edges))) AS cut FROM edge"


def _best(source: str, extra: str) -> str:
    """The best cut of a level: ``source`` has (m, leaf, i, bin, g, h)."""
    return f"""
SELECT m, i, cut FROM (
  SELECT m, i, cut, sum(gl * gl / (hl + l2) + (gt - gl) * (gt - gl) / (ht - hl + l2) - gt * gt / (ht + l2)) AS gain
  FROM (SELECT s.m, s.leaf, c.i, c.cut, m.l2, coalesce(sum(g) FILTER (bin <= cut), 0) AS gl, coalesce(sum(h) FILTER (bin <= cut), 0) AS hl,
               sum(g) AS gt, sum(h) AS ht
        FROM {source} s JOIN cuts c ON c.i = s.i JOIN models m ON m.m = s.m {extra}
        GROUP BY s.m, s.leaf, c.i, c.cut, m.l2)
  GROUP BY m, i, cut)
QUALIFY row_number() OVER (PARTITION BY m ORDER BY ROUND(gain, 7) DESC, i, cut) = 1"""


_HIST = """
SELECT t.m, t.{leaf} AS leaf, b.i, b.bin, sum(t.y - CAST(0.5 AS DOUBLE)) AS g, count(*) * CAST(0.25 AS DOUBLE) AS h
FROM {rows} t JOIN bin b USING (o_orderkey) WHERE t.is_test = 0 GROUP BY t.m, t.{leaf}, b.i, b.bin"""


def query(marks: dict[str, tuple[str, int]], models: dict[str, tuple[int, int]], last: str) -> str:
    """``marks``: model -> (condition on its rows, split seed); ``models``: model -> (depth, l2)."""
    values = ", ".join(f"('{m}', {d}, {l2})" for m, (d, l2) in models.items())
    marked = " UNION ALL ".join(f"""
SELECT '{m}' AS m, o_orderkey, y, CAST(ROW_NUMBER() OVER (PARTITION BY y ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':{seed}'), o_orderkey)
       <= ROUND(COUNT(*) OVER (PARTITION BY y) * {K.TEST_SHARE}) AS INTEGER) AS is_test
FROM base WHERE {where}""" for m, (where, seed) in marks.items())
    extra = (
        ("models", f"SELECT * FROM (VALUES {values}) t(m, depth, l2)"), ("base", _BASE), ("wide", _WIDE), ("edge", _EDGE),
        ("bin", _BIN), ("cuts", _CUTS), ("marked", marked),
        ("h1", _HIST.format(rows="(SELECT *, 0 AS leaf0 FROM marked)", leaf="leaf0")),
        ("b1", _best("h1", "")),
        ("one", "SELECT t.*, CAST(b.bin > b1.cut AS INTEGER) AS leaf1 FROM marked t JOIN b1 USING (m) "
                "JOIN bin b ON b.o_orderkey = t.o_orderkey AND b.i = b1.i"),
        ("h2", _HIST.format(rows="one", leaf="leaf1")),
        ("b2", _best("h2", "AND m.depth = 2")),
        ("two", "SELECT t.*, t.leaf1 + 2 * coalesce(CAST(b.bin > b2.cut AS INTEGER), 0) AS leaf FROM one t LEFT JOIN b2 USING (m) "
                "LEFT JOIN bin b ON b.o_orderkey = t.o_orderkey AND b.i = b2.i"),
        ("leaf", f"SELECT m, leaf, g, h, n, {RATE} * g / (h + l2) AS value FROM (SELECT m, CAST(leaf AS INTEGER) AS leaf, "
                 "sum(y - CAST(0.5 AS DOUBLE)) AS g, count(*) * CAST(0.25 AS DOUBLE) AS h, count(*) AS n FROM two WHERE is_test = 0 "
                 "GROUP BY m, leaf) JOIN models USING (m)"),
        ("scored", "SELECT t.m, t.o_orderkey, t.y, t.is_test, t.leaf, 1 / (1 + exp(-coalesce(l.value, 0))) AS score "
                   "FROM two t LEFT JOIN leaf l ON l.m = t.m AND l.leaf = t.leaf"),
        ("dist", "SELECT m, is_test, score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY m, is_test, score"),
        ("ranked", "SELECT *, sum(neg) OVER w - neg AS below, sum(pos) OVER w - pos AS pos_below, sum(pos) OVER (PARTITION BY m, is_test) AS p, "
                   "sum(neg) OVER (PARTITION BY m, is_test) AS q FROM dist WINDOW w AS (PARTITION BY m, is_test ORDER BY score)"),
        ("auc", "SELECT m, is_test, CAST(max(p + q) AS BIGINT) AS n, sum(pos * (below + neg / 2.0)) / (max(p) * CAST(max(q) AS DOUBLE)) AS auc, "
                "greatest(max((p - pos_below) / CAST(p AS DOUBLE) - (q - below) / CAST(q AS DOUBLE)), 0) AS ks FROM ranked GROUP BY m, is_test"))
    return fx.with_views(last, "scored_orders", extra=extra)


def decile_table(places: int) -> str:
    probs = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
    return f"""
SELECT segment, part, CAST(row_number() OVER o AS INTEGER) AS decile, min_prob, max_prob, events, nonevents,
       ROUND(events / e, {places}) AS event_rate, ROUND(sum(events / e) OVER o, {places}) AS cum_eventrate,
       ROUND(sum(nonevents / ne) OVER o, {places}) AS cum_noneventrate,
       ROUND(ROUND_EVEN(sum(events / e) OVER o - sum(nonevents / ne) OVER o, 3) * 100, {places}) AS ks,
       ROUND(events / (events + nonevents), {places}) AS cure_rate
FROM (
  SELECT segment, part, bucket, min(p) AS min_prob, max(p) AS max_prob, CAST(sum(y) AS DOUBLE) AS events,
         CAST(sum(1 - y) AS DOUBLE) AS nonevents, sum(sum(y)) OVER (PARTITION BY segment, part) AS e,
         sum(sum(1 - y)) OVER (PARTITION BY segment, part) AS ne
  FROM (SELECT s.*, CASE WHEN len(edges) > 1 THEN greatest(1, len(list_filter(edges, lambda x: x < p))) END AS bucket
        FROM rows s JOIN (SELECT segment, part, list_sort(list_distinct(quantile_cont(p, {probs}))) AS edges FROM rows GROUP BY segment, part) USING (segment, part))
  GROUP BY segment, part, bucket)
WINDOW o AS (PARTITION BY segment, part ORDER BY min_prob DESC ROWS UNBOUNDED PRECEDING)""".replace("FROM rows", f"""FROM (
          SELECT m AS segment, unnest([CASE WHEN is_test = 1 THEN 'test' ELSE 'train' END, 'all']) AS part, y, ROUND(score, {places}) AS p FROM scored)""")


def _full() -> str:
    """(m, l1, l2_, value, n): all four leaves of each tree, empty ones too."""
    return """(SELECT x.m, a.l1, b.l2, coalesce(t.value, 0) AS value, coalesce(t.n, 0) AS n
  FROM models x, (SELECT unnest([0, 1]) AS l1) a, (SELECT unnest([0, 1]) AS l2) b
  LEFT JOIN leaf t ON t.m = x.m AND t.leaf = a.l1 + 2 * b.l2)"""


def importance(places: int) -> str:
    return f"""
SELECT f.m AS segment, f.feature, ROUND(coalesce(sum(v.change), 0) * 100 / any_value(f.whole), {places}) AS importance
FROM (SELECT x.m, e.feature, e.i, (SELECT sum(change) FROM change c WHERE c.m = x.m) AS whole FROM models x, edge e) f
LEFT JOIN change v ON v.m = f.m AND v.i = f.i GROUP BY f.m, f.feature""".replace("change c", f"({_CHANGE}) c").replace("change v", f"({_CHANGE}) v")


_CHANGE = f"""
SELECT m, i, sum(w) AS change FROM (
  SELECT b1.m, b1.i, (p.value - mean) * (p.value - mean) * p.n AS w FROM b1 JOIN (
    SELECT *, sum(value * n) OVER (PARTITION BY m, l2) / greatest(sum(n) OVER (PARTITION BY m, l2), 1) AS mean FROM {_full()}) p ON p.m = b1.m
  UNION ALL
  SELECT b2.m, b2.i, (p.value - mean) * (p.value - mean) * p.n FROM b2 JOIN (
    SELECT *, sum(value * n) OVER (PARTITION BY m, l1) / greatest(sum(n) OVER (PARTITION BY m, l1), 1) AS mean FROM {_full()}) p ON p.m = b2.m)
GROUP BY m, i"""


def attribution(places: int | None) -> str:
    """(o_orderkey, feature, value, phi) of the test rows: the four expectations of a tree of
    depth 2, with its levels followed or averaged by their training rows."""
    phi = "CASE WHEN a.i1 = a.i2 AND w.i = a.i1 THEN v12 - v0 WHEN w.i = a.i1 THEN ((v1 - v0) + (v12 - v2)) / 2 " \
          "WHEN w.i = a.i2 THEN ((v2 - v0) + (v12 - v1)) / 2 ELSE 0 END"
    phi = phi if places is None else f"ROUND({phi}, {places})"
    return f"""
SELECT o_orderkey, e.feature, w.value, {phi} AS phi
FROM scored s JOIN (
  SELECT p.m, p.l1, p.l2, b1.i AS i1, b2.i AS i2, p.value AS v12,
         sum(p.value * p.n) OVER (PARTITION BY p.m) / sum(p.n) OVER (PARTITION BY p.m) AS v0,
         sum(p.value * p.n) OVER (PARTITION BY p.m, p.l1) / sum(p.n) OVER (PARTITION BY p.m, p.l1) AS v1,
         sum(p.value * side) OVER (PARTITION BY p.m, p.l2) / sum(side) OVER (PARTITION BY p.m, p.l2) AS v2
  FROM (SELECT *, sum(n) OVER (PARTITION BY m, l1) AS side FROM {_full()}) p JOIN b1 ON b1.m = p.m JOIN b2 ON b2.m = p.m) a
  ON a.m = s.m AND a.l1 + 2 * a.l2 = s.leaf
JOIN wide w USING (o_orderkey) JOIN edge e ON e.i = w.i WHERE s.is_test = 1"""
