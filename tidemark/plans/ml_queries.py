"""Registered queries: split, training, search, segments, selection, stability,
importance and attribution (build steps 9-10).

Models of many deep trees have no SQL form.  Their queries have companions of one tree
(``one_tree_*``, ``tree_sql``): the same operators on four features, with every number (cuts, leaf
values, scores, AUC, decile tables, importances, attributions) worked out in SQL."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.functions import ordinal_map
from tidemark.operators import boosting
from tidemark.operators.boosting import Spec
from tidemark.operators.evaluate import cut_labels, ks_peak, ks_statistic, ks_table, roc_auc
from tidemark.operators.explain import attribution_summary, feature_importance, importances, tree_shap
from tidemark.operators.selection import shadow_selection
from tidemark.operators.train import Search, Study, model_pipeline, pipelines, prefilter, search_many, stratified_split
from tidemark.plans import constants as K
from tidemark.plans import fixtures as fx
from tidemark.plans import tree_sql
from tidemark.plans.model_queries import _matrix_features, model_matrix_cut
from tidemark.plans.registry import register
from tidemark.session import checkpoint_dir, cut_lineage

SEED = 3
STABILITY_SEEDS = list(range(10))
KEY = "o_orderkey"


def stored(spark, root: str, name: str, build) -> dict[str, Study]:
    """Studies fitted once per application and read back by every query that reports on them.

    They lie under the checkpoint folder by application, input folder and name: the rows first, the
    document with models, candidates and selections last, so a half-written study is not
    taken for a whole one."""
    run = hashlib.md5(f"{root}|{name}".encode()).hexdigest()
    base = f"{checkpoint_dir(spark)}/tidemark-studies/{spark.conf.get('spark.app.id')}/{run}"

    def read():
        return {r["name"]: Study.from_json(r["doc"], spark.read.parquet(f"{base}/rows/{r['at']}"))
                for r in spark.read.parquet(f"{base}/doc").orderBy("at").collect()}       # one row a study
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    studies = build()
    for at, st in enumerate(studies.values()):
        st.rows.write.mode("overwrite").parquet(f"{base}/rows/{at}")
    docs = [(n, at, st.to_json()) for at, (n, st) in enumerate(studies.items())]
    spark.createDataFrame(docs, "name string, at int, doc string").coalesce(1).write.mode("overwrite").parquet(f"{base}/doc")
    return read()


def study(spark, root, validation_share: float = 0.0) -> Study:
    """The whole chain on the model matrix: filters, split, shadow selection, grid, model."""
    return stored(spark, root, f"whole-{validation_share}", lambda: {"": model_pipeline(
        model_matrix_cut(spark, root), _matrix_features(), "y", KEY, K.MODEL_GRID, SEED,
        K.CORR_THRESHOLD, K.IV_THRESHOLD, K.IV_BINS, K.TEST_SHARE, validation_share)})[""]


_SPLIT_BODY = f"""
SELECT o_orderkey, y,
       CAST(ROW_NUMBER() OVER (PARTITION BY y ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':{SEED}'),
                                                   o_orderkey)
            <= ROUND(COUNT(*) OVER (PARTITION BY y) * {K.TEST_SHARE}) AS INTEGER) AS is_test
FROM scored_orders"""
SQL_SPLIT = fx.with_views(_SPLIT_BODY, "scored_orders")


@register("stratified_split", SQL_SPLIT)
def stratified_split_query(spark, root):
    """Seeded, exactly stratified 80/20 split from a per-row hash (M5)."""
    s = fx.scored_orders(spark, root).select(KEY, "y")
    return stratified_split(s, "y", KEY, SEED, K.TEST_SHARE).select(KEY, "y", "is_test")


@register("train_and_score")
def train_and_score(spark, root):
    """The chosen model's score of every row (M7, M10, M17); no rows where no feature was accepted."""
    return study(spark, root).scored(KEY).select(KEY, F.col("label").cast("int").alias("y"), "part", "score")


@register("train_and_score_check", fx.with_views(
    "SELECT o_orderkey, y, is_test, 1 AS in_range FROM split", "scored_orders", extra=(("split", _SPLIT_BODY),)))
def train_and_score_check(spark, root):
    """Row keys, labels and split of the scored rows; the score lies in [0, 1]."""
    s = train_and_score(spark, root)
    return s.select(KEY, "y", (F.col("part") == "test").cast("int").alias("is_test"),
                    F.col("score").between(0, 1).cast("int").alias("in_range"))


@register("model_search")
def model_search(spark, root):
    """Every candidate of the search grid by test AUC - |train AUC - test AUC|, the chosen one
    flagged (M8, M9)."""
    return _candidates(spark, study(spark, root))


def _candidates(spark, st: Study):
    rows = [(c.params["iterations"], float(c.params["learning_rate"]), c.params["depth"], c.params["l2_leaf_reg"],
             c.train_auc, c.test_auc, c.score, c is st.chosen) for c in st.candidates]
    return spark.createDataFrame(rows, "max_iter int, step_size double, max_depth int, l2_leaf_reg int, "
                                       "train_auc double, test_auc double, selection_score double, chosen boolean")


SQL_SEARCH_CHECK = f"""
SELECT i AS max_iter, CAST(s AS DOUBLE) AS step_size, d AS max_depth, l AS l2_leaf_reg, 1 AS consistent
FROM (SELECT UNNEST({K.MODEL_GRID['iterations']}) AS i),
     (SELECT UNNEST({K.MODEL_GRID['learning_rate']}) AS s),
     (SELECT UNNEST({K.MODEL_GRID['depth']}) AS d),
     (SELECT UNNEST({K.MODEL_GRID['l2_leaf_reg']}) AS l)"""


@register("model_search_check", SQL_SEARCH_CHECK)
def model_search_check(spark, root):
    """The search with a validation hold-out rates every point of the grid; AUCs lie in
    [0, 1], scores follow from them, and the chosen one has the best score (M9, M17).  The rated
    numbers themselves are checked by ``one_tree_search``."""
    c = _candidates(spark, study(spark, root, validation_share=0.25))
    best = c.select(F.max("selection_score")).scalar()
    ok = (F.col("train_auc").between(0, 1) & F.col("test_auc").between(0, 1)
          & (F.abs(F.col("selection_score") - F.col("test_auc") + F.abs(F.col("train_auc") - F.col("test_auc"))) < 1e-12)
          & (~F.col("chosen") | (F.col("selection_score") == best)))
    return c.select("max_iter", "step_size", "max_depth", "l2_leaf_reg", ok.cast("int").alias("consistent"))


def _segments(spark, root, mm):
    """Model matrix rows with their payment segment; NULL payments are in neither."""
    pay = fx.scored_orders(spark, root).select(F.col(KEY).alias("_k"), "o_totalprice")
    return mm.join(pay, F.col(KEY) == F.col("_k")).withColumn(
        "segment", F.when(F.col("o_totalprice") <= K.FX_PAYMENT_SEGMENT, "small")
                    .when(F.col("o_totalprice") > K.FX_PAYMENT_SEGMENT, "large")).drop("_k", "o_totalprice")


def segment_studies(seg, features, label: str, key: str, grid: dict, keep=()) -> dict[str, Study]:
    """The whole chain on every segment of a matrix with the column ``segment``; the models of
    all segments are fitted in the same passes, the segment being part of the training key."""
    names = [r["segment"] for r in seg.select("segment").where("segment is not null").distinct().orderBy("segment").collect()]
    groups = {n: F.col("segment") == F.lit(n) for n in names}                  # one name a segment
    found = pipelines(seg, groups, features, label, key, grid, [SEED], K.CORR_THRESHOLD, K.IV_THRESHOLD, K.IV_BINS,
                      K.TEST_SHARE, keep=keep)
    return {name: st for (name, _), st in found.items()}


def _studies(spark, root) -> dict[str, Study]:
    def build():
        seg = cut_lineage(_segments(spark, root, model_matrix_cut(spark, root)))
        return segment_studies(seg, _matrix_features(), "y", KEY, K.MODEL_GRID)
    return stored(spark, root, "segments", build)


def segment_scores(studies: dict[str, Study], key: str):
    """(segment, key, part, label, score): every row of a segment that has a model, all scored in one pass."""
    fitted = {n: st for n, st in studies.items() if st.model is not None}
    wide = sorted({f for st in fitted.values() for f in st.features})
    rows = None
    for name, st in studies.items():
        one = st.rows.select(F.lit(name).alias("segment"), F.col(key), "part", "label", *[
            (F.col(f) if f in st.features else F.lit(None)).cast("double").alias(f) for f in wide])
        one = one if name in fitted else one.where("false")
        rows = one if rows is None else rows.unionByName(one)
    return boosting.score_by({n: st.model for n, st in fitted.items()}, rows, "segment").select(
        "segment", key, "part", "label", "score")


def _with_all(scored):
    """Every row in its part and in the part ``all``."""
    return scored.withColumn("part", F.explode(F.array("part", F.lit("all"))))


def segment_ks(studies, key):
    """(segment, part, decile table): the training rows, the test rows and all of them."""
    return ks_table(_with_all(cut_lineage(segment_scores(studies, key))), "label", "score", groups=["segment", "part"])


CUTS = {"large": (K.CUTS_LARGE_PAYMENT, True), "small": (K.CUTS_SMALL_PAYMENT, False)}


def segment_cuts(studies, key, cuts: dict = CUTS, default=(K.CUTS_OVERALL, False)):
    """(segment, key, part, label, score, decile): every row, its score cut by its segment's own
    list (``cuts``: segment -> list, first bin open below) or the ``default``."""
    scored = segment_scores(studies, key)
    label = cut_labels("score", default[0], K.DECILE_LABELS, first_open=default[1])
    for name, (points, first_open) in cuts.items():
        label = F.when(F.col("segment") == name, cut_labels("score", points, K.DECILE_LABELS, first_open=first_open)).otherwise(label)
    return scored.select("segment", key, "part", "label", "score", label.alias("decile"))


def segment_importances(spark, studies):
    """(segment, feature, importance, rank) of all features of a segment's model."""
    out = spark.createDataFrame([], "segment string, feature string, importance double, rank int")
    for name, st in studies.items():
        if st.model is not None:
            out = out.unionByName(feature_importance(st.model, spark).withColumn("segment", F.lit(name)).select(out.columns))
    return out


def segment_phi(spark, studies, key, key_type="long"):
    """(segment, key, feature, value, phi) of every test row of a segment."""
    out = spark.createDataFrame([], f"segment string, {key} {key_type}, feature string, value double, phi double")
    for name, st in studies.items():
        if st.model is not None:
            out = out.unionByName(tree_shap(st.model, st.rows.where("part = 'test'"), key).withColumn(
                "segment", F.lit(name)).select(out.columns))
    return out


def segment_summary(spark, studies, key, key_type="long"):
    """One row a segment, see ``segment_models``."""
    scored = cut_lineage(segment_scores(studies, key))
    auc = roc_auc(scored, "label", "score", ["segment", "part"]).groupBy("segment").agg(
        F.max(F.expr("IF(part = 'train', auc, NULL)")).alias("train_auc"), F.max(F.expr("IF(part = 'test', auc, NULL)")).alias("test_auc"))
    ks = ks_statistic(scored, "label", "score", ["segment", "part"]).groupBy("segment").agg(
        F.max(F.expr("IF(part = 'train', ks, NULL)")).alias("train_ks"), F.max(F.expr("IF(part = 'test', ks, NULL)")).alias("test_ks"))
    peak = ks_peak(ks_table(scored, "label", "score", groups=["segment"]), ["segment"])
    top = segment_importances(spark, studies).where("rank = 1").select("segment", F.col("feature").alias("top_feature"))
    size = segment_phi(spark, studies, key, key_type).groupBy("segment", F.col("feature").alias("top_feature")).agg(
        F.avg(F.abs("phi")).alias("top_mean_abs_phi"))
    base = spark.createDataFrame([(n, len(st.features) if st.model else 0) for n, st in studies.items()], "segment string, n_features int")
    rows = None
    for n, st in studies.items():
        one = st.rows.select(F.lit(n).alias("segment"))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("rows"))
    out = base.join(rows, "segment", "left").join(auc, "segment", "left").join(ks, "segment", "left").join(
        peak, "segment", "left").join(top, "segment", "left").join(size, ["segment", "top_feature"], "left")
    return out.select("segment", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), "n_features", "train_auc", "test_auc",
                      "max_ks", "at_decile", "top_feature", "top_mean_abs_phi", "train_ks", "test_ks")


@register("segment_models")
def segment_models(spark, root):
    """The whole chain per payment segment (P16, M20): rows, features, AUC on train and test,
    peak KS of the decile table and its decile, most important feature, mean |phi| of it on
    the test rows, KS statistic on train and test."""
    return segment_summary(spark, _studies(spark, root), KEY)


@register("segment_ks_tables")
def segment_ks_tables(spark, root):
    """Decile tables of each segment's model on train, test and all rows."""
    return segment_ks(_studies(spark, root), KEY)


@register("segment_cut_deciles")
def segment_cut_deciles(spark, root):
    """Each segment model's scores under the segment's fixed cut-offs."""
    return segment_cuts(_studies(spark, root), KEY)


@register("segment_importance")
def segment_importance(spark, root):
    """Importance of each feature of each segment's model."""
    return segment_importances(spark, _studies(spark, root))


@register("segment_attribution")
def segment_attribution(spark, root):
    """Feature value and phi of every test row and feature of each segment's model."""
    return segment_phi(spark, _studies(spark, root), KEY)


@register("segment_attribution_summary")
def segment_attribution_summary(spark, root):
    """Mean |phi| per feature over the test rows of each segment."""
    return segment_phi(spark, _studies(spark, root), KEY).groupBy("segment", "feature").agg(
        F.avg(F.abs("phi")).alias("mean_abs_phi"), F.count(F.lit(1)).alias("rows"))


SQL_SEGMENT_SPLIT = fx.with_views(f"""
SELECT segment, y, is_test, COUNT(*) AS n
FROM (SELECT segment, y,
             CAST(ROW_NUMBER() OVER (PARTITION BY segment, y ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':{SEED}'),
                                     o_orderkey)
                  <= ROUND(COUNT(*) OVER (PARTITION BY segment, y) * {K.TEST_SHARE}) AS INTEGER) AS is_test
      FROM (SELECT *, CASE WHEN o_totalprice <= {K.FX_PAYMENT_SEGMENT} THEN 'small' ELSE 'large' END AS segment
            FROM scored_orders WHERE o_totalprice IS NOT NULL))
GROUP BY segment, y, is_test""", "scored_orders")


@register("segment_split_counts", SQL_SEGMENT_SPLIT)
def segment_split_counts(spark, root):
    """Rows per segment, label and side of the segment's own split."""
    seg = _segments(spark, root, fx.scored_orders(spark, root).select(KEY, "y"))
    parts = [stratified_split(seg.where(F.col("segment") == s), "y", KEY, SEED, K.TEST_SHARE) for s in ("small", "large")]
    return parts[0].unionByName(parts[1]).groupBy("segment", "y", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("shadow_selection")
def shadow_selection_query(spark, root):
    """Shadow-feature (all-relevant) selection on the training rows (M6)."""
    mm = model_matrix_cut(spark, root)
    feats = prefilter(mm, _matrix_features(), "y", K.CORR_THRESHOLD, K.IV_THRESHOLD, K.IV_BINS)
    train = stratified_split(mm, "y", KEY, SEED, K.TEST_SHARE).where("is_test = 0")
    return shadow_selection(train, feats, "y", KEY, seed=SEED)


@register("shadow_selection_check", "SELECT * FROM (VALUES ('planted', 1), ('noise_1', 0), ('noise_2', 0)) t(feature, accepted)")
def shadow_selection_check(spark, root):
    """A planted copy of the label with errors is accepted, hashed noise is not (M6)."""
    h = lambda n: F.pmod(F.xxhash64(KEY, F.lit(n)), F.lit(10_000)).cast("double")
    df = fx.scored_orders(spark, root).select(
        KEY, "y", (F.col("y") * 4000 + h(0)).alias("planted"), h(1).alias("noise_1"), h(2).alias("noise_2"))
    sel = shadow_selection(df, ["planted", "noise_1", "noise_2"], "y", KEY, seed=SEED)
    return sel.select("feature", F.col("accepted").cast("int").alias("accepted"))


def seed_studies(spark, root, seeds=STABILITY_SEEDS, grid: dict = K.SEED_GRID, fit: bool = True) -> dict[int, Study]:
    """The chain of every seed on the filtered matrix: split and selection of their own, all
    models of all seeds fitted in the same passes (M18)."""
    mm = model_matrix_cut(spark, root)
    feats = prefilter(mm, _matrix_features(), "y", K.CORR_THRESHOLD, K.IV_THRESHOLD, K.IV_BINS)
    found = pipelines(mm, {"": F.lit(True)}, feats, "y", KEY, grid, seeds, test_share=K.TEST_SHARE, prefiltered=True, fit=fit)
    return {seed: st for (_, seed), st in found.items()}


def seed_stability_df(spark, studies: dict[int, Study]):
    """Per seed: train/test AUC of the chosen model, their distance and the selected features."""
    rows = []
    for seed, st in studies.items():
        a, b = (st.chosen.train_auc, st.chosen.test_auc) if st.chosen else (None, None)
        rows.append((seed, a, b, abs(a - b) if st.chosen else None, st.features))
    return spark.createDataFrame(rows, "seed int, train_auc double, test_auc double, delta_auc double, features array<string>")


@register("seed_stability")
def seed_stability(spark, root):
    """AUC and selected features per seed, each with its own grid search."""
    return seed_stability_df(spark, seed_studies(spark, root))


SQL_FREQUENCY = """
SELECT feature, COUNT(*) AS count, AVG(n_features) AS avg_list_size
FROM (SELECT unnest(features) AS feature, len(features) AS n_features
      FROM (SELECT l_orderkey, list(DISTINCT l_returnflag) AS features FROM lineitem GROUP BY l_orderkey))
GROUP BY feature"""


def frequency_of(lists):
    """(feature, count, avg_list_size): how often each name occurs in an array column
    ``features``, and the mean length of the lists that hold it (M19, A12, A14)."""
    st = lists.withColumn("n_features", F.size("features"))
    return (st.select("n_features", F.explode("features").alias("feature"))
            .groupBy("feature").agg(F.count(F.lit(1)).alias("count"),
                                    F.avg("n_features").alias("avg_list_size")))


@register("list_frequency", SQL_FREQUENCY)
def list_frequency(spark, root):
    """Occurrence of names over a table of lists, here the return flags of each order."""
    return frequency_of(fx.table(spark, root, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set("l_returnflag").alias("features")))


@register("selection_frequency")
def selection_frequency(spark, root):
    """How often each feature was selected across seeds, and list sizes (M19): the splits and
    selections of ``seed_stability`` without its fits."""
    return frequency_of(seed_stability_df(spark, seed_studies(spark, root, fit=False)).select("features"))


@register("feature_importance")
def feature_importance_query(spark, root):
    """Importance of each feature of the chosen model, sorted and ranked."""
    st = study(spark, root)
    if st.model is None:
        return spark.createDataFrame([], "feature string, importance double, rank int")
    return feature_importance(st.model, spark)


def _attribution(spark, root):
    """(o_orderkey, feature, value, phi) of the chosen model on all test rows."""
    st = study(spark, root)
    if st.model is None:
        return spark.createDataFrame([], f"{KEY} long, feature string, value double, phi double")
    return tree_shap(st.model, st.rows.where("part = 'test'"), KEY)


@register("attribution_rows")
def attribution_rows(spark, root):
    """Feature value and phi of every test row and feature (M16, the scatter view's table)."""
    return _attribution(spark, root)


@register("attribution_summary")
def attribution_summary_query(spark, root):
    """Mean |phi| per feature over all test rows."""
    return attribution_summary(_attribution(spark, root))


@register("attribution_check", fx.with_views(
    "SELECT o_orderkey, 1 AS adds_up FROM split WHERE is_test = 1", "scored_orders", extra=(("split", _SPLIT_BODY),)))
def attribution_check(spark, root):
    """Per test row, the attributions and the model's mean add up to the row's log-odds."""
    from tidemark.operators.explain import expected_raw
    st = study(spark, root)
    if st.model is None:
        return spark.createDataFrame([], f"{KEY} long, adds_up int")
    phi = _attribution(spark, root).groupBy(KEY).agg(F.sum("phi").alias("phi"))
    raw = F.ln(F.col("score") / (1 - F.col("score")))
    return st.scored(KEY).where("part = 'test'").join(phi, KEY).select(
        KEY, (F.abs(F.col("phi") + expected_raw(st.model) - raw) < 1e-9).cast("int").alias("adds_up"))


# ------------------------------------------------------------- one tree, in Spark and in SQL

TREE_FEATURES = ("price", "balance", "kind", "noise")
TREE_GRID = {"iterations": [1], "learning_rate": [0.05], "depth": [1, 2], "l2_leaf_reg": [10, 20]}
_R = 9                                     # places that fitted numbers are compared to


def tree_rows(spark, root, marks: dict):
    """Scored orders with four features and one fold column per mark: (condition, seed) -> 0 on
    training rows, 1 on test rows, NULL on rows outside the condition."""
    c = fx.table(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    rows = fx.scored_orders(spark, root).join(c, "o_custkey", "left").select(
        KEY, "y", F.col("o_totalprice").cast("double").alias("price"), F.col("c_acctbal").cast("double").alias("balance"),
        ordinal_map("c_mktsegment", K.FX_BUSINESS_TYPE_ORDER).cast("double").alias("kind"),
        (F.col(KEY) * 7919 % 1000).cast("double").alias("noise"))
    rows = cut_lineage(rows)
    out = rows
    for name, (where, seed) in marks.items():
        part = stratified_split(rows.where(where), "y", KEY, seed, K.TEST_SHARE).select(F.col(KEY).alias("_k"), F.col("is_test").alias(name))
        out = out.join(part, F.col(KEY) == F.col("_k"), "left").drop("_k")
    return cut_lineage(out)


def _one_tree(spark, root, marks: dict, depth: int = 2, l2: float = 10.0):
    """(rows, fold -> model) of one tree per mark, all fitted together."""
    rows = tree_rows(spark, root, marks)
    models, *_ = boosting.fit_many(rows, [Spec(TREE_FEATURES, depth, 0.05, l2, 1, m) for m in marks], "y", KEY)
    return rows, dict(zip(marks, models))


WHOLE = {"fold": ("true", SEED)}
PARTS = {"small": (f"price <= {K.FX_PAYMENT_SEGMENT}", SEED), "large": (f"price > {K.FX_PAYMENT_SEGMENT}", SEED)}


@register("one_tree", tree_sql.query(WHOLE, {"fold": (2, 10)}, f"""
SELECT t.leaf, ROUND(t.value, {_R}) AS value, t.n AS cover, c1.feature AS feature_1, ROUND(c1.edges[b1.cut + 1], {_R}) AS cut_1,
       c2.feature AS feature_2, ROUND(c2.edges[b2.cut + 1], {_R}) AS cut_2
FROM leaf t JOIN b1 ON b1.m = t.m JOIN b2 ON b2.m = t.m JOIN edge c1 ON c1.i = b1.i JOIN edge c2 ON c2.i = b2.i"""))
def one_tree(spark, root):
    """The tree of depth 2 with L2 10 on the training rows: cuts, leaf values, training rows per
    leaf (M7)."""
    _, models = _one_tree(spark, root, WHOLE)
    model = models["fold"]
    t = model.trees[0]
    cuts = [(model.features[f], round(model.edges[f][c], _R)) for f, c in zip(t.features, t.cuts)]
    rows = [(i, round(float(v), _R), int(n), *cuts[0], *cuts[1]) for i, (v, n) in enumerate(zip(t.values, t.covers))]
    return spark.createDataFrame(rows, "leaf int, value double, cover long, feature_1 string, cut_1 double, feature_2 string, cut_2 double")


@register("one_tree_scores", tree_sql.query(WHOLE, {"fold": (2, 10)}, f"""
SELECT o_orderkey, y, CASE WHEN is_test = 1 THEN 'test' ELSE 'train' END AS part, ROUND(score, {_R}) AS score FROM scored"""))
def one_tree_scores(spark, root):
    """Score of every row by the tree."""
    rows, models = _one_tree(spark, root, WHOLE)
    return boosting.score(models["fold"], rows).select(
        KEY, "y", F.when(F.col("fold") == 1, "test").otherwise("train").alias("part"), F.round("score", _R).alias("score"))


_SEARCH_MODELS = {f"{d}-{l2}": (d, l2) for d in TREE_GRID["depth"] for l2 in TREE_GRID["l2_leaf_reg"]}


@register("one_tree_search", tree_sql.query({m: ("true", SEED) for m in _SEARCH_MODELS}, _SEARCH_MODELS, f"""
SELECT 1 AS max_iter, CAST(0.05 AS DOUBLE) AS step_size, depth AS max_depth, l2 AS l2_leaf_reg,
       ROUND(train_auc, {_R}) AS train_auc, ROUND(test_auc, {_R}) AS test_auc,
       ROUND(test_auc - abs(train_auc - test_auc), {_R}) AS selection_score
FROM (SELECT m, max(auc) FILTER (is_test = 0) AS train_auc, max(auc) FILTER (is_test = 1) AS test_auc FROM auc GROUP BY m)
JOIN models USING (m)"""))
def one_tree_search(spark, root):
    """A grid of depths and L2 weights rated by AUC on train and test rows."""
    rows = tree_rows(spark, root, WHOLE)
    found = search_many(rows, [Search(TREE_FEATURES, "fold", TREE_GRID)], "y", KEY)[0]
    return spark.createDataFrame(
        [(c.params["iterations"], c.params["learning_rate"], c.params["depth"], c.params["l2_leaf_reg"], round(c.train_auc, _R),
          round(c.test_auc, _R), round(c.score, _R)) for c in found.candidates],
        "max_iter int, step_size double, max_depth int, l2_leaf_reg int, train_auc double, test_auc double, selection_score double")


_SEED_MARKS = {f"s{seed}": ("true", seed) for seed in STABILITY_SEEDS}


@register("one_tree_stability", tree_sql.query(_SEED_MARKS, {m: (1, 10) for m in _SEED_MARKS}, f"""
SELECT CAST(substr(m, 2) AS INTEGER) AS seed, CAST(sum(n) FILTER (is_test = 0) AS BIGINT) AS train_rows,
       CAST(sum(n) FILTER (is_test = 1) AS BIGINT) AS test_rows, ROUND(max(auc) FILTER (is_test = 0), {_R}) AS train_auc,
       ROUND(max(auc) FILTER (is_test = 1), {_R}) AS test_auc,
       ROUND(abs(max(auc) FILTER (is_test = 0) - max(auc) FILTER (is_test = 1)), {_R}) AS delta_auc
FROM auc GROUP BY m"""))
def one_tree_stability(spark, root):
    """Split sizes and AUC of every seed's own split, tree and scores (M18, M5): the search of
    all seeds in one pass, as ``seed_stability`` runs it."""
    rows = tree_rows(spark, root, _SEED_MARKS)
    grid = {"iterations": [1], "learning_rate": [0.05], "depth": [1], "l2_leaf_reg": [10]}
    found = search_many(rows, [Search(TREE_FEATURES, m, grid) for m in _SEED_MARKS], "y", KEY)
    sizes = rows.agg(*[F.count(F.when(F.col(m) == v, 1)).alias(f"{m}_{v}") for m in _SEED_MARKS for v in (0, 1)]).first()
    return spark.createDataFrame(
        [(int(m[1:]), sizes[f"{m}_0"], sizes[f"{m}_1"], round(c.train_auc, _R), round(c.test_auc, _R), round(abs(c.train_auc - c.test_auc), _R))
         for m, f in zip(_SEED_MARKS, found) for c in f.candidates],
        "seed int, train_rows long, test_rows long, train_auc double, test_auc double, delta_auc double")


def _segment_trees(spark, root):
    """Test rows and training rows of both segments with the segment's tree."""
    rows, models = _one_tree(spark, root, PARTS)
    seg = rows.withColumn("segment", F.when(F.col("small").isNotNull(), "small").when(F.col("large").isNotNull(), "large"))
    seg = seg.where("segment is not null").withColumn("part", F.when(F.coalesce("small", "large") == 1, "test").otherwise("train"))
    return seg, models


@register("one_tree_segments", tree_sql.query(PARTS, {m: (2, 10) for m in PARTS}, f"""
SELECT m AS segment, CASE WHEN is_test = 1 THEN 'test' ELSE 'train' END AS part, n AS rows, ROUND(auc, {_R}) AS auc, ROUND(ks, {_R}) AS ks
FROM auc"""))
def one_tree_segments(spark, root):
    """Rows, AUC and KS of each segment's own tree on train and test rows."""
    seg, models = _segment_trees(spark, root)
    scored = cut_lineage(boosting.score_by(models, seg, "segment"))
    by = ["segment", "part"]
    return roc_auc(scored, "y", "score", by).join(ks_statistic(scored, "y", "score", by), by).select(
        *by, (F.col("positives") + F.col("negatives")).alias("rows"), F.round("auc", _R).alias("auc"), F.round("ks", _R).alias("ks"))


@register("one_tree_deciles", tree_sql.query(PARTS, {m: (2, 10) for m in PARTS}, tree_sql.decile_table(_R)))
def one_tree_deciles(spark, root):
    """Decile tables of each segment's scores on train, test and all rows."""
    seg, models = _segment_trees(spark, root)
    scored = cut_lineage(boosting.score_by(models, seg, "segment").withColumn("score", F.round("score", _R)))
    t = ks_table(_with_all(scored), "y", "score", groups=["segment", "part"])
    return t.select("segment", "part", "decile", "min_prob", "max_prob", "events", "nonevents",
                    *[F.round(c, _R).alias(c) for c in ("event_rate", "cum_eventrate", "cum_noneventrate", "ks", "cure_rate")])


@register("one_tree_importance", tree_sql.query(PARTS, {m: (2, 10) for m in PARTS}, tree_sql.importance(_R)))
def one_tree_importance(spark, root):
    """Importance of every feature of each segment's tree."""
    _, models = _one_tree(spark, root, PARTS)
    return spark.createDataFrame([(m, f, round(v, _R)) for m, model in models.items() for f, v in zip(model.features, importances(model))],
                                 "segment string, feature string, importance double")


@register("one_tree_attribution", tree_sql.query(WHOLE, {"fold": (2, 10)}, tree_sql.attribution(_R)))
def one_tree_attribution(spark, root):
    """Exact attribution of every test row and feature."""
    rows, models = _one_tree(spark, root, WHOLE)
    return tree_shap(models["fold"], rows.where("fold = 1"), KEY).select(KEY, "feature", "value", F.round("phi", _R).alias("phi"))


@register("one_tree_attribution_summary", tree_sql.query(PARTS, {m: (2, 10) for m in PARTS}, f"""
SELECT segment, feature, ROUND(AVG(abs(phi)), {_R}) AS mean_abs_phi, COUNT(*) AS rows
FROM ({tree_sql.attribution(None)}) GROUP BY segment, feature""".replace("SELECT o_orderkey,", "SELECT s.m AS segment, o_orderkey,")))
def one_tree_attribution_summary(spark, root):
    """Mean |phi| per segment and feature over the segment's test rows."""
    seg, models = _segment_trees(spark, root)
    out = None
    for name, model in models.items():
        phi = tree_shap(model, seg.where((F.col("segment") == name) & (F.col("part") == "test")), KEY).withColumn("segment", F.lit(name))
        out = phi if out is None else out.unionByName(phi)
    return out.groupBy("segment", "feature").agg(F.round(F.avg(F.abs("phi")), _R).alias("mean_abs_phi"), F.count(F.lit(1)).alias("rows"))
