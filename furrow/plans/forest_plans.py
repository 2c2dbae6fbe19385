"""Queries of the classifier: splits, training, validation, probability rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions.ranking import attach_scalar
from furrow.operators import forest as M
from furrow.operators import panel as P
from furrow.operators import sampling as A
from furrow.operators import spatial as G
from furrow.plans.base import obs, rnd, stack, table
from furrow.plans.raster_plans import layer
from furrow.plans.registry import query
from furrow.session import cut_lineage

FEATURES = ["n_chars", "n_words", "mean_word", "punct", "upper", "lines", "digits"]
#: Published sizes: the retrained classifier, and the one behind rasters, importance and block validation.
BALANCED = dict(trees=500, depth=12, min_leaf=1, subset="sqrt", balanced=True)
PLAIN = dict(trees=300, depth=12, min_leaf=5, subset="3")
FOLDS = 5


def samples(s, d):
    """Labelled feature rows: text shape features against the quality class."""
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda pat: F.length(F.regexp_replace("text", pat, "")) / n
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    return j.select(
        "doc_id", "quality", "toxic", F.col("n_chars").cast("double"), words.cast("double").alias("n_words"), (n / words).alias("mean_word"),
        (1 - share("[.,;:!?]")).alias("punct"), (1 - share("[A-Z]")).alias("upper"), (n - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("double").alias("lines"), (1 - share("[0-9]")).alias("digits"),
    )


@query(
    "m01_stratified_split",
    """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', doc_id, '42')), doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, rn <= ceil(n * 0.8::DOUBLE) AS is_train FROM r""",
)
def m01(s, d):
    return A.stratified_split(table(s, d, "labels"), ["quality"], ["doc_id"], 0.8).select("doc_id", "quality", "is_train")


@query(
    "m01_random_split",
    "SELECT doc_id, CAST('0x' || substr(md5(concat_ws('|', doc_id, '42')), 1, 13) AS BIGINT) / pow(16, 13) < 0.7 AS is_train FROM labels",
)
def m01_random(s, d):
    from furrow.functions.scalar import hash_uniform

    return table(s, d, "labels").select("doc_id", (hash_uniform("doc_id") < 0.7).alias("is_train"))


@query(
    "m06_stratified_folds",
    """SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', doc_id, '42')), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels""",
)
def m06_folds(s, d):
    return A.stratified_folds(table(s, d, "labels"), ["quality"], ["doc_id"], 5).select("doc_id", "quality", "fold")


def split(s, d):
    # every tree level reads the table again: write the features once
    f = cut_lineage(A.stratified_split(samples(s, d), ["quality"], ["doc_id"], 0.8))
    return f.where("is_train"), f.where("not is_train")


@query("m02_m03_forest_predictions")
def m02(s, d):
    train, test = split(s, d)
    return M.predict(M.train_forest(train, FEATURES, "quality", **BALANCED), test, FEATURES, ["doc_id", "quality"])


@query("m04_class_probability_raster")
def m04(s, d):
    cells = stack(obs(s, d), ["user_id"]).join(layer(s, d), "user_id").na.fill(0.0)
    cls = F.when((F.col("b8") > 52) & (F.col("occurrence") < 55), 2).when(F.col("b4") < 45, 1).otherwise(0)
    cells = cut_lineage(cells.withColumn("label", cls))
    feats = ["b8", "b4", "b3", "b11", "vh", "occurrence"]
    model = M.train_forest(cells, feats, "label", **PLAIN)
    return M.class_probability(model, cells, feats, ["user_id"], 2, "flood_prob").withColumn("flood_prob", rnd("flood_prob"))


@query("m05_feature_importance")
def m05(s, d):
    train, _ = split(s, d)
    return M.importance(s, M.train_forest(train, FEATURES, "quality", **PLAIN), FEATURES)


def out_of_fold(s, d):
    f = cut_lineage(A.stratified_folds(samples(s, d), ["quality"], ["doc_id"], FOLDS))
    return M.cross_validate(f, FEATURES, "quality", "fold", FOLDS, ["doc_id"], **BALANCED)


@query("m06_cross_validation")
def m06(s, d):
    return M.fold_accuracy(out_of_fold(s, d), "quality", "fold")


@query(
    "m06_pooled_scores",
    "SELECT count(*) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, round(max(n_class) / count(*)::DOUBLE + 1e-9, 6) + 0.0 AS majority, true AS above_majority, true AS macro_f1_above_half FROM (SELECT doc_id, count(*) OVER (PARTITION BY quality) AS n_class FROM labels JOIN documents USING (doc_id))",
)
def m06_pooled(s, d):
    """Accuracy and macro F1 of all out-of-fold predictions; SQL holds the rows and what the scores must exceed."""
    pred = cut_lineage(out_of_fold(s, d))
    p = M.pooled_scores(pred, "quality")
    docs = pred.agg(F.count_distinct("doc_id").alias("n_docs"))
    return attach_scalar(p, docs).select("n", "n_docs", rnd("majority").alias("majority"), (F.col("oa") > F.col("majority")).alias("above_majority"), (F.col("macro_f1") > 0.5).alias("macro_f1_above_half"))


def block_folds(s, d):
    e = table(s, d, "embeddings")
    pts = e.select("vec_id", (F.col("label") >= 5).cast("int").alias("cls"), (F.lit(84.5) + F.col("embedding")[0] * 10).cast("double").alias("lon"), (F.lit(19.5) + F.col("embedding")[1] * 10).cast("double").alias("lat"),
                   *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(2, 8)])
    return cut_lineage(G.with_fold(pts, G.block_folds(pts, 0.5, FOLDS), 0.5))


@query("m07_spatial_block_validation")
def m07(s, d):
    pred = M.cross_validate(block_folds(s, d), [f"f{i}" for i in range(2, 8)], "cls", "fold", FOLDS, ["vec_id"], **PLAIN)
    return M.with_mean(M.fold_accuracy(pred, "cls", "fold"), "fold").withColumns({"oa": rnd("oa"), "kappa": rnd("kappa")})


@query("m08_feature_ablation")
def m08(s, d):
    train, test = split(s, d)
    sets = {"all": FEATURES, "no_counts": [f for f in FEATURES if f not in ("n_chars", "n_words")]}
    parts = [
        M.predict(M.train_forest(train, fs, "quality", **PLAIN), test, fs, ["doc_id", "quality"]).withColumn("feature_set", F.lit(name)) for name, fs in sets.items()
    ]
    both = parts[0].unionByName(parts[1])
    return both.groupBy("feature_set").agg(F.count("*").alias("n"), F.avg((F.col("quality") == F.col("pred")).cast("double")).alias("oa"))


@query("m02_imputed_training")
def m02_imputed(s, d):
    """Missing features are filled by class medians before training."""
    # the medians read the table over and over: work the texts once
    raw = cut_lineage(samples(s, d).withColumn("punct", F.when(F.col("toxic") != 1, F.col("punct"))))
    filled = cut_lineage(P.impute_by_class(raw, "quality", FEATURES))
    return M.importance(s, M.train_forest(filled, FEATURES, "quality", **BALANCED), FEATURES)
