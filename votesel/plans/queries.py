"""Registered queries: one per operator of the inventory, each over the driver's tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names and rounding (doubles to 6 decimals, integers as bigint) match the DuckDB
oracle in ``votesel.plans.oracle``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from votesel.operators import attributes as A
from votesel.operators import complexity as C
from votesel.operators import threshold as TH
from votesel.operators import votes as V
from votesel.operators.discretize import class_list, mdl_best, mdl_candidates, mdl_discretize, prepare_histogram, value_histogram
from votesel.operators.info import class_entropy, nominal_contingency
from votesel.operators.selectors import Blocks, cfs_select, class_scores, coded_rows, ig_select, pair_su
from votesel.operators.split import assign_folds, attrs_frame, deal_rows, horizontal_assignment, train_test_split, vertical_partition
from votesel.session import cut_lineage, ensure_checkpoint_dir, materialize
from votesel.sources import fixtures as FX
from votesel.sources.text import parse_lines, read_text_table

# Fixed parameters of the registered queries (the oracle SQL uses the same values).
PARTS = 4
ROUNDS = 5
SEED = 42
TOP_K = 4
EMB_PARTS = 4
EMB_K = 8
OVERLAP = 0.25
ALPHA = 0.75


def present(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 decimals, integral types widened to bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ------------------------------------------------------------------ shared inputs


def band(spark, sf):
    return FX.lineitem_band(spark, sf)


def band_train(spark, sf):
    train, _ = train_test_split(band(spark, sf))
    return materialize(train)


def band_attrs(spark, sf):
    return A.typed_attributes(band(spark, sf))


def band_blocks(spark, sf) -> tuple[Blocks, list[str]]:
    train = band_train(spark, sf)
    attrs = A.typed_attributes(train)
    rows, places = deal_rows(train, PARTS, ROUNDS, SEED)
    return Blocks(train, attrs, dealt=rows, places=places), class_list(train)


def band_global(spark, sf) -> tuple[Blocks, list[str]]:
    """Whole training table as one scope (round = part = 0)."""
    train = band_train(spark, sf)
    attrs = A.typed_attributes(train)
    vpart = attrs_frame(spark, attrs).select(F.lit(0).alias("round"), F.lit(0).alias("part"), "idx", "feature", F.lit(False).alias("shared"))
    return Blocks(train, attrs, vpart=vpart), class_list(train)


def band_ig_votes(spark, sf):
    bl, classes = band_blocks(spark, sf)
    picked = materialize(ig_select(bl, classes, TOP_K))
    attrs_df = attrs_frame(spark, bl.attrs)
    return picked, bl, attrs_df


def band_totals(spark, sf):
    picked, bl, attrs_df = band_ig_votes(spark, sf)
    return materialize(V.vote_totals(V.partition_votes(picked, bl.blocks(), attrs_df, ROUNDS))), bl


def band_measures(spark, sf, train=None):
    train = train if train is not None else band_train(spark, sf)
    return C.feature_measures(C.class_feature_stats(train, A.typed_attributes(train)))


def text_table(spark, sf, class_first=False):
    return parse_lines(FX.band_lines(spark, sf, class_first), class_first=class_first)


# ------------------------------------------------------------------ sources, schema


def q_csv_scan(spark, sf):
    return present(text_table(spark, sf))


def q_class_first(spark, sf):
    return present(text_table(spark, sf, class_first=True))


def _text_files(spark, sf):
    """Rows and quarantined lines of text files written from the ragged lines."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/votesel-text/{uuid.uuid4().hex}"
    FX.ragged_lines(spark, sf).write.text(path)
    return read_text_table(spark, path, n_fields=5)


def q_text_file_scan(spark, sf):
    rows, _ = _text_files(spark, sf)
    return present(rows.drop("row_id"))


def q_quarantine_lines(spark, sf):
    _, bad = _text_files(spark, sf)
    return present(bad.drop("row_id"))


def q_infer_attributes(spark, sf):
    return present(A.infer_attributes_df(text_table(spark, sf)))


def q_cast_numeric(spark, sf):
    t = text_table(spark, sf)
    return present(A.cast_numeric(t, A.infer_attributes(t)))


def q_nominal_domains(spark, sf):
    b = band(spark, sf)
    return present(A.nominal_domains(b, A.typed_attributes(b)))


def q_encode_nominal(spark, sf):
    b = band(spark, sf)
    nom = [a for a in A.typed_attributes(b) if a.kind == A.NOMINAL]
    cells = A.encoded_cells(b, nom)
    return present(cells.select("row_id", "feature", F.col("x").cast("bigint").alias("code")))


def q_drop_rare_classes(spark, sf):
    return present(A.drop_rare_classes(FX.order_lines(spark, sf), 2).select("row_id", "class"))


def q_melt_cells(spark, sf):
    b = band(spark, sf)
    return present(A.melt_cells(b, A.typed_attributes(b)))


def q_project_selected(spark, sf):
    b = band(spark, sf)
    attrs = A.typed_attributes(b)
    return present(A.project_selected(b, attrs, [a.name for a in attrs if a.kind == A.NUMERIC]))


def q_class_priors(spark, sf):
    return present(A.class_priors(band_train(spark, sf)))


# ------------------------------------------------------------------ split, partitions


def q_train_test_split(spark, sf):
    return present(assign_folds(band(spark, sf)).select("row_id", "class", "fold"))


def q_union_train_test(spark, sf):
    train, test = train_test_split(band(spark, sf))
    return present(
        train.select("row_id", "class", F.lit(False).alias("is_test")).unionByName(
            test.select("row_id", "class", F.lit(True).alias("is_test"))
        )
    )


def q_horizontal_partition(spark, sf):
    train, _ = train_test_split(band(spark, sf).select("row_id", "class"))
    return present(horizontal_assignment(cut_lineage(train, free_shuffles=True), PARTS, ROUNDS, SEED))


def _emb_parts(spark, sf, overlap):
    """The vertical partitioning with the value count and range of every feature dealt."""
    e = FX.embedding_wide(spark, sf)
    attrs = A.typed_attributes(e)
    vpart = vertical_partition(attrs_frame(spark, attrs), EMB_PARTS, ROUNDS, SEED, overlap)
    held = A.melt_cells(e, attrs).groupBy("idx").agg(F.count("num").alias("n_values"), F.min("num").alias("lowest"), F.max("num").alias("highest"))
    return vpart.join(held, "idx")


def q_vertical_partition(spark, sf):
    return present(_emb_parts(spark, sf, 0.0))


def q_vertical_overlap(spark, sf):
    return present(_emb_parts(spark, sf, OVERLAP))


# ------------------------------------------------------------------ information measures


def q_contingency(spark, sf):
    bl, _ = band_blocks(spark, sf)
    return present(nominal_contingency(bl.cells().where(F.col("cat").isNotNull()), ["round", "part"]))


def q_class_entropy(spark, sf):
    bl, _ = band_blocks(spark, sf)
    return present(class_entropy(bl.values(), keys=["round", "part"]))


def _global_hist(spark, sf):
    bl, classes = band_global(spark, sf)
    cells = bl.cells().where(F.col("num").isNotNull())
    return value_histogram(cells, ["round", "part", "idx"], classes), classes


def q_mdl_best_cut(spark, sf):
    hist, classes = _global_hist(spark, sf)
    keys = ["round", "part", "idx"]
    cum, roots = prepare_histogram(hist, keys, len(classes))
    best = mdl_best(mdl_candidates(cum, roots, keys, len(classes)), keys, len(classes))
    return present(best.select("idx", "cut", "e", "gain", "n", "accepted"))


def q_mdl_discretize(spark, sf):
    hist, classes = _global_hist(spark, sf)
    _, cuts = mdl_discretize(hist, ["round", "part", "idx"], len(classes))
    return present(cuts.select("idx", "cut", "depth"))


def _band_scores(spark, sf):
    bl, classes = band_blocks(spark, sf)
    scores, cuts = class_scores(bl, classes)
    return bl, classes, scores, cuts


def q_info_gain(spark, sf):
    _, _, scores, _ = _band_scores(spark, sf)
    return present(scores.select("round", "part", "idx", "ig"))


def q_symm_uncertainty_class(spark, sf):
    _, _, scores, _ = _band_scores(spark, sf)
    return present(scores.select("round", "part", "idx", "su"))


def _global_pairs(spark, sf):
    bl, classes = band_global(spark, sf)
    scores, cuts = class_scores(bl, classes)
    coded = materialize(coded_rows(bl, cuts))
    chosen = attrs_frame(spark, bl.attrs).select(F.lit(0).alias("round"), F.lit(0).alias("part"), F.col("idx").alias("c"))
    return scores, pair_su(coded, chosen)


def q_symm_uncertainty_pair(spark, sf):
    _, su = _global_pairs(spark, sf)
    return present(su.select(F.col("c").alias("idx_a"), F.col("idx").alias("idx_b"), "su"))


def q_rank_top_k(spark, sf):
    bl, classes = band_blocks(spark, sf)
    return present(ig_select(bl, classes, TOP_K))


def q_cfs_merit(spark, sf):
    scores, su = _global_pairs(spark, sf)
    r = scores.select("idx", F.col("su").alias("rcf"))
    single = r.select(F.col("idx").alias("idx_a"), F.col("idx").alias("idx_b"), F.col("rcf").alias("merit"))
    pairs = (
        su.where(F.col("c") < F.col("idx"))
        .join(r.withColumnRenamed("idx", "c").withColumnRenamed("rcf", "r_a"), "c")
        .join(r.withColumnRenamed("rcf", "r_b"), "idx")
        .select(
            F.col("c").alias("idx_a"),
            F.col("idx").alias("idx_b"),
            ((F.col("r_a") + F.col("r_b")) / F.sqrt(2 + 2 * F.col("su"))).alias("merit"),
        )
    )
    return present(single.unionByName(pairs))


def q_cfs_select(spark, sf):
    bl, classes, scores, cuts = _band_scores(spark, sf)
    return present(cfs_select(bl, classes, scores, cuts))


def q_cfs_mean_size(spark, sf):
    bl, classes, scores, cuts = _band_scores(spark, sf)
    picked = materialize(cfs_select(bl, classes, scores, cuts).select("round", "part", "idx"))
    return present(V.cfs_mean_size(picked, bl.blocks(), len(bl.attrs)))


# ------------------------------------------------------------------ votes


def q_partition_votes_h(spark, sf):
    picked, bl, attrs_df = band_ig_votes(spark, sf)
    return present(V.partition_votes(picked, bl.blocks(), attrs_df, ROUNDS))


def q_partition_votes_v(spark, sf):
    e = FX.embedding_wide(spark, sf)
    train, _ = train_test_split(e)
    train = materialize(train)
    attrs = A.typed_attributes(train)
    adf = attrs_frame(spark, attrs)
    vpart = materialize(vertical_partition(adf, EMB_PARTS, ROUNDS, SEED, 0.0))
    bl = Blocks(train, attrs, vpart=vpart)
    picked = ig_select(bl, class_list(train), EMB_K)
    return present(V.partition_votes(picked, bl.blocks(), adf, ROUNDS))


def q_vote_totals(spark, sf):
    totals, _ = band_totals(spark, sf)
    return present(totals)


def q_vote_stats(spark, sf):
    totals, _ = band_totals(spark, sf)
    return present(V.vote_stats(totals))


def q_zero_vote_features(spark, sf):
    totals, _ = band_totals(spark, sf)
    return present(V.zero_vote_features(totals))


def q_part_stats(spark, sf):
    picked, bl, _ = band_ig_votes(spark, sf)
    return present(V.part_stats(V.block_sizes(picked, bl.blocks())))


# ------------------------------------------------------------------ complexity


def q_fisher_ratio(spark, sf):
    train = band_train(spark, sf)
    return present(C.fisher_ratio(C.class_feature_stats(train, A.typed_attributes(train))))


def q_f1_complexity(spark, sf):
    r = C.fisher_ratio(C.class_feature_stats(band_train(spark, sf), band_attrs(spark, sf)))
    return present(r.agg(C.f1_from_max(F.max("ratio")).alias("f1")))


def q_f2_overlap(spark, sf):
    train = band_train(spark, sf)
    return present(C.f2_overlap(C.class_feature_stats(train, A.typed_attributes(train))))


def q_f2_complexity(spark, sf):
    train = band_train(spark, sf)
    f2 = C.f2_overlap(C.class_feature_stats(train, A.typed_attributes(train)))
    return present(f2.agg(F.sum("f2").alias("f2")))


# ------------------------------------------------------------------ threshold


def _sweep_inputs(spark, sf):
    totals, bl = band_totals(spark, sf)
    fm = materialize(band_measures(spark, sf, bl.train))
    rng = TH.vote_range(V.vote_stats(totals), False, PARTS, ROUNDS)
    cands = materialize(TH.candidate_subsets(totals, TH.thresholds(rng), fm))
    return totals, rng, cands, len(bl.attrs)


def q_vote_range(spark, sf):
    _, rng, _, _ = _sweep_inputs(spark, sf)
    return present(rng)


def q_candidate_subsets(spark, sf):
    _, _, cands, _ = _sweep_inputs(spark, sf)
    return present(cands.select("a", "n_features", "size"))


def q_threshold_sweep(spark, sf):
    _, _, cands, m = _sweep_inputs(spark, sf)
    out = None
    for meas in ("F1", "F2"):
        s = TH.score_candidates(cands, meas, m, ALPHA).withColumn("measure", F.lit(meas))
        out = s if out is None else out.unionByName(s)
    return present(out)


def q_select_threshold(spark, sf):
    _, _, cands, m = _sweep_inputs(spark, sf)
    out = None
    for meas in ("F1", "F2"):
        s = TH.select_threshold(TH.score_candidates(cands, meas, m, ALPHA)).withColumn("measure", F.lit(meas))
        out = s if out is None else out.unionByName(s)
    return present(out)


def q_selected_features(spark, sf):
    totals, _, cands, m = _sweep_inputs(spark, sf)
    a, fb = TH.choose(TH.score_candidates(cands, "F2", m, ALPHA))
    return present(TH.selected_features(totals, a, fb))


def q_run_selection(spark, sf):
    from votesel.plans.pipeline import select_features

    res = select_features(band(spark, sf), parts=PARTS, selectors=("IG",), measures=("F1", "F2"), k=TOP_K, rounds=ROUNDS, seed=SEED)
    rows = [(s, m_, f) for (s, m_), feats in res.selected.items() for f in feats]
    return spark.createDataFrame(rows, "selector string, measure string, feature string")


def q_run_selection_vertical(spark, sf):
    """The whole vertical run over the embedding columns, without and with shared features."""
    from votesel.plans.pipeline import select_features

    out = []
    for overlap in (0.0, OVERLAP):
        res = select_features(
            FX.embedding_wide(spark, sf), parts=EMB_PARTS, selectors=("IG",), measures=("F2",), k=EMB_K, rounds=ROUNDS, seed=SEED, vertical=True, overlap=overlap
        )
        out.append(res.votes["IG"].select(F.lit(overlap).alias("overlap"), "idx", "votes"))
    return present(out[0].unionByName(out[1]))


def q_run_report(spark, sf):
    """The whole run: every selector, both measures, and the classifiers on the features each pair kept."""
    from votesel.plans.pipeline import run_report_frame, select_features

    res = select_features(band(spark, sf), parts=PARTS, selectors=("CFS", "IG", "RF"), measures=("F1", "F2"), rounds=ROUNDS, seed=SEED, evaluate=True)
    return run_report_frame(spark, res)


# ------------------------------------------------------------------ prep and models


DOC_NUM = ["n_chars", "n_words", "alpha_ratio", "uniq_ratio"]


def _scaled_docs(spark, sf):
    """doc_quality numeric features min-max scaled over the whole table, as arrays."""
    d = FX.doc_quality(spark, sf)
    scaled = d.select(
        "row_id", "class",
        *[F.col(c) for c in DOC_NUM],
    )
    mm = d.select(*DOC_NUM).agg(*[F.struct(F.min(c), F.max(c)).alias(c) for c in DOC_NUM]).first()
    cols = []
    for c in DOC_NUM:
        lo, hi = mm[c][0], mm[c][1]
        cols.append(F.lit(0.5) if hi == lo else (F.col(c) - F.lit(lo)) / F.lit(hi - lo))
    return scaled.select("row_id", "class", F.array(*cols).alias("v"))


def _knn_docs(spark, sf):
    from votesel.operators.knn import knn_predict

    s = _scaled_docs(spark, sf)
    train, test = train_test_split(s)
    pred = knn_predict(
        train.select(F.col("row_id").alias("tid"), F.col("class").alias("label"), "v"),
        test.select(F.col("row_id").alias("qid"), "v"),
    )
    return pred.join(test.select(F.col("row_id").alias("qid"), F.col("class").alias("truth")), "qid")


def q_knn_1nn(spark, sf):
    return present(_knn_docs(spark, sf).select(F.col("qid").alias("row_id"), "prediction"))


def q_knn_lineitem(spark, sf):
    """1-NN over every row of the band table: nominal values as indicators, numbers min-max scaled."""
    from votesel.operators.knn import knn_predict

    b = band(spark, sf)
    nums = ["qty", "qty_disc", "price", "disc", "tax", "line"]
    lows = b.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in nums], *[F.array_sort(F.collect_set(c)).alias(c) for c in ("flag", "status")]).first()
    cols = [(F.col(c) == F.lit(value)).cast("double") for c in ("flag", "status") for value in lows[c]]
    for c in nums:
        lo, hi = lows[c]
        cols.append(F.lit(0.5) if hi == lo else (F.col(c) - F.lit(lo)) / F.lit(hi - lo))
    train, test = train_test_split(b.select("row_id", "class", F.array(*cols).alias("v")))
    found = knn_predict(train.select(F.col("row_id").alias("tid"), F.col("class").alias("label"), "v"), test.select(F.col("row_id").alias("qid"), "v"))
    return present(found.select(F.col("qid").alias("row_id"), "prediction"))


def q_accuracy(spark, sf):
    p = _knn_docs(spark, sf)
    return present(p.agg(F.avg((F.col("prediction") == F.col("truth")).cast("double")).alias("accuracy")))


def q_string_index(spark, sf):
    from pyspark.ml.feature import StringIndexer

    b = band(spark, sf)
    cols = ["flag", "status", "class"]
    model = StringIndexer(inputCols=cols, outputCols=[f"{c}_i" for c in cols]).fit(b)
    rows = [(c, v, i) for c, labels in zip(cols, model.labelsArray) for i, v in enumerate(labels)]
    return spark.createDataFrame(rows, "column string, value string, index bigint")


def q_one_hot(spark, sf):
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.functions import vector_to_array

    b = band(spark, sf).select("row_id", "flag")
    idx = StringIndexer(inputCol="flag", outputCol="flag_i").fit(b).transform(b)
    enc = OneHotEncoder(inputCols=["flag_i"], outputCols=["flag_v"]).fit(idx).transform(idx)
    arr = vector_to_array("flag_v")
    return present(enc.select("row_id", arr.getItem(0).alias("flag_0"), arr.getItem(1).alias("flag_1")))


def q_minmax_scale(spark, sf):
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = FX.doc_quality(spark, sf)
    v = VectorAssembler(inputCols=DOC_NUM, outputCol="raw").transform(d)
    sc = MinMaxScaler(inputCol="raw", outputCol="scaled").fit(v).transform(v)
    arr = vector_to_array("scaled")
    return present(sc.select("row_id", *[arr.getItem(i).alias(c) for i, c in enumerate(DOC_NUM)]))


def q_prep_pipeline(spark, sf):
    from pyspark.ml.functions import vector_to_array

    from votesel.operators.models import prep_pipeline

    d = FX.doc_quality(spark, sf)
    attrs = A.typed_attributes(d)
    model, _ = prep_pipeline(d, attrs, [a.name for a in attrs])
    t = model.transform(d).select("row_id", "label", F.posexplode(vector_to_array("features")).alias("slot", "value"))
    return present(t)


def _eval(spark, sf, models):
    from votesel.operators.models import evaluate_models

    d = FX.doc_quality(spark, sf)
    attrs = A.typed_attributes(d)
    train, test = train_test_split(d)
    rows = evaluate_models(train, test, attrs, [a.name for a in attrs], models)
    return spark.createDataFrame(rows, "model string, accuracy double")


def q_eval_svm(spark, sf):
    return _eval(spark, sf, ["SVM"])


def q_eval_dt(spark, sf):
    return _eval(spark, sf, ["DT"])


def q_eval_nb(spark, sf):
    return _eval(spark, sf, ["NB"])


def q_evaluate_models(spark, sf):
    return _eval(spark, sf, ["SVM", "DT", "NB", "KNN"])


def q_classifier_complexity(spark, sf):
    from votesel.operators.models import classifier_complexity

    totals, bl = band_totals(spark, sf)
    rng = TH.vote_range(V.vote_stats(totals), False, PARTS, ROUNDS)
    cands = TH.candidate_subsets(totals, TH.thresholds(rng))
    return classifier_complexity(bl.train, bl.attrs, totals, cands, "DT")


def q_classifier_complexity_nb(spark, sf):
    """Naive Bayes error of every candidate subset of the sweep, from one set of counts."""
    from votesel.operators.models import classifier_complexity

    totals, bl = band_totals(spark, sf)
    rng = TH.vote_range(V.vote_stats(totals), False, PARTS, ROUNDS)
    cands = TH.candidate_subsets(totals, TH.thresholds(rng))
    return present(classifier_complexity(bl.train, bl.attrs, totals, cands, "NB"))


def q_nested_bayes(spark, sf):
    """Naive Bayes predictions for every row from the first 1, 2, ... features in index order, per subset the
    rows of each (class, prediction)."""
    from votesel.operators.bayes import bayes_model, nested_predictions

    d = band(spark, sf)
    attrs = sorted(A.typed_attributes(d), key=lambda a: a.idx)
    said = nested_predictions(d, bayes_model(d, attrs), attrs, list(range(1, len(attrs) + 1)))
    rows = said.select("class", F.posexplode("predictions").alias("k", "prediction"))
    return present(rows.groupBy((F.col("k") + 1).alias("n_features"), "class", "prediction").agg(F.count("*").alias("n")))


def q_nb_predictions(spark, sf):
    """Naive Bayes prediction of every test row; scaling and indicators from train and test together."""
    from votesel.operators.bayes import bayes_predict

    d = FX.doc_quality(spark, sf)
    train, test = train_test_split(d)
    return present(bayes_predict(train, test, A.typed_attributes(d), fit_df=d).select("row_id", F.col("class").alias("truth"), "prediction"))


# ------------------------------------------------------------------ ReliefF

DOC_PARTS = 2
RELIEF_K = 10


def q_relieff_weights(spark, sf):
    from votesel.operators.relief import relieff_weights

    d = FX.doc_quality(spark, sf)
    train, _ = train_test_split(d)
    train = materialize(train)
    attrs = A.typed_attributes(train)
    bl = Blocks(train, attrs, assign=materialize(horizontal_assignment(train, DOC_PARTS, ROUNDS, SEED)))
    return present(relieff_weights(bl, class_list(train), RELIEF_K))


def q_relieff_lineitem(spark, sf):
    """ReliefF weights over all line items, whose rows share few distinct vectors."""
    from votesel.operators.relief import relieff_weights

    d = materialize(FX.lineitem_nominal(spark, sf))
    bl = Blocks(d, A.typed_attributes(d), assign=materialize(horizontal_assignment(d, 1, 1, SEED)))
    return present(relieff_weights(bl, None, RELIEF_K).select("idx", "weight"))


QUERIES = {name[2:]: fn for name, fn in dict(globals()).items() if name.startswith("q_") and callable(fn)}
