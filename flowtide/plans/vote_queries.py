"""Named queries over classifier votes, scores and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtide.functions import vectors
from flowtide.operators import metrics, neighbors, retrieval, sampling, voting
from flowtide.plans.registry import query
from flowtide.session import table
from flowtide.sources import adapters

VOTERS = voting.VOTERS

# Majority in SQL: most votes, then the earliest voter.
_MAJORITY = """SELECT row_id, arg_min(cls, -n * 10 + first_seen) AS majority, max(n) AS top_votes,
    sum(CASE WHEN n = top THEN 1 ELSE 0 END) > 1 AS low_agreement
  FROM (SELECT row_id, cls, n, first_seen, max(n) OVER (PARTITION BY row_id) AS top FROM
    (SELECT row_id, cls, count(*) AS n, min(pos) AS first_seen FROM
      (SELECT row_id, rfc AS cls, 1 AS pos FROM votes UNION ALL SELECT row_id, xgb, 2 FROM votes
       UNION ALL SELECT row_id, mlp, 3 FROM votes UNION ALL SELECT row_id, knn, 4 FROM votes) GROUP BY row_id, cls))
  GROUP BY row_id"""


@query(
    "hard_vote",
    f"""SELECT row_id, majority, CAST(top_votes AS INT) AS top_votes, low_agreement,
        CAST(top_votes AS DOUBLE) / 4 * 100 AS agreement_ratio FROM ({_MAJORITY})""",
    "votes",
)
def hard_vote(spark, folder):
    return voting.hard_vote(adapters.votes(spark, folder)).select(
        "row_id", "majority", "top_votes", "low_agreement", "agreement_ratio"
    )


@query("low_agreement", f"SELECT row_id, majority FROM ({_MAJORITY}) WHERE low_agreement", "votes")
def low_agreement(spark, folder):
    return voting.low_agreement_only(voting.hard_vote(adapters.votes(spark, folder))).select("row_id", "majority")


@query(
    "soft_vote",
    """SELECT row_id, CAST(arg_min(class_id, -p * 1000 + class_id * 0.0001) AS INT) AS best_class, round(max(p), 6) AS best_p
       FROM (SELECT row_id, class_id, (score + (1 - score) + score * score + 0.25) / 4 AS p FROM scores) GROUP BY row_id""",
    "scores",
)
def soft_vote(spark, folder):
    """Mean of four classifiers' probability arrays, then the best class."""
    # Sorting by class restores array order after the shuffle; a row has one entry per class.
    per_row = (
        adapters.scores(spark, folder)
        .groupBy("row_id")
        .agg(F.array_sort(F.collect_list(F.struct("class_id", "score"))).alias("s"))
        .select("row_id", F.transform("s", lambda x: x["score"]).alias("p1"))
    )
    voters = per_row.withColumns(
        {
            "p2": F.transform("p1", lambda x: 1 - x),
            "p3": F.transform("p1", lambda x: x * x),
            "p4": F.transform("p1", lambda x: F.lit(0.25)),
        }
    )
    voted = voting.soft_vote(voters, ["p1", "p2", "p3", "p4"], "p")
    return voted.select(
        "row_id", vectors.argmax(F.col("p")).alias("best_class"), F.round(F.array_max("p"), 6).alias("best_p")
    )


@query(
    "soft_vote_long",
    "SELECT truth, class_id, round(avg(score), 6) AS mean_probability FROM scores GROUP BY truth, class_id",
    "scores",
)
def soft_vote_long(spark, folder):
    out = voting.soft_vote_long(adapters.scores(spark, folder), ["truth", "class_id"], "score")
    return out.withColumn("mean_probability", F.round("mean_probability", 6))


@query(
    "confusion_matrix",
    """SELECT t.c AS truth, p.c AS prediction, CAST(count(v.row_id) AS BIGINT) AS n
       FROM (SELECT DISTINCT truth AS c FROM votes) t CROSS JOIN (SELECT DISTINCT knn AS c FROM votes) p
       LEFT JOIN votes v ON v.truth = t.c AND v.knn = p.c GROUP BY t.c, p.c""",
    "votes",
)
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(adapters.votes(spark, folder), "truth", "knn")


@query(
    "binary_metrics",
    """WITH s AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp,
        count(*) FILTER (quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (quality = toxic) AS hits, count(*) AS n FROM labels)
       SELECT round(hits / n, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision",
        round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM s""",
)
def binary_metrics(spark, folder):
    out = metrics.binary_metrics(table(spark, folder, "labels"), "quality", "toxic")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    "weighted_metrics",
    f"""WITH long AS (SELECT row_id, truth, 'rfc' AS classifier, rfc AS prediction FROM votes UNION ALL
          SELECT row_id, truth, 'xgb', xgb FROM votes UNION ALL SELECT row_id, truth, 'mlp', mlp FROM votes UNION ALL
          SELECT row_id, truth, 'knn', knn FROM votes UNION ALL
          SELECT v.row_id, v.truth, 'majority', m.majority FROM votes v JOIN ({_MAJORITY}) m ON v.row_id = m.row_id),
        c AS (SELECT classifier, k.cls, count(*) FILTER (truth = k.cls) AS support, count(*) FILTER (prediction = k.cls) AS predicted,
          count(*) FILTER (truth = k.cls AND prediction = k.cls) AS hits
          FROM long, (SELECT DISTINCT truth AS cls FROM votes) k GROUP BY classifier, k.cls)
        SELECT classifier, round(sum(hits) / sum(support), 6) AS accuracy,
          round(sum(coalesce(hits / nullif(predicted, 0), 0) * support) / sum(support), 6) AS "precision",
          round(sum(coalesce(hits / nullif(support, 0), 0) * support) / sum(support), 6) AS recall,
          round(sum(coalesce(2 * hits / nullif(support + predicted, 0), 0) * support) / sum(support), 6) AS f1
        FROM c GROUP BY classifier""",
    "votes",
)
def weighted_metrics(spark, folder):
    voted = voting.hard_vote(adapters.votes(spark, folder))
    long = metrics.voters_long(voted, [*VOTERS, "majority"], ["row_id", "truth"])
    out = metrics.weighted_metrics(long, ["classifier"], "truth", "prediction")
    return out.select("classifier", *[F.round(c, 6).alias(c) for c in out.columns if c != "classifier"])


_FOLDED = """SELECT truth, knn, (row_number() OVER (PARTITION BY truth ORDER BY md5(concat('42:', CAST(row_id AS VARCHAR))), row_id) - 1) % 5 AS fold FROM votes"""


@query(
    "cv_scores",
    f"""WITH f AS ({_FOLDED}), c AS (SELECT fold, k.cls, count(*) FILTER (truth = k.cls) AS support,
          count(*) FILTER (knn = k.cls) AS predicted, count(*) FILTER (truth = k.cls AND knn = k.cls) AS hits
          FROM f, (SELECT DISTINCT truth AS cls FROM votes) k GROUP BY fold, k.cls)
        SELECT CAST(fold AS INT) AS fold, round(avg(hits / nullif(support, 0)), 6) AS balanced_accuracy,
          round(sum(coalesce(2 * hits / nullif(support + predicted, 0), 0) * support) / sum(support), 6) AS weighted_f1
        FROM c GROUP BY fold""",
    "votes",
)
def cv_scores(spark, folder):
    folded = sampling.stratified_folds(adapters.votes(spark, folder), "truth", "row_id", 5)
    out = metrics.cv_scores(folded, "fold", "truth", "knn")
    return out.select("fold", *[F.round(c, 6).alias(c) for c in ("balanced_accuracy", "weighted_f1")])


@query(
    "pr_curve",
    """WITH p AS (SELECT class_id, score, sum(CASE WHEN truth = class_id THEN 1 ELSE 0 END) AS t, count(*) AS n FROM scores GROUP BY class_id, score),
       c AS (SELECT class_id, score, sum(t) OVER w AS tp, sum(n) OVER w AS m, sum(t) OVER (PARTITION BY class_id) AS pos FROM p
             WINDOW w AS (PARTITION BY class_id ORDER BY score DESC))
       SELECT class_id, round(score, 6) AS threshold, round(tp / m, 6) AS "precision", round(CASE WHEN pos > 0 THEN tp / pos ELSE 1 END, 6) AS recall FROM c
       UNION ALL SELECT DISTINCT class_id, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM scores""",
    "scores",
)
def pr_curve(spark, folder):
    scored = adapters.scores(spark, folder).withColumn("positive", (F.col("truth") == F.col("class_id")).cast("int"))
    out = metrics.pr_curve(scored, "class_id", "score", "positive")
    return out.select("class_id", *[F.round(c, 6).alias(c) for c in ("threshold", "precision", "recall")])


@query(
    "class_weights",
    "SELECT truth AS label, CAST(count(*) AS BIGINT) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM votes GROUP BY truth",
    "votes",
)
def class_weights(spark, folder):
    return metrics.class_weights(adapters.votes(spark, folder), "truth").withColumn("weight", F.round("weight", 6))


@query(
    "best_params",
    """WITH s AS (SELECT 'rfc' AS classifier, avg(CAST(rfc = truth AS INT)) AS score FROM votes UNION ALL
         SELECT 'xgb', avg(CAST(xgb = truth AS INT)) FROM votes UNION ALL SELECT 'mlp', avg(CAST(mlp = truth AS INT)) FROM votes
         UNION ALL SELECT 'knn', avg(CAST(knn = truth AS INT)) FROM votes)
       SELECT classifier, round(score, 6) AS score FROM s ORDER BY score DESC, classifier LIMIT 1""",
    "votes",
)
def best_params(spark, folder):
    long = metrics.voters_long(adapters.votes(spark, folder), VOTERS, ["row_id", "truth"])
    results = long.groupBy("classifier").agg(
        F.avg((F.col("prediction") == F.col("truth")).cast("int")).alias("score")
    )
    return metrics.best_params(results, "score", ["classifier"]).withColumn("score", F.round("score", 6))


@query(
    "label_align",
    "SELECT v.row_id, v.knn AS prediction, e.label FROM votes v JOIN embeddings e ON v.row_id = e.vec_id WHERE v.knn <> 0",
    "votes",
)
def label_align(spark, folder):
    """Labels of the rows that a filter kept, matched by row id."""
    kept = adapters.votes(spark, folder).where(F.col("knn") != 0).select("row_id", F.col("knn").alias("prediction"))
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    return kept.join(labels, "row_id")


@query(
    "memory_candidates",
    """SELECT row_id, truth FROM votes WHERE knn = truth""",
    "votes",
)
def memory_candidates(spark, folder):
    votes = adapters.votes(spark, folder)
    return retrieval.memory_candidates(votes.select("row_id", F.col("knn").alias("prediction")), votes.select("row_id", "truth"), "row_id", "truth")


@query(
    "mitigation_memory",
    """WITH t AS (SELECT flow_id, label FROM flows WHERE label <> 'Benign')
       SELECT flow_id, label, CASE WHEN flow_id % 3 = 0 THEN 'blocked at source' ELSE '-' END AS mitigation, flow_id % 3 = 0 AS remember FROM t""",
    "flows",
)
def mitigation_memory(spark, folder):
    """Threats with the mitigation recorded for the same sample."""
    threats = adapters.flows(spark, folder).where(F.col("label") != "Benign").select("flow_id", "label")
    worked = threats.where(F.col("flow_id") % 3 == 0).select("flow_id", F.lit("blocked at source").alias("mitigation"))
    out = retrieval.mitigation_memory(threats, worked, "flow_id")
    return out.withColumn("mitigation", F.coalesce("mitigation", F.lit("-")))


@query(
    "label_except",
    """SELECT row_id, (SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FROM (SELECT DISTINCT truth AS c FROM votes) k
          WHERE NOT ((c = v.xgb AND v.xgb <> v.truth) OR (c = v.mlp AND v.mlp <> v.truth) OR (c = v.knn AND v.knn <> v.truth))) AS remaining
       FROM votes v""",
    "votes",
)
def label_except(spark, folder):
    """Labels still open for a row once its wrong answers are excluded."""
    from flowtide.operators.encoding import distinct_sorted

    votes = adapters.votes(spark, folder)
    known = F.array(*[F.lit(c) for c in distinct_sorted(votes, "truth")])
    wrong = F.filter(F.array("xgb", "mlp", "knn"), lambda v: v != F.col("truth"))
    left = F.array_except(known, wrong)
    return votes.select("row_id", F.array_join(F.transform(left, lambda v: v.cast("string")), ",").alias("remaining"))


@query(
    "eval_rows",
    f"""SELECT v.row_id AS sample_index, v.truth AS true_label, m.majority AS majority_prediction,
          CAST(m.top_votes AS DOUBLE) / 4 * 100 AS agreement_ratio, v.rfc AS rfc_prediction, v.xgb AS xgb_prediction,
          v.mlp AS mlp_prediction, v.knn AS knn_prediction, round(s.relevance, 6) AS relevance, round(s.faithfulness, 6) AS faithfulness
        FROM votes v JOIN ({_MAJORITY}) m ON v.row_id = m.row_id
        LEFT JOIN (SELECT row_id, max(score) AS relevance, min(score) AS faithfulness FROM scores GROUP BY row_id) s ON s.row_id = v.row_id""",
    "votes scores",
)
def eval_rows(spark, folder):
    scored = adapters.scores(spark, folder).groupBy("row_id").agg(
        F.max("score").alias("relevance"), F.min("score").alias("faithfulness")
    )
    return retrieval.evaluation_rows(adapters.votes(spark, folder), scored, "row_id").select(
        "sample_index", "true_label", "majority_prediction", "agreement_ratio", *[f"{v}_prediction" for v in VOTERS],
        F.round("relevance", 6).alias("relevance"), F.round("faithfulness", 6).alias("faithfulness"),
    )


@query(
    "eval_summary",
    """SELECT round(avg(CASE WHEN row_id % 3 = 0 THEN NULL ELSE score END), 6) AS relevance, round(avg(score * score), 6) AS faithfulness FROM scores""",
    "scores",
)
def eval_summary(spark, folder):
    rows = adapters.scores(spark, folder).select(
        F.when(F.col("row_id") % 3 != 0, F.col("score")).alias("relevance"), (F.col("score") * F.col("score")).alias("faithfulness")
    )
    return retrieval.evaluation_summary(rows, 6)


@query(
    "feature_scores",
    """WITH t AS (SELECT *, CASE WHEN label = 'Benign' THEN 0 ELSE 1 END AS target FROM flows)
       SELECT 'flow_duration' AS feature, round(abs(corr(flow_duration, target)), 6) AS score FROM t
       UNION ALL SELECT 'dst_port', round(abs(corr(dst_port, target)), 6) FROM t
       UNION ALL SELECT 'protocol', round(abs(corr(protocol, target)), 6) FROM t
       UNION ALL SELECT 'src_port', round(abs(corr(src_port, target)), 6) FROM t""",
    "flows",
)
def feature_scores(spark, folder):
    flows = adapters.flows(spark, folder).withColumn("target", F.when(F.col("label") == "Benign", 0).otherwise(1))
    out = retrieval.feature_scores(flows, ["flow_duration", "dst_port", "protocol", "src_port"], "target")
    return out.withColumn("score", F.round("score", 6))


# -- vectors -----------------------------------------------------------------------------

_VECTORS = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"


@query(
    "vector_math",
    """SELECT vec_id, round(list_cosine_similarity(v, list_reverse(v)), 6) AS similarity,
         CAST(list_position(v, list_max(v)) - 1 AS INT) AS best,
         round(exp(list_max(v)) / list_sum(list_transform(v, lambda x: exp(x))), 6) AS best_share
       FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""",
)
def vector_math(spark, folder):
    v = F.col("embedding")
    return table(spark, folder, "embeddings").select(
        "vec_id",
        F.round(vectors.cosine(v, F.reverse(v)), 6).alias("similarity"),
        vectors.argmax(v).alias("best"),
        F.round(F.array_max(vectors.softmax(v)), 6).alias("best_share"),
    )


@query(
    "l2_normalize",
    """SELECT vec_id, round(sum(x / n), 6) AS total, round(sum((x / n) * (x / n)), 6) AS square, round(max(x / n), 6) AS top
       FROM (SELECT vec_id, unnest(v) AS x, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n
             FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)) GROUP BY vec_id""",
)
def l2_normalize(spark, folder):
    unit = table(spark, folder, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x)
    square = F.aggregate("u", F.lit(0.0), lambda acc, x: acc + x * x)
    return unit.select(
        "vec_id", F.round(total, 6).alias("total"), F.round(square, 6).alias("square"), F.round(F.array_max("u"), 6).alias("top")
    )


def _knn_sql(distance: str) -> str:
    return f"""SELECT query_id, reference_id, CAST(rn AS INT) AS rank, round(d, 6) AS distance FROM
      (SELECT query_id, reference_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, reference_id) AS rn FROM
        (SELECT a.vec_id AS query_id, b.vec_id AS reference_id, {distance} AS d
         FROM ({_VECTORS}) a JOIN ({_VECTORS}) b ON a.vec_id <> b.vec_id)) WHERE rn <= 5"""


def _self_neighbours(spark, folder, k, metric):
    rows = table(spark, folder, "embeddings")
    return neighbors.nearest(
        rows.withColumnRenamed("vec_id", "query_id"),
        rows.withColumnRenamed("vec_id", "reference_id"),
        k,
        metric,
        exclude_same_id=True,
    )


@query("knn_join", _knn_sql("list_distance(a.v, b.v)"))
def knn_join(spark, folder):
    return _self_neighbours(spark, folder, 5, "euclidean").withColumn("distance", F.round("distance", 6))


@query("knn_join_manhattan", _knn_sql("list_sum(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))"))
def knn_join_manhattan(spark, folder):
    return _self_neighbours(spark, folder, 5, "manhattan").withColumn("distance", F.round("distance", 6))


@query("knn_join_chebyshev", _knn_sql("list_max(list_transform(list_zip(a.v, b.v), lambda p: abs(p[1] - p[2])))"))
def knn_join_chebyshev(spark, folder):
    return _self_neighbours(spark, folder, 5, "chebyshev").withColumn("distance", F.round("distance", 6))


@query(
    "cosine_topk",
    f"""SELECT query_id, reference_id, CAST(rn AS INT) AS rank, round(s, 6) AS similarity FROM
      (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, reference_id) AS rn FROM
        (SELECT a.vec_id AS query_id, b.vec_id AS reference_id, list_cosine_similarity(a.v, b.v) AS s
         FROM ({_VECTORS}) a JOIN ({_VECTORS}) b ON a.vec_id <> b.vec_id)) WHERE rn <= 5""",
)
def cosine_topk(spark, folder):
    out = _self_neighbours(spark, folder, 5, "cosine")
    return out.select("query_id", "reference_id", "rank", F.round("similarity", 6).alias("similarity"))


_SPLIT = "substr(md5(concat('42:', CAST(vec_id AS VARCHAR))), 1, 15) < '333333333333333'"


@query(
    "knn_classify",
    f"""WITH e AS (SELECT *, {_SPLIT} AS is_test FROM ({_VECTORS})),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, reference_id) AS rn FROM
          (SELECT a.vec_id AS query_id, b.vec_id AS reference_id, b.label, list_distance(a.v, b.v) AS d
           FROM e a JOIN e b ON a.is_test AND NOT b.is_test)),
        c AS (SELECT query_id, label, count(*) AS k FROM n WHERE rn <= 3 GROUP BY query_id, label)
        SELECT query_id, arg_min(label, -k * 1000 + label) AS prediction, round(max(k) / sum(k), 6) AS share FROM c GROUP BY query_id""",
)
def knn_classify(spark, folder):
    train, test = sampling.train_test_split(table(spark, folder, "embeddings"), "vec_id")
    references = train.withColumnRenamed("vec_id", "reference_id")
    found = neighbors.nearest(test.withColumnRenamed("vec_id", "query_id"), references, 3)
    return neighbors.neighbour_vote(found, references, "label").withColumn("share", F.round("share", 6))


@query(
    "resolve_ties",
    f"""WITH m AS ({_MAJORITY}), e AS (SELECT t.vec_id, t.v, m.low_agreement, m.majority, t.label % 4 AS truth FROM ({_VECTORS}) t JOIN m ON m.row_id = t.vec_id),
        n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, reference_id) AS rn FROM
          (SELECT a.vec_id AS query_id, b.vec_id AS reference_id, b.truth, list_cosine_similarity(a.v, b.v) AS s
           FROM e a JOIN e b ON a.low_agreement AND NOT b.low_agreement AND b.majority = b.truth)),
        c AS (SELECT query_id, truth, count(*) AS k FROM n WHERE rn <= 5 GROUP BY query_id, truth)
        SELECT query_id AS row_id, arg_min(truth, -k * 1000 + truth) AS resolved FROM c GROUP BY query_id""",
    "votes",
)
def resolve_ties(spark, folder):
    voted = voting.hard_vote(adapters.votes(spark, folder))
    rows = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "row_id").drop("label").join(voted, "row_id")
    memory = rows.where(~F.col("low_agreement") & (F.col("majority") == F.col("truth")))
    return retrieval.resolve_low_agreement(rows.where("low_agreement"), memory, "row_id", "truth", k=5)
