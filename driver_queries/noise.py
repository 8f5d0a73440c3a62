"""Label-noise jobs and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.functions.losses import dmi_loss, loss, mean_loss
from argentum.functions.probability import argmax, at, softmax, to_prediction
from argentum.plans.noise import (
    bucket_samples,
    changed_texts,
    correct_labels,
    curve_variance,
    flip_labels,
    keep_low_loss,
    label_histogram,
    label_mix,
    loss_curves,
    mean_loss_by_epoch,
    mean_loss_by_sample,
    mean_probability,
    moving_loss,
    pooled_curve,
    ratio_threshold,
    rolling_probability,
    switched_share,
)
from argentum.session import stage
from driver_queries.inputs import LOGITS, LOSSES, PROBS
from driver_queries.registry import query, with_

MOVING = """matrix AS (
  SELECT s.sample_id, e.epoch, coalesce(loss, 0) AS loss FROM (SELECT DISTINCT sample_id FROM losses) s
  CROSS JOIN (SELECT DISTINCT epoch FROM losses) e LEFT JOIN losses USING (sample_id, epoch)),
moving AS (SELECT sample_id, sum(loss - epoch_mean) AS moving_loss FROM (
  SELECT *, avg(loss) OVER (PARTITION BY epoch) AS epoch_mean FROM matrix) GROUP BY sample_id)"""


@query("moving_loss", with_(LOSSES, MOVING, "SELECT sample_id, round(moving_loss, 6) AS moving_loss FROM moving"))
def moving_loss_query(t):
    return moving_loss(t.losses).withColumn("moving_loss", F.round("moving_loss", 6))


@query(
    "keep_low_loss",
    with_(
        LOSSES,
        MOVING,
        """SELECT sample_id FROM moving ORDER BY moving_loss, sample_id
LIMIT (SELECT CAST(floor(0.7 * count(*)) AS BIGINT) FROM moving)""",
    ),
)
def keep_low_loss_query(t):
    return keep_low_loss(moving_loss(t.losses), 0.3)


@query("epoch_mean_loss", with_(LOSSES, MOVING, "SELECT epoch, round(avg(loss), 6) AS mean_loss FROM matrix GROUP BY epoch"))
def epoch_mean_loss(t):
    n_samples = t["events"].agg(F.count_distinct("user_id")).first()[0]
    return mean_loss_by_epoch(t.losses, n_samples).withColumn("mean_loss", F.round("mean_loss", 6))


PROFILE = """means AS (SELECT sample_id, avg(loss) AS mean_loss FROM matrix GROUP BY sample_id),
bounds AS (SELECT quantile_cont(mean_loss, [{shares}]) AS b FROM means),
bucketed AS (SELECT sample_id, mean_loss, CAST(len(list_filter(b, lambda x: x <= mean_loss)) AS INTEGER) - 1 AS bucket FROM means, bounds
  WHERE mean_loss < b[{last}]),
curves AS (SELECT bucket, epoch, avg(loss) AS mean_loss FROM matrix JOIN bucketed USING (sample_id)
  WHERE epoch IN (SELECT DISTINCT epoch FROM losses ORDER BY epoch LIMIT 20) GROUP BY ALL)"""


def profile(step: int) -> str:
    shares = [i / 100 for i in range(0, 101, step)]
    return PROFILE.format(shares=", ".join(map(str, shares)), last=len(shares)).replace("means, bounds\n", "means, bounds\n").replace(
        "SELECT sample_id, mean_loss, CAST", "SELECT sample_id, means.mean_loss, CAST"
    )


def profiled(t, step: int):
    n_epochs = t["events"].agg(F.count_distinct(F.dayofmonth("ts"))).first()[0]
    return bucket_samples(mean_loss_by_sample(t.losses, n_epochs), step)[0]


@query(
    "loss_profile_curves",
    with_(LOSSES, MOVING, profile(10), "SELECT bucket, epoch, round(mean_loss, 6) AS mean_loss FROM curves"),
)
def loss_profile_curves(t):
    return loss_curves(t.losses, profiled(t, 10)).withColumn("mean_loss", F.round("mean_loss", 6))


@query(
    "loss_profile_pooled",
    with_(
        LOSSES,
        MOVING,
        profile(2),
        "SELECT epoch, round(avg(mean_loss), 6) AS mean_loss FROM curves WHERE bucket < 40 GROUP BY epoch",
    ),
)
def loss_profile_pooled(t):
    curves = loss_curves(t.losses, profiled(t, 2))
    return pooled_curve(curves, 40).withColumn("mean_loss", F.round("mean_loss", 6))


@query(
    "loss_profile_variance",
    with_(LOSSES, MOVING, profile(10), "SELECT bucket, round(var_pop(mean_loss), 6) AS variance FROM curves GROUP BY bucket"),
)
def loss_profile_variance(t):
    return curve_variance(loss_curves(t.losses, profiled(t, 10))).withColumn("variance", F.round("variance", 6))


@query(
    "loss_profile_label_mix",
    with_(
        LOSSES,
        MOVING,
        profile(10),
        """SELECT bucket, count(*) FILTER (sample_id % 3 = 0) AS n_label_0, count(*) FILTER (sample_id % 3 = 1) AS n_label_1,
  count(*) FILTER (sample_id % 3 = 2) AS n_label_2 FROM bucketed GROUP BY bucket""",
    ),
)
def loss_profile_label_mix(t):
    return label_mix(profiled(t, 10), t.sample_labels, [0, 1, 2])


ROLLED = """slots AS (SELECT *, last_value(CASE WHEN epoch % 2 = 0 THEN p0 END IGNORE NULLS) OVER w AS a0,
  last_value(CASE WHEN epoch % 2 = 0 THEN p1 END IGNORE NULLS) OVER w AS a1, last_value(CASE WHEN epoch % 2 = 0 THEN p2 END IGNORE NULLS) OVER w AS a2,
  last_value(CASE WHEN epoch % 2 = 1 THEN p0 END IGNORE NULLS) OVER w AS b0, last_value(CASE WHEN epoch % 2 = 1 THEN p1 END IGNORE NULLS) OVER w AS b1,
  last_value(CASE WHEN epoch % 2 = 1 THEN p2 END IGNORE NULLS) OVER w AS b2 FROM probs
  WINDOW w AS (PARTITION BY sample_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rolled AS (SELECT sample_id, epoch, CAST(sample_id % 3 AS INTEGER) AS label, (coalesce(a0, 0) + coalesce(b0, 0)) / 2 AS q0,
  (coalesce(a1, 0) + coalesce(b1, 0)) / 2 AS q1, (coalesce(a2, 0) + coalesce(b2, 0)) / 2 AS q2 FROM slots)"""
FLIPPED = """picked AS (SELECT *, greatest(q0, q1, q2) AS top, CAST(CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS INTEGER) AS best,
  CASE label WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END AS own FROM rolled),
flipped AS (SELECT *, CASE WHEN best <> label AND top > (1.3 + 0.1 * greatest(epoch - 5, 0)) * own THEN best ELSE label END AS new_label FROM picked)"""


@query(
    "rolling_probability",
    with_(PROBS, ROLLED, "SELECT sample_id, epoch, round(q0, 9) AS q0, round(q1, 9) AS q1, round(q2, 9) AS q2 FROM rolled"),
)
def rolling_probability_query(t):
    rolled = rolling_probability(t.probs, 2, 3)
    return rolled.select(
        "sample_id", "epoch", *[F.round(at(F.col("probs_bar"), F.lit(k)), 9).alias(f"q{k}") for k in range(3)]
    )


def flipped_rows(t):
    rolled = rolling_probability(t.probs, 2, 3).withColumn("label", (F.col("sample_id") % 3).cast("int"))
    return flip_labels(rolled, ratio_threshold(F.col("epoch"), 1.3, 0.1, 5), 3)


@query(
    "lrt_flip",
    with_(
        PROBS,
        ROLLED,
        FLIPPED,
        """SELECT sample_id, epoch, label, new_label, label <> new_label AS changed,
  CASE WHEN new_label = 0 THEN 0.99 ELSE 0.005 END::DOUBLE AS s0, CASE WHEN new_label = 2 THEN 0.99 ELSE 0.005 END::DOUBLE AS s2 FROM flipped""",
    ),
)
def lrt_flip(t):
    soft = lambda k: F.round(at(F.col("soft_label"), F.lit(k)), 6)
    return flipped_rows(t).select(
        "sample_id", "epoch", "label", "new_label", "changed", soft(0).alias("s0"), soft(2).alias("s2")
    )


@query(
    "lrt_corrected_labels",
    "WITH RECURSIVE "
    + ",\n".join(
        [
            PROBS,
            ROLLED,
            """steps AS (SELECT sample_id, epoch, label, q0, q1, q2, greatest(q0, q1, q2) AS top,
  CAST(CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS INTEGER) AS best,
  row_number() OVER (PARTITION BY sample_id ORDER BY epoch) AS i FROM rolled WHERE epoch >= 5),
walk AS (
  SELECT DISTINCT sample_id, 0::BIGINT AS i, label AS y FROM rolled
  UNION ALL
  SELECT w.sample_id, s.i, CASE WHEN s.best <> w.y AND s.top > (1.3 + 0.1 * (s.epoch - 5)) *
    (CASE w.y WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END) THEN s.best ELSE w.y END
  FROM walk w JOIN steps s ON s.sample_id = w.sample_id AND s.i = w.i + 1)""",
        ]
    )
    + """
SELECT sample_id, CAST(sample_id % 3 AS INTEGER) AS label, CAST(arg_max(y, i) AS INTEGER) AS new_label FROM walk GROUP BY sample_id""",
)
def lrt_corrected_labels(t):
    return correct_labels(rolling_probability(t.probs, 2, 3), t.sample_labels, 1.3, 0.1, 5)


@query("label_histogram", with_(PROBS, ROLLED, FLIPPED, "SELECT epoch, new_label, count(*) AS n FROM flipped GROUP BY ALL"))
def label_histogram_query(t):
    return label_histogram(flipped_rows(t), "new_label")


@query(
    "label_switch_share",
    with_(
        PROBS,
        ROLLED,
        FLIPPED,
        "SELECT round(avg(CASE WHEN label <> new_label THEN 1 ELSE 0 END) * 100, 2) AS percent_switched FROM flipped",
    ),
)
def label_switch_share(t):
    # a label of every epoch is a row of its own
    rows = stage(flipped_rows(t).select(F.struct("sample_id", "epoch").alias("sample_id"), "label", "new_label"), "flipped")
    return switched_share(rows.select("sample_id", "label"), rows.select("sample_id", F.col("new_label").alias("label")))


@query(
    "label_changes_with_text",
    with_(
        PROBS,
        ROLLED,
        FLIPPED,
        """SELECT sample_id, label AS old_label, new_label, text FROM flipped JOIN documents ON doc_id = sample_id
WHERE label <> new_label""",
    ),
)
def label_changes_with_text(t):
    texts = t["documents"].select(F.col("doc_id").alias("sample_id"), "text")
    return changed_texts(flipped_rows(t), texts)


@query(
    "mean_probability",
    with_(
        PROBS,
        """SELECT epoch, class, round(avg(p), 9) AS mean_p FROM (
  SELECT epoch, unnest([0, 1, 2]) AS class, unnest([p0, p1, p2]) AS p FROM probs) GROUP BY ALL""",
    ),
)
def mean_probability_query(t):
    return mean_probability(t.probs).withColumn("mean_p", F.round("mean_p", 9))


SOFT = LOGITS + """,
soft AS (SELECT *, ln(exp(z0) + exp(z1) + exp(z2)) AS lse FROM logits),
lp AS (SELECT vec_id, y, z0, z1, z2, z0 - lse AS l0, z1 - lse AS l1, z2 - lse AS l2,
  CASE y WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END - lse AS ly FROM soft),
p AS (SELECT *, exp(l0) AS p0, exp(l1) AS p1, exp(l2) AS p2, exp(ly) AS py,
  least(greatest(exp(l0), 1e-7), 1) AS c0, least(greatest(exp(l1), 1e-7), 1) AS c1, least(greatest(exp(l2), 1e-7), 1) AS c2,
  least(greatest(exp(ly), 1e-7), 1) AS cy FROM lp)"""


@query(
    "softmax_prediction",
    with_(
        SOFT,
        """SELECT vec_id, round(p0, 9) AS p0, round(p2, 9) AS p2, CAST(CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS INTEGER) AS prediction,
  CAST(z1 > 0 AS INTEGER) AS flag_1 FROM p""",
    ),
)
def softmax_prediction(t):
    z = F.col("logits")
    p = softmax(z)
    return t.logits.select(
        "vec_id",
        F.round(at(p, F.lit(0)), 9).alias("p0"),
        F.round(at(p, F.lit(2)), 9).alias("p2"),
        to_prediction(z, 3).alias("prediction"),
        at(to_prediction(z, 3, multilabel=True), F.lit(1)).alias("flag_1"),
    )


# each loss as SQL over p (softmax), c (clamped softmax), l (log softmax), of class 0..2 and of the label
_CE, _MAE = "(-ly)", "(1 - py)"
_RCE = "(-ln(1e-4) * (c0 + c1 + c2 - cy))"
_NCE = "(ly / (l0 + l1 + l2))"
_GCE = "((1 - pow(cy, 0.7)) / 0.7)"
_NGCE = "((1 - pow(cy, 0.7)) / (3 - pow(c0, 0.7) - pow(c1, 0.7) - pow(c2, 0.7)))"
_NFL = "(sqrt(1 - py) * ly / (sqrt(1 - p0) * l0 + sqrt(1 - p1) * l1 + sqrt(1 - p2) * l2))"
_W = "(CASE y WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 0.5 END)"
_AB = {"alpha": 0.6, "beta": 1.7}

LOSS_SQL = {
    "ce": ("CE", {}, _CE),
    "ce_weighted": ("CE", {"weight": [1.0, 2.0, 0.5]}, f"{_CE} * {_W}"),
    "sce": ("SCE", _AB, f"0.6 * {_CE} + 1.7 * {_RCE}"),
    "rce": ("RCE", {"scale": 2.0}, f"2 * {_RCE}"),
    "nrce": ("NRCE", {}, f"{_RCE} * 0.5"),
    "nce": ("NCE", {}, _NCE),
    "nce_weighted": ("NCE", {"weight": [1.0, 2.0, 0.5]}, f"ly * {_W} / (l0 + 2 * l1 + 0.5 * l2)"),
    "gce": ("GCE", {}, _GCE),
    "ngce": ("NGCE", {}, _NGCE),
    "mae": ("MAE", {}, _MAE),
    "nmae": ("NMAE", {}, f"{_MAE} / 4"),
    "focal": ("Focal", {"gamma": 2.0, "focal_alpha": [0.2, 0.3, 0.5]}, "-pow(1 - py, 2) * ly * (CASE y WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 ELSE 0.5 END)"),
    "nfl": ("NFL", {"gamma": 0.5}, _NFL),
    "nce_rce": ("NCEandRCE", _AB, f"0.6 * {_NCE} + 1.7 * {_RCE}"),
    "nce_mae": ("NCEandMAE", _AB, f"0.6 * {_NCE} + 1.7 * {_MAE}"),
    "gce_mae": ("GCEandMAE", _AB, f"{_GCE} + 1.7 * {_MAE}"),
    "gce_rce": ("GCEandRCE", _AB, f"{_GCE} + 1.7 * {_RCE}"),
    "gce_nce": ("GCEandNCE", _AB, f"{_GCE} + {_NCE}"),
    "ngce_nce": ("NGCEandNCE", _AB, f"0.6 * {_NGCE} + 1.7 * {_NCE}"),
    "ngce_mae": ("NGCEandMAE", _AB, f"0.6 * {_NGCE} + 1.7 * {_MAE}"),
    "ngce_rce": ("NGCEandRCE", _AB, f"0.6 * {_NGCE} + 1.7 * {_RCE}"),
    "mae_rce": ("MAEandRCE", _AB, f"0.6 * {_MAE} + 1.7 * {_RCE}"),
    "nfl_nce": ("NFLandNCE", _AB, f"0.6 * {_NFL} + 1.7 * {_NCE}"),
    "nfl_mae": ("NFLandMAE", _AB, f"0.6 * {_NFL} + 1.7 * {_MAE}"),
    "nfl_rce": ("NFLandRCE", _AB, f"0.6 * {_NFL} + 1.7 * {_RCE}"),
}


def _register_loss(key: str, name: str, options: dict, sql: str) -> None:
    @query(f"loss_{key}", with_(SOFT, f"SELECT vec_id, round({sql}, 7) AS loss FROM p"))
    def build(t):
        value = loss(name, F.col("logits"), F.col("label"), 3, **options)
        return t.logits.select("vec_id", F.round(value, 7).alias("loss"))


for _key, (_name, _options, _sql) in LOSS_SQL.items():
    _register_loss(_key, _name, _options, _sql)


@query("loss_mean_weighted", with_(SOFT, f"SELECT round(sum({_CE} * {_W}) / sum({_W}), 7) AS mean_loss FROM p"))
def loss_mean_weighted(t):
    weight = [1.0, 2.0, 0.5]
    value = loss("CE", F.col("logits"), F.col("label"), 3, weight=weight)
    return mean_loss(t.logits.withColumn("loss", value), weight=weight).withColumn("mean_loss", F.round("mean_loss", 7))


_CELL = "sum(CASE WHEN y = {i} THEN p{j} ELSE 0 END) AS m{i}{j}"


@query(
    "loss_dmi",
    with_(
        SOFT,
        "m AS (SELECT " + ", ".join(_CELL.format(i=i, j=j) for i in range(3) for j in range(3)) + " FROM p)",
        """SELECT round(-ln(abs(m00 * (m11 * m22 - m12 * m21) - m01 * (m10 * m22 - m12 * m20) + m02 * (m10 * m21 - m11 * m20)) + 0.001), 7)
  AS loss FROM m""",
    ),
)
def loss_dmi(t):
    return dmi_loss(t.logits, "logits", "label", 3).withColumn("loss", F.round("loss", 7))


@query(
    "loss_by_predicted_class",
    with_(
        SOFT,
        f"""SELECT CAST(CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS INTEGER) AS prediction,
  count(*) AS n, round(avg({_CE}), 7) AS mean_loss FROM p GROUP BY 1""",
    ),
)
def loss_by_predicted_class(t):
    value = loss("CE", F.col("logits"), F.col("label"), 3)
    rows = t.logits.select(argmax(F.col("logits")).alias("prediction"), value.alias("loss"))
    return rows.groupBy("prediction").agg(F.count("*").alias("n"), F.round(F.avg("loss"), 7).alias("mean_loss"))
