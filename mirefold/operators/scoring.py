"""Points of many reasons as one capped, explained score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def capped(df: DataFrame, group: list[str], order: str, points: str, cap: int) -> DataFrame:
    """df with `capped_points`: where a group's points exceed the cap, each is scaled by
    cap/total with half-even rounding and the last takes what is left; a negative cap is a floor
    for groups of negative points. A group is one message's reasons of one category, hence small.
    """
    part, run = W.partitionBy(*group), W.partitionBy(*group).orderBy(order)
    total, n, k = F.sum(points).over(part), F.count("*").over(part), F.row_number().over(run)
    over = total > cap if cap >= 0 else total < cap
    each = F.bround(F.col(points) * F.lit(cap) / total, 0).cast("int")
    each = F.greatest(each, F.lit(0)) if cap >= 0 else each
    rows = df.withColumn("__over", over).withColumn("__n", n).withColumn("__k", k).withColumn("__each", F.when(F.col("__over"), each))
    before = F.coalesce(F.sum("__each").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    value = F.when(~F.col("__over"), F.col(points)).when(F.col("__k") == F.col("__n"), cap - before).otherwise(F.col("__each"))
    return rows.withColumn("capped_points", value.cast("int")).drop("__over", "__n", "__k", "__each")


def level(score: Column, malicious: int = 60, suspicious: int = 30, unknown: int = 10) -> Column:
    """The level of a score by its thresholds."""
    return F.when(score >= malicious, "malicious").when(score >= suspicious, "suspicious").when(score >= unknown, "unknown").otherwise("benign")


def verdicts(contributions: DataFrame, message: str, points: str = "capped_points", edges: tuple[int, int, int] = (10, 30, 60)) -> DataFrame:
    """(message, score, level, confidence): the sum of the points within 0..100, its level, and
    how settled it is: low near an edge (5) or where risk and mitigation nearly cancel (8), high
    far from one (12) with 20 points of risk or at either end, else medium.
    """
    p = F.col(points)
    sums = contributions.groupBy(message).agg(F.sum(p).alias("s"), F.sum(F.greatest(p, F.lit(0))).alias("risk"), F.sum(F.greatest(-p, F.lit(0))).alias("mit"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("s"))).cast("int")
    rows = sums.withColumn("score", score).withColumn("level", level(F.col("score"), edges[2], edges[1], edges[0]))
    distance = F.least(*[F.abs(F.col("score") - e) for e in edges])
    tug = (F.col("risk") > 0) & (F.col("mit") > 0) & (F.abs(F.col("risk") - F.col("mit")) <= 8)
    confidence = F.when((distance <= 5) | tug, "low").when((distance >= 12) & ((F.col("risk") >= 20) | F.col("level").isin("benign", "malicious")), "high").otherwise("medium")
    return rows.select(message, "score", "level", confidence.alias("confidence"))


# The weights that feedback of a segment concerns.
SEGMENT_WEIGHTS: dict[str, tuple[str, ...]] = {
    "bec": ("weight_bec_payment",),
    "display_spoof": ("weight_display_spoof", "weight_lookalike", "weight_spf_lookalike"),
    "shortener": ("weight_url_shortener",),
    "messenger": ("weight_messenger_only", "weight_messenger_lure"),
    "messenger_lure": ("weight_messenger_lure",),
    "qr_lure": ("weight_qr_lure", "weight_qr_credential", "weight_qr_present"),
    "html_smuggling": ("weight_html_smuggling",),
    "html_polyglot": ("weight_html_polyglot",),
    "cab": ("weight_cab_archive",),
    "remote_template": ("weight_office_remote_template",),
    "office_link": ("weight_office_hyperlink",),
    "office_dde": ("weight_office_dde",),
    "ole_package": ("weight_ole_package",),
    "script_att": ("weight_script_attachment",),
    "cloud_lure": ("weight_cloud_lure",),
    "tnef": ("weight_tnef",),
    "rar": ("weight_rar_archive",),
    "iso_exe": ("weight_iso_exe", "weight_attachment_iso"),
    "iso": ("weight_attachment_iso", "weight_iso_lnk", "weight_iso_exe"),
    "archive_password": ("weight_archive_password", "weight_archive_password_match"),
    "oob_delivery": ("weight_oob_delivery",),
    "nested_mail": ("weight_archive_nested_email",),
    "safelinks": ("weight_url_rewrite",),
    "ru_rewrite": ("weight_url_rewrite",),
    "rewrite": ("weight_url_rewrite",),
    "wrap_lure": ("weight_wrap_lure", "weight_url_rewrite"),
    "cid_phishing": ("weight_cid_phishing",),
    "form_action": ("weight_form_action_suspicious",),
    "arc_fail": ("weight_arc_fail",),
    "reply_chain": ("weight_reply_chain_anomaly",),
    "return_path": ("weight_return_path_mismatch",),
    "campaign": ("weight_campaign_divergence",),
    "pdf_openaction": ("weight_pdf_openaction_uri",),
    "phishing_content": ("weight_credential_harvest", "weight_href_mismatch"),
    "attachment": ("weight_attachment_flag",),
    "sender_mismatch": ("weight_sender_mismatch",),
    "orphan_reply": ("weight_orphan_reply",),
    "mailer_brand": ("weight_mailer_brand",),
    "dangerous_scheme": ("weight_dangerous_scheme",),
    "url_userinfo": ("weight_url_userinfo",),
    "pdf_launch": ("weight_pdf_launch",),
    "lure_shortcut": ("weight_lure_shortcut",),
    "rtf": ("weight_rtf_exploit",),
    "office_encrypted": ("weight_office_encrypted",),
    "office_external": ("weight_office_external_data",),
    "bec_callback": ("weight_bec_callback",),
    "payment_tokens": ("weight_payment_tokens",),
    "clickfix": ("weight_clickfix",),
    "image_only": ("weight_image_only_body", "weight_image_only_link"),
    "fake_auth": ("weight_fake_auth_results",),
    "office_xlm": ("weight_office_xlm",),
    "office_vba": ("weight_office_vba_live",),
    "macro_password": ("weight_macro_password", "weight_office_vba_live", "weight_office_xlm"),
    "html_form_lure": ("weight_html_form_lure", "weight_form_action_suspicious"),
    "org_domain": ("weight_lookalike", "weight_display_spoof"),
    "resent_from": ("weight_resent_from_mismatch",),
    "msgid_from": ("weight_header_low",),
}


def segment_weights(spark: SparkSession) -> DataFrame:
    """(segment, weight_key), one row a pair."""
    return spark.createDataFrame([(s, w) for s, weights in SEGMENT_WEIGHTS.items() for w in weights], "segment string, weight_key string")


def calibration(df: DataFrame, segment: str, level: str) -> DataFrame:
    """(segment, level, events): how many events of each segment have which level."""
    return df.groupBy(F.coalesce(F.lower(F.trim(segment)), F.lit("")).alias("segment"), F.coalesce(F.lower(F.trim(level)), F.lit("")).alias("level")).agg(F.count("*").alias("events"))


def weight_changes(feedback: DataFrame, weights: DataFrame, step: int = 2, most: int = 10) -> DataFrame:
    """(weight_key, delta): missed cases raise the weights of their segment, false alarms lower
    them; sums are held within ±most, zeros left out. weights(segment, weight_key).
    """
    counted = feedback.where(F.lower("kind").isin("fp", "fn")).groupBy(F.lower(F.trim("segment")).alias("segment")).agg(F.sum(F.when(F.lower("kind") == "fn", step).otherwise(-step)).alias("d"))
    sums = counted.join(weights, "segment").groupBy("weight_key").agg(F.sum("d").alias("d"))
    return sums.select("weight_key", F.greatest(F.lit(-most), F.least(F.lit(most), F.col("d"))).cast("int").alias("delta")).where("delta <> 0")


def threshold_changes(feedback: DataFrame) -> DataFrame:
    """(setting, value): thresholds and caps that the rates of false alarms and missed cases suggest."""
    k, s = F.lower("kind"), F.lower(F.trim(F.coalesce("segment", F.lit(""))))
    one = feedback.agg(
        F.count_if(k == "fp").alias("fp"), F.count_if(k == "fn").alias("fn"), F.count_if(k == "confirm").alias("ok"),
        F.count_if((k == "fp") & (s == "display_spoof")).alias("spoof"), F.count_if((k == "fp") & s.isin("safelinks", "rewrite")).alias("links"),
    )
    usable = (F.col("fp") + F.col("fn") + F.col("ok") >= 3) & (F.col("fp") + F.col("fn") > 0)
    rate = F.col("fp") / F.greatest(F.lit(1), F.col("fp") + F.col("fn"))
    high_fp, some_fp = (rate >= 0.55) & (F.col("fp") >= 2), (rate >= 0.35) & (rate < 0.55) & (F.col("fp") >= 2)
    high_fn, some_fn = (1 - rate >= 0.55) & (F.col("fn") >= 2), (1 - rate >= 0.35) & (1 - rate < 0.55) & (F.col("fn") >= 2)
    after_fp = F.when(high_fp, 35).when(some_fp, 33)
    suspicious = F.when(high_fn, F.greatest(F.lit(18), F.coalesce(after_fp, F.lit(30)) - 5)).when(some_fn, F.greatest(F.lit(22), F.coalesce(after_fp, F.lit(30)) - 3)).otherwise(after_fp)
    malicious = F.when(high_fn, F.greatest(F.lit(45), F.when(high_fp, 65).otherwise(60) - 5)).when(high_fp, 65)
    spoof = F.when(high_fp, 24).when(some_fp, 26)
    spoof = F.when(F.col("spoof") >= 2, F.least(F.coalesce(spoof, F.lit(28)), F.lit(22))).otherwise(spoof)
    look = F.when(high_fp, 26)
    look = F.when(F.col("spoof") >= 2, F.least(F.coalesce(look, F.lit(30)), F.lit(24))).otherwise(look)
    settings = {"threshold_suspicious": suspicious, "threshold_malicious": malicious, "cap_headers": F.when(high_fp, 40), "cap_lookalike": look, "cap_display_spoof": spoof, "cap_content": F.when(high_fn, 45), "cap_urls": F.when(F.col("links") >= 2, 22)}
    rows = F.array(*[F.struct(F.lit(n).alias("setting"), v.cast("int").alias("value")) for n, v in settings.items()])
    return one.where(usable).select(F.explode(rows).alias("r")).select("r.setting", "r.value").where("value is not null")


def accuracy(df: DataFrame, expected: str, observed: str, score: str, middle: dict[str, float]) -> DataFrame:
    """(events, right, mean_deviation): how many levels agree, and how far scores are from the
    middle of the expected level's band.
    """
    mid = F.coalesce(*[F.when(F.col(expected) == k, v) for k, v in middle.items()])
    return df.agg(F.count("*").alias("events"), F.count_if(F.col(expected) == F.col(observed)).alias("right"), F.round(F.avg(F.abs(F.col(score) - mid)), 6).alias("mean_deviation"))
