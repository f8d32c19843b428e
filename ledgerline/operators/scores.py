"""Contact quality: how direct a registered e-mail or phone is, judged by how many companies share it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.phones import registry_phone_kind
from ..functions.text import fold
from ..functions.web import mail_kind

SCORE_COLUMNS = (
    "cnpj email_kind email_shared_companies email_domain_companies email_matches_name email_score phone1_kind phone1_shared_companies phone2_kind phone2_shared_companies "
    "phone_score contact_score contact_tier"
).split()


def _shares(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, n): distinct company roots of each value. Pairs are made distinct first, so a value that very many rows share is spread over tasks."""
    return rows.select(value.alias(key), "cnpj_basico").where(F.col(key).isNotNull()).distinct().groupBy(key).agg(F.count("*").alias("n"))


def mail_shares(establishments: DataFrame) -> DataFrame:
    return _shares(establishments, "em", F.lower(F.trim("email")))


def domain_shares(establishments: DataFrame) -> DataFrame:
    return _shares(establishments.where(F.col("email").like("%@%.%")), "dom", F.lower(F.split_part("email", F.lit("@"), F.lit(2))))


def phone_shares(establishments: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.concat("ddd1", "telefone1"), F.concat("ddd2", "telefone2")))
    return _shares(establishments, "ph", both)


def share_sketches(establishments: DataFrame, lg_size: int = 14) -> DataFrame:
    """(kind, value, month, sketch): for each e-mail address, mail domain and phone and each month of opening, a sketch of the company roots that show it.

    Sketches of months are kept and merged without their rows: a new month adds its own, a share count over any months is
    merged_shares() of theirs. A sketch is at most 2^lg_size bytes, whatever it has counted.
    """
    em = F.lower(F.trim("email"))
    item = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    domain = F.when(F.col("email").like("%@%.%"), F.lower(F.split_part("email", F.lit("@"), F.lit(2))))
    items = F.array(item("email", em), item("domain", domain), item("phone", F.concat("ddd1", "telefone1")), item("phone", F.concat("ddd2", "telefone2")))
    rows = establishments.select("cnpj_basico", F.date_format("data_inicio_atividade", "yyyy-MM").alias("month"), F.explode(items).alias("i")).where("i.value IS NOT NULL")
    return rows.groupBy("i.kind", "i.value", "month").agg(F.hll_sketch_agg("cnpj_basico", lg_size).alias("sketch"))


def merged_shares(sketches: DataFrame) -> DataFrame:
    """(kind, value, n): about how many companies share each value over all the months given; exact for few, within about 1 % for many."""
    return sketches.groupBy("kind", "value").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def share_points(n: Column) -> Column:
    return F.when(n.isNull(), 0).when(n == 1, 25).when(n <= 3, 10).when(n <= 20, -15).otherwise(-35)


def _clamped(points: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), points))


def _with_count(rows: DataFrame, key: str, counts: DataFrame, name: str) -> DataFrame:
    """rows with the count of their key under `name`. Rows without a key match nothing; they are spread by their own key, not hashed to one task."""
    spread = rows.withColumn("k", F.coalesce(key, F.concat(F.lit("\u0000"), "cnpj")))
    return spread.join(counts.select(F.col(counts.columns[0]).alias("k"), F.col("n").alias(name)), "k", "left").drop("k")


def contact_scores(establishments: DataFrame) -> DataFrame:
    """SCORE_COLUMNS for each establishment with an e-mail or phone.

    Three count tables, each one row a value, join to the establishments; a popular value makes only the
    establishments' side large, which adaptive execution splits.
    """
    rows = establishments.where("email IS NOT NULL OR telefone1 IS NOT NULL OR telefone2 IS NOT NULL")
    em = F.lower(F.trim("email"))
    rows = rows.select(
        "cnpj", em.alias("em"), F.split_part(em, F.lit("@"), F.lit(2)).alias("dom"), F.split_part(em, F.lit("@"), F.lit(1)).alias("loc"),
        F.concat("ddd1", "telefone1").alias("ph1"), F.concat("ddd2", "telefone2").alias("ph2"),
        registry_phone_kind(F.col("ddd1"), F.col("telefone1")).alias("phone1_kind"), registry_phone_kind(F.col("ddd2"), F.col("telefone2")).alias("phone2_kind"),
        F.split(F.regexp_replace(fold(F.coalesce("nome_fantasia", "razao_social", F.lit(""))), "[^a-z0-9 ]", " "), " +").alias("words"),
    )
    phones = phone_shares(establishments)
    rows = _with_count(rows, "em", mail_shares(establishments), "email_shared_companies")
    rows = _with_count(rows, "dom", domain_shares(establishments), "email_domain_companies")
    for i in ("1", "2"):
        rows = _with_count(rows, f"ph{i}", phones, f"phone{i}_shared_companies")
    matches = F.exists(F.filter("words", lambda w: F.length(w) >= 4), lambda w: F.contains(F.col("dom"), w) | F.contains(F.col("loc"), w))
    rows = rows.withColumns({"email_kind": mail_kind(F.col("em")), "email_matches_name": F.coalesce(matches, F.lit(False))})
    kind = F.col("email_kind")
    base = F.when(kind == "corporate", 55).when(kind == "generic", 30).when(kind == "accountant", 15).when(kind == "typo", 5).otherwise(0)
    crowded = F.when((kind == "corporate") & (F.col("email_domain_companies") > 20), 25).otherwise(0)
    mail = F.when(kind.isNotNull(), _clamped(base + share_points(F.col("email_shared_companies")) + F.when(F.col("email_matches_name"), 20).otherwise(0) - crowded))

    def phone(i: str) -> Column:
        kind = F.col(f"phone{i}_kind")
        return F.when(kind.isNotNull(), _clamped(F.when(kind == "mobile", 65).when(kind == "landline", 55).otherwise(-1000) + share_points(F.col(f"phone{i}_shared_companies"))))

    rows = rows.withColumns({"email_score": mail, "phone_score": F.greatest(phone("1"), phone("2"))})
    rows = rows.withColumn("contact_score", F.greatest(F.coalesce("email_score", F.lit(0)), F.coalesce("phone_score", F.lit(0))))
    tier = F.when(F.col("contact_score") >= 85, "high").when(F.col("contact_score") >= 50, "medium").otherwise("low")
    return rows.withColumn("contact_tier", tier).select(*SCORE_COLUMNS)


def tier_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n_rows"), *(F.count_if(F.col("contact_tier") == t).alias(t) for t in ("high", "medium", "low")))


def write_scores(scores: DataFrame, path: str, tiers_path: str) -> None:
    """The score table in sorted files by key, which lookups and scored searches read instead of scoring again, and its tiers as one JSON record."""
    scores.repartitionByRange("cnpj").sortWithinPartitions("cnpj").write.parquet(path, compression="zstd")
    tier_summary(scores.sparkSession.read.parquet(path)).coalesce(1).write.json(tiers_path)
