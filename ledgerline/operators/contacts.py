"""Contacts found on stored web pages: extraction, merging by domain, cleaning, and the funnel's counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phones import checked, prepared
from ..functions.web import contact_items, junk_mail, landing_class, social_ok

KINDS = ("whatsapp", "phones", "emails", "social")
#: Domains from which on a value belongs to a vendor, host or platform.
SHARED_FROM = {"whatsapp": 25, "phones": 25, "emails": 25, "social": 10}


def extract_contacts(pages: DataFrame) -> DataFrame:
    """(domain, kind, value, source_url) of pages (domain, page_no, url, html): each value once a domain, from the page that shows it first."""
    found = contact_items(pages.select("domain", "page_no", "url", "html"))
    return found.groupBy("domain", "kind", "value").agg(F.min_by("url", F.struct("page_no", "pos")).alias("source_url"))


def nested_contacts(sites: DataFrame, contacts: DataFrame) -> DataFrame:
    """sites with one array<struct<value, source_url>> for each kind; a site's contacts are few."""
    items = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("value", "source_url")))).alias(k) for k in KINDS]
    grouped = contacts.groupBy("domain").agg(*items)
    none = F.array().cast("array<struct<value:string,source_url:string>>")
    return sites.join(grouped, "domain", "left").withColumns({k: F.coalesce(k, none) for k in KINDS})


def _cleaned(rows: DataFrame) -> DataFrame:
    """rows (kind, raw) with value, its normal form, and reason, why it goes; null if it stays."""
    kind, raw = F.col("kind"), F.col("raw")
    # made an element of an array and taken out again, so that the checks see a column and not the whole expression
    number = F.when(kind == "whatsapp", prepared(raw, True)).when(kind == "phones", prepared(raw, False))
    rows = rows.withColumn("number", F.explode(F.array(number)))
    rows = rows.withColumn("phone", F.when(F.col("number").isNotNull(), checked(F.col("number"))))
    other = F.when(kind == "emails", F.when(junk_mail(raw), "junk")).when(kind == "social", F.when(~social_ok(raw), "generic")).otherwise("unknown_kind")
    reason = F.when(kind.isin("whatsapp", "phones"), F.col("phone.reason")).otherwise(other)
    value = F.when(kind == "whatsapp", F.concat(F.lit("55"), F.col("phone.value"))).when(kind == "phones", F.col("phone.value")).otherwise(raw)
    return rows.withColumns({"value": value, "reason": reason}).drop("phone", "number")


def marked_sites(sites: DataFrame) -> DataFrame:
    """sites whose status ok gives way to why the landing page isn't their own, where that is so."""
    reason = F.when(F.col("status") == "ok", landing_class(F.col("domain"), F.col("final_url")))
    return sites.withColumn("status", F.coalesce(reason, F.col("status")))


def clean_contacts(sites: DataFrame, contacts: DataFrame, shared_from: dict[str, int] = SHARED_FROM) -> tuple[DataFrame, DataFrame]:
    """Cleaned contacts (domain, kind, value, source_url), and all with their fate (…, raw, reason) for the funnel.

    Contacts of sites that land elsewhere go (reason landing), as do malformed ones, and values that too many
    domains show (shared). Counting domains is a partial aggregate over distinct pairs, so values on very many
    sites are no skew.
    """
    own = marked_sites(sites).select("domain", "status")
    rows = _cleaned(contacts.withColumnRenamed("value", "raw").join(own, "domain"))
    rows = rows.select("domain", "kind", "raw", "source_url", "status", "value", F.when(F.col("status") != "ok", "landing").otherwise(F.col("reason")).alias("reason"))
    limit = F.create_map(*(F.lit(x) for kv in shared_from.items() for x in kv))
    good = rows.where("reason IS NULL").select("kind", "value", "domain").distinct()
    shared = good.groupBy("kind", "value").agg(F.count("*").alias("domains")).where(F.col("domains") >= limit[F.col("kind")]).select("kind", "value", F.lit("shared").alias("shared"))
    fate = rows.join(shared, ["kind", "value"], "left").withColumn("reason", F.coalesce("reason", "shared")).drop("shared")
    kept = fate.where("reason IS NULL").groupBy("domain", "kind", "value").agg(F.min("source_url").alias("source_url"))
    return kept, fate


def funnel(sites: DataFrame, fate: DataFrame) -> DataFrame:
    """(metric, n): raw, kept and dropped contacts by kind and reason, and sites by status and by what they show.

    Contacts count for sites that are ok after the landing test only. <kind>_after is what the cleaned table holds before
    repeats within a site are merged, ok_raw and ok are the sites that contacts are taken from.
    """
    fate, own = fate.where("status = 'ok'"), marked_sites(sites)
    reason = F.coalesce("reason", F.lit("kept"))
    after = fate.where("reason IS NULL").groupBy(F.concat_ws("_", "kind", F.lit("after")).alias("metric")).agg(F.count("*").alias("n"))
    ok = own.where("status = 'ok'").agg(F.count("*").alias("n")).select(F.explode(F.array(F.lit("ok_raw"), F.lit("ok"))).alias("metric"), "n")
    raw = fate.groupBy(F.concat_ws("_", "kind", F.lit("raw")).alias("metric")).agg(F.count("*").alias("n"))
    by_reason = fate.groupBy(F.concat_ws("_", "kind", F.when(reason == "kept", reason).otherwise(F.concat(F.lit("drop_"), reason))).alias("metric")).agg(F.count("*").alias("n"))
    shown = fate.where("reason IS NULL").select("domain", "kind").distinct()
    by_kind = shown.groupBy(F.concat_ws("_", "kind", F.lit("sites")).alias("metric")).agg(F.count("*").alias("n"))
    any_kind = shown.where("kind <> 'social'").agg(F.lit("any_contact_sites").alias("metric"), F.count_distinct("domain").alias("n"))
    status = own.groupBy(F.concat(F.lit("status_"), F.col("status")).alias("metric")).agg(F.count("*").alias("n"))
    return raw.unionByName(after).unionByName(ok).unionByName(by_reason).unionByName(by_kind).unionByName(any_kind).unionByName(status).orderBy("metric")


def sweep_outcome(sites: DataFrame) -> DataFrame:
    """(status, n, share) over all swept sites."""
    total = sites.agg(F.count("*").alias("total"))
    return sites.groupBy("status").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("status", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def shown_shares(sites: DataFrame, kept: DataFrame) -> DataFrame:
    """(kind, n, share): how many of all swept sites show a contact of each kind after cleaning."""
    total = sites.agg(F.count("*").alias("total"))
    shown = kept.select("domain", "kind").distinct().groupBy("kind").agg(F.count("*").alias("n"))
    return shown.join(F.broadcast(total)).select("kind", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))
