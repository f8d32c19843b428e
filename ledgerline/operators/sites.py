"""Which web site belongs to which company, decided from what its pages say.

Evidence is inverted: pages become rows (domain, kind, value), companies too, and the two meet by equality. No page's
text is joined to a company, so a domain with very many companies or pages is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_phrases, words_only
from ..functions.web import mentions, page_signals

PROMINENT = "title/heading/copyright"


#: Words of a page that are cut into phrases at a time.
CHUNK = 512


def company_claims(companies: DataFrame) -> DataFrame:
    """(domain, cnpj, id, kind, value, slot, name_kind): what would tie each company to a page of its domain.

    kind: key, root, cep, phone, city, name; slot 0 is the trade name, 1 the legal one. id tells rows of a company apart.
    """
    claim = lambda kind, value, slot=F.lit(None), name_kind=F.lit(None): F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), slot.cast("int").alias("slot"), name_kind.cast("string").alias("name_kind"))
    many = lambda kind, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: claim(kind, v))
    postal = F.replace(F.coalesce("cep", F.lit("")), F.lit("-"), F.lit(""))
    names = F.transform(name_phrases(F.col("nome_fantasia"), F.col("razao_social")), lambda p, i: claim("name", p["phrase"], i, p["kind"]))
    claims = F.concat(F.array(claim("key", F.col("cnpj")), claim("root", F.substring("cnpj", 1, 8)), claim("cep", postal), claim("city", words_only(F.col("municipio")))), many("phone", F.col("phones")), names)
    every = F.filter(claims, lambda c: (c["kind"] == "key") | (c["value"] != ""))
    columns = ("cnpj", "razao_social", "nome_fantasia", "municipio", "cep", "phones")
    return companies.select("domain", "cnpj", F.xxhash64(*columns).alias("id"), F.explode(every).alias("c")).select("domain", "cnpj", "id", "c.*")


def page_evidence(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(domain, kind, value, prominent, in_body) of pages (domain, page_no, html): each thing that some page of the domain says, once.

    kind: key, root, cep, phone, and phrase, a run of words of the text or of what stands out (titles, headings,
    copyright lines). Phrases are of the lengths that `sizes` (domain, sizes array<int>) asks for; domains that it
    lacks are left out. A phrase never spans two pages or two headings.
    """
    rows = pages.select("domain", page_signals(F.col("html")).alias("s")).join(sizes, "domain")
    rows = rows.select("domain", "sizes", F.array_max("sizes").alias("longest"), "s.prominent", "s.body", mentions(F.col("s.raw")).alias("m"))
    fact = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    facts = F.concat(fact("key", F.col("m.keys")), fact("root", F.transform("m.keys", lambda k: F.substring(k, 1, 8))), fact("cep", F.col("m.postal")), fact("phone", F.col("m.phones")))
    said = rows.select("domain", F.explode(facts).alias("f")).select("domain", "f.kind", "f.value", F.lit(False).alias("prominent"), F.lit(True).alias("in_body"))

    # chunks of words overlap by the longest phrase less one word, so each phrase lies whole in some chunk
    texts = rows.select("domain", "sizes", "longest", F.explode(F.array(F.struct(F.lit(True).alias("prominent"), F.split(F.trim("prominent"), " +").alias("words")), F.struct(F.lit(False).alias("prominent"), F.split(F.trim("body"), " +").alias("words")))).alias("t"))
    starts = F.sequence(F.lit(0), F.size("t.words") - 1, F.lit(CHUNK))
    chunks = texts.where(F.size("t.words") > 0).select("domain", "sizes", "t.prominent", F.explode(F.transform(starts, lambda i: F.slice(F.col("t.words"), i + 1, F.lit(CHUNK) + F.col("longest") - 1))).alias("words"))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))
    phrases = F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.size("words")), run))
    phrases = chunks.select("domain", F.lit("phrase").alias("kind"), F.explode(F.array_distinct(phrases)).alias("value"), "prominent", (~F.col("prominent")).alias("in_body"))
    return said.unionByName(phrases).groupBy("domain", "kind", "value").agg(F.bool_or("prominent").alias("prominent"), F.bool_or("in_body").alias("in_body"))


def _verdict(name: Column) -> Column:
    """struct<level, evidence> over a company's flags; `name` gets the first rule that fits."""
    level = lambda name, evidence: F.struct(F.lit(name).alias("level"), evidence.alias("evidence"))
    some = lambda cond, what: F.when(cond, F.array(F.lit(what))).otherwise(F.array().cast("array<string>"))
    geo = F.concat(some(F.col("cep"), "cep"), some(F.col("phone"), "phone"))
    names = F.transform("names", lambda s: F.concat(F.lit("name_"), s["name_kind"], F.lit("_in_"), F.when(s["prominent"], PROMINENT).otherwise("body")))
    multi, prominent = name["name_kind"] == "multi", name["prominent"]
    near = F.when(F.size(geo) > 0, geo).when(F.col("city"), F.array(F.lit("city")))
    sure = F.when(F.size(geo) > 0, multi).otherwise(multi & prominent)
    return (
        F.when(F.col("key"), level("confirmed", F.array(F.lit("cnpj_on_page"))))
        .when(F.col("root"), level("confirmed", F.array(F.lit("cnpj_root_on_page"))))
        .when(name.isNull(), level("candidate", F.array().cast("array<string>")))
        .when(near.isNotNull() & sure, level("confirmed", F.concat(names, near)))
        .when(near.isNotNull(), level("likely", F.concat(names, near)))
        .when(multi | (prominent & (name["size"] >= 8)), level("likely", names))
        .otherwise(level("candidate", names))
    )


def match_sites(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """(domain, cnpj, level, evidence) for companies (domain, cnpj, razao_social, nome_fantasia, municipio, cep, phones) and the pages of their domains.

    Companies of domains without pages give no row, equal rows of a company give one. Claims and evidence meet by
    (domain, kind, value); flags are then merged by company, a handful of rows each.
    """
    claims = company_claims(companies.join(pages.select("domain").distinct(), "domain", "left_semi"))
    worded = F.col("kind").isin("name", "city")
    sizes = claims.where(worded).groupBy("domain").agg(F.collect_set(F.size(F.split("value", " "))).alias("sizes"))
    # a domain whose companies have no words to look for still has keys and numbers
    sizes = companies.select("domain").distinct().join(sizes, "domain", "left").select("domain", F.coalesce("sizes", F.array(F.lit(1))).alias("sizes"))
    evidence = page_evidence(pages, sizes)
    found = claims.withColumn("of", F.when(worded, "phrase").otherwise(F.col("kind"))).join(evidence.withColumnRenamed("kind", "of"), ["domain", "of", "value"], "left")
    has = lambda kind, there: F.coalesce(F.bool_or(F.when(F.col("kind") == kind, there)), F.lit(False)).alias(kind)
    there = F.coalesce("in_body", F.lit(False))
    name = F.when((F.col("kind") == "name") & F.col("in_body").isNotNull(), F.struct("slot", "name_kind", "prominent", F.length("value").alias("size")))
    flags = found.groupBy("domain", "cnpj", "id").agg(*(has(k, there) for k in ("key", "root", "cep", "phone", "city")), F.array_sort(F.collect_list(name)).alias("names"))
    # the first name found stands, but several words outdo one
    best = F.coalesce(F.get(F.filter("names", lambda s: s["name_kind"] == "multi"), 0), F.get("names", 0))
    return flags.select("domain", "cnpj", _verdict(best).alias("v")).select("domain", "cnpj", "v.*")


def level_shares(matches: DataFrame) -> DataFrame:
    """(level, n, share) over company-site pairs."""
    total = matches.agg(F.count("*").alias("total"))
    return matches.groupBy("level").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("level", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))
