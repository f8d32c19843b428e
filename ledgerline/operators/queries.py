"""Questions about companies: search, counts, records, partners, addresses, codes. DataFrames in, a DataFrame out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codes
from ..functions.text import fold, formatted_key, self_folding
from ..functions.web import mail_domain
from ..sources.shared import written
from .accounts import account_matches
from .filters import Filters, contains_folded, one_of, only_digits, page, state, text_guard
from .name_index import NameIndex

ORDERS = {
    "data_inicio_atividade": lambda: F.col("data_inicio_atividade").desc_nulls_last(),
    "capital_social": lambda: F.col("capital_social").desc_nulls_last(),
    "razao_social": lambda: F.col("razao_social").asc_nulls_last(),
}
CONTACT_COLUMNS = ["email", "ddd1", "telefone1", "ddd2", "telefone2", "tipo_logradouro", "logradouro", "numero", "complemento", "bairro", "cep"]
FOUND_COLUMNS = (
    "cnpj razao_social nome_fantasia situacao_cadastral data_situacao_cadastral data_inicio_atividade matriz_filial cnae_principal cnae_principal_descricao "
    "natureza_juridica natureza_juridica_descricao porte capital_social opcao_mei opcao_simples municipio uf"
).split()
TIERS = {"low": 0, "medium": 50, "high": 85}
MATCH_NOTES = {
    "confirmed": "The page names this company and one of its registered details.",
    "likely": "The page shows the company's name; no registered detail confirms it.",
    "candidate": "Only the registered e-mail's domain leads to this site; it may belong to someone else.",
}
EVIDENCE = {
    "cnpj_on_page": "registry key on the page",
    "cnpj_root_on_page": "root of the registry key on the page",
    "phone": "registered phone on the page",
    "cep": "registered postal code on the page",
    "city": "registered city on the page",
    "name_multi_in_title/heading/copyright": "company name in title, heading or copyright line",
    "name_single_in_title/heading/copyright": "one distinctive name word in title, heading or copyright line",
    "name_multi_in_body": "company name in the text",
    "name_single_in_body": "one distinctive name word in the text",
}


def group_keys() -> dict[str, Column]:
    """The 16 expressions that counts can be grouped by."""
    opened, changed = F.col("data_inicio_atividade"), F.when(F.col("situacao_cadastral") == "08", F.col("data_situacao_cadastral"))
    plain = {k: F.col(k) for k in ("uf", "municipio", "cnae_principal", "cnae_divisao", "cnae_secao", "natureza_juridica", "porte", "matriz_filial")}
    return plain | {
        "situacao": F.col("situacao_cadastral"),
        "ano_abertura": F.year(opened),
        "mes_abertura": F.date_format(opened, "yyyy-MM"),
        "ano_baixa": F.year(changed),
        "mes_baixa": F.date_format(changed, "yyyy-MM"),
        "mei": F.col("opcao_mei"),
        "simples": F.col("opcao_simples"),
        "motivo_situacao": F.col("motivo_situacao_descricao"),
    }


def count_companies(
    establishments: DataFrame,
    filters: Filters | None = None,
    group_by: str | list[str] = (),
    unit: str = "estabelecimentos",
    metric: str = "count",
    order: str = "count_desc",
    limit: int | None = 25,
    partners: DataFrame | None = None,
    name_index: NameIndex | None = None,
    partner_index: NameIndex | None = None,
) -> DataFrame:
    """Counts (or summed capital of head offices) by up to two keys. limit None returns all groups; indexes as in search_companies."""
    keys, known = [group_by] if isinstance(group_by, str) else list(group_by), group_keys()
    if unit not in ("estabelecimentos", "empresas") or metric not in ("count", "sum_capital") or order not in ("count_desc", "key_asc", "key_desc"):
        raise ValueError("unit, metric or order is unknown")
    if len(keys) > 2 or not set(keys) <= set(known):
        raise ValueError(f"group_by: at most two of {', '.join(known)}")
    if limit is not None:
        page(limit)
    rows = (filters or Filters()).apply(establishments, partners, name_index, partner_index)
    if unit == "empresas" or metric == "sum_capital":
        rows = rows.where("matriz_filial = 1")
    name, value = ("total", F.count("*")) if metric == "count" else ("capital_social_total_brl", F.sum("capital_social"))
    beside = [F.min("uf").alias("uf_do_municipio")] if "municipio" in keys and "uf" not in keys else []
    out = rows.groupBy(*(known[k].alias(k) for k in keys)).agg(value.alias(name), *beside)
    by_key = [F.col(k).asc_nulls_last() for k in keys]
    ordered = {"count_desc": [F.col(name).desc_nulls_last(), *by_key], "key_asc": by_key, "key_desc": [F.col(k).desc_nulls_last() for k in keys]}[order]
    out = out.orderBy(*ordered) if keys else out
    out = out.limit(limit) if limit is not None else out
    for key, names in (("situacao", codes.STATUS), ("porte", codes.SIZES)):
        if key in keys:
            out = out.withColumn(key, codes.label(F.col(key), names, or_code=True))
    return out


def score_floor(value: int | str) -> int:
    if isinstance(value, str):
        key = value.strip().lower()
        value = TIERS.get(key, int(key) if key.isdigit() else -1)
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= 100:
        raise ValueError("min_contact_score: a whole number from 0 to 100, or low, medium, high")
    return value


def score_block() -> Column:
    """The contact-quality block of a joined score row; null without one."""
    names = (
        "contact_score contact_tier email_kind email_shared_companies email_domain_companies email_matches_name email_score phone1_kind phone1_shared_companies phone2_kind "
        "phone2_shared_companies phone_score"
    ).split()
    return F.when(F.col("contact_score").isNotNull(), F.struct(*names))


def with_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    flat = rows.join(scores, "cnpj", "left").withColumn("registry_contact_quality", score_block())
    return flat.select(*rows.columns, "registry_contact_quality")


def with_sites(rows: DataFrame, sites: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Adds website_contacts: what the site under the e-mail's domain shows, with how surely it is the company's own."""
    site = sites.where("status = 'ok'").select("domain", F.struct("domain", "final_url", "crawled_at", "pages", "whatsapp", "phones", "emails", "social").alias("site"))
    out = rows.withColumn("domain", mail_domain(F.col("email"))).join(site, "domain", "left")
    if matches is not None:
        out = out.join(matches.select("domain", "cnpj", "level", "evidence"), ["domain", "cnpj"], "left")
    else:
        out = out.withColumns({"level": F.lit(None).cast("string"), "evidence": F.lit(None).cast("array<string>")})
    texts = F.array_join(F.transform("evidence", lambda e: codes.label(e, EVIDENCE, or_code=True)), "; ")
    basis = F.when(F.col("level").isNull(), "domain of the registered e-mail").when(F.coalesce(F.size("evidence"), F.lit(0)) < 1, "nothing on the page ties the site to this company").otherwise(texts)
    match = F.coalesce("level", F.lit("candidate"))
    block = F.struct("site.*", match.alias("match"), basis.alias("match_basis"), codes.label(match, MATCH_NOTES).alias("note"))
    return out.withColumn("website_contacts", F.when(F.col("site").isNotNull(), block)).select(*rows.columns, "website_contacts")


def search_companies(
    establishments: DataFrame,
    filters: Filters | None = None,
    order_by: str = "data_inicio_atividade",
    include_contacts: bool = False,
    min_contact_score: int | str | None = None,
    limit: int = 25,
    offset: int = 0,
    scores: DataFrame | None = None,
    partners: DataFrame | None = None,
    sites: DataFrame | None = None,
    matches: DataFrame | None = None,
    name_index: NameIndex | None = None,
    partner_index: NameIndex | None = None,
) -> DataFrame:
    """One page of companies, with has_more and next_offset. Scores filter before the page is cut; sites join after it.

    name_index (companies' names by cnpj) and partner_index (partners' names by cnpj_basico) narrow searches inside names.
    """
    if order_by not in ORDERS:
        raise ValueError(f"order_by: one of {', '.join(ORDERS)}")
    limit, offset = page(limit, offset)
    rows = (filters or Filters()).apply(establishments, partners, name_index, partner_index)
    if min_contact_score is not None:
        if scores is None:
            raise ValueError("min_contact_score needs the score table")
        # joined once, with its block, and only for what the other filters leave
        good = scores.where(F.col("contact_score") >= score_floor(min_contact_score)).select("cnpj", score_block().alias("registry_contact_quality"))
        rows = rows.join(good, "cnpj")
    cols = FOUND_COLUMNS + (CONTACT_COLUMNS if include_contacts else []) + (["registry_contact_quality"] if min_contact_score is not None else [])
    # one row more than the page tells whether there are others
    place = F.row_number().over(Window.orderBy(ORDERS[order_by](), "cnpj"))
    rows = rows.select(*cols).orderBy(ORDERS[order_by](), "cnpj").offset(offset).limit(limit + 1)
    rows = rows.withColumn("place", place).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)
    rows = rows.withColumn("next_offset", F.when(F.col("has_more"), F.lit(offset + limit))).withColumnsRenamed({"opcao_mei": "mei", "opcao_simples": "simples"})
    rows = rows.withColumns({"cnpj_formatado": formatted_key(F.col("cnpj")), "situacao": codes.label(F.col("situacao_cadastral"), codes.STATUS), "porte": codes.label(F.col("porte"), codes.SIZES, or_code=True)}).drop("situacao_cadastral")
    if scores is not None and include_contacts and min_contact_score is None:
        rows = with_scores(rows, scores)
    if sites is not None and include_contacts:
        rows = with_sites(rows, sites, matches)
    return rows


def head_offices(establishments: DataFrame) -> DataFrame:
    """One head office for each root: the one with the least key."""
    first = F.row_number().over(Window.partitionBy("cnpj_basico").orderBy("cnpj"))
    return establishments.where("matriz_filial = 1").withColumn("place", first).where("place = 1").drop("place")


def of_root(establishments: DataFrame, root: str) -> DataFrame:
    """All establishments of one root, as a range of keys that the key-sorted layout's statistics prune."""
    root = only_digits(root, "cnpj", 8, 14)[:8]
    return establishments.where(F.col("cnpj").between(root + "0" * 6, root + "9" * 6))


def company_record(establishments: DataFrame, partners: DataFrame, activities: DataFrame, cnpj: str, **more: DataFrame | None) -> DataFrame:
    """company_records of one key or root; only its root's part of the tables is read. `more` as there."""
    digits = only_digits(cnpj, "cnpj", 8, 14)
    keys = establishments.sparkSession.sql("SELECT :key AS cnpj", args={"key": digits})
    return company_records(of_root(establishments, digits), partners.where(F.col("cnpj_basico") == digits[:8]), activities, keys, **more)


def with_accounts(rows: DataFrame, checks: DataFrame) -> DataFrame:
    """Adds account: the first of a company's numbers that a check found an account of, and how well its name fits; null without one."""
    companies = rows.where("cnpj IS NOT NULL").select("cnpj", "razao_social", "nome_fantasia", "ddd1", "telefone1", "ddd2", "telefone2").dropDuplicates(["cnpj"])
    known = account_matches(companies, checks)
    return rows.join(known.select("cnpj", F.struct(*(c for c in known.columns if c != "cnpj")).alias("account")), "cnpj", "left").select(*rows.columns, "account")


def company_records(establishments: DataFrame, partners: DataFrame, activities: DataFrame, keys: DataFrame, scores: DataFrame | None = None, sites: DataFrame | None = None, matches: DataFrame | None = None, checks: DataFrame | None = None) -> DataFrame:
    """One wide record for each key of `keys` (column cnpj: 14 digits, or a root of 8 for its head office); found is false for unknown ones.

    `keys` is a small set. Partners: the first 100 by entry date; secondary activities: the first 50, with their texts.
    """
    asked = keys.select(F.regexp_replace("cnpj", r"\D", "").alias("asked")).distinct()
    # the asked companies' part of the table is read and written once; all that follows comes from that part
    establishments = written(establishments.join(asked.select(F.substring("asked", 1, 8).alias("cnpj_basico")).distinct(), "cnpj_basico", "left_semi"), "asked")
    roots = asked.where("length(asked) = 8").select("asked", F.col("asked").alias("cnpj_basico"))
    by_root = head_offices(establishments).join(roots, "cnpj_basico")
    by_key = establishments.join(asked.where("length(asked) = 14").withColumn("cnpj", F.col("asked")), "cnpj")
    rows = by_root.unionByName(by_key)
    of = rows.select("cnpj_basico").distinct()
    totals = establishments.groupBy("cnpj_basico").agg(F.count("*").alias("estabelecimentos_total"))
    place = F.row_number().over(Window.partitionBy("cnpj_basico").orderBy(F.col("data_entrada").asc_nulls_last(), "nome_socio", "cnpj_cpf_socio"))
    linked = partners.join(of, "cnpj_basico", "left_semi").withColumn("place", place).where("place <= 100")
    partner = F.struct("place", "nome_socio", codes.partner_kind(F.col("identificador_socio")).alias("tipo"), "cnpj_cpf_socio", F.col("qualificacao_socio_descricao").alias("qualificacao"), "data_entrada", "faixa_etaria", "nome_representante")
    linked = linked.groupBy("cnpj_basico").agg(F.array_sort(F.collect_list(partner)).alias("socios"))
    second = rows.select("asked", F.explode(F.slice(F.split("cnae_secundaria", ","), 1, 50)).alias("codigo")).join(activities, "codigo").groupBy("asked").agg(F.array_sort(F.collect_set(F.struct("codigo", "descricao"))).alias("cnae_secundaria_descricoes"))
    out = asked.join(rows, "asked", "left").join(totals, "cnpj_basico", "left").join(linked, "cnpj_basico", "left").join(second, "asked", "left")
    out = out.withColumns({"found": F.col("cnpj").isNotNull(), "cnpj_formatado": formatted_key(F.col("cnpj")), "situacao": codes.label(F.col("situacao_cadastral"), codes.STATUS), "porte_nome": codes.label(F.col("porte"), codes.SIZES)})
    out = with_scores(out, scores) if scores is not None else out
    out = with_accounts(out, checks) if checks is not None else out
    return with_sites(out, sites, matches) if sites is not None else out


def list_partners(partners: DataFrame, cnpj: str, limit: int = 200) -> DataFrame:
    root = only_digits(cnpj, "cnpj", 8, 14)[:8]
    cols = ["nome_socio", "identificador_socio", "cnpj_cpf_socio", F.col("qualificacao_socio_descricao").alias("qualificacao"), "data_entrada", "faixa_etaria", "nome_representante"]
    return partners.where(F.col("cnpj_basico") == root).select(*cols).orderBy(F.col("data_entrada").asc_nulls_last(), "nome_socio", "cnpj_cpf_socio").limit(limit)


def search_partners(partners: DataFrame, establishments: DataFrame, name: str, contains: bool = False, cpf_middle: str | None = None, uf: str | None = None, limit: int = 25, offset: int = 0, index: NameIndex | None = None) -> DataFrame:
    """A page of the companies that a person or firm is a partner of, by whole folded name, or by a part of it within a state.

    With an index of the partners' names (by cnpj_basico), a search for a part reads the companies that it gives, not all partners.
    """
    if contains:
        text_guard(name, uf)
    if not 4 <= len((name or "").strip()) <= 256:
        raise ValueError("name: 4 to 256 characters")
    limit, offset = page(limit, offset)
    partners = index.narrowed(partners, "cnpj_basico", name.strip()) if contains and index else partners
    if "nome_socio" in self_folding(partners):
        key, asked = F.col("nome_socio"), F.lit(name.strip())
    else:
        key, asked = F.col("nome_key") if "nome_key" in partners.columns else fold(F.col("nome_socio")), fold(F.lit(name.strip()))
    found = partners.where(F.contains(key, asked) if contains else key == asked)
    if cpf_middle:
        found = found.where(F.col("cnpj_cpf_socio") == f"***{only_digits(cpf_middle, 'cpf_middle', 6, 6)}**")
    offices = head_offices(establishments)
    if uf:
        offices = offices.where(F.col("uf") == state(uf))
    offices = offices.select("cnpj_basico", "cnpj", "razao_social", codes.label(F.col("situacao_cadastral"), codes.STATUS).alias("situacao"), "data_inicio_atividade", "cnae_principal_descricao", "municipio", "uf")
    out = found.select("cnpj_basico", "nome_socio", "cnpj_cpf_socio", F.col("qualificacao_socio_descricao").alias("qualificacao"), "data_entrada").join(offices, "cnpj_basico").drop("cnpj_basico")
    out = out.withColumn("cnpj_formatado", formatted_key(F.col("cnpj")))
    return out.orderBy(F.col("data_entrada").desc_nulls_last(), "cnpj", "nome_socio", "cnpj_cpf_socio").offset(offset).limit(limit)


def companies_at_address(
    establishments: DataFrame, cep: str | None = None, logradouro_contains: str | None = None, numero: str | None = None, municipio: str | None = None, uf: str | None = None, situacao: str | None = "ativa", limit: int = 50, offset: int = 0
) -> DataFrame:
    """A page of the establishments at an address; total_matching counts all of them."""
    if not cep and not logradouro_contains:
        raise ValueError("cep or logradouro_contains is needed")
    limit, offset = page(limit, offset)
    rows = Filters(cep=cep, municipio=municipio, uf=uf, situacao=situacao).apply(establishments)
    if logradouro_contains:
        text = logradouro_contains.strip()
        first, _, rest = text.partition(" ")
        kind = codes.STREETS.get(first.upper().rstrip("."))
        if kind and rest.strip():
            rows, text = rows.where(F.col("tipo_logradouro") == kind), rest.strip()
        rows = rows.where(contains_folded(F.col("logradouro"), text))
    if numero:
        rows = rows.where(F.col("numero") == numero.strip())
    cols = "cnpj razao_social nome_fantasia data_inicio_atividade cnae_principal_descricao tipo_logradouro logradouro numero complemento bairro cep municipio uf".split()
    total = rows.agg(F.count("*").alias("total_matching"))
    out = rows.select(*cols, codes.label(F.col("situacao_cadastral"), codes.STATUS).alias("situacao"), formatted_key(F.col("cnpj")).alias("cnpj_formatado"))
    order = [F.col("complemento").asc_nulls_last(), "cnpj"]
    out = out.orderBy(*order).offset(offset).limit(limit)
    # the total's one row stays when the page is past the end; a page is small
    return total.join(F.broadcast(out), F.lit(True), "left").select(*out.columns, "total_matching").orderBy(*order)


def lookup_codes(table: DataFrame, text: str, limit: int = 25, establishments: DataFrame | None = None) -> DataFrame:
    """Code rows by code prefix, or by words that all occur; with establishments, municipalities also get their state."""
    if not (text or "").strip():
        raise ValueError("text is needed")
    limit, _ = page(limit)
    words = text.split()
    where = F.col("codigo").startswith(words[0]) if re.fullmatch(r"\d+", text.strip()) else reduce(lambda a, b: a & b, (contains_folded(F.col("descricao"), w) for w in words))
    out = table.where(where).select("codigo", "descricao").orderBy("codigo").limit(limit)
    if establishments is not None:
        states = establishments.where("uf <> 'EX'").groupBy(F.col("municipio_codigo").alias("codigo")).agg(F.min("uf").alias("uf"))
        out = out.join(states, "codigo", "left").orderBy("codigo")
    return out
