"""Registered queries over page texts, each beside the SQL that finds the same with DuckDB's own regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import codes, phones, text, web
from .operators import contacts
from .plans import demo
from .registered import QUERIES, SQL, query, table


ALL_PAGES = r"""SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS domain, page_id AS page_no, url, html FROM pages
 UNION ALL SELECT source || '.example.com.br', doc_id, 'https://' || source || '.example.com.br/' || CAST(doc_id AS STRING), text FROM documents"""
#: Pages with links of every kind put behind their text, made from the stored ones.
LINKED_PAGES = r"""SELECT 'site' || CAST(page_id % 50 AS STRING) || '.com.br' AS domain, page_id AS page_no, url, html || CASE page_id % 10
 WHEN 0 THEN '<a href="https://wa.me/5511' || lpad(CAST(900000000 + page_id * 7919 % 99999999 AS STRING), 9, '9') || '?text=oi">zap</a>'
 WHEN 1 THEN '<a href="https://api.whatsapp.com/send?phone=551187' || lpad(CAST(page_id * 977 % 999999 AS STRING), 6, '3') || '">zap</a>'
 WHEN 2 THEN '<a href="tel:+55 (21) 3' || lpad(CAST(page_id * 31 % 999 AS STRING), 3, '4') || '-' || lpad(CAST(page_id * 7907 % 9999 AS STRING), 4, '5') || '">fone</a>'
 WHEN 3 THEN '<a href="https://www.instagram.com/loja.' || CAST(page_id AS STRING) || '/">i</a><a href="https://instagram.com/outra">o</a>'
 WHEN 4 THEN '<a href="https://www.facebook.com/sharer/sharer.php?u=x">f</a><a href="https://m.facebook.com/loja' || CAST(page_id % 30 AS STRING) || '/">f</a>'
 WHEN 5 THEN '<a href="https://twitter.com/intent/tweet">t</a><a href="https://x.com/home">t</a><a href="https://x.com/u' || CAST(page_id AS STRING) || '">t</a>'
 WHEN 6 THEN '<a href="https://www.youtube.com/@canal' || CAST(page_id % 7 AS STRING) || '">y</a> <a href="https://br.linkedin.com/company/c-' || CAST(page_id AS STRING) || '">l</a>'
 WHEN 7 THEN '<p>Ligue (11) 9' || lpad(CAST(page_id * 7919 % 9999 AS STRING), 4, '8') || '-' || lpad(CAST(page_id * 37 % 9999 AS STRING), 4, '7') || ' ou 0800 123 4567</p>'
 WHEN 8 THEN '<p>Contato: Vendas' || CAST(page_id AS STRING) || '@Loja.com.br. seuemail@loja.com.br logo@2x.png</p>'
 ELSE '<script>var x = "(11) 98765-1234";</script><a href="https://www.tiktok.com/@tok' || CAST(page_id AS STRING) || '">k</a>' END AS html FROM pages"""


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _plain(c: str) -> str:
    """The entities that the given pages hold as characters."""
    return f"replace(replace(replace(replace({c}, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"


def _visible(c: str) -> str:
    return f"""regexp_replace({_plain(f"regexp_replace({c}, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g')")}, '<[^>]+>', ' ', 'g')"""


def contacts_sql(pages: str) -> str:
    """CTEs that end in found (domain, kind, value, source_url): every contact of the pages, from the first page that shows it."""
    areas = ", ".join(f"'{a}'" for a in codes.AREA_CODES)
    # in the text with all else than digits and their signs made bars, a word's edge is a run of digits' edge
    number = r"regexp_extract_all(bars, '\b(?:55\s?)?\(?(\d{{2}})\)?[\s.-]?(9?\d{{4}})[\s.-]?(\d{{4}})\b', {0})"
    numbers = f"list_filter(list_transform(list_zip({number.format(1)}, {number.format(2)}, {number.format(3)}), lambda x: x[1] || x[2] || x[3]), lambda x: NOT starts_with(x, '0'))"
    networks = []
    for i, (name, pattern) in enumerate(web.SOCIAL_LINKS.items()):
        handles = f"list_filter(list_transform(regexp_extract_all(page, '{_quoted(pattern)}', 1), lambda h: regexp_replace(h, '^/+|/+$', '', 'g')), lambda h: lower(split_part(h, '/', 1)) NOT IN ({', '.join(f"'{w}'" for w in web.SKIPPED_HANDLES)}))"
        networks.append(f"SELECT domain, page_no, url, 'social' AS kind, '{name}:' || h AS raw, {i} AS place FROM (SELECT domain, page_no, url, ({handles})[1] AS h FROM cut) WHERE h IS NOT NULL")
    generic = " OR ".join(f"split_part(raw, ':', 1) = '{n}' AND (split_part(handle, '/', 1) IN ({', '.join(f"'{w}'" for w in words)}) OR handle IN ({', '.join(f"'{w}'" for w in words)}))" for n, words in web.GENERIC_HANDLES.items() if words)
    repeats = " OR ".join(f"contains(sub, '{d * 6}')" for d in "0123456789")
    each = lambda kind, items, first: f"SELECT domain, page_no, url, '{kind}' AS kind, unnest({items}) AS raw, unnest(range({first}, {first} + len({items}))) AS place FROM cut"
    return f"""source AS ({pages}), blobless AS (SELECT domain, page_no, url, regexp_replace(html, '[A-Za-z0-9+/=_.%-]{{150,}}', ' ', 'g') AS page FROM source),
 cut AS (SELECT *, regexp_replace({_visible("page")}, '[^0-9./\\s()+-]', '|', 'g') AS bars FROM blobless),
 items AS ({each("whatsapp", f"regexp_extract_all(page, '{_quoted(web.MESSAGE_LINK)}', 1)", 0)}
  UNION ALL {each("phones", f"regexp_extract_all(page, '{_quoted(web.TEL_LINK)}', 1)", 0)} UNION ALL {each("phones", numbers, 1_000_000)}
  UNION ALL {each("emails", f"list_transform(regexp_extract_all(page, '{_quoted(web.MAIL)}'), lambda m: regexp_replace(lower(m), '\\.+$', ''))", 0)} UNION ALL {" UNION ALL ".join(networks)}),
 digits AS (SELECT *, ltrim(CASE WHEN g LIKE '00%' THEN substr(g, 3) ELSE g END, '0') AS z FROM (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS g FROM items)),
 national AS (SELECT *, CASE WHEN length(z) IN (12, 13) AND z LIKE '55%' THEN substr(z, 3) ELSE z END AS n FROM digits),
 ninth AS (SELECT *, CASE WHEN kind = 'whatsapp' AND length(n) = 10 AND substr(n, 1, 2) IN ({areas}) AND substr(n, 3, 1) IN ('6', '7', '8', '9') THEN substr(n, 1, 2) || '9' || substr(n, 3) ELSE n END AS d FROM national),
 parts AS (SELECT *, substr(d, 3) AS sub, lower(regexp_replace(raw, '^[^:]*:?', '')) AS handle FROM ninth),
 judged AS (SELECT *, length(d) IN (10, 11) AND substr(d, 1, 2) IN ({areas}) AND NOT (length(sub) = 9 AND sub NOT LIKE '9%') AND NOT (length(sub) = 8 AND substr(sub, 1, 1) NOT IN ('2', '3', '4', '5'))
  AND NOT (len(list_distinct(string_split(sub, ''))) <= 2 OR {repeats} OR contains('{phones.RISING}', sub) OR contains('{phones.FALLING}', sub) OR right(sub, 8) IN ('12345678', '87654321')) AS is_phone FROM parts),
 valued AS (SELECT domain, page_no, url, kind, place, CASE WHEN kind = 'whatsapp' THEN CASE WHEN is_phone THEN '55' || d END WHEN kind = 'phones' THEN CASE WHEN is_phone THEN d END
  WHEN kind = 'emails' THEN CASE WHEN NOT regexp_matches(raw, '{_quoted(web.JUNK_MAIL[0])}') AND NOT regexp_matches(raw, '{_quoted(web.JUNK_MAIL[1])}') AND NOT regexp_matches(raw, '{_quoted(web.ASSET)}') THEN raw END
  WHEN NOT ({generic}) THEN raw END AS value FROM judged),
 found AS (SELECT domain, kind, value, arg_min(url, page_no * 10000000 + place) AS source_url FROM valued WHERE value IS NOT NULL GROUP BY domain, kind, value)"""


def funnel_sql(pages: str) -> str:
    """The funnel's counts of contacts on sites that are all swept and lead to themselves."""
    return f"""WITH {contacts_sql(pages)}, counted AS (SELECT kind, value, count(*) AS n FROM found GROUP BY 1, 2),
 fate AS (SELECT f.*, n >= CASE f.kind WHEN 'social' THEN 10 ELSE 25 END AS shared FROM found f JOIN counted c ON c.kind = f.kind AND c.value = f.value), sites AS (SELECT DISTINCT domain FROM source)
 SELECT kind || '_raw' AS metric, count(*) AS n FROM fate GROUP BY 1 UNION ALL SELECT kind || unnest(['_after', '_kept']), count(*) FROM fate WHERE NOT shared GROUP BY 1
 UNION ALL SELECT kind || '_drop_shared', count(*) FROM fate WHERE shared GROUP BY 1 UNION ALL SELECT kind || '_sites', count(DISTINCT domain) FROM fate WHERE NOT shared GROUP BY 1
 UNION ALL SELECT 'any_contact_sites', count(DISTINCT domain) FROM fate WHERE NOT shared AND kind <> 'social' UNION ALL SELECT unnest(['ok', 'ok_raw', 'status_ok']), count(*) FROM sites"""


SQL["page_contact_values"] = f"WITH {contacts_sql(ALL_PAGES)} SELECT * FROM found"
SQL["clean_funnel"] = funnel_sql(ALL_PAGES)
SQL["visible_text"] = f"SELECT page_id, {_visible('html')} AS visible FROM pages"


def _linked(spark, sf_dir) -> DataFrame:
    return spark.sql(LINKED_PAGES.replace("FROM pages", "FROM {pages}"), pages=table(spark, sf_dir, "pages"))


@query(f"WITH {contacts_sql(LINKED_PAGES)} SELECT * FROM found", views=False)
def linked_contact_values(spark, sf_dir):
    return contacts.extract_contacts(_linked(spark, sf_dir))


@query(funnel_sql(LINKED_PAGES), views=False)
def linked_funnel(spark, sf_dir):
    pages = _linked(spark, sf_dir)
    swept = pages.select("domain").distinct().withColumns({"final_url": F.concat(F.lit("https://"), "domain", F.lit("/")), "status": F.lit("ok")})
    return contacts.funnel(swept, contacts.clean_contacts(swept, contacts.extract_contacts(pages))[1])


# names


def _words(c: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def _tokens(c: str) -> str:
    """A name's words without legal forms and the numbers at its end."""
    legal = ", ".join(f"'{w}'" for w in text.LEGAL_WORDS)
    return f"list_filter(string_split(regexp_replace(array_to_string(list_filter(string_split({_words(c)}, ' '), lambda w: w <> '' AND w NOT IN ({legal})), ' '), '(^| )[0-9]{{11,14}}( [0-9]{{11,14}})*$', '\\1'), ' '), lambda w: w <> '')"


NAMED = "CASE CAST(cnpj_basico AS INTEGER) % 6 WHEN 0 THEN razao_social || ' EIRELI 12345678901' WHEN 1 THEN 'Comércio' WHEN 2 THEN 'Zuleica' WHEN 3 THEN 'Ótica & Cia' WHEN 4 THEN NULL ELSE nome_fantasia || ' - ME' END"
_KIND = f"CASE WHEN len(t) >= 2 AND length(array_to_string(t, '')) >= 10 THEN 'multi' WHEN len(t) = 1 AND length(t[1]) >= 7 AND t[1] NOT IN ({', '.join(f"'{w}'" for w in text.COMMON_NAMES)}) THEN 'single' END"


@query(f"SELECT cnpj, array_to_string(t, ' ') AS tokens, {_KIND} AS kind, CASE WHEN {_KIND} IS NOT NULL THEN array_to_string(t, ' ') END AS phrase FROM (SELECT cnpj, {_tokens(f'({NAMED})')} AS t FROM est)")
def name_phrases(spark, sf_dir):
    named = demo.establishments(spark, sf_dir).select("cnpj", F.expr(NAMED).alias("name"))
    first = F.get(text.name_phrases(F.col("name"), F.lit(None).cast("string")), 0)
    return named.select("cnpj", F.array_join(text.name_tokens(F.col("name")), " ").alias("tokens"), first["kind"].alias("kind"), first["phrase"].alias("phrase"))


# links to contact pages, numbers for messages

_HOST = r"lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"
_WITH_LINK = """html || CASE page_id % 5 WHEN 0 THEN '<a class="x" href="/fale-conosco#form">Fale</a>' WHEN 1 THEN '<a href="https://other.example.org/contato">Contato</a>' WHEN 2 THEN '<a href="http://' || host || '/p?id=1"><b>Atendimento</b></a>' WHEN 3 THEN '<a href="//' || host || '/onde-estamos">x</a>' ELSE '' END"""


@query(f"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/fale-conosco' WHEN 2 THEN 'http://' || host || '/p?id=1' WHEN 3 THEN 'https://' || host || '/onde-estamos' END AS link FROM (SELECT page_id, url, {_HOST} AS host FROM pages)""", views=False)
def contact_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("host", web.url_host(F.col("url")))
    return pages.select("page_id", web.contact_link(F.expr(_WITH_LINK), F.col("url")).alias("link"))


_RAW_MESSAGE = "CASE c_custkey % 4 WHEN 0 THEN '55118' || lpad(CAST(c_custkey * 7919 % 10000000 AS STRING), 7, '6') WHEN 1 THEN '+55 (21) 9' || lpad(CAST(c_custkey * 31 % 100000000 AS STRING), 8, '7') WHEN 2 THEN '0011 3' || lpad(CAST(c_custkey * 977 % 10000000 AS STRING), 7, '2') ELSE '20 8' || lpad(CAST(c_custkey AS STRING), 7, '1') END"


def _message_sql() -> str:
    areas, repeats = ", ".join(f"'{a}'" for a in codes.AREA_CODES), " OR ".join(f"contains(sub, '{d * 6}')" for d in "0123456789")
    return f"""SELECT c_custkey, CASE WHEN reason IS NULL THEN d END AS value, CASE WHEN reason IS NULL THEN CASE WHEN length(d) = 11 THEN 'mobile' ELSE 'landline' END END AS kind, reason FROM (SELECT *, CASE WHEN length(d) NOT IN (10, 11) THEN 'foreign_or_bad_length' WHEN substr(d, 1, 2) NOT IN ({areas}) THEN 'bad_ddd'
 WHEN length(sub) = 9 AND sub NOT LIKE '9%' THEN 'bad_mobile' WHEN length(sub) = 8 AND substr(sub, 1, 1) NOT IN ('2', '3', '4', '5') THEN 'bad_landline'
 WHEN len(list_distinct(string_split(sub, ''))) <= 2 OR {repeats} OR contains('{phones.RISING}', sub) OR contains('{phones.FALLING}', sub) OR right(sub, 8) IN ('12345678', '87654321') THEN 'placeholder_pattern' END AS reason
 FROM (SELECT c_custkey, d, substr(d, 3) AS sub FROM (SELECT c_custkey, CASE WHEN length(n) = 10 AND substr(n, 1, 2) IN ({areas}) AND substr(n, 3, 1) IN ('6', '7', '8', '9') THEN substr(n, 1, 2) || '9' || substr(n, 3) ELSE n END AS d
 FROM (SELECT c_custkey, CASE WHEN length(z) IN (12, 13) AND z LIKE '55%' THEN substr(z, 3) ELSE z END AS n FROM (SELECT c_custkey, ltrim(CASE WHEN g LIKE '00%' THEN substr(g, 3) ELSE g END, '0') AS z FROM (SELECT c_custkey, regexp_replace({_RAW_MESSAGE}, '[^0-9]', '', 'g') AS g FROM customer))))))"""


@query(_message_sql(), views=False)
def message_phones(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", phones.message_phone(F.expr(_RAW_MESSAGE)).alias("p")).select("c_custkey", "p.value", "p.kind", "p.reason")


assert {"page_contact_values", "clean_funnel", "visible_text"} <= QUERIES.keys()
