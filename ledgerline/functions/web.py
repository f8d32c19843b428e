"""Urls, e-mail addresses, social handles and what web pages say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phones import checked, prepared
from .text import digits, unescaped, visible_text, without_blobs, without_scripts, without_tags, words_only

# What the published rules of the registry's contact data name.
FREE_MAIL = (
    "gmail.com hotmail.com outlook.com yahoo.com yahoo.com.br uol.com.br bol.com.br terra.com.br ig.com.br globo.com live.com "
    "icloud.com msn.com r7.com zipmail.com.br oi.com.br hotmail.com.br outlook.com.br globomail.com me.com gmx.com protonmail.com "
    "yahoo.com.ar aol.com bol.com brturbo.com.br superig.com.br click21.com.br veloxmail.com.br pop.com.br ymail.com mail.com email.com "
    "uai.com.br ibest.com.br itelefonica.com.br netsite.com.br"
).split()
MISTYPED_MAIL = "gmail.com.br gmai.com gamil.com gmal.com gmail.con hotmai.com hotmal.com gmail.co gmial.com hotmail.co outlook.com.com".split()
ACCOUNTANT_WORDS = "contab contad assessoria escritorio contas fiscal despachante consultoria".split()
JUNK_MAIL = (
    r"(?i)@([a-z0-9-]+\.)*(sentry(-next)?\.wixpress\.com|wixpress\.com|sentry\.io)$|^[0-9a-f]{24,}@|@(email|empresa|exemplo|example|domain|dominio|seudominio|seusite|seuemail|yourdomain|yoursite|site|nome|mail|test|teste|mysite|meusite|naoinformado|nomedosite|suaempresa|company|yourcompany)\.(com|com\.br|org|net|br)$|^(email|seuemail|seu-email|seunome|nome|exemplo|example|your|you|name|user|usuario|teste|test|naoinformado)@",
    r"(?i)^(seu|sua|your|my)([-_.]?(contato|email|e-mail|mail|nome|name|usuario|user|site))?@|^(youremail|yourmail|username|seu[-_.]?nome|seu[-_.]?email|example[-_.]?mail)[^@]*@|@(your-?domain|seu-?dominio|e-mail|melhoremail|provedor|hum)\.",
)
ASSET = r"\.(png|jpg|jpeg|gif|webp|svg|css|js)$"
GENERIC_HANDLES = {
    "facebook": (
        "profile.php 2008 sharer.php sharer share.php share recover help https http pages people groups tr plugins policies policy.php dialog login login.php watch events "
        "hashtag photo.php permalink.php story.php l.php business ads marketplace legal about privacy terms gaming stories reel reels video.php videos photo photos home.php facebook"
    ).split(),
    "instagram": "reel reels accounts explore p tv stories about whatsapp direct web instagram legal developer privacy challenge".split(),
    "x": "share intent home whatsapp search i hashtag x twitter login privacy tos explore".split(),
    "tiktok": "@https @http @tiktok".split(),
    "youtube": "c/youtube @youtube".split(),
    "linkedin": [],
}
SKIPPED_HANDLES = "sharer share tr plugins dialog intent home login".split()
SOCIAL_LINKS = {
    "instagram": r"https?://(?:www\.)?instagram\.com/([A-Za-z0-9._]{2,30})/?",
    "facebook": r"https?://(?:www\.|pt-br\.|m\.)?facebook\.com/(profile\.php\?id=\d+|[A-Za-z0-9.\-_/]{2,80})",
    "linkedin": r"https?://(?:[a-z]{2,3}\.)?linkedin\.com/((?:company|in)/[A-Za-z0-9\-_%]{2,80})",
    "youtube": r"https?://(?:www\.)?youtube\.com/(@[A-Za-z0-9._\-]{2,50}|channel/[A-Za-z0-9_\-]+|c/[A-Za-z0-9_\-]+)",
    "tiktok": r"https?://(?:www\.)?tiktok\.com/(@[A-Za-z0-9._]{2,40})",
    "x": r"https?://(?:www\.)?(?:twitter|x)\.com/([A-Za-z0-9_]{2,30})",
}
PARKED = (
    "uni5.net hugedomains.com expireddomains.com buscaintegrada.com.br a.umbler.com umbler.com mpitemporario.com.br combrhost.com.br sedoparking.com sedo.com godaddy.com "
    "registro.br dan.com afternic.com parkingcrew.net bodis.com"
).split()
PLATFORMS = (
    "instagram.com facebook.com accounts.google.com google.com outlook.live.com api.whatsapp.com whatsapp.com youtube.com github.com linktr.ee wa.me x.com twitter.com linkedin.com"
).split()
SECOND_LEVEL = "com net org gov adv edu ind eco med".split()
MESSAGE_LINK = r"(?:wa\.me/|(?:api|web)\.whatsapp\.com/send/?\?[^\"' <>]*phone=|whatsapp://send\?[^\"' <>]*phone=)\+?(\d{10,13})"
MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)(?:\+?55\s?)?\(?(\d{2})\)?[\s.-]?(9?\d{4})[\s.-]?(\d{4})(?!\d)"
TEL_LINK = r"""(?i)href=["']tel:([^"']+)["']"""
ANCHOR = r"""(?is)<a\s[^>]*?href=["']([^"'#][^"']*)["'][^>]*>(.*?)</a>"""
CONTACT_HINT = r"(?i)contato|contact|fale[-_ ]?conosco|atendimento|onde[-_ ]?estamos|localiza"
KEY_ON_PAGE = r"(?<!\d)(\d{2}\.?\d{3}\.?\d{3}\s?/\s?\d{4}\s?-?\s?\d{2})(?!\d)"
POSTAL_ON_PAGE = r"(?<!\d)(\d{5}-?\d{3})(?!\d)"
PHONE_ON_PAGE = r"(?<!\d)(?:\+?55\s?)?\(?0?(\d{2})\)?[\s.-]?(9?\d{4})[\s.-]?(\d{4})(?!\d)"
PROMINENT = (
    (r"(?is)<title[^>]*>(.*?)</title>", 1),
    (r"(?is)<h[12][^>]*>(.*?)</h[12]>", 6),
    (r"""(?i)<meta[^>]+(?:property|name)=["'](?:og:site_name|og:title|application-name|twitter:title)["'][^>]*content=["']([^"']{1,200})["']""", 4),
    (r"""(?i)<meta[^>]+content=["']([^"']{1,200})["'][^>]+(?:property|name)=["'](?:og:site_name|og:title|application-name)["']""", 4),
    (r"(?i)((?:©|&copy;|&#169;|copyright|todos os direitos|direitos reservados)[^<]{0,160})", 6),
)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _prefixed(items: Column, prefix: str) -> Column:
    return F.transform(items, lambda x: F.concat(F.lit(prefix), x))


def url_host(url: Column) -> Column:
    """The lower-cased host of an http(s) url, else ''."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://([^/:?#]+)", 1))


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three below a Brazilian second level."""
    parts = F.split(host, r"\.")
    deep = (F.size(parts) >= 3) & (F.get(parts, F.size(parts) - 1) == "br") & F.get(parts, F.size(parts) - 2).isin(SECOND_LEVEL)
    return F.array_join(F.when(deep, F.slice(parts, -3, 3)).when(F.size(parts) >= 2, F.slice(parts, -2, 2)).otherwise(parts), ".")


def _under(host: Column, domains: list[str]) -> Column:
    return host.isin(domains) | reduce(lambda a, b: a | b, (host.endswith(f".{d}") for d in domains))


def landing_class(domain: Column, final_url: Column) -> Column:
    """Why the page that a domain leads to isn't its own site: parked_or_unavailable, redirects_to_platform, else null."""
    host, own = url_host(final_url), F.lower(F.trim(domain))
    same = (host == "") | (registrable_domain(host) == registrable_domain(own)) | host.endswith(F.concat(F.lit("."), own)) | own.endswith(F.concat(F.lit("."), host))
    return F.when(same, F.lit(None)).when(_under(host, PARKED), "parked_or_unavailable").when(_under(host, PLATFORMS), "redirects_to_platform")


def junk_mail(mail: Column) -> Column:
    return mail.rlike(JUNK_MAIL[0]) | mail.rlike(JUNK_MAIL[1])


def mail_domain(mail: Column) -> Column:
    """What stands after the last @, trimmed and lowered; null without one."""
    return F.when(mail.contains("@"), F.lower(F.trim(F.substring_index(mail, "@", -1))))


def mail_kind(mail: Column) -> Column:
    """invalid, typo, generic (free provider), accountant or corporate, in this order; null without an address. mail is trimmed and lowered."""
    domain, local = F.split_part(mail, F.lit("@"), F.lit(2)), F.split_part(mail, F.lit("@"), F.lit(1))
    office = reduce(lambda a, b: a | b, (c.contains(w) for w in ACCOUNTANT_WORDS for c in (domain, local)))
    kind = F.when(~mail.like("%@%.%"), "invalid").when(domain.isin(MISTYPED_MAIL), "typo").when(domain.isin(FREE_MAIL), "generic").when(office, "accountant").otherwise("corporate")
    return F.when(mail.isNotNull(), kind)


def social_ok(item: Column) -> Column:
    """Whether network:handle names an account and not a function of the network."""
    network, handle = F.substring_index(item, ":", 1), F.lower(F.regexp_replace(item, "^[^:]*:?", ""))
    first = F.substring_index(handle, "/", 1)
    generic = [(network == n) & (first.isin(words) | handle.isin(words)) for n, words in GENERIC_HANDLES.items() if words]
    return ~reduce(lambda a, b: a | b, generic)


def contact_items(pages: DataFrame) -> DataFrame:
    """pages without html, with (pos, kind, value) rows: whatsapp, phones (links, then text), emails, social, in order of finding.

    Values can repeat; the first source of each is chosen where pages are merged. Of each social network only the
    first link counts that isn't a sharing function, and only if it names an account. What is found becomes rows
    before it is checked, so the checks are compiled expressions over a column.
    """
    rest = [c for c in pages.columns if c != "html"]
    rows = pages.withColumn("page", without_blobs(F.col("html"))).withColumn("shown", visible_text(F.col("page")))
    raw = lambda kind, found: F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("raw")))
    join = lambda a, b: F.concat(a, b)
    page, shown = F.col("page"), F.col("shown")
    numbers = F.zip_with(F.zip_with(_found(shown, PHONE, 1), _found(shown, PHONE, 2), join), _found(shown, PHONE, 3), join)
    social = []
    for network, pattern in SOCIAL_LINKS.items():
        handles = F.transform(_found(page, pattern), lambda h: F.regexp_replace(h, "^/+|/+$", ""))
        first = F.slice(F.filter(handles, lambda h: ~F.lower(F.substring_index(h, "/", 1)).isin(SKIPPED_HANDLES)), 1, 1)
        social.append(raw("social", _prefixed(first, f"{network}:")))
    items = F.concat(
        raw("whatsapp", F.transform(_found(page, MESSAGE_LINK), lambda n: prepared(n, True))),
        raw("phones", F.transform(F.concat(_found(page, TEL_LINK), F.filter(numbers, lambda n: ~n.startswith("0"))), lambda n: prepared(n, False))),
        raw("emails", F.transform(_found(page, MAIL, 0), lambda m: F.regexp_replace(F.lower(m), r"\.+$", ""))),
        *social,
    )
    rows = rows.select(*rest, F.posexplode(items).alias("pos", "item")).select(*rest, "pos", "item.kind", "item.raw")
    kind, found = F.col("kind"), F.col("raw")
    phone = F.concat(F.when(kind == "whatsapp", "55").otherwise(""), checked(found)["value"])
    value = (
        F.when(kind.isin("whatsapp", "phones"), phone)
        .when(kind == "emails", F.when(~junk_mail(found) & ~found.rlike(ASSET), found))
        .otherwise(F.when(social_ok(found), found))
    )
    return rows.withColumn("value", value).where("value IS NOT NULL").drop("raw")


def contact_link(page: Column, final_url: Column) -> Column:
    """The first link of the same host whose address or label hints at contact details, as an absolute url; null without one."""
    links = F.arrays_zip(_found(page, ANCHOR, 1).alias("href"), _found(page, ANCHOR, 2).alias("label"))
    base = F.regexp_extract(final_url, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(final_url, r"^([^?#]*)", 1), r"^(https?://[^/]+.*/)[^/]*$", "$1")

    def whole(href: Column) -> Column:
        to = F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).when(href.startswith("/"), F.concat(base, href))
        return F.substring_index(to.otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(base, F.lit("/"))), href)), "#", 1)

    plain = lambda u: F.regexp_replace(url_host(u), r"www\.", "")
    hinted = F.filter(links, lambda a: a["href"].rlike(CONTACT_HINT) | without_tags(a["label"]).rlike(CONTACT_HINT))
    own = F.filter(F.transform(hinted, lambda a: whole(a["href"])), lambda u: (plain(u) == plain(final_url)) & (u != final_url))
    return F.get(own, 0)


def page_signals(page: Column) -> Column:
    """struct<prominent, body, raw> of a whole page: normalised title, headings, names and copyright lines; normalised text; text as it stands."""
    page = without_blobs(page)
    shown = F.concat(*(F.slice(_found(page, pattern), 1, n) for pattern, n in PROMINENT))
    prominent = F.array_join(F.transform(F.split(unescaped(F.array_join(F.transform(shown, without_tags), "\u0001")), "\u0001"), words_only), " | ")
    raw = unescaped(without_tags(without_scripts(page)))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return F.struct(padded(prominent).alias("prominent"), padded(words_only(raw)).alias("body"), raw.alias("raw"))


def mentions(raw: Column) -> Column:
    """struct<keys, postal, phones>: registry keys, postal codes and phone numbers in a text, digits only."""
    phones = F.arrays_zip(_found(raw, PHONE_ON_PAGE, 1).alias("a"), _found(raw, PHONE_ON_PAGE, 2).alias("b"), _found(raw, PHONE_ON_PAGE, 3).alias("c"))
    return F.struct(
        F.array_distinct(F.transform(_found(raw, KEY_ON_PAGE), digits)).alias("keys"),
        F.array_distinct(F.transform(_found(raw, POSTAL_ON_PAGE), digits)).alias("postal"),
        F.array_distinct(F.transform(phones, lambda p: F.concat(p["a"], p["b"], p["c"]))).alias("phones"),
    )


def business_page(body: Column) -> Column:
    """struct<name, account_type, has_photo> of a stored account page; all null where its title or description is missing."""
    title, about = F.regexp_extract(body, 'property="og:title" content="([^"]*)"', 1), F.regexp_extract(body, 'name="description" content="([^"]*)"', 1)
    whole = body.rlike('property="og:title" content="') & body.rlike('name="description" content="')
    about = F.regexp_replace(about, "&#32;|&nbsp;", " ")
    kind = F.when(about.contains("Official Business Account"), "official_business").when(about.contains("Business Account"), "business")
    return F.when(whole, F.struct(unescaped(title).alias("name"), kind.alias("account_type"), (kind.isNotNull() & body.contains("pps.whatsapp.net")).alias("has_photo")))
