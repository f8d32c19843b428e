"""Text helpers: Column in, Column out. Two of them need an Arrow function; all others are built-in expressions."""

from __future__ import annotations

import html
import re
import unicodedata
from difflib import SequenceMatcher
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

ACCENTED = "áàâãäåāăąçćčďéèêëēęěíìîïīłñńňóòôõöøōőŕřśšťúùûüūůűýÿžźż"
PLAIN = "aaaaaaaaacccdeeeeeeeiiiiilnnnoooooooorrsstuuuuuuuyyzzz"
# Words that are no part of a company's own name.
LEGAL_WORDS = "ltda ltd me epp eireli sa s a mei ss cia slu ei e de da do das dos d".split()
COMMON_NAMES = (
    "comercio servicos servico brasil brasileira industria empresa grupo transportes transporte construcoes construtora distribuidora representacoes importacao "
    "exportacao participacoes consultoria assessoria engenharia tecnologia solucoes produtos materiais equipamentos comercial industrial associacao sociedade clinica "
    "loja restaurante academia escola centro nacional internacional geral express brasileiro digital studio estudio"
).split()
ACCOUNT_STOP = set("ltda me epp eireli sa s a mei ss e de da do das dos cia comercio servicos servico".split())


def _letters(form: str) -> dict[str, str]:
    """Lower-case signs of the Latin and full-width blocks that the normal form `form` turns into one plain letter or digit and marks."""
    out = {}
    for c in map(chr, (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x209D), *range(0xFF01, 0xFF5F))):
        plain = "".join(x for x in unicodedata.normalize(form, c) if not unicodedata.combining(x))
        if plain != c == c.lower() and len(plain) == 1 and plain.isascii() and plain.isalnum():
            out[c] = plain
    return out


def _mapped(c: Column, form: str) -> Column:
    pairs = _letters(form) | dict(zip(ACCENTED, PLAIN))
    # signs beyond the length of the replacement are dropped: the combining marks that stand alone
    return F.translate(F.lower(c), "".join(pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(pairs.values()))


def fold(c: Column) -> Column:
    """Lower case without accents, composed or combining ones."""
    return _mapped(c, "NFD")


#: Compares without case and accents, in any script.
COLLATION = "UNICODE_CI_AI"


def collated(df: DataFrame, *columns: str) -> DataFrame:
    """df with columns that compare without case and accents by themselves: in equality, joins, grouping and contains. Written tables keep it."""
    return df.withColumns({c: F.collate(c, COLLATION) for c in columns})


def plain(df: DataFrame) -> DataFrame:
    """df with all collated columns as plain strings again."""
    return df.select(*(F.collate(f.name, "UTF8_BINARY").alias(f.name) if _folds(f) else F.col(f.name) for f in df.schema.fields))


def _folds(field: StructField) -> bool:
    return isinstance(field.dataType, StringType) and field.dataType.collation == COLLATION


def self_folding(df: DataFrame) -> set[str]:
    """The columns of df that compare without case and accents by themselves."""
    return {f.name for f in df.schema.fields if _folds(f)}


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def typed_date(c: Column) -> Column:
    """A date of yyyyMMdd text; '0', zeros and what is no date become null."""
    return F.try_to_date(F.when(~c.isin("0", "00000000", ""), c), "yyyyMMdd")


def decimal_comma(c: Column) -> Column:
    """A double of text with a decimal comma; null where it doesn't parse."""
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def words_only(c: Column) -> Column:
    """Folded text, full-width and raised signs plain too, with one blank for each run of other signs than letters and digits."""
    return F.trim(F.regexp_replace(_mapped(F.coalesce(c, F.lit("")), "NFKD"), "[^a-z0-9]+", " "))


def name_tokens(c: Column) -> Column:
    """Words of a name without legal forms; numbers of 11 to 14 digits at its end (owners' documents) go too."""
    words = F.filter(F.split(words_only(c), " "), lambda w: (w != "") & ~w.isin(LEGAL_WORDS))
    joined = F.regexp_replace(F.array_join(words, " "), r"(^| )[0-9]{11,14}(?: [0-9]{11,14})*$", "")
    return F.filter(F.split(joined, " "), lambda w: w != "")


def name_phrases(trade: Column, legal: Column) -> Column:
    """array<struct<kind, phrase>>: trade name, then legal name. multi: two words or more with ten letters; single: one distinctive word of seven."""

    def phrase(c: Column) -> Column:
        tokens = name_tokens(c)
        joined, n = F.array_join(tokens, " "), F.size(tokens)
        multi = (n >= 2) & (F.length(F.array_join(tokens, "")) >= 10)
        single = (n == 1) & (F.length(joined) >= 7) & ~joined.isin(COMMON_NAMES)
        return F.when(multi, F.struct(F.lit("multi").alias("kind"), joined.alias("phrase"))).when(single, F.struct(F.lit("single").alias("kind"), joined.alias("phrase")))

    return F.filter(F.array(phrase(trade), phrase(legal)), lambda p: p.isNotNull())


def safe_label(c: Column, size: int = 64) -> Column:
    return F.substring(F.regexp_replace(c, r"[^A-Za-z0-9 ._\-/+]", ""), 1, size)


def version_label(c: Column) -> Column:
    return F.when(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"), c).otherwise("unknown")


def formatted_key(c: Column) -> Column:
    """NN.NNN.NNN/NNNN-NN for keys of 14 characters, others unchanged."""
    return F.when(F.length(c) == 14, F.regexp_replace(c, "^(.{2})(.{3})(.{3})(.{4})(.{2})$", "$1.$2.$3/$4-$5")).otherwise(c)


def formatted_values(df):
    """The presentation edge: doubles with two decimals, dates as ISO text."""
    return df.select(*(F.round(c, 2).alias(c) if t in ("double", "float") else F.date_format(c, "yyyy-MM-dd").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes))


def _similar_words(name: str | None) -> str:
    plain = unicodedata.normalize("NFKD", name or "").encode("ascii", "ignore").decode().lower()
    return " ".join(sorted(w for w in re.findall("[a-z0-9]+", plain) if w not in ACCOUNT_STOP))


def name_similarity(shown: Column, legal: Column, trade: Column) -> Column:
    """struct<score, against>: how alike the shown name and the nearer of two names are, 0 to 100, in any word order.

    The ratio of matching blocks is no edit distance, so this is an Arrow function; call it on joined candidate
    pairs only. One name's words being all in the other's gives 85 at least; the legal name wins ties.
    """

    @F.arrow_udf("struct<score: int, against: string>")
    def similarity(shown: pa.Array, legal: pa.Array, trade: pa.Array) -> pa.Array:
        out = []
        for s, *names in zip(shown.to_pylist(), legal.to_pylist(), trade.to_pylist()):
            a, best = _similar_words(s), None
            for against, b in zip(("razao_social", "nome_fantasia"), map(_similar_words, names)):
                if a and b:
                    ratio = SequenceMatcher(None, a, b).ratio()
                    if set(a.split()) <= set(b.split()) or set(b.split()) <= set(a.split()):
                        ratio = max(ratio, 0.85)
                    score = round(100 * ratio)
                    if best is None or score > best["score"]:
                        best = {"score": score, "against": against}
            out.append(best)
        return pa.array(out, pa.struct([("score", pa.int32()), ("against", pa.string())]))

    return similarity(shown, legal, trade)


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def _closed(m: re.Match) -> str:
    return html.unescape(m[0]) if m[1].startswith("#") or f"{m[1]};" in html5 else m[0]


def unescaped(c: Column, closed: bool = False) -> Column:
    """HTML entities as characters; `closed`: only those that end in a semicolon. The list of named entities is long, so this is an Arrow function."""

    @F.arrow_udf("string")
    def unescape(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else _CLOSED.sub(_closed, t) if closed else html.unescape(t) for t in texts.to_pylist()], pa.string())

    return unescape(c)


def without_blobs(page: Column) -> Column:
    """Unbroken runs of 150 and more base64-like characters as one blank, so that later patterns stay linear."""
    return F.regexp_replace(page, r"[A-Za-z0-9+/=_.%-]{150,}+", " ")


def without_scripts(page: Column) -> Column:
    return F.regexp_replace(page, r"(?is)<(script|style|noscript|svg)\b.*?</\1>", " ")


def without_tags(page: Column) -> Column:
    return F.regexp_replace(page, "<[^>]+>", " ")


def visible_text(page: Column, closed: bool = False) -> Column:
    return without_tags(unescaped(F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), closed))
