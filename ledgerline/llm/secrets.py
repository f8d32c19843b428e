"""Secret scanning with DataFrame functions only, and a random forest that removes false positives.

Candidates are values of any length and signs that follow a credential word or stand before @ in a url, and runs of 16 or
more key characters that hold a digit or change from lower to upper case. Features: length, character classes, character
transitions (a bigram model counted from the corpus), coverage by dictionary words (counted from the corpus, beside a short
fixed list), the document's path, and the words around. The forest is fitted on labelled findings: those given, or else
templates of many kinds and, as distant labels, a bounded number of the corpus's own candidates that their surroundings decide.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, staged, unboxed

KEY = r"A-Za-z0-9+/_\-"
CREDENTIAL = r"(?i)pass(word|wd|phrase)?|pwd|secret|token|api.?key|access.?key|auth|credential|private|bearer|client.?key"
#: A value: after a credential word and a sign of assignment, after Bearer, or the password of a url (behind a user name of at most 1,024 characters); else a run of key characters.
ASSIGNED = r"""(?<=[:=\s"'])(?:(?<=[:=>]{1,2}["'\s]{0,3})(?<=(?i:pass|password|passwd|passphrase|pwd|secret|token|api.?key|access.?key|auth|credential|private.?key|client.?key)["']?\s{0,2}[:=>]{1,2}["'\s]{0,3})|(?<=(?i:bearer)\s))"""
IN_URL = r"(?<=:)(?<=//[^\s/:@]{1,1024}:)[^\s/:@]{3,}+(?=@)"
CANDIDATE = rf"""{ASSIGNED}[^\s"'`<>,;(){{}}\[\]]{{4,}}+|{IN_URL}|(?<![{KEY}])(?=[A-Za-z+/_\-]*+[0-9]|[A-Z0-9+/_\-]*+[a-z]++[a-z0-9+/_\-]*+[A-Z])[{KEY}]{{16,}}+={{0,2}}"""
AROUND = 48
#: Findings of each kind that the templates make.
TEMPLATES = 300
#: Candidates of the corpus that are looked at for distant labels (expected number), chosen by a digest.
LABELLED = 20_000
#: Times that a word occurs in the corpus to be a word of its dictionary.
WORD_TIMES = 3
#: Words of names and prose that random strings don't hold.
DICTIONARY = "the and for not with this that test user name data file path node item type list value index config default example sample dummy version release build commit image string object class page table color width height event order customer product session module package service required password secret token".split()
HARMLESS = r"(?i)commit|checksum|sha-?(1|256|512)|md5|uuid|guid|digest|revision|etag|isbn|serial|version|build|hash"
DUMMY = r"(?i)example|sample|dummy|placeholder|fake|your|change.?me|xxxx|0000|1234567|\$\{|required"
TEST_PATH = r"(?i)(^|[/_.\-])(test|tests|spec|fixture|fixtures|example|examples|mock|docs?)([/_.\-]|$)"
#: The shapes of well-known keys, for the kind of a finding.
KINDS = (("aws_key", r"^(AKIA|ASIA)[0-9A-Z]{16}$"), ("github", r"^gh[pousr]_[A-Za-z0-9]{36,}$"), ("slack", r"^xox[abprs]-"), ("google", r"^AIza[0-9A-Za-z_\-]{35}$"), ("payment", r"^[sr]k_(live|test)_[0-9A-Za-z]{16,}"), ("jwt", r"^eyJ[A-Za-z0-9_\-]{10,}"), ("hex", r"^(?=[0-9]*[a-f])[0-9a-f]{16,}$"))
#: Characters of the bigram model: letters (A-Z lower-cased), one digit, one sign.
CLASSES = "abcdefghijklmnopqrstuvwxyz0."
FOUND = ("word", "before", "after", "path")


def _classes(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(word), "[0-9]", "0"), "[^a-z0]", ".")


def _features(word: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """The features that a finding's own columns give; bigrams and dictionary coverage come by _with_language()."""
    size = F.length(word)
    share = lambda pattern: F.regexp_count(word, F.lit(pattern)) / size
    near = F.regexp_extract(before, r"(\S*\s*\S*)$", 1)
    path = F.coalesce(path, F.lit(""))
    return {
        "length": size.cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "signs": share(r"[+/_\-=]"),
        "other": share(r"[^A-Za-z0-9+/_\-=]"),
        "hex_only": word.rlike("^[0-9a-fA-F]+$").cast("double"),
        "digits_only": word.rlike(r"^[0-9\-]+$").cast("double"),
        "transitions": F.regexp_count(word, F.lit(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) / size,
        "repeats": share(r"(.)(?=\1)"),
        "variety": F.size(F.array_distinct(F.split(word, ""))) / F.sqrt(size.cast("double")),
        "vowels": share("[aeiouAEIOU]"),
        "dashes": word.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-").cast("double"),
        "dummy": (word.rlike(DUMMY) | near.rlike(DUMMY)).cast("double"),
        "prefix": word.rlike("|".join(p for k, p in KINDS if k != "hex")).cast("double"),
        "credential": near.rlike(CREDENTIAL).cast("double"),
        "harmless": near.rlike(HARMLESS).cast("double"),
        "assigned": before.rlike(r"""[:=]\s*["']?$""").cast("double"),
        "quoted": (before.rlike("[\"']$") & after.rlike("^[\"']")).cast("double"),
        "url_password": (before.rlike(r"//[^\s/:@]+:$") & after.startswith("@")).cast("double"),
        "in_url": before.rlike(r"(?i)(https?:)?//\S*$").cast("double"),
        "test_path": path.rlike(TEST_PATH).cast("double"),
        "depth": F.regexp_count(path, F.lit("/")).cast("double"),
    }


def _candidates(box: DataFrame) -> DataFrame:
    """One row (key, id, k, start, word, before, after, path) for each candidate of (key, id, text, path)."""
    hit = box.where(F.col("text").rlike(CANDIDATE)).select(F.monotonically_increasing_id().alias("n"), "key", "id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("words"), F.split("text", CANDIDATE, -1).alias("gaps"))
    # a word starts after the gaps up to it and the words before it
    sizes = lambda items: F.transform(items, F.length)
    steps = F.zip_with(sizes("gaps"), F.concat(F.array(F.lit(0)), sizes("words")), lambda g, w: g + w)
    rows = F.transform(
        F.arrays_zip(F.col("words").alias("word"), F.slice("gaps", 1, F.size("words")).alias("gap"), F.slice("gaps", 2, F.size("words")).alias("next"), F.slice(steps, 1, F.size("words")).alias("step")),
        lambda r: F.struct(r["word"].alias("word"), r["step"].cast("long").alias("step"), F.right(r["gap"], F.lit(AROUND)).alias("before"), F.left(r["next"], F.lit(AROUND)).alias("after")),
    )
    # a fold that appends to an array would be quadratic in a text's candidates, a window over them isn't
    rows = hit.select("n", "key", "id", "path", F.posexplode(rows).alias("k", "r"))
    start = F.sum("r.step").over(Window.partitionBy("n").orderBy("k"))
    return rows.select("key", "id", "path", "k", start.alias("start"), "r.word", "r.before", "r.after")


def _words(texts: DataFrame) -> DataFrame:
    """(part, times): the words of letters, A-Z lower-cased, of a column text, counted."""
    words = texts.select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("part")).where("length(part) BETWEEN 3 AND 24")
    return words.groupBy("part").agg(F.count("*").alias("times"))


def _bigrams(words: DataFrame) -> Column:
    """log10 P(second | first) of two characters' classes as a map of at most 28 * 28 entries, from words with their counts and add-one smoothing."""
    spelled = words.withColumn("c", _classes(F.concat(F.lit("."), "part", F.lit("."))))
    pairs = spelled.select("times", F.explode(F.transform(F.sequence(F.lit(1), F.length("c") - 1), lambda i: F.substring("c", i, F.lit(2)))).alias("pair"))
    seen = {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("times").alias("n")).collect()}  # at most 28 * 28 rows
    of = {a: sum(seen.get(a + b, 0) for b in CLASSES) + len(CLASSES) for a in CLASSES}
    return F.create_map(*(F.lit(x) for a in CLASSES for b in CLASSES for x in (a + b, math.log10((seen.get(a + b, 0) + 1) / of[a]))))


def _with_language(found: DataFrame, dictionary: DataFrame, bigrams: Column) -> DataFrame:
    """found (with a column n that numbers its rows) and the features likelihood and covered."""
    c = _classes(F.concat(F.lit("."), "word", F.lit(".")))
    pairs = F.regexp_extract_all(c, F.lit("(?=(..))"), F.lit(1))  # substring() would count from the start for each
    likely = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.coalesce(F.try_element_at(bigrams, p), F.lit(-4.0))) / (F.length("word") + 1)
    # letters of a candidate in words of the dictionary: it is cut where the case or the kind of sign changes
    cut = F.split(F.lower(F.regexp_replace("word", r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")), "[^\\p{L}]+")
    parts = found.select("n", F.explode(F.array_distinct(F.filter(cut, lambda x: F.length(x) >= 3))).alias("part"))
    known = parts.join(dictionary.select("part"), "part", "left_semi").groupBy("n").agg(F.collect_set("part").alias("known"))
    covered = F.aggregate(F.filter(cut, lambda x: F.array_contains(F.col("known"), x)), F.lit(0), lambda a, x: a + F.length(x)) / F.length("word")
    return found.join(known, "n", "left").withColumns({"likelihood": likely, "covered": F.coalesce(covered, F.lit(0.0))}).drop("known")


def templates(spark: SparkSession, each: int = TEMPLATES) -> DataFrame:
    """Labelled findings (word, before, after, path, label): `each` of every kind, made from digests of numbers.

    Secrets: random keys and passwords in assignments, urls and prose, and keys of known shapes.
    Others: checksums, commits, UUIDs, names joined of words, paths, numbers, placeholders, plain words after credential words.
    """
    rows = spark.range(each).select(F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 512).alias("h"))
    hexa = lambda at, n: F.substring("h", at, n)
    b64 = lambda at, n: F.translate(F.substring(F.base64(F.unhex(F.substring("h", at, 64))), 1, n), "=+/", "Qxy")
    number = lambda at: F.conv(hexa(at, 4), 16, 10).cast("int")
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (number(at) % len(words)) + 1)
    name = lambda at: pick("password secret token api_key access_key auth_token client_secret passwd DB_PASSWORD pwd".split(), at)
    sign = lambda at: pick(["=", ": ", ' = "', "='", ": "], at)
    letters = lambda at, n: F.translate(hexa(at, n), "0123456789", "ghkmqrtvwz")
    word = lambda at: pick(DICTIONARY, at)
    big = lambda at: F.initcap(word(at))
    size = 16 + number(9) % 28
    made = [
        (F.substring("h", F.lit(20), size), F.concat(name(1), sign(5)), "", "", 1),
        (F.substring("h", F.lit(33), size), F.concat(name(5), F.lit(' = "')), '"', "", 1),
        (F.concat(F.lit("AKIA"), F.substring(F.upper(b64(1, 30)), 1, 16)), F.concat(word(3), F.lit(" ")), " and", "", 1),
        (b64(17, 40), F.concat(name(9), sign(13)), " ", "src/app.py", 1),
        (F.concat(b64(3, 5), pick(["!", "$", "@", ".", "&", "#"], 21), b64(23, 4)), F.concat(name(25), sign(29)), "", "", 1),
        (F.concat(big(31), hexa(40, 3), pick(["!", "$", "@", "_", "&", "#"], 21)), F.concat(name(35), sign(39)), "", "", 1),
        (letters(30, 24), F.concat(name(2), sign(6)), "", "", 1),
        (b64(31, 22), F.concat(name(3), sign(7)), "", "", 1),
        (F.concat(b64(5, 6), hexa(50, 3)), F.concat(pick(["postgres", "mysql", "https", "amqp"], 11), F.lit("://"), word(15), F.lit(":")), "@db.host", "", 1),
        (F.concat(pick(["ghp_", "gho_"], 19), b64(11, 36)), F.concat(word(23), F.lit(" ")), " ", "", 1),
        (F.concat(pick(["sk_live_", "rk_live_", "xoxb-", "AIza"], 27), b64(13, 35)), F.concat(word(31), F.lit(" ")), " ", "", 1),
        (F.concat(F.lit("eyJ"), b64(1, 40)), F.lit("Authorization: Bearer "), "", "", 1),
        (hexa(50, 40), F.concat(pick(["commit ", "sha1 ", "revision ", "etag: ", "build "], 7)), " ", "", 0),
        (hexa(1, 64), F.concat(pick(["sha256 checksum: ", "digest ", "hash: "], 11)), "", "", 0),
        (F.concat_ws("-", hexa(2, 8), hexa(10, 4), hexa(14, 4), hexa(18, 4), hexa(22, 12)), F.concat(pick(["uuid=", "id: ", "session ", "guid ", "the "], 11)), "", "", 0),
        (F.concat_ws("_", word(1), word(5), word(9), word(13), hexa(30, 2), F.lit("2024")), F.concat(word(17), F.lit(" ")), " the", "", 0),
        (F.concat(big(1), big(5), big(9), big(13)), F.concat(word(17), F.lit(" ")), " ", "src/app.py", 0),
        (F.concat_ws("/", word(2), word(6), big(10), word(14)), F.concat(F.lit("http://"), word(18), F.lit(".com/")), " ", "", 0),
        (F.concat(pick(["EXAMPLEKEY", "your-api-key-", "changeme-dummy-", "sample_token_"], 21), F.lit("1234567890")), F.concat(name(25), F.lit("=")), "", "docs/example.md", 0),
        (F.translate(hexa(60, 16), "abcdef", "314159"), F.concat(word(33), F.lit(" ")), " and", "", 0),
        (F.concat_ws("-", *(F.translate(hexa(x, 4), "abcdef", "314159") for x in (60, 64, 68, 72))), F.concat(word(33), F.lit(" ")), " and", "", 0),
        (F.concat(F.repeat(hexa(40, 1), 20), F.lit("00")), F.concat(name(29), F.lit("=")), "", "tests/test_keys.py", 0),
        (word(21), F.concat(name(25), sign(29)), " ", "", 0),
        (F.concat(pick(["${", "$", "%"], 21), F.upper(word(25)), F.lit("_KEY")), F.concat(name(29), sign(33)), "", "", 0),
    ]
    found = F.array(*(F.struct(w.alias("word"), b.alias("before"), F.lit(a).alias("after"), F.lit(p).alias("path"), F.lit(float(y)).alias("label")) for w, b, a, p, y in made))
    return rows.select(F.explode(found).alias("f")).select("f.*")


def distant_labels(found: DataFrame, most: int = LABELLED) -> DataFrame:
    """Labelled findings among candidates (FOUND) that their surroundings decide: about `most` candidates at most are looked at.

    Secret: long, random-looking values assigned to a credential word, and keys of known shapes. Not: placeholders, numbers, UUIDs, and
    what follows words such as commit or checksum. All others stay without a label.
    """
    n = found.count()
    some = found.select(*FOUND).where(F.pmod(F.xxhash64(*FOUND), F.lit(max(n, 1))) < most)
    f = _features(*map(F.col, FOUND))
    dull = (f["dummy"] > 0) | (f["digits_only"] > 0) | (f["dashes"] > 0) | (f["harmless"] > 0)
    secret = (f["prefix"] > 0) | (f["credential"] > 0) & (f["assigned"] > 0) & (f["length"] >= 16) & (f["digits"] > 0.05) & (f["transitions"] > 0.05)
    return some.withColumn("label", F.when(dull & (f["prefix"] == 0), 0.0).when(secret & ~dull, 1.0)).where("label IS NOT NULL")


def fit_forest(labelled: DataFrame, features: list[str], trees: int = 32, depth: int = 8, seed: int = 17) -> PipelineModel:
    """A forest over labelled rows (label: 1 for a secret, else 0) with the named features."""
    vectors = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="p", predictionCol="guess", rawPredictionCol="votes")
    return PipelineModel([vectors, forest.fit(vectors.transform(labelled))])


def shown(found: DataFrame, dictionary: DataFrame, bigrams: Column) -> tuple[DataFrame, list[str]]:
    """found (FOUND and other columns) with all features, and their names."""
    own = _features(*map(F.col, FOUND))
    rows = _with_language(staged(found.withColumn("n", F.monotonically_increasing_id()), "found"), dictionary, bigrams)
    return rows.select(*found.columns, *(v.alias(f"f_{k}") for k, v in own.items()), F.col("likelihood").alias("f_likelihood"), F.col("covered").alias("f_covered")), [f"f_{k}" for k in (*own, "likelihood", "covered")]


def _box(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    box = boxed(docs, id=id_col, text=text_col, **({"path": path_col} if path_col else {}))
    box = box if path_col else box.withColumn("path", F.lit(""))
    # the digest of a struct of both, so that no id and text run into each other
    return box.withColumns({"path": F.col("path").cast("string"), "key": F.sha2(F.to_json(F.struct(F.col("id").cast("string").alias("id"), "text")), 256)})


def _judged(box: DataFrame, labelled: DataFrame | None, threshold: float) -> DataFrame:
    spark = box.sparkSession
    found = staged(_candidates(box), "candidates")
    words = staged(_words(box), "words")
    bigrams = _bigrams(words)
    fixed = spark.createDataFrame([(w,) for w in DICTIONARY], "part string")
    dictionary = words.where(F.col("times") >= WORD_TIMES).select("part").union(fixed).distinct()
    if labelled is None:
        labelled = templates(spark).unionByName(distant_labels(found))
    rows, features = shown(labelled.select(*FOUND, F.col("label").cast("double").alias("label")), dictionary, bigrams)
    forest = fit_forest(staged(rows, "labelled"), features)
    rows, _ = shown(found, dictionary, bigrams)
    p = vector_to_array("p").getItem(1)
    kind = F.coalesce(*(F.when(F.col("word").rlike(r), k) for k, r in KINDS), F.lit("other"))
    return forest.transform(rows).select("key", "id", "k", "start", "word", F.length("word").alias("length"), kind.alias("kind"), p.alias("probability"), (p >= threshold).alias("secret"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row (id_col, start, length, kind, probability, secret, secret_sha256) for each candidate in docs.

    start counts characters from 0. Whole texts are searched; null and empty text has no candidates. Repeated rows
    give their findings each; rows without an id keep a null id. Other columns are not read. `labelled` holds
    findings (word, before, after, path, label) to fit on; without it, templates() and distant_labels() make a bounded number
    of them. An empty table, or texts without candidates, give no rows.
    """
    out = _judged(_box(docs, id_col, text_col, path_col), labelled, threshold)
    return out.select(F.col("id").alias(id_col), "start", F.col("length").cast("int").alias("length"), "kind", "probability", "secret", F.sha2("word", 256).alias("secret_sha256"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", labelled: DataFrame | None = None, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret in text_col replaced by `mark`; all rows and other columns stay.

    Only texts with candidates are shuffled. Null text stays null; an empty table stays empty.
    """
    box = _box(docs, id_col, text_col, path_col)
    judged = _judged(box, labelled, threshold).where("secret")
    marks = judged.groupBy("key").agg(F.collect_set("k").alias("at"))
    some = F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False))
    words, gaps = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), F.split("text", CANDIDATE, -1)
    shown = F.transform(words, lambda w, i: F.when(F.array_contains("at", i), F.lit(mark)).otherwise(w))
    new = F.array_join(F.flatten(F.zip_with(gaps, F.concat(shown, F.array(F.lit(""))), lambda g, w: F.array(g, w))), "")
    cut = box.where(some).join(marks, "key", "left").select("row", F.when(F.col("at").isNull(), F.col("text")).otherwise(new).alias("text"))
    whole = box.where(~some).select("row", "text")
    return unboxed(whole.unionByName(cut), docs.columns, **{text_col: F.col("text")})
