"""Secrets by candidates and a random forest that removes false positives; DataFrame functions only.

Every run of 16 or more characters of the key alphabet in the whole text is a candidate; a word can
have several (URLs, minified JSON, comma-separated lines). The name of a run is the one assigned
just before it in its word, for later items of a list that of the list, and otherwise it is looked
for in the words before. A candidate is described by its length, its character transitions (changes between
lower-case letters, capitals, digits and signs, and repeated characters), how much of it dictionary
words cover, its document's path, and its neighbouring words. The dictionary is the corpus' own: the
``WORDS`` words that most documents hold, counted over all of them. The forest is trained on
labelled findings; ``seed_findings`` gives a set made by rule where no reviewed findings exist, and
reviewed rows of the same columns can be added to it or take its place.

Only counts of words are shuffled: candidates are found and scored in the scan of the texts, each
with its neighbours and without the rest of its text. The secret itself never leaves the operator,
only its SHA-256 and its first four characters.

Defined results: null and empty texts have no candidates; a null path counts as empty; repeated
rows give repeated findings; null ids are carried; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.llm.work import table

KEY = r"[A-Za-z0-9_+/=\-]{16,}"
#: A name and its assignment at the end of the text before a run, at the start of a run, and marks between items of a list.
#: A name is entered at its first character only, and nothing is given back, so a long run costs no more than its length.
NAME_BEFORE, NAME_WITHIN, ITEM = r"""(?<![A-Za-z0-9_.\-])([A-Za-z0-9_.\-]++)["'`\\]*+[=:]++["'`\\(\[{]*+$""", r"^([A-Za-z0-9_.\-]+)=[^=]", r"""^["'`\\]*[,;|]["'`\\]*$"""
NAMES = r"(?i)(token|secret|passw|passwd|pwd|api|apikey|auth|bearer|credential|private|access|key)"
#: Short words that long harmless words are often made of.
DICTIONARY = ["able", "and", "con", "der", "die", "ein", "ent", "ere", "est", "example", "for", "hat", "her", "ing", "ion", "ity", "keit", "lich", "ment", "nd", "not", "ous", "our", "que", "sample", "sch", "ser", "st", "test", "th", "the", "ther", "tion", "und", "ung", "ver", "was", "with", "you"]
FEATURES = ["length", "changes", "repeats", "digits", "capitals", "signs", "hexadecimal", "variety", "covered", "named", "assigned", "quoted", "words", "sentence_after", "path_is_test"]
TREES, DEPTH, SEED_ROWS = 40, 7, 6000
#: Words of the dictionary, and their least length.
WORDS, LEAST_WORD = 5000, 3


def _share(token: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(token, pattern, "")) / F.length(token)


def dictionary(docs: DataFrame) -> list[str]:
    """The words of letters that most documents hold, in a fixed order."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{LEAST_WORD},}}"), F.lit(0)))
    held = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r.word for r in held.orderBy(F.desc("n"), "word").limit(WORDS).collect()]


def _spelled(token: Column, known: list[str]) -> Column:
    """Share of the token that is words of the dictionary, cut at signs, digits and capitals."""
    cut = F.split(F.lower(F.regexp_replace(token, r"(?<=[a-z])(?=[A-Z])", " ")), r"[^\p{L}]+")
    inside = F.filter(cut, lambda w: w.isin(known)) if known else F.array().cast("array<string>")
    return F.aggregate(inside, F.lit(0), lambda n, w: n + F.length(w)) / F.length(token)


def features(df: DataFrame, known: list[str] | None = None) -> DataFrame:
    """Numbers that the forest reads, from token, word, before2, before1, after1 and path."""
    token = F.col("token")
    # one sign a class, then one sign a run: the runs less one are the changes
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[_+/=-]", "\u0001"), "[a-z]", "\u0002"), "[A-Z]", "\u0003"), "[0-9]", "\u0004")
    runs = F.regexp_replace(classes, "(.)\\1*", "x")
    spelled = F.filter(F.split(token, ""), lambda c: c != "")
    before = F.concat_ws(" ", F.coalesce("before2", F.lit("")), F.coalesce("before1", F.lit("")), F.regexp_extract("word", r"^([^\"'=:]*)[=:]", 1))
    values = {
        "length": F.length(token).cast("double"),
        "changes": (F.length(runs) - 1) / F.length(token),
        "repeats": _share(token, r"(.)\1+"),
        "digits": 1 - _share(token, "[0-9]"),
        "capitals": 1 - _share(token, "[A-Z]"),
        "signs": 1 - _share(token, "[_+/=-]"),
        "hexadecimal": token.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "variety": F.size(F.array_distinct(spelled)) / F.length(token),
        "covered": 1 - _share(F.lower(token), "(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"),
        "named": before.rlike(NAMES).cast("double"),
        "assigned": (F.coalesce("before1", F.lit("")).rlike("[=:]$") | F.col("word").rlike("[=:]")).cast("double"),
        "quoted": F.col("word").rlike("[\"'`]").cast("double"),
        "words": _spelled(token, known or []),
        "sentence_after": F.coalesce("after1", F.lit("")).rlike(r"^\p{L}+[,.]?$").cast("double"),
        "path_is_test": F.coalesce("path", F.lit("")).rlike("(?i)(test|example|fixture|sample|docs?)(/|$|\\.)").cast("double"),
    }
    return df.select("*", *(c.cast("double").alias(n) for n, c in values.items()))


def seed_findings(spark: SparkSession, rows: int = SEED_ROWS, start: int = 0, known: list[str] | None = None) -> DataFrame:
    """Labelled findings made by rule: token, word, before2, before1, after1, path, label.

    True: hexadecimal, base-64-like and prefixed keys behind a name and an assignment, quoted or
    not. False: long words, numbers, dates and identifiers in prose, digests named as such,
    placeholders, and keys of test paths that say so. Identifiers are made of the words ``known``;
    another ``start`` gives other findings.
    """
    n = F.col("id")
    sha, up = F.sha2(n.cast("string"), 256), F.upper(F.sha2((n + 7).cast("string"), 256))
    h = lambda k: F.pmod(F.xxhash64(n, F.lit(k)), F.lit(k))
    pick = lambda k, *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.pmod(F.xxhash64(n, F.lit(1000 + k)), F.lit(len(xs))) + 1).cast("int"))
    mixed = F.regexp_replace(F.translate(F.base64(F.unhex(sha)), "+/", "-_"), "=", "")
    long_word = F.concat(*(pick(k, *DICTIONARY) for k in range(7)))
    common = [w for w in known or [] if w.isascii()][:1000]
    if common:
        # one literal, not one a word and place
        words = F.split(F.lit(" ".join(common)), " ")
        several = F.concat_ws("_", *(F.element_at(words, (F.pmod(F.xxhash64(n, F.lit(1020 + k)), F.lit(len(common))) + 1).cast("int")) for k in range(5)))
        long_word = F.when((h(7) < 3) & (F.length(several) >= 16), several).otherwise(long_word)
    digits = F.regexp_replace(F.concat(F.abs(F.xxhash64(n, F.lit(1))).cast("string"), F.abs(F.xxhash64(n, F.lit(2))).cast("string")), "-", "")
    kind = F.pmod(n, F.lit(12))
    size = (F.lit(20) + h(24)).cast("int")
    token = (
        F.when(kind.isin(0, 1), F.substring(sha, 1, 40)).when(kind == 2, F.substring(up, 1, 40)).when(kind == 3, F.expr("left(mixed, size)")).when(kind == 4, F.concat(pick(1, "sk_live_", "ghp_", "xoxb-", "pk_"), F.expr("left(mixed, size)"))).when(kind == 5, F.expr("left(sha, size)"))
        .when(kind == 6, long_word).when(kind == 7, F.expr("left(digits, 16)")).when(kind == 8, F.concat(long_word, F.lit("-"), F.expr("left(digits, 4)"))).when(kind == 9, F.substring(sha, 1, 40)).when(kind == 10, pick(2, "xxxxxxxxxxxxxxxxxxxx", "EXAMPLEEXAMPLEEXAMPLE", "your_api_key_goes_here", "0000000000000000000000", "changeme_changeme_changeme")).otherwise(F.substring(up, 1, 32))
    )
    secret = kind <= 5
    names = ("token", "api_key", "secret", "password:", "auth", "access_key", "TOKEN")
    words = ("the", "of", "und", "que", "commit", "order", "la", "with", "then.", "THE!!")
    frame = spark.range(start, start + rows).select("id", sha.alias("sha"), mixed.alias("mixed"), digits.alias("digits"), size.alias("size"))
    frame = frame.select("id", token.alias("token"), secret.alias("secret"), kind.alias("kind"))
    quote = F.when(h(3) > 0, F.lit('"')).otherwise(F.lit(""))
    plain = F.when(kind == 9, pick(3, "sha256", "commit", "digest", "checksum")).when(kind == 10, pick(4, *names)).otherwise(pick(5, *words))
    return frame.select(
        "token",
        F.when(F.col("secret") & (h(5) == 0), F.concat(pick(6, *names), F.lit("="), quote, "token", quote)).when(F.col("secret") | kind.isin(10, 11), F.concat(quote, "token", quote)).otherwise(F.concat("token", pick(7, "", ",", "."))).alias("word"),
        F.when(F.col("secret"), pick(8, *names)).otherwise(plain).alias("before2"),
        F.when(F.col("secret"), pick(9, "=", ":", "=")).when(kind == 9, pick(10, ":", "is", "=")).when(kind.isin(10, 11), F.lit("=")).otherwise(pick(11, *words)).alias("before1"),
        pick(12, "the", "of.", "Then", "and", "la", "").alias("after1"),
        F.when(kind == 11, pick(13, "tests/fixtures/a", "docs/example.md", "sample/x")).otherwise(pick(14, "src/a", "src7", "app/main.py")).alias("path"),
        F.col("secret").cast("double").alias("label"),
    )


def train(findings: DataFrame, known: list[str] | None = None) -> PipelineModel:
    """Forest over labelled findings; their number is bounded by review, not by the corpus."""
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featuresCol="features", labelCol="label", featureSubsetStrategy="sqrt")
    return PipelineModel([vector, forest.fit(vector.transform(features(findings, known)))])


def candidates(docs: DataFrame, path: Column | None = None) -> DataFrame:
    """doc_id, position, run, token, word, before2, before1, after1, path of each run of a word.

    ``word`` is the run with the text between it and the runs beside it; a run with a name in its
    own word has the name and an equals sign for the words before.
    """
    likely = docs.where(F.col("text").rlike(KEY))
    words = likely.select(F.col("doc_id"), F.coalesce(path if path is not None else F.lit(""), F.lit("")).alias("path"), F.split("text", r"\s+").alias("words"))
    # the neighbours go along, not the text
    spot = lambda w, i: F.struct(i.cast("long").alias("position"), w.alias("whole"), F.get("words", i - 1).alias("before1"), F.get("words", i - 2).alias("before2"), F.get("words", i + 1).alias("after1"))
    spots = F.filter(F.transform("words", lambda w, i: F.when((F.length(w) >= 16) & w.rlike(KEY), spot(w, i))), lambda x: x.isNotNull())
    near = words.select("doc_id", "path", F.inline(spots)).withColumns({"tokens": F.regexp_extract_all("whole", F.lit(KEY), F.lit(0)), "gaps": F.split("whole", KEY)})
    found = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    lead = lambda j: F.concat(F.when(j > 0, F.get("tokens", j - 1)).otherwise(F.lit("")), F.get("gaps", j))
    near = near.withColumn("names", F.transform("tokens", lambda t, j: F.coalesce(found(lead(j), NAME_BEFORE), F.when(j > 0, found(t, NAME_WITHIN)))))
    # for each run the last name before it: each name fills the places up to the next one
    near = near.withColumn("named", F.filter(F.transform("names", lambda n, j: F.struct(j.alias("j"), n.alias("name"))), lambda x: x["name"].isNotNull()))
    near = near.withColumn("places", F.concat("named.j", F.array(F.size("names"))))
    filled = F.flatten(F.transform("named", lambda x, k: F.array_repeat(x["name"], F.get("places", k + 1) - x["j"])))
    near = near.withColumn("earlier", F.concat(F.array_repeat(F.lit(None).cast("string"), F.get("places", F.lit(0)) + 1), filled))
    last = F.size("tokens") - 1

    def run(token: Column, j: Column) -> Column:
        gap, after = F.get("gaps", j), F.get("gaps", j + 1)
        # only items of lists look back for a name
        item = (j > 0) & gap.rlike(ITEM)
        name = F.coalesce(F.get("names", j), F.when(item, F.coalesce(F.get("earlier", j), found(F.get("tokens", F.lit(0)), NAME_WITHIN))))
        word = F.concat(gap, token, F.when(j == last, after).otherwise(F.regexp_extract(after, r"""^["'`\\]*""", 0)))
        return F.struct(j.cast("long").alias("run"), token.alias("token"), word.alias("word"), name.alias("name"), ((j == 0) | item).alias("own"), (j == last).alias("last"))

    runs = near.select("doc_id", "position", "path", "before1", "before2", "after1", F.inline(F.transform("tokens", run)))
    before = lambda name, sign: F.when(F.col("name").isNotNull(), sign).when(F.col("own"), F.col(name))
    return runs.select(
        "doc_id", "position", "run", "token", "word", before("before2", F.col("name")).alias("before2"), before("before1", F.lit("=")).alias("before1"),
        F.when(F.col("last"), F.col("after1")).alias("after1"), "path",
    )


def scan(docs: DataFrame, model: PipelineModel, path: Column | None = None, least: float = 0.5, known: list[str] | None = None) -> DataFrame:
    """One row per candidate: doc_id, position, run, token_sha256, shown, length, score, is_secret."""
    found = model.transform(features(candidates(docs, path), known))
    score = vector_to_array("probability")[1]
    return found.select("doc_id", "position", "run", F.sha2("token", 256).alias("token_sha256"), F.concat(F.substring("token", 1, 4), F.lit("…")).alias("shown"), F.length("token").alias("length"), F.round(score, 6).alias("score"), (score >= least).alias("is_secret"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = dictionary(docs)
    return scan(docs, train(seed_findings(spark, known=known), known), F.col("source"), known=known)


QUERIES = {"op7_secret_scan": op7_secret_scan}
