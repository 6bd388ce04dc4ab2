"""Quality rules: counts per document and divergence from language references.

Each document's character classes and common words are counted, a language's
reference holds each class's median share over its documents, and a document is
as far from its language as the Jensen-Shannon distance (base 2, square root)
between the two distributions. Short documents are not judged by distance, as
their histograms are noise; base rules on length and repetition hold for all.
Everything is built-in expressions; the text is read once.

Only documents that pass the base rules and are long enough to be judged add to
a reference, one share a class whatever their length, and a source counts as no
more documents than the mean source of the language. So neither giant documents
nor one hot source move a reference; what holds half of a language's weight does.
Without a column ``source`` all rows are one source.

Defined cases: a null or blank text has no words, fails the base rules and adds
nothing to a reference; a null language is a language of its own; a language
without a reference has null distances and is judged by the base rules; repeated
rows count each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import BLANKS, stored, words

# fixed values: frequent function words of English, French, German and Spanish
COMMON_WORDS = ("the", "of", "and", "to", "in", "is", "de", "la", "le", "les", "et", "des", "un", "que",
                "der", "die", "und", "von", "zu", "mit", "el", "en", "los", "y")
#: Character classes, as patterns of what is not in them; blanks and the rest make two more.
CLASSES = {"lower": "[^a-z]+", "upper": "[^A-Z]+", "digit": "[^0-9]+", "punct": "[^!\"'(),./:;?@\\[\\\\\\]^_`{}~+=-]+"}
SYMBOLS = "[^#*$%&|<>]+"

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
#: Guards: a distance counts only from so many characters or words on.
GUARD_CHARS = 600
GUARD_WORDS = 100
#: Largest distances that a document may keep.
MAX_CHAR_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.35
#: Medians of shares are taken on a grid of this many steps, the weight of a document on one of so many.
GRID = 1000
WEIGHT = 1 << 20


def _length_of(text: Column, not_in: str) -> Column:
    return F.length(F.regexp_replace(text, not_in, "")).cast("long")


def measure(docs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The key (doc_id and lang by default), the base counts, both histograms and the source (as origin) of every row."""
    w, t = F.col("w"), F.col("t")
    key = key or ["doc_id", "lang"]
    origin = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    first = docs.select(*key, origin.alias("origin"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).withColumn("w", words(F.col("t")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    known = F.filter(w, lambda x: x.isin(*COMMON_WORDS))
    windows = F.when(F.size(w) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW))))
    second = first.select(
        *key, "origin", "w", lines.alias("lines"), windows.alias("windows"),
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.length(t).cast("long").alias("n_chars"),
        _length_of(t, SYMBOLS).alias("n_symbols"),
        *(_length_of(t, p).alias(n) for n, p in CLASSES.items()),
        F.concat(F.lit(" "), F.array_join(known, "  "), F.lit(" ")).alias("known"),
        F.size(known).cast("long").alias("n_known"),
    )
    # equal hashes only say that windows may be equal; then the words themselves are sorted and compared
    maybe = F.col("windows").isNotNull() & (F.size(F.array_distinct("windows")) < F.size("windows"))
    texts = F.when(maybe, F.array_sort(F.transform(
        F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.struct(F.array_join(F.slice("w", i, WINDOW), " ").alias("t"), i.alias("p")))))
    third = second.select("*", texts.alias("sorted"))
    twice = F.filter("sorted", lambda x, i: ((i > 0) & (F.get("sorted", i - 1)["t"] == x["t"])) | (F.get("sorted", i + 1)["t"] == x["t"]))
    fourth = third.select("*", F.array_sort(F.transform(twice, lambda x: x["p"])).alias("starts"))
    covered = F.aggregate("starts", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
                          lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])
    one = [((F.octet_length("known") - F.octet_length(F.replace("known", F.lit(f" {x} "), F.lit("")))) / (len(x) + 2)).cast("long") for x in COMMON_WORDS]
    other_chars = F.col("word_chars") - F.col("n_symbols") - sum((F.col(n) for n in CLASSES), F.lit(0))
    return fourth.select(
        *key, "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_chars",
        F.array(*(F.col(n) for n in CLASSES), "n_symbols", F.col("n_chars") - F.col("word_chars"), other_chars).alias("chars"),
        F.array(*one, F.col("n_words") - F.col("n_known")).alias("commons"), "origin",
    )


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(F.lit(2.0) * x / (x + y))).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))
    return F.when(parts.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2)))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def references(measured: DataFrame) -> DataFrame:
    """Per language (ref_lang) the median shares of both histograms, as steps of ``GRID`` (ref_chars, ref_commons)."""
    n_chars, n_words = len(CLASSES) + 3, len(COMMON_WORDS) + 1

    def steps(column: str, long_enough: Column, first: int) -> Column:
        shares = F.transform(_shares(F.col(column), _total(F.col(column))), lambda x, i: F.struct(
            (i + first).alias("class"), F.round(GRID * x).cast("int").alias("step")))
        return F.when(long_enough, shares).otherwise(F.array().cast("array<struct<class:int,step:int>>"))

    judged = measured.where(~_base_failed() & ((F.col("n_chars") >= GUARD_CHARS) | (F.col("n_words") >= GUARD_WORDS)))
    sources = judged.groupBy("lang", "origin").agg(F.count("*").alias("n"))
    # integers, so that the sums don't depend on their order
    mean = F.avg("n").over(Window.partitionBy("lang"))
    weights = sources.select(F.col("lang").alias("w_lang"), F.col("origin").alias("w_origin"), F.ceil(WEIGHT * F.least(F.lit(1.0), mean / F.col("n"))).alias("weight"))
    rows = judged.select("lang", "origin", F.concat(
        steps("chars", F.col("n_chars") >= GUARD_CHARS, 0), steps("commons", F.col("n_words") >= GUARD_WORDS, n_chars)).alias("steps"))
    rows = rows.join(weights, F.col("lang").eqNullSafe(F.col("w_lang")) & F.col("origin").eqNullSafe(F.col("w_origin"))).select("lang", "weight", F.inline("steps"))
    counts = rows.groupBy("lang", "class", "step").agg(F.sum("weight").alias("weight"))
    own = Window.partitionBy("lang", "class")
    upto = counts.select("*", F.sum("weight").over(own.orderBy("step")).alias("upto"), F.sum("weight").over(own).alias("all"))
    medians = upto.where(2 * F.col("upto") >= F.col("all")).groupBy("lang", "class").agg(F.min("step").cast("long").alias("step"))
    at = lambda first, n: F.array(*(F.max(F.when(F.col("class") == i, F.col("step"))) for i in range(first, first + n)))
    whole = lambda c: F.when(F.get(c, F.lit(0)).isNotNull(), F.col(c)).alias(c)
    return medians.groupBy(F.col("lang").alias("ref_lang")).agg(at(0, n_chars).alias("ref_chars"), at(n_chars, n_words).alias("ref_commons")).select(
        "ref_lang", whole("ref_chars"), whole("ref_commons"))


def judge(measured: DataFrame) -> DataFrame:
    """Add both distances, ``base_failed`` and ``kept`` to the rows of ``measure`` (read more than once: store them)."""
    # a stored table has a known size, so the small side is broadcast before the rows are moved
    joined = measured.join(stored(references(measured)), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    shares = joined.select("*", *(
        _shares(F.col(c), _total(F.col(c))).alias(f"{c}_share") for c in ("chars", "commons", "ref_chars", "ref_commons")))
    far = ((F.col("n_chars") >= GUARD_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | (
        (F.col("n_words") >= GUARD_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return shares.select(
        "*", F.round(distance(F.col("chars_share"), F.col("ref_chars_share")), 9).alias("char_distance"),
        F.round(distance(F.col("commons_share"), F.col("ref_commons_share")), 9).alias("word_distance"), _base_failed().alias("base_failed"),
    ).select(*measured.columns[:measured.columns.index("n_words")], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance",
             "base_failed", (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"))


def quality(docs: DataFrame) -> DataFrame:
    """Counts, distances and verdict of every row of documents."""
    return judge(stored(measure(docs)))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep. Texts are stored beside their counts and not moved: only references meet them."""
    names = [c for c in ("text", "source") if c in docs.columns]
    rows = docs.select(F.struct(*docs.columns).alias("row"), "lang", *names)
    return judge(stored(measure(rows, ["row", "lang"]))).where("kept").select("row.*")
