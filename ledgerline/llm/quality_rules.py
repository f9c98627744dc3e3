"""Quality rules by distribution divergence (DataFrame functions only).

Each document gets histograms of character classes, of common words and of word shapes. They are compared with
the fixed reference of its language by Jensen-Shannon distance (base 2, so from 0 to 1), so the verdict
on a document does not depend on the other rows. Short documents give noisy histograms of characters and
common words and pass those by a length guard; word shapes are nearly constant in prose and need none.
``fit_references`` makes references from labelled rows. ``rate_relative`` is a variant whose reference is
the sum over all rows of the language.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.staging import stage

#: White space is the space and U+0009 to U+000D; everything else belongs to words.
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8

#: Frequent function words of each supported language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "was", "be", "by", "on", "this"],
    "fr": ["de", "la", "le", "et", "les", "des", "un", "une", "dans", "est", "en", "que", "qui", "pour", "du"],
    "de": ["der", "die", "und", "in", "den", "von", "das", "mit", "sich", "des", "ist", "im", "dem", "nicht", "ein"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "para"],
}
#: Documents in any other language, or in none. The fixed references take the nearest language for them;
#: the relative ones have one reference for all of them, over the English words.
OTHER = "other"
N_COMMON = 15
LETTERS = [chr(97 + k) for k in range(N_COMMON)]

#: Guards and thresholds of the verdict.
MIN_CHARS, MIN_WORDS = 300, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.28
#: On the labelled rows of sf0.01, clean documents lie up to 0.151 and junk from 0.471 on.
MAX_SHAPE_DISTANCE = 0.3

#: Shapes of words, the first that holds: without letters and digits, equal to the word before, with a
#: symbol, capitals only (two at least), any other.
SHAPES = ["s", "r", "y", "u", "p"]


#: Labelled rows of each language, those of the smallest ids, that ``fit_references`` takes at most.
MOST_LABELLED = 1000
#: Version 1 of the references: what ``fit_references`` gives for sf0.01, which has 219 such documents of en,
#: 47 of fr, 36 of de and 31 of es. Summed histograms of character classes, common words and word shapes.
REFERENCES: dict[str, tuple[list[int], list[int], list[int]]] = {
    "en": ([446973, 7733, 270, 0, 0, 93772, 13239, 28], [5313, 2663, 2151, 1592, 1128, 1064, 842, 753, 759, 511, 606, 477, 433, 597, 425, 74677], [2, 542, 0, 9, 93438]),
    "fr": ([87968, 1515, 125, 0, 0, 18443, 2643, 20], [1006, 560, 355, 298, 259, 253, 180, 135, 79, 104, 215, 130, 102, 110, 147, 14557], [4, 106, 0, 0, 18380]),
    "de": ([68479, 1062, 11, 0, 0, 13182, 1796, 0], [741, 383, 311, 214, 193, 160, 120, 108, 78, 100, 64, 70, 63, 64, 65, 10484], [0, 85, 0, 3, 13130]),
    "es": ([60626, 1039, 90, 0, 0, 12196, 1738, 9], [694, 362, 269, 212, 162, 141, 0, 122, 108, 103, 103, 75, 79, 60, 52, 9685], [0, 73, 0, 3, 12151]),
}


def language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(OTHER))


def _common(lang: Column) -> Column:
    """The word list of a language as an array column."""
    words = F.when(lang == "en", F.array(*map(F.lit, COMMON_WORDS["en"])))
    for code in ("fr", "de", "es"):
        words = words.when(lang == code, F.array(*map(F.lit, COMMON_WORDS[code])))
    return words.otherwise(F.array(*map(F.lit, COMMON_WORDS["en"])))


def _codes(common: Column) -> Column:
    """A letter for each word: its place in the list, or z."""
    code = F.array(F.lit("z"), *map(F.lit, LETTERS))
    return F.array_join(F.transform("words", lambda w: F.element_at(code, (F.array_position(common, F.lower(w)) + 1).cast("int"))), "")


def _counts(codes: str, letters: list[str] = [*LETTERS, "z"]) -> Column:  # noqa: B006
    return F.array(*[(F.char_length(codes) - F.char_length(F.replace(F.col(codes), F.lit(letter), F.lit("")))).cast("long") for letter in letters])


def features(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns of ``docs`` in a struct ``doc``, and the measurements of each text.

    Every intermediate array is a column of its own that later columns use more than once, so that
    the optimizer evaluates it once a row.
    """
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("doc"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
        language(docs[lang_col]).alias("language"),
    )
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != "")).withColumn("common", _common(F.col("language")))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    rows = rows.withColumn("rest", F.regexp_replace("text", "\\p{Ll}+", ""))
    rows = rows.withColumn("codes", _codes(F.col("common")))
    # Nearly all words have a small letter and no symbol; one look tells them.
    shape = lambda w, k: F.when(w.rlike("\\A[^#*$%&|<>]*+\\z") & w.rlike("\\p{Ll}"), F.when((k > 0) & (F.get("hashes", k - 1) == F.get("hashes", k)), "r").otherwise("p")).otherwise(
        F.when(~w.rlike("[\\p{L}\\p{N}]"), "s")
        .when((k > 0) & (F.get("hashes", k - 1) == F.get("hashes", k)), "r")
        .when(w.rlike(SYMBOLS), "y")
        .when(~w.rlike("\\p{Ll}") & w.rlike("\\p{Lu}\\P{Lu}*+\\p{Lu}"), "u")
        .otherwise("p")
    )
    rows = rows.withColumn("shapes", F.array_join(F.transform("words", shape), ""))
    # Rows in no known language are counted against every word list.
    for c, common in COMMON_WORDS.items():
        listed = F.array(*map(F.lit, common))
        rows = rows.withColumn(f"codes_{c}", F.when(F.col("language") == OTHER, _codes(listed)))
    windows = F.when(
        F.size("hashes") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), lambda k: F.xxhash64(F.slice("hashes", k + 1, WINDOW))),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    rows = rows.select(
        "doc",
        "language",
        F.char_length("text").cast("long").alias("n_chars"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.char_length("rest").cast("long").alias("n_not_lower"),
        F.regexp_count("rest", F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("rest", F.lit("\\p{Nd}")).cast("long").alias("n_digits"),
        F.regexp_count("rest", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("rest", F.lit("\\|")).cast("long").alias("n_bars"),
        F.regexp_count("rest", F.lit("[.,;:?!]")).cast("long").alias("n_sentence"),
        "codes",
        "shapes",
        *[f"codes_{c}" for c in COMMON_WORDS],
        windows.alias("windows"),
    )
    rows = rows.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, k: F.struct(h.alias("h"), k.alias("k"))))).otherwise(
            F.expr("cast(array() as array<struct<h:bigint,k:int>>)")
        ),
    )
    twice = F.filter(
        "sorted",
        lambda x, k: ((k > 0) & (F.get("sorted", k - 1)["h"] == x["h"])) | ((k < F.size("sorted") - 1) & (F.get("sorted", k + 1)["h"] == x["h"])),
    )
    rows = rows.withColumn("starts", F.array_sort(F.transform(twice, lambda x: x["k"])))
    covered = F.aggregate(
        F.transform("starts", lambda x, k: F.when(k == F.size("starts") - 1, WINDOW).otherwise(F.least(F.lit(WINDOW), F.get("starts", k + 1) - x))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    n_other = F.col("n_not_lower") - (F.col("n_chars") - F.col("word_chars")) - F.col("n_upper") - F.col("n_digits") - F.col("n_symbols")
    lower, space = F.col("n_chars") - F.col("n_not_lower"), F.col("n_chars") - F.col("word_chars")
    fine = [lower, F.col("n_upper"), F.col("n_digits"), F.col("n_bars"), F.col("n_symbols") - F.col("n_bars"), space, F.col("n_sentence"), n_other - F.col("n_sentence")]
    return rows.select(
        "doc",
        "language",
        "n_chars",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        covered.alias("n_repeat_words"),
        F.array(lower, F.col("n_upper"), F.col("n_digits"), F.col("n_symbols"), space, n_other).alias("classes"),
        F.array(*fine).alias("fine_classes"),
        _counts("shapes", SHAPES).alias("shapes"),
        _counts("codes").alias("common"),
        F.when(F.col("language") == OTHER, F.array(*[_counts(f"codes_{c}") for c in COMMON_WORDS])).alias("commons"),
    )


N_CLASSES, N_FINE = 6, 8


def references(rows: DataFrame) -> DataFrame:
    """Summed histograms of each language: at most one row for each entry of COMMON_WORDS, and OTHER."""
    sums = rows.groupBy("language").agg(
        F.array(*[F.sum(F.col("classes")[k]) for k in range(N_CLASSES)]).alias("ref_classes"),
        F.array(*[F.sum(F.col("common")[k]) for k in range(N_COMMON + 1)]).alias("ref_common"),
    )
    return sums


def fit_references(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """language and the summed fine_classes, common and shapes of labelled rows (doc_id, quality), as in REFERENCES.

    Taken are documents of the supported languages with quality 1 that pass the base rule, at most
    MOST_LABELLED of each language, by the smallest ids. Null texts fail the base rule; rows without a label
    or with a null id take no part. Empty tables give no rows.
    """
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.filter(docs[lang_col].isin(*COMMON_WORDS)).join(good, docs[id_col] == F.col("_id"), "left_semi")
    place = F.row_number().over(Window.partitionBy("language").orderBy("doc_id"))
    rows = _verdict(stage(_measured(named, id_col, text_col, lang_col), "labelled").withColumns({c: F.lit(0.0) for c in ("class_distance", "word_distance")})).filter("NOT base_failed")
    rows = rows.withColumn("place", place).filter(F.col("place") <= MOST_LABELLED)
    sizes = {"fine_classes": N_FINE, "common": N_COMMON + 1, "shapes": len(SHAPES)}
    return rows.groupBy("language").agg(*[F.array(*[F.sum(F.col(c)[k]) for k in range(n)]).alias(c) for c, n in sizes.items()])


def _shares(histogram: Column | str) -> Column:
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(histogram, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def _distance(p: Column | str, q: Column | str) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    log2 = math.log(2)

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * (F.log(2 * a / (a + b)) / log2)).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def _words_far() -> Column:
    return (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)


def _verdict(rows: DataFrame, *more: Column) -> DataFrame:
    """Add base_failed and kept to rows that have their distances."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    odd = (F.col("n_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)
    for also in more:
        odd = odd | also
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~odd)


def judge(rows: DataFrame) -> DataFrame:
    """Add the distances of classes, words and shapes, base_failed and kept to the measurements, by the fixed references.

    Rows in no known language get the distances to the language whose common words lie nearest. Their words are no ground to reject them: a text in a
    language without a reference has none of the listed words, whatever it says.
    """
    rows = rows.withColumns({"p_classes": _shares("fine_classes"), "p_shapes": _shares("shapes"), "p_common": _shares("common")}).withColumn("p_commons", F.transform("commons", _shares))
    found = []
    for k, (c, sums) in enumerate(REFERENCES.items()):
        q_classes, q_common, q_shapes = (F.array(*[F.lit(x / sum(h)) for x in h]) for h in sums)
        p_common = F.coalesce(F.get("p_commons", F.lit(k)), F.col("p_common"))
        here = F.struct(
            _distance(p_common, q_common).alias("word_distance"), _distance("p_classes", q_classes).alias("class_distance"), _distance("p_shapes", q_shapes).alias("shape_distance")
        )
        found.append(F.when(F.col("language").isin(c, OTHER), here))
    rows = rows.withColumn("nearest", F.array_min(F.array(*found)))
    rows = rows.withColumns({c: F.col("nearest")[c] for c in ("class_distance", "word_distance", "shape_distance")})
    return _verdict(rows, F.col("shape_distance") > MAX_SHAPE_DISTANCE, _words_far() & (F.col("language") != OTHER))


def judge_relative(rows: DataFrame) -> DataFrame:
    """Like ``judge``, with the sum over all rows of a language as its reference."""
    rows = rows.join(F.broadcast(references(rows)), "language")
    for name in ("classes", "common"):
        rows = rows.withColumn(f"p_{name}", _shares(name)).withColumn(f"q_{name}", _shares(f"ref_{name}"))
    return _verdict(rows.withColumn("class_distance", _distance("p_classes", "q_classes")).withColumn("word_distance", _distance("p_common", "q_common")), _words_far())


RATED = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]


def _measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return features(narrow).withColumn("doc", F.col("doc.doc_id")).withColumnRenamed("doc", "doc_id")


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, class_distance, word_distance, shape_distance.

    Null and empty texts have no words, so base_failed holds. Null or unknown languages are held
    against the nearest reference, and not judged by its common words. Null ids stay null and repeated rows are rated one by one. Empty tables give no rows;
    other columns are ignored. Words in repeated windows are found by 64-bit hashes of the windows.
    """
    return judge(stage(_measured(docs, id_col, text_col, lang_col), "features")).select(*RATED, "shape_distance")


def rate_relative(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``rate`` against the sums over the rows themselves; null or unknown languages share one reference.

    A large share of junk moves the reference, so this fits only tables that are mostly clean.
    """
    return judge_relative(stage(_measured(docs, id_col, text_col, lang_col).drop("commons", "fine_classes", "shapes"), "features")).select(*RATED)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``rate`` keeps, with all their columns; texts are measured once.

    Null and empty texts go, as they have no words. Ids play no part: null ones and repeated rows are judged one
    by one. Null or unknown languages take the nearest reference, but not its common words. Empty tables give no rows; columns of any
    names may be there. Texts are read whole.
    """
    return judge(stage(features(docs, text_col, lang_col), "measured")).filter("kept").select("doc.*")
