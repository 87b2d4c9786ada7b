"""Quality rules: simple counts, and how far a text's histograms lie from those of its language.

Two histograms are taken of each text: characters by class, and words by which common word of the
language they are (or none). Each is compared with the histogram of all documents of the language by
Jensen-Shannon distance. Short texts have ragged histograms, so each distance counts only from a
minimum length on. All of it is built-in functions on one row; the only shuffles are the word counts
that find the common words and the sums of the references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cuelake.llm.common import SPACE, let, stored, words
from cuelake.session import broadcast_if_small, cut, read_table

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Common words of a language, by how often all its documents use them.
COMMON = 16
#: From this many characters and words on a distance counts,
MIN_CHARS_JSD, MIN_WORDS_JSD = 200, 50
#: and a text further than this from its language is rejected (distances lie between 0 and 1).
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.44
#: Character classes that are rare in prose; white space and all other characters are two more.
RARE = (r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()]", r"[#*$%&|<>]")
CLASSES = len(RARE) + 2
#: "@" stands for any other word, the letters after it for the common ones.
_OTHER = 0x40


def _count_chars(text: Column, pattern: str) -> Column:
    """Characters that match a one-character pattern."""
    inverse = pattern.replace(r"\p", r"\P", 1) if pattern.startswith(r"\p") else "[^" + pattern[1:]
    return F.length(F.regexp_replace(text, f"{inverse}+", ""))


def character_classes(text: Column, word_chars: Column) -> Column:
    """How many characters of a text are in each of RARE, white space and the rest. One pass leaves out
    lower-case letters and white space, so that the others count in what little is left."""

    def counts(left: Column) -> Column:
        rare = [_count_chars(left, p) for p in RARE]
        return let(F.array(*rare, F.length(text) - word_chars), lambda c: F.concat(c, F.array(F.length(text) - sum(c[k] for k in range(CLASSES - 1)))))

    return let(F.regexp_replace(text, rf"[\p{{Ll}}{SPACE}]+", ""), counts)


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """How many words of the array lie in windows that come twice or more in it."""

    def covered(hashes: Column) -> Column:
        # Windows sorted by hash, then place: one that equals a neighbour is repeated.
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        def cover(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(let(ordered, places), cover))

    # The array beside itself shifted by one, two ...: each row of the zip is a window.
    shifted = [w, *(F.slice(w, k + 1, F.size(w)) for k in range(1, window))]
    windows = F.slice(F.arrays_zip(*shifted), 1, F.size(w) - window + 1)
    hashes = F.transform(windows, lambda x: F.xxhash64(x))
    return F.when(F.size(w) > window, let(hashes, covered)).otherwise(0)


def common_words(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """lang, common: the most frequent words of each language over all its documents, most frequent
    first (ties: the smaller word). A null language is a language of its own."""
    each = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.explode(words(F.col("text"))).alias("word"))
    counts = each.groupBy("lang", "word").count()
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))).where(F.col("rank") <= common)
    tops = ranked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias("r"))
    return tops.select("lang", F.transform("r", lambda r: r["word"]).alias("common"))


def features(docs: DataFrame, tops: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with _f: the counts and the two histograms of each text. text and lang name the columns."""
    text = F.coalesce(F.col(text), F.lit(""))
    tops = tops.select(F.col("lang").alias("_lang"), F.col("common").alias("_common"))
    keyed = docs.join(broadcast_if_small(tops), F.coalesce(F.col(lang), F.lit("")) == F.col("_lang"), "left")

    def measured(w: Column) -> Column:
        word_chars = F.length(F.array_join(w, ""))
        # A string with a letter for each word: which common word it is, or "@".
        marks = F.array_join(F.transform(w, lambda x: F.char(F.lit(_OTHER) + F.array_position("_common", x))), "")
        per_word = lambda m: F.array(*(F.length(m) - F.length(F.replace(m, F.lit(chr(_OTHER + k)), F.lit(""))) for k in range(COMMON + 1)))
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            word_chars.cast("long").alias("word_chars"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            character_classes(text, word_chars).alias("classes"),
            let(marks, per_word).alias("common"),
        )

    # A generated column is worked out once a row; a projected one again in each filter or column that uses it.
    return keyed.withColumn("_f", F.explode(F.array(let(words(text), measured)))).drop("_common")


def references(measured: DataFrame, lang: str = "lang") -> DataFrame:
    """_ref_lang, _class_ref, _word_ref: the summed histograms of each language."""
    sums = [F.sum(F.col("_f.classes")[k]).alias(f"c{k}") for k in range(CLASSES)] + [F.sum(F.col("_f.common")[k]).alias(f"w{k}") for k in range(COMMON + 1)]
    total = measured.groupBy(F.coalesce(lang, F.lit("")).alias("_ref_lang")).agg(*sums)
    return total.select("_ref_lang", F.array(*(f"c{k}" for k in range(CLASSES))).alias("_class_ref"), F.array(*(f"w{k}" for k in range(COMMON + 1))).alias("_word_ref"))


def jensen_shannon(a: Column, b: Column) -> Column:
    """The Jensen-Shannon distance (square root of the divergence in bits) of two count arrays of the
    same length; null if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    half = lambda p, q: F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    def distance(n: Column) -> Column:
        terms = F.zip_with(a, b, lambda x, y: let(F.struct((x / n["a"]).alias("p"), (y / n["b"]).alias("q")), lambda r: half(r["p"], r["q"]) + half(r["q"], r["p"])))
        return F.when((n["a"] > 0) & (n["b"] > 0), F.sqrt(F.greatest(total(terms) / 2, F.lit(0.0))))

    return let(F.struct(total(a).alias("a"), total(b).alias("b")), distance)


def judge(measured: DataFrame, refs: DataFrame, lang: str = "lang") -> DataFrame:
    """measured with n_words ... base_failed, class_distance, word_distance and kept."""
    out = measured.join(broadcast_if_small(refs), F.coalesce(lang, F.lit("")) == F.col("_ref_lang"), "left")
    names = ("n_words", "word_chars", "n_dup_lines", "n_repeat_words")
    out = out.withColumns({n: F.col(f"_f.{n}") for n in names} | {"n_symbols": F.col("_f.classes")[len(RARE) - 1].cast("long")})
    out = out.withColumns({"class_distance": jensen_shannon(F.col("_f.classes"), F.col("_class_ref")), "word_distance": jensen_shannon(F.col("_f.common"), F.col("_word_ref"))})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    far = lambda distance, size, least, most: (size >= least) & (F.coalesce(distance, F.lit(0.0)) > most)
    chars = F.aggregate("_f.classes", F.lit(0), lambda s, v: s + v)
    odd = far(F.col("class_distance"), chars, MIN_CHARS_JSD, MAX_CLASS_DISTANCE) | far(F.col("word_distance"), F.col("n_words"), MIN_WORDS_JSD, MAX_WORD_DISTANCE)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~odd).drop("_f", "_ref_lang", "_class_ref", "_word_ref", "_lang")


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, class_distance, word_distance.

    A null or empty text has no words and fails, long ones are read whole. A null language is one of its own. Rows that repeat are
    judged alike and returned as often as they come; other columns are ignored. No rows give no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    measured = cut(features(own, cut(common_words(own))).drop("text"))
    out = judge(measured, cut(references(measured)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns as they are, whatever their names.

    A null or empty text goes; a null language is one of its own; rows that repeat share their fate and stay as
    often as they come; no rows give no rows. Texts and histograms are written once: taking the histograms
    a second time costs more than writing and reading the texts.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    measured = stored(features(row, cut(common_words(docs)), "row.text", "row.lang"))
    judged = judge(measured, cut(references(measured, "row.lang")), "row.lang")
    return judged.where("kept").select("row.*")


def op6_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
