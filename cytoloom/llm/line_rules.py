"""Line-first cleaning with built-in functions only: rules for each line, then a verdict on what the document has left."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoloom.llm.shared import SPACE, words

WORD = r"[^\x20\x09-\x0D]"
#: A line of prose closes with one of these marks, white space, quotes and brackets after it aside, however many they are.
MARKS, AFTER = ".!?…:;。！？", "\"'’”»)] \t\n\v\f\r"
#: Menus, breadcrumbs and tables: at least so many separators between items.
SEPARATOR, MOST_SEPARATORS = r"\x20[|»›•·>]\x20|\x09", 3
#: Phrases that pages repeat whatever they are about, in lower case.
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "copyright ©", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "uses cookies",
    "enable javascript", "click here", "sign up for", "subscribe to", "log in to", "login to", "powered by", "lorem ipsum", "skip to content", "skip to main content", "share this",
)
#: Words that carry a run of signs, as broken text does; and what such texts must hold.
NOISE, NOISE_RUNS = r"(?:[#$%&*]{3}|!!)(?:[\x20\x09-\x0D]|\z)", ("#", "$", "%", "&", "*", "!!")
SEPARATORS = (" | ", " » ", " › ", " • ", " · ", " > ", "\t")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text to every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    df = docs.withColumns({"_w": words(F.col(text)), "_l": lines})
    df = df.withColumn("_n", F.size("_w"))
    # Windows of three words with their places, sorted, so that equal windows are neighbours.
    tail = lambda k: F.slice(F.col("_w"), k, F.greatest(F.col("_n") - 2, F.lit(1)))
    pair = F.zip_with(tail(1), tail(2), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(pair, tail(3), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_s", F.when(F.col("_n") >= 3, F.sort_array(F.transform(three, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    # A window is repeated if it equals the one before or after it in that order.
    inner = lambda k: F.slice(F.col("_s")["w"], k, F.greatest(F.size("_s") - 1, F.lit(1)))
    equal = F.zip_with(inner(1), inner(2), lambda a, b: F.coalesce(a == b, F.lit(False)))
    df = df.withColumn("_e", F.when(F.size("_s") >= 2, equal))
    here, before = F.concat(F.col("_e"), F.array(F.lit(False))), F.concat(F.array(F.lit(False)), F.col("_e"))
    both = F.zip_with(here, before, lambda a, b: a | b)
    df = df.withColumn("_p", F.sort_array(F.filter(F.zip_with(both, F.col("_s")["i"], lambda m, i: F.when(m, i)), lambda i: i.isNotNull())))
    # Each repeated window covers three words, less what the next one covers again.
    gaps = F.zip_with(F.col("_p"), F.slice(F.col("_p"), 2, F.greatest(F.size("_p"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    covered = F.when(F.size("_p") > 0, F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x))
    return df.withColumns({
        "n_words": F.col("_n").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]", "")).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("_w", "_n", "_s", "_e", "_p")


def clean(docs: DataFrame, text: str = "text", most_lost: float = 0.5) -> DataFrame:
    """Line-first cleaning of every row's whole text.

    A line with a word fails if it has no closing mark, is a row of navigation items, holds a boilerplate phrase, or carries noise
    signs. Adds the measures of `measured`, base_failed (under 50 words, or over half of them in repeated windows), cleaned_text (the
    lines that pass, in order), lost (characters of failing lines over those of all lines with a word), and kept: not base_failed and
    lost <= most_lost. Null and empty texts have no words: base_failed, cleaned_text "", lost 0. Repeated rows are answered alike;
    input columns with the names of results (or _w, _n, _s, _e, _p, _l, _g, _b, _low, _all, _kept) are replaced, others stay.
    """
    df = measured(docs, text)
    has = lambda x, parts: reduce(or_, [F.contains(x, F.lit(p)) for p in parts])
    df = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("_b", has(F.col("_low"), BOILERPLATE + SEPARATORS + NOISE_RUNS)).drop("_low")  # most texts have none: their lines needn't be asked
    opened = lambda x: ~F.right(F.rtrim(x, F.lit(AFTER)), F.lit(1)).isin(*MARKS)
    marked = lambda x: (F.size(F.split(x, SEPARATOR)) > MOST_SEPARATORS) | x.rlike(NOISE) | has(F.lower(x), BOILERPLATE)
    plain, asked = F.filter(F.col("_l"), lambda x: ~opened(x)), F.filter(F.col("_l"), lambda x: ~(opened(x) | marked(x)))
    df = df.withColumn("_g", F.when(F.col("_b"), asked).otherwise(plain))  # _b stands outside the lambdas, or it would be made for every line
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    df = df.withColumns({"_all": total(F.col("_l")), "_kept": total(F.col("_g"))})
    lost = F.when(F.col("_all") > 0, 1 - F.col("_kept") / F.col("_all")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumns({"base_failed": failed, "cleaned_text": F.array_join("_g", "\n"), "lost": lost})
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= most_lost)).drop("_l", "_g", "_b", "_all", "_kept")
