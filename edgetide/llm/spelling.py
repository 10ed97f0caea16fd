"""Groups spelling variants of words: reduced alphabets, one-edit neighbourhoods, verification on the words themselves.

Letters are hashed to a few symbols (the code point modulo their number). Two words that differ by one inserted, deleted or
replaced letter have reduced words that are equal or differ by one such edit. The whole one-edit neighbourhood of every
distinct reduced word is generated, each pair of neighbours from one of its ends: replacements from the word with the smaller
symbol, insertions as deletions from the longer word. Neighbourhoods meet the reduced vocabulary in an equality join, and
the words behind each meeting are compared exactly. A word has a bounded number of possible neighbours (letters times
length), so no group grows with the corpus except the words of one reduced form, of which there are few: 8 symbols
tell a word of seven letters from two million others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import apart, whole_text
from edgetide.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))  # what a run holds once A-Z are lower-cased
SYMBOLS = 8


def letter_runs(text: Column, least: int = 1) -> Column:
    """Maximal runs of ASCII and Latin-1 letters of at least ``least`` letters, A-Z not yet lower-cased."""
    return F.regexp_extract_all(text, F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{max(least, 1)},}}"), F.lit(0))


def worn(doc_id: Column, run: Column, every: int) -> Column:
    """The run, without one letter where ``every`` divides the checksum of ``doc_id:run``; a null id reads as empty."""
    mark = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (mark % F.char_length(run)).cast("int")
    cut = F.concat(run.substr(F.lit(1), place), run.substr(place + 2, F.char_length(run)))
    return F.when(mark % every == 0, cut).otherwise(run)


def word_counts(docs: DataFrame, min_length: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n) over whole texts. A deletion only shortens a run, so shorter runs than ``min_length`` never become words."""
    runs = docs.select("doc_id", F.explode(letter_runs(whole_text("text"), min_length)).alias("run"))
    lowered = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    found = lowered.select(worn(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.char_length("word") >= min_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def reduced(word: Column | str, symbols: int = SYMBOLS) -> Column:
    """The word with every letter replaced by one of ``symbols`` symbols."""
    return F.translate(word, LETTERS, "".join(chr(ord("a") + ord(c) % symbols) for c in LETTERS))


def neighbourhood(word: Column, symbols: int = SYMBOLS) -> Column:
    """The reduced word, its one-symbol deletions and its replacements by a larger symbol, each once.

    Every pair of reduced words within one edit is generated from exactly one of its two words this way.
    """
    places = F.sequence(F.lit(1), F.char_length(word))
    at = lambda i: word.substr(i, F.lit(1))
    head, tail = (lambda i: word.substr(F.lit(1), i - 1)), (lambda i: word.substr(i + 1, F.char_length(word)))
    last_of_run = F.filter(places, lambda i: at(i) != at(i + 1))  # deleting any symbol of a run gives the same word
    deleted = F.transform(last_of_run, lambda i: F.concat(head(i), tail(i)))
    alphabet = F.array(*[F.lit(chr(ord("a") + s)) for s in range(symbols)])
    replaced = F.flatten(F.transform(places, lambda i: F.transform(
        F.filter(alphabet, lambda s: s > at(i)), lambda s: F.concat(head(i), s, tail(i)))))
    return F.when(F.char_length(word) == 0, F.array(word)).otherwise(F.concat(F.array(word), deleted, replaced))


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, other, other_n): every pair of distinct words that differ by exactly one edit, once.

    Joins run on 64-bit hashes of reduced words; a collision can only add pairs to be verified. ``words`` has unique
    words over the letters of ``letter_runs`` with A-Z lower-cased.
    """
    coded = words.select("word", "n", reduced("word", symbols).alias("form"))
    forms = coded.select("form").distinct()
    variants = forms.select(F.xxhash64("form").alias("a"), F.explode(neighbourhood(F.col("form"), symbols)).alias("v"))
    variants = variants.select("a", F.xxhash64("v").alias("b"))
    met = variants.join(apart(forms.select(F.xxhash64("form").alias("b")).distinct()), "b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    keyed = coded.select(F.xxhash64("form").alias("a"), "word", "n")
    others = keyed.select(F.col("a").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = met.join(apart(keyed), "a").join(apart(others), "b").where("a <> b or word < other")
    return pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for (word, form) links without cycles: the end of the chain of forms, by pointer jumping.

    Every round doubles the length of chain that is followed; chains are as long as a logarithm of the largest count.
    """
    now = stored(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.select("word", "root").join(apart(ahead), "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, every: int = 31,
                      symbols: int = SYMBOLS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of at least ``min_length`` letters and ``min_count`` uses.

    ``form`` is the most used word one edit away (ties: the smallest in code-point order) if it is used at least ``ratio``
    times as often, else null; ``root`` follows forms to the last one, a word without form is its own root. Null texts have no words,
    repeated rows and repeated ids count again, a null id damages runs as an empty one would; other columns are ignored.
    """
    words = stored(word_counts(docs.select("doc_id", "text"), min_length, min_count, every))
    pairs = near_words(words, symbols)
    ends = F.explode(F.array(
        F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("e")
    best = pairs.select(ends).select("e.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    known = words.join(apart(best), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.minus") >= F.col("n") * ratio, F.col("best")).alias("best"))
    known = stored(known.select("word", F.col("best.near").alias("form"), "n", "n_near", (-F.col("best.minus")).alias("form_n")))
    found = known.join(apart(roots(known.where("form is not null"))), "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
