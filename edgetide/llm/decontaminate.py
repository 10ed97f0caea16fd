"""Benchmark decontamination by template windows, with DataFrame functions only.

Numbers, units and names become typed placeholders, so a question whose values were changed keeps its template. Windows
of eight template tokens are hashed and joined with the windows of the benchmark items. Matching windows on one
alignment of document and item are put together, compared token by token, and their slots must be consistent:
equal values of the item have to stand for equal values of the document.

``leaks`` follows that rule alone. ``held_items`` also finds copies by their words as they are, items of any length and
items with replaced words: its seeds are windows of templates and of words, as long as the item allows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import fresh, small, whole_text
from edgetide.session import stored

WINDOW = 8
LITERALS = 4  # tokens of a window that must not be placeholders
MATCHED = 12  # tokens of an item, or all of a shorter one, that a document must hold
SHORTEST = 4  # items with fewer tokens can't be told from ordinary prose and never match
NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
SPACE = r"[ \t\n\x0B\f\r\x01-\x03]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
UNSPACED = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])"  # scripts without blanks

# Units, as they stand after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs oz pound "
    "pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour "
    "hours day days week weeks month months year years mph kmh c f degree degrees percent dollar dollars cent cents euro euros"
).split()


def raw_tokens(text: Column) -> Column:
    return F.split(F.regexp_replace(text, SPACE, " "), " ")


def template_tokens(text: Column) -> Column:
    """One token per raw token: a placeholder, or the token in lower case without punctuation (maybe empty).

    A number starts with a digit; a unit is one of ``UNITS`` right after a number; a name starts with a
    capital, has a small letter too (text in capitals has no names) and does not begin a sentence.
    """
    words = F.regexp_replace(text, SPACE, " ")
    names = F.regexp_replace(words, rf"(?<=[^.!?: ] ){PUNCTUATION}*+\p{{Lu}}(?=[^ ]*\p{{Ll}})[^ ]*", NAME)
    numbers = F.regexp_replace(names, rf"(?<![^ ]){PUNCTUATION}*+[0-9][^ ]*", NUMBER)
    plain = F.lower(F.regexp_replace(numbers, rf"{PUNCTUATION}+", ""))
    units = F.regexp_replace(plain, rf"(?<={NUMBER} )(?:{'|'.join(UNITS)})(?![^ ])", UNIT)
    return F.split(units, " ")


def _tokens(rows: DataFrame, text: str, template: str) -> DataFrame:
    """Adds ``template``: the tokens that are not empty."""
    return rows.withColumn(template, F.filter(template_tokens(F.col(text)), lambda t: t != ""))


def _window_hashes(tokens: str, length: int) -> Column:
    """Hash of each run of ``length`` tokens, in order."""
    starts = F.when(F.size(tokens) >= length, F.sequence(F.lit(1), F.size(tokens) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(tokens), i, length)))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, tokens, values): template and raw tokens of each distinct item; ``item`` names id and text."""
    named = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    tokens = named.select(
        F.xxhash64("item_id", "text").alias("item"), "item_id",
        F.filter(F.arrays_zip(template_tokens(F.col("text")).alias("t"), raw_tokens(F.col("text")).alias("r")), lambda x: x["t"] != "").alias("z"))
    return tokens.select("item", "item_id", F.col("z.t").alias("tokens"), F.col("z.r").alias("values")).where(F.size("tokens") >= SHORTEST)


def item_windows(items: DataFrame) -> DataFrame:
    """(hash, length, at: array of item and position): the items' windows; a short item is one window."""
    length = F.least(F.size("tokens"), F.lit(WINDOW))
    each = items.select("item", "tokens", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("tokens") - length + 1)).alias("place"))
    window = each.withColumn("window", F.slice("tokens", F.col("place"), F.col("length")))
    marks = F.size(F.filter("window", lambda t: t.isin(NAME, NUMBER, UNIT)))
    literal = window.where(F.size("window") - marks >= LITERALS)
    return literal.groupBy(F.xxhash64("window").alias("hash"), "length").agg(F.collect_set(F.struct("item", "place")).alias("at"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n_matched, n_tokens, changed): items that documents hold, whole or in large part.

    ``n_matched`` of the item's ``n_tokens`` tokens are in the document on consistent alignments; ``changed``
    says that some value differs. Documents without text match nothing; a repeated row is reported once, as is a repeated
    item. An empty benchmark gives no rows.
    """
    items = stored(items_of(benchmark))
    windows = stored(item_windows(items))
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most WINDOW numbers
    texts = docs.select("doc_id", whole_text("text").alias("text"))
    tokenised = _tokens(texts, "text", "tokens").select("doc_id", F.xxhash64("text").alias("text_hash"), "tokens")
    hashed = tokenised.select("doc_id", "text_hash", *[_window_hashes("tokens", n).alias(f"h{n}") for n in lengths])
    wanted = small(windows)
    schema = "doc_id long, text_hash long, place int, item long, item_place int"
    found = docs.sparkSession.createDataFrame([], schema)
    for n in lengths:
        # not posexplode: the filter for empty arrays that is inferred from it would compute all hashes a second time,
        # with the tokens spelled out anew for every window
        placed = hashed.select("doc_id", "text_hash", F.posexplode_outer(f"h{n}").alias("place", "hash"))
        hits = placed.join(wanted.where(F.col("length") == n), "hash").select("doc_id", "text_hash", "place", F.explode("at").alias("a"))
        found = found.unionByName(hits.select("doc_id", "text_hash", (F.col("place") + 1).alias("place"), F.col("a.item").alias("item"), F.col("a.place").alias("item_place")))
    aligned = stored(
        found.groupBy("doc_id", "text_hash", "item", (F.col("place") - F.col("item_place")).alias("shift"))
        .agg(F.sort_array(F.collect_set("item_place")).alias("places")))
    # raw and template tokens of the few documents with a hit
    keys = small(aligned.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct())
    with_hash = texts.withColumn("text_hash", F.xxhash64("text"))
    same = with_hash["doc_id"].eqNullSafe(keys["hit_id"]) & (with_hash["text_hash"] == keys["hit_hash"])
    hit_texts = stored(with_hash.join(keys, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(
        F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"),
        F.filter(F.arrays_zip(template_tokens(F.col("text")).alias("t"), raw_tokens(F.col("text")).alias("r")), lambda x: x["t"] != "").alias("z"),
    ))
    joined = aligned.join(
        hit_texts, aligned["doc_id"].eqNullSafe(hit_texts["hit_id"]) & (aligned["text_hash"] == hit_texts["hit_hash"])
    ).join(items, "item")
    first, last = F.col("places")[0], F.element_at("places", -1)
    size = F.least(F.size("tokens"), F.lit(WINDOW))
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1))))
    cut = joined.withColumn("size", size).withColumn("part", F.slice("z", F.col("shift") + first, last - first + F.col("size"))).select(
        "doc_id", "text_hash", "item", "item_id", F.size("tokens").alias("n_tokens"), "tokens", "values", "part", first.alias("first"), covered.alias("covered"))
    # of each covered place: template and value in item and document; a place with another template is a hash collision
    pair = F.transform("covered", lambda p: F.struct(
        p.alias("p"), F.get("tokens", p - 1).alias("t"), F.get("values", p - 1).alias("v"),
        F.get("part", p - F.col("first"))["t"].alias("dt"), F.get("part", p - F.col("first"))["r"].alias("dv")))
    plain = lambda c: F.lower(F.regexp_replace(c, rf"{PUNCTUATION}+", ""))
    true = F.filter(pair, lambda x: x["t"] == x["dt"])
    slots = F.array_distinct(F.transform(
        F.filter("true", lambda x: x["t"].isin(NAME, NUMBER, UNIT)),
        lambda x: F.struct(x["t"].alias("t"), plain(x["v"]).alias("v"), plain(x["dv"]).alias("dv"))))
    slotted = cut.withColumn("true", true).withColumn("slots", slots)
    named = F.array_distinct(F.transform("slots", lambda x: F.struct(x["t"], x["v"])))
    consistent = slotted.where(F.size("slots") == F.size(named))
    changed = F.exists("slots", lambda x: x["v"] != x["dv"])
    whole = consistent.groupBy("doc_id", "text_hash", "item", "item_id", "n_tokens").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list(F.col("true.p"))))).alias("n_matched"), F.max(changed).alias("changed"))
    kept = whole.where(F.col("n_matched") >= F.least(F.lit(MATCHED), F.col("n_tokens")))
    return kept.select("doc_id", "text_hash", "item_id", "n_matched", "n_tokens", "changed")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it holds."""
    return contaminated(docs, benchmark).select("doc_id", "item_id", "n_matched", "n_tokens", "changed")


def _spelled(text: Column) -> Column:
    """The text with every character of a script without blanks as a token of its own."""
    return F.when(text.rlike(UNSPACED), F.regexp_replace(text, UNSPACED, " $1 ")).otherwise(text)


def _words(text: Column) -> Column:
    """Tokens in lower case without punctuation: a word is empty where its template token is."""
    return F.split(F.lower(F.regexp_replace(F.regexp_replace(text, SPACE, " "), rf"{PUNCTUATION}+", "")), " ")


def _run_hashes(rows: DataFrame, tokens: list[str], lengths: list[int]) -> tuple[DataFrame, dict[tuple[str, int], str]]:
    """Adds an array of hashes of the runs of each length from each token on, and names it. Runs past the end hold no sense.

    A run is hashed from the hashes of two shorter runs that cover it, each a column of its own, so none is computed twice.
    """
    names = {}

    def add(rows: DataFrame, column: str, length: int) -> DataFrame:
        if (column, length) in names:
            return rows
        name = names[column, length] = f"{column}_{length}"
        if length == 1:
            return rows.withColumn(name, F.transform(column, lambda t: F.xxhash64(t)))
        half = 1 << ((length - 1).bit_length() - 1)
        part = f"{column}_{half}"
        rest = F.slice(part, length - half + 1, F.size(column))
        return add(rows, column, half).withColumn(name, F.zip_with(part, rest, lambda a, b: F.xxhash64(F.lit(length), a, b)))

    for column in tokens:
        for length in lengths:
            rows = add(rows, column, length)
    return rows, {k: v for k, v in names.items() if k[1] in lengths}


def whole_items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, tokens, words, capital, n, need, run, seed): each distinct item with a token, and what it asks for.

    ``need`` tokens must be found: all of an item under eight tokens, else three quarters, at most ``MATCHED``. Only
    runs of ``run`` equal tokens count, which leaves enough of them whichever word is replaced. ``seed`` is the length of the windows:
    half the item or less, so one side of a replaced word holds one. ``capital`` says that the first token may be a name.
    """
    named = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    text = _spelled(F.col("text"))
    split = named.select(F.xxhash64("item_id", "text").alias("item"), "item_id", F.filter(
        F.arrays_zip(template_tokens(text).alias("t"), _words(text).alias("w"), raw_tokens(text).alias("r")), lambda x: x["t"] != "").alias("z"))
    n = F.col("n")
    need = F.when(n < WINDOW, n).otherwise(F.least(F.lit(MATCHED), F.ceil(n * 0.75).cast("int")))
    return (
        split.select("item", "item_id", F.col("z.t").alias("tokens"), F.col("z.w").alias("words"), F.size("z").alias("n"),
                     F.get("z", F.lit(0))["r"].rlike(rf"^{PUNCTUATION}*\p{{Lu}}(?=[^ ]*\p{{Ll}})").alias("capital"))
        .where("n > 0").withColumn("need", need).withColumn("run", F.greatest(F.lit(1), F.least(F.lit(WINDOW), n - F.col("need"))))
        .withColumn("seed", F.when(n < WINDOW, n).when(n < 2 * WINDOW, WINDOW // 2).otherwise(WINDOW)))


def _literals(tokens: Column | str) -> Column:
    return F.size(F.filter(tokens, lambda t: ~t.isin(NAME, NUMBER, UNIT)))


def seeds_of(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(hash, at: array of item, its length and place): windows of words, and of templates that hold enough literals.

    The first token of an item can follow anything in a document, so where it may be a name it is also taken as one.
    """
    as_name = F.concat(F.array(F.lit(NAME)), F.slice("tokens", 2, F.size("tokens")))
    form = lambda exact, tokens: F.struct(F.lit(exact).alias("exact"), tokens.alias("form"))
    forms = F.array(form(True, F.col("words")), form(False, F.col("tokens")), form(False, F.when(F.col("capital"), as_name).otherwise(F.col("tokens"))))
    each, names = _run_hashes(items.select("item", "n", "seed", F.explode(forms).alias("f")).select("item", "n", "seed", "f.*"), ["form"], lengths)
    # items under WINDOW tokens are one window, which asks for LITERALS; of longer ones, half the window, as everywhere
    least = F.when(F.col("n") < WINDOW, LITERALS).otherwise(F.col("seed") * LITERALS / WINDOW)
    found = None
    for length in lengths:
        placed = each.where(F.col("seed") == length).select("item", "n", "exact", "form", "seed", F.posexplode(names["form", length]).alias("place", "hash"))
        window = F.slice("form", F.col("place") + 1, length)
        kept = placed.where((F.col("place") <= F.col("n") - length) & (F.col("exact") | (_literals(window) >= least)))
        rows = kept.select("hash", F.struct("item", "n", (F.col("place") + 1).alias("place")).alias("at"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("hash").agg(F.collect_set("at").alias("at"))


def _covered(equal: str, literal: Column | None) -> Column:
    """Places in runs of ``run`` equal tokens, where asked half of them literals."""
    def whole(s: Column) -> Column:
        every = F.forall(F.slice(equal, s, F.col("run")), lambda e: e)
        if literal is None:
            return every
        return every & (F.size(F.filter(F.slice(literal, s, F.col("run")), lambda x: x)) * WINDOW >= F.col("run") * LITERALS)

    starts = F.filter(F.sequence(F.lit(1), F.col("n") - F.col("run") + 1), whole)
    return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + F.col("run") - 1))))


def held(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n_matched, n_tokens, changed): as ``contaminated``, for items of every length and kind.

    Copies in the item's own words count whatever their tokens are; copies with other values as far as the slots are
    consistent. Alignments of an item under sixteen tokens are only put together when they are less than its length apart.
    """
    items = stored(whole_items(benchmark))
    lengths = sorted(r["seed"] for r in items.select("seed").distinct().collect())  # at most WINDOW numbers
    schema = "doc_id long, text_hash long, item_id long, n_matched int, n_tokens int, changed boolean"
    if not lengths:
        return docs.sparkSession.createDataFrame([], schema)
    texts = docs.select("doc_id", whole_text("text").alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), _spelled(F.col("text")).alias("text"))
    parts = {"tokens": template_tokens(F.col("text")), "words": _words(F.col("text"))}
    split = texts.select("doc_id", "text_hash", *[F.filter(c, lambda t: t != "").alias(name) for name, c in parts.items()])
    hashed, names = _run_hashes(split, list(parts), lengths)
    # all arrays are as long as the document, so the place in it is a remainder; not posexplode, see contaminated()
    placed = hashed.select("doc_id", "text_hash", F.size("tokens").alias("size"), F.posexplode_outer(F.concat(*names.values())).alias("place", "hash"))
    hits = placed.join(small(stored(seeds_of(items, lengths))), "hash").select(
        "doc_id", "text_hash", (F.col("place") % F.col("size")).alias("place"), F.explode("at").alias("a"))
    aligned = stored(
        hits.select("doc_id", "text_hash", F.struct(F.col("a.item").alias("item"), F.col("a.n").alias("n"), (F.col("place") - F.col("a.place") + 1).alias("shift")).alias("a"))
        .groupBy("doc_id", "text_hash").agg(F.collect_set("a").alias("alignments")))
    # the item's stretch of the few documents with a hit, cut from the text once for all alignments
    keys = small(aligned.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")))
    same = texts["doc_id"].eqNullSafe(keys["hit_id"]) & (texts["text_hash"] == keys["hit_hash"])
    hit_texts = texts.join(keys, same, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(
        F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"),
        F.filter(F.arrays_zip(parts["tokens"].alias("t"), parts["words"].alias("w")), lambda x: x["t"] != "").alias("z"))
    stretch = F.transform("alignments", lambda a: F.struct(
        a["item"].alias("item"), a["shift"].alias("shift"),
        F.transform(F.sequence(F.lit(0), a["n"] - 1), lambda p: F.get("z", a["shift"] + p)).alias("part")))
    hit_texts = stored(hit_texts)
    cut = aligned.join(hit_texts, aligned["doc_id"].eqNullSafe(hit_texts["hit_id"]) & (aligned["text_hash"] == hit_texts["hit_hash"])).select(
        "doc_id", "text_hash", F.explode(stretch).alias("a")).select("doc_id", "text_hash", "a.*")
    mark = lambda t: t.isin(NAME, NUMBER, UNIT)
    pair = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda p: F.struct(
        p.alias("p"), F.get("tokens", p).alias("t"), F.get("words", p).alias("w"), F.get("part", p)["t"].alias("dt"), F.get("part", p)["w"].alias("dw")))
    row = cut.join(items, "item").withColumn("pair", pair)
    row = row.withColumn("same", F.transform("pair", lambda x: F.coalesce(x["w"] == x["dw"], F.lit(False))))
    row = row.withColumn("alike", F.transform("pair", lambda x: F.coalesce(
        (x["w"] == x["dw"]) | (x["t"] == x["dt"]) | ((x["p"] == 0) & F.col("capital") & (x["dt"] == NAME)), F.lit(False))))
    # stored, as the optimizer would put each array's expression into the lambdas that read it, once for every element
    row = stored(row.withColumn("literal", F.transform("pair", lambda x: F.coalesce(~mark(x["t"]) & (x["w"] == x["dw"]), F.lit(False)))))
    row = stored(row.withColumn("verbatim", _covered("same", None)).withColumn("filled", _covered("alike", F.col("literal"))))
    row = row.drop("part", "tokens", "words").withColumn("slots", F.array_distinct(F.transform(
        F.filter("pair", lambda x: F.array_contains("filled", x["p"] + 1) & (mark(x["t"]) | mark(x["dt"]))),
        lambda x: F.struct(F.when(mark(x["t"]), x["t"]).otherwise(x["dt"]).alias("t"), x["w"].alias("w"), x["dw"].alias("dw")))))
    fits = (F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: F.struct(x["t"], x["w"]))))) & (
        F.size(F.filter("filled", lambda p: F.get("literal", p - 1))) >= LITERALS)
    row = row.withColumn("fits", fits).withColumn("places", F.when(F.col("fits"), F.array_union("verbatim", "filled")).otherwise(F.col("verbatim")))
    row = row.withColumn("changed", F.col("fits") & F.exists("slots", lambda x: x["w"] != x["dw"]))
    near = F.when(F.col("n") >= 2 * WINDOW, F.array(F.lit(0).cast("bigint"))).otherwise(F.array(
        2 * F.floor(F.col("shift") / F.col("n")), 2 * F.floor((F.col("shift") + F.col("n") / 2) / F.col("n")) + 1))
    whole = row.withColumn("near", F.explode(near)).groupBy("doc_id", "text_hash", "item", "item_id", "n", "need", "near").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_matched"), F.max("changed").alias("changed"))
    kept = whole.where("n_matched >= need").groupBy("doc_id", "text_hash", "item", "item_id", F.col("n").alias("n_tokens"))
    best = kept.agg(F.max(F.struct("n_matched", F.col("changed"))).alias("b"))
    return best.select("doc_id", "text_hash", "item_id", "b.n_matched", "n_tokens", "b.changed")


def held_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it holds, of any length, in its words or with other values."""
    return held(docs, benchmark).select("doc_id", "item_id", "n_matched", "n_tokens", "changed")


def clean_documents(docs: DataFrame, benchmark: DataFrame, find: Callable[[DataFrame, DataFrame], DataFrame] = contaminated) -> DataFrame:
    """The documents in which ``find`` (``contaminated`` or ``held``) sees no benchmark item, with all their columns."""
    hits = stored(find(docs, benchmark).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct())
    h = fresh(docs.columns, "text_hash")
    rows = docs.withColumn(h, F.xxhash64(whole_text("text")))
    keys = small(hits)
    same = rows["doc_id"].eqNullSafe(keys["hit_id"]) & (rows[h] == keys["hit_hash"])
    return rows.join(keys, same, "left_anti").select(*docs.columns)
