"""Benchmark decontamination by template windows, in DataFrame functions alone.

Text is canonicalised to a template: numbers, units after numbers, and names (capitalised words, wherever they stand) become
typed placeholders; other words are lower-cased and stripped of all but letters and digits, so that punctuation glued to
words does not matter. Half a `window` of placeholders or more in a row, such as figures of a table, are read twice: as their values, so that any
part of a list is found, and as placeholders that tell their place and the row's length, so that a row of as many other values is found too.
A third template has names as plain words, for texts in other case. Beside the templates stands the
sequence of values, word for word. Words that repeat with a period of at most four are cut to REPEATS periods in items, and in documents if any item is cut, so
that longer repetitions count as that long. Runs of half a `window` of template words of the benchmark are hashed and joined to those
of all documents; two runs that match at one offset and span `window` words are a matched window.

Matches of a document's text and an item are taken together by offset, and in overlapping bands of offsets, so that inserted
and deleted words lose only what they touch. There, each value of the item's slots must stand against one value of the
document; several may stand against the same. Windows whose slots contradict each other do not count. A document is reported
for an item if matched windows are at least `coverage` of the item's windows, or if no number or unit is contradicted and
matched runs hold at least `word_coverage` of the item's words and `window` words: as a copy ("exact", if each of the item's slots is matched
with its own value) or re-parameterised ("reparameterised"). An item shorter than `window` is one window, of all its words; items shorter than
half a window are matched by runs of their own lengths. An item of placeholders alone is met with other values only by a text of just as many,
and with its values anywhere.

Plan: documents are scanned once, their runs exploded and probed against the benchmark's inside one stage if those are at
most BROADCAST_ROWS rows (counted first); otherwise runs of a few words each are joined by shuffle. Only matches are shuffled
further, each with the slots of its run; groups are as large as a band of one text against one item.

Nulls and ties: null or empty texts have no windows and match nothing. Rows of one id are
reported together, but different texts of theirs are matched apart; items or documents with a null id take part under the null id. Repeated items match alike. Very long
texts give a narrow row for each match. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotolake.llm.common import col, without_keys

#: Placeholders, of the private use area: name, number, unit. Such characters of a text itself are dropped.
NAME, NUMBER, UNIT = "", "", ""
SLOT = NAME + NUMBER + UNIT
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|mile|miles|ft|feet|inch|inches|in|yd|l|ml|litre|litres|liter|liters|h|hr|hrs|hour|hours|min|mins|minute|minutes|s|sec|secs|second|seconds|ms|day|days|week|weeks|month|months|year|years|mph|kmh|kph|w|kw|v|a|hz|khz|mhz|ghz|kb|mb|gb|tb|j|kj|cal|kcal|n|pa|kpa|usd|eur|gbp|dollar|dollars|euro|euros|cent|cents|percent|degrees"
#: Periods that are left of words that repeat.
REPEATS = 16
REPETITION = rf"(?<!\S)((?:\S++\s++){{1,4}}?)\1{{{REPEATS - 1},}}+"
#: At most so many benchmark windows, of about 200 bytes, are broadcast.
BROADCAST_ROWS = 500_000


def template(text: Column, cut: bool = True) -> tuple[Column, Column]:
    """(template words, values) of a text, each joined by single spaces and equally many; `cut`: repetitions are cut to REPEATS periods."""
    clean = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT, "")
    clean = F.regexp_replace(clean, REPETITION, "$1" * REPEATS) if cut else clean
    # Each pattern starts with what is rare, and looks behind only from there.
    typed = F.regexp_replace(clean, r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}+", NAME)
    typed = F.regexp_replace(typed, r"[0-9](?<![\p{L}\p{N}][0-9])[0-9]*(?:[.,:/][0-9]+)*", NUMBER)
    typed = F.regexp_replace(typed, rf"{NUMBER}([^\p{{L}}\p{{N}}\s]{{0,4}}\s?)(?:{UNITS})(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1{UNIT}")
    words = lambda c, keep: F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{keep}\s]+", "")), r"\s+", " "))
    return words(typed, SLOT), words(clean, "")


def _bound(df: DataFrame, name: str, *fields: Column) -> DataFrame:
    """`df` with a struct of those columns, computed once: an exploded array of one, which keeps filters above it."""
    return df.select("*", F.explode(F.array(F.struct(*fields))).alias(name))


def _stretches(seed: int) -> Column:
    """`typed` with the values in place of `seed` or more placeholders in a row, or of all in a text of fewer words."""
    bare = lambda i: F.coalesce(F.length(F.translate(F.get("typed", i), SLOT, "")) == 0, F.lit(False))
    within = lambda i: functools.reduce(Column.__or__, (functools.reduce(Column.__and__, (bare(i + (k - back)) for k in range(seed))) for back in range(seed)))
    short = (F.size("typed") < seed) & F.forall("typed", lambda t: F.length(F.translate(t, SLOT, "")) == 0)
    return F.transform("typed", lambda t, i: F.when(short | within(i), F.get("values", i)).otherwise(t))


def _placed(seed: int) -> Column:
    """The words of the text `typed`, those in rows of `seed` or more placeholders with their place and the row's length."""
    rows = F.regexp_extract_all("typed", F.lit(rf"[{SLOT}][{SLOT} ]*(?![^ ])|[^ ]+"), 0)

    def told(row: Column) -> Column:
        words = F.split(row, " ")
        n = F.size(words)
        return F.when((n >= seed) & (F.length(F.translate(row, SLOT + " ", "")) == 0), F.transform(words, lambda t, i: F.concat(t, i.cast("string"), F.lit("/"), n.cast("string")))).otherwise(words)

    return F.flatten(F.transform(rows, told))


def windows(df: DataFrame, id_col: str, text_col: str, seed: int, slots: bool = False, cut: bool = True) -> DataFrame:
    """(id, text_hash, words, typed, plain, placed, values, at, h): a row for each run of `seed` template words, in each template it differs in.

    A text of fewer words is one run. `plain` is the template with names as lower-case words, `placed` that of rows (null without any);
    with `slots`, the places of placeholders, null if there is nothing else.
    """
    src = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    typed, values = template(F.col("text"), cut)
    src = _bound(src, "s", F.xxhash64("text").alias("text_hash"), typed.alias("typed"), values.alias("values")).select("id", "s.*").where("typed <> ''")
    row = F.col("typed").rlike(rf"[{SLOT}](?: [{SLOT}]+){{{seed - 1}}}") | (F.length("typed") < 40)
    placed = F.when(row & (F.col("typed").contains(" ")), _placed(seed))
    src = _bound(src, "s", F.split("typed", " ").alias("typed"), F.split("values", " ").alias("values"), row.alias("row"), placed.alias("placed")).select("id", "text_hash", "s.*")
    kept = ["id", "text_hash", "values", "placed"]
    if slots:
        at = F.filter(F.transform("typed", lambda t, i: F.when(t.rlike(f"[{SLOT}]"), i)), lambda i: i.isNotNull())
        src, kept = src.withColumn("slots", F.when(F.exists("typed", lambda t: F.length(F.translate(t, SLOT, "")) > 0), at)), [*kept, "slots"]
    src = _bound(src, "s", F.when(F.col("row"), _stretches(seed)).otherwise(F.col("typed")).alias("typed")).select(*kept, "s.*")
    plain = F.zip_with("typed", "values", lambda t, v: F.when(t.contains(NAME), v).otherwise(t))
    src = _bound(src.withColumn("words", F.size("typed")), "s", plain.alias("plain")).select("*", "s.plain").drop("s")
    out = src.select("*", F.posexplode("typed").alias("at", "word")).where(F.col("at") <= F.greatest(F.col("words") - seed, F.lit(0))).drop("word")
    typed, plain, placed = (F.xxhash64(*(F.get(c, F.col("at") + i) for i in range(seed))) for c in ("typed", "plain", "placed"))
    two = F.when(typed == plain, F.array(typed)).otherwise(F.array(typed, plain))
    return out.select("*", F.explode(F.when(F.col("placed").isNull(), two).otherwise(F.array_distinct(F.array(typed, plain, placed)))).alias("h"))


def _runs(df: DataFrame, seed: int) -> DataFrame:
    """Rows of `windows` with their own run (words of the templates, values) in place of the whole text's words."""
    cut = lambda c: F.slice(c, F.col("at") + 1, seed)
    # Bound, so that none of it is computed before the rows are there, such as those of a join.
    found = _bound(df, "s", cut("typed").alias("typed_run"), cut("plain").alias("plain_run"), cut("placed").alias("placed_run"), cut("values").alias("value_run"))
    return found.select("*", "s.*").drop("s", "typed", "plain", "placed", "values")


def _contradicted(runs: Column, kinds: str) -> Column:
    """The item values of those kinds of slots that stand against several document values: by a sort of the distinct pairs."""
    slots = F.filter(F.flatten(F.transform(runs, lambda r: r["slots"])), lambda x: x["t"].rlike(f"[{kinds}]"))
    pairs = F.array_distinct(F.transform(slots, lambda x: F.concat_ws(" ", x["a"], x["b"])))
    ordered = F.array_sort(F.transform(pairs, lambda x: F.substring_index(x, " ", 1)))
    return F.array_distinct(F.array_compact(F.zip_with(ordered, F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1))), lambda x, y: F.when(x == y, x))))


def _without(runs: Column, values: Column) -> Column:
    """The runs without slots of those item values; an unchanged name contradicts nothing."""
    kept = F.filter(runs, lambda r: ~F.exists(r["slots"], lambda x: F.array_contains(values, x["a"]) & ~(x["t"].contains(NAME) & (x["a"] == x["b"]))))
    return F.when(F.size(values) == 0, runs).otherwise(kept)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, coverage: float = 0.3, word_coverage: float = 0.6) -> DataFrame:
    """(id_col, item_col, n_windows, n_matched, coverage, word_coverage, kind): the best match of each document and item."""
    seed = (window + 1) // 2
    sizes = windows(benchmark, item_col, item_text_col, seed).where("at = 0").select(F.least("words", F.lit(seed)).alias("n")).distinct()
    # Only items that repeat so long need documents cut like them: against others, a repetition matches wherever it is as long as the item's.
    cut = not benchmark.where(F.coalesce(col(item_text_col).cast("string"), F.lit("")).rlike(REPETITION)).isEmpty()
    found = None
    # Items of half a window and more, and those of each shorter length that there is.
    for n in sorted((r["n"] for r in sizes.collect()), reverse=True):
        part = _matched(docs, benchmark, id_col, text_col, item_col, item_text_col, window if n == seed else n, n, n == seed, cut, coverage, word_coverage)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = _matched(docs, benchmark, id_col, text_col, item_col, item_text_col, window, seed, True, cut, coverage, word_coverage)
    best = found.groupBy("id", "item", "n_windows").agg(F.max(F.struct("n_matched", "exact", (F.col("n_words") / F.col("item_words")).alias("words"))).alias("best"))
    kind = F.when(F.col("best.exact"), "exact").otherwise("reparameterised")
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("n_windows").cast("long").alias("n_windows"), F.col("best.n_matched").cast("long").alias("n_matched"), F.round(F.col("best.n_matched") / F.col("n_windows"), 6).alias("coverage"), F.round("best.words", 6).alias("word_coverage"), kind.alias("kind"))


def _matched(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, seed: int, longer: bool, cut: bool, coverage: float, word_coverage: float) -> DataFrame:
    """Matches (id, text_hash, item, item_hash, item_words, n_windows, n_matched, n_words, exact) of items of `seed` words, or, `longer`, of more too."""
    # A row of each template; where they have the same words, one stays.
    items = _runs(windows(benchmark, item_col, item_text_col, seed, slots=True).where(F.col("words") >= seed if longer else F.col("words") == seed).drop("h"), seed)
    items = items.select("*", F.explode(F.array_compact(F.array("typed_run", "plain_run", "placed_run"))).alias("item_run"))
    items = items.select(F.col("id").alias("item"), F.col("text_hash").alias("item_hash"), F.col("words").alias("item_words"), F.col("slots").alias("item_slots"), F.col("at").alias("item_at"), "item_run", F.col("value_run").alias("item_values"), F.xxhash64(*(F.get("item_run", F.lit(i)) for i in range(seed))).alias("h")).distinct()
    found = windows(docs, id_col, text_col, seed, cut=cut)
    if items.count() <= BROADCAST_ROWS:
        found = _runs(found.join(F.broadcast(items), "h"), seed)
    else:
        found = _runs(found, seed).join(items, "h")
    # The words are compared too, so a hash is never trusted alone. Placeholders alone stand for texts of just as many.
    same = (F.col("typed_run") == F.col("item_run")) | (F.col("plain_run") == F.col("item_run")) | F.coalesce(F.col("placed_run") == F.col("item_run"), F.lit(False))
    alone = F.col("item_slots").isNull() & F.get("item_run", F.lit(0)).rlike(f"[{SLOT}]")
    found = found.where(same & (~alone | (F.col("words") == F.col("item_words"))))
    pairs = F.arrays_zip(F.col("item_run").alias("t"), F.col("item_values").alias("a"), F.col("value_run").alias("b"))
    slots = F.filter(pairs, lambda x: x["t"].rlike(f"[{SLOT}]"))
    key = ["id", "text_hash", "item", "item_hash", "item_words", "item_slots"]
    found = found.select(*key, (F.col("at") - F.col("item_at")).alias("offset"), "item_at", slots.alias("slots")).select(*key, "offset", F.struct("item_at", "slots").alias("run"))
    # Runs at one offset, at most two for each place of the item: whole windows are those whose two ends match there.
    size, short = F.least(F.lit(window), F.col("item_words")), F.least(F.lit(seed), F.col("item_words"))
    by = found.groupBy(*key, "offset").agg(F.collect_set("run").alias("runs"))
    ends = lambda r: F.filter("runs", lambda q: q["item_at"] == r["item_at"] + (size - short))
    whole = F.flatten(F.transform("runs", lambda r: F.transform(ends(r), lambda q: F.named_struct(F.lit("item_at"), r["item_at"], F.lit("slots"), F.concat(r["slots"], q["slots"])))))
    placed = F.transform("runs", lambda r: F.named_struct(F.lit("item_at"), r["item_at"], F.lit("at"), r["item_at"] + F.col("offset"), F.lit("slots"), r["slots"]))
    # They are taken alone, and with those of two bands of offsets, each twice as wide as the item.
    band = F.floor(F.col("offset") / F.col("item_words")).cast("int")
    place = lambda wide, at: F.struct(F.lit(wide).alias("wide"), at.alias("at"))
    by = by.select(*key, placed.alias("runs"), whole.alias("whole"), F.explode(F.array(place(0, F.col("offset")), place(1, band), place(1, band - 1))).alias("place"))
    by = by.groupBy(*key, "place").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("whole")).alias("whole"))
    # Windows with a contradicted slot do not count.
    by = by.where(F.size("runs") * short >= size)
    by = _bound(by, "bad", _contradicted(F.col("whole"), SLOT).alias("whole"), _contradicted(F.col("runs"), NAME).alias("names"), F.size(_contradicted(F.col("runs"), NUMBER + UNIT)).alias("numbers"))
    by = _bound(by, "good", _without(F.col("whole"), F.col("bad.whole")).alias("whole"), _without(F.col("runs"), F.col("bad.names")).alias("runs"))
    words = lambda at: F.size(F.array_distinct(F.flatten(F.transform("good.runs", lambda r: F.sequence(r[at], r[at] + (short - 1))))))
    matched = F.size(F.array_distinct(F.transform("good.whole", lambda r: r["item_at"])))
    by = by.withColumn("n_windows", F.col("item_words") - size + 1).withColumn("n_matched", matched).withColumn("n_words", F.least(words("item_at"), words("at")))
    by_windows = (F.col("n_matched") > 0) & (F.col("n_matched") >= F.lit(coverage) * F.col("n_windows"))
    by_words = (F.col("bad.numbers") == 0) & (F.col("n_words") >= F.greatest(size.cast("double"), F.lit(word_coverage) * F.col("item_words")))
    # A copy has all of the item's slots, with their own values.
    covered = lambda runs, n: F.flatten(F.transform(runs, lambda r: F.sequence(r["item_at"], r["item_at"] + (n - 1))))
    exact = lambda runs, n: ~F.exists(runs, lambda r: F.exists(r["slots"], lambda x: x["a"] != x["b"])) & (F.size(F.array_except(F.coalesce("item_slots", F.array().cast("array<int>")), covered(runs, n))) == 0)
    return by.where(by_windows | by_words).withColumn("exact", F.when(by_windows, exact("good.whole", size)).otherwise(exact("good.runs", short)))


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """`docs` less the rows whose text is reported for any item.

    Texts are told apart by their MD5, so ids may be null or repeat: a row goes if and only if its own text is reported.
    """
    key = F.unhex(F.md5(col(text_col).cast("string").cast("binary")))
    leaks = contaminated(docs.select(key.alias("key"), col(text_col).alias("text")).where("key is not null"), benchmark, id_col="key", text_col="text", **how)
    return without_keys(docs, leaks.select("key"), key)
