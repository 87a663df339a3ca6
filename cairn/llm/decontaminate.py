"""Operator 4: benchmark decontamination by template canonicalisation, with DataFrame operations alone.

Texts become words without punctuation, in lower case. Numbers (digits, or English number words from two on), units after
numbers, and names (capitalised words of any script that follow a lower-case letter or a comma) are slots: a marker character
for the type, then the value. Other capitalised words, such as open a sentence, have a marker of their own and are names in
the wide form of a template alone. A window is ``width`` successive words of a benchmark item; its template has the markers
alone, its plain form the values. All are hashed, and documents' windows meet them in a hash join on form and hash. Only
windows around anchors are hashed: documents are exploded to words once and joined with one word of each benchmark window
(its longest word, of a template its longest that is no slot), which says where windows begin there, if the window's next
longest word is in its place too.

Hits of one alignment (a document, an item, the distance of their places) are checked for slot consistency: equal slots of
the item have equal values in the document, and different names and units different ones; different numbers may become equal
ones, as a new question may well give two things one number. A document is contaminated by an item
if the windows of consistent alignments cover ``coverage`` of the item's templates, or of its wide ones, or those met in plain form as much of all
its windows, or ``run`` of them are met in plain form.

Rows: null and empty texts match nothing. An item shorter than ``width`` is one window. A window has a template if it has
``least`` words that are no slots, and a wide template goes on beyond ``width`` until it has them; any window is met in plain form, so that an item of one word is in all texts with the word. Repeated documents and items are reported once for each pair of
ids. A null doc_id or item_id is reported as null. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

NAME, NUMBER, UNIT, MAYBE = "\x01", "\x02", "\x03", "\x04"
#: Units that make a slot after a number.
UNITS = "kg|g|mg|km|m|cm|mm|l|ml|lb|lbs|oz|mi|ft|in|mph|kmh|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent"
#: Words that are numbers.
NUMBERS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
BROADCAST_BYTES = 32 << 20
"""Anchors, and windows, of a benchmark are broadcast up to so many bytes; those of a larger one are joined by a shuffle."""


def canonical_words(text: Column) -> Column:
    """The words of a text, slots marked; one empty word for a null text."""
    text = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT + MAYBE, "    ")
    named = F.regexp_replace(text, r"\p{Lu}(?<=[\p{Ll},;] \p{Lu})\p{Ll}+", NAME + "$0")
    named = F.regexp_replace(named, rf"(?<![\p{{L}}\p{{N}}{NAME}])\p{{Lu}}\p{{Ll}}+", MAYBE + "$0")
    joined = F.regexp_replace(named, r"(?<=[0-9])[.,](?=[0-9])", "")
    numbered = F.regexp_replace(joined, r"(?<![\p{L}0-9])[0-9]+", " " + NUMBER + "$0 ")
    united = F.regexp_replace(numbered, rf"({NUMBER}[0-9]+ +){MAYBE}?((?i:{UNITS}))(?![\p{{L}}0-9])", "$1" + UNIT + "$2")
    slotted = F.when(text.rlike("[0-9]"), united).otherwise(named)
    clean = F.trim(F.lower(F.regexp_replace(slotted, r"[^\p{L}\p{N}\x01-\x04]+", " ")))
    return F.split(clean, " ")


def _counted(words: Column) -> Column:
    """Words that are numbers, marked as such."""
    return F.transform(words, lambda w: F.when(_plain(w).isin(NUMBERS), F.concat(F.lit(NUMBER), _plain(w))).otherwise(w))


def _is_slot(word: Column, wide: bool = False) -> Column:
    """Whether a word is a slot; in the wide form, any capitalised word is one."""
    return word < F.lit("\x05" if wide else MAYBE)


def _plain(word: Column) -> Column:
    return F.ltrim(word, F.lit(NAME + NUMBER + UNIT + MAYBE))


def _kind(word: Column) -> Column:
    return F.translate(F.substring(word, 1, 1), MAYBE, NAME)


def _template(words: Column, wide: bool = False) -> Column:
    """Hash of a window whose slots have their markers alone."""
    return F.xxhash64(F.transform(words, lambda w: F.when(_is_slot(w, wide), _kind(w)).otherwise(_plain(w))))


def _verbatim(words: Column) -> Column:
    """Hash of a window in plain form."""
    return F.xxhash64(F.transform(words, _plain))


def benchmark_windows(benchmark: DataFrame, width: int, least: int) -> DataFrame:
    """item_id, text_id, k, n_windows, n_templates and n_wides (of the item), anchor, offset, second (one more word
    that is no slot, and its offset; null without one), size, span, template (null with fewer than ``least`` words that are
    no slots), wide, plain, item_words. The wide template is of span words, as many as are needed
    for ``least`` that are no slots in that form, and null if the item ends before."""
    items = benchmark.select("item_id", _counted(canonical_words(F.col("text"))).alias("words")).distinct()
    items = items.where(F.array_max("words") != "").withColumn("text_id", F.xxhash64(F.array_join("words", " ")))
    count = F.greatest(F.size("words") - width + 1, F.lit(1))
    rows = items.select("item_id", "text_id", "words", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    rows = rows.withColumn("item_words", F.slice("words", F.col("k") + 1, F.lit(width)))
    templated = F.size(F.filter("item_words", lambda w: ~_is_slot(w))) >= least
    rows = rows.withColumn("template", F.when(templated, _template(F.col("item_words"))))
    solid = F.size(F.filter("item_words", lambda w: ~_is_slot(w, True)))
    places = F.filter(F.sequence(F.col("k"), F.size("words") - 1), lambda i: ~_is_slot(F.get("words", i), True))
    rows = rows.withColumn("wide_size", F.when(solid >= least, F.size("item_words")).when(solid > 0, F.get(places, F.lit(least - 1)) - F.col("k") + 1))
    sized = F.coalesce("wide_size", F.size("item_words"))
    rows = rows.withColumns({"size": F.size("item_words"), "item_words": F.slice("words", F.col("k") + 1, sized)})
    rows = rows.withColumn("wide", F.when(F.col("wide_size").isNotNull(), _template(F.col("item_words"), True)))
    # Templates have their anchor among the words that are no slots.
    slot = lambda w: (F.col("wide").isNotNull() & _is_slot(w, True)) | (F.col("template").isNotNull() & _is_slot(w))
    length = lambda w: F.when(slot(w), 0).otherwise(F.char_length(_plain(w)))
    ranked = F.array_sort(F.transform(F.slice("item_words", F.lit(1), F.col("size")), lambda w, i: F.struct((-length(w)).alias("short"), _plain(w).alias("word"), i.alias("offset"))))
    best, other = ranked[0], F.get(ranked, F.lit(1))
    rows = rows.withColumn("second", F.when(other["short"] < 0, F.struct(other["offset"].alias("offset"), other["word"].alias("word"))))
    item = Window.partitionBy("item_id", "text_id")
    rows = rows.withColumns({"n_windows": F.count("*").over(item), "n_templates": F.count("template").over(item), "n_wides": F.count("wide").over(item)})
    plain = _verbatim(F.slice("item_words", F.lit(1), F.col("size")))
    return rows.select("item_id", "text_id", "k", "n_windows", "n_templates", "n_wides", best["word"].alias("anchor"), best["offset"].alias("offset"), "second", "size", F.size("item_words").alias("span"), "template", "wide", plain.alias("plain"), "item_words")


def _fits(df: DataFrame, row_bytes: Column) -> bool:
    """Whether the rows come to ``BROADCAST_BYTES`` at most."""
    return (df.agg(F.sum(row_bytes + 32).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES


def _small(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df`` with a broadcast hint if its rows come to ``BROADCAST_BYTES`` at most."""
    return F.broadcast(df) if _fits(df, row_bytes) else df


def _met(words: DataFrame, by_anchor: DataFrame) -> DataFrame:
    """Words that are anchors, with their document's words and the anchor's places.

    A benchmark too large to be broadcast is met by the words' hashes alone; what is hit then fetches its document's words, by
    one shuffle of the documents, whatever their length. Documents of equal id and text are fetched once."""
    if _fits(by_anchor, F.size("places") * 64):
        return words.join(F.broadcast(by_anchor), "anchor")
    hits = words.select("doc_key", "place", "anchor").join(by_anchor, "anchor").drop("anchor")
    return words.select("doc_id", "doc_key", "words").where("place = 0").dropDuplicates(["doc_key"]).join(hits.distinct(), "doc_key")


def _forms(plain: Column, template: Column, wide: Column) -> Column:
    """An array of (form, hash), without those whose hash is null."""
    pairs = (("plain", plain), ("template", template), ("wide", wide))
    return F.array_compact(F.array(*(F.when(h.isNotNull(), F.struct(F.lit(name).alias("form"), h.alias("hash"))) for name, h in pairs)))


def _matches(words: DataFrame, windows: DataFrame) -> DataFrame:
    """Aligned windows of documents and items whose templates, or plain forms, are equal: doc_id, doc_key, own (the document's
    words), the window's columns, same_plain, same_template, same_wide and shift (how far apart they begin)."""
    # One row for each anchor: the join has no further condition and stays in the stage that explodes the words, so that
    # a document's array of words is copied for hits alone.
    reach = (F.max("offset").alias("back"), F.max(F.col("span") - F.col("offset")).alias("ahead"))
    by_anchor = windows.groupBy(F.xxhash64("anchor").alias("anchor")).agg(F.collect_set(F.struct("offset", "second", "size", "span")).alias("places"), *reach)
    begin = F.greatest(F.col("place") - F.col("back"), F.lit(0))
    around = F.slice("words", begin + 1, F.col("place") - begin + F.col("ahead"))
    near = _met(words, by_anchor).select("doc_id", "doc_key", "place", begin.alias("begin"), around.alias("around"), "places")
    near = near.select("doc_id", "doc_key", "begin", "around", "place", F.explode("places").alias("p"))  # apart, so that what is around is made once a hit
    near = near.select("doc_id", "doc_key", "begin", "around", (F.col("place") - F.col("p.offset")).alias("at"), "p.*").where("at >= 0")
    start = F.col("at") - F.col("begin")
    near = near.where((F.size("around") - start >= F.col("size")) & (F.col("second").isNull() | (_plain(F.get("around", start + F.col("second.offset"))) == F.col("second.word"))))
    near = near.withColumn("own", _counted(F.slice("around", start + 1, F.col("span"))))
    first = F.slice("own", F.lit(1), F.col("size"))
    near = near.select("doc_id", "doc_key", "at", "size", "span", "own", F.explode(_forms(_verbatim(first), _template(first), _template(F.col("own"), True))).alias("f")).select("*", "f.*").drop("f")
    known = windows.withColumn("f", F.explode(_forms(F.col("plain"), F.col("template"), F.col("wide")))).select("*", "f.*").drop("f", "anchor", "offset", "second", "plain")
    hits = near.join(_small(known, F.size("item_words") * 16 + 64), ["form", "hash", "size", "span"])
    same = [F.bool_or(F.col("form") == x).alias(f"same_{x}") for x in ("plain", "template", "wide")]
    once = ["doc_id", "doc_key", "item_id", "text_id", "k", "at"]
    hits = hits.groupBy(*once).agg(*same, *(F.first(c).alias(c) for c in ("n_windows", "n_templates", "n_wides", "size", "span", "template", "wide", "item_words", "own")))
    return hits.withColumn("shift", F.col("at") - F.col("k"))


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, least: int = 5, coverage: float = 0.5, run: int = 6) -> DataFrame:
    """doc_id, item_id, n_matched, n_windows, reparameterised (a slot has another value), for contaminated documents.

    n_matched and n_windows are those of the item's templates, wide templates or windows in plain form, whichever has the largest share."""
    windows = stored(benchmark_windows(benchmark, width, least), "windows")
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = docs.select("doc_id", F.xxhash64("doc_id", text).alias("doc_key"), canonical_words(F.col("text")).alias("words"))
    words = parts.select("doc_id", "doc_key", "words", F.posexplode_outer("words").alias("place", "anchor")).withColumn("anchor", F.xxhash64(_plain(F.col("anchor"))))
    found = _matches(words, windows)

    # A matched window counts in each form that it has.
    def form(name: str, same: str, n: str, wide: bool = False) -> Column:
        item, own = (F.slice(c, F.lit(1), F.when(F.col(same), F.col("span" if wide else "size")).otherwise(F.col("size"))) for c in ("item_words", "own"))
        pairs = F.filter(F.zip_with(item, own, lambda a, b: F.struct(a.alias("word"), F.concat(_kind(a), _plain(a)).alias("item"), F.concat(_kind(a), _plain(b)).alias("own"))), lambda p: _is_slot(p["word"], wide) & F.lit(name != "plain"))
        return F.struct(F.lit(name).alias("form"), F.col(n).alias("n"), F.transform(pairs, lambda p: F.struct(p["item"].alias("item"), p["own"].alias("own"))).alias("slots"))

    templated = F.when(F.col("template").isNotNull() & (F.col("same_template") | F.col("same_plain")), form("template", "same_template", "n_templates"))
    widened = F.when(F.col("same_wide") | (F.col("wide").isNotNull() & F.col("same_plain")), form("wide", "same_wide", "n_wides", True))
    plain = F.when(F.col("same_plain"), form("plain", "same_plain", "n_windows"))
    keys = ["doc_id", "doc_key", "item_id", "text_id", "form", "n"]
    found = found.withColumn("of", F.explode(F.array_compact(F.array(templated, widened, plain)))).select("*", "of.*")
    aligned = found.groupBy(*keys, "shift").agg(
        F.collect_set("k").alias("ks"), F.collect_set(F.when(F.col("same_plain"), F.col("k"))).alias("plain_ks"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    named = F.filter("slots", lambda p: ~p["item"].startswith(NUMBER))
    sound = F.size(F.array_distinct(F.transform("slots", lambda p: p["item"]))) == F.size("slots")
    sound &= F.size(F.array_distinct(F.transform(named, lambda p: p["own"]))) == F.size(named)
    changed = F.when(F.col("form") != "plain", F.exists("slots", lambda p: p["item"] != p["own"]))
    sound = aligned.withColumn("changed", changed).withColumn("ks", F.when(sound, F.col("ks")).otherwise(F.col("plain_ks")))
    whole = sound.groupBy(*keys).agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ks")))).alias("n_matched"), F.size(F.array_distinct(F.flatten(F.collect_list("plain_ks")))).alias("n_plain"), F.min("changed").alias("changed")
    )
    hit = (F.col("n_matched") >= F.lit(coverage) * F.col("n")) | (F.col("n_plain") >= run)
    share = F.max(F.struct(F.col("n_matched") / F.col("n"), "n_matched", "n")).alias("share")
    pairs = whole.where(hit).groupBy("doc_id", "item_id").agg(share, F.coalesce(F.min("changed"), F.lit(False)).alias("reparameterised"))
    return pairs.select("doc_id", "item_id", F.col("share.n_matched"), F.col("share.n").alias("n_windows"), "reparameterised")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, all columns as they are."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
