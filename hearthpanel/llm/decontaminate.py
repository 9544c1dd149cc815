"""Benchmark decontamination by template windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a template window.
WINDOW = 6
#: Words of a window that are no placeholder, at least; slots alone are no evidence.
PLAIN = 3
#: Share of an item's words that a document has to follow.
COVERAGE = 0.5
#: Codes of placeholders in window keys, below those of all words.
SLOTS = {"#name": 1 - 2**63, "#number": 2 - 2**63, "#unit": 3 - 2**63}
WORD = r"\p{L}[\p{L}\p{M}]*|\d+(?:[.,]\d+)*"
# Names are marked by a private character while a text is cut into words; capitalised words that may be names by another.
MARK = "\ue000"
MAYBE = "\ue001"
# Units that follow a number.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yards mile miles mg g kg t lb lbs oz ml cl l liters litres gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent degrees usd eur gbp dollars euros pounds cents k w kw kwh v hz mhz ghz kb mb gb tb mph kmh"
).split()


def words(text: Column) -> Column:
    """Words and numbers of a text; a name, a capitalised word inside a sentence, keeps a mark in front.

    One anywhere else, as at the start of a text or sentence or behind a quote,
    bracket or number, may be a name and keeps the other mark.
    """
    marked = F.regexp_replace(_unmarked(text), r"(?<=[\p{Ll},;] )(\p{Lu}\p{Ll}+)", MARK + "$1")
    marked = F.regexp_replace(marked, r"(?<![\p{L}" + MARK + r"])(\p{Lu}\p{Ll}+)", MAYBE + "$1")
    return F.regexp_extract_all(marked, F.lit("[" + MARK + MAYBE + "]?" + WORD), F.lit(0))


def _unmarked(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(MAYBE)), F.translate(text, MARK + MAYBE, "")).otherwise(text)


def _bare(word: Column) -> Column:
    return F.lower(F.translate(word, MARK + MAYBE, ""))


def _maybe(word: Column) -> Column:
    return F.startswith(word, F.lit(MAYBE))


def _number(word: Column) -> Column:
    return F.substring(word, 1, 1).between("0", "9")


def template(raw: Column) -> Column:
    """The words with numbers, names, possible ones too, and units behind a number replaced by typed placeholders, the rest in lower case."""

    def slot(word: Column, i: Column) -> Column:
        unit = (i > 0) & F.coalesce(_number(F.get(raw, i - 1)), F.lit(False)) & _bare(word).isin(UNITS)
        typed = F.when(_number(word), "#number").when(unit, "#unit")
        return typed.when(F.startswith(word, F.lit(MARK)) | _maybe(word), "#name").otherwise(F.lower(word))

    return F.transform(raw, slot)


def _is_slot(word: Column) -> Column:
    return F.startswith(word, F.lit("#"))


def _plain(canon: Column) -> Column:
    return F.size(F.filter(canon, lambda x: ~_is_slot(x)))


def _code(word: Column) -> Column:
    """Hash of a word in lower case."""
    code = F.xxhash64(word)
    return F.greatest(code, F.lit(4 - 2**63))


def _codes(plain: Column) -> Column:
    """For each word, without marks, the code of the word or of the placeholder that ``template`` gives it.

    A word that starts a run of letters is a name, sure or possible, if a
    capital and a small letter begin it, so texts need no marks here.
    """

    def code(word: Column, i: Column) -> Column:
        unit = (i > 0) & F.coalesce(_number(F.get(plain, i - 1)), F.lit(False)) & F.lower(word).isin(UNITS)
        name = ~F.substring(word, 1, 1).between("a", "z") & F.rlike(word, F.lit(r"^\p{Lu}\p{Ll}"))
        slot = F.when(_number(word), SLOTS["#number"]).when(unit, SLOTS["#unit"]).when(name, SLOTS["#name"])
        return slot.otherwise(_code(F.lower(word)))

    return F.transform(plain, code)


def _slots_prevail(window: Column) -> Column:
    """Whether fewer than PLAIN codes of a window are those of words: slots sort before them."""
    return F.get(F.sort_array(window), F.lit(WINDOW - PLAIN)) <= max(SLOTS.values())


def windows(texts: DataFrame) -> DataFrame:
    """(doc_id, place, hash) of the windows at every word of (doc_id, text), places from 1.

    The hash is that of the template, and another row has that of the words
    themselves where slots prevail. Words are hashed once, in columns of their
    own; windows only combine the numbers.
    """
    plain = texts.select("doc_id", F.regexp_extract_all(_unmarked(F.col("text")), F.lit(WORD), F.lit(0)).alias("plain"))
    plain = plain.filter(F.size("plain") >= WINDOW)
    coded = plain.select("doc_id", "plain", _codes(F.col("plain")).alias("codes"))
    places = F.sequence(F.lit(1), F.size("codes") - WINDOW + 1)
    begun = coded.select("doc_id", "plain", "codes", F.explode(places).alias("place"))
    begun = begun.select("doc_id", "plain", "place", F.slice("codes", F.col("place"), F.lit(WINDOW)).alias("window"))
    own = F.array(F.xxhash64("window"))
    themselves = F.xxhash64(*(_code(F.lower(F.get("plain", F.col("place") + (k - 1)))) for k in range(WINDOW)))
    both = F.when(_slots_prevail(F.col("window")), F.array(F.xxhash64("window"), themselves)).otherwise(own)
    return begun.select("doc_id", "place", F.explode(both).alias("hash"))


def _key(window: Column) -> Column:
    """The hash of a window of words and placeholders, as ``windows`` makes it."""
    return F.xxhash64(F.transform(window, lambda w: F.coalesce(*(F.when(w == slot, F.lit(code)) for slot, code in SLOTS.items()), _code(w))))


def leaks(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a benchmark item it holds: doc_id, item_id, coverage, n_slots, n_changed, kind.

    1. Texts become templates: numbers, names and units turn into placeholders.
       A capitalised word at the start of a sentence or behind a quote, bracket
       or number may be a name: documents have a placeholder for it, and items
       have templates with the placeholder and with the word.
    2. Template windows of documents and items, at every word of both, are
       hash-joined; each hit says where in the document the item would begin.
       Windows of fewer than PLAIN words beside slots are met by their very
       words, and by the template only for items that have no other window.
    3. At each such place the whole item is compared word by word. Its slots
       must be consistent: one value of the item always has the same value in
       the document. A word that may be a name and differs counts as a slot if
       it has one value, else as a word that does not match. An inconsistent place is no evidence, nor is one of fewer
       than PLAIN words beside slots, unless the slots have the item's values or
       the whole item matches and is not of slots alone.
    4. A pair is reported when the places together cover ``coverage`` of the
       item's words. ``kind`` is ``reparameterised`` when slot values differ,
       else ``verbatim``.

    Items with fewer than WINDOW words are too short to tell a
    leak from chance and are not looked for. Null and empty texts match
    nothing; a null doc_id or item_id cannot be named and is left out; rows
    that repeat an id count as that id; empty tables give no pair. The join
    of windows and items is left to Spark, which broadcasts the items' side
    only by its measured size.
    """
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", "text").distinct()
    items = items.select("item_id", words(F.col("text")).alias("raw")).withColumn("canon", template(F.col("raw")))
    items = items.filter(F.size("canon") >= WINDOW)
    cut = items.select("item_id", "raw", "canon", F.explode(F.sequence(F.lit(1), F.size("canon") - WINDOW + 1)).alias("item_place"))
    cut = cut.withColumns({c: F.slice(c, F.col("item_place"), F.lit(WINDOW)) for c in ("raw", "canon")}).withColumn("plain", _plain(F.col("canon")))
    # Words that the document may write as a possible name: those, and the first word of the item.
    open_word = lambda w, i: (_maybe(w) & (F.get("canon", i) == "#name")) | ((F.col("item_place") == 1) & (i == 0) & ~_is_slot(F.get("canon", i)))
    cut = cut.withColumn("open", F.transform("raw", open_word))
    cut = cut.withColumn("plain", F.size(F.filter(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda i: F.get("open", i) | ~_is_slot(F.get("canon", i)))))
    strict = F.size(F.filter(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda i: ~F.get("open", i) & ~_is_slot(F.get("canon", i))))
    best = cut.groupBy("item_id").agg(F.max("plain").alias("best"))
    by_template = cut.join(best, "item_id").filter((F.col("plain") >= PLAIN) | ((F.col("best") < PLAIN) & (F.col("plain") > 0)))
    options = F.transform("raw", lambda w, i: F.when(F.get("open", i), F.array(_bare(w), F.lit("#name"))).otherwise(F.array(F.get("canon", i))))
    every = lambda made, more: F.flatten(F.transform(made, lambda v: F.transform(more, lambda x: F.concat(v, F.array(x)))))
    none = F.array(F.array().cast("array<string>"))
    by_template = by_template.withColumn("options", options).withColumn("variants", F.aggregate("options", none, every))
    by_template = by_template.select("item_id", "item_place", F.explode("variants").alias("variant"))
    literal = cut.filter(strict < PLAIN).select("item_id", "item_place", _key(F.transform("raw", _bare)).alias("hash"))
    keys = by_template.select("item_id", "item_place", _key(F.col("variant")).alias("hash")).unionByName(literal).distinct()
    known = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    hits = windows(known).join(keys, "hash")
    begins = hits.select("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("begin")).distinct()

    asked = begins.groupBy("doc_id").agg(F.collect_set(F.struct("item_id", "begin")).alias("asked"))
    held = known.join(asked, "doc_id").select("doc_id", words(F.col("text")).alias("doc_raw"), "asked").withColumn("doc_canon", template(F.col("doc_raw")))
    held = held.select("doc_id", "doc_raw", "doc_canon", F.explode("asked").alias("a")).select("doc_id", "a.item_id", "a.begin", "doc_raw", "doc_canon")
    # Only the stretch that may hold the item travels on to it.
    sizes = items.select("item_id", F.size("canon").alias("n"))
    held = held.join(sizes, "item_id")
    start, behind = F.greatest(F.col("begin"), F.lit(0)), F.greatest(-F.col("begin"), F.lit(0))
    stretch = {c: F.slice(c, start + 1, F.greatest(F.col("n") - behind, F.lit(0))) for c in ("doc_raw", "doc_canon")}
    held = held.select("doc_id", "item_id", behind.alias("behind"), *(v.alias(c) for c, v in stretch.items())).join(items, "item_id")
    there = F.col("behind")

    def of(column: str, p: Column) -> Column:
        return F.get(column, p if column in ("raw", "canon") else p - there)

    def unsure(p: Column) -> Column:
        return (_maybe(of("raw", p)) & (of("canon", p) == "#name")) | (_maybe(of("doc_raw", p)) & (of("doc_canon", p) == "#name"))

    def equal(p: Column) -> Column:
        return of("canon", p) == of("doc_canon", p)

    def pair(p: Column) -> Column:
        return F.struct(_bare(of("raw", p)).alias("item"), _bare(of("doc_raw", p)).alias("doc"))

    within = F.filter(F.sequence(F.lit(0), F.size("canon") - 1), lambda p: (p >= there) & (p - there < F.size("doc_raw")))
    held = held.withColumn("within", within)
    held = held.withColumns(
        {
            "sure": F.filter("within", lambda p: ~unsure(p) & equal(p)),
            "unsure": F.filter("within", lambda p: unsure(p) & (equal(p) | (_bare(of("raw", p)) == _bare(of("doc_raw", p))))),
        }
    )
    held = held.withColumn("slots", F.array_distinct(F.transform(F.filter("sure", lambda p: _is_slot(of("canon", p))), pair)))
    consistent = F.size("slots") == F.size(F.array_distinct("slots.item"))
    held = held.filter(consistent).withColumn("pairs", F.array_union("slots", F.transform("unsure", pair)))
    same_word = lambda p: _bare(of("raw", p)) == _bare(of("doc_raw", p))
    one_value = lambda p: F.size(F.filter("pairs", lambda s: s["item"] == _bare(of("raw", p)))) == 1
    held = held.withColumn("words", F.filter("unsure", same_word)).withColumn("names", F.filter("unsure", lambda p: ~same_word(p) & one_value(p)))
    held = held.withColumn("matched", F.concat("sure", "words", "names")).withColumn("slots", F.array_union("slots", F.transform("names", pair)))
    plain = F.size("words") + F.size(F.filter("sure", lambda p: ~_is_slot(of("canon", p))))
    same = F.forall("slots", lambda s: s["item"] == s["doc"])
    evidence = (plain >= PLAIN) | same | ((plain > 0) & (F.size("matched") == F.size("canon")))
    found = held.filter(evidence & (F.size("matched") >= WINDOW)).groupBy("doc_id", "item_id").agg(
        F.max(F.size("canon")).alias("n"),
        F.array_distinct(F.flatten(F.collect_set("matched"))).alias("matched"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    changed = F.size(F.filter("slots", lambda s: s["item"] != s["doc"]))
    found = found.select("doc_id", "item_id", (F.size("matched") / F.col("n")).alias("coverage"), F.size("slots").alias("n_slots"), changed.alias("n_changed"))
    return found.filter(F.col("coverage") >= coverage).withColumn("kind", F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim"))
