"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts are rewritten as templates: numbers, units after numbers and names (capitalised words
inside a sentence) become typed placeholders, the rest is lower-cased and freed of punctuation.
Windows of `WINDOW` template words are hashed, and documents meet benchmark items where hashes
are equal. An item is leaked to a document that holds at least `SHARE` of its windows. Where
the item has placeholders, the windows must line up in one stretch of the document, and each
value in the item must stand for one value in the document: a question with other numbers is
caught, a chance meeting of placeholders is not.

Which words are names depends on case, so the bare words, lower-cased and without placeholders,
have windows of their own: an item copied word for word is met whatever the case of its copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meandra.llm.common import SPACE, cut

WINDOW = 5
SHARE = 0.8
#: Benchmark windows up to this number (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
#: Units that count as such after a number (fixed values).
UNITS = "km|cm|mm|m|kg|mg|g|lb|oz|ml|l|s|ms|min|h|hr|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|kilometers?|grams?|liters?|litres?|dollars?|euros?|cents?|usd|eur|gbp|percent|degrees?|mph|kmh"
_NAME = r"(?<=[^.!?\x09-\x0D\x20]\x20)\p{Lu}[\p{L}'’-]*"
_NUMBER = r"(?<![\p{L}\d])[+-]?\d+(?:[.,:/]\d+)*"


def valued(text: Column) -> Column:
    """The text with placeholders that still hold their values: <num=12>, <unit=km>, <name=Anna>."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), "<>=", "")
    t = F.regexp_replace(t, _NAME, "<name=$0>")
    # most texts have no digit: two passes less
    number = F.regexp_replace(F.regexp_replace(t, _NUMBER, "<num=$0>"), rf"(<num=[^>]*>)\x20?(?i:({UNITS}))(?![\p{{L}}\d])", "$1 <unit=$2>")
    return F.when(t.rlike(r"\d"), number).otherwise(t)


def template(v: Column) -> Column:
    """Template words of a valued text."""
    t = F.lower(F.regexp_replace(v, "=[^>]*>", ">"))
    # plain letters and spaces are most of a text: they are asked for first
    t = F.regexp_replace(t, r"[^a-z\x20\p{L}\p{M}\p{N}<>\x09-\x0D]+", "")
    return F.array_remove(F.split(t, SPACE), "")


def bare(text: Column) -> Column:
    """Words of a text as template() makes them, without placeholders."""
    return template(F.translate(F.coalesce(text.cast("string"), F.lit("")), "<>=", ""))


def _pairs(v: Column) -> Column:
    """(template word, value) of each word of a valued text, in step with template()."""
    clean = lambda w: F.regexp_replace(F.lower(F.regexp_replace(w, "=[^>]*>", ">")), r"[^\p{L}\p{M}\p{N}<>]+", "")
    words = F.transform(F.split(v, SPACE), lambda w: F.struct(clean(w).alias("t"), F.regexp_extract(w, "=([^>]*)>", 1).alias("value")))
    return F.filter(words, lambda w: w["t"] != "")


def _held(df: DataFrame, name: str, column: Column) -> DataFrame:
    """`df` with an array made once a row: a generator keeps the optimizer from pasting it into lambdas."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def _none() -> Column:
    return F.array().cast("array<struct<h:bigint,at:int>>")


def _windows(words: Column, width: int, literal: bool = False) -> Column:
    """(h, at) of each window of `width` words; literal windows have hashes of their own."""
    at = F.sequence(F.lit(0), F.size(words) - width)
    h = F.transform(at, lambda i: F.struct(F.xxhash64(F.lit(-width if literal else width), *(words[i + k] for k in range(width))).alias("h"), i.alias("at")))
    return F.when(F.size(words) >= width, h).otherwise(_none())


def _text_windows(words: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, h, at): windows of `words` and `bare` of each row, with hashes as _windows() gives them.

    Texts of fewer than WINDOW words are one window, if some item has as many. Rows are made before they are hashed,
    so that no lambda is called for a window and what follows is compiled with it.
    """
    n = lambda c: F.when(F.size(c) >= WINDOW, F.size(c) - (WINDOW - 1)).when(F.size(c).isin(widths), 1).otherwise(0)
    each = words.select("doc_id", "words", "bare", n("words").alias("n"), n("bare").alias("m"))
    each = each.select("doc_id", "words", "bare", "n", F.explode(F.when(F.col("n") + F.col("m") > 0, F.sequence(F.lit(0), F.col("n") + F.col("m") - 1))).alias("i"))
    literal = F.col("i") >= F.col("n")
    each = each.select("doc_id", F.when(literal, F.col("bare")).otherwise(F.col("words")).alias("of"), F.when(literal, F.col("i") - F.col("n")).otherwise(F.col("i")).alias("at"), literal.alias("literal"))
    width = F.least(F.size("of"), F.lit(WINDOW))
    # places behind the end of a short text are null, which hashes pass over
    h = F.xxhash64(F.when(F.col("literal"), -width).otherwise(width), *(F.get("of", F.col("at") + k) for k in range(WINDOW)))
    return each.select("doc_id", h.alias("h"), "at")


def _item_windows(items: DataFrame, literal: bool) -> DataFrame:
    """(item_id, literal, h, at, n, places, slots): an item with fewer than WINDOW words is one window of all of them."""
    words = _held(items, "words", bare(F.col("text"))) if literal else _held(_held(items, "v", valued(F.col("text"))), "words", template(F.col("v")))
    col = F.col("words")
    made = _windows(col, WINDOW, literal)
    for width in range(1, WINDOW):
        made = F.when(F.size(col) == width, _windows(col, width, literal)).otherwise(made)
    rows = words.select("item_id", F.exists(col, lambda w: w.startswith("<")).alias("slots"), F.explode(made).alias("w"))
    rows = rows.select("item_id", F.lit(literal).alias("literal"), "slots", "w.h", "w.at")
    return rows.join(rows.groupBy("item_id").agg(F.countDistinct("h").alias("n"), F.count("*").alias("places")), "item_id")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, matched, windows): the items that documents hold, each pair once.

    matched of the item's `windows` windows are in the document, at least `share` of them. An item of
    fewer than WINDOW words, which may stand anywhere by chance, is held by a text of just these words only.
    Null or wordless texts hold nothing and are in nothing. Rows without doc_id or item_id take
    no part. Repeated rows count once; items or documents that share an id are judged together.
    Other columns are ignored. Empty tables give no rows.
    """
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null").dropDuplicates()
    items = cut(_item_windows(asked, False).unionByName(_item_windows(asked, True)))
    facts = items.agg(F.count("*").alias("n")).first()
    small = facts["n"] <= BROADCAST_WINDOWS
    sized = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    widths = [WINDOW, *(r["n"] for r in _short_widths(benchmark).collect())]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    words = _held(_held(texts, "words", template(valued(F.col("text")))), "bare", bare(F.col("text"))).drop("text")
    met = _text_windows(words, widths)
    met = cut(met.join(sized(items.select("h").distinct()), "h", "left_semi"))

    # An item with n windows misses at most n - need: of any n - need + 1 of its windows a leak holds one. The rarest lead to few items.
    each_h = items.select("item_id", "literal", "h", "n", "slots").distinct()
    rarity = each_h.groupBy("h").agg(F.count("*").alias("df"))
    need = F.ceil(F.col("n") * F.lit(share) - 1e-9)
    by = F.struct("df", "h")
    order = each_h.join(rarity, "h").groupBy("item_id", "literal", "n", "slots").agg(F.array_sort(F.collect_list(by)).alias("all"))
    probes = order.select("item_id", "literal", F.explode(F.slice("all", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("p")).select("item_id", "literal", "p.h")
    pairs = met.select("doc_id", "h").distinct().join(sized(probes), "h").select("doc_id", "item_id", "literal").distinct()
    held = pairs.join(each_h, ["item_id", "literal"]).join(met.select("doc_id", "h").distinct(), ["doc_id", "h"])
    held = held.groupBy("doc_id", "item_id", "literal", "n", "slots").agg(F.count("*").alias("matched")).filter(F.col("matched") >= need)
    held = cut(held)
    plain = held.filter("not slots").select("doc_id", "item_id", "matched", F.col("n").alias("windows"))
    slotted = held.filter("slots").select("doc_id", "item_id")
    if not slotted.isEmpty():
        plain = plain.unionByName(_consistent(texts, benchmark, items.filter("not literal"), met, slotted, share))
    best = plain.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("matched") / F.col("windows"), "matched", "windows")).alias("best"))
    return best.select("doc_id", "item_id", "best.matched", "best.windows")


def _short_widths(benchmark: DataFrame) -> DataFrame:
    """Widths under WINDOW that some item has; four rows at most."""
    words = benchmark.filter("item_id is not null").select(F.explode(F.array(F.size(template(valued(F.col("text")))), F.size(bare(F.col("text"))))).alias("n"))
    return words.filter((F.col("n") > 0) & (F.col("n") < WINDOW)).distinct()


def _consistent(texts: DataFrame, benchmark: DataFrame, items: DataFrame, met: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """Of pairs whose item has placeholders: those with enough windows in one line and one value for each value."""
    lined = pairs.join(items.select("item_id", "h", F.col("at").alias("item_at"), "places"), "item_id").join(met, ["doc_id", "h"])
    lined = lined.withColumn("shift", F.col("at") - F.col("item_at"))
    need = F.ceil(F.col("places") * F.lit(share) - 1e-9)
    line = lined.groupBy("doc_id", "item_id", "shift", "places").agg(F.countDistinct("item_at").alias("matched")).filter(F.col("matched") >= need)
    places = F.posexplode(F.col("pairs"))
    slot = lambda df, key, other: df.select(key, F.explode(F.array(_pairs(valued(F.col("text"))))).alias("pairs")).select(key, places.alias("pos", "p")).filter(F.col("p.t").startswith("<")).select(key, F.col("pos").alias(f"{other}_pos"), F.col("p.t").alias("kind"), F.lower("p.value").alias(other))
    asked = slot(benchmark.join(pairs.select("item_id").distinct(), "item_id", "left_semi").dropDuplicates(["item_id", "text"]), "item_id", "asked")
    given = slot(texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "given")
    values = line.join(asked, "item_id").withColumn("given_pos", F.col("asked_pos") + F.col("shift")).join(given, ["doc_id", "given_pos", "kind"])
    torn = values.groupBy("doc_id", "item_id", "shift", "kind", "asked").agg(F.countDistinct("given").alias("n")).filter("n > 1")
    good = line.join(torn.select("doc_id", "item_id", "shift").distinct(), ["doc_id", "item_id", "shift"], "left_anti")
    return good.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("places").alias("windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of `docs` that hold no benchmark item; rows without a doc_id stay."""
    return docs.join(leaks(docs, benchmark, share).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
