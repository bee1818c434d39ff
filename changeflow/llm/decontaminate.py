"""Operator 5: benchmark decontamination by template canonicalisation.

Texts become token lists in which numbers, capitalised words and units after
numbers are typed slots that keep their value; operators beside numbers are
tokens, digits inside a word are part of it. Windows of tokens are
hashed with the slots' types in place of their values (mostly slots: with their
values) and hash-joined with the benchmark's windows; where values differ, each
value of the item must have one value in the aligned passage, and enough
different tokens must agree word for word, so that a question
with other numbers or names is found and a chance meeting of templates is not. DataFrame
expressions only.
"""

from __future__ import annotations

import functools
import itertools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import read, save
from changeflow.session import broadcast_if_bounded

WINDOW = 8
# Tokens in the runs by which documents and items meet.
SEED = 4
# Share of an item's windows that a document must hold; or, for items of WINDOW tokens and more,
# share of the tokens of one alignment; or an unbroken passage of so many tokens.
MIN_SHARE = 0.5
MIN_COVER = 0.75
PASSAGE = 20
# Tokens of an alignment count in runs of RUN, or at the item's ends; tokens put in or
# left out may shift it by up to SHIFT.
RUN = 3
SHIFT = 16
# Different tokens that must agree word for word where slots differ.
VARIETY = 3
# An alignment is compared if it has at least one shared run for so many tokens of its item.
TOKENS_A_RUN = 10

# Marks a slot; the next character is its type, the rest its value.
MARK = "\x01"
# Stands for the decimal points of whole numbers.
POINT = "\x02"
# Stands before an operator.
SIGN = "\x03"
OPERATORS = "+*=/×÷"
NAME, NUMBER, UNIT = MARK + "a", MARK + "n", MARK + "u"
# Bits of a token's code: its kind, and the hash of its value.
KIND, VALUE = 3, -4
# Unit words recognised after a number.
UNITS = [
    "percent", "degrees", "mm", "cm", "m", "km", "inches", "inch", "feet", "foot", "yards", "miles", "mile", "meters", "metres",
    "mg", "g", "kg", "grams", "kilograms", "pounds", "lb", "oz", "ounces", "tons", "ml", "l", "liters", "litres", "gallons",
    "seconds", "minutes", "hours", "days", "weeks", "months", "years", "s", "h", "kmh", "mph",
    "cents", "dollars", "euros", "usd", "eur", "kb", "mb", "gb", "watts", "kw", "volts", "hz",
]

# Capitalised words that are no names.
NO_NAMES = [
    "The", "An", "And", "As", "At", "But", "By", "For", "From", "If", "In", "Into", "Is", "It", "Its", "Not", "Of", "On", "Or", "So", "Than", "That", "Then", "There",
    "These", "They", "This", "Those", "To", "With", "He", "Her", "Him", "His", "She", "We", "You", "Your", "My", "Our", "Their", "Are", "Was", "Were", "Be", "Been",
    "Can", "Could", "Do", "Does", "Did", "Has", "Have", "Had", "Will", "Would", "Should", "How", "What", "When", "Where", "Which", "Who", "Whose", "Why", "After",
    "Before", "Each", "Every", "All", "Some", "Any", "No", "Both", "Because", "While", "During", "Since", "Until",
]


def tokens(text: Column, whole: bool = False) -> Column:
    """Lower-case words of letters and digits; slots are MARK + type + value (null text: none).

    Digits after a letter belong to its word. One operator beside a number is a
    token, a hyphen only between spaces. A capitalised word is a name wherever it stands, NO_NAMES excepted. With
    ``whole``, thousands separators and decimal points belong to their number.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{MARK}{POINT}{SIGN}]", " ")
    t = F.regexp_replace(t, rf"(?=\p{{Lu}}\p{{Ll}})(?<![\p{{L}}\p{{N}}]['’\-]?)(?!(?:{'|'.join(NO_NAMES)})(?![\p{{L}}\p{{N}}]))", NAME)
    if whole:
        t = F.regexp_replace(t, r",(?<=[0-9],)(?=[0-9]{3}(?![0-9]))", "")
        t = F.regexp_replace(t, r"\.(?<=[0-9]\.)(?=[0-9])", POINT)
    t = F.lower(t)
    plain = F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}{MARK}{POINT}]+", " ")
    # Patterns begin with what is rare, so that most places fail at their first character.
    one = rf"([{OPERATORS}])(?<![{OPERATORS}][{OPERATORS}])(?![{OPERATORS}])(?:(?<=[0-9] ?[{OPERATORS}])|(?= ?[0-9]))"
    signs = F.regexp_replace(t, rf"{one}|(-)(?:(?<=[0-9] -)(?= )|(?<= -)(?= [0-9]))", f" {SIGN}$1$2 ")
    signs = F.regexp_replace(signs, rf"(?:(?<!{SIGN})[^\p{{L}}\p{{N}}{MARK}{POINT}{SIGN}])+", " ")
    digits = F.regexp_replace(F.regexp_replace(signs, rf"(?=[0-9])(?<![\p{{L}}0-9{POINT}])([0-9]+(?:{POINT}[0-9]+)*)", rf" {NUMBER}$1 "), " +", " ")
    units = F.regexp_replace(digits, rf"(?<= )(?<={NUMBER}[0-9{POINT}]{{1,40}} )(?=(?:{'|'.join(UNITS)})(?: |$))", UNIT)
    t = F.when(t.rlike("[0-9]"), units).otherwise(plain)
    return F.array_remove(F.split(F.trim(t), " +"), "")


def _plain(token: Column) -> Column:
    """A token without its slot mark."""
    return F.when(F.startswith(token, F.lit(MARK)), F.substr(token, F.lit(3))).otherwise(token)


def _codes(toks: Column) -> Column:
    """One number a token: the hash of its value, whose two lowest bits are 0 for a plain token, 1 for a name, 2 for a number, 3 for a unit."""
    value = lambda x: F.xxhash64(x).bitwiseAND(F.lit(VALUE))
    kind = lambda x: F.when(F.startswith(x, F.lit(NAME)), 1).when(F.startswith(x, F.lit(NUMBER)), 2).otherwise(3)
    return F.transform(toks, lambda x: F.when(F.startswith(x, F.lit(MARK)), value(_plain(x)).bitwiseOR(kind(x))).otherwise(value(x)))


def seeds(run: list[Column]) -> tuple[Column, Column]:
    """The one or two hashes under which the run of these codes meets its like; null where there is none.

    A run of which at most half are slots has its template's hash, and the hash
    in which names stand for themselves, so that copies in which other words or
    none look like names (all capitals, all small, other punctuation) are met. Of
    a run with more slots the template says too little: its plain values are hashed.
    """
    n = len(run)
    kind = lambda c: c.bitwiseAND(F.lit(KIND))
    total = lambda least: functools.reduce(operator.add, [(kind(c) > least).cast("int") for c in run])
    slots, values = total(0), total(1)
    # Kinds above ``least`` stand for their values.
    hashed = lambda least: F.xxhash64(F.lit(n), *[F.when(kind(c) > least, kind(c)).otherwise(c.bitwiseAND(F.lit(VALUE))) for c in run])
    slotted = kind(functools.reduce(Column.bitwiseOR, run)) > 0
    least = F.when(slots * 2 <= n, F.lit(0)).otherwise(F.lit(3))
    first = F.when(slotted, hashed(least)).otherwise(F.xxhash64(F.lit(n), *run))
    named = slotted & (values < slots) & (values * 2 <= n) & ((slots * 2 <= n) | (values > 0))
    return F.when(run[-1].isNotNull(), first), F.when(named, hashed(F.lit(1)))


def benchmark_items(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(item_id, item_hash, toks, size, n), one row per item; ``n`` is the item's window length.

    An item of fewer than ``n`` tokens is one window of its own length; items
    without tokens are left out.
    """
    items = benchmark.select("item_id", F.xxhash64("text").alias("item_hash"), tokens(F.col("text"), whole=True).alias("toks")).dropDuplicates(["item_id", "item_hash"])
    return save(items.withColumn("size", F.size("toks")).where("size > 0").withColumn("n", F.least("size", F.lit(n))), "benchmark")


def _seeded(df: DataFrame, sizes: list[int], *cols: str) -> DataFrame:
    """``cols``, pos and h of every run of each of ``sizes`` of the rows' ``toks``; the tokens are coded once.

    Places are rows before their runs are hashed, as expressions inside a lambda are not compiled.
    """
    at = df.select(*cols, _codes(F.col("toks")).alias("codes")).select(*cols, "codes", F.posexplode_outer("codes").alias("pos", "c0"))
    at = at.select(*cols, "pos", "c0", *[F.get("codes", F.col("pos") + k).alias(f"c{k}") for k in range(1, max(sizes))])
    hashes = [seeds([F.col(f"c{k}") for k in range(n)]) for n in sizes]
    at = at.select(*cols, "pos", *[h.alias(f"h{k}") for k, h in enumerate(itertools.chain(*hashes))])
    none = F.array().cast("array<bigint>")
    found = [F.when(F.col(f"h{k}").isNull(), none).when(F.col(f"h{k + 1}").isNull(), F.array(f"h{k}")).otherwise(F.array(f"h{k}", f"h{k + 1}")) for k in range(0, 2 * len(sizes), 2)]
    return at.select(*cols, "pos", F.explode(F.concat(*found) if len(found) > 1 else found[0]).alias("h"))


def matches(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, row_hash, item_id, item_hash, item_windows, item_tokens, n_windows, n_exact, covered, passage_tokens) of every row and item that share enough runs.

    That is one run of SEED tokens, and one more for every TOKENS_A_RUN tokens of
    the item beyond the first. n_windows counts the item's windows found, once
    each: those found word for word, and those of passages in which each of the
    item's slot values has one value, at most half of the window's values differ
    and VARIETY different tokens agree. item_windows counts all windows of the
    item. covered counts the tokens found along the best alignment in the same
    way, passage_tokens those of the longest unbroken passage.
    """
    items = benchmark_items(benchmark, n)
    length = F.least(F.col("size"), F.lit(min(SEED, n)))
    sizes = sorted(r["s"] for r in items.select(length.alias("s")).distinct().collect()) or [n]
    keys = [_seeded(items.where(length == size), [size], "item_id", "item_hash", "size") for size in sizes]
    keys = save(functools.reduce(DataFrame.unionByName, keys).withColumnRenamed("pos", "item_pos"), "benchmark-seeds")
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), tokens(F.col("text"), whole=True).alias("toks"))
    hit = _seeded(rows, sizes, "doc_id", "row_hash").join(broadcast_if_bounded(keys), "h")
    pair = ["doc_id", "row_hash", "item_id", "item_hash", "size"]
    found = hit.groupBy(*pair).agg(F.collect_set(F.col("pos") - F.col("item_pos")).alias("offsets"), F.size(F.collect_set("item_pos")).alias("shared"))
    found = save(found.where(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.col("size") / TOKENS_A_RUN))).drop("shared"), "seed-hits")
    ids = save(found.select(F.col("doc_id").alias("d"), F.col("row_hash").alias("rh")).distinct(), "hit-rows")
    own = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    own = own.join(broadcast_if_bounded(ids), own["doc_id"].eqNullSafe(ids["d"]) & (own["row_hash"] == ids["rh"]), "left_semi").dropDuplicates(["doc_id", "row_hash"])
    own = own.select(F.col("doc_id").alias("d"), F.col("row_hash").alias("rh"), tokens(F.col("text"), whole=True).alias("doc_toks"))
    at = found.join(own, found["doc_id"].eqNullSafe(own["d"]) & (found["row_hash"] == own["rh"]))
    # The document's tokens beside the item's, null where it has none.
    beside = lambda offset: F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda p: F.get("doc_toks", p + offset))
    each = F.transform("offsets", lambda o: F.struct(o.alias("offset"), beside(o).alias("passage")))
    at = at.select("doc_id", "row_hash", "item_id", "item_hash", F.explode(each).alias("c")).select("doc_id", "row_hash", "item_id", "item_hash", "c.*")
    items = items.withColumnsRenamed({"item_id": "i", "item_hash": "ih"})
    both = at.join(broadcast_if_bounded(items), at["item_id"].eqNullSafe(items["i"]) & (at["item_hash"] == items["ih"]))
    return _counted(_compared(both))


def _runs(marks: Column) -> Column:
    """``marks`` without inner runs of fewer than RUN ones."""
    for k in range(RUN - 1, 0, -1):
        marks = F.regexp_replace(marks, f"(?<=0)1{{{k}}}(?=0)", "0" * k)
    return marks


def _agreeing(marks: Column, at: Column) -> Column:
    """Different tokens of the item that agree word for word at the places ``at``."""
    return F.size(F.array_distinct(F.transform(F.filter(at, lambda p: F.substr(marks, p + 1, F.lit(1)) == "2"), lambda p: F.get("toks", p))))


def _at_most_half_differ(marks: Column) -> Column:
    return F.length(F.replace(marks, F.lit("1"))) * 2 >= F.length(marks)


def _compared(both: DataFrame) -> DataFrame:
    """Adds to each item beside a passage: windows found (``windows``) and found word for word (``exact``), tokens found
    in runs (``cover``), and the length of the longest unbroken run (``passage_tokens``)."""

    def token(p: Column) -> Column:
        a, b = F.get("toks", p), F.get("passage", p)
        typed = F.startswith(a, F.lit(MARK)) & (F.substring(a, 1, 2) == F.substring(b, 1, 2))
        return F.when(b.isNull(), "0").when(_plain(a) == _plain(b), "2").when(typed, "1").otherwise("0")

    places = F.sequence(F.lit(0), F.col("size") - 1)
    starts = F.sequence(F.lit(0), F.col("size") - F.col("n"))
    part = lambda p: F.substr("marks", p + 1, F.col("n"))
    held = lambda marks: F.filter(places, lambda p: F.substr(marks, p + 1, F.lit(1)) == "1")
    both = both.withColumn("marks", F.array_join(F.transform(places, token), ""))
    both = both.withColumn("run", _runs(F.translate("marks", "2", "1")))
    slots = F.filter(held(F.col("run")), lambda p: F.startswith(F.get("toks", p), F.lit(MARK)))
    both = both.withColumn("slots", F.array_distinct(F.transform(slots, lambda p: F.struct(_plain(F.get("toks", p)).alias("was"), _plain(F.get("passage", p)).alias("now")))))
    one_each = F.size("slots") == F.size(F.array_distinct(F.col("slots")["was"]))
    both = both.withColumn("marks", F.when(one_each, F.col("marks")).otherwise(F.translate("marks", "1", "0")))
    both = both.withColumn("exact", F.filter(starts, lambda p: part(p) == F.repeat(F.lit("2"), F.col("n"))))
    other = lambda p: ~F.contains(part(p), F.lit("0")) & _at_most_half_differ(part(p)) & (_agreeing(F.col("marks"), F.sequence(p, p + F.col("n") - 1)) >= VARIETY)
    both = both.withColumn("windows", F.filter(starts, lambda p: (part(p) == F.repeat(F.lit("2"), F.col("n"))) | other(p)))
    both = both.withColumn("run", _runs(F.translate("marks", "2", "1"))).withColumn("cover", held(F.col("run")))
    agree = F.size(F.filter("cover", lambda p: F.substr("marks", p + 1, F.lit(1)) == "2")) * 2 >= F.size("cover")
    both = both.withColumn("marks", F.when(agree & (_agreeing(F.col("marks"), F.col("cover")) >= VARIETY), F.col("marks")).otherwise(F.translate("marks", "1", "0")))
    both = both.withColumn("run", _runs(F.translate("marks", "2", "1"))).withColumn("cover", held(F.col("run")))
    passages = F.filter(F.split("marks", "0+"), _at_most_half_differ)
    return both.withColumn("passage_tokens", F.coalesce(F.array_max(F.transform(passages, F.length)), F.lit(0)))


def _counted(both: DataFrame) -> DataFrame:
    """One row per document row and item. An alignment is what lies in one span of 2 * SHIFT offsets."""
    group = ["doc_id", "row_hash", "item_id", "item_hash", "item_windows", "item_tokens"]
    both = both.withColumn("item_windows", (F.col("size") - F.col("n") + 1).cast("long")).withColumn("item_tokens", F.col("size"))
    span = F.floor(F.col("offset") / SHIFT)
    both = both.withColumn("span", F.explode(F.array(span, span - 1)))
    all_of = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)
    spans = both.groupBy(*group, "span").agg(all_of("windows"), all_of("exact"), F.size(all_of("cover")).alias("covered"), F.max("passage_tokens").alias("passage_tokens"))
    count = lambda c, to: F.size(all_of(c)).cast("long").alias(to)
    return spans.groupBy(*group).agg(count("windows", "n_windows"), count("exact", "n_exact"), F.max("covered").alias("covered"), F.max("passage_tokens").alias("passage_tokens"))


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``matches`` that hold the item, whole or in part.

    That is at least ``min_share`` of the item's windows; or, of an item of ``n``
    tokens or more, MIN_COVER of its tokens along one alignment, so that single
    words may be changed, put in or left out; or an unbroken passage of PASSAGE
    tokens. Null and empty texts hold nothing. Rows are told apart by doc_id (null
    is an id like any other) and text; exact repeated rows give one row. Items
    that repeat an item_id with another text are items of their own. Only doc_id,
    text and item_id, text are read. Empty tables on either side give no rows.
    """
    near = (F.col("item_tokens") >= n) & (F.col("covered") >= F.col("item_tokens") * MIN_COVER)
    return matches(docs, benchmark, n).where((F.col("n_windows") >= F.col("item_windows") * min_share) | near | (F.col("passage_tokens") >= PASSAGE))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns unchanged."""
    bad = save(contaminated(docs, benchmark, n, min_share).select(F.col("doc_id").alias("bad_id"), F.col("row_hash").alias("bad_hash")).distinct(), "contaminated")
    side = broadcast_if_bounded(bad)
    return docs.join(side, docs["doc_id"].eqNullSafe(side["bad_id"]) & (F.xxhash64(docs["text"]) == side["bad_hash"]), "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, windows found (all, word for word), the item's windows: one row per contaminated document and item."""
    out = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_windows", "n_exact", "item_windows")
