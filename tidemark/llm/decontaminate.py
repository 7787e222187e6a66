"""Benchmark decontamination by template windows, in DataFrame functions alone.

A text becomes a template: lower-case words, with numbers (in digits or words), units behind numbers, and names
replaced by typed placeholders. Every window of WIDTH template words is hashed, in documents as in benchmark items;
items of fewer than 2 * WIDTH - 1 words have windows of SHORT words. A window with fewer than PLAIN plain words says
too little as a template and is hashed with the values of its placeholders.

An item counts as contained where at least ``least`` of its windows are found in a text and its slots are filled
consistently: at the best alignment each value of the item stands for one value of the text, the same or a new
parameter. Texts are scanned once, against the set of the items' hashes; what that leaves is joined by the items'
rarest windows, of which a contained item must show one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, release

WIDTH, SHORT, PLAIN = 5, 3, 2
#: Hashes that one scan of the texts broadcasts, and rows of a verdict that are broadcast: about 50 MB at most.
BROADCAST_ROWS = 1_000_000
# What counts as a unit, a number word, and a name wherever it stands.
UNITS = "mm|cm|km|m|mg|g|kg|t|ml|l|s|ms|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|%|miles?|feet|foot|inch(?:es)?|pounds?|ounces?|meters?|metres?|kilometers?|kilometres?|kilograms?|grams?|liters?|litres?|degrees?|mph|kmh"
NUMBERS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante soixante mille "
    "dos tres cuatro cinco seis siete ocho nueve diez doce veinte treinta cuarenta cincuenta cien mil"
).split()
NAMES = (
    "alice bob carol dave eve mary john james anna peter paul sarah tom emma jack lucy david emily daniel laura michael julia robert susan "
    "maria jose carlos ana luis hans fritz greta klaus pierre marie jean claire ahmed fatima wei ming raj priya ivan olga kenji yuki"
).split()


def _any(words: list[str]) -> str:
    """A pattern of any of the words, by their first letter."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for first, rest in sorted(by.items()))


_NAME = r"(?<![\p{L}\p{N}])(?:(?<=[\p{Ll}\p{Nd},;] )\p{Lu}\p{Ll}+|(?i:" + _any(NAMES) + r"))(?![\p{L}\p{N}])"
_NUMBER = r"(?<![\p{L}\p{N}<:_])(?:(\p{Nd}+)(?:[.,](\p{Nd}+))?|(" + _any(NUMBERS) + r")(?:[\x20-](one))?)(?:\x20?(" + UNITS + r"))?(?![\p{L}\p{N}])"


def template(text: Column) -> Column:
    """Space-separated template words; a placeholder holds what it stands for behind a colon.

    A run of numbers is one slot, of its first and its last value.
    """
    # The marks of placeholders are no part of a text's own words.
    t = F.coalesce(text.cast("string"), F.lit(""))
    t = F.when(F.contains(t, F.lit("<")) | F.contains(t, F.lit(">")) | F.contains(t, F.lit(":")) | F.contains(t, F.lit("_")), F.translate(t, "<>:_", "    ")).otherwise(t)
    t = F.lower(F.regexp_replace(t, _NAME, "<name:$0>"))
    # A number without a unit leaves an empty unit slot, which both sides have.
    t = F.regexp_replace(t, _NUMBER, "<num:$1_$2$3$4> <unit:$5>")
    t = F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}<>:_%]+", " "))
    return F.regexp_replace(t, "(<num:[^>]*)> <unit:>(?: and)?(?: <num:([^>]*)> <unit:>)+", "$1_$2> <unit:>")


def _windows(width: int) -> str:
    """SQL of (pos, hash, slots) of the windows at every word of w, whose hashes are p: the last bit marks a placeholder."""
    at = [f"p[i + {k}]" for k in range(width)]
    slots = " + ".join(f"({x} & 1L)" for x in at)
    whole = f"xxhash64({width}, {', '.join(at)})"
    valued = f"xxhash64({width}, array_join(slice(w, i + 1, {width}), ' '))"
    empty = "cast(null AS array<string>)"
    marked = f"named_struct('pos', i, 'hash', if({slots} <= {width - PLAIN}L, {whole}, {valued}), 'slots', filter(slice(w, i + 1, {width}), x -> startswith(x, '<')))"
    one = f"if(({' | '.join(at)}) & 1L = 0L, named_struct('pos', i, 'hash', {whole}, 'slots', {empty}), {marked})"
    return f"if(size(w) >= {width}, transform(sequence(0, size(w) - {width}), i -> {one}), array())"


_HASHES = "transform(w, x -> if(startswith(x, '<'), xxhash64(substring_index(x, ':', 1)) | 1L, xxhash64(x) & -2L))"


def _words(rows: DataFrame, text: Column, *keep: Column) -> DataFrame:
    return rows.select(*keep, F.split(template(text), " ").alias("w")).withColumn("p", F.expr(_HASHES))


def items(benchmark: DataFrame, id_col: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(item_id, item) of each item, equal texts being one item, and (item, width, n_windows, item_pos, hash, item_slots)
    of its windows, a repeated one once. Null items and those of fewer than SHORT template words have none."""
    key = F.md5(F.col(text).cast("string"))
    named = benchmark.where(F.col(text).isNotNull()).select(F.col(id_col).alias("item_id"), key.alias("item"))
    words = _words(benchmark.where(F.col(text).isNotNull()), F.col(text), key.alias("item")).dropDuplicates(["item"])
    long = F.size("w") >= 2 * WIDTH - 1
    spread = words.select("item", F.when(long, WIDTH).otherwise(SHORT).alias("width"), F.explode(F.when(long, F.expr(_windows(WIDTH))).otherwise(F.expr(_windows(SHORT)))).alias("x"))
    first = spread.groupBy("item", "width", "x.hash").agg(F.min(F.struct("x.pos", "x.slots")).alias("f"))
    n = F.count("*").over(Window.partitionBy("item"))
    return named, first.select("item", "width", n.alias("n_windows"), F.col("f.pos").alias("item_pos"), "hash", F.col("f.slots").alias("item_slots"))


def rarest(windows: DataFrame, least: float) -> DataFrame:
    """hash, item: of each item the windows that the fewest items have, one more than a contained item can lack."""
    shared = windows.join(windows.groupBy("hash").agg(F.count("*").alias("df")), "hash")
    place = F.row_number().over(Window.partitionBy("item").orderBy("df", "hash"))
    return shared.withColumn("place", place).where(F.col("place") <= F.col("n_windows") - F.ceil(least * F.col("n_windows") - 1e-9) + 1).select("hash", "item")


def _found(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """tk (MD5 of the text), pos, hash, slots of the windows of texts whose hash an item has; written in the shared folder."""
    hashes = materialize(windows.select("width", "hash").distinct(), "item-hashes")
    widths = sorted(r.width for r in hashes.select("width").distinct().collect())
    slices = max(1, -(-hashes.count() // BROADCAST_ROWS))
    words = _words(docs, F.col(text), F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("tk"))
    arrays = F.expr(_windows(widths[0])) if len(widths) == 1 else F.concat(*[F.expr(_windows(x)) for x in widths]) if widths else F.array().cast("array<struct<pos:int,hash:bigint,slots:array<string>>>")
    spread = words.select("tk", F.explode(arrays).alias("x")).select("tk", "x.pos", "x.hash", "x.slots")
    out = None
    for i in range(slices):
        mine = hashes.where(F.pmod("hash", F.lit(slices)) == i).select("hash")
        part = materialize(spread.join(F.broadcast(mine), "hash", "left_semi").select("tk", "pos", "hash", "slots"), "found")
        out = part if out is None else out.unionByName(part)
    # Copies of a text count once.
    seen = materialize(out.dropDuplicates(["tk", "pos", "hash"]), "met")
    release(hashes)
    return seen


def verdicts(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, clash: float = 0.0, text: str = "text") -> DataFrame:
    """tk, item_id, coverage, same, slots of the texts that contain items, each text once; written in the shared folder.

    clash is the share of an item's slots that may stand for several values.
    """
    named, windows = items(benchmark)
    windows = materialize(windows, "items")
    seen = _found(docs, windows, text)
    pairs = materialize(seen.select("tk", "hash").join(rarest(windows, least), "hash").select("tk", "item").distinct(), "pairs")
    both = pairs.join(seen, "tk").join(windows.drop("width"), ["item", "hash"])
    found = materialize(both.select("tk", "item", "n_windows", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")).alias("slots")), "alignments")
    whole = found.groupBy("tk", "item").agg((F.countDistinct("item_pos") / F.max("n_windows")).alias("coverage")).where(F.col("coverage") >= least)
    # Of all alignments of an item in a text, the one that covers most of it is judged, of several the last.
    best = found.groupBy("tk", "item", "shift").agg(F.countDistinct("item_pos").alias("hit")).groupBy("tk", "item").agg(F.max_by("shift", F.struct("hit", "shift")).alias("shift"))
    slots = (
        found.join(best, ["tk", "item", "shift"], "left_semi").select("tk", "item", F.explode("slots").alias("s"))
        .groupBy("tk", "item", "s.i").agg(F.countDistinct("s.d").alias("values"), F.max(F.col("s.i") != F.col("s.d")).alias("new"))
        .groupBy("tk", "item").agg(F.count("*").alias("slots"), F.sum((F.col("values") > 1).cast("long")).alias("clash"), F.max("new").alias("new"))
    )
    judged = whole.join(slots, ["tk", "item"], "left").where(F.coalesce("clash", F.lit(0)) <= clash * F.coalesce("slots", F.lit(0)))
    out = judged.join(named, "item").select("tk", "item_id", "coverage", (~F.coalesce("new", F.lit(False))).alias("same"), F.coalesce("slots", F.lit(0)).cast("long").alias("slots"))
    out = materialize(out, "contained")
    release(windows, seen, pairs, found)
    return out


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, clash: float = 0.0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, coverage (share of the item's windows found), same (slots keep their values), slots.

    One row for each row of docs and item contained, whatever the ids: null and repeated ones are reported with
    their rows. Null and empty texts contain nothing; null items and items of fewer than SHORT template words are
    never reported; equal items are each reported. Empty tables give no rows; other columns are ignored, whatever
    their names. Very long texts are judged as a whole.
    """
    bad = verdicts(docs, benchmark, least, clash, text)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.col(text).cast("string"))).alias("tk"))
    return rows.join(_small(bad), "tk").select("doc_id", "item_id", "coverage", "same", "slots")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, clash: float = 0.0, text: str = "text") -> DataFrame:
    """The rows of docs that contain no benchmark item; null texts stay. See contaminated."""
    bad = materialize(verdicts(docs, benchmark, least, clash, text).select(F.col("tk").alias("__contaminated")).distinct(), "contaminated")
    return docs.join(_small(bad), F.unhex(F.md5(F.col(text).cast("string"))) == F.col("__contaminated"), "left_anti")
