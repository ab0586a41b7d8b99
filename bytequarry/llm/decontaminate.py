"""Benchmark decontamination by template canonicalisation. DataFrame functions only.

Numbers, units after numbers, and names become typed placeholders. The hashes of all windows of WINDOW template tokens of a
document are joined with those of the benchmark's items. Matches of a document, an item and a distance between their
places (a shift) are one alignment. An alignment counts if the places of the item that its windows cover are enough and if its
slots are consistent: there, equal slot values of the item stand for equal values of the document, and the other way
round. Places between its windows differ from the item and don't count. So re-parameterised questions are caught as well. Inserted or deleted tokens change the shift: shifts at most BAND apart are also taken together, each place of the
item at the shift of its longest run. Where runs meet, a slot may be cut off ('Anna' and 'Anna Maria') and isn't compared.
QUOTE equal plain words in a row count by themselves.

Items of fewer than WINDOW tokens are compared as a whole with the windows of their length, in the same pass; those of fewer
than LEAST_TOKENS occur in any prose and match only a document that consists of nothing else. An item's first token
matches as a word and, if it is capitalised, as a name.

Defined cases: a null or empty text has no windows and is clean; null or empty items match nothing; a row without id has no
result in `leaks` and stays in `clean`; repeated documents each get a result; repeated items are reported by each of their
ids; empty tables have no leaks; further columns are left out, and kept by `clean` whatever their names. The tokens of a
very long text take about 100 bytes of memory each while they are one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 8
#: An alignment counts from this share of the item's tokens on, or from so many tokens.
COVER, LONG_RUN = 0.6, 25
#: Tokens of an alignment that aren't placeholders, at least, so that templates alone don't match; not asked of verbatim copies.
LEAST_WORDS = 4
#: Tokens of an item that may be found within other text, at least.
LEAST_TOKENS = 4
#: Shifts up to so far apart are joined; so many plain words in a row are a quote.
BAND, QUOTE = 8, 13
#: Benchmark windows up to which they are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Units that count as such after a number.
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "ml", "l", "s", "sec", "min", "h", "hr", "hours", "minutes", "seconds", "days", "weeks", "months", "years", "meters", "metres", "kilometers", "miles", "feet", "inches", "pounds", "ounces", "grams", "kilograms", "liters", "litres", "dollars", "euros", "cents", "percent", "degrees", "mph", "kmh", "usd", "eur")

NUMBER, UNIT, NAME = "\u0001num", "\u0001unit", "\u0001name"


def tokens(text: Column) -> Column:
    """Words, numbers and marked names (a capitalised word right after a word or comma) in order, as written."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=[\p{Ll},;] )(?=\p{Lu}\p{Ll})", "\u0001")
    return F.regexp_extract_all(marked, F.lit(r"\u0001?[\p{L}\p{M}]+|\p{N}+(?:[.,]\p{N}+)*"), 0)


def template(raw: Column) -> Column:
    """Tokens to template tokens."""
    units = F.array(*map(F.lit, UNITS))

    def one(t: Column, i: Column) -> Column:
        before = F.get(raw, i - 1)
        return F.when(t < "\u0002", NAME).when((t >= "0") & (t < ":"), NUMBER).when((before >= "0") & (before < ":") & F.array_contains(units, F.lower(t)), UNIT).otherwise(F.lower(t))

    return F.transform(raw, one)


def hashes(raw: Column) -> Column:
    return F.transform(template(raw), lambda t: F.xxhash64(t))


def windows(df: DataFrame, column: str, size: int) -> DataFrame:
    """`column`, an array of token hashes, becomes the array of the hashes of its windows of `size` tokens.

    Doubling: the hash of 2k tokens comes from those of k and of the k after; so a window takes log2(size) steps.
    """
    width = 1
    steps = []
    while width < size:
        steps.append(min(width, size - width))
        width += steps[-1]
    for k in steps:
        cur, shift = F.col(column), k
        df = df.withColumn(column, F.when(F.size(cur) > shift, F.zip_with(F.slice(cur, 1, F.size(cur) - shift), F.slice(cur, shift + 1, F.size(cur) - shift), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))
    return df


def exploded(df: DataFrame, ids: list[str], sizes: list[int]) -> DataFrame:
    """ids, at, key and size of the windows of each of the sizes; h: token hashes. The rows are read once."""
    if len(sizes) == 1:
        made = windows(df.select(*ids, "h"), "h", sizes[0]).withColumn("h", common.settled(F.col("h")))
        return made.select(*ids, F.posexplode("h").alias("at", "key"), F.lit(sizes[0]).alias("size"))
    df = df.select(*ids, common.settled(F.col("h")).alias("h"))
    cells = []
    for size in sizes:
        df = windows(df.withColumn(f"h{size}", F.col("h")), f"h{size}", size)
        cells.append(F.transform(F.col(f"h{size}"), lambda key, at: F.struct(at.alias("at"), key.alias("key"), F.lit(size).alias("size"))))  # noqa: B023  called at once
    made = df.select(*ids, common.settled(F.concat(*cells)).alias("cells"))
    return made.select(*ids, F.explode("cells").alias("cell")).select(*ids, "cell.*")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cover: float = COVER, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, from, to (token places in the document), n_tokens and slots of every alignment that counts."""
    raw_docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL").select("doc_id", common.settled(tokens(F.col("text"))).alias("raw"))
    items = common.materialize(benchmark.select(F.col(item_id).alias("item_id"), common.settled(tokens(F.col(text))).alias("item_raw")).withColumn("h", hashes(F.col("item_raw"))).where(F.size("h") > 0), "benchmark")
    hashed_docs = raw_docs.select("doc_id", F.size("raw").alias("doc_tokens"), hashes(F.col("raw")).alias("h"))
    short = [r[0] for r in items.where(F.size("h") < window).select(F.size("h")).distinct().collect()]  # at most window - 1 sizes
    sizes, keys = [window, *sorted(short, reverse=True)], None
    for size in sizes:
        own = items.where(F.size("h") >= window if size == window else F.size("h") == size)
        first = own.where(F.get("item_raw", F.lit(0)).rlike(r"^\p{Lu}\p{Ll}")).withColumn("h", F.concat(F.array(F.xxhash64(F.lit(NAME))), F.slice("h", 2, F.size("h"))))
        plain, named = (exploded(x.select("item_id", F.size("h").alias("length"), "h"), ["item_id", "length"], [size]).withColumnRenamed("at", "item_at") for x in (own, first))
        part = plain.unionByName(named.where("item_at = 0"))
        keys = part if keys is None else keys.unionByName(part)
    # beyond the bound both sides are dealt by (key, size), and adaptive execution splits a key that many documents hold
    found = exploded(hashed_docs, ["doc_id", "doc_tokens"], sizes).join(common.few(keys.distinct(), MOST_BROADCAST), ["key", "size"])
    found = found.where((F.col("length") >= LEAST_TOKENS) | (F.col("doc_tokens") == F.col("length")))
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    runs = found.groupBy("doc_id", "item_id", "length", "size", shift).agg(F.sort_array(F.collect_set("item_at")).alias("ats"))
    runs = common.materialize(runs.withColumn("parts", parts(F.col("ats"), F.col("size"), F.col("shift"))).drop("ats"), "runs")
    covered = F.aggregate("parts", F.lit(0), lambda n, x: n + x["n"])  # runs of one shift never meet
    enough = (covered >= F.ceil(cover * F.col("length"))) | (covered >= LONG_RUN)
    inside = F.flatten(F.transform("parts", lambda x: F.sequence(x["lo"], x["hi"] - 1)))
    one = F.transform(inside, lambda p: F.struct(p.alias("p"), F.col("shift").alias("shift"), F.lit(False).alias("joint")))
    single = runs.withColumn("enough", enough).where(F.col("enough") | F.exists("parts", lambda x: x["n"] >= QUOTE)).select("doc_id", "item_id", one.alias("places"), "enough")
    band = F.floor(F.col("shift") / BAND)
    chains = runs.withColumn("band", F.explode(F.array(band, band - 1))).groupBy("doc_id", "item_id", "length", "band").agg(F.flatten(F.collect_list("parts")).alias("parts"), F.countDistinct("shift").alias("n_shifts")).where("n_shifts > 1")
    chains = chains.withColumn("places", common.settled(joined_places(F.col("parts"), F.col("length"))))
    chains = chains.where((F.size("places") >= F.ceil(cover * F.col("length"))) | (F.size("places") >= LONG_RUN)).select("doc_id", "item_id", "places", F.lit(True).alias("enough"))
    alignments = common.materialize(single.unionByName(chains), "alignments")
    few = alignments.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).head()[0] <= MOST_BROADCAST
    suspects = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if not few:  # only the texts that are needed are shuffled
        ids = common.materialize(alignments.select("doc_id").distinct(), "suspects")
        suspects = suspects.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_semi")
    sources = items.select("item_id", "item_raw")
    aligned = suspects.join(F.broadcast(alignments) if few else alignments, "doc_id").join(F.broadcast(sources) if items.count() <= MOST_BROADCAST // 50 else sources, "item_id").withColumn("raw", common.settled(tokens(F.col("text")))).drop("text")
    aligned = aligned.withColumn("kinds", common.settled(template(F.col("item_raw"))))

    def cell(x: Column) -> Column:
        ours = F.get("raw", (x["p"] + x["shift"]).cast("int"))
        kind = F.get("kinds", x["p"])
        value = lambda t: F.lower(F.translate(t, "\u0001", ""))
        slot = (kind < "\u0002") | ((x["p"] == 0) & (ours < "\u0002"))
        return F.struct(value(F.get("item_raw", x["p"])).alias("a"), value(ours).alias("b"), slot.alias("slot"), x["joint"].alias("joint"))

    aligned = aligned.withColumn("cells", common.settled(F.transform("places", cell))).where(~F.exists("cells", lambda c: c["b"].isNull())).drop("raw", "kinds")
    pairs = F.filter("cells", lambda c: c["slot"] & ~c["joint"])
    slots = F.array_distinct(F.transform(pairs, lambda c: F.struct(c["a"], c["b"])))
    values = F.array_distinct(F.transform(pairs, lambda c: c["a"]))
    ours = F.array_distinct(F.transform(pairs, lambda c: c["b"]))
    words = F.size(F.filter("cells", lambda c: ~c["slot"]))
    verbatim = F.forall("cells", lambda c: ~c["slot"] | (c["a"] == c["b"]))
    whole = F.col("enough") & (F.size(slots) == F.size(values)) & (F.size(slots) == F.size(ours)) & ((words >= LEAST_WORDS) | (words >= F.size("item_raw")) | verbatim)
    checked = aligned.where(whole | (longest_quote(F.col("cells")) >= QUOTE))
    ends = F.transform("places", lambda x: x["p"] + x["shift"])
    return checked.select("doc_id", "item_id", F.array_min(ends).cast("long").alias("from"), (F.array_max(ends) + 1).cast("long").alias("to"), F.size("places").cast("long").alias("n_tokens"), F.size(values).cast("long").alias("slots")).distinct()


def parts(ats: Column, size: Column, shift: Column) -> Column:
    """The unbroken runs of windows that begin at `ats` (ascending): n (tokens), shift, lo and hi."""
    los = F.filter(ats, lambda a, i: F.coalesce(F.get(ats, i - 1) < a - 1, F.lit(True)))
    his = F.filter(ats, lambda a, i: F.coalesce(F.get(ats, i + 1) > a + 1, F.lit(True)))
    return F.zip_with(los, his, lambda a, b: F.struct((b + size - a).alias("n"), shift.alias("shift"), a.alias("lo"), (b + size).alias("hi")))


def joined_places(runs: Column, length: Column) -> Column:
    """Each place of the item that a run covers, at the shift of its longest run, and whether the run ends beside it."""
    owner = F.transform(F.sequence(F.lit(0), length - 1), lambda p: F.struct(p.alias("p"), F.array_max(F.filter(runs, lambda r: (r["lo"] <= p) & (p < r["hi"])))["shift"].alias("shift")))
    beside = lambda x, p: F.coalesce(F.get(x, p)["shift"], F.lit(-(2**31)))

    def marked(got: Column) -> Column:
        return F.transform(got, lambda o, i: F.struct(o["p"].alias("p"), o["shift"].alias("shift"), ((beside(got, i - 1) != o["shift"]) | (beside(got, i + 1) != o["shift"])).alias("joint")))

    # an array of one array: the owners are computed once
    return F.filter(F.get(F.transform(F.array(owner), marked), F.lit(0)), lambda o: o["shift"].isNotNull())


def longest_quote(cells: Column) -> Column:
    """Tokens of the longest stretch of equal words, without slots."""

    def step(s: Column, c: Column) -> Column:
        n = F.when(~c["slot"] & (c["a"] == c["b"]), s["n"] + 1).otherwise(0)
        return F.struct(n.alias("n"), F.greatest(s["best"], n).alias("best"))

    return F.aggregate(cells, F.struct(F.lit(0).alias("n"), F.lit(0).alias("best")), step, lambda s: s["best"])


def leaked_ids(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id of every document with a leak, once, its number of items and the first of them."""
    return leaks(docs, benchmark, **options).groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"), F.max("n_tokens").alias("n_tokens"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents without a leak, their columns as they were."""
    own = common.fresh(docs, "leaked_id")
    bad = common.materialize(leaked_ids(docs, benchmark, doc_id=doc_id, **options).select(F.col("doc_id").alias(own)), "leaked")
    return docs.join(common.few(bad, MOST_BROADCAST), docs[doc_id] == bad[own], "left_anti").select(*docs.columns)


def op8_decontaminate(spark, sf_dir):
    docs, benchmark = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark")
    found = common.materialize(leaked_ids(docs, benchmark), "leaked")
    joined = docs.select("doc_id").join(F.broadcast(found) if found.count() <= MOST_BROADCAST else found, "doc_id", "left")
    return joined.select("doc_id", F.col("n_items").isNotNull().alias("leaked"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("first_item", F.lit(-1)).alias("first_item"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
