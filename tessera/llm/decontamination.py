"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Tokens are lower-cased runs of letters and digits, each known by its 64-bit hash.
A fixed mask looks at 6 of 8 tokens and ignores the others; the hashes of all
masked places of the benchmark are joined with those of the documents.  Around a
hit the aligned tokens are compared: a document is contaminated by an item if some
``WINDOW`` aligned tokens differ in at most ``SUBSTITUTIONS``.  The two masks
together miss no such window (every choice of 2 of 13 tokens leaves one mask a
free place), so the result is that of comparing all alignments.  An item of 8 to
12 tokens must occur whole; shorter ones are too common to tell: those that
occur whole are reported in ``short_item_ids`` and contaminate nothing.

Every place carries the hashes of the 18 tokens that a window around its seed can
reach, so a hit is judged where it is found: a text is read and tokenised once, and
only (document, item, matched) is shuffled.

The benchmark's seeds are broadcast only if they take at most ``broadcast_mb``.
Beyond that both sides are shuffled by hash, first without the 18 tokens to find
the documents with a hit, then with them for those documents alone.

Edge cases: null counts as an empty text, which is clean; a very long text is
searched whole, one row of its places at a time; of equal counts of matched
tokens the count is the same, so ties need no rule; rows that share a doc_id, null
included, share the verdict that any of them earns; an empty benchmark leaves all
clean; an empty table gives no rows; other columns pass through ``clean``,
whatever their names, and are ignored by ``find``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .storage import fresh_name, persist, scratch

MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
WINDOW, SUBSTITUTIONS, SPAN = 13, 2, 8
REACH = WINDOW - SPAN
_AROUND = range(SPAN + 2 * REACH)


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashed(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, hashes of the text's tokens."""
    return rows.select(*keys, F.transform(tokens(F.col("text")), lambda x: F.xxhash64(x)).alias("words"))


def _places(rows: DataFrame, keys: list[str], around: bool, side: str) -> DataFrame:
    """A row (keys, pos, seed) for each masked place of ``words``; with
    ``around`` also the struct ``side`` of the tokens from REACH before to REACH
    after it, null where the text ends."""
    wanted = list(_AROUND) if around else [REACH + o for o in sorted({o for mask in MASKS for o in mask})]
    none = F.array_repeat(F.lit(None).cast("long"), REACH)
    padded = rows.select(*keys, F.greatest(F.size("words") - (SPAN - 1), F.lit(0)).alias("n"), F.concat(none, "words", none).alias("padded"))
    places = F.arrays_zip(*[F.slice("padded", F.lit(o + 1), F.col("n")).alias(f"{side}{o}") for o in wanted])
    # Shorter texts give no places; a filter on the size would split every text once more.
    found = padded.select(*keys, F.posexplode(places).alias("pos", "w"))
    hashes = [F.xxhash64(F.lit(k), *[F.col(f"w.{side}{REACH + o}") for o in mask]) for k, mask in enumerate(MASKS)]
    return found.select(*keys, "pos", *([F.col("w").alias(side)] if around else []), F.explode(F.array(*hashes)).alias("seed"))


def _judged(hits: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item, matched: most equal tokens in a window over the
    seed, null if no window fits; for an item of fewer than WINDOW tokens its
    size if it occurs whole.  One bit a token keeps the generated code small
    enough to be compiled."""
    same = reduce(Column.bitwiseOR, [F.when(F.col(f"d.d{o}") == F.col(f"i.i{o}"), 1 << o).otherwise(0) for o in _AROUND])
    begin = F.lit(REACH) - F.least("pos", "item_pos")
    end = F.lit(REACH) + F.least(F.col("n_doc") - F.col("pos"), F.col("n_item") - F.col("item_pos"))
    rows = hits.select("doc_id", "item_id", "n_item", same.alias("same"), begin.alias("begin"), end.alias("end"))
    windows = [F.when((F.col("begin") <= a) & (F.col("end") >= a + WINDOW), F.bit_count(F.col("same").bitwiseAND(((1 << WINDOW) - 1) << a))) for a in range(REACH + 1)]
    whole = F.bit_count("same")
    return rows.select("doc_id", "item_id", "n_item", F.when(F.col("n_item") >= WINDOW, F.greatest(*windows)).when(whole == F.col("n_item"), whole).alias("matched"))


def _links(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, broadcast_mb: float) -> DataFrame:
    """doc_id, item_id, matched: the items found in each doc_id."""
    items = _hashed(benchmark.select("item_id", "text"), "item_id").where(F.size("words") >= SPAN).withColumn("n_item", F.size("words"))
    # Written, for its size decides and it is read once or twice.
    index = persist(_places(items, ["item_id", "n_item"], True, "i").withColumnRenamed("pos", "item_pos"), "benchmark-seeds")
    bytes_of_row = 8 * (len(_AROUND) + 6)
    small = index.count() * bytes_of_row <= broadcast_mb * 2**20
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not small:
        seeds = _places(_hashed(rows, "doc_id"), ["doc_id"], False, "d").select("doc_id", "seed")
        hit = persist(seeds.join(index.select("seed").distinct(), "seed", "left_semi").select(F.col("doc_id").alias("hit_id")).distinct(), "hits")
        rows = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
    words = _hashed(rows, "doc_id").withColumn("n_doc", F.size("words"))
    judged = _judged(_places(words, ["doc_id", "n_doc"], True, "d").join(F.broadcast(index) if small else index, "seed"))
    # Filtered after the aggregation: before it the condition, with all it is made of, would move into the join.
    best = judged.groupBy("doc_id", "item_id", "n_item").agg(F.max("matched").alias("matched"))
    enough = F.when(F.col("n_item") >= WINDOW, F.lit(WINDOW - SUBSTITUTIONS)).otherwise(F.col("n_item"))
    return best.where(F.col("matched") >= enough).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def _short(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """doc_id, item_id of items of fewer than SPAN tokens that occur whole; None
    if there is no such item.  The lengths, at most seven, are known on the driver."""
    items = _hashed(benchmark.select("item_id", "text"), "item_id").where(F.size("words").between(1, SPAN - 1))
    items = persist(items.select("item_id", F.size("words").alias("n"), F.xxhash64("words").alias("key")), "short-items")
    lengths = sorted(r.n for r in items.select("n").distinct().collect())
    if not lengths:
        return None
    words = _hashed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    runs = None
    for n in lengths:
        places = F.arrays_zip(*[F.slice("words", F.lit(o + 1), F.greatest(F.size("words") - (n - 1), F.lit(0))).alias(f"w{o}") for o in range(n)])
        found = words.select("doc_id", F.explode(places).alias("w")).select("doc_id", F.lit(n).alias("n"), F.xxhash64(F.array(*[F.col(f"w.w{o}") for o in range(n)])).alias("key"))
        runs = found if runs is None else runs.union(found)
    return runs.join(items, ["n", "key"]).select("doc_id", "item_id").distinct()


def find(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_mb: float = 64) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, matched (most equal tokens in a
    window, null if clean) and short_item_ids of every row of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        links = keep(_links(docs, benchmark, id_col, text_col, broadcast_mb), "links")
    found = links.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("matched").alias("matched")).withColumnRenamed("doc_id", "hit_id")
    rows = docs.select(F.col(id_col).alias("doc_id")).join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left")
    none = F.array().cast(found.schema["item_ids"].dataType)
    short, short_ids = _short(docs, benchmark, id_col, text_col), none
    if short is not None:
        lists = short.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("short_ids")).withColumnRenamed("doc_id", "short_id")
        rows, short_ids = rows.join(lists, F.col("doc_id").eqNullSafe(F.col("short_id")), "left"), F.coalesce("short_ids", none)
    return rows.select("doc_id", F.col("matched").isNotNull().alias("contaminated"), F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.col("matched").cast("long").alias("matched"), short_ids.alias("short_item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_mb: float = 64) -> DataFrame:
    """The rows of ``docs`` without a benchmark item, with all their columns."""
    # Written, so that its size is known before the texts would be shuffled to join it.
    with scratch(docs.sparkSession) as keep:
        bad = keep(_links(docs, benchmark, id_col, text_col, broadcast_mb).select(F.col("doc_id").alias(fresh_name(docs, "bad_id"))).distinct(), "bad")
    return docs.join(bad, docs[id_col].eqNullSafe(bad[bad.columns[0]]), "left_anti")
