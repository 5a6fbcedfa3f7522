"""Near duplicates by improved consistent weighted sampling (ICWS).

A document is the weighted set of its shingles of five words (of all its words
if it has fewer).  A shingle weighs its count in the document times the smooth
inverse document frequency ``1 + SPAN * min(1, log(N / df) / log(1 / RARE))``, from 1
for one that all documents have to 2 for one in at most 0.1 % of them.  The
logarithm is scaled by its largest value, for a bare one lets the near copies of a
text that a third of all documents repeat fall apart: their edits, rare beside
their own shingles, would weigh four times as much.  Shingles in at least
``RARE * N`` documents are counted exactly over all documents: a run of rows
passes on the shingles that are in half that share of it, so none can be missed
(a shingle that frequent overall is as frequent in some run), then the candidates
are counted.  Their number is at most shingles-per-document / RARE whatever N is,
so they can be broadcast.

ICWS draws for every sample one shingle with its level, equal in two documents
with the probability of their weighted Jaccard similarity.  ``BANDS`` groups of
``ROWS`` samples are hashed: two documents with a similarity of 0.8 share a group
with a probability of 0.999.  Links are found in three steps, however large a
group is, and each link is verified by the weighted Jaccard similarity of the
whole texts:

1. In every group all documents are compared with two of them: that with the most
   company in all its groups, and one by chance.  A group of copies costs two
   rows for each member and not a pair for each two.
2. The documents of groups that this leaves in several components are joined by
   prefix: shingles rare among them come first, and two similar documents share
   one while enough weight is left in both to be similar (``_prefixes``).  Of two
   components the most promising pairs are compared first.
3. All pairs of that join that are still unconnected are compared.

Documents that share most of a template but not 0.8 of their weight end in step 2:
what is left of them from the first shared shingle on is too little for a pair.
Classes are the connected components.  Exact copies are put together first and
stand for one document.

Edge cases: null counts as an empty text; texts without a word aren't copies of
anything and stay a class each; very long texts are compared whole, and fewer of
them meet in one task; repeated rows and doc_ids fall together; equal rank of two
documents is decided by the smaller doc_id; null doc_ids take no part and get a
null class; an empty table gives no rows; other columns pass through
``keep_first``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .storage import fresh_name, persist, release, scratch
from .textbatch import TextSlice, mix, slices

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 14, 4
RARE = 1e-3
SPAN = 1.0
#: A task compares documents in blocks of at most this many, and of this many shingles unless one has more.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
_RUN = 2_000_000
_U = np.uint64


def shingles(s: TextSlice, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: their text, hash and count."""
    at = s.window_starts(k)
    hashes, owner = s.window_hash(at, k), s.word_text[at] if len(at) else at
    short = np.flatnonzero((s.n_words > 0) & (s.n_words < k))
    for n in range(1, k) if len(short) else ():
        few = short[s.n_words[short] == n]
        hashes = np.concatenate([hashes, s.run_hash(n)[s.word_offsets[:-1][few]]])
        owner = np.concatenate([owner, few])
    # By text, then by the upper 44 bits of the hash: one integer sorts far faster than two keys.
    order = np.argsort((owner.astype(_U) << _U(44)) | (hashes >> _U(20)))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    return owner[begin], hashes[begin], np.diff(np.append(begin, len(hashes)))


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and document counts of the shingles in at least
    ``RARE * n`` of the n texts."""
    least = max(1.0, RARE * n)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush(n: int) -> pa.RecordBatch:
            """The first n slices; the rest stay, so that no run is short."""
            nonlocal held, size
            now, held = held[:n], held[n:]
            size -= sum(len(h) for _, h in now)
            seen = sum(k for k, _ in now)
            found, times = np.unique(np.concatenate([h for _, h in now]), return_counts=True)
            good = times >= RARE * seen / 2
            return pa.RecordBatch.from_arrays([pa.array(found[good].view(np.int64)), pa.array(times[good].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for _, s in slices(batch):
                hashes = shingles(s)[1]
                held.append((s.n, hashes))
                size += len(hashes)
                if size >= 2 * _RUN and len(held) > 1:
                    yield flush(max(1, len(held) // 2))
        if held:
            yield flush(len(held))

    texts = docs.select("text")
    # Runs of too few documents would pass on nearly all they hold.
    runs = texts.coalesce(max(1, int(RARE * n / 5)))
    # A shingle that passes was in half the share of runs whose counts are here; the rest can add less than the other half.
    near = runs.mapInArrow(local, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least / 2)
    candidates = np.sort(near.select("h").toArrow().column("h").combine_chunks().to_numpy().view(_U))
    if not len(candidates):
        return candidates, np.zeros(0)
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        totals = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, s in slices(batch):
                hashes = shingles(s)[1]
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                totals += np.bincount(at[known[at] == hashes], minlength=len(known))
        index = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(totals[index])], ["i", "n"])

    exact = texts.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    index, counts = exact.column("i").to_numpy(), exact.column("n").to_numpy()
    order = np.argsort(index)
    return candidates[index[order]], counts[order].astype(float)


class Weights:
    """Weight of a shingle, from the counts of the frequent ones."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int):
        self.hashes = hashes
        idf = np.log(max(1, n) / np.maximum(1.0, counts)) / np.log(1 / RARE)
        self.weight = 1 + SPAN * np.clip(idf, 0, 1)

    def of(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), 1 + SPAN)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == hashes
            out[hit] = self.weight[at[hit]]
        return out * times


def _gamma_table(bits: int) -> np.ndarray:
    """Values of a Gamma(2, 1) variable at evenly spaced probabilities; its
    distribution function is 1 - (1 + x) exp(-x)."""
    x = np.linspace(0, 40, 400_001)
    p = (np.arange(1 << bits) + 0.5) / (1 << bits)
    return np.interp(p, 1 - (1 + x) * np.exp(-x), x)


_R = _gamma_table(12).astype(np.float32)
_LOG_C = np.log(_gamma_table(16)).astype(np.float32)


def sample(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, count: int) -> np.ndarray:
    """``count`` ICWS samples of each of n texts, as 32-bit hashes of the drawn
    shingle and its level.  owner is in order; texts without shingles get 0."""
    out = np.zeros((n, count), np.uint32)
    if not len(owner):
        return out
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    which = owner[begin]
    log_w = np.log(weights).astype(np.float32)
    for k in range(count):
        h = mix(hashes + _U(k * 0xA0761D6478BD642F % (1 << 64)))
        r = _R[(h >> _U(52)).astype(np.intp)]
        log_c = _LOG_C[(h >> _U(36)).astype(np.intp) & 0xFFFF]
        beta = (h >> _U(12) & _U(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
        level = np.floor(log_w / r + beta)
        value = log_c - r * (level - beta + 1)
        # The least value and what drew it, in one integer: floats in their order above, a hash below.
        bits = value.view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(_U)
        drawn = mix(hashes ^ (level.astype(np.int64).view(_U) << _U(40))) & _U(0xFFFFFFFF)
        out[which, k] = np.minimum.reduceat(ordered << _U(32) | drawn, begin).astype(np.uint32)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two weighted sets, hashes in order."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    hit = hb[at] == ha
    shared = float(np.minimum(wa[hit], wb[at[hit]]).sum())
    return shared / (float(wa.sum()) + float(wb.sum()) - shared)


def _verified(docs: DataFrame, dealt: DataFrame, shared) -> DataFrame:
    """a, b of the pairs in (key, a, b) that are similar.

    Texts go to a key once each.  A task holds the left documents of one key and
    streams the right ones past them, each with the list of those it asks for.
    """
    right = dealt.groupBy("key", F.col("b").alias("id")).agg(F.collect_set("a").alias("asks")).withColumn("side", F.lit(1))
    left = dealt.select("key", F.col("a").alias("id")).distinct().select("key", "id", F.lit(None).cast("array<long>").alias("asks"), F.lit(0).alias("side"))
    texts = docs.join(left.union(right), docs.doc_id == F.col("id")).select("key", "side", "id", "asks", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}  # the texts of each left document: a doc_id may have several
        for batch in batches:
            for part, s in slices(batch):
                keys, sides, ids, asks = (part.column(i).to_pylist() for i in range(4))
                owner, hashes, times = shingles(s)
                weights = shared.value.of(hashes, times)
                cut = np.searchsorted(owner, np.arange(s.n + 1))
                found = set()
                for i in range(s.n):
                    if keys[i] != key:
                        key, held = keys[i], {}
                    own = (hashes[cut[i] : cut[i + 1]], weights[cut[i] : cut[i + 1]])
                    if sides[i] == 0:
                        held.setdefault(ids[i], []).append((own[0].copy(), own[1].copy()))
                    else:
                        found.update((a, ids[i]) for a in asks[i] if any(similarity(x, own) >= SIMILAR for x in held[a]))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

    return texts.repartition("key").sortWithinPartitions("key", "side", "id").mapInArrow(compare, "a long, b long")


def _stars(groups: DataFrame) -> DataFrame:
    """(key, a, b) for groups (g, doc_id, n) of n documents: each member b with
    the member that has the most company in all its groups, and with one by chance."""
    company = groups.groupBy("doc_id").agg(F.sum("n").alias("company"))
    ranked = groups.join(company, "doc_id")
    chance = F.xxhash64("doc_id", "g")
    centres = persist(ranked.groupBy("g").agg(F.max_by("doc_id", F.struct("company", -F.col("doc_id"))).alias("most"), F.min_by("doc_id", F.struct(chance, "doc_id")).alias("any")), "centres")
    pairs = groups.join(centres, "g").select(F.explode(F.array("most", "any")).alias("a"), F.col("doc_id").alias("b"), "n").where("a <> b")
    # Pairs of small groups come from either side; the number of a centre's parts follows its largest group.
    pairs = pairs.groupBy("a", "b").agg(F.max("n").alias("n"))
    return pairs.select(F.xxhash64("a", "n", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK))).alias("key"), "a", "b")


def _open(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, root) of the documents in groups with more than one component."""
    named = persist(groups.join(roots, groups.doc_id == roots.vertex, "left").select("g", "doc_id", F.coalesce("root", "doc_id").alias("root")), "named")
    several = persist(named.groupBy("g").agg((F.min("root") < F.max("root")).alias("open")).where("open").select("g"), "open")
    return persist(named.join(several, "g").select("doc_id", "root").distinct(), "left")


def _prefixes(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, h, p, w): shingles by which similar documents must meet.

    In order of their number among the documents, rare first, p is the weight
    before the shingle and w that of the whole text.  If two texts are similar,
    the weight that they share is at least t / (1 + t) of the sum of theirs for
    t = SIMILAR, and all of it comes from their first shared shingle on.  So that
    one has p <= (1 - t) * w in both, and p <= (1 - t) / (1 + t) * w in the lighter.
    """

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, s in slices(batch):
                owner, hashes, times = shingles(s)
                weights, take = shared.value.of(hashes, times), pa.array(owner)
                whole = np.bincount(owner, weights, minlength=s.n)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(2)), pa.array(hashes.view(np.int64)), pa.array(weights), pa.array(whole[owner])], ["doc_id", "t", "h", "x", "w"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(weigh, "doc_id long, t long, h long, x double, w double")
    rows = persist(rows, "weighed")
    counts = persist(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "counted")
    # Those that one text has come first in the order and meet nothing: their weight is what the others leave.
    own = Window.partitionBy("doc_id", "t")
    p = F.col("w") - F.sum("x").over(own) + F.sum("x").over(own.orderBy("n", "h").rowsBetween(Window.unboundedPreceding, 0)) - F.col("x")
    out = rows.join(counts, "h").select("doc_id", "h", "w", p.alias("p")).where(F.col("p") <= (1 - SIMILAR + 1e-6) * F.col("w"))
    return persist(out, "prefixes")


def _candidates(prefixes: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b, their roots ra, rb and weights wa, wb, and the similarity that
    their prefixes allow, for the pairs of different roots that can be similar."""
    rows = prefixes.join(roots, prefixes.doc_id == roots.vertex, "left").select("h", "doc_id", F.coalesce("root", "doc_id").alias("root"), "p", "w")
    rows = rows.withColumn("strong", F.col("p") <= ((1 - SIMILAR) / (1 + SIMILAR) + 1e-6) * F.col("w"))
    tallies = rows.groupBy("h", "root").agg(F.count("*").alias("n"), F.max("strong").alias("strong"))
    keys = tallies.groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.min("root") < F.max("root")).alias("several"), F.max("strong").alias("any"))
    keys = persist(keys.where("several and any").select("h", "main"), "keys")
    # Within the most frequent component of a shingle no pair is wanted, so only the others lead.
    rows = persist(rows.join(keys, "h").withColumn("leads", F.col("root") != F.col("main")), "keyed")
    left = rows.where("strong").select("h", "leads", F.col("doc_id").alias("a"), F.col("root").alias("ra"), F.col("p").alias("pa"), F.col("w").alias("wa"))
    right = rows.select("h", "leads", F.col("doc_id").alias("b"), F.col("root").alias("rb"), F.col("p").alias("pb"), F.col("w").alias("wb"))
    shared = F.least(F.col("wa") - F.col("pa"), F.col("wb") - F.col("pb"))
    bound = shared / (F.col("wa") + F.col("wb") - shared)
    fits = (F.col("ra") != F.col("rb")) & (F.col("wa") <= F.col("wb") * (1 + 1e-9)) & (bound >= SIMILAR * (1 - 1e-6))
    both = left.where("leads").drop("leads").join(right.drop("leads"), "h").union(left.where("not leads").drop("leads").join(right.where("leads").drop("leads"), "h"))
    return both.where(fits).select("a", "b", "ra", "rb", "wa", "wb", bound.alias("bound"))


def _blocks(pairs: DataFrame) -> DataFrame:
    """(key, a, b) of candidates: pairs of the component that has the most of
    them go by blocks of its documents and blocks of their partners."""
    pairs = persist(pairs, "pairs")
    number = persist(pairs.select(F.explode(F.array("ra", "rb")).alias("root")).groupBy("root").agg(F.count("*").alias("n")), "number")
    ranked = pairs.join(number.select(F.col("root").alias("ra"), F.col("n").alias("na")), "ra").join(number.select(F.col("root").alias("rb"), F.col("n").alias("nb")), "rb")
    swap = F.struct("na", "ra") > F.struct("nb", "rb")
    # From here on b is of the component that has the most pairs, the hub.
    turned = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(z) for x, y, z in (("a", "b", "a"), ("b", "a", "b"), ("wa", "wb", "wa"), ("wb", "wa", "wb"), ("rb", "ra", "hub"))]
    turned = persist(ranked.select(*turned), "turned")

    def parts(side: str, weight: str, name: str) -> DataFrame:
        each = turned.groupBy("hub", side).agg(F.max(weight).alias("w"))
        return each.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("w") / BLOCK_SHINGLES)).alias(name))

    sizes = persist(parts("a", "wa", "left").join(parts("b", "wb", "right"), "hub"), "sizes")
    key = F.xxhash64("hub", F.pmod(F.xxhash64("a"), "left"), F.lit(1), F.pmod(F.xxhash64("b"), "right"))
    return turned.join(sizes, "hub").select(key.alias("key"), "a", "b")


def _links(docs: DataFrame, groups: DataFrame, shared) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of groups (g, doc_id, n), as the module's text says, and
    fewer links with the same components: those found last and the stars of the rest."""
    spark = docs.sparkSession
    found = persist(_verified(docs, _stars(groups), shared), "links-a")
    roots = persist(components(found), "roots")
    stars = roots.select(F.col("vertex").alias("a"), F.col("root").alias("b"))
    left = _open(groups, roots)
    if left.isEmpty():
        return found, stars
    release(spark)
    prefixes = _prefixes(docs.join(left.select("doc_id").hint("merge"), "doc_id", "left_semi"), shared)
    pairs = _candidates(prefixes, roots)
    two = (F.least("ra", "rb").alias("r"), F.greatest("ra", "rb").alias("s"), F.pmod(F.xxhash64("a", "b"), F.lit(4)).alias("k"))
    best = pairs.groupBy(*two).agg(F.max_by(F.struct("a", "b", "ra", "rb", "wa", "wb"), F.struct("bound", "a", "b")).alias("x")).select("x.*").distinct()
    more = persist(_verified(docs, _blocks(best), shared), "links-b")
    release(spark)
    roots = persist(components(stars.union(more)), "roots")
    stars = roots.select(F.col("vertex").alias("a"), F.col("root").alias("b"))
    rest = _candidates(prefixes, roots).select("a", "b", "ra", "rb", "wa", "wb").distinct()
    last = persist(_verified(docs, _blocks(rest), shared), "links-c")
    release(spark)
    return found.union(more).union(last), stars.union(last)


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and n_links of every row.

    n_links is the number of verified links that the document has: texts that it
    was compared with and found similar, and for a copy of an equal text the link
    to the least doc_id with it.  Pairs that other links connect are not compared.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with scratch(spark) as keep:
        known = rows.where("doc_id is not null")
        n = docs.count()
        hashes, counts = _frequent(rows, n)
        shared = spark.sparkContext.broadcast(Weights(hashes, counts, n))

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, s in slices(batch):
                    owner, found, times = shingles(s)
                    drawn = sample(owner, found, shared.value.of(found, times), s.n, BANDS * ROWS)
                    bands = np.zeros((s.n, BANDS), _U)
                    for b in range(BANDS):
                        for r in range(ROWS):
                            bands[:, b] = mix(bands[:, b] + drawn[:, b * ROWS + r].astype(_U) + _U(b + 1))
                    flat = pa.array(bands.reshape(-1).view(np.int64))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(s.n + 1, dtype=np.int32) * BANDS), flat)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s.n_words > 0), lists], ["doc_id", "content", "worded", "bands"])

        signed = known.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content"), "text").mapInArrow(sign, "doc_id long, content binary, worded boolean, bands array<long>")
        signed = persist(signed, "signed")
        copies = persist(signed.where("worded").groupBy("content").agg(F.min("doc_id").alias("rep")), "reps")
        member = persist(signed.where("worded").select("doc_id", "content").join(copies, "content").select("doc_id", "rep").distinct(), "copies")
        one = signed.where("worded").join(copies, (signed.content == copies.content) & (signed.doc_id == copies.rep), "left_semi").dropDuplicates(["doc_id", "content"])
        groups = one.select("doc_id", F.posexplode("bands").alias("band", "h")).select("doc_id", F.xxhash64("band", "h").alias("g"))
        several = persist(groups.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "several")
        groups = persist(groups.join(several, "g").distinct(), "groups")
        # These doc_ids grow with the corpus, so the plan is the one for large tables at every size.
        texts = persist(known.join(groups.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"), "texts")
        release(spark)
        links, fewer = _links(texts, groups, shared)
        # A doc_id with several texts links their classes.
        same = member.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        roots = keep(components(fewer.union(same)), "roots")
        ends = links.union(same).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count("*").alias("n_links"))
        ends = keep(ends, "ends")
    out = rows.select("doc_id").join(roots, rows.doc_id == roots.vertex, "left").join(ends, F.col("doc_id") == F.col("v"), "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class, that of its least doc_id, with all columns; of
    rows that share that doc_id, one.  Rows with a null doc_id stay."""
    found = persist(classes(docs, id_col=id_col, text_col=text_col), "classes")
    gone = persist(found.where("doc_id <> class_id").select(F.col("doc_id").alias(fresh_name(docs, "gone"))).distinct(), "gone")
    left = docs.join(gone, docs[id_col] == gone[gone.columns[0]], "left_anti")
    again = persist(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias(fresh_name(docs, "again"))), "again")
    if again.isEmpty():
        return left
    same = left[id_col] == again[again.columns[0]]
    return left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates([id_col]))
