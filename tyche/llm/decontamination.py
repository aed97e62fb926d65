"""Benchmark decontamination with spaced seeds.

Words are the lower-cased runs of letters and digits. Fixed masks select five of up to eleven consecutive words and
ignore the others; their hashes at every position of the benchmark are joined with those at every third position of
the documents. A hit puts document and item on a diagonal, along which the words are compared: it is a leak if some
``window`` aligned words (all, of an item shorter than that) differ in at most ``subs`` of them.

The three masks below together find every window of 13 words with up to two substitutions, wherever it starts
(``tests/llm`` checks all placements). An item of fewer words is cut into one run more than it may have substitutions,
so that one of the runs is unchanged; these are hashed at every position of the documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import kept

#: The masks as (offset, number of words) of their two selected runs, and the distance of hashed document positions.
MASKS = (((0, 3), (6, 2)), ((0, 3), (9, 2)), ((0, 3), (3, 2)))
STRIDE, WINDOW, SUBS = 3, 13, 2
#: Items of fewer words are not looked for, unless all are wanted.
SHORTEST = 5
#: Test hashes, and hits, up to this number (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def hashed(tokens: Column) -> Column:
    """Each word's hash: what seeds are made of, so that a word is read once."""
    return F.transform(tokens, lambda w: F.xxhash64(w))


def hashed_at(starts: Column, name: str, seed: Callable[[Column], Column]) -> Column:
    """``array<struct<name, seed>>`` for each of ``starts``; empty for none."""
    found = F.transform(starts, lambda i: F.struct(i.alias(name), seed(i).alias("seed")))
    return F.coalesce(found, F.array().cast(f"array<struct<{name}:int,seed:bigint>>"))


def seeds(tokens: Column, stride: int) -> Column:
    """``array<struct<pos, seed>>`` over all masks."""

    def masked(number: int) -> Column:
        runs = MASKS[number]
        last = F.size(tokens) - (runs[-1][0] + runs[-1][1])
        starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride)))
        return hashed_at(starts, "pos", lambda i: F.xxhash64(F.lit(number), *(F.get(tokens, i + at + k) for at, n in runs for k in range(n))))

    return F.concat(*map(masked, range(len(MASKS))))


def allowed(n: int) -> int:
    """Substitutions in an item of ``n`` words, in proportion to those of a window."""
    return min(SUBS, n * SUBS // WINDOW)


def runs(n: int, subs: int) -> list[tuple[int, int]]:
    """Place and length of the runs that ``n`` words are cut into, one more than ``subs``."""
    cuts = [n * k // (subs + 1) for k in range(subs + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def run_seed(tokens: Column, start: Column, n: int) -> Column:
    return F.xxhash64(F.lit(-n), F.slice(tokens, start + 1, F.lit(n)))


def run_seeds(tokens: Column, lengths: list[int]) -> Column:
    """``array<struct<pos, seed>>`` over all runs of these lengths."""
    starts = lambda n: F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n))
    return F.concat(*(hashed_at(starts(n), "pos", partial(lambda n, i: run_seed(tokens, i, n), n)) for n in lengths))


def aligned(doc: Column, item: Column, offset: Column, window: int, subs: int) -> tuple[Column, Column]:
    """Equal words in the best allowed window on a diagonal (0 if none is allowed), and on the whole diagonal.

    ``offset`` is the place in ``doc`` of the item's first word.
    """
    same = F.transform(item, lambda w, j: F.when(F.get(doc, offset + j) == w, 1).otherwise(0))
    total = lambda flags: F.aggregate(flags, F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size(item) - window + 1), lambda s: total(F.slice(same, s, F.lit(window)))))
    return F.when(best >= window - subs, best).otherwise(0), total(same)


def contaminated(docs: DataFrame, benchmark: DataFrame, every: bool = False) -> DataFrame:
    """``doc_id, item_id, doc_pos, window_words, matched_words`` for each pair of a document and an item it leaks.

    ``window_words`` counts the equal words of the best window, ``matched_words`` those along the whole diagonal, and
    ``doc_pos`` is where the item's first word would be (negative if the document starts within it); of equally good
    diagonals the first counts. With ``every``, items of 7 to 12 words may have one word changed and shorter ones, down
    to a single word, must occur exactly; else items of 5 to 12 words must occur whole and shorter ones are never
    found. Null and empty texts leak nothing; null ids are reported as such; repeated rows of a document or item give
    one pair; other columns are not read; an empty table on either side gives an empty result.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("item")).distinct().withColumn("codes", hashed(F.col("item")))
    long_items = items.filter(F.size("item") >= WINDOW)
    short_items = items.filter((F.size("item") >= (1 if every else SHORTEST)) & (F.size("item") < WINDOW))
    sizes = {r.n: allowed(r.n) if every else 0 for r in short_items.select(F.size("item").alias("n")).distinct().collect()}
    tests = long_items.select("item_id", F.explode(seeds(F.col("codes"), 1)).alias("at")).select("item_id", F.col("at.pos").alias("item_pos"), F.col("at.seed").alias("seed"))
    for n, subs in sizes.items():
        cut = F.array(*(F.struct(F.lit(at).alias("pos"), run_seed(F.col("codes"), F.lit(at), size).alias("seed")) for at, size in runs(n, subs)))
        tests = tests.unionByName(short_items.filter(F.size("item") == n).select("item_id", F.explode(cut).alias("at")).select("item_id", F.col("at.pos").alias("item_pos"), F.col("at.seed").alias("seed")))
    tests = kept(tests, "seeds")
    few = tests.count() <= BROADCAST_ROWS
    codes = docs.select("doc_id", words(F.col("text")).alias("words")).select("doc_id", hashed(F.col("words")).alias("codes"))
    lengths = sorted({size for n, subs in sizes.items() for _, size in runs(n, subs)})
    hashes = F.concat(seeds(F.col("codes"), STRIDE), run_seeds(F.col("codes"), lengths)) if lengths else seeds(F.col("codes"), STRIDE)
    # Rows of seeds carry no words, so a text takes rows in proportion to its length.
    trained = codes.select("doc_id", F.explode(hashes).alias("at")).select("doc_id", F.col("at.pos").alias("pos"), F.col("at.seed").alias("seed"))
    shift = (F.col("pos") - F.col("item_pos")).alias("doc_pos")
    found = kept(trained.join(F.broadcast(tests) if few else tests, "seed").select(F.col("doc_id").alias("hit_id"), "item_id", shift).distinct(), "hits")
    around = found.count() <= BROADCAST_ROWS
    longest = items.agg(F.max(F.size("item"))).first()[0] or WINDOW
    start = F.greatest(F.lit(0), F.col("doc_pos"))
    hit_ids = found.select("hit_id").distinct()
    hit_docs = docs.join(F.broadcast(hit_ids) if around else hit_ids, docs.doc_id.eqNullSafe(hit_ids.hit_id), "left_semi")
    texts = hit_docs.select("doc_id", words(F.col("text")).alias("words"))
    hits = texts.join(F.broadcast(found) if around else found, texts.doc_id.eqNullSafe(found.hit_id))
    hits = hits.select("doc_id", "item_id", "doc_pos", (F.col("doc_pos") - start).alias("offset"), F.slice("words", start + 1, F.lit(longest)).alias("words"))
    best, total = aligned(F.col("words"), F.col("item"), F.col("offset"), WINDOW, SUBS)
    least = F.lit(WINDOW)
    for n, subs in sizes.items():
        least = F.when(F.size("item") == n, n - subs).otherwise(least)
    best = F.when(F.size("item") >= WINDOW, best).when(total >= least, total).otherwise(0)
    looked_for = long_items.unionByName(short_items).select(F.col("item_id").alias("known_id"), "item")
    compared = hits.join(looked_for, hits.item_id.eqNullSafe(looked_for.known_id))
    leaks = compared.select("doc_id", "item_id", "doc_pos", best.alias("window_words"), total.alias("matched_words"))
    ranked = F.struct("window_words", "matched_words", (-F.col("doc_pos")).alias("first"))
    top = leaks.filter("window_words > 0").groupBy("doc_id", "item_id").agg(F.max(ranked).alias("best"))
    return top.select("doc_id", "item_id", (-F.col("best.first")).alias("doc_pos"), "best.window_words", "best.matched_words")
