"""Benchmark decontamination: a prefix-filtered set join with exact containment. Native operations only.

An item is cut into windows of ``size`` consecutive words (an item with fewer words is one window). A window
is the set of its shingles, two neighbouring words each (a one-word window: the word). Since a document must
contain a window whole, one shingle of it, the prefix, must occur in the document; the shingles are ordered
by their number of occurrences in the corpus and the rarest is taken. Document shingles meet prefixes by an
equality join; the prefix's offset in the window gives the start of the only window that can match there.
Length and positional bounds drop starts before the first or ends after the last word, and the words of the
item-sized window are compared.

Documents are never shuffled: they are read, normalised and staged once, exploded twice (rarity, matching)
against small blocks of the benchmark's shingles, and only verified matches move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import broadcast_blocks, fold, union_all
from palimpsest.session import stage

SIZE = 10
BLOCK = 500_000  # windows or shingles broadcast at a time, about 100 bytes each


def normal(text: Column) -> Column:
    """Words (runs of digits, letters and everything beyond ASCII; A-Z lowered) joined by one space."""
    return F.btrim(F.regexp_replace(fold(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" "))


def split_words(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def shingles(words: Column, single: bool = False) -> Column:
    """Hashes of neighbouring words, by position; with ``single`` those of one word."""
    if single:
        return F.transform(words, lambda w: F.xxhash64(w))
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda w, i: F.xxhash64(w, F.get(words, i + 1)))


def item_windows(items: DataFrame, size: int = SIZE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct ``(item_id, window)``; the window's words joined by a space. Items without words have none."""
    words = items.select(F.col(item_id).alias("item_id"), split_words(normal(F.col(text))).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(size))
    windows = F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda i: F.array_join(F.slice("w", i, length), " "))
    return words.select("item_id", F.explode(windows).alias("window")).distinct()


def _occurrences(docs: DataFrame, single: bool) -> DataFrame:
    """One row per document shingle; the words of the row stay within the scan's stage."""
    words = docs.select("row", F.split("norm", " ").alias("w")).where(F.col("w")[0] != "")
    return words.select("row", "w", F.posexplode(shingles(F.col("w"), single)).alias("pos", "key"))


def match(docs: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every occurrence of every distinct window: ``(row, start, length, window)``.

    docs: ``(row, norm)``; windows: ``(window)``. Tables without rows give none."""
    parts = []
    cut = windows.select("window").distinct().withColumn("v", F.split("window", " ")).withColumn("length", F.size("v"))
    for single in (False, True):
        own = cut.where(F.col("length") == 1 if single else F.col("length") > 1)
        keyed = stage(own.select("window", "length", F.posexplode(shingles(F.col("v"), single)).alias("offset", "key")), "window-shingles")
        if keyed.isEmpty():
            continue
        keys = keyed.select("key").distinct()
        seen = union_all([_occurrences(docs, single).select("key").join(b, "key") for b in broadcast_blocks(keys, "key", block)])
        counts = seen.groupBy("key").agg(F.count("*").alias("n"))
        rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "offset"))
        prefix = stage(keyed.join(counts, "key", "left").groupBy("window", "length").agg(rarest.alias("p"))
                       .where("p.n > 0").select("window", "length", "p.key", "p.offset"), "window-prefixes")
        start = F.col("pos") - F.col("offset")
        exact = ((F.col("d.key") == F.col("p.key")) & (start >= 0) & (start + F.col("length") <= F.size("w"))
                 & (F.array_join(F.slice("w", start + 1, F.col("length")), " ") == F.col("window")))
        parts += [_occurrences(docs, single).alias("d").join(b.alias("p"), exact).select("row", start.alias("start"), "length", "window")
                  for b in broadcast_blocks(prefix, "key", block)]
    if not parts:
        return docs.select("row", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window")).where(F.lit(False))
    return union_all(parts)


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per document, with all its columns but the text: ``n_words``, ``n_hit`` (words inside any occurrence
    of a window), ``item_ids`` (sorted as strings), ``n_items``, ``contaminated``; and ``row``, its number.

    A null text has no words. Repeated document rows are judged each by itself; repeated items count by
    their id; items without an id mark words but are not listed. An empty benchmark hits nothing."""
    clash = ["row", "norm", "n_words", "n_hit", "n_items", "item_ids", "contaminated"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text and c not in clash]
    norm = docs.select(F.monotonically_increasing_id().alias("row"), *kept, normal(F.col(f"`{text}`")).alias("norm"))
    staged = stage(norm.withColumn("n_words", F.when(F.col("norm") == "", 0).otherwise(
        F.length("norm") - F.length(F.translate("norm", " ", "")) + 1).cast("long")), "normalised")
    pairs = stage(item_windows(items, size), "item-windows")
    found = stage(match(staged, pairs, block), "window-matches")

    before = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = found.groupBy("row", "start").agg(F.max("length").alias("length"))
    hit = (spans.withColumn("fresh", F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0)))))
           .groupBy("row").agg(F.sum("fresh").alias("n_hit")))
    ids = (found.select("row", "window").distinct().join(pairs.where("item_id is not null"), "window")
           .select("row", F.col("item_id").cast("string").alias("id")).distinct()
           .groupBy("row").agg(F.array_sort(F.collect_list("id")).alias("item_ids")))
    out = staged.drop("norm").join(hit, "row", "left").join(ids, "row", "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
    out = out.withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    return out.withColumn("n_items", F.size("item_ids").cast("long")).withColumn("contaminated", F.col("n_hit") > 0)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs.select("doc_id", "text"), items).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.0) -> DataFrame:
    """Documents whose share of hit words is at most ``share``, with their own columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "text")
    return contamination(whole, items).where(F.col("n_hit") <= F.col("n_words") * share).select("__doc.*")


SQL = r"""
with dw as (
  select doc_id, row, len(w) n, w from (
    select doc_id, row_number() over () as row,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
    from documents)),
iw as (
  select item_id, least(len(w), 10) k, w from (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
    from benchmark) where len(w) > 0),
win as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as win from (select item_id, k, w, unnest(range(1, len(w) - k + 2)) i from iw)),
uw as (select distinct k, win from win),
occ as (
  select row, i, k, array_to_string(w[i:i + k - 1], ' ') as win
  from (select row, w, k, unnest(range(1, n - k + 2)) i from dw, (select distinct k from uw) where n >= k)),
hits as (select row, i, k, win from occ join uw using (k, win)),
cover as (select row, count(distinct p) n_hit from (select row, unnest(range(i, i + k)) p from hits) group by row),
ids as (select row, count(*) n_items, string_agg(id, ',' order by id) s
        from (select distinct row, cast(item_id as varchar) id from hits join win using (win)) group by row)
select doc_id, cast(n as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join cover using (row) left join ids using (row)
"""
