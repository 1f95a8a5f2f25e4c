"""Benchmark decontamination: windows of benchmark words looked up in training texts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import row_key, stored

WINDOW = 13
#: Words before a window is built: only where these begin a benchmark window is the window itself looked up.
ANCHOR = 3
#: Windows that begin in so many consecutive words are looked for together.
PIECE = 64
#: The windows are broadcast if their texts and item lists hold at most so many bytes; beyond, they are joined by shuffle.
BROADCAST_BYTES = 48 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; lower() does the same where a text is ASCII, and faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lowered(F.coalesce(text, F.lit(""))), _BETWEEN + "+"), "")


def _joined(array: Column, begin: Column, length: Column) -> Column:
    return F.array_join(F.slice(array, begin + 1, length), " ")


def windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """`window, len, head, items`: each different window, its words, its first words' hash and the ids that have it.

    An item of fewer words than a window, but not none, is one window. Ids become strings; an item without an id has windows but is in no list.
    """
    item = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    n = F.size("w")
    item = item.where(n > 0)
    begin = F.explode(F.when(n <= width, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - width)))
    each = item.select("item", "w", F.least(n, F.lit(width)).alias("len"), begin.alias("i"))
    each = each.select("item", "len", _joined(F.col("w"), F.col("i"), F.col("len")).alias("window"), _head(F.col("w"), F.col("i"), F.least("len", F.lit(ANCHOR))).alias("head"))
    return each.groupBy("window", "len", "head").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _head(array: Column, i: Column, count) -> Column:
    """Hash of the `count` words from i on; the missing ones hash as null, which xxhash64 skips, so the count is hashed too."""
    at = [F.when(F.lit(k) < count, F.get(array, i + k)) for k in range(ANCHOR)]
    return F.xxhash64(*at, F.lit(1).cast("int") * count)


def _heads_of(array: Column, m: Column, k: int):
    return lambda x, i: F.when((i + k <= m) & (i < PIECE), _head(array, i, F.lit(k)))


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, width: int, broadcast_bytes: int) -> DataFrame:
    """`doc_id, row, n, hit, items`: a row with null hit for each document row, and one for each window found; hit is 16 * position + length."""
    known = stored(windows(benchmark, item_col, item_text, width), "windows")
    bytes_, lengths = known.agg(
        F.coalesce(F.sum(F.octet_length("window") + 16 * F.size("items") + 64), F.lit(0)), F.sort_array(F.collect_set("len"))
    ).first()
    lengths = lengths or [width]
    small = bytes_ <= broadcast_bytes
    kinds = sorted({min(ANCHOR, x) for x in lengths})
    base = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row"), words(F.col(text_col)).alias("w"))
    base = base.withColumn("n", F.size("w"))
    n = F.col("n")
    # Texts are dealt out in pieces: every row of an explode is a copy of what stands beside it, so whole texts beside
    # each position would cost the square of their length. Piece -1 is the document's own row, without words.
    empty = F.array().cast("array<string>")
    piece = lambda c: F.transform(F.sequence(c, F.least(c + (PIECE + width - 2), n - 1)), lambda j: F.get(F.col("w"), j))
    starts = F.when(n > 0, F.concat(F.array(F.lit(-1)), F.sequence(F.lit(0), n - 1, F.lit(PIECE)))).otherwise(F.array(F.lit(-1)))
    pieces = F.transform(starts, lambda c: F.struct(c.alias("c"), F.when(c >= 0, piece(c)).otherwise(empty).alias("w")))
    parts = base.select("doc_id", "row", "n", F.explode(pieces).alias("x")).select("doc_id", "row", "n", "x.c", "x.w").withColumn("m", F.size("w"))
    w, m, own = F.col("w"), F.col("m"), F.col("c") < 0
    tried_heads = [F.transform(w, _heads_of(w, m, k)) for k in kinds]
    mark = F.when(own, F.array(F.lit(None).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    spread = parts.select("doc_id", "row", "n", "c", "w", "m", F.posexplode(F.concat(*tried_heads, mark)).alias("p", "head"))
    heads = known.select("head", F.lit(1).alias("known")).distinct()
    if small:
        spread = spread.join(F.broadcast(heads), "head", "left").where(own | F.col("known").isNotNull())
    else:  # places without their words are joined with the heads; only words of pieces with a find are moved after that
        places = spread.where(~own).select("row", "c", "p", "head").join(heads.hint("merge"), "head", "left_semi").select("row", "c", "p").distinct()
        words_ = parts.where(~own).select("doc_id", "row", "c", "n", "w", "m").join(places.select("row", "c").distinct().hint("merge"), ["row", "c"], "left_semi").dropDuplicates(["row", "c"])
        hits = places.join(words_.hint("merge"), ["row", "c"]).select("doc_id", "row", "n", "c", "w", "m", "p")
        spread = spread.where(own).select("doc_id", "row", "n", "c", "w", "m", "p").union(hits)
    fits = F.lit(None).cast("array<int>")
    for k, kind in enumerate(kinds):
        fits = F.when(F.floor(F.col("p") / m) == k, F.array(*[F.lit(x) for x in lengths if min(ANCHOR, x) == kind])).otherwise(fits)
    local = F.when(own, F.lit(0)).otherwise(F.col("p") % F.greatest(m, F.lit(1)))
    tried = spread.select("doc_id", "row", "n", "c", "w", "m", own.alias("own"), local.alias("i"), F.explode(F.when(own, F.array(F.lit(0))).otherwise(fits)).alias("l"))
    tried = tried.where(F.col("own") | ((F.col("i") + F.col("l") <= m) & (F.col("i") < PIECE)))
    tried = tried.select("doc_id", "row", "n", "own", ((F.col("c") + F.col("i")) * 16 + F.col("l")).alias("hit"), F.when(~F.col("own"), _joined(w, F.col("i"), F.col("l"))).alias("window"))
    right = known.select("window", "items")
    if small:
        joined = tried.join(F.broadcast(right), "window", "left")
    else:  # a document's own rows need no join; salting the null windows is left to the union
        joined = tried.where("own").select("*", F.lit(None).cast("array<string>").alias("items")).unionByName(tried.where("not own").join(right.hint("merge"), "window"), allowMissingColumns=True)
    return joined.where(F.col("own") | F.col("items").isNotNull()).select("doc_id", "row", "n", F.when(~F.col("own"), F.col("hit")).alias("hit"), "items")


def _covered(hits: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(s: Column, h: Column) -> Column:
        begin = F.floor(h / 16)
        end = begin + h % 16
        return F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), end - F.greatest(begin, s["end"]))).cast("long").alias("n"),
            F.greatest(s["end"], end).cast("long").alias("end"),
        )

    return F.aggregate(F.sort_array(hits), start, step, lambda s: s["n"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """One row per document row: `doc_id, row, n_words, n_hit, hits, items, contaminated`.

    hits holds 16 * position + length of each window found, items the sorted ids that they come
    from. A word is hit if any window found covers it; contaminated means that a twentieth of
    the words or more are hit. Null and wordless texts have no words and are never contaminated.
    Rows repeated whole give as many rows. Empty tables on either side work. Window texts are
    compared, not only hashes, so no collision counts as a hit.
    """
    if not 1 <= width < 16:
        raise ValueError("a window has 1 to 15 words")
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text, width, broadcast_bytes)
    each = found.groupBy("doc_id", "row").agg(
        F.max("n").cast("long").alias("n_words"),
        F.count(F.when(F.col("hit").isNull(), 1)).alias("copies"),
        F.collect_set("hit").alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    each = each.withColumn("n_hit", _covered(F.col("hits").cast("array<long>")))
    rows = each.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))) 
    return rows.select("doc_id", "row", "n_words", "n_hit", "hits", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def report(found: DataFrame) -> DataFrame:
    """The digest of contamination(): counts and the SHA-256 of the comma-joined item ids."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark, id_col, text_col, **options).where("contaminated").select(F.col("row").alias("__tm_row")).distinct()
    return docs.withColumn("__tm_row", row_key(id_col, text_col)).join(bad, "__tm_row", "left_anti").drop("__tm_row")


def without_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows of `docs`; hit words are cut out of the text, each with what stands between it and the word before."""
    hit = contamination(docs, benchmark, id_col, text_col, **options).where("n_hit > 0").groupBy(F.col("row").alias("__tm_row")).agg(F.first("hits").alias("__tm_hits"))
    gone = F.array_distinct(F.flatten(F.transform("__tm_hits", lambda h: F.sequence(F.floor(h / 16).cast("int"), (F.floor(h / 16) + h % 16 - 1).cast("int")))))
    split = F.when(F.col("__tm_hits").isNotNull(), F.regexp_extract_all(F.col(text_col), F.lit(f"{_BETWEEN}*{_WORD}+"), F.lit(0)))
    parts = F.col("__tm_parts")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    cut = F.concat(F.array_join(F.transform(left, lambda i: F.get(parts, i)), ""), F.regexp_extract(F.col(text_col), f"{_BETWEEN}*\\z", 0))
    marked = docs.withColumn("__tm_row", row_key(id_col, text_col)).join(hit, "__tm_row", "left")
    return marked.withColumn("__tm_parts", split).withColumn(text_col, F.when(F.col("__tm_hits").isNull(), F.col(text_col)).otherwise(cut)).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS l, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT rid, i, l, array_to_string(w[i : i + l - 1], ' ') AS s
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
h AS (SELECT dw.rid, dw.i, dw.l, bw.item FROM dw JOIN bw ON dw.s = bw.s AND dw.l = bw.l),
p AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(i, i + l)) AS q FROM (SELECT DISTINCT rid, i, l FROM h)) GROUP BY rid),
t AS (SELECT rid, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)
"""
