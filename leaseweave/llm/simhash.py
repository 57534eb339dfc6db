"""SimHash fingerprints of 128 bits, with DataFrame functions only.

Terms are pairs of neighbouring words (a lone word is its own term), weighted 1 to 3 by how many of the two are longer
than three characters. Each term's hash votes with its weight on every bit. Votes are added in packed 16-bit lanes
per block of terms, then in 32-bit lanes per text, so no count can overflow within Spark's largest string.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Terms whose votes at the largest weight fit signed 16-bit lanes.
BLOCK_TERMS = 10_000
LANES = "281479271743489L"  # 0x0001000100010001
SEED = 0x51ED27


def term_hashes(text: Column) -> Column:
    """One long for each term of `text`: its hash with the weight in the two lowest bits. An empty text has one term."""
    words = F.split(F.trim(text), r"\s+")
    n = F.size(words)

    def long_word(w):
        return (F.char_length(w) > 3).cast("int")

    def code(h, weight):
        return h.bitwiseAND(F.lit(-4)).bitwiseOR(weight.cast("long"))

    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda x, y: code(F.xxhash64(x, y), 1 + long_word(x) + long_word(y)))
    return F.when(n > 1, pairs).otherwise(F.transform(words, lambda x: code(F.xxhash64(x), 1 + long_word(x))))


def votes(df: DataFrame, keys: list[str], terms: str) -> DataFrame:
    """`keys` with `hi` and `lo`, the bits for which more than half of the weight votes. `keys` name one text each."""
    h = df.select(*keys, F.posexplode(terms).alias("_pos", "_h"))
    h = h.select(*keys, F.expr(f"_pos div {BLOCK_TERMS}").alias("_block"), F.expr("_h & 3").alias("_w"), F.expr(f"xxhash64(_h, {SEED})").alias("_a"), F.expr(f"xxhash64({SEED}, _h)").alias("_b"))
    packed = [F.expr(f"sum(_w * (shiftrightunsigned(_{x}, {j}) & {LANES}))").alias(f"_{x}{j}") for x in "ab" for j in range(16)]
    blocks = h.groupBy(*keys, "_block").agg(F.sum("_w").alias("_w"), *packed)
    # Lanes 0 and 2 of a packed sum go to one long, lanes 1 and 3 to another, with room for 32 bits each.
    wide = [F.expr(f"sum(shiftrightunsigned(_{x}{j}, {16 * k}) & 281470681808895L)").alias(f"_{x}{j}_{k}") for x in "ab" for j in range(16) for k in (0, 1)]
    texts = blocks.groupBy(*keys).agg(F.sum("_w").alias("_w"), *wide)

    def bits(x):
        parts = []
        for bit in range(64):
            j, lane = bit % 16, bit // 16
            value = f"(shiftrightunsigned(_{x}{j}_{lane % 2}, {32 * (lane // 2)}) & 4294967295L)"
            parts.append(f"if(2 * {value} > _w, {1 << bit if bit < 63 else '-9223372036854775808'}L, 0L)".replace("-9223372036854775808L", "(-9223372036854775807L - 1L)"))
        return F.expr(" | ".join(parts))

    return texts.select(*keys, bits("a").alias("hi"), bits("b").alias("lo"))


def as_text(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits."""
    return 1 - (F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))) / F.lit(128.0)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `hi`, `lo`, `fingerprint` for each row; a null text counts as empty, equal texts have equal prints."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), term_hashes(F.coalesce(F.col(text_col), F.lit(""))).alias("_terms"))
    return votes(rows, ["doc_id", "_row"], "_terms").select("doc_id", "hi", "lo", as_text(F.col("hi"), F.col("lo")).alias("fingerprint"))


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs of different fingerprints at most `radius` bits apart, by permuted block tables.

    `prints` has hi and lo. Of `blocks` bit blocks at least blocks - radius are equal in such a pair, so for some
    choice of as many blocks both fall in the same table entry. Equal fingerprints are collapsed first: a group of
    copies is one entry. Returns a_hi, a_lo, b_hi, b_lo, distance with a < b, each pair once.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below the number of blocks")
    edges = [128 * i // blocks for i in range(blocks + 1)]

    def block(i):
        parts = []
        for name, low, high in (("lo", edges[i], min(64, edges[i + 1])), ("hi", max(0, edges[i] - 64), edges[i + 1] - 64)):
            if high > low:
                mask = (1 << (high - low)) - 1
                parts.append(f"shiftrightunsigned({name}, {low})" + (f" & {mask}L" if high - low < 64 else ""))
        return "xxhash64(" + ", ".join(parts) + ")"

    one = prints.select("hi", "lo").distinct()
    tables = [f"struct({t} AS t, xxhash64({', '.join(block(i) for i in chosen)}) AS k)" for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    rows = one.select("hi", "lo", F.explode(F.expr(f"array({', '.join(tables)})")).alias("e")).select("hi", "lo", "e.t", "e.k")
    a = rows.select("t", "k", F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"))
    b = rows.select("t", "k", F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"))
    distance = F.expr("bit_count(a_hi ^ b_hi) + bit_count(a_lo ^ b_lo)")
    near = a.join(b, ["t", "k"]).where("a_hi < b_hi OR a_hi = b_hi AND a_lo < b_lo").withColumn("distance", distance)
    return near.where(F.col("distance") <= radius).select("a_hi", "a_lo", "b_hi", "b_lo", "distance").distinct()


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the text of the next one by descending id (after the last, the first), in one shuffle.

    Ids are cut into ranges at quantiles, which are ids themselves; the first row of a range is copied to the range
    that it follows, so each range is complete by itself. Null ids come last; equal ids go by text.
    Returns `bucket`, `place` in the range, `tail` (a copied row), doc_id, text, next_text.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    ranges = max(1, min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    at = [i / ranges for i in range(1, ranges)] or [0.5]
    cut = rows.agg(F.percentile_approx("_key", at, 10_000).alias("q"), F.max("_key").alias("top")).first()
    cuts = sorted({x for x in cut["q"] or [] if x < cut["top"]})
    edges = F.array(*[F.lit(x).cast("long") for x in cuts]) if cuts else F.expr("array_repeat(0L, 0)")
    bucket = F.size(F.filter(edges, lambda x: x < F.col("_key")))
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("tail"))
    following = F.when(F.col("_key") == F.lit(cut["top"]), F.struct(F.lit(0).alias("bucket"), F.lit(True).alias("tail"))).when(
        F.array_contains(edges, F.col("_key")) if cuts else F.lit(False), F.struct((bucket + 1).alias("bucket"), F.lit(True).alias("tail")))
    rows = rows.select("doc_id", "text", "_key", F.explode(F.array_compact(F.array(own, following))).alias("e")).select("doc_id", "text", "_key", "e.bucket", "e.tail")
    w = Window.partitionBy("bucket").orderBy("tail", F.desc("_key"), "text")
    return rows.select("bucket", F.row_number().over(w).alias("place"), "tail", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, whose last third is the start of the next document.

    Empty tables give no rows; a table of one row is its own next document. Repeated rows each give a row.
    """
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, cast(char_length(text) - char_length(text) div 3 as int))"), F.expr("substring(coalesce(next_text, ''), 1, cast(char_length(text) div 3 as int))"))
    rows = with_next(df, id_col, text_col).select("bucket", "place", "tail", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    own, other = term_hashes(F.col("text")), F.when(F.col("tail"), F.expr("array_repeat(0L, 0)")).otherwise(term_hashes(F.col("edited")))
    rows = rows.select("bucket", "place", "tail", "doc_id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), own.alias("terms")), F.struct(F.lit(1).alias("kind"), other.alias("terms")))).alias("e"))
    rows = rows.select("bucket", "place", "tail", "doc_id", "n_chars", "sha", "e.kind", "e.terms")
    prints = votes(rows, ["bucket", "place", "tail", "doc_id", "n_chars", "sha", "kind"], "terms")
    both = prints.groupBy("bucket", "place", "tail", "doc_id", "n_chars", "sha").agg(
        *[F.max(F.when(F.col("kind") == k, F.col(x))).alias(f"{x}{k}") for k in (0, 1) for x in ("hi", "lo")])
    w = Window.partitionBy("bucket").orderBy("place")
    both = both.select("*", F.lead("hi0").over(w).alias("hi2"), F.lead("lo0").over(w).alias("lo2")).where("NOT tail")
    pair = [(F.col(f"hi{k}"), F.col(f"lo{k}")) for k in range(3)]
    return both.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_text(*pair[0]).alias("fingerprint"), as_text(*pair[1]).alias("edited_fingerprint"),
        likeness(pair[0], pair[1]).alias("near_edited"), likeness(pair[0], pair[2]).alias("near_next"))
