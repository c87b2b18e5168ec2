"""Document fingerprints: a canonical exact digest, in built-in expressions only.

The canonical form of a text is its compatibility composition (NFKC) after full case folding, with
every run of white space made one space and the ends trimmed. Its fingerprint is two chained 64-bit
xxhash values. Texts share a fingerprint exactly when their canonical forms are equal, but for
collisions of 128 bits; ``exact_groups`` compares the bytes inside each bucket of equal fingerprints.

Nulls count as empty texts; empty and all-blank texts share one fingerprint. Repeated rows stay
repeated. Only the named columns of the input are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import salted_left_join, shuffle_partitions, small_table

_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def _compose(text: Column) -> Column:
    """NFKC by the ICU classes that come with Spark (SQL function ``reflect``)."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def canonical_text(text: Column) -> Column:
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(_compose(folded), _SPACE, " "))


def wide_hash(canonical: Column, hashes: int = 3) -> Column:
    """h1, h2: the fingerprint's 128 bits; h3: 64 more, to tell texts apart whose fingerprints collide. Chained xxhash64 of the bytes.

    A lambda's variable holds the canonical text, as Spark would work out a ``reflect`` call for each of the hashes.
    """
    each = [F.lit("second"), F.lit("third")]
    return F.transform(F.array(canonical), lambda c: F.struct(F.xxhash64(c).alias("h1"), *[F.xxhash64(each[i], c).alias(f"h{i + 2}") for i in range(hashes - 1)]))[0]


def as_text(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def fingerprint(text: Column) -> Column:
    """32 hex digits."""
    wide = wide_hash(canonical_text(text), 2)
    return as_text(wide["h1"], wide["h2"])


def likeness(a: Column, b: Column) -> Column:
    """Of two exact digests: 1 if equal, else 0."""
    return F.when(a == b, 1.0).otherwise(0.0)


_HASHES = ["h1", "h2", "h3"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, h3, group_id, group_size, n_texts): one row per different canonical text.

    Rows meet by fingerprint and canonical bytes, so texts are compared byte by byte where fingerprints
    are equal; copies collapse before the shuffle. ``n_texts`` counts the different texts of a bucket:
    above 1 the fingerprint collided and h3 tells its texts apart.
    """
    canonical = docs.select(F.col(id_col).alias("id"), canonical_text(F.col(text_col)).alias("canonical"))
    hashed = canonical.withColumn("h", wide_hash(F.col("canonical"), 2))
    texts = hashed.groupBy("h.h1", "h.h2", "canonical").agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    texts = texts.select("h1", "h2", F.xxhash64(F.lit("third"), F.col("canonical")).alias("h3"), "group_id", "group_size")
    bucket = Window.partitionBy("h1", "h2")  # a row per different text: one, but for collisions
    return texts.withColumn("n_texts", F.count(F.lit(1)).over(bucket))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """id, fingerprint, group_id (smallest id with the same canonical text), group_size."""
    rows = docs.select(id_col, wide_hash(canonical_text(F.col(text_col))).alias("_h")).select(id_col, "_h.*")
    rows = _with_groups(rows, exact_groups(docs, id_col, text_col), id_col, salts)
    return rows.select(id_col, as_text(F.col("h1"), F.col("h2")).alias("fingerprint"), "group_id", "group_size")


def _with_groups(rows: DataFrame, groups: DataFrame, id_col: str, salts: int) -> DataFrame:
    """Rows of singletons need no partner: only groups of two or more travel to them."""
    shared = groups.filter("group_size > 1 or n_texts > 1").select(*_HASHES, "group_id", "group_size")
    joined = salted_left_join(rows, shared, _HASHES, F.monotonically_increasing_id(), salts)
    return joined.withColumn("group_id", F.coalesce("group_id", F.col(id_col))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))


def with_successor(docs: DataFrame, id_col: str, carried: list[str], derived: Column | None = None) -> DataFrame:
    """Adds next_<c> for each carried column: its value in the next row by descending id; after the last, the first.

    ``derived`` is a struct column worked out for every row, whose fields can be carried too. Rows are dealt into ranges of
    ids, one task each; the first row of a range is also sent to the range before, whose last row it follows. Of rows with
    one id the order is by a hash of the other columns, and an id with more rows than a range should hold, as the rows without
    an id, which come last, is dealt into ranges of that hash.
    """
    spark, n = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    found = docs.select(F.percentile_approx(id_col, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts, hot = sorted(set(found)), sorted({a for a, b in zip(found, found[1:]) if a == b})
    kind = docs.schema[id_col].dataType
    list_of = lambda values: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind.simpleString()}>")
    others = [c for c in docs.columns if c != id_col]
    tie = F.xxhash64(*others) if others else F.lit(0).cast("long")
    part = F.shiftright("_tie", 60) + 8  # of 16
    below = F.size(F.filter(list_of(cuts), lambda c: c <= F.col(id_col)))
    own_range = F.coalesce(F.array_contains(list_of(hot), F.col(id_col)), F.lit(False))
    number = F.when(F.col(id_col).isNull(), part - 16).when(own_range, 32 * below + part).otherwise(32 * below + 16)
    ranged = docs.withColumn("_tie", tie).withColumn("_range", number.cast("int"))
    tops = sorted(tuple(r) for r in ranged.groupBy("_range").agg(F.max(F.struct(id_col, "_tie")).alias("t")).select("_range", f"t.{id_col}", "t._tie").collect())  # a row a range
    whole = lambda rows, guest: (rows if derived is None else rows.withColumn("_d", derived).select("*", "_d.*").drop("_d")).withColumn("_guest", F.lit(guest))
    rows = whole(ranged, False)
    if tops:
        above = [(None if top is None else str(top), top_tie, tops[(i + 1) % len(tops)][0]) for i, (_, top, top_tie) in enumerate(tops)]
        guests = small_table(spark, above, "_top string, _top_tie long, _to int").withColumn("_top", F.col("_top").cast(kind))
        guests = F.broadcast(guests)  # a row a range
        sent = ranged.join(guests, F.col(id_col).eqNullSafe(F.col("_top")) & (F.col("_tie") == F.col("_top_tie")))
        rows = rows.unionByName(whole(sent.withColumn("_range", F.col("_to")).drop("_top", "_top_tie", "_to"), True))
    order = Window.partitionBy("_range").orderBy("_guest", F.col(id_col).desc_nulls_last(), F.col("_tie").desc())
    for c in carried:
        rows = rows.withColumn(f"next_{c}", F.lead(c).over(order))
    return rows.filter(~F.col("_guest")).drop("_guest", "_range", "_tie")


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with its last third (in code points, rounded down) replaced by the start of ``following``."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(F.coalesce(following, F.lit("")), F.lit(1), third))


def fingerprint_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with the exact groups they fall into."""
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_successor(rows, id_col, ["text", "h1", "h2"], wide_hash(canonical_text(F.col("text"))))
    edited = edited_text(F.col("text"), F.col("next_text"))
    rows = rows.select(
        id_col,
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(edited, 256).alias("edited_sha256"),
        *_HASHES,
        "next_h1",
        "next_h2",
        wide_hash(canonical_text(edited), 2).alias("e"),
    ).select("*", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2"))
    own, changed, following = (as_text(F.col(a), F.col(b)) for a, b in (("h1", "h2"), ("e1", "e2"), ("next_h1", "next_h2")))
    return _with_groups(rows, exact_groups(docs, id_col, text_col), id_col, 16).select(
        id_col,
        "n_chars",
        "edited_sha256",
        own.alias("fingerprint"),
        changed.alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        "group_id",
        "group_size",
    )
