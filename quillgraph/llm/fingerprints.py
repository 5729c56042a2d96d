"""Document fingerprints by winnowing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import Buckets, id_order

#: Bytes in a gram and grams in a window: any shared run of GRAM + WINDOW - 1 bytes shares a fingerprint.
GRAM, WINDOW = 16, 64

#: Window starts in one block. A block also reads the WINDOW - 1 grams after it, so the work on a text of any length
#: stays linear.
BLOCK = 1984

_PLACES = 1 << 12  # a gram's place in its block sits in the low bits, reversed, so that a minimum carries its position
_LAST = _PLACES - 1
_NONE = 2**63 - 1


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _block(data: Column, grams: Column, start: Column, gram: int, window: int) -> Column:
    """Places (1-based, in the whole text) of the minima of the windows that start in one block.

    Each gram is hashed by itself: an expression has no running state, and rolling hashes taken in strides (a gram from its two
    halves) took 2.2 times as long as this. From each minimum the next one follows directly: the first later gram in its reach that is not larger, or else the
    minimum of the first window without it. The folds take one step for each minimum, not for each gram.
    """
    n = F.least(start + F.lit(BLOCK + window - 1), grams) - start
    packed = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.xxhash64(F.substring(data, start + i, F.lit(gram))).bitwiseAND(F.lit(~_LAST)).bitwiseOR((F.lit(_LAST) - i).cast("long")),
    )
    none = F.lit(_NONE)

    def follow(p: Column) -> Column:
        size = F.size(p)

        def step(out: Column, _: Column) -> Column:
            last = F.element_at(out, F.lit(-1))
            after = F.lit(_PLACES) - last.bitwiseAND(F.lit(_LAST)).cast("int")
            reach = last.bitwiseOR(F.lit(_LAST))

            def then(least: Column) -> Column:
                upto = F.lit(_PLACES) - least.bitwiseAND(F.lit(_LAST)).cast("int") - after
                return (
                    F.when(least.isNull(), none)
                    .when(least > reach, F.when(after + F.lit(window - 1) <= size, least).otherwise(none))
                    .otherwise(F.get(F.filter(F.slice(p, after, upto), lambda x: x <= reach), F.lit(0)))
                )

            return F.when(last == none, out).otherwise(F.concat(out, F.array(_bind(F.array_min(F.slice(p, after, F.lit(window))), then))))

        def steps(out: Column, _: Column) -> Column:
            return F.when(F.element_at(out, F.lit(-1)) == none, out).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(16)), out, step))

        first = F.array(F.array_min(F.slice(p, F.lit(1), F.lit(window))))
        return F.aggregate(F.sequence(F.lit(0), F.floor(size / F.lit(16)).cast("int")), first, steps)

    chosen = F.filter(_bind(packed, follow), lambda v: v != none)
    return F.transform(chosen, lambda v: start + F.lit(_LAST) - v.bitwiseAND(F.lit(_LAST)).cast("int"))


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Ascending places (1-based, in UTF-8 bytes) of the grams that winnowing keeps.

    Each window of `window` consecutive gram hashes keeps its minimum, the rightmost one among ties. A text shorter than
    a gram has one gram, one shorter than a window one window; null and empty texts have none.
    """

    def whole(data: Column) -> Column:
        grams = F.greatest(F.octet_length(data) - F.lit(gram - 1), F.lit(1))
        blocks = F.sequence(F.lit(0), F.greatest(grams - F.lit(window), F.lit(0)), F.lit(BLOCK))
        return F.array_distinct(F.flatten(F.transform(blocks, lambda s: _block(data, grams, s, gram, window))))

    return F.when(F.octet_length(text) > 0, _bind(text.cast("binary"), whole)).otherwise(F.array().cast("array<int>"))


def gram_hashes(text: Column, places: Column, gram: int = GRAM) -> Column:
    """The 52-bit hashes of the grams at these places."""
    return _bind(F.coalesce(text, F.lit("")).cast("binary"), lambda data: F.transform(places, lambda i: F.shiftrightunsigned(F.xxhash64(F.substring(data, i, F.lit(gram))), 12)))


def fingerprint_text(hashes: Column, places: Column) -> Column:
    """`hash@byte` items (hash in hex, byte from 0) joined by commas."""
    return F.array_join(F.zip_with(hashes, places, lambda h, i: F.concat(F.hex(h), F.lit("@"), (i - 1).cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of hashes as sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(both.cast("double") / either)


def with_fingerprints(df: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """All rows and columns of df, with `places` and `hashes` of the winnowed fingerprint of each whole text."""
    df = df.withColumn("places", winnow(F.col(text), gram, window))
    return df.withColumn("hashes", gram_hashes(F.col(text), F.col("places"), gram))


def next_in_order(df: DataFrame, key: str, values: list[str], name: str) -> DataFrame:
    """df with the struct `name` of the values of the next row in ascending order of key (null first, ties by the
    values); after the last row comes the first. One shuffle, no task sees more than a bucket of rows."""
    b = Buckets(df, key)
    if not b.rows:
        return df.withColumn(name, F.struct(*values))
    before = {x: b.filled[i - 1] for i, x in enumerate(b.filled)}  # cyclic
    lows = [b.lows.get(i) for i in range(len(b.counts))]
    prev = [before.get(i, -1) for i in range(len(b.counts))]
    as_array = lambda xs: F.from_json(F.lit("[" + ",".join("null" if x is None else str(x) for x in xs) + "]"), "array<bigint>")
    rows = df.withColumn("_b", b.bucket())
    copy = F.get(as_array(lows), F.col("_b")) == id_order(key)
    at = F.when(copy, F.array(F.struct(F.col("_b").cast("long").alias("b"), F.lit(0).alias("c")), F.struct(F.get(as_array(prev), F.col("_b")).alias("b"), F.lit(1).alias("c")))).otherwise(F.array(F.struct(F.col("_b").cast("long").alias("b"), F.lit(0).alias("c"))))
    rows = rows.withColumn("_at", F.explode(at))
    order = Window.partitionBy("_at.b").orderBy(F.col("_at.c"), id_order(key), *[F.col(v).asc_nulls_first() for v in values])
    rows = rows.withColumn(name, F.lead(F.struct(*values)).over(order))
    return rows.where(F.col("_at.c") == 0).drop("_b", "_at")


def fingerprint_edits(documents: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each document's text and of its edited text, whose last floor(n/2) code points are the first ones
    of the next document, and the likeness to the edited text and to the next document.

    Null texts count as empty; the fingerprint of an empty text is empty; two empty ones are alike (1), an empty and
    another are not (0). Rows of equal doc_id stand in order of their texts. An empty table gives an empty result;
    further columns are ignored.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("places", winnow(F.col("text"), gram, window))
    rows = next_in_order(rows, "doc_id", ["text", "places"], "next")
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.select(
        "doc_id", "text", "places", "next", F.char_length("text").cast("long").alias("n_chars"),
        F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited"),
    )
    rows = rows.withColumn("edited_places", winnow(F.col("edited"), gram, window))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "places", "edited_places",
        gram_hashes(F.col("text"), F.col("places"), gram).alias("hashes"), gram_hashes(F.col("edited"), F.col("edited_places"), gram).alias("edited_hashes"), gram_hashes(F.col("next.text"), F.col("next.places"), gram).alias("next_hashes"),
    )
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint_text(F.col("hashes"), F.col("places")).alias("fingerprint"), fingerprint_text(F.col("edited_hashes"), F.col("edited_places")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
