"""Document fingerprints by winnowing, in DataFrame expressions alone.

A text's words (runs of letters and digits, A-Z as a-z, runs of more than `LONGEST` code points cut into pieces of so many) are
hashed `K` in a row, at every word. Of every `W` hashes in a row the smallest is kept, of equal ones the rightmost, with its
place. So two texts that share `K + W - 1` words in a row share a fingerprint there (the window inside that run chooses alike in
both), and no run of fewer than `K` words can match.

A hash carries its place in its lower bits, so a window's minimum is a plain `least` with rightmost ties. Nothing is exploded: a
text is worked on inside its row, in time that grows with its length.

A text of fewer than `K` words is one hash of all of them, one with fewer than `W` hashes is one window, and one without a word is
itself the only word. An empty or null text has an empty fingerprint; two empty ones are alike (1), an empty one and another
are not (0). Columns other than doc_id and text are not read. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 4
W = 6
LONGEST = 16
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_PLACES = (1 << 31) - 1
_HASH = (1 << 32) - 1


def _let(value: Column, body) -> Column:
    """body(value), with value computed once, also where body's lambdas use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _following(values: Column, i: Column, many: int) -> list[Column]:
    """The values behind place i, null beyond the last."""
    return [F.get(values, i + step) for step in range(1, many)]


def _of_words(words: Column, grams: Column) -> Column:
    # Upper bits of the hash, less the place: the least of equal hashes is the rightmost. A last gram may be short of words.
    tagged = lambda w, i: F.xxhash64(w, *_following(words, i, K)).bitwiseAND(F.lit(~_PLACES)) - i
    chosen = lambda v: F.transform(F.slice(v, F.lit(1), F.greatest(F.lit(1), grams - (W - 1))), lambda x, i: F.least(x, *_following(v, i, W)))
    found = _let(F.transform(F.slice(words, F.lit(1), grams), tagged), chosen)
    place = lambda v: (-v).bitwiseAND(F.lit(_PLACES).cast("long"))
    return F.transform(F.array_distinct(found), lambda v: F.shiftleft(place(v), 32).bitwiseOR(F.shiftrightunsigned(v + place(v), 32)))


def winnow(text: Column) -> Column:
    """The fingerprint of a text that isn't null: array<long> by place, each place * 2**32 + the hash's upper 32 bits."""
    # lower() changes other letters too; of these only the Kelvin sign would become an ASCII letter.
    plain = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138")))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w), F.lit(LONGEST)), lambda i: F.substr(w, i, F.lit(LONGEST)))
    words = F.array_remove(F.split(plain, _BETWEEN), "")
    long = lambda a: F.exists(a, lambda w: F.char_length(w) > LONGEST)
    words = _let(words, lambda a: F.when(long(a), F.flatten(F.transform(a, cut))).when(F.size(a) > 0, a).otherwise(F.array(text)))
    found = _let(words, lambda w: _of_words(w, F.greatest(F.lit(1), F.size(w) - (K - 1))))
    return F.when(text == "", F.array().cast("array<long>")).otherwise(found)


def hashes_of(fingerprint: Column) -> Column:
    """The distinct hashes, without places."""
    return F.array_distinct(F.transform(fingerprint, lambda e: e.bitwiseAND(F.lit(_HASH))))


def likeness(a: Column, b: Column, common: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes, given the number they have in common."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def as_text(fingerprint: Column) -> Column:
    """Nine hexadecimal digits a choice, by place: eight of the hash and one of the steps from the choice before (from 0 at first).

    Two choices are at most W places apart; the first is within the first window."""
    steps = lambda f, e, i: F.shiftright(e, 32) - F.when(i > 0, F.shiftright(F.get(f, i - 1), 32)).otherwise(F.lit(0))
    number = lambda f, e, i: F.shiftleft(e.bitwiseAND(F.lit(_HASH)), 4) + steps(f, e, i)
    digits = _let(fingerprint, lambda f: F.transform(f, lambda e, i: F.lpad(F.hex(number(f, e, i)), 9, "0")))
    return F.lower(F.array_join(digits, ""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint: array<struct<place int, hash long>> of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(text).alias("n_chars"), winnow(text).alias("f"))
    entry = lambda e: F.struct(F.shiftright(e, 32).cast("int").alias("place"), e.bitwiseAND(F.lit(_HASH)).alias("hash"))
    return rows.select("doc_id", "n_chars", F.transform("f", entry).alias("fingerprint"))


def _neighbourhoods(rows: DataFrame) -> DataFrame:
    """rows (doc_id, h, text) dealt by `bucket`, a run of ids; the first row of each run stands in the run before as well, as a guest,
    and the very first in the last run. One shuffle of the texts; the runs' bounds come from ids and hashes alone."""
    spark = rows.sparkSession
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct("doc_id", "h")
    ids = rows.select("doc_id", "h").repartitionByRange(4 * many, "doc_id", "h")
    # As many rows as there are runs, four a partition.
    first = [r.low for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("low")).orderBy("low").collect()]
    value = lambda x: F.lit(x).cast("long")
    bounds = F.array(*[F.struct(value(r.doc_id).alias("doc_id"), value(r.h).alias("h")) for r in first]) if first else F.array(key)
    own = F.size(F.filter(bounds, lambda b: b <= key)) - 1
    guest = F.array_contains(bounds, key)
    rows = rows.withColumn("own", own)
    places = F.when(guest, F.array(F.col("own"), F.pmod(F.col("own") - 1, F.lit(max(1, len(first)))))).otherwise(F.array("own"))
    rows = rows.select("doc_id", "h", "text", F.posexplode(places).alias("guest", "bucket"))
    return rows.repartition(many, "bucket")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row's text, by
    ascending doc_id (rows without one come first; rows of one id by the hash of their texts), after the last row the first's.
    Rows that repeat id and text are next to each other and are sorted in one task, which spills."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("h", F.xxhash64("text"))
    rows = _neighbourhoods(rows).withColumn("f", winnow(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), "h")
    rows = rows.withColumn("next", F.lead(F.struct("text", "f")).over(order)).filter("guest = 0")
    rows = rows.withColumn("n", F.char_length("text")).withColumn("half", F.floor(F.col("n") / 2).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n") - F.col("half")), F.substr("next.text", F.lit(1), F.col("half"))))
    rows = rows.select("doc_id", "n", "f", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), winnow(F.col("edited")).alias("e"), F.col("next.f").alias("next_f"))
    rows = rows.select("*", *[hashes_of(F.col(x)).alias(f"{x}_hashes") for x in ("f", "e", "next_f")])
    common = [F.size(F.array_intersect("f_hashes", f"{x}_hashes")).alias(f"{x}_common") for x in ("e", "next_f")]
    near = lambda x: likeness(F.col("f_hashes"), F.col(f"{x}_hashes"), F.col(f"{x}_common"))
    return rows.select("*", *common).select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("f")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"),
        near("e").alias("near_edited"),
        near("next_f").alias("near_next"),
    )
