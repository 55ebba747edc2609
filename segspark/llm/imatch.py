"""I-Match fingerprints over randomised lexicon subsets, in DataFrame functions only.

The lexicon is the terms whose document frequency over all texts lies in a band: at least MIN_DOCS documents,
at most MAX_SHARE of them. A term is a lower-cased run of letters and digits, known by its 64-bit hash. The
lexicon is split at random, at LEVELS rates: level j keeps 4**-j of it, by bits of the terms' hashes, and splits
that into PARTS disjoint subsets by other bits. A text's fingerprint lists,
for each subset with terms of the text, the subset and a hash over the text's sorted distinct terms in it.
Two fingerprints are as like as the share of their entries that are the same. Dense subsets tell apart long
texts that differ in a word; sparse ones still agree where half the text was replaced. A text without a
term in the band uses all its terms, one without terms a hash of itself.

The band needs no join of all (document, term) pairs. Terms above it are few whatever the size (a document's
mean number of distinct terms, divided by MAX_SHARE); where they are more than MAX_FREQUENT they are joined,
else they go into the plan. Terms below it occur in fewer than MIN_DOCS = 2 documents, so in one, which the
count carries along: they go back to that document alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segspark.llm.common import cut, documents, read, stored

MIN_DOCS, MAX_SHARE, MAX_FREQUENT = 2, 0.05, 20_000
LEVELS, PARTS = 7, 16
_SUBSET_BITS, _TERM_BITS = 12, 52


def terms(text: Column) -> Column:
    """Distinct term hashes."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))  # noqa: PLW0108


def with_codes(df: DataFrame, ts: str, to: str) -> DataFrame:
    """Adds the sorted codes of the terms in column ts: longs with the subset's number above the term's bits.

    A term is in a subset of level j if the 2j lowest bits of its hash are 0; which one, four higher bits say,
    others at each level. So each level looks only at what the one before kept. Each step is a column, as an
    expression that is used twice within one would be computed twice.
    """
    low = (1 << _TERM_BITS) - 1
    names = [f"_level{j}" for j in range(LEVELS)]
    df = df.withColumn(names[0], F.col(ts))

    def kept(j: int) -> Column:
        return F.filter(names[j - 1], lambda t: t.bitwiseAND(F.lit((1 << 2 * j) - 1)) == 0)

    for j in range(1, LEVELS):
        df = df.withColumn(names[j], kept(j))

    def codes(j: int) -> Column:
        part = lambda t: F.shiftrightunsigned(t, 60 - 4 * j).bitwiseAND(F.lit(PARTS - 1))
        return F.transform(names[j], lambda t: F.shiftleft(part(t) + j * PARTS, _TERM_BITS).bitwiseOR(t.bitwiseAND(F.lit(low))))

    return df.withColumn(to, F.array_sort(F.concat(*[codes(j) for j in range(LEVELS)]))).drop(*names)


def entries(codes: Column) -> Column:
    """Subset numbers and hashes from sorted codes: 3 and 8 hex digits an entry, one after another."""
    first = lambda s: F.lpad(F.hex(s), 3, "0")
    digest = lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    start = F.struct(F.lit(-1).cast("long").alias("s"), F.lit(0).cast("long").alias("h"), F.lit("").alias("o"))

    def step(a: Column, c: Column) -> Column:
        s = F.shiftrightunsigned(c, _TERM_BITS)
        done = F.when(a["s"] < 0, "").otherwise(F.concat(a["o"], first(a["s"]), digest(a["h"])))
        same = F.struct(a["s"].alias("s"), F.xxhash64(a["h"], c).alias("h"), a["o"].alias("o"))
        return F.when(s == a["s"], same).otherwise(F.struct(s.alias("s"), F.xxhash64(F.lit(0).cast("long"), c).alias("h"), done.alias("o")))

    return F.aggregate(codes, start, step, lambda a: F.when(a["s"] < 0, "").otherwise(F.concat(a["o"], first(a["s"]), digest(a["h"]))))


def with_fingerprint(df: DataFrame, text: str, out: list[Column], to: str) -> DataFrame:
    """Adds the fingerprint of a text without the terms of the arrays in out; where none is left of all its terms,
    where there are none of the text itself. It is never empty, as level 0 has all terms."""
    kept = F.col("_terms")
    for o in out:
        kept = F.array_except(kept, o)
    df = df.withColumn("_terms", terms(F.col(text))).withColumn("_kept", kept)
    whole = F.when(F.size("_terms") > 0, F.col("_terms")).otherwise(F.array(F.xxhash64(F.lit("text"), text)))
    df = df.withColumn("_chosen", F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(whole))
    df = with_codes(df, "_chosen", "_codes")
    return df.withColumn(to, entries(F.col("_codes"))).drop("_terms", "_kept", "_chosen", "_codes")


def _list(fp: Column) -> Column:
    return F.filter(F.split(fp, "(?<=\\G.{11})"), lambda e: e != "")


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets, of those in either fingerprint, whose hashes are the same; 0 for a null."""
    x, y = _list(a), _list(b)
    keys = F.array_union(F.transform(x, lambda e: F.substring(e, 1, 3)), F.transform(y, lambda e: F.substring(e, 1, 3)))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.greatest(F.size(keys), F.lit(1)), F.lit(0.0))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, text with a key for each row: the id where ids are unique, else (and only then the texts are
    written once more, so that keys stay when a task is repeated) a number of its own."""
    d = documents(docs).withColumn("text", F.coalesce("text", F.lit("")))
    repeats = d.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if not repeats:
        return d.select("doc_id", F.col("doc_id").alias("row"), "text")
    return stored(d.select("doc_id", F.monotonically_increasing_id().alias("row"), "text"), "rows")


class Band:
    """What lies outside the band: frequent, an array column of at most MAX_FREQUENT terms, and rare, a table
    (row, rare) of the terms found in one row only, and of frequent ones where they are more. The share holds for any
    number of documents; where it leaves a text no term (as in a table of a few documents), all its terms count."""

    def __init__(self, d: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE):
        if min_docs not in (1, 2):
            raise ValueError("min_docs is 1 or 2")
        n = d.count()
        pairs = d.select("row", F.explode(terms(F.col("text"))).alias("t"))
        counts = pairs.groupBy("t").agg(F.count("*").alias("n"), F.max("row").alias("row"))
        outside = cut(counts.where((F.col("n") < min_docs) | (F.col("n") > F.lit(max_share * n))))
        above = outside.where(F.col("n") >= min_docs).select("t")
        often = above.count()
        own = outside.where(F.col("n") < min_docs).select("row", "t")
        if often > MAX_FREQUENT:
            own = own.union(pairs.join(above, "t", "left_semi").select("row", "t"))
        held = sorted(r["t"] for r in above.collect()) if often <= MAX_FREQUENT else []
        self.frequent = F.array(*[F.lit(t) for t in held]).cast("array<bigint>")
        self.rare = own.groupBy("row").agg(F.collect_list("t").alias("rare"))


def successors(d: DataFrame) -> DataFrame:
    """row, n_chars, next (row, doc_id) by ascending id and row, the first after the last; only keys and lengths move.

    Rows are range-partitioned and each range is a window; the ends of ranges, a row a range, link the ranges. Rows
    of one id are dealt over ranges like any others.
    """
    spark = d.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = d.select("doc_id", "row", F.char_length("text").cast("long").alias("n_chars"))
    own = cut(own.repartitionByRange(n, "doc_id", "row").withColumn("range", F.spark_partition_id()))
    w = Window.partitionBy("range").orderBy("doc_id", "row")
    at = F.struct("doc_id", "row")
    inner = own.select("range", "row", "n_chars", F.lead(at).over(w).alias("next"))
    heads = own.groupBy("range").agg(F.min(at).alias("head"))
    order = Window.orderBy("range")
    ends = heads.select("range", F.lead("head").over(order).alias("after"), F.min("head").over(Window.partitionBy()).alias("least"))
    return inner.join(F.broadcast(ends), "range").select("row", "n_chars", F.coalesce("next", "after", "least").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint for each row of docs. Null texts are empty, a null id is -1; equal texts, and texts
    with the same terms in the band, have equal fingerprints. Rows that share an id are documents of their own. Texts without
    terms, however long, get the hash of the text itself. Other columns are ignored, whatever their names. No rows give no rows."""
    d = _rows(docs)
    band = Band(d)
    both = d.join(band.rare, "row", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<bigint>")))
    return with_fingerprint(both, "text", [band.frequent, F.col("rare")], "fingerprint").select("doc_id", "text", "fingerprint")


def compare_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256 (of the text with its last half replaced by the next document's start),
    fingerprint, edited_fingerprint, near_edited, near_next.

    A row for each row of docs. Rows that share an id (null ids are -1) are documents of their own, next to one another in an
    order that is fixed for the call. One document is its own next. Null texts are empty. Other columns are ignored,
    whatever their names. No rows give no rows.
    """
    d = _rows(docs)
    band = Band(d)
    links = cut(successors(d))
    # For each document, the one before it and how much of this one's start that needs: what is sent there, with
    # the rare terms of this one.
    need = links.select(F.col("next.row").alias("row"), F.col("next.doc_id").alias("doc_id"), F.col("row").alias("before"), F.floor(F.col("n_chars") / 2).cast("int").alias("need"))
    # The id comes from there, so that both uses of the texts below share one exchange of (row, text).
    own = d.select("row", "text").join(band.rare, "row", "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<bigint>"))).join(need, "row")
    given = own.select(F.col("before").alias("row"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("start"), F.col("rare").alias("next_rare"))
    n = F.char_length("text")
    both = own.drop("need").join(given, "row").withColumn("n_chars", n.cast("long"))
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 2)).cast("int")), "start"))
    both = with_fingerprint(both, "text", [band.frequent, F.col("rare")], "fingerprint")
    both = with_fingerprint(both, "edited", [band.frequent, F.col("rare"), F.col("next_rare")], "edited_fingerprint")
    # Written once, as each fingerprint is read at two documents.
    out = stored(both.select("doc_id", "row", "before", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"), "imatch")
    after = out.select(F.col("before").alias("row"), F.col("fingerprint").alias("next_fingerprint"))
    return out.join(after, "row").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(read(spark, sf_dir, "documents"))
