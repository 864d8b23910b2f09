"""Homomorphic multiset fingerprints of documents, by DataFrame functions alone.

A paragraph (line) is hashed to a wide vector: EXACT lanes of 32 bits hash its whole text, and LIKE lanes of
32 bits add a random sign for each of its word pairs. A document's fingerprint is the sum of its paragraphs'
vectors, lane by lane modulo 2^32, with the number of word pairs. So it doesn't depend on the order of
paragraphs, and adding or subtracting a paragraph's vector inserts or deletes that paragraph. Equal multisets of
paragraphs have equal fingerprints; the LIKE lanes are a random projection of the multiset of word pairs, so their
cosine estimates how alike two documents are, with a standard error of at most 1 / sqrt(LIKE).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT, LIKE = 8, 128
#: Cells of the document order that a broadcast may hold, at 48 bytes each, and documents of a cell that there are at least on average.
CELLS, ROWS = 1_000_000, 256
#: Bits by which a cell of more than MANY times the average is divided again.
FINER, MANY = 12, 4


def _long(name: str) -> Column:
    return F.col(name).cast("long")


def _wrapped(x: Column) -> Column:
    half = F.lit(1 << 31)
    return ((x + half).bitwiseAND(F.lit((1 << 32) - 1)) - half).cast("int")


def vectors(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and fp, a struct of pairs long, exact array<long> and like array<int>, for each distinct ``keys``.

    Rows of the same keys add up. If ``df`` is already dealt out by some of the keys, nothing is shuffled; else each
    task sends one row of sums for each key. Null text is empty; an empty text is one empty paragraph.
    """
    names = [f"__{i}" for i in range(len(keys))]
    whole = [f"__x{j}" for j in range(EXACT // 2)]
    lines = df.select(
        *(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)),
        F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("__n", "__line"),
    )
    words = F.split("__line", " ", -1)
    pairs = lines.select(
        *names, "__n", *(F.xxhash64(F.lit(-1 - j), "__line").alias(x) for j, x in enumerate(whole)),
        F.posexplode(F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))).alias("__at", "__pair"),
    ).select(
        *names, "__n", F.shiftright("__at", 6).alias("__part"), *whole,
        *(F.xxhash64(F.lit(j), F.col("__pair.a"), F.col("__pair.b")).alias(f"__h{j}") for j in range(LIKE // 64)),
    )
    # first up to 64 pairs of a line, whose bits are counted in bytes, eight to a long; then these, two counts to a long
    ones = F.lit(0x0101010101010101)
    counts = [F.sum(F.shiftrightunsigned(f"__h{j}", i).bitwiseAND(ones)).alias(f"c{8 * j + i}") for j in range(LIKE // 64) for i in range(8)]
    parts = pairs.groupBy(*names, "__n", "__part", *whole).agg(F.count(F.lit(1)).alias("n"), *counts)
    bytes_ = F.lit(0x000000FF000000FF)
    sums = [
        F.sum(F.shiftrightunsigned(f"c{8 * j + i}", 8 * m).bitwiseAND(bytes_)).alias(f"s{32 * j + 8 * m + i}")
        for j in range(LIKE // 64) for m in range(4) for i in range(8)
    ]
    low = F.lit((1 << 32) - 1)
    for j, x in enumerate(whole):
        first = F.when(F.col("__part") == 0, F.col(x)).otherwise(F.lit(0))
        sums += [F.sum(first.bitwiseAND(low)).alias(f"e{2 * j}"), F.sum(F.shiftrightunsigned(first, 32)).alias(f"e{2 * j + 1}")]
    total = parts.groupBy(*names).agg(F.sum("n").alias("pairs"), *sums)

    def signed(ones: Column) -> Column:
        """Sum of signs, +1 for a set bit and -1 for another, modulo 2^32 and around 0."""
        return _wrapped(ones * 2 - F.col("pairs"))

    like = [x for k in range(LIKE // 2) for x in (signed(F.col(f"s{k}").bitwiseAND(low)), signed(F.shiftrightunsigned(f"s{k}", 32)))]
    exact = [F.col(f"e{k}").bitwiseAND(low) for k in range(EXACT)]
    fp = F.struct(F.col("pairs"), F.array(*exact).alias("exact"), F.array(*like).alias("like"))
    return total.select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), fp.alias("fp"))


def as_text(fp: Column) -> Column:
    """A fingerprint as lower-case hex: the number of pairs, the EXACT and the LIKE lanes."""
    exact, like = fp.getField("exact"), fp.getField("like")
    longs = [fp.getField("pairs")]
    longs += [F.shiftleft(exact[k], 32).bitwiseOR(exact[k + 1]) for k in range(0, EXACT, 2)]
    low = F.lit((1 << 32) - 1)
    longs += [F.shiftleft(like[k].cast("long"), 32).bitwiseOR(like[k + 1].cast("long").bitwiseAND(low)) for k in range(0, LIKE, 2)]
    return F.lower(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in longs)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the union of two multisets of paragraphs (sign 1), or of ``a`` with ``b`` deleted (-1)."""
    low = F.lit((1 << 32) - 1)
    return F.struct(
        (a.getField("pairs") + b.getField("pairs") * sign).alias("pairs"),
        F.zip_with(a.getField("exact"), b.getField("exact"), lambda x, y: (x + y * sign).bitwiseAND(low)).alias("exact"),
        F.zip_with(a.getField("like"), b.getField("like"), lambda x, y: _wrapped(x.cast("long") + y.cast("long") * sign)).alias("like"),
    )


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.getField("like"), b.getField("like"), lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the cosine of the LIKE lanes, from 0 to 1."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    cosine = F.coalesce(F.try_divide(_dot(a, b), norms), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def _cells(docs: DataFrame, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, h, text) with __l, __a and __b, which name an interval of (doc_id, h), and those intervals: cell, their number in ascending
    order, before, the number before it (the last for the first), and __first, __h, a cell's least doc_id and its least h.

    Ids are cut in equal widths first; a cell that holds MANY times the average is cut FINER bits further, by ids and then, where all have one id or none,
    by h, until none does or all its rows are equal. So gaps and clusters of ids don't matter, and cells are at most some CELLS, whatever the input.
    """
    n, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    low, high = low or 0, high or 0
    rows = max(rows, n // CELLS)
    shift = 0
    while (high >> shift) - (low >> shift) >= max(1, n // rows) and shift < 62:
        shift += 1
    cuts = [(s, 64) for s in range(shift, 0, -FINER)] + [(0, 64)] + [(0, s) for s in range(64 - FINER, 0, -FINER)] + [(0, 0)]

    def part(level: int) -> list[Column]:
        by_id, by_hash = cuts[level]
        of_id = F.coalesce(F.shiftright("doc_id", by_id), F.lit((low >> by_id) - 1).cast("long"))
        return [F.lit(level).alias("__l"), of_id.alias("__a"), (F.shiftright("h", by_hash) if by_hash < 64 else F.lit(0).cast("long")).alias("__b")]

    named = docs.select("doc_id", "h", "text", *part(0))
    for level in range(len(cuts) - 1):
        sizes = named.where(F.col("__l") == level).groupBy("__l", "__a", "__b").count()
        heavy = sizes.where(F.col("count") > MANY * rows).select("__l", "__a", "__b").collect()  # CELLS / MANY at most
        if not heavy:
            break
        table = docs.sparkSession.createDataFrame(heavy, "__l int, __a long, __b long").withColumn("__heavy", F.lit(True))
        named = named.join(F.broadcast(table), ["__l", "__a", "__b"], "left")
        finer = [F.when(F.col("__heavy"), x).otherwise(F.col(c)).alias(c) for x, c in zip(part(level + 1), ("__l", "__a", "__b"), strict=True)]
        named = named.select("doc_id", "h", "text", *finer)
    first = F.min(F.struct("doc_id", "h"))  # null is the least
    order = Window.orderBy("__first", "__h")
    firsts = named.groupBy("__l", "__a", "__b").agg(first.alias("f")).select("__l", "__a", "__b", F.col("f.doc_id").alias("__first"), F.col("f.h").alias("__h"))
    firsts = firsts.withColumn("cell", F.row_number().over(order))
    last = firsts.agg(F.max("cell").alias("__last"))
    return named, firsts.crossJoin(F.broadcast(last)).withColumn("before", F.when(F.col("cell") > 1, F.col("cell") - 1).otherwise(F.col("__last"))).drop("__last")


def edited(documents: DataFrame, rows: int = ROWS) -> DataFrame:
    """Every document in pieces, with n_chars and the edited text's SHA-256, in cells: the lines that the edit leaves whole
    (which 0; none if it leaves none), the rest of the text (1), and the rest of the edited text (2).

    Documents are in ascending order of doc_id, null first, ties by a hash of the text; each one's last quarter of code points makes
    way for the beginning of the next (after the last: the first; a single document follows itself). Texts are shuffled
    once, to the cell of their id; a cell's first document also goes to the cell before it, as its last row (guest 1, no edit).
    Only rows that are equal in doc_id and text must meet in one cell.
    """
    docs = documents.select(_long("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs, firsts = _cells(docs.withColumn("h", F.xxhash64("text")), rows)
    docs = docs.join(F.broadcast(firsts), ["__l", "__a", "__b"])
    own = F.struct(F.col("cell").alias("cell"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("before").alias("cell"), F.lit(1).alias("guest"))
    is_first = F.col("doc_id").eqNullSafe(F.col("__first")) & (F.col("h") == F.col("__h"))
    placed = docs.select("doc_id", "h", "text", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("p"))
    placed = placed.select("doc_id", "h", "text", "p.cell", "p.guest").repartition("cell")
    order = Window.partitionBy("cell").orderBy("guest", "doc_id", "h", "text")
    texts = placed.select(
        "cell", "guest", "doc_id", "text", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("after"),
        F.char_length("text").alias("n"), F.floor(F.char_length("text") / 4).cast("int").alias("cut"),
    )
    texts = texts.withColumn("stays", F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("cut")))
    texts = texts.withColumn("comes", F.when(F.col("guest") == 0, F.substring(F.col("after"), F.lit(1), F.col("cut"))))
    texts = texts.withColumn("open", F.substring_index("stays", "\n", -1))
    whole = F.char_length("stays") - F.char_length("open") - 1
    pieces = F.array(
        F.when(whole >= 0, F.substring(F.col("stays"), F.lit(1), whole)),
        F.concat("open", F.substring(F.col("text"), F.col("n") - F.col("cut") + 1, F.col("cut"))),
        F.concat("open", "comes"),
    )
    return texts.select(
        "cell", "guest", "doc_id", "at", F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.concat("stays", "comes").cast("binary"), 256).alias("edited_sha256"), F.posexplode(pieces).alias("which", "text"),
    ).where("text is not null")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every document (see ``edited``)."""
    rows = edited(documents)
    keys = ["cell", "at", "guest", "doc_id", "n_chars", "edited_sha256", "which"]
    fps = vectors(rows, keys)
    # what the edit leaves is hashed once: the edited text's fingerprint deletes the old rest and inserts the new
    pieces = fps.groupBy(*keys[:-1]).agg(*(F.max(F.when(F.col("which") == k, F.col("fp"))).alias(f"fp{k}") for k in range(3)))
    added = lambda c: F.when(F.col("fp0").isNull(), F.col(c)).otherwise(combine(F.col("fp0"), F.col(c)))
    both = pieces.select(*keys[:-1], added("fp1").alias("fp"), added("fp2").alias("edited_fp"))
    after = F.lead("fp").over(Window.partitionBy("cell").orderBy("at"))
    both = both.withColumn("next_fp", after).where("guest = 0")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
