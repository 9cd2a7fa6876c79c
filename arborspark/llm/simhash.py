"""Document fingerprints by SimHash, with DataFrame functions only.

The terms of a text are its words, lower-cased, each with the word that follows;
a term weighs as often as it occurs.  Each occurrence votes with the 128 bits of
its hash: a set bit for, a clear bit against.  A fingerprint has the bits that
won.  Votes are counted by sums of masked shifts, several counters in a long, so
the aggregation stays in generated code.  Likeness of two fingerprints is the
share of equal bits.

Pairs of fingerprints within a small Hamming radius are found in permuted block
tables: of radius + 1 blocks at least one is equal in such a pair, so each block
in turn leads a table that is joined on it; a pair counts in the first block that
agrees, and is then verified on all bits.

near_class is the smallest doc_id that links between fingerprints within a wide
radius reach, where radius + 1 blocks get too short.  Of radius / 2 + 1 blocks one
differs in at most one bit in such a pair, so of its four parts three are equal:
each block gives four tables, joined on three of its parts.  A pair counts in the
first table that agrees.  Sorted rotations of the fingerprints link neighbours
first; the tables then look for pairs of different classes only, so the pairs of a
group of near copies are never written.  The work of comparing grows with the
square of the number of distinct fingerprints, about a twentieth of all pairs
being looked at.

Defined cases: a null text is empty; a text without words has no votes and the
fingerprint of all zeros; repeated rows are fingerprinted each; among equal
doc_ids the order is that of the text's hash; null doc_ids come last; a single
document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .ranges import sampled_ranges
from .shared import cut, documents

_HALVES = ("hi", "lo")

#: Bits of 128 within which fingerprints are near: texts of a five-word similarity of 0.8 seldom lie farther apart.
RADIUS = 19

#: Rows of one table and key that are held against each other in one cell.
CELL_ROWS = 1 << 14


#: White space of ASCII, and how many terms are counted in counters of a byte: the greatest counter keeps its sign.
BLANKS = " \t\n\x0b\f\r"
CHUNK = 127
_BYTES = 0x0101010101010101
_BYTE_PAIR = 0x000000FF000000FF


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, hi, lo: the fingerprint of each row, as two longs, zero without terms; keys are unique.

    Votes are counted twice: chunks of a text's terms in counters of a byte, eight
    in a long, then the chunks' sums in counters of 32 bits.
    """
    bare = F.btrim(F.lower(F.col(text)), F.lit(BLANKS))
    names = F.when(bare != "", F.transform(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w)))
    each = texts.select(*keys, names.alias("names_")).select(*keys, "names_", F.posexplode_outer("names_").alias("p_", "w_"))
    # a text without words has one row here, which votes for nothing
    term = F.when(F.col("w_").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("w_", F.get("names_", F.col("p_") + 1)))
    terms = each.select(*keys, F.floor(F.coalesce("p_", F.lit(0)) / CHUNK).alias("chunk_"), F.col("w_").isNotNull().cast("long").alias("some_"), term.alias("lo_"))
    terms = terms.withColumn("hi_", F.when(F.col("some_") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64("lo_")))
    counters = [F.sum(F.shiftrightunsigned(f"{half}_", j).bitwiseAND(F.lit(_BYTES))).alias(f"{half}{j}_") for half in _HALVES for j in range(8)]
    chunks = terms.groupBy(*keys, "chunk_").agg(F.sum("some_").alias("n_"), *counters)
    sums = [F.sum(F.shiftrightunsigned(f"{half}{j}_", 8 * m).bitwiseAND(F.lit(_BYTE_PAIR))).alias(f"{half}{j}_{m}_") for half in _HALVES for j in range(8) for m in range(4)]
    votes = chunks.groupBy(*keys).agg(F.sum("n_").alias("n_"), *sums)

    def bits(half: str) -> Column:
        won = []
        for place in range(64):
            lane, j = divmod(place, 8)
            count = F.shiftrightunsigned(f"{half}{j}_{lane % 4}_", 32 * (lane // 4)).bitwiseAND(F.lit(0xFFFFFFFF))
            won.append(F.when(2 * count > F.col("n_"), F.lit((1 << place) - (1 << 64 if place == 63 else 0))).otherwise(F.lit(0)))
        while len(won) > 1:
            won = [won[i].bitwiseOR(won[i + 1]) for i in range(0, len(won), 2)]
        return won[0].cast("long")

    return votes.select(*keys, *(bits(half).alias(half) for half in _HALVES))


def distance(a: str, b: str) -> Column:
    """Hamming distance of the fingerprints with these column prefixes."""
    return sum((F.bit_count(F.col(f"{a}{half}").bitwiseXOR(F.col(f"{b}{half}"))) for half in _HALVES[1:]), F.bit_count(F.col(f"{a}{_HALVES[0]}").bitwiseXOR(F.col(f"{b}{_HALVES[0]}"))))


def as_hex(hi: str, lo: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def near_fingerprints(prints: DataFrame, radius: int = 3) -> DataFrame:
    """a_hi, a_lo, b_hi, b_lo, distance of all pairs of different fingerprints (hi, lo) within the radius, each once, a < b."""
    blocks, width = radius + 1, 128 // (radius + 1)
    if not 1 <= radius <= 15:
        raise ValueError("radius is 1 to 15")

    def block(i: int) -> Column:
        start, stop = i * width, (i + 1) * width if i < blocks - 1 else 128
        parts = []
        for half, base in (("lo", 0), ("hi", 64)):
            a, b = max(start, base) - base, min(stop, base + 64) - base
            if a < b:
                mask = (1 << b - a) - 1
                parts.append(F.shiftrightunsigned(half, a).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        return F.concat_ws("/", F.lit(i), *(x.cast("string") for x in parts)) if len(parts) > 1 else F.concat_ws("/", F.lit(i), parts[0].cast("string"))

    distinct = prints.select("hi", "lo").distinct()
    tables = distinct.select("hi", "lo", F.array(*(F.xxhash64(block(i)) for i in range(blocks))).alias("blocks"))
    rows = tables.select("hi", "lo", "blocks", F.posexplode("blocks").alias("table", "key"))
    a = rows.select("key", "table", *(F.col(c).alias(f"a_{c}") for c in ("hi", "lo", "blocks")))
    b = rows.select(F.col("key").alias("key_"), *(F.col(c).alias(f"b_{c}") for c in ("hi", "lo", "blocks")))
    earlier = F.exists(F.zip_with(F.slice("a_blocks", 1, F.col("table")), F.slice("b_blocks", 1, F.col("table")), lambda x, y: x == y), lambda same: same)
    ordered = (F.col("a_hi") < F.col("b_hi")) | (F.col("a_hi") == F.col("b_hi")) & (F.col("a_lo") < F.col("b_lo"))
    found = a.join(b, (F.col("key") == F.col("key_")) & ordered & (distance("a_", "b_") <= radius) & ~earlier)
    return found.select("a_hi", "a_lo", "b_hi", "b_lo", distance("a_", "b_").alias("distance"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class _Tables:
    """The permuted tables of a wide radius, and what a pair found in them has to meet.

    Of radius / 2 + 1 blocks one differs in at most one bit in a near pair, so of its
    four parts three are equal: each block gives four tables.
    """

    def __init__(self, radius: int):
        if not 1 <= radius <= 31:
            raise ValueError("radius is 1 to 31")
        self.radius = radius
        each = (radius // 2 + 2) // 2  # blocks of a half; twice as many are radius // 2 + 1 at least
        edges = [64 * k // (4 * each) for k in range(4 * each + 1)]
        parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
        self.blocks = [(half, parts[4 * i : 4 * i + 4]) for half in _HALVES for i in range(each)]

    @staticmethod
    def _mask(bits: int) -> Column:
        return F.lit(_signed(bits)).cast("long")

    def dealt(self, distinct: DataFrame, *others: str) -> tuple[DataFrame, bool]:
        """Rows of distinct (hi, lo) once for each table; a large group is dealt to chunks, and each two of these meet in a cell."""
        values = [F.col(half).bitwiseAND(self._mask(sum(four) - left)) for half, four in self.blocks for left in four]
        tables = distinct.select("hi", "lo", *others, F.posexplode(F.array(*values)).alias("table", "value"))
        large = cut(tables.groupBy("table", "value").count().where(F.col("count") > CELL_ROWS).select("table", "value", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("chunks")))
        if large.isEmpty():
            return tables.withColumns({"chunk": F.lit(0), "cell": F.lit(0).cast("long")}), False
        # tables and values are few, so large is small however many rows there are
        rows = tables.join(F.broadcast(large), ["table", "value"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("hi", "lo"), F.col("chunks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        cell = F.least("chunk", "other").cast("long") * F.col("chunks") + F.greatest("chunk", "other")
        return rows.withColumn("cell", cell).withColumn("chunk", F.when(F.col("chunk") == F.col("other"), F.lit(-1)).otherwise(F.col("chunk"))).drop("other", "chunks"), True

    def pairs(self, distinct: DataFrame, *others: str, given: Column | None = None) -> DataFrame:
        """All ordered pairs of different rows within the radius, each once: columns of both with a_ and b_ before their names.

        With a condition `given`, which no row meets with itself: the pairs that meet it, each once or more often.
        """
        rows, chunked = self.dealt(distinct, *others)
        side = lambda name: rows.select(F.col("table").alias(f"{name}table"), F.col("value").alias(f"{name}value"), F.col("cell").alias(f"{name}cell"), *(F.col(c).alias(f"{name}{c}") for c in ("hi", "lo", "chunk", *others)))
        differ = lambda half, bits: F.col(f"a_{half}").bitwiseXOR(F.col(f"b_{half}")).bitwiseAND(self._mask(bits)) != 0
        within = distance("a_", "b_") <= self.radius
        unequal = (F.col("a_hi") != F.col("b_hi")) | (F.col("a_lo") != F.col("b_lo"))
        cells = (F.col("a_chunk") != F.col("b_chunk")) | (F.col("a_chunk") == -1) if chunked else F.lit(True)
        earlier, same = F.lit(False), F.lit(False)
        for i, (half, four) in enumerate(self.blocks):
            agrees = sum((differ(half, bits).cast("int") for bits in four[1:]), differ(half, four[0]).cast("int")) <= 1
            earlier = earlier | (F.col("a_table") >= 4 * i + 4) & agrees
            # four tables find a pair with an equal block: the first one counts it
            same = same | F.col("a_table").between(4 * i + 1, 4 * i + 3) & ~differ(half, sum(four))
        keys = (F.col("a_table") == F.col("b_table")) & (F.col("a_value") == F.col("b_value")) & (F.col("a_cell") == F.col("b_cell"))
        # the shorter condition stays within what the JVM compiles
        condition = keys & within & given if given is not None else keys & within & unequal & cells & ~same & ~earlier
        return side("a_").join(side("b_").hint("merge"), condition)


def near_counts(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """hi, lo, n_near of each distinct fingerprint: the other rows of prints (hi, lo) within the radius, those with the same fingerprint included."""
    distinct = cut(prints.fillna(0, ["hi", "lo"]).groupBy("hi", "lo").agg(F.count("*").alias("w")))
    found = _Tables(radius).pairs(distinct, "w")
    sums = found.groupBy(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).agg(F.sum("b_w").alias("n"))
    return distinct.join(sums, ["hi", "lo"], "left").select("hi", "lo", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_near"))


#: Rotations whose sorted orders give the first links, and leading bits that share a window.
ROTATIONS, LEADING = 16, 12


def near_classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """hi, lo, near_class of each distinct fingerprint of prints (hi, lo, doc_id).

    Links join fingerprints within the radius; near_class is the smallest doc_id that
    links reach (null only if there is none).  First, fingerprints are sorted by each of
    some rotations of their bits, and neighbours that are near are linked, which ties a
    group of many near copies together without its pairs.  The tables then give every
    near pair that still lies in two classes, so no link between classes is lost.
    """
    whole = prints.fillna(0, ["hi", "lo"]).groupBy("hi", "lo").agg(F.min("doc_id").alias("least"))
    distinct = cut(whole.withColumn("id", F.monotonically_increasing_id()))
    turned = []
    for i in range(ROTATIONS):
        shift = 64 * (i // 2) // (ROTATIONS // 2)
        one, two = _HALVES if i % 2 == 0 else _HALVES[::-1]
        turn = lambda a, b: F.shiftleft(a, shift).bitwiseOR(F.shiftrightunsigned(b, 64 - shift)) if shift else F.col(a)  # noqa: B023, E731
        turned.append(F.struct(turn(one, two).alias("x"), turn(two, one).alias("y")))
    ordered = distinct.select("id", "hi", "lo", F.posexplode(F.array(*turned)).alias("turn", "key"))
    ordered = ordered.select("id", "hi", "lo", "turn", F.shiftrightunsigned("key.x", 64 - LEADING).alias("lead"), "key.x", "key.y")
    order = Window.partitionBy("turn", "lead").orderBy("x", "y")
    beside = ordered.select(F.col("id").alias("a"), F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), *(F.lag(c).over(order).alias(d) for c, d in (("id", "b"), ("hi", "b_hi"), ("lo", "b_lo"))))
    links = cut(beside.where(F.col("b").isNotNull() & (distance("a_", "b_") <= radius)).select("a", "b").distinct())
    parts = components(links, native=True).withColumnRenamed("node", "id")
    parted = cut(distinct.join(parts, "id", "left").select("id", "hi", "lo", F.coalesce("component", "id").alias("part")))
    apart = F.col("a_part") < F.col("b_part")
    more = _Tables(radius).pairs(parted, "part", given=apart).select(F.col("a_part").alias("a"), F.col("b_part").alias("b")).distinct()
    classes = components(more, native=True).select(F.col("node").alias("part"), F.col("component").alias("class"))
    named = cut(parted.join(classes, "part", "left").select("id", F.coalesce("class", "part").alias("class")).join(distinct, "id"))
    least = named.groupBy("class").agg(F.min("least").alias("near_class"))
    return named.join(least, "class").select("hi", "lo", "near_class")


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by as many
    first ones of the next document's, by falling doc_id; after the last comes the
    first.  Texts move once, to the range of their doc_id; the next one is then in
    the same range, or the first of the next range.  near_class is the
    smallest doc_id of the class of near fingerprints.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({
        "a_": F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)), "b_": F.xxhash64("text")})
    light = cut(rows.select("a_", "b_", (F.length("text").cast("long") + 1).alias("w_")))
    ranges = sampled_ranges(light, "a_", "b_", "w_")
    if not sum(ranges.rows):
        ranges.rows = [1]
    order = Window.partitionBy("r_").orderBy("a_", "b_")
    ranged = rows.withColumn("r_", ranges.of("a_", "b_")).withColumns({"i_": F.row_number().over(order), "next_": F.lead("text").over(order)})
    # the first text of each range follows the last one of the range before; its key is found without texts
    before = {y: x for x, y in enumerate(ranges.following()) if y >= 0}
    prior = F.array(*(F.lit(before.get(i, -1)) for i in range(len(ranges.rows))))
    heads = cut(light.groupBy(ranges.of("a_", "b_").alias("r_")).agg(F.min(F.struct("a_", "b_")).alias("k_")).select("r_", "k_.a_", "k_.b_"))
    firsts = rows.join(F.broadcast(heads), ["a_", "b_"]).dropDuplicates(["r_"]).select(F.element_at(prior, F.col("r_") + 1).alias("r_"), F.col("text").alias("wrap_"))
    paired = ranged.join(firsts, "r_", "left").withColumn("next_", F.coalesce("next_", "wrap_"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_", F.lit(1), half))
    paired = paired.select("r_", "i_", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    paired = paired.withColumn("edited_sha256", F.sha2("edited", 256))
    keys = ["r_", "i_", "doc_id", "n_chars", "edited_sha256"]
    own = F.struct(F.lit(0).alias("kind"), F.col("text").alias("t"))
    other = F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))
    both = paired.select(*keys, F.explode(F.array(own, other)).alias("x")).select(*keys, "x.kind", "x.t")
    made = fingerprints(both, [*keys, "kind"], "t")
    of_kind = lambda kind, half: F.max(F.when(F.col("kind") == kind, F.col(half)))
    table = cut(made.groupBy(*keys).agg(of_kind(0, "hi").alias("hi"), of_kind(0, "lo").alias("lo"), of_kind(1, "hi").alias("e_hi"), of_kind(1, "lo").alias("e_lo")))
    pair = F.struct("hi", "lo")
    chained = table.withColumn("next_", F.lead(pair).over(Window.partitionBy("r_").orderBy("i_")))
    starts = table.where("i_ = 1").select(F.element_at(prior, F.col("r_") + 1).alias("r_"), pair.alias("wrap_"))
    chained = chained.join(starts, "r_", "left").withColumn("next_", F.coalesce("next_", "wrap_")).withColumns({"n_hi": F.col("next_.hi"), "n_lo": F.col("next_.lo"), "o_hi": F.col("hi"), "o_lo": F.col("lo")})
    classes = near_classes(table.select("hi", "lo", "doc_id"), radius)
    likeness = lambda a, b: 1 - distance(a, b) / 128.0
    return chained.join(classes, ["hi", "lo"], "left").select(
        "doc_id", "n_chars", "edited_sha256", as_hex("hi", "lo").alias("fingerprint"), as_hex("e_hi", "e_lo").alias("edited_fingerprint"),
        likeness("o_", "e_").alias("near_edited"), likeness("o_", "n_").alias("near_next"), "near_class",
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
