"""Fuzzy line dedup with DataFrame functions only.

Lines are normalised (lower case, single spaces) and equal ones collapsed by a 128-bit hash.  Every distinct line gets a SimHash
of five blocks, one for each fifth of its different words: a word belongs to the block that its first character names, so a typo
inside a word changes one block, another word two at most, and the others keep every bit.  Repeats do not count, or the bits of a
block would be those of its most common word.  Lines join on any three equal blocks, which by the
pigeonhole principle finds all pairs with two changed blocks or fewer.  Edit similarity verifies, on characters, or on words where
the longer line has over ``LONG`` characters; the first line of every connected group is kept.

Lines are numbered in the order of the stored table.  Votes are counted by a plain aggregation over words, in generated code,
several counters to a number.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.llm.common import cut_lineage, with_row
from eventloom.llm.components import connected_components
from eventloom.operators.settle import settle

SIMILARITY = 0.9
# Lines of fewer words are taken by pairs of characters.
FEW_WORDS = 4
LONG = 4096
_BLOCKS, _BITS = 5, 15
_TRIPLES = tuple(combinations(range(_BLOCKS), 3))
# Five counters of twelve bits to a number, for lines of so many words; longer lines get a number for each counter.
_LANES, _WIDTH = 5, 12
_ONES = sum(1 << (_WIDTH * k) for k in range(_LANES))
_HIGH = 1 << (_WIDTH - 1)
_NARROW = _HIGH - 1
# Places are told by one bit each, so many powers of two to a number.
_PLACE_BITS = 6


def normalise(line: Column) -> Column:
    """Lower case, words joined by single spaces; lines that are so but for their case, as most are, are only lowered."""
    uneven = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for space in ("  ", "\t", "\r", "\x0b", "\x0c"):
        uneven = uneven | line.contains(space)
    return F.when(uneven, F.btrim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]++", " "))).otherwise(F.lower(line))


def places_of(docs: DataFrame) -> DataFrame:
    """``(_id, _row, _line, _at, line)`` of every line; ``docs`` has ``_id``, ``_row`` and ``text``.

    ``_at`` numbers the lines of the table in its order, the same on every read of a stored table.
    """
    lines = docs.select("_id", "_row", F.posexplode(F.split("text", "\n", -1)).alias("_line", "line"))
    return lines.select("_id", "_row", "_line", F.monotonically_increasing_id().alias("_at"), "line")


def lines_of(docs: DataFrame, least: int = 0) -> DataFrame:
    """``(_at, text)`` of every normalised line with a word; of long lines only, if ``least`` characters are asked for."""
    # A filter on the normalised text would be pushed down and normalise every line twice.
    places = places_of(docs)
    if least:
        # Lower case may take more bytes than the text had, up to three for one; the number of bytes is known unread.
        places = places.where(F.octet_length("line") * 3 >= least)
    # Most lines begin with a word.
    worded = (F.ascii("line") > 32) | F.col("line").rlike(r"[^\x20\x09-\x0D]")
    return places.where(worded).select("_at", normalise(F.col("line")).alias("text"))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def features(text: Column, words: Column) -> Column:
    """The different ``words`` of a normalised line; of a line of few words its pairs of neighbouring characters, repeats included."""
    characters = F.split(text, "")
    pairs = F.transform(characters, lambda c, i: F.concat(c, F.coalesce(F.get(characters, i + 1), F.lit(""))))
    return F.when(F.size(words) >= FEW_WORDS, F.array_distinct(words)).otherwise(pairs)


def _packed_votes(rows: DataFrame) -> DataFrame:
    """Adds up the votes of lines of up to ``_NARROW`` words: three numbers a block, and one for all sizes."""
    steps = range(_BITS // _LANES)
    sums = [F.sum(F.when(F.col("g") == j, F.shiftright("h", s).bitwiseAND(_long(_ONES))).otherwise(_long(0))).alias(f"c{j}_{s}")
            for j in range(_BLOCKS) for s in steps]
    sizes = F.sum(F.expr(f"shiftleft(1L, {_WIDTH} * g)")).alias("sizes")
    counted = rows.groupBy("at", "h1", "h2", "length").agg(sizes, *sums)
    size = [F.shiftright("sizes", _WIDTH * j).bitwiseAND(_long((1 << _WIDTH) - 1)) for j in range(_BLOCKS)]
    # A counter above half the words carries into its top bit once that bit, less one and half the words, is added.
    carried = [[F.shiftright(F.col(f"c{j}_{s}") + (_long(_HIGH - 1) - F.shiftright(size[j], 1)) * _long(_ONES), _WIDTH - 1)
                .bitwiseAND(_long(_ONES)) for s in steps] for j in range(_BLOCKS)]

    def block(j: int) -> Column:
        value = _long(0)
        for s in steps:
            # Bit k is at _WIDTH * k; shifts that bring all of them down at once, as code of one step a bit is too long for the JVM to compile.
            low = carried[j][s]
            for k in range(1, _LANES):
                low = low.bitwiseOR(F.shiftright(carried[j][s], (_WIDTH - 1) * k))
            value = value.bitwiseOR(F.shiftleft(low.bitwiseAND(_long((1 << _LANES) - 1)), s * _LANES))
        return value

    # Lines that are counted apart have no votes here.
    apart = F.col("sizes").isNull().alias("apart")
    return counted.select(apart, "at", "h1", "h2", "length", *(size[j].alias(f"n{j}") for j in range(_BLOCKS)),
                          *(block(j).alias(f"b{j}") for j in range(_BLOCKS)))


def _wide_votes(rows: DataFrame) -> DataFrame:
    """The same for lines of any length, a row a block in between."""
    places = [(s * _LANES + k, s + _WIDTH * k) for s in range(_BITS // _LANES) for k in range(_LANES)]
    votes = [F.sum(F.shiftright("h", at).bitwiseAND(_long(1))).alias(f"v{bit}") for bit, at in places]
    counted = rows.groupBy("at", "h1", "h2", "length", "g").agg(F.count("*").alias("n"), *votes)
    value = sum((F.when(F.col(f"v{bit}") * 2 > F.col("n"), _long(1 << bit)).otherwise(_long(0)) for bit in range(_BITS)), _long(0))
    blocks = counted.select("at", "h1", "h2", "length", "g", "n", value.alias("b"))
    return blocks.groupBy("at", "h1", "h2", "length").agg(
        *(F.coalesce(F.max(F.when(F.col("g") == j, F.col(c))), _long(0)).alias(f"{c}{j}") for c in "nb" for j in range(_BLOCKS)))


def measured_lines(docs: DataFrame, narrow: int = _NARROW) -> DataFrame:
    """``(at, h1, h2, fp, rest)`` of every line of ``docs``: its 128-bit hash and its SimHash.

    A bit of a block is set if over half of the hashes of its words have it.  ``fp`` holds four blocks; ``rest`` the fifth, from bit
    15 on which triples of blocks are keys, and from bit 25 on the length.  A triple is a key if it holds two words or more, and at
    least a quarter of the line's.  Lines of more than ``narrow`` words are counted apart.  The votes are checkpointed.
    """
    def rows(wide: bool) -> DataFrame:
        # More words than ``narrow`` need as many characters.
        some = lines_of(docs, narrow if wide else 0).select(
            F.col("_at").alias("at"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"),
            F.length("text").alias("length"), "text", F.split("text", " ").alias("words"))
        # In steps: what stands beside an explode is computed for every exploded row.  A filter on the number of words, and the
        # one that Spark puts before an inner explode, would read the words twice.
        words = some.select("at", "h1", "h2", "length", features(F.col("text"), F.col("words")).alias("words"))
        chosen = F.when((F.size("words") > narrow) if wide else (F.size("words") <= narrow), F.col("words"))
        exploded = words.select("at", "h1", "h2", "length", chosen.alias("words")).select(
            "at", "h1", "h2", "length", F.explode_outer("words").alias("word"))
        # A line that is counted apart stays as one row without a word.
        return (exploded.where(F.col("word").isNotNull()) if wide else exploded).select(
            "at", "h1", "h2", "length", F.xxhash64("word").alias("h"),
            F.when(F.col("word").isNotNull(), F.pmod(F.xxhash64(F.substring("word", 1, 1)), F.lit(_BLOCKS)).cast("int")).alias("g"))

    total = sum((F.col(f"n{j}") for j in range(_BLOCKS)), _long(0))
    fp, rest = _long(0), F.col("b4").bitwiseOR(F.shiftleft(F.col("length").cast("long"), 25))
    for j in range(4):
        fp = fp.bitwiseOR(F.shiftleft(F.col(f"b{j}"), _BITS * j))
    for number, (i, j, k) in enumerate(_TRIPLES):
        held = F.col(f"n{i}") + F.col(f"n{j}") + F.col(f"n{k}")
        rest = rest.bitwiseOR(F.when((held >= 2) & (held * 4 >= total), _long(1 << (_BITS + number))).otherwise(_long(0)))
    fields = ("at", "h1", "h2", fp.alias("fp"), rest.alias("rest"))
    packed = cut_lineage(_packed_votes(rows(False)).select("apart", *fields))
    told = packed.where("NOT apart").drop("apart")
    # Lines are read again only where some are counted apart.
    if packed.where("apart").isEmpty():
        return told
    return told.unionByName(cut_lineage(_wide_votes(rows(True)).select(*fields)))


def block_keys(distinct: DataFrame) -> DataFrame:
    """``(key, at, length)`` of every line: one key for each triple of blocks with words enough."""
    mask = _long((1 << _BITS) - 1)

    def block(j: int) -> Column:
        return (F.shiftright("fp", _BITS * j) if j < 4 else F.col("rest")).bitwiseAND(mask)

    def key(number: int, i: int, j: int, k: int) -> Column:
        value = _long(number << (3 * _BITS)).bitwiseOR(F.shiftleft(block(i), 2 * _BITS)).bitwiseOR(F.shiftleft(block(j), _BITS)).bitwiseOR(block(k))
        return F.when(F.shiftright("rest", _BITS + number).bitwiseAND(_long(1)) == 1, value)

    keys = F.array(*(key(number, *triple) for number, triple in enumerate(_TRIPLES)))
    length = F.shiftright("rest", 25).cast("int").alias("length")
    return distinct.select("at", length, F.explode(keys).alias("key")).where(F.col("key").isNotNull())


def _allowed(longer: Column, similarity: float) -> Column:
    return F.floor(longer * F.lit(round(1 - similarity, 9)) + 1e-9).cast("int")


def spelled(text: Column) -> Column:
    """A line with one character per word: equal words get equal characters, others all but certainly different ones."""
    def character(word: Column) -> Column:
        code = F.lpad(F.hex(F.xxhash64(word)), 16, "0")
        return F.concat(F.translate(F.substring(code, 13, 1), "0123456789ABCDEF", "4567894567894567"), F.substring(code, 14, 3))

    return F.decode(F.unhex(F.array_join(F.transform(F.split(text, " "), character), "")), "UTF-16BE")


def similar_pairs(pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``pairs`` with 1 - edits / characters of the longer of ``one`` and ``two`` at least ``similarity``.

    Lengths that cannot do are told first.  Lines of as many words are similar if the edits from word to word are few enough, as the
    edits of the lines are no more.  All others are compared without the words common to both ends, which changes no distance.
    """
    longer, shorter = F.greatest(F.length("one"), F.length("two")), F.least(F.length("one"), F.length("two"))
    near = pairs.withColumn("allowed", _allowed(longer, similarity)).where(longer - shorter <= F.col("allowed"))
    # Each step is a projection of its own, so that no split is done again for every use.
    words = near.withColumn("a", F.split("one", " ")).withColumn("b", F.split("two", " "))
    by_word = F.aggregate(F.zip_with("a", "b", lambda x, y: F.when(x == y, 0).otherwise(F.levenshtein(x, y))), F.lit(0),
                          lambda total, edits: total + edits)
    # A bound by words is worth its price only where it is no comparison of all characters.
    many = (F.size("a") == F.size("b")) & (F.size("a") >= FEW_WORDS)
    told = words.withColumn("sure", (F.col("one") == F.col("two")) | F.when(many, by_word <= F.col("allowed")).otherwise(False))
    left = told.select(*pairs.columns, "allowed", "sure", *(F.when(~F.col("sure"), F.col(c)).alias(c) for c in "ab"))

    def common(a: Column, b: Column) -> Column:
        at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
        return F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int")

    head = left.withColumn("head", common(F.col("a"), F.col("b")))
    tail = head.withColumn("tail", F.least(common(F.reverse("a"), F.reverse("b")), F.least(F.size("a"), F.size("b")) - F.col("head")))

    def middle(c: str) -> Column:
        return F.slice(c, F.col("head") + 1, F.size(c) - F.col("head") - F.col("tail"))

    cut = tail.withColumn("a", middle("a")).withColumn("b", middle("b"))
    # Where one text has no words left between, a space goes or stays with the words of the other.
    whole = (F.size("a") == 0) | (F.size("b") == 0)
    distance = F.call_function("levenshtein", *(F.when(whole, F.col(text)).otherwise(F.array_join(c, " ")) for text, c in (("one", "a"), ("two", "b"))),
                               F.col("allowed"))
    # A filter on the verdict itself would be pushed down and repeat all steps for every use.
    judged = settle(cut.withColumn("same", F.when(F.col("sure"), True).otherwise(distance >= 0)), "same")
    return judged.where("same").select(*pairs.columns)


def line_groups(lines: DataFrame, measured: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(h1, h2, first)``: for every distinct line, the place of the first line of its connected group.

    ``measured`` are the hashes of ``lines``.  Lines are first compared with the first line of each key; then those of a key that
    are not in one group yet, with each other.  So no link is lost, and a large group of near copies is not compared pair by pair.
    """
    distinct = cut_lineage(measured.groupBy("h1", "h2").agg(
        F.min("at").alias("at"), F.max("fp").alias("fp"), F.max("rest").alias("rest")))
    # Dealt out by key once, for the counts and for the join.
    index = block_keys(distinct).repartition("key")
    first = F.min(F.struct("at", "length"))
    shared = index.groupBy("key").agg(first.alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    members = cut_lineage(index.join(shared.select(
        "key", F.col("first.at").alias("leader"), F.col("first.length").alias("length2")).hint("shuffle_hash"), "key"))

    def fitting(pairs: DataFrame) -> DataFrame:
        longer = F.greatest("length", "length2")
        return pairs.where(longer - F.least("length", "length2") <= _allowed(longer, similarity)).select("at", "at2").distinct()

    # Most lines are not involved; a bit for each of 64 places tells so before any text is normalised or moves.
    bits = members.select("at").groupBy(F.shiftright("at", _PLACE_BITS).alias("places")).agg(
        F.expr(f"bit_or(shiftleft(1L, CAST(at & {(1 << _PLACE_BITS) - 1} AS INT)))").alias("bits"))
    held = F.expr(f"shiftright(bits, CAST(_at & {(1 << _PLACE_BITS) - 1} AS INT)) & 1L") == 1
    some = lines.join(F.broadcast(bits), (F.shiftright("_at", _PLACE_BITS) == F.col("places")) & held, "left_semi")
    texts = cut_lineage(some.select(
        # Lines that only go with longer ones than ``LONG`` need no characters, and those that go with none of them no words.
        F.col("_at").alias("at"), F.length("text").alias("size"),
        F.when(F.length("text") <= LONG / similarity + 1, F.col("text")).alias("text"),
        F.when(F.length("text") >= LONG * similarity - 1, spelled(F.col("text"))).alias("words")))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts, "at").join(texts.select(
            F.col("at").alias("at2"), *(F.col(c).alias(f"{c}2") for c in ("size", "text", "words"))), "at2")
        by_words = F.greatest("size", "size2") > LONG
        one, two = (F.when(by_words, F.col(f"words{n}")).otherwise(F.col(f"text{n}")) for n in ("", "2"))
        return cut_lineage(similar_pairs(both.select("at", "at2", one.alias("one"), two.alias("two")), similarity).select("at", "at2"))

    found = verified(fitting(members.where(F.col("at") != F.col("leader")).withColumnRenamed("leader", "at2")))
    groups = connected_components(found, "at", "at2")
    named = cut_lineage(members.join(groups, F.col("at") == F.col("node"), "left").select(
        "key", "at", "length", "leader", F.coalesce("component", "at").alias("group")))
    main = F.max(F.when(F.col("at") == F.col("leader"), F.col("group"))).alias("main")
    divided = named.groupBy("key").agg(main, F.min("group").alias("low"), F.max("group").alias("high")).where(F.col("low") < F.col("high"))
    # Left are pairs of two groups.  One of the two lines is outside the group of the first line, which may be a large one, and
    # that first line was compared with all.
    one = named.join(divided.select("key", "main"), "key").where(F.col("at") != F.col("leader"))
    two = one.where(F.col("group") != F.col("main")).select(
        "key", F.col("at").alias("at2"), F.col("length").alias("length2"), F.col("group").alias("group2"))
    rest = verified(fitting(one.join(two, "key").where((F.col("group") == F.col("main")) | (F.col("group") < F.col("group2")))))
    joined = groups.select(F.col("node").alias("at"), F.col("component").alias("at2"))
    final = groups if rest.isEmpty() else connected_components(joined.unionByName(rest), "at", "at2")
    return distinct.join(final, F.col("at") == F.col("node"), "left").select(
        "h1", "h2", F.coalesce("component", "at").alias("first"))


def judge_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(_id, _row, _line, group, kept)`` of every line with a word; ``docs`` has ``_id``, ``_row`` and ``text``.

    ``group`` is the number of the group's first line, which alone is kept.  Null and empty texts and lines without a word give no
    row.  Repeated rows and null ids are documents of their own; of equal lines the first in the stored table is kept.  Other
    columns of ``docs`` are not looked at.  An empty table gives an empty result.
    """
    lines = lines_of(docs)
    measured = measured_lines(docs)
    grouped = measured.join(line_groups(lines, measured, similarity), ["h1", "h2"]).select(F.col("at").alias("_at"), "first")
    return places_of(docs).drop("line").join(grouped, "_at").select(
        "_id", "_row", "_line", F.col("first").alias("group"), (F.col("_at") == F.col("first")).alias("kept"))


def numbered(docs: DataFrame, id_column: str = "doc_id", *columns: Column) -> DataFrame:
    return with_row(docs, F.col(id_column).alias("_id"), "text", *columns)


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without repeated lines; lines without a word stay, and so do documents that lose all lines.

    The first line of a group is that which comes first in the stored table.  Null texts stay null.  Repeated rows and
    null ids are documents of their own: all but the first lose their lines.  An empty table gives an empty result.  All other
    columns stay as they are.  ``docs`` is read several times and must number its rows alike, as a stored table does.
    """
    everything = numbered(docs, id_column, F.struct(*docs.columns).alias("_all"))
    judged = judge_lines(everything.select("_id", "_row", "text"), similarity)
    dropped = judged.where(~F.col("kept")).groupBy("_row").agg(F.collect_set("_line").alias("dropped"))
    marked = everything.select("_row", "_all").join(dropped.hint("shuffle_hash"), "_row", "left")
    kept = F.array_join(F.filter(F.split("_all.text", "\n", -1), lambda _, i: ~F.array_contains("dropped", i)), "\n")
    text = F.when(F.col("dropped").isNull(), F.col("_all.text")).otherwise(kept)
    return marked.select(*(text.alias("text") if c == "text" else F.col(f"_all.{c}") for c in docs.columns))
