"""Document fingerprints as invertible Bloom lookup tables, in DataFrame and SQL functions only.

A document is the set of the digests of its paragraphs: its lines, longer ones cut to passages. Passages
are a power of two long, an eighth to a quarter of the text (``LEAST_PASSAGE`` at least), so versions of
one text are cut alike; texts of different passage lengths are compared at the longer one. By content
(as op10 asks) lines are instead cut after words whose hash has ``CUT_BITS`` low bits of zero, and into
pieces of ``LONGEST_PIECE`` at most, alike for every text: stored tables of any two texts subtract. Words
are runs of Latin letters, digits and signs; any other character is a word. Each digest is added to one cell of each of three subtables; a cell holds how
many digests it has, their exclusive-or, and the exclusive-or of their checksums. Cells of two versions
subtract, what both versions share vanishes, and peeling recovers the rest: a cell with one digest
yields it, which is then taken from its other cells, until all are empty.

A stored fingerprint has ``3 * SLOTS`` cells. If a difference is too large for it, both documents'
digests are dealt into groups by other bits of the digest, each group with a table of its own, and a
group that still fails is retried with tables four and sixteen times as large; should even these fail,
the group's digests are compared themselves. Work therefore follows the number of paragraphs.

Defined results: a null text is empty; an empty text (or one of line breaks only) has no paragraphs,
and two such texts have likeness 1; repeated paragraphs count once; rows with a null identifier come
last in descending order; rows with one identifier are ordered by their texts' hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASSAGES, LEAST_PASSAGE = 8, 8
CUT_BITS, LONGEST_PIECE = 4, 256
#: A word with the character after it; a longer run of Latin characters is several words.
WORDS = r"[\x21-\x{24F}]{1,64}[^\x21-\x{24F}]?|[^\x21-\x{24F}]"
SLOTS, TABLES = 8, 3
#: Digests that a group should have on average, of both documents together.
GROUP_DIGESTS = 12
#: Bits of the digest that deal it into groups, at most.
DEAL_BITS = 31
RETRIES = (1, 4, 16)
ROUNDS = 16
#: Documents of a bucket of neighbouring identifiers, and buckets at most.
BUCKET_DOCS, MAX_BUCKETS = 2048, 65_536
LEAST = -(1 << 63)


def let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def passage_sql(text: str) -> str:
    """Length of the passages that long lines are cut to: a power of two, an eighth to a quarter of the text."""
    return f"cast(greatest({LEAST_PASSAGE}, shiftleft(1, cast(ceil(log2(greatest(1, length({text})) / {PASSAGES}.0D)) as int))) as int)"


def digests_sql(text: str, passage: str) -> str:
    """Distinct paragraph digests of a text."""
    return f"array_distinct(transform(regexp_extract_all({text}, concat('([^\\n]{{1,', {passage}, '}})'), 1), piece -> xxhash64(piece)))"


def pieces_sql(text: str) -> str:
    """Distinct digests of a text's pieces, cut by content; the marks are line breaks."""
    marked = f"array_join(transform(regexp_extract_all({text}, r'({WORDS})', 1), word -> if((xxhash64(word) & {(1 << CUT_BITS) - 1}) = 0, concat(word, '\n'), word)), '')"
    return f"array_distinct(transform(regexp_extract_all({marked}, '([^\n]{{1,{LONGEST_PIECE}}})', 1), piece -> xxhash64(piece)))"


def _check(key: str) -> str:
    return f"hash({key})"


def _places(slots: int, table: int) -> str:
    """The cells of a subtable, each as the bits of the digest that choose it; each subtable reads other bits."""
    return f"sequence(0L, {(slots - 1) << 10 * table}L, {1 << 10 * table}L)"


def _in_cell(key: str, cell: str, slots: int, table: int) -> str:
    """Whether key belongs to a cell of a subtable, one of _places."""
    return f"({key} & {(slots - 1) << 10 * table}L) = {cell}"


def _changed(digests: str, cell: str, slots: int, table: int, by: int, start: str) -> str:
    """A cell after digests that belong to it are added (by 1) or taken (by -1)."""
    changed = f"named_struct('n', sum.n + {by}, 'k', sum.k ^ key, 's', sum.s ^ {_check('key')})"
    return f"aggregate(filter({digests}, key -> {_in_cell('key', cell, slots, table)}), {start}, (sum, key) -> {changed})"


def cells_sql(digests: str, slots: int = SLOTS, less: str | None = None) -> str:
    """The table of an array of digests: the cells of its subtables, one after another. less: digests to subtract."""
    empty = "named_struct('n', 0, 'k', 0L, 's', 0)"
    start = lambda t: _changed(less, "cell", slots, t, -1, empty) if less else empty
    parts = [f"transform({_places(slots, t)}, cell -> {_changed(digests, 'cell', slots, t, 1, start(t))})" for t in range(TABLES)]
    return f"concat({', '.join(parts)})"


def subtracted_sql(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'k', p.k ^ q.k, 's', p.s ^ q.s))"


def peeled_sql(cells: str, slots: int = SLOTS) -> str:
    """Struct: c (cells left), a, b (digests that only the first or only the second has)."""
    pure = lambda n: f"array_distinct(transform(filter(state.c, x -> x.n = {n} and x.s = {_check('x.k')}), x -> x.k))"
    found = f"named_struct('a', {pure(1)}, 'b', {pure(-1)})"
    taken = lambda t: _changed("found.b", "cell", slots, t, 1, _changed("found.a", "cell", slots, t, -1, "was"))
    after = lambda t: f"if(was.n = 0 and was.k = 0, was, {taken(t)})"
    emptied = ", ".join(f"zip_with(slice(state.c, {t * slots + 1}, {slots}), {_places(slots, t)}, (was, cell) -> {after(t)})" for t in range(TABLES))
    ended = "named_struct('c', state.c, 'a', state.a, 'b', state.b, 'live', false)"
    step = let(found, "found", f"if(size(found.a) + size(found.b) = 0, {ended}, named_struct('c', concat({emptied}), 'a', concat(state.a, found.a), 'b', concat(state.b, found.b), 'live', true))")
    start = f"named_struct('c', {cells}, 'a', cast(array() as array<bigint>), 'b', cast(array() as array<bigint>), 'live', true)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (state, round) -> if(state.live, {step}, state))"


def _done(peeled: str) -> str:
    return f"forall({peeled}.c, x -> x.n = 0 and x.k = 0 and x.s = 0)"


def _sides(peeled: str) -> str:
    return f"named_struct('a', {peeled}.a, 'b', {peeled}.b)"


def _group_difference(a: str, b: str) -> str:
    """Of two arrays of digests, by tables that grow on failure."""
    body = f"named_struct('a', array_except({a}, {b}), 'b', array_except({b}, {a}))"
    for times in reversed(RETRIES):
        slots = SLOTS * times
        table = peeled_sql(cells_sql(a, slots, less=b), slots)
        body = let(table, f"try{times}", f"if({_done(f'try{times}')}, {_sides(f'try{times}')}, {body})")
    return f"if(size({a}) + size({b}) = 0, named_struct('a', {a}, 'b', {b}), {body})"


def _dealt(digests: str, bits: str) -> str:
    """2 ** bits groups by the upper bits of the digest: a bit halves every group, so a digest is tested twice a bit."""
    halves = ", ".join(f"filter(part, key -> (key & bit) {is_} 0L)" for is_ in ("=", "!="))
    return f"aggregate(slice(sequence(0, {DEAL_BITS - 1}), 1, {bits}), array({digests}), (parts, at) -> {let('shiftleft(4294967296L, at)', 'bit', f'flatten(transform(parts, part -> array({halves})))')})"


def difference_sql(a: str, b: str, cells_a: str, cells_b: str) -> str:
    """Struct a, b: the digests that only one document has. a, b: digest arrays, with their tables."""
    bits = f"cast(least({DEAL_BITS}, greatest(0, ceil(log2((size({a}) + size({b}) + 1) / {GROUP_DIGESTS}D)))) as int)"
    groups = let(bits, "bits", f"zip_with({_dealt(a, 'bits')}, {_dealt(b, 'bits')}, (x, y) -> {_group_difference('x', 'y')})")
    merged = let(groups, "all", "named_struct('a', flatten(transform(all, v -> v.a)), 'b', flatten(transform(all, v -> v.b)))")
    return let(peeled_sql(subtracted_sql(cells_a, cells_b)), "first_try", f"if({_done('first_try')}, {_sides('first_try')}, {merged})")


def compared_sql(text_a: str, text_b: str, a: str, b: str, by_content: bool = False) -> str:
    """Struct a, b (digests that only one text has) and n (digests of both texts).

    Texts cut by content are compared by their stored tables, whatever their lengths.

    a, b: names of the texts' columns of digests; with suffixes _cells and _passage their tables and lengths.
    """
    whole = lambda x, y, cx, cy: let(difference_sql(x, y, cx, cy), "diff", f"named_struct('a', diff.a, 'b', diff.b, 'n', size({x}) + size({y}))")
    if by_content:
        return whole(a, b, f"{a}_cells", f"{b}_cells")
    longer = f"greatest({a}_passage, {b}_passage)"
    again = let(digests_sql(text_a, longer), "da", let(digests_sql(text_b, longer), "db", whole("da", "db", cells_sql("da"), cells_sql("db"))))
    return f"if({a}_passage = {b}_passage, {whole(a, b, f'{a}_cells', f'{b}_cells')}, {again})"


def likeness_sql(compared: str) -> str:
    """Jaccard likeness of two digest sets, from their sizes and the recovered difference."""
    d = f"(size({compared}.a) + size({compared}.b))"
    return f"if({compared}.n = 0, 1.0D, cast({compared}.n - {d} as double) / ({compared}.n + {d}))"


def text_of_cells(digests: str, cells: str, passage: str) -> str:
    """A fingerprint as text: number of digests, passage length, then count, key and checksum of each cell."""
    cell = "concat(hex(x.n), '.', lower(hex(x.k)), '.', lower(hex(x.s & 4294967295L)))"
    return f"concat(size({digests}), '/', {passage}, ':', array_join(transform({cells}, x -> {cell}), ','))"


def fingerprinted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with passage, digests, cells and fingerprint of a text column."""
    text = f"coalesce(`{text_col}`, '')"
    return (
        docs.withColumn("passage", F.expr(passage_sql(text)))
        .withColumn("digests", F.expr(digests_sql(text, "passage")))
        .withColumn("cells", F.expr(cells_sql("digests")))
        .withColumn("fingerprint", F.expr(text_of_cells("digests", "cells", "passage")))
    )


def with_next(docs: DataFrame, derived: dict[str, Column] | None = None, more: list[dict[str, Column]] | None = None, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """doc_id, text and next_text: the text of the next row in descending doc_id; after the last, the first's.

    derived: further columns of the text; more: columns of those. Each comes with its next_ column too.

    Rows are dealt into buckets of neighbouring (identifier, text hash), also those with one identifier or
    none, and a task orders a bucket; the first row of a bucket is sent to the bucket before it as well.
    Buckets hold about bucket_docs rows up to MAX_BUCKETS of them (134 million rows) and grow beyond that;
    rows that repeat both identifier and text share one. The buckets' ends, at most MAX_BUCKETS pairs of numbers, come from a range
    partitioning and reach the tasks as a scalar subquery.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"at": F.coalesce("doc_id", F.lit(LEAST)), "nh": F.bitwise_not(F.xxhash64("text"))})
    n = max(1, min(MAX_BUCKETS, -(-rows.count() // bucket_docs)))
    key = F.struct("at", "nh")
    ends = rows.select("at", "nh").repartitionByRange(n, "at", "nh").groupBy(F.spark_partition_id()).agg(F.min(key).alias("low"), F.max(key).alias("high")).orderBy("low").collect()
    bounds = docs.sparkSession.createDataFrame([([tuple(r["low"]) for r in ends[1:]], [tuple(r["high"]) for r in ends])], "lows array<struct<at:bigint,nh:bigint>>, highs array<struct<at:bigint,nh:bigint>>")
    lows, highs = bounds.select("lows").scalar(), bounds.select("highs").scalar()
    rows = rows.withColumn("bucket", F.lit(0))
    for p in range(len(ends).bit_length() - 1, -1, -1):  # binary search, a projection a step
        up = F.col("bucket") + (1 << p)
        rows = rows.withColumn("bucket", F.when((up < len(ends)) & (F.get(lows, up - 1) <= key), up).otherwise(F.col("bucket")))
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("bucket") + 1, F.lit(max(1, len(ends)))).alias("b"), F.lit(1).alias("guest"))
    sent = rows.withColumn("sent", F.explode(F.when(F.get(highs, "bucket") == key, F.array(own, guest)).otherwise(F.array(own)))).select("doc_id", "text", "at", "nh", F.col("sent.b").alias("bucket"), F.col("sent.guest").alias("guest"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("at").desc(), F.col("nh").desc())
    # What is derived of a text is computed once a row, and read by the row before.
    own = sent.select("doc_id", "bucket", "guest", "at", "nh", "text", *[c.alias(n) for n, c in (derived or {}).items()]) if derived else sent
    for level in (more or []):
        own = own.withColumns(level)
    names = ["text", *(derived or {}), *[n for level in (more or []) for n in level]]
    return own.withColumns({f"next_{n}": F.lead(n).over(order) for n in names}).where("guest = 0").select("doc_id", *names, *[f"next_{n}" for n in names])


def versions(docs: DataFrame, by_content: bool = False) -> DataFrame:
    """Fingerprints of each document and of its edited version, and their likeness.

    The edit replaces the last third of the code points by as many of the next document's first ones.
    by_content: cut lines by content; the fingerprint's passage length is then zero.
    """
    passage = lambda text: F.lit(0) if by_content else F.expr(passage_sql(text))
    digests = lambda text, name: F.expr(pieces_sql(text) if by_content else digests_sql(text, name))
    rows = with_next(docs, {"a_passage": passage("text")}, [{"a": digests("text", "a_passage")}, {"a_cells": F.expr(cells_sql("a"))}])
    rows = rows.withColumnsRenamed({"next_a": "x", "next_a_cells": "x_cells", "next_a_passage": "x_passage"})
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 3)), substring(next_text, 1, int(n_chars div 3)))"))
    rows = rows.withColumn("e_passage", passage("edited")).withColumn("e", digests("edited", "e_passage")).withColumn("e_cells", F.expr(cells_sql("e")))
    rows = rows.withColumns({"to_edited": F.expr(compared_sql("text", "edited", "a", "e", by_content)), "to_next": F.expr(compared_sql("text", "next_text", "a", "x", by_content))})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(text_of_cells("a", "a_cells", "a_passage")).alias("fingerprint"),
        F.expr(text_of_cells("e", "e_cells", "e_passage")).alias("edited_fingerprint"),
        F.expr(likeness_sql("to_edited")).alias("near_edited"),
        F.expr(likeness_sql("to_next")).alias("near_next"),
    )
