"""Document fingerprints by winnowing over code points, as DataFrame expressions.

Every run of ``GRAM`` code points has a polynomial hash, the value that a Karp-Rabin hash rolls along the text.  Of each
window of ``WINDOW`` neighbouring hashes the least is chosen, on ties the rightmost; chosen hashes keep their position (in
code points, from 1).  So two texts that share a run of ``GRAM + WINDOW - 1`` code points share a chosen hash of it,
wherever the run stands and whatever its script.

Built-in functions keep no state between the elements of an array, and functions of array elements are interpreted.  So a text is
exploded into blocks of ``BLOCK`` windows with what those read beyond them, and a block is one row with a column for each
place: hashes of 4 code points come from 4 columns, those of 16 from 4 of these, and least values of windows likewise.
Every step is compiled and costs the same for any length of gram.  A hash and its position travel as one integer,
``hash * 2**31 - position``, whose least value is the least hash and, on ties, the rightmost.

The edited text of a document is the beginning of its own text and that of the next one.  Windows that lie within one
of the two have been seen there; only those across the seam are hashed, so no text is fingerprinted twice.

A text shorter than a gram is one gram; one of fewer grams than a window is one window.  Empty and null texts have no
hashes.  Two documents without hashes are alike (1.0), one without is unlike any other (0.0).  Rows that share an id
follow one another by their texts; rows without an id have nothing next.  Columns other than the named ones are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import bloom_filter, may_hold

#: Powers of four, so that steps of four reach them.
GRAM = 16
WINDOW = 16
#: Windows of a block.  More than 100 columns (``spark.sql.codegen.maxFields``) keep Spark from fusing the steps into one method, which would be too large to compile.
BLOCK = 128
#: A prime below 2**30, so that sums of four products stay below 2**63, and the base of the polynomial.
MODULUS, BASE = 1_073_741_789, 771_243_123
#: Neighbouring ids that are put in order within one task.
NEIGHBOURS = 64

_NEVER = 2**63 - 1


def beyond(gram: int = GRAM, window: int = WINDOW) -> int:
    """Code points that windows reach beyond the first one of the last window."""
    return gram + window - 2


def _by_fours(n: int) -> list[int]:
    """The widths 1, 4, 16... below ``n``, a power of four."""
    widths = []
    while n > 1:
        if n % 4:
            raise ValueError("grams and windows must be powers of four")
        n //= 4
        widths.append(4 ** len(widths))
    return widths


def grams_of(n: str, gram: int = GRAM) -> str:
    """SQL for the number of grams of a text of ``n`` code points."""
    return f"greatest({n} - {gram - 1}, least({n}, 1))"


def windows_of(n: str, gram: int = GRAM, window: int = WINDOW) -> str:
    """SQL for the number of windows of a text of ``n`` code points."""
    return f"greatest({n} - {beyond(gram, window)}, least({n}, 1))"


def chosen_in_block(rows: DataFrame, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``rows`` with the chosen hashes of one block as column ``out``, in order of position.

    Takes the columns ``_block`` (its code points in UTF-32), ``_at`` (code points before it), ``_grams`` and ``_windows`` (how many the
    text has).
    """
    kept = [f"`{c}`" for c in rows.columns if c != "_block"]
    count = BLOCK + beyond(gram, window)
    power = lambda n: f"{pow(BASE, n, MODULUS)}L"
    rows = rows.selectExpr(*kept, *(f"xxhash64(substring(_block, {4 * i + 1}, 4)) & {2**30 - 1}L AS _h{i}" for i in range(count)))
    for w in _by_fours(gram):
        count -= 3 * w
        rolled = [f"(_h{i} * {power(3 * w)} + _h{i + w} * {power(2 * w)} + _h{i + 2 * w} * {power(w)} + _h{i + 3 * w}) % {MODULUS}L" for i in range(count)]
        if 4 * w == gram:
            rolled = [f"if(_at + {i} < _grams, {h} * 2147483648L - (_at + {i + 1}), {_NEVER}L)" for i, h in enumerate(rolled)]
        rows = rows.selectExpr(*kept, *(f"{h} AS _h{i}" for i, h in enumerate(rolled)))
    for w in _by_fours(window):
        count -= 3 * w
        least = [f"least(_h{i}, _h{i + w}, _h{i + 2 * w}, _h{i + 3 * w})" for i in range(count)]
        if 4 * w < window:
            rows = rows.selectExpr(*kept, *(f"{h} AS _h{i}" for i, h in enumerate(least)))
    own = [c for c in kept if c not in ("`_at`", "`_grams`", "`_windows`")]
    return rows.selectExpr(*own, "_at", f"array_distinct(slice(array({', '.join(least)}), 1, cast(greatest(0, least({BLOCK}, _windows - _at)) AS int))) AS {out}")


def with_chosen(rows: DataFrame, text: str, out: str, keys: tuple[str, ...] = (), gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``rows`` with the chosen hashes of a text column, in order of position.

    Blocks of a row are put together again by ``keys`` and a number of the row.  Where ``rows`` are dealt out by ``keys``, they stay
    where they are.
    """
    carried = [c for c in rows.columns if c not in keys]
    own = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_code", F.encode(text, "UTF-32"))
    own = own.withColumn("_n", F.expr("octet_length(_code) div 4"))
    reach = 4 * (BLOCK + beyond(gram, window))
    first = ", ".join(f"'{c}', if(p = 0, `{c}`, null)" for c in carried)
    blocks = f"transform(sequence(0, greatest(0, cast(({windows_of('_n', gram, window)} - 1) div {BLOCK} AS int))), p -> named_struct('p', p, '_block', substring(_code, p * {4 * BLOCK} + 1, {reach}), {first}))"
    exploded = own.selectExpr(*keys, "_row", "_n", f"explode({blocks}) AS b")
    exploded = exploded.selectExpr(
        *keys, "_row", *(f"b.`{c}`" for c in carried), "b._block", f"b.p * {BLOCK} AS _at", f"{grams_of('_n', gram)} AS _grams", f"{windows_of('_n', gram, window)} AS _windows"
    )
    found = chosen_in_block(exploded, out, gram, window)
    parts = F.sort_array(F.collect_list(F.struct("_at", out)))
    grouped = found.groupBy(*keys, "_row").agg(*(F.max(c).alias(c) for c in carried), parts.alias(out))
    return grouped.select(*rows.columns, F.array_distinct(F.flatten(F.col(f"{out}.{out}"))).alias(out))


def hashes(chosen_col: str) -> Column:
    """The distinct hashes among chosen ones."""
    return F.array_distinct(F.transform(chosen_col, lambda v: (F.shiftright(v, 31) + 1).cast("int")))


def positions(chosen_col: str) -> Column:
    """The positions of chosen hashes, ascending."""
    return F.transform(chosen_col, lambda v: F.pmod(-v, F.lit(1 << 31)).cast("int"))


def digest(chosen_col: str) -> Column:
    """One string for all chosen hashes and their positions."""
    return F.sha2(F.array_join(F.transform(chosen_col, lambda v: v.cast("string")), ",").cast("binary"), 256)


def likeness(a: str, b: str) -> Column:
    """Twice the shared hashes by the hashes of both: 0 to 1."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, fingerprint array<struct<hash, position>>) of every row; positions are code points, from 1."""
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = with_chosen(own.withColumnRenamed(id_col, "_id"), "_text", "_v", (), gram, window)
    pair = F.transform("_v", lambda v: F.struct((F.shiftright(v, 31) + 1).cast("int").alias("hash"), F.pmod(-v, F.lit(1 << 31)).cast("int").alias("position")))
    return found.select(F.col("_id").alias(id_col), pair.alias("fingerprint"))


def _range(id_col: str) -> Column:
    return F.floor(F.col(id_col).cast("long") / NEIGHBOURS)


def _firsts(ids: DataFrame, id_col: str) -> DataFrame:
    """(first, goes_to): the first id of each range, and the range before it that has any; the very first goes to the last.

    Ranges are ordered within ranges of 4,096 of them, and these among themselves, so few rows meet in one task.
    """
    ranges = ids.groupBy(_range(id_col).alias("r")).agg(F.min(id_col).alias("first")).withColumn("above", F.floor(F.col("r") / 4096))
    tops = ranges.groupBy("above").agg(F.max("r").alias("last"))
    everywhere = Window.orderBy("above")
    greatest = F.max("last").over(everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    tops = tops.select("above", F.coalesce(F.lag("last").over(everywhere), greatest).alias("before"))
    within = Window.partitionBy("above").orderBy("r")
    near = ranges.withColumn("near", F.lag("r").over(within)).join(tops, "above")
    return near.select("first", F.coalesce("near", "before").alias("goes_to"))


def dealt_by_range(rows: DataFrame) -> DataFrame:
    """(_id, _text) dealt out by ranges of ids, with ``_range``, ``_keyless`` (no id) and ``_guest``.

    Rows are dealt out once, by ranges of ``NEIGHBOURS`` ids.  The first row of a range goes to the range before it as well, as
    a guest.  Where a range's first possible id is missing, a Bloom filter finds the few rows that may be first; a join with the first ids
    decides.  Rows without an id are spread by their texts.  Ids that are far apart make ranges of a row each, so that each row is dealt out
    twice; rows that share one id meet in one range.
    """
    known = rows.where(F.col("_id").isNotNull())
    firsts = _firsts(known.select("_id"), "_id")
    odd = bloom_filter(firsts.where(F.col("first") % NEIGHBOURS != 0), "first").scalar()
    likely = known.where((F.col("_id") % NEIGHBOURS == 0) | may_hold(odd, F.col("_id")))
    guests = likely.join(firsts, F.col("_id") == F.col("first")).select("_id", "_text", F.col("goes_to").alias("_range"), F.lit(False).alias("_keyless"), F.lit(True).alias("_guest"))
    hosts = rows.select("_id", "_text", F.coalesce(_range("_id"), F.xxhash64("_text")).alias("_range"), F.col("_id").isNull().alias("_keyless"), F.lit(False).alias("_guest"))
    return hosts.unionByName(guests).repartition("_range")


def _within(chosen: str, n: str) -> str:
    """SQL for those of a text's chosen hashes that some window within its first ``n`` code points chooses.

    A hash is first chosen by the window that it enters, where it is the least there, else by the one that its predecessor has left.
    """
    place = lambda v: f"pmod(-{v}, 2147483648L)"
    first = f"CASE WHEN i = 0 THEN 1 WHEN v < get({chosen}, i - 1) THEN {place('v')} - {WINDOW - 1} ELSE {place(f'get({chosen}, i - 1)')} + 1 END"
    return f"filter({chosen}, (v, i) -> {first} <= {n} - {beyond()})"


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next document's are.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by as many of the beginning of the
    next document.  ``positions`` are those of ``fingerprint``.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    own = with_chosen(dealt_by_range(rows), "_text", "_v", ("_range",))
    order = Window.partitionBy("_range", "_keyless").orderBy("_guest", "_id", "_text")
    after = lambda c: F.when(~F.col("_keyless"), F.lead(c).over(order))
    pairs = own.select("_id", "_text", "_v", "_guest", F.coalesce(after("_text"), F.lit("")).alias("_next"), F.coalesce(after("_v"), F.array().cast("array<bigint>")).alias("_nv"))
    pairs = pairs.where(~F.col("_guest")).drop("_guest")
    pairs = pairs.withColumn("_n", F.char_length("_text")).withColumn("_taken", F.expr("least(_n div 2, char_length(_next))"))
    pairs = pairs.withColumn("_left", F.expr("cast(_n - _n div 2 AS int)"))
    pairs = pairs.withColumn("_edited", F.expr("concat(substring(_text, 1, _left), substring(_next, 1, cast(_taken AS int)))"))
    reach = beyond()
    seam = pairs.withColumn("_from", F.expr(f"greatest(0, _left - {reach})"))
    seam = seam.withColumn("_size", F.expr(f"cast(_left - _from + least(_taken, {reach}) AS int)"))
    seam = seam.withColumn("_block", F.encode(F.expr("substring(_edited, _from + 1, _size)"), "UTF-32")).withColumn("_at", F.lit(0))
    # A seam without a whole window counts only where it is the whole edited text.
    seam = seam.withColumn("_grams", F.expr(grams_of("_size"))).withColumn("_windows", F.expr(f"if(_size <= {reach} AND _size < _left + _taken, 0, {windows_of('_size')})"))
    both = chosen_in_block(seam, "_sv")
    edited = f"array_distinct(concat({_within('_v', '_left')}, transform(_sv, v -> v - _from), transform({_within('_nv', '_taken')}, v -> v - _left)))"
    both = both.withColumn("_ev", F.expr(edited)).withColumns({"_h": hashes("_v"), "_nh": hashes("_nv")}).withColumn("_eh", hashes("_ev"))
    return both.select(
        F.col("_id").alias(id_col),
        F.col("_n").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        digest("_v").alias("fingerprint"),
        digest("_ev").alias("edited_fingerprint"),
        likeness("_h", "_eh").alias("near_edited"),
        likeness("_h", "_nh").alias("near_next"),
        positions("_v").alias("positions"),
    )
