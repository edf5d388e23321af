"""Line dedup by a segment-partition edit join (operator 3).

Lines that occur again, exactly or within ``MAX_EDITS`` edits, are dropped but for
their first occurrence.  A line within t edits of another keeps at least one of
the other's t + 1 segments whole: so every line is indexed by its t + 1 segments,
and probes the index of each length it may match with the few substrings that
can be such a segment (the positions that both the edits before and the edits
after a segment allow).  A segment that many lines share is cut further: its lines
meet by one more whole piece left or right of it, and pairs that Spark's own banded
distance tells to be farther apart don't leave the join.  Candidates are verified by a
bit-parallel automaton over the 2t + 1 diagonals of the band, run on what lies
between the pair's common beginning and end.

A line is taken without surrounding white space.  Lines of fewer than
``MIN_CHARS`` characters (headings, list marks, closing words) stay, or with
``short`` are classes by equality, of which the first occurrence stays.  Blank
lines always stay.

Order of occurrence is (doc_id, text, line number).  Defined results: null and
empty texts have no line that takes part; rows alike in doc_id and text share
every decision; null doc_ids come first.  A document all of whose longer lines
occur before goes, and one that loses some keeps the rest in order.  An empty
table gives an empty result.  Only built-in expressions run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, cut, likely_in, same, table_in_shared_dir
from .links import link_components

MAX_EDITS = 2
MIN_CHARS = 20
#: Characters after which pairs that differ throughout are told.
FIRST_CHARS = 16
PAIRS_A_TASK = 2_000


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), line_no (from 0), line: every line of every row."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("row"), F.posexplode(F.split(t, "\n")).alias("line_no", "line")).withColumn(
        "line", trimmed(F.col("line"))
    )


def takes_part(line: Column) -> Column:
    return F.char_length(line) >= MIN_CHARS


def _places(edits: int) -> list[tuple[int, int, int]]:
    """Where a line looks for segments: (shorter, segment number, shift) for every length
    that may match, the line's own segments at (0, ..., 0)."""
    return [
        (shorter, i, shift)
        for shorter in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1)
    ]


def _segments(lines: DataFrame, edits: int) -> DataFrame:
    """A row for each place of each line: besides the columns of ``lines`` length, i, shift
    and own of the place, start and size of the segment, and its bucket (hash of length,
    segment number and substring)."""
    parts = edits + 1
    # Places are rows, not expressions of one row: so the code for a place stays short and
    # a line's characters are counted once.
    places = F.array(*[F.struct(F.lit(shorter).alias("shorter"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for shorter, i, shift in _places(edits)])
    s = lines.withColumn("chars", F.char_length("line")).withColumn("raw", F.col("line").cast("binary"))
    s = s.withColumn("plain", F.octet_length("line") == F.col("chars")).withColumn("place", F.explode(places))
    s = s.withColumn("length", F.col("chars") - F.col("place.shorter")).withColumn("i", F.col("place.i")).withColumn("shift", F.col("place.shift"))
    s = s.withColumn("base", F.floor(F.col("length") / parts).cast("int")).withColumn("extra", F.col("length") % parts)
    # The last `extra` segments are one character longer.
    longer = F.col("i") - (parts - F.col("extra"))
    s = s.withColumn("start", F.col("base") * F.col("i") + F.greatest(longer, F.lit(0)) + 1).withColumn("size", F.col("base") + F.when(longer >= 0, 1).otherwise(0))
    at = F.col("start") + F.col("shift")
    # Of ASCII lines bytes are characters, found without walking up to them.
    part = F.when(F.col("plain"), F.substring(F.col("raw"), at, F.col("size"))).otherwise(F.substring(F.col("line"), at, F.col("size")).cast("binary"))
    own = (F.col("place.shorter") == 0) & (F.col("shift") == 0)
    return s.select(*lines.columns, "length", "i", "shift", own.alias("own"), "start", "size", F.xxhash64("length", "i", part).alias("bucket"))


def probes(lines: DataFrame, edits: int = MAX_EDITS) -> DataFrame:
    """(node, line) -> bucket, node, index: the buckets of each line; index: whether it is
    the line's own segment, so that other lines may find it there."""
    return _segments(lines.select("node", "line"), edits).select("bucket", "node", F.col("own").alias("index"))


def _finer(members: DataFrame, edits: int) -> DataFrame:
    """Buckets within buckets that many lines share: rows (bucket, node, c, line) ->
    (bucket, node, index, c).

    Two lines within the edits meet in a bucket along an alignment: what lies left and
    what lies right of the shared segment differ by the edits together.  So of
    edits + 1 pieces, cut from the index line's left and right, one is whole in the
    other line, at most the edits off."""
    m = _segments(members.select(F.col("bucket").alias("met"), "node", "c", "line"), edits).filter(F.col("bucket") == F.col("met"))
    half = -(-(edits + 1) // 2)
    left, right, after = F.col("start") - 1, F.col("length") - F.col("start") - F.col("size") + 1, F.col("start") + F.col("size") + F.col("shift")
    first, last = F.col("i") == 0, F.col("i") == edits
    sides = [
        (F.lit(1), left, F.when(first, 0).when(last, edits + 1).otherwise(half)),
        (after, right, F.when(first, edits + 1).when(last, 0).otherwise(half)),
    ]
    keys = []
    for side, (begin, length, pieces) in enumerate(sides):
        wide = F.floor(length / pieces).cast("int")
        for k in range(edits + 1):
            for off in range(-edits, edits + 1):
                at = begin + wide * k + off
                key = F.xxhash64("bucket", F.lit(side), F.lit(k), F.substring(F.col("line"), at, wide))
                keys.append(F.when((pieces > k) & (at >= 1), F.struct(key.alias("bucket"), (F.col("own") & F.lit(off == 0)).alias("index"))))
    m = m.select("node", "c", F.explode(F.array(*keys)).alias("f")).filter("f is not null")
    return m.select("f.bucket", "node", "f.index", "c")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def edit_distance(a: Column, b: Column, edits: int = MAX_EDITS) -> Column:
    """Edits between two strings up to ``edits``, else ``edits`` + 1.

    State: for e = 0..edits the set of diagonals (bit d + edits for an offset of d
    characters between the strings) reachable with at most e edits, as one number.
    A character keeps the diagonals where it matches; an edit more replaces a
    character (same diagonal), skips one of b (down) or one of a (up).
    """
    band = (1 << (2 * edits + 1)) - 1

    def step(a_chars: Column, b_chars: Column):
        def run(state: Column, i: Column) -> Column:
            c = F.get(b_chars, i - 1)
            match = F.lit(0)
            for d in range(-edits, edits + 1):
                match = match + F.when(F.get(a_chars, i + d - 1) == c, 1 << (d + edits)).otherwise(0)

            def moved(m: Column) -> Column:
                return level(F.struct(state["r0"].bitwiseAND(m).alias("r0")), m, 1)

            def level(done_levels: Column, m: Column, e: int) -> Column:
                if e > edits:
                    return done_levels
                old = state[f"r{e - 1}"]
                kept = state[f"r{e}"].bitwiseAND(m).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1))

                def add(s: Column) -> Column:
                    up = F.shiftleft(s[f"r{e - 1}"], 1)
                    new = kept.bitwiseOR(up).bitwiseAND(F.lit(band)).alias(f"r{e}")
                    return F.struct(*[s[f"r{k}"].alias(f"r{k}") for k in range(e)], new)

                return level(_let(done_levels, add), m, e + 1)

            return _let(match, moved)

        return run

    first = [sum(1 << (edits + k) for k in range(e + 1)) & band for e in range(edits + 1)]
    start = F.struct(*[F.lit(x).alias(f"r{e}") for e, x in enumerate(first)])
    off = F.char_length(a) - F.char_length(b)

    def done(state: Column) -> Column:
        result = F.lit(edits + 1)
        for e in range(edits, -1, -1):
            at = F.lit(0)
            for d in range(-edits, edits + 1):
                at = F.when(off == d, F.shiftright(state[f"r{e}"], d + edits).bitwiseAND(F.lit(1))).otherwise(at)
            result = F.when(at == 1, F.lit(e)).otherwise(result)
        return result

    n = F.char_length(b)
    chars = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))

    def walk(x: Column) -> Column:
        # Strings that differ throughout leave no diagonal after a few characters.
        alive = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(FIRST_CHARS))), start, step(x["a"], x["b"]), lambda state: state[f"r{edits}"] != 0)
        return F.when(alive, F.aggregate(F.sequence(F.lit(1), n), start, step(x["a"], x["b"]), done)).otherwise(F.lit(edits + 1))

    return F.when(F.abs(off) > edits, F.lit(edits + 1)).when(n == 0, F.char_length(a)).otherwise(_let(chars, walk))


def _common(a: Column, b: Column, most: Column, steps: int = 31) -> Column:
    """Length of the common beginning, up to ``most``: a binary search for the last
    length at which native comparison finds the beginnings equal."""
    low = F.struct(F.lit(0).alias("lo"), most.cast("int").alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = s["lo"] + F.floor((s["hi"] - s["lo"] + 1) / 2).cast("int")
        equal = F.substring(a, F.lit(1), middle) == F.substring(b, F.lit(1), middle)
        return F.struct(F.when(equal, middle).otherwise(s["lo"]).alias("lo"), F.when(equal, s["hi"]).otherwise(F.greatest(middle - 1, s["lo"])).alias("hi"))

    # As many halvings as the length has binary digits.
    rounds = F.sequence(F.lit(0), F.least(F.ceil(F.log2(most + 1.0)).cast("int"), F.lit(steps)))
    return F.aggregate(rounds, low, halve, lambda s: s["lo"])


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns worked out once: the optimizer would copy an expression to every use of it."""
    value = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(value)).alias("__v")).select(*kept, "__v.*")


def differing(pairs: DataFrame) -> DataFrame:
    """Columns x and y without their common beginning and end, which no edit need touch."""
    shorter = F.least(F.char_length("x"), F.char_length("y"))
    p = _once(pairs, __p=_common(F.col("x"), F.col("y"), shorter))
    p = _once(p, __s=_common(F.reverse("x"), F.reverse("y"), shorter - F.col("__p")))
    middle = lambda c: F.substring(F.col(c), F.col("__p") + 1, F.char_length(c) - F.col("__p") - F.col("__s"))
    return _once(p, x=middle("x"), y=middle("y")).drop("__p", "__s")


class _Texts:
    """(node, line) of lines that are compared, kept in one table.  The first call, that of
    the stars, names every node of a shared bucket, and later ones no others: so the
    documents are read once."""

    def __init__(self, lines: DataFrame):
        self.lines, self.found = lines, None

    def __call__(self, nodes: DataFrame) -> DataFrame:
        """The texts of the nodes (column need) at least."""
        if self.found is None:
            nodes = cut(nodes.distinct())
            found = likely_in(self.lines, "node", nodes, nodes.count()).groupBy("node").agg(F.any_value("line").alias("line"))
            self.found = table_in_shared_dir(found.join(nodes, F.col("node") == F.col("need")).select("node", "line"), "lines")
        return self.found


def _verifier(texts: _Texts, edits: int):
    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        found = texts(pairs.select(F.explode(F.array("a", "b")).alias("need")))
        both = pairs.join(found.select(F.col("node").alias("a"), F.col("line").alias("x")), "a")
        both = both.join(found.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
        # Tasks by the number of pairs: their bytes say little of the work.
        both = differing(both.repartition(pairs.count() // PAIRS_A_TASK + 1, "a", "b"))
        return both.filter(edit_distance(F.col("x"), F.col("y"), edits) <= edits).select("a", "b")

    return verify


def _narrower(texts: _Texts, edits: int):
    def narrow(members: DataFrame) -> DataFrame:
        return _finer(members.join(texts(members.select(F.col("node").alias("need"))), "node"), edits)

    return narrow


def _meeter(texts: _Texts, edits: int):
    """Pairs of rows of a bucket in different components.  Lines that are near copies of
    one another but not within the edits share many buckets, so the texts come along
    and Spark's banded distance holds back, inside the join, what can't be verified.
    Two index rows find each other, so one of them looks."""

    def meet(members: DataFrame) -> DataFrame:
        members = cut(members)
        m = members.join(texts(members.select(F.col("node").alias("need"))), "node")
        left = m.filter("index").select("bucket", F.col("node").alias("x"), F.col("c").alias("cx"), F.col("line").alias("lx"))
        right = m.select(F.col("bucket").alias("rb"), F.col("node").alias("y"), F.col("c").alias("cy"), F.col("index").alias("iy"), F.col("line").alias("ly"))
        once = ~F.col("iy") | (F.col("x") < F.col("y"))
        near = (F.col("bucket") == F.col("rb")) & (F.col("cx") != F.col("cy")) & once & (F.levenshtein("lx", "ly", edits) >= 0)
        return left.join(right, near).select("x", "y")

    return meet


def _occurrences(docs: DataFrame, id_col: str, text_col: str, edits: int) -> DataFrame:
    """doc_id, row, line_no, long, class_id (null for blank lines), kept (no earlier
    occurrence): every line, short ones classed by equality."""
    rows = line_rows(docs, id_col, text_col)
    lines = rows.filter(takes_part(F.col("line"))).select(F.xxhash64("line").alias("node"), "line")
    texts = _Texts(lines)
    parts, _ = link_components(probes(lines, edits), _verifier(texts, edits), narrow=_narrower(texts, edits), meet=_meeter(texts, edits))
    node = F.when(F.col("line") != "", F.xxhash64("line"))
    parts = cut(parts.withColumnRenamed("node", "pn"))
    occ = rows.select("doc_id", "row", "line_no", takes_part(F.col("line")).alias("long"), node.alias("node"))
    occ = cut(occ.join(parts, F.col("node") == F.col("pn"), "left").select("doc_id", "row", "line_no", "long", F.coalesce("component", "node").alias("class_id")))
    # Only classes with a second occurrence matter, and they are counted before they are joined.
    place = F.struct("doc_id", "row", "line_no")
    again = occ.filter("class_id is not null").groupBy("class_id").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    again = cut(again.filter(F.col("first") != F.col("last")).select(F.col("class_id").alias("c"), "first"))
    out = occ.join(again, F.col("class_id") == F.col("c"), "left")
    here = F.struct("doc_id", "row", "line_no")
    return out.select("doc_id", "row", "line_no", "long", "class_id", (F.col("first").isNull() | here.eqNullSafe(F.col("first"))).alias("kept"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MAX_EDITS, short: bool = False) -> DataFrame:
    """doc_id, row, line_no, class_id (null for lines that take no part), kept: every line."""
    takes = F.lit(short) | F.col("long")
    found = _occurrences(docs, id_col, text_col, edits)
    return found.select("doc_id", "row", "line_no", F.when(takes, F.col("class_id")).alias("class_id"), (F.col("kept") | ~takes).alias("kept"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", edits: int = MAX_EDITS, short: bool = False
) -> DataFrame:
    """The documents without repeated lines; columns as given (``chars_col``, where
    there is one, follows the text)."""
    found = _occurrences(docs, id_col, text_col, edits)
    tag = uuid.uuid4().hex
    i, r, gone, own = f"i{tag}", f"r{tag}", f"g{tag}", f"o{tag}"
    drops = found.groupBy("doc_id", "row").agg(
        F.collect_set(F.when(~F.col("kept") & (F.lit(short) | F.col("long")), F.col("line_no"))).alias(gone), F.max(F.col("class_id").isNotNull() & F.col("kept")).alias(own)
    )
    drops = cut(drops.filter(F.size(gone) > 0).withColumnRenamed("doc_id", i).withColumnRenamed("row", r))
    text = F.col(f"`{text_col}`")
    d = docs.withColumn(f"h{tag}", F.xxhash64(F.coalesce(text, F.lit("")))).join(drops, same(F.col(f"`{id_col}`"), F.col(i)) & (F.col(f"h{tag}") == F.col(r)), "left")
    d = d.filter(F.col(gone).isNull() | F.col(own))

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")

    new = F.when(F.col(gone).isNull(), text).otherwise(_let(F.split(text, "\n"), rest))
    d = d.withColumn(text_col, new)
    if chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        d = d.withColumn(chars_col, F.when(F.col(gone).isNull(), F.col(chars_col)).otherwise(F.char_length(text).cast(kind)))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns])
