"""Line dedup by content-defined chunks of lines (DataFrame operations only).

A document's lines are hashed, and so is every line with the one before it, by a rolling hash over line
hashes. A chunk ends at a line whose rolling hash is below both neighbours', so that boundaries follow
from four lines alone, the same run of lines is cut alike wherever it stands, and a chunk has at least two
lines (a text of one line is no chunk). Chunks that occur more than once in the corpus stay at their first
place (by doc_id, nulls first, then position) and are removed elsewhere, and with them the lines beside
them, as far as two chunks, that equal those beside the first place: edges of a repeated passage that
chunks share with their surroundings. Lines of LONG_WORDS words or more count on their own too. Whatever
goes has an equal line at an earlier place, so a copy of every line stays. A passage is found if a whole
chunk lies inside: nine in ten passages of eight lines, nearly all of twelve, few of three. With `every`,
an exact check follows: of the neighbouring lines that the chunks left, every two that stand together at
an earlier place go too, so that no repeated run of two lines is lost. It changes nothing that chunks
settled: two lines inside of a removed run stand at an earlier place, so the first place of any two is
among those left. Blank lines between blank lines stay then.

Candidates are found by counts of 64-bit hashes of their lines, and only they are made texts; whether
they are really equal is decided on their bytes, which are the grouping and join key (lines beside them:
by 64-bit hashes). Copies of a frequent chunk are
dealt into parts of about PART rows before they meet its first place.

Null texts stay null and have no lines; an empty text is one empty line and is kept; chunks of
blank lines only are kept; rows equal in id and text count as one document and share a result; very long
texts are single rows, with work linear in their lines; an empty table gives no rows; other columns are
kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, hex_number, join_sized, table

MODULUS, FACTOR, LONG_WORDS, PART = 2147483647, 263, 50, 128


def with_units(docs: DataFrame, pairs: bool) -> DataFrame:
    """Adds __lines and __units, the chunks of a text and its long lines but those of blanks only, with what stands beside each chunk.

    A unit is k (its place, unique in the text), from (its first line, from 1), n (lines), left and right
    (hashes of the lines of the two chunks on either side). pairs: units are instead every two neighbouring
    lines, but those inside a range of __gone, which docs then has.
    """
    # possessive and anchored, so that matching takes linear time
    long = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{LONG_WORDS - 1}}}[^\x20\x09-\x0D]"
    nothing = "cast(array() as array<bigint>)"
    numbers = F.sequence(F.lit(1), F.size("__lines"))
    longs = F.transform(F.filter(numbers, lambda i: F.element_at("__lines", i).rlike(long)), lambda i: F.struct((2 * i).alias("k"), i.alias("from"), F.lit(1).alias("n"), F.expr(nothing).alias("left"), F.expr(nothing).alias("right")))
    lines = docs.withColumn("__lines", F.split("text", "\n", -1)).filter("__lines is not null").withColumn("__full", F.transform("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    if pairs:
        settled = "coalesce(flatten(transform(__gone, r -> filter(sequence(r.low, r.high), i -> i < r.high))), cast(array() as array<int>))"
        units = F.expr(f"transform(filter(array_except(sequence(1, size(__lines)), {settled}), i -> i < size(__lines)), i -> named_struct('k', 2 * i + 1, 'from', i, 'n', 2, 'left', {nothing}, 'right', {nothing}))")
    else:
        before, earlier = "(case when j = 0 then 0 else element_at(__ends, j) end)", "(case when j <= 2 then 0 else element_at(__ends, j - 2) end)"
        lines = (
            lines.withColumn("__h", F.transform("__lines", lambda x: hex_number(F.md5(x), 7)))
            .withColumn("__x", F.transform("__lines", lambda x: F.xxhash64(x)))
            .withColumn("__r", F.expr(f"transform(sequence(1, size(__lines)), i -> (element_at(__h, i) + case when i > 1 then {FACTOR} * element_at(__h, i - 1) else 0 end) % {MODULUS})"))
            .withColumn("__ends", F.expr("""filter(sequence(1, size(__lines)), i -> i = size(__lines)
                or (i > 1 and i < size(__lines) - 1 and element_at(__r, i) < element_at(__r, i - 1) and element_at(__r, i) <= element_at(__r, i + 1)))"""))
        )
        chunks = F.expr(f"""filter(transform(__ends, (e, j) -> named_struct('k', 2 * {before} + 3, 'from', {before} + 1, 'n', e - {before},
            'left', slice(__x, {earlier} + 1, {before} - {earlier}), 'right', slice(__x, e + 1, element_at(__ends, least(j + 3, size(__ends))) - e))), u -> u.n > 1)""")
        units = F.concat(chunks, longs)
    units = lines.withColumn("__units", units).withColumn("__units", F.filter("__units", lambda u: any_full(u, pairs)))
    return units.drop("__full", "__h", "__x", "__r", "__ends")


def any_full(unit: Column, pairs: bool) -> Column:
    """Whether a unit has a line that is not blank."""
    if pairs:
        return F.element_at("__full", unit["from"]) | F.element_at("__full", unit["from"] + unit["n"] - 1)
    return F.exists(F.slice("__full", unit["from"], unit["n"]), lambda x: x)


def line_hash(unit: Column, pairs: bool) -> Column:
    """A hash of a unit's lines, compared only within one of the two ways to cut."""
    if pairs:
        return F.xxhash64(F.element_at("__lines", unit["from"]), F.element_at("__lines", unit["from"] + 1))
    return F.xxhash64(F.slice("__lines", unit["from"], unit["n"]))


def shared_lines(a: str, b: str) -> str:
    """SQL: at how many places from the first on two arrays agree."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), named_struct('n', 0, 'on', true), (s, e) -> named_struct('n', s.n + if(s.on and e, 1, 0), 'on', s.on and e), s -> s.n)"


def repeated_lines(docs: DataFrame, scratch: Scratch, every: bool) -> DataFrame:
    """__id, __key and __gone, the ranges of lines (from, to) to remove, for documents that lose any."""
    keyed = docs.filter(F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("__key"))
    gone = repeated_units(keyed, scratch)
    if not every:
        return gone
    more = repeated_units(with_gone(keyed, gone).select("doc_id", "text", "__key", "__gone"), scratch, pairs=True)
    both = scratch.put(gone.unionByName(more).groupBy("__id", "__key").agg(F.flatten(F.collect_list("__gone")).alias("__gone")))
    scratch.drop(gone, more)
    return both


def repeated_units(keyed: DataFrame, scratch: Scratch, pairs: bool = False) -> DataFrame:
    """What repeated_lines gives, of the chunks and long lines, or of the neighbouring lines that ranges in __gone leave."""
    # outer, as an inner explode makes Spark push a copy of all these nested expressions down as a filter
    hashed = F.transform("__units", lambda u: F.struct(u["k"].alias("k"), line_hash(u, pairs).alias("hash")))
    hashes = with_units(keyed, pairs).select("doc_id", "__key", F.posexplode_outer(hashed).alias("pos", "u")).filter("u is not null")
    hashes = scratch.put(hashes.select("doc_id", "__key", F.col("u.k" if pairs else "pos").cast("long").alias("__at"), F.col("u.hash").alias("__hash")))
    often = scratch.put(hashes.groupBy("__hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("__hash", F.ceil(F.col("times") / PART).alias("__parts")))
    # only units whose hash occurs again are made texts; which, and in how many parts, is one number
    wanted = join_sized(hashes, often, "__hash", "inner").groupBy("doc_id", "__key").agg(F.collect_set(F.shiftleft("__at", 32) + F.col("__parts")).alias("__wanted"))
    wanted = scratch.put(wanted.withColumnRenamed("doc_id", "__id").withColumnRenamed("__key", "__key2"))
    keyed = keyed.select("doc_id", "text", "__key")
    some = join_sized(keyed, wanted, keyed["doc_id"].eqNullSafe(wanted["__id"]) & (keyed["__key"] == wanted["__key2"]), "inner", items="__wanted")
    some = some.withColumn("__lines", F.split("text", "\n", -1)) if pairs else with_units(some, pairs)
    at = "cast(shiftright(w, 32) as int)"
    unit = f"named_struct('k', {at}, 'from', {at} div 2, 'n', 2, 'left', cast(array() as array<bigint>), 'right', cast(array() as array<bigint>))" if pairs else f"get(__units, {at})"
    of = F.expr(f"transform(__wanted, w -> named_struct('u', {unit}, 'parts', w & 4294967295))")
    bodies = F.transform(of, lambda w: F.struct(w["u"].alias("u"), w["parts"].alias("parts"), F.array_join(F.slice("__lines", w["u"]["from"].cast("int"), w["u"]["n"].cast("int")), "\n").alias("body")))
    again = some.select("doc_id", "__key", F.explode_outer(bodies).alias("b"))
    again = again.select("doc_id", "__key", *(F.col(f"b.u.{c}").alias(f"__{c}") for c in ("k", "from", "n", "left", "right")), F.col("b.parts").alias("__parts"), F.col("b.body").alias("__body"), F.xxhash64("b.body").alias("__hash"))
    again = scratch.put(again.withColumn("__part", F.pmod(F.xxhash64("doc_id", "__key", "__k"), "__parts")))
    scratch.drop(hashes, often)
    place = F.struct("doc_id", "__key", "__k", "__left", "__right")
    first = again.groupBy("__hash", "__body").agg(F.min(place).alias("f"), F.max("__parts").alias("__parts"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = first.select("__hash", "__body", "f", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)).alias("__part"))
    same = again.join(first, ["__hash", "__body", "__part"])
    later = same.filter(~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("__key") == F.col("f.__key")) & (F.col("__k") == F.col("f.__k"))))
    low = F.col("__from") - F.expr(shared_lines("reverse(__left)", "reverse(f.__left)"))
    high = F.col("__from") + F.col("__n") - 1 + F.expr(shared_lines("__right", "f.__right"))
    out = later.groupBy("doc_id", "__key").agg(F.collect_set(F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))).alias("__gone"))
    out = scratch.put(out.withColumnRenamed("doc_id", "__id"))
    scratch.drop(wanted, again)
    return out


def with_gone(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """keyed with __gone, null where nothing is to go; gone is a table."""
    gone = gone.withColumnRenamed("__key", "__key2")
    return join_sized(keyed, gone, keyed["doc_id"].eqNullSafe(gone["__id"]) & (keyed["__key"] == gone["__key2"]), "left", items="__gone")


def with_places(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """row (all columns of docs), text and __gone, null where nothing is to go; gone is a table."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.xxhash64("text").alias("__key"))
    return with_gone(whole, gone).select("row", "text", "__gone")


def columns_with(docs: DataFrame, text: Column, *more: str) -> list[Column]:
    """The columns of docs from row, with another text; those named in `more` are left out."""
    return [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in more]


def dedup_lines(docs: DataFrame, counts: bool = True, every: bool = False) -> DataFrame:
    """docs with repeated lines taken out of text; counts adds n_lines and n_removed, which replace columns of those names.

    every: also what the chunks miss of repeated runs of two lines.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    joined = with_places(docs, repeated_lines(docs.select("doc_id", "text"), scratch, every))
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    joined = joined.withColumn("lines", F.split(F.when(F.col("__gone").isNotNull(), F.col("text")), "\n", -1))
    if every:
        joined = joined.withColumn("full", F.transform("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        full = "element_at(full, i) or i > r.low and element_at(full, i - 1) or i < r.high and element_at(full, i + 1)"
        gone = F.expr(f"flatten(transform(__gone, r -> filter(sequence(r.low, r.high), i -> {full})))")
    else:
        gone = F.flatten(F.transform("__gone", lambda r: F.sequence(r["low"], r["high"])))
    kept = F.transform(F.array_except(F.sequence(F.lit(1), F.size("lines")), gone), lambda i: F.element_at("lines", i))
    joined = joined.withColumn("kept", kept)
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    removed = F.when(F.col("__gone").isNull(), F.lit(0).cast("long")).otherwise(lines - F.size("kept"))
    if not counts:
        return joined.select(*columns_with(docs, text))
    return joined.select(*columns_with(docs, text, "n_lines", "n_removed"), lines.alias("n_lines"), removed.alias("n_removed"))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the MD5 of the text that is left, per document."""
    out = dedup_lines(table(sf_dir, "documents", spark, "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


ORACLE = rf"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, text FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM l WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM x),
b AS (SELECT *, (h + {FACTOR} * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {MODULUS} AS r FROM h),
r AS (SELECT *, (i = n OR (i > 1 AND i < n - 1 AND r < lag(r) OVER (PARTITION BY doc_id ORDER BY i) AND r <= lead(r) OVER (PARTITION BY doc_id ORDER BY i))) AS last FROM b),
k AS (SELECT *, coalesce(sum(CASE WHEN last THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM r),
c0 AS (SELECT doc_id, k, min(i) AS a, max(i) AS z, string_agg(line, chr(10) ORDER BY i) AS body, list(line ORDER BY i) AS ls FROM k GROUP BY doc_id, k),
c AS (SELECT *, list_concat(coalesce(lag(ls, 2) OVER w, []), coalesce(lag(ls) OVER w, [])) AS pre, list_concat(coalesce(lead(ls) OVER w, []), coalesce(lead(ls, 2) OVER w, [])) AS post FROM c0 WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
u AS (SELECT doc_id, a, z, body, pre, post, 1 AS kind FROM c WHERE z > a
    UNION ALL SELECT doc_id, i, i, line, [], [], 0 FROM x WHERE len(regexp_extract_all(line, '[^ 	-
]+')) >= {LONG_WORDS}),
g AS (SELECT *, row_number() OVER w AS place, first_value(pre) OVER w AS pre0, first_value(post) OVER w AS post0 FROM u WHERE regexp_matches(body, '[^ 	-
]') WINDOW w AS (PARTITION BY body ORDER BY doc_id, 2 * a + kind)),
s AS (SELECT *, least(len(pre), len(pre0)) AS np, least(len(post), len(post0)) AS nq FROM g WHERE place > 1),
t AS (SELECT doc_id, a - coalesce(nullif(list_position(list_transform(range(1, np + 1), lambda j: pre[len(pre) + 1 - j] = pre0[len(pre0) + 1 - j]), false), 0) - 1, np) AS low,
    z + coalesce(nullif(list_position(list_transform(range(1, nq + 1), lambda j: post[j] = post0[j]), false), 0) - 1, nq) AS high FROM s),
v AS (SELECT DISTINCT doc_id, unnest(range(low, high + 1)) AS i FROM t),
o AS (SELECT x.doc_id, count(*) AS n_lines, count(v.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY x.i) FILTER (WHERE v.i IS NULL), '') AS kept FROM x LEFT JOIN v ON v.doc_id = x.doc_id AND v.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(o.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(o.n_removed, 0) AS BIGINT) AS n_removed,
    CASE WHEN d.text IS NULL THEN NULL ELSE md5(o.kept) END AS kept_md5 FROM documents d LEFT JOIN o USING (doc_id)
"""
