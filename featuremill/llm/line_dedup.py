"""Line dedup within one word edit, by a deletion-neighbourhood join.

A line is its words joined by one space. Lines are ordered by (doc_id, row, line number); row is 0 unless rows share an id, else
60 bits of the text's MD5. A line with a word goes if an
earlier line of the corpus has equal words; a line of ``MIN_WORDS`` words and more also goes if an earlier one of as many
is at word edit distance 1 from it (one word inserted, deleted or replaced), whether or not that earlier line goes
itself. In shorter lines one edit is too large a part, so only equal ones are repeats.

Equal lines are grouped first, so that each text counts once. A text can only have a neighbour if it shares its first
or its second half with another text (an edit spares one of the halves), so only such texts emit their deletion
neighbourhood: the text itself and, for each word outside the shared half, the text without it, as hashed keys. Equal keys are joined by a
grouped minimum, never by pairs: each key hands on its earliest text. What a text receives is then verified on the
words themselves, once for each pair. Native functions only.

Defined cases: null text has no lines and stays null; an empty text has one empty line; lines without words stay; rows with the same doc_id (or
none) are documents of their own; of equal rows one comes first, so the others keep only lines without words; null ids are the earliest; extra columns
pass through ``dedup_lines``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, drop, sized, table, written

MIN_WORDS = 5
#: Bytes up to which the lists of lines to take out are broadcast.
BROADCAST_BYTES = 32 << 20


def _raw_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, raw). Splits at a single character, which needs no regex."""
    odd = [F.col("text").contains(c) for c in "\t\x0b\x0c\r"]
    text = F.when(odd[0] | odd[1] | odd[2] | odd[3], F.translate("text", "\t\x0b\x0c\r", "    ")).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "row", F.posexplode(F.split(text, "\n")).alias("line", "raw"))


def _count(text: Column, char: str) -> Column:
    """How often the one-byte ``char`` is in ``text``."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def _lines(raw: DataFrame) -> DataFrame:
    """``raw`` column to ``x``, the line's words joined by one space, and ``n``, their number; lines with words only."""
    x = F.trim("raw")
    x = F.when(x.contains("  "), F.regexp_replace(x, " {2,}", " ")).otherwise(x)
    rows = raw.withColumn("x", x).drop("raw")
    return rows.withColumn("n", _count(F.col("x"), " ") + 1).filter("x <> ''")


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, a, b, halves): hashes of each line and of its halves; lines below ``MIN_WORDS`` have no halves.

    Texts at distance 1 share a half, as an edit spares one of them: the halves are cut for the line's length and, for
    neighbours with one word less, for the length below. All are cut from the line's text, without splitting it.
    """
    x, n = F.col("x"), F.col("n")
    h, g = F.shiftright(n, 1), F.shiftright(n - 1, 1)
    cut = lambda k: F.call_function("substring_index", x, F.lit(" "), k)
    halves = [
        F.xxhash64(F.lit("first"), n, cut(h)),
        F.xxhash64(F.lit("last"), n, cut(h - n)),
        F.xxhash64(F.lit("first"), n - 1, cut(g)),
        F.xxhash64(F.lit("last"), n - 1, cut(g - n + 1)),
    ]
    found = F.when(n >= MIN_WORDS, F.array(*halves))
    return _lines(_raw_lines(docs)).select("doc_id", "row", "line", F.xxhash64(x).alias("a"), F.hash(x).alias("b"), found.alias("halves"))


def _without(w: Column, i: Column) -> Column:
    """``w`` without its i-th word (from 1); i = 0: ``w``."""
    return F.when(i == 0, w).otherwise(F.concat(F.slice(w, F.lit(1), F.greatest(i - 1, F.lit(0))), F.slice(w, i + 1, F.size(w))))


def _near_texts(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, near): texts that have an earlier text at distance 1, and the place of the earliest one."""
    halves = texts.select("doc_id", "row", "line", F.posexplode("halves").alias("side", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    places = halves.join(shared, "half", "left_semi").groupBy("doc_id", "row", "line").agg(F.bool_or(F.col("side") % 2 == 0).alias("head"), F.bool_or(F.col("side") % 2 == 1).alias("tail"))
    places = written(places.select(F.col("doc_id").alias("at_id"), F.col("row").alias("at_row"), F.col("line").alias("at_line"), "head", "tail"), "candidates")
    ids = places.select("at_id", "at_row").distinct()
    id_is = lambda d: d["doc_id"].cast("long").eqNullSafe(F.col("at_id")) & (d["row"] == F.col("at_row"))
    docs = docs.select("doc_id", "row", "text")
    found = docs.join(sized(ids, places.count()), id_is(docs), "left_semi")
    raw = _raw_lines(found)
    own = _lines(raw.join(sized(places, places.count()), id_is(raw) & (F.col("line") == F.col("at_line"))))
    own = own.select(F.xxhash64("x").alias("a"), F.hash("x").alias("b"), "doc_id", "row", "line", F.split("x", " ").alias("w"), "head", "tail")
    first = F.min_by(F.struct("doc_id", "row", "line", "w", "head", "tail"), F.struct("doc_id", "row", "line")).alias("x")
    own = own.groupBy("a", "b").agg(first).select("a", "b", "x.*")
    texts = written(own.select("a", "b", F.struct("doc_id", "row", "line").alias("at"), "w", "head", "tail"), "texts")

    # an edit beside a shared first half is behind it, one beside a shared last half before it
    g = F.shiftright(F.size("w") - 1, 1)
    words = texts.select("a", "b", "at", F.when(F.col("head"), g).alias("behind"), F.when(F.col("tail"), g + 1).alias("until"), F.posexplode("w").alias("i", "word"))
    words = words.select("a", "b", "at", "behind", "until", (F.col("i") + 1).alias("i"), F.xxhash64("word", F.col("i") + 1).alias("here"), F.xxhash64("word", "i").alias("moved"))
    text = Window.partitionBy("a", "b").orderBy("i")
    left = F.coalesce(F.bit_xor("here").over(text.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    right = F.coalesce(F.bit_xor("moved").over(text.rowsBetween(1, Window.unboundedFollowing)), F.lit(0).cast("long"))
    cut = words.select("a", "b", "at", "i", "behind", "until", left.bitwiseXOR(right).alias("rest")).filter("i > behind OR i <= until")
    whole = words.groupBy("a", "b").agg(F.first("at").alias("at"), F.bit_xor("here").alias("rest"))
    cut = cut.select("a", "b", "at", "i", F.explode(F.array(F.struct(F.xxhash64("rest", "i").alias("key"), F.lit("r").alias("kind")), F.struct(F.xxhash64("rest", F.lit(0)).alias("key"), F.lit("d").alias("kind")))).alias("k"))
    variants = cut.select("a", "b", "at", "i", "k.key", "k.kind").unionByName(
        whole.select("a", "b", "at", F.lit(0).alias("i"), F.xxhash64("rest", F.lit(0)).alias("key"), F.lit("w").alias("kind"))
    )
    variants = written(variants, "variants")
    # replaced words ("r") meet each other; a text without a word ("d") meets whole texts ("w"), and they meet both
    least = F.struct("at", "i")
    met = variants.groupBy("key").agg(
        F.min(F.when(F.col("kind") != "d", least)).alias("not_cut"), F.min(least).alias("any"), F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")
    ).filter("n > 1 AND first < last")
    met = written(met.select("key", "not_cut", "any"), "met")
    given = variants.join(met, "key").withColumn("to", F.when(F.col("kind") == "d", F.col("not_cut")).otherwise(F.col("any")))
    given = given.filter("to.at < at").select("a", "b", F.col("to.at").alias("near"), "i", F.col("to.i").alias("j"))
    # equal words in a row give a pair many times; equal keys are equal texts but for collisions, so one is enough
    given = written(given.groupBy("a", "b", "near").agg(F.min(F.struct("i", "j")).alias("x")).select("a", "b", "near", "x.*"), "given")
    for gone in (places, variants, met):
        drop(gone)
    mine, other = texts.select("a", "b", F.col("w").alias("mine")), texts.select(F.col("at").alias("near"), F.col("w").alias("other"))
    both = given.join(mine, ["a", "b"]).join(other, "near")
    allowed = (F.col("i") == F.col("j")) | (F.col("i") == 0) | (F.col("j") == 0)
    verified = both.filter(allowed & (_without(F.col("mine"), F.col("i")) == _without(F.col("other"), F.col("j"))))
    near = written(verified.groupBy("a", "b").agg(F.min("near").alias("near")), "near")
    drop(texts)
    drop(given)
    return near


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, gone): for each document (doc_id, row, text) that loses lines, the numbers of these lines."""
    place = F.struct("doc_id", "row", "line")
    seen = written(_hashed(docs), "lines")
    texts = seen.groupBy("a", "b").agg(F.min(place).alias("at"), F.first("halves").alias("halves"), F.count("*").alias("n"))
    texts = written(texts.select("a", "b", "at.doc_id", "at.row", "at.line", "halves", "n"), "distinct-lines")
    near = _near_texts(docs, texts)
    active = texts.join(near, ["a", "b"], "left").filter("n > 1 OR near IS NOT NULL")
    active = written(active.select("a", "b", F.least(place, F.coalesce("near", place)).alias("first")), "active")
    drop(texts)
    drop(near)
    gone = seen.select("doc_id", "row", "line", "a", "b").join(sized(active, active.count()), ["a", "b"]).filter(F.col("first") < place)
    gone = written(gone.groupBy("doc_id", "row").agg(F.collect_set("line").alias("gone")), "gone")
    drop(seen)
    drop(active)
    return gone


def _with_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows, copies): ``docs`` with ``row``; the second holds all but one of equal rows (doc_id, row), if there are any."""
    shared = docs.groupBy(F.col("doc_id").cast("long").alias("_shared")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_shared")
    shared = written(shared, "shared")
    n = shared.count()
    if not n:
        return docs.withColumn("row", F.lit(0).cast("long")), None
    mark = F.coalesce(F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long"), F.lit(0))
    joined = docs.join(sized(shared.withColumn("_is", F.lit(True)), n), F.col("doc_id").cast("long").eqNullSafe(F.col("_shared")), "left")
    rows = joined.withColumn("row", F.when(F.col("_is"), mark).otherwise(F.lit(0))).drop("_shared", "_is")
    key = [F.col("doc_id").cast("long").alias("_e_id"), F.col("row").alias("_e_row")]
    equal = written(rows.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1").select("_e_id", "_e_row"), "equal")
    m = equal.count()
    if not m:
        return rows, None
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_e_id")) & (F.col("row") == F.col("_e_row"))
    # numbered once, so that one row of each kind can be told from the others
    several = written(rows.join(sized(equal, m), same).withColumn("_number", F.monotonically_increasing_id()), "several")
    first = several.groupBy("_e_id", "_e_row").agg(F.min("_number").alias("_first")).select("_first")
    first = written(first, "first")
    is_first = several.join(sized(first, m), F.col("_number") == F.col("_first"), "left")
    one = rows.join(sized(equal, m), same, "left_anti")
    kept = is_first.filter("_first IS NOT NULL").select(*one.columns)
    return one.unionByName(kept), is_first.filter("_first IS NULL").select(*docs.columns)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and n_lines, n_removed (long), which replace columns of these names."""
    counts = ("n_lines", "n_removed")
    other = [c for c in docs.columns if c not in ("doc_id", "text", *counts)]
    # further columns are set aside, so that none has the name of one used here
    own = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"_other{k}") for k, c in enumerate(other)])
    rows, copies = _with_rows(own)
    gone = repeated_lines(rows).select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row"), F.col("gone").alias("_gone_lines"))
    n_bytes = gone.agg(F.coalesce(F.sum(32 + 4 * F.size("_gone_lines")), F.lit(0))).first()[0]
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_id")) & (F.col("row") == F.col("_gone_row"))
    joined = rows.join(sized(gone, n_bytes, BROADCAST_BYTES), same, "left")
    if copies is not None:
        words = F.transform(F.split("text", "\n"), lambda x, i: F.when(F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "", i))
        again = copies.withColumn("_gone_lines", F.filter(words, lambda i: i.isNotNull()))
        joined = joined.select(*again.columns).unionByName(again)
    lines = F.split("text", "\n")
    n = _count(F.col("text"), "\n") + 1
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone_lines"))
    # the array of one array binds the lines, so that the text is split once
    joined_text = F.transform(F.array(lines), lambda ls: F.array_join(F.transform(kept, lambda i: F.get(ls, i)), "\n"))[0]
    text = F.when(F.col("_gone_lines").isNull(), F.col("text")).otherwise(joined_text)
    made = {"n_lines": F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"), "n_removed": F.when(F.col("_gone_lines").isNull() | F.col("text").isNull(), 0).otherwise(n - F.size(kept)).cast("long")}
    names = [c for c in docs.columns if c not in ("text", *counts)]
    return joined.select(*["doc_id" if c == "doc_id" else F.col(f"_other{other.index(c)}").alias(c) for c in names], text.alias("text"), *[e.alias(k) for k, e in made.items()])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(text)) AS row, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT row, unnest(range(0, len(ls))) AS line, ls FROM d),
x AS (SELECT row, line, list_filter(regexp_split_to_array(ls[line + 1], '{SPACE_CLASS}'), lambda x: x <> '') AS w FROM l),
t AS (SELECT w, min((row, line)) AS pos FROM x WHERE len(w) > 0 GROUP BY w),
e AS (SELECT w, pos FROM t WHERE len(w) >= {MIN_WORDS}),
v AS (SELECT w, pos, i, list_concat(w[1:i - 1], w[i + 1:]) AS r FROM (SELECT w, pos, unnest(range(1, len(w) + 1)) AS i FROM e)),
pairs AS (
  SELECT a.w, b.pos FROM v a JOIN v b ON a.r = b.r AND a.i = b.i
  UNION ALL SELECT v.w, e.pos FROM v JOIN e ON v.r = e.w
  UNION ALL SELECT e.w, v.pos FROM v JOIN e ON v.r = e.w
  UNION ALL SELECT w, pos FROM t),
first AS (SELECT w, min(pos) AS pos FROM pairs GROUP BY w),
gone AS (SELECT x.row, x.line FROM x JOIN first f ON x.w = f.w WHERE f.pos < (x.row, x.line)),
kept AS (SELECT l.row, string_agg(l.ls[l.line + 1], chr(10) ORDER BY l.line) AS t, count(*) AS n FROM l ANTI JOIN gone g ON l.row = g.row AND l.line = g.line GROUP BY l.row)
SELECT d.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(k.n, 0))::BIGINT AS n_removed, md5(coalesce(k.t, '')) AS kept_md5
FROM d LEFT JOIN kept k ON d.row = k.row
"""
