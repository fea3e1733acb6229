"""Line dedup by a log-template tree, with DataFrame functions only.

Each line is parsed down a tree of fixed depth: its number of tokens, then its LEAD first tokens; a token with a digit
is a variable field from the start. Below the leaf, lines shorter than LONG tokens are one template if all their tokens
agree. In longer ones one of three equal spans of the rest may vary: two lines that agree outside one span are of the
same template, that span generalised. A line goes if its template recurs in MIN_TEXTS different texts or more and an
earlier one holds it; of PASSAGE tokens and more, two texts are enough. The first text keeps its line, so nothing is
lost altogether. Equal texts count as one and are
treated alike, which leaves copies whole for near-duplicate detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_name, written

LEAD, LONG, MIN_TEXTS, MIN_CONSTANT = 3, 9, 3, 3
#: Lines of so many tokens don't agree by chance: they recur from two texts on.
PASSAGE = 50
_VARIABLE = "<*>"


def _keys(t: str) -> Column:
    """The template keys of a line with tokens t: one, or with one span left out each. Every token is hashed once."""
    tokens, n = F.col(t), F.size(t)
    third = ((n - LEAD) / 3).cast("int")
    cut = [F.lit(LEAD), LEAD + third, LEAD + 2 * third, n]
    whole = F.array(F.xxhash64(n, F.lit(0), tokens))
    lead = F.xxhash64(F.slice(tokens, 1, LEAD))
    spans = [F.xxhash64(F.slice(tokens, cut[j] + 1, cut[j + 1] - cut[j])) for j in range(3)]
    one_out = [F.xxhash64(n, F.lit(j + 1), lead, *(spans[i] for i in range(3) if i != j)) for j in range(3)]
    return F.when(n < LONG, whole).otherwise(F.array(*one_out))


def line_templates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """text_id, key, line (its number), template and whether it is `long`, of every line with MIN_CONSTANT constant tokens or more."""
    lines = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.xxhash64(text).alias("text_id"), F.posexplode(F.split(text, "\n", -1)).alias("line", "x"))
    x = F.col("x")
    # most lines have no digits and only blanks between tokens: those skip the slower expressions
    blank = F.when(x.contains("\t") | x.contains("\r"), F.translate(x, "\t\r", "  ")).otherwise(x)
    plain = F.when(blank.rlike("[0-9]"), F.regexp_replace(blank, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*", _VARIABLE)).otherwise(blank)
    parsed = lines.where(F.length("x") > 2 * MIN_CONSTANT - 2).withColumn("x", plain).withColumn("t", F.array_remove(F.split("x", " ", -1), "")).where(F.size("t") >= MIN_CONSTANT)
    constant = F.when(F.col("x").contains(_VARIABLE), F.size(F.array_remove("t", _VARIABLE))).otherwise(F.size("t"))
    return parsed.where(constant >= MIN_CONSTANT).select("text_id", "key", "line", (F.size("t") >= PASSAGE).alias("long"), F.explode(_keys("t")).alias("template"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """text_id (xxhash64 of a text) and lines: the numbers of its lines that go."""
    found = written(line_templates(docs, key, text), "line-templates")
    texts = found.groupBy("template", "long", "text_id").agg(F.min("key").alias("key"))
    first = F.min(F.struct(F.col("key").isNull().alias("last"), "key", "text_id")).alias("first")
    recurring = texts.groupBy("template", "long").agg(F.count("*").alias("n"), first).where((F.col("n") >= MIN_TEXTS) | (F.col("long") & (F.col("n") > 1)))
    gone = found.select("template", "text_id", "line").join(recurring.select("template", F.col("first.text_id").alias("keeper")), "template").where("text_id != keeper")
    return gone.groupBy("text_id").agg(F.collect_set("line").alias("lines"))


def drop_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", dropped: str | None = "n_dropped") -> DataFrame:
    """All rows and columns, the texts without their repeated lines, and their number as `dropped` (None: not added; a column of that name is replaced).

    The first text of a template is that with the smallest key (null keys last). Lines end at a line feed. Null texts stay
    null; a text all of whose lines go becomes empty; texts without repeated lines stay as they are, byte for byte.
    Lines of fewer than MIN_CONSTANT constant tokens have no template. Repeated rows are treated alike.
    """
    here, there, which = (free_name(docs.columns, x) for x in ("here", "there", "lines"))
    gone = repeated_lines(docs, key, text).select(F.col("text_id").alias(there), F.col("lines").alias(which))
    joined = docs.withColumn(here, F.xxhash64(text)).join(gone, F.col(here) == F.col(there), "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(which))
    rest = F.concat_ws("\n", F.transform(kept, lambda i: F.get(lines, i)))
    has = F.col(which).isNotNull() & F.col(text).isNotNull()
    out = [F.when(has, rest).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if c != dropped]
    return joined.select(*out, *([F.when(has, F.size(which)).otherwise(0).cast("long").alias(dropped)] if dropped else []))
