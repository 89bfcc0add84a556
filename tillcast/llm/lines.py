"""Lines that many documents share, dropped from all of them.

A line's key is the line without white space at both ends, A-Z in lower case. Keys are
hashed, the documents of a hash are counted, and the positions of the lines over the
threshold go back to their texts, which are put together again from what lies between.
Only DataFrame functions: hashes and positions are shuffled for the count, and a text
once, to meet its positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, col, fresh, read

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_DOCS, MIN_CHARS = 10, 1


def split_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped and folded; lower() is the same for a line of ASCII only, and faster."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _two_hashes(value: Column) -> list[Column]:
    """128 bits in two columns: one hash of 64 bits would meet another by chance at 10^10 lines."""
    return [F.xxhash64(value), F.xxhash64(F.lit("second"), value)]


def drop_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
                      min_chars: int = MIN_CHARS, names: tuple[str, str, str] = ("kept", "n_lines", "n_dropped")) -> DataFrame:
    """docs with the text that is left, the number of its lines before, and of those dropped.

    A key of ``min_chars`` code points or more that ``min_docs`` documents hold loses all
    its lines. Rows of one doc_id, null included, count as one document; every row is
    returned, repeated rows too. A null or empty text is one empty line, and what is left
    of it is the empty text. Columns of docs with one of ``names`` are replaced. An empty
    table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.select(*[col(c) for c in docs.columns if c not in names])
    whole = _two_hashes(F.coalesce(col(text), F.lit("")))
    keyed = (docs.select(col(doc_id).alias("id"), whole[0].alias("t1"), whole[1].alias("t2"), F.posexplode(split_lines(col(text))).alias("pos", "line"))
             .select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars))
    first, second = _two_hashes(F.col("key"))
    lines = scratch.keep(keyed.select("id", "t1", "t2", "pos", first.alias("h1"), second.alias("h2")))
    common = scratch.keep(lines.groupBy("h1", "h2").agg(F.count_distinct(F.struct("id")).alias("n"))
                          .where(F.col("n") >= min_docs).select("h1", "h2"))
    gone = lines.join(common, ["h1", "h2"]).groupBy("id", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("at"))

    a, b, i, at = (fresh(docs, x) for x in ("__t1", "__t2", "__id", "__at"))
    gone = gone.select(F.col("id").alias(i), F.col("t1").alias(f"{a}_"), F.col("t2").alias(f"{b}_"), F.col("at").alias(at))
    met = docs.withColumns({a: whole[0], b: whole[1]}).join(
        gone, col(doc_id).eqNullSafe(col(i)) & (col(a) == col(f"{a}_")) & (col(b) == col(f"{b}_")), "left")
    places = col(at)
    every = F.struct(split_lines(col(text)).alias("lines"), F.concat(F.array(F.lit(-1)), places, F.array(F.size(split_lines(col(text))))).alias("ends"))
    # bound by a lambda, so that a text is split once and not for each of its positions
    between = F.transform(F.array(every), lambda x: F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(x["ends"]) - 1),
        lambda k: F.slice(x["lines"], F.get(x["ends"], k - 1) + 2, F.get(x["ends"], k) - F.get(x["ends"], k - 1) - 1))))
    left = F.when(places.isNull(), F.coalesce(col(text), F.lit(""))).otherwise(F.array_join(F.get(between, F.lit(0)), "\n"))
    return met.select(*[col(c) for c in docs.columns], left.alias(names[0]), F.size(split_lines(col(text))).cast("long").alias(names[1]),
                      F.coalesce(F.size(places), F.lit(0)).cast("long").alias(names[2]))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = f"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
each as (select doc_id, generate_subscripts(lines, 1) as pos, unnest(lines) as line from split),
keyed as (select doc_id, pos, line,
                 translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as key from each),
common as (select key from keyed where length(key) >= {MIN_CHARS} group by key having count(distinct doc_id) >= {MIN_DOCS})
select k.doc_id, count(*) as n_lines, count(c.key) as n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) order by k.pos) filter (where c.key is null), '')) as kept_sha256
from keyed k left join common c on c.key = k.key
group by k.doc_id
"""
