"""Line deduplication by overlapping three-line windows.

Every run of three consecutive lines is a window. Windows are compared over the whole table by hashes of their
lines (96 bits). Of each repeated window the first occurrence stays, in order of doc_id and line; the lines of
later ones are covered, overlapping covers merge into spans, and the spans are removed. Windows without a word
are not compared.

Hot windows: occurrences are counted with map-side combining, and only windows that occur twice meet the
occurrences again, in a join whose hot keys Spark may split. Nothing but a document's own spans is gathered.

Rows: null text has no lines and stays null; empty text is one empty line; texts of under three lines stay as
they are; very long texts have as many windows as lines; a null doc_id sorts first; rows with equal doc_id and
text count as one document, and all of them come back with the same decision; an empty table gives an empty
result. Other columns can have any name: they are neither read nor returned, unless named in `carry`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def windows(docs: DataFrame) -> DataFrame:
    """(h, g, at = struct(id, key, pos)) for each window of rows (id, key, lines)."""
    last = WINDOW - 1
    each = F.expr(
        f"""transform(sequence(0, size(lines) - {WINDOW}), i -> struct(
            xxhash64({", ".join(f"lines[i + {k}]" for k in range(WINDOW))}) as h,
            hash({", ".join(f"lines[i + {last - k}]" for k in range(WINDOW))}) as g,
            {" or ".join(f"lines[i + {k}] rlike '[^ \\t-\\r]'" for k in range(WINDOW))} as worded))"""
    )
    found = docs.filter(F.size("lines") >= WINDOW).select("id", "key", F.posexplode(each).alias("pos", "w"))
    return found.filter("w.worded").select("w.h", "w.g", F.struct("id", "key", "pos").alias("at"))


def repeated_starts(occurrences: DataFrame) -> DataFrame:
    """(id, key, starts): where later occurrences of repeated windows begin, in order."""
    first = occurrences.groupBy("h", "g").agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last")
    # The join's key is derived from the grouping's key, so that Spark shuffles anew and can split hot windows.
    sides = [x.select(F.col("h").bitwiseXOR(F.lit(1)).alias("hk"), F.col("g").bitwiseXOR(F.lit(1)).alias("gk"), c) for x, c in ((occurrences, "at"), (first, "first"))]
    later = sides[0].join(sides[1], ["hk", "gk"]).filter("at > first")
    return later.groupBy("at.id", "at.key").agg(F.sort_array(F.collect_set("at.pos")).alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans, spans (from, to: line numbers from 0, end excluded) and what stays of
    the text; with `carry`, those columns too, in a struct `carried`."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        *([F.struct(*carry).alias("carried")] if carry else []),
    ).withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    split = F.split("text", "\n", -1)
    starts = repeated_starts(windows(rows.select("id", "key", split.alias("lines"))))
    met = rows.alias("r").join(starts.alias("s"), F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.key") == F.col("s.key")), "left").select("r.*", F.coalesce("s.starts", F.array().cast("array<int>")).alias("starts"))
    spans = met.withColumn("lines", split).withColumns(
        {
            "begins": F.expr(f"filter(starts, (s, i) -> i = 0 or s > starts[i - 1] + {WINDOW})"),
            "ends": F.expr(f"transform(filter(starts, (s, i) -> i = size(starts) - 1 or starts[i + 1] > s + {WINDOW}), s -> s + {WINDOW})"),
        }
    )
    kept = F.expr("flatten(transform(sequence(0, size(begins)), i -> slice(lines, if(i = 0, 0, ends[i - 1]) + 1, if(i = size(begins), size(lines), begins[i]) - if(i = 0, 0, ends[i - 1]))))")
    return spans.select(
        F.col("id").alias("doc_id"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.expr("cast(aggregate(zip_with(begins, ends, (b, e) -> e - b), 0, (a, x) -> a + x) as long)").alias("n_removed"),
        F.size("begins").cast("long").alias("n_spans"),
        F.expr("zip_with(begins, ends, (b, e) -> struct(b as from, e as to))").alias("spans"),
        F.when(F.size("begins") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        *(["carried"] if carry else []),
    )


ORACLE = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos
  from documents where text is not null),
three as (
  select doc_id, pos, [line, lead(line, 1) over w, lead(line, 2) over w] as win, lead(pos, 2) over w as last
  from lines window w as (partition by doc_id order by pos)),
worded as (
  select doc_id, pos, win from three
  where last is not null and (regexp_matches(win[1], '[^\x20\x09-\x0D]') or regexp_matches(win[2], '[^\x20\x09-\x0D]') or regexp_matches(win[3], '[^\x20\x09-\x0D]'))),
ranked as (select doc_id, pos, row_number() over (partition by win order by doc_id, pos) as n from worded),
covered as (select distinct doc_id, pos + k as pos from ranked, (values (0), (1), (2)) as t(k) where n > 1),
marked as (
  select l.doc_id, l.pos, l.line, c.pos is not null as gone
  from lines l left join covered c on l.doc_id = c.doc_id and l.pos = c.pos),
edges as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by pos), false) as begins from marked),
sums as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, count(*) filter (where begins) as n_spans,
         coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text
  from edges group by doc_id)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans, s.text as text
from documents d left join sums s on d.doc_id = s.doc_id
"""
