"""Queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import encoding, mixing, nearcopies, packing, prose, termcounts, weighting
from quarrylight.llm.tokens import token_counter
from quarrylight.storage import written
from quarrylight.tables import spread, table


def _repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows that can be garbled; a text of ASCII characters can't and is not sent to Python."""
    return encoding.repair_encoding(encoding.beyond_ascii(spread(table(spark, sf_dir, "collection").select("line_no", "text"))))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).where("garbled").select("line_no")


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir).where("layers > 0").select("line_no", "restored", "layers")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.alike_pairs(*nearcopies.alike(table(spark, sf_dir, "collection"), run=3, similarity=0.5))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.groups(*nearcopies.alike(table(spark, sf_dir, "collection"), run=3, similarity=0.5))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = weighting.term_weights(table(spark, sf_dir, "postings"), table(spark, sf_dir, "doc_stats"))
    return weighting.top_terms(weights).select("doc_id", "term")


def p4_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's term of greatest residual weight."""
    weights = weighting.term_weights(table(spark, sf_dir, "postings"), table(spark, sf_dir, "doc_stats"))
    return weighting.top_terms(weights.withColumn("residual", F.round("residual", 9)), "residual").withColumn("residual", F.round("residual", 6))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termcounts.marked_terms(table(spark, sf_dir, "postings")).where("mark is not null").select("term")


def p5_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termcounts.marked_terms(table(spark, sf_dir, "postings"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_sizes(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), table(spark, sf_dir, "pack_sizes"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the largest containers hold only in pieces."""
    sizes = table(spark, sf_dir, "pack_sizes")
    largest = sizes.join(sizes.agg(F.max("capacity").alias("capacity")), "capacity")
    packed = packing.pack(packing.token_sizes(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))), largest)
    return packed.where("piece_no = 1 and container is not null").select("doc_id").distinct()


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    count = token_counter(spark)
    sized = written(documents.select("doc_id", "source", count(F.col("text")).alias("tokens")), "mix-sizes")
    return mixing.mix(sized, table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1].where("short").select("source")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_statistics(spark, sf_dir).where("not is_prose").select("doc_id")


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.text_statistics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "common_words"))


QUERIES = {
    "p1_found": p1_found,
    "p1_restored": p1_restored,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p4_residual": p4_residual,
    "p5_found": p5_found,
    "p5_term_counts": p5_term_counts,
    "p7_found": p7_found,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_statistics": p9_statistics,
}

_COUNTED = """counted as (select distinct shard_no, run_no, rec_no, lower(regexp_replace(term, '[^A-Za-z0-9]', '', 'g')) as term, doc_id, freq
    from postings where freq >= 1 and regexp_replace(term, '[^A-Za-z0-9]', '', 'g') <> '')"""
_WEIGHTS = f"""{_COUNTED},
  lens as (select doc_id, len from doc_stats qualify row_number() over (partition by doc_id order by counted_at desc, len desc nulls last) = 1),
  live as (select doc_id, len::double as len from lens where len > 0),
  s as (select count(*)::double as n, avg(len) as mean from live),
  tf as (select doc_id, term, sum(freq)::bigint as tf from counted join live using (doc_id) group by all),
  ft as (select term, count(*) as ft, sum(tf)::double as cf from tf group by all),
  w as (select doc_id, term, ln((n - ft + 0.5::double) / (ft + 0.5::double) + 1.0::double) * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * len / mean)) as weight,
      round(tf * (log2(n / ft) + log2(1.0::double - exp(-cf / n))), 9) as residual from tf join ft using (term) join live using (doc_id), s where ft >= 2)"""
_TERMS = f"""{_COUNTED},
  n as (select count(distinct doc_id) as n from counted),
  t as (select term, sum(freq)::bigint as occurrences, count(distinct doc_id) as records from counted group by all),
  m as (select term, occurrences, records, case when records < 3 then 'rare' when records > 0.25 * n then 'common' end as mark from t, n)"""

_ALIKE = """words as (select line_no, list_filter(list_transform(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: lower(regexp_replace(x, '[^A-Za-z0-9]', '', 'g'))), lambda x: x <> '') as w
      from collection where text is not null),
  runs as (select distinct line_no, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as r from words where len(w) >= 3),
  n as (select line_no, count(*) as n from runs group by all),
  common as (select a.line_no as line_a, b.line_no as line_b, count(*) as c from runs a join runs b on a.r = b.r and a.line_no < b.line_no group by all),
  pairs as (select line_a, line_b from common join n x on x.line_no = line_a join n y on y.line_no = line_b where 2 * c >= x.n + y.n - c)"""

# Sizes keep so clear of the limits that bytes decide as tokens do, at four bytes a token.
_SOURCES = """own as (select translate(lower(trim(source)), '- ', '__') as key, sum(strlen(text))::bigint as size from documents where source is not null group by all),
  wanted as (select source, target_share, coalesce(max_repeats, 1) as most, coalesce(size, 0) as size
    from mix_targets left join own on key = translate(lower(trim(mix_targets.source)), '- ', '__') where mix_targets.source is not null and target_share is not null)"""

SQL = {
    "p7_found": "select distinct doc_id from documents where strlen(text) > 4 * (select max(capacity) from pack_sizes)",
    "p8_found": f"with {_SOURCES} select source from wanted where most * size < target_share * (select sum(size) from wanted)",
    "p3_found": f"with {_ALIKE} select line_a, line_b from pairs",
    "p3_groups": f"""with recursive {_ALIKE},
  same as (select line_a, line_b from common join n x on x.line_no = line_a join n y on y.line_no = line_b where c = x.n and c = y.n),
  classes as (select line_no, least(line_no, coalesce(min(line_a), line_no)) as class_id from n left join same on line_b = line_no group by line_no),
  edges as (select distinct a.class_id as a, b.class_id as b from pairs join classes a on a.line_no = line_a join classes b on b.line_no = line_b where a.class_id <> b.class_id),
  ways as (select a, b from edges union select b, a from edges),
  reach(a, b) as (select class_id, class_id from classes union select r.a, w.b from reach r join ways w on w.a = r.b),
  groups as (select a as class_id, min(b) as group_id from reach group by a),
  degree as (select a as class_id, count(*) as links from ways group by a)
  select line_no, class_id, group_id, coalesce(links, 0) as links from classes join groups using (class_id) left join degree using (class_id)""",
    "p4_found": f"with {_WEIGHTS} select doc_id, term from w qualify row_number() over (partition by doc_id order by weight desc, term) = 1",
    "p4_residual": f"with {_WEIGHTS} select doc_id, term, round(residual, 6) as residual from w qualify row_number() over (partition by doc_id order by residual desc, term) = 1",
    "p5_found": f"with {_TERMS} select term from m where mark is not null",
    "p5_term_counts": f"with {_TERMS} select * from m",
}
