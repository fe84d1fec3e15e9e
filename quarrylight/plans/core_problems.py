"""Queries of the general data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import rejects, skew
from quarrylight.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.heavy_keys(table(spark, sf_dir, "postings"))


def p2_lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.lexicon_counts(table(spark, sf_dir, "postings"), table(spark, sf_dir, "lexicon"))


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.load(table(spark, sf_dir, "collection"), table(spark, sf_dir, "collection_raw"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).where("reason is not null").select("line_no")


def p6_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).where("reason is null").select("line_no", "id", "text")


def p6_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


QUERIES = {
    "p2_found": p2_found,
    "p2_lexicon_counts": p2_lexicon_counts,
    "p6_found": p6_found,
    "p6_loaded": p6_loaded,
    "p6_reasons": p6_reasons,
}

#: Counted records, each name once.
COUNTED = """counted as (select distinct shard_no, run_no, rec_no, lower(regexp_replace(term, '[^A-Za-z0-9]', '', 'g')) as term, doc_id, freq
    from postings where freq >= 1 and regexp_replace(term, '[^A-Za-z0-9]', '', 'g') <> '')"""

#: A field that starts with a quote ends at the next quote that is not doubled.
_FIELD = """("[^"]*(?:""[^"]*)*"|[^"\t][^\t]*|)"""

#: Every line with its id and text; null where they are not valid.
_LINES = f"""fields as (select line_no, external_id as i, text as t, true as split from collection
    union all select line_no, regexp_extract(l, '^(?s:{_FIELD}\t{_FIELD})$', 1), regexp_extract(l, '^(?s:{_FIELD}\t{_FIELD})$', 2), false
    from (select line_no, regexp_replace(line, '\r$', '') as l from collection_raw)),
  plain as (select line_no, split, t as given,
      trim(case when not split and i like '"%' then replace(i[2:-2], '""', '"') else i end, ' ') as i,
      case when not split and t like '"%' then replace(t[2:-2], '""', '"') else t end as t from fields),
  lines as (select line_no, case when regexp_full_match(i, '[0-9]+') and length(ltrim(i, '0')) <= 19 then try_cast(i as bigint) end as id, t as text,
      split or (t is not null and trim(t, ' ') <> '') as has_text from plain)"""

_REASONS = f"""why as (select case when line is null then 'null line' when not regexp_full_match(l, '(?s:{_FIELD}(\t{_FIELD})*)') then 'broken quoting'
      when regexp_full_match(l, '(?s:{_FIELD})') then 'too few fields' when not regexp_full_match(l, '(?s:{_FIELD}\t{_FIELD})') then 'too many fields'
      when i = '' then 'missing id' when id is null then 'invalid id' when not has_text then 'empty text' end as reason
    from (select line_no, line, regexp_replace(line, '\r$', '') as l from collection_raw) join lines using (line_no) join plain using (line_no)
    union all select case when coalesce(i, '') = '' then 'missing id' else 'invalid id' end from lines join plain using (line_no) where plain.split and id is null)"""

SQL = {
    "p6_reasons": f"with {_LINES}, {_REASONS} select reason, count(*) as n from why where reason is not null group by all",
    "p6_found": f"with {_LINES} select line_no from lines where id is null or not has_text",
    "p6_loaded": f"with {_LINES} select line_no, id, text from lines where id is not null and has_text",
    "p2_found": f"""with {COUNTED},
    k as (select shard_no, term, count(*) as n from counted group by all),
    t as (select shard_no, sum(n) as total from k group by all)
    select shard_no, term from k join t using (shard_no) where n * 50 >= total""",
    "p2_lexicon_counts": f"""with {COUNTED},
    k as (select shard_no, term, count(*) as postings, count(distinct doc_id) as ft from counted group by all),
    l as (select shard_no, term, postings as lexicon_postings from lexicon
      qualify row_number() over (partition by shard_no, term order by built_at desc nulls last, postings desc nulls last) = 1)
    select k.shard_no, k.term, k.postings, k.ft, l.lexicon_postings from k left join l using (shard_no, term)""",
}
