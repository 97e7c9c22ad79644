"""Queries of the general problems, with SQL for the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from actlens.common import read
from actlens.operators import hot_keys, parse_errors


def queries() -> dict:
    return {
        "p1_found": lambda s, d: parse_errors.rejects(read(s, d, "raw_records")).select("line_id", "reason"),
        "p1_dataset_rows": lambda s, d: parse_errors.strict_load(read(s, d, "raw_records"), "dataset").drop("_raw"),
        "p1_feature_rows": lambda s, d: parse_errors.strict_load(read(s, d, "raw_records"), "features").drop("_raw"),
        "p1_reasons": lambda s, d: parse_errors.rejects(read(s, d, "raw_records")).groupBy("file_name", "reason").agg(F.count("*").alias("n")),
        "p3_found": lambda s, d: hot_keys.heavy_keys(read(s, d, "eval_data")).select("concept"),
        "p3_concept_stats": lambda s, d: hot_keys.concept_stats(read(s, d, "eval_data")),
        "p3_concept_quantiles": lambda s, d: hot_keys.concept_quantiles(read(s, d, "eval_data")),
    }


# The SQL parses each line with one regular expression over the whole of it, where the operator cuts it at quotes.
_LINES = r"""
lines as (
  select line_id, file_name, line_no, starts_with(file_name, 'dataset') as ds, ends_with(file_name, '.tsv') as tsv,
         case when ends_with(raw, chr(13)) then raw[1:length(raw)-1] else coalesce(raw, '') end as body
  from raw_records where line_no > 1),
cut as (
  select *, case when tsv then regexp_full_match(body, '(?s)("([^"]|"")*"|[^"\t]*)(\t("([^"]|"")*"|[^"\t]*))*')
                 else regexp_full_match(body, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') end as quoted,
         case when tsv then regexp_extract_all(chr(9) || body, '\t("(?:[^"]|"")*"|[^"\t]*)', 1)
              else regexp_extract_all(',' || body, ',("(?:[^"]|"")*"|[^",]*)', 1) end as parts
  from lines),
plain as (
  select *, list_transform(parts, lambda f: case when starts_with(f, '"') then replace(f[2:length(f)-1], '""', '"') else f end) as f from cut),
tok as (
  select *, regexp_extract_all(f[2], '\[[^\]]+\]|%[0-9][0-9]|Br|Cl|[BCNOSPFIbcnosp().=#\-+\\/:~@?>*$0-9]') as t from plain),
judged as (
  select *,
    case when not quoted then 'quoting'
         when len(f) <> (case when ds then 7 else 5 end) then 'column_count'
         when ds and not (
           regexp_full_match(f[1], '[0-9]{1,18}') and regexp_full_match(f[3], '[0-9]{1,18}')
           and f[2] <> '' and array_to_string(t, '') = f[2]
           and list_reduce(list_transform(t, lambda x: case x when '(' then 1 when ')' then -1 else 0 end), lambda a, x: case when a < 0 then a else a + x end, 0) = 0
           and len(list_filter(list_distinct(t), lambda r: regexp_full_match(r, '[0-9]|%[0-9][0-9]') and len(list_filter(t, lambda y: y = r)) % 2 = 1)) = 0
           and trim(f[4], ' ' || chr(9) || chr(10) || chr(13)) <> '' and f[5] in ('cls', 'reg') and f[6] in ('train', 'valid', 'test')
           and (case when f[5] = 'cls' then f[7] in ('0', '1') else regexp_full_match(f[7], '-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') end)) then 'value'
         when not ds and not (
           regexp_full_match(f[1], '[0-9]{1,18}') and f[2] in ('0', '1')
           and len(list_filter(f[3:5], lambda x: not regexp_full_match(x, '-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?'))) = 0) then 'value'
    end as reason
  from tok)
"""

_CONCEPT = r"""
rows as (
  select smiles as sample_idx, lower(trim(concept, ' ' || chr(9) || chr(10) || chr(13))) as concept, token_idxs,
         coalesce(len(list_filter(flatten(token_idxs), lambda x: x is not null)), 0) as width
  from eval_data where trim(concept, ' ' || chr(9) || chr(10) || chr(13)) <> '')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"with {_LINES} select line_id, reason from judged where reason is not null",
        "p1_dataset_rows": f"""with {_LINES} select line_id, file_name, line_no, f[1]::bigint as record_id, f[2] as smiles, f[3]::bigint as canon_index,
            f[4] as task, f[5] as task_type, f[6] as split, f[7]::double as y from judged where reason is null and ds""",
        "p1_feature_rows": f"""with {_LINES} select line_id, file_name, line_no, f[1]::bigint as canon_index, f[2]::int as "isSmilesRDKitParsable",
            f[3]::double as logp, f[4]::double as molwt, f[5]::double as tpsa from judged where reason is null and not ds""",
        "p1_reasons": f"with {_LINES} select file_name, reason, count(*) as n from judged where reason is not null group by all",
        "p3_found": f"""with {_CONCEPT}, k as (select concept, count(*) as n, sum(width) as w from rows group by concept)
            select concept from k where n >= 0.05 * (select sum(n) from k) or (w > 0 and w >= 0.05 * (select sum(w) from k))""",
        "p3_concept_stats": f"""with {_CONCEPT},
            s as (select concept, count(*) as rows, sum(coalesce(len(list_filter(token_idxs, lambda m: m is not null)), 0))::bigint as matches,
                         quantile_disc(width, 0.5)::bigint as width_p50, quantile_disc(width, 0.95)::bigint as width_p95 from rows group by concept),
            p as (select concept, count(*) as positions from (
                    select distinct concept, sample_idx, token from (select concept, sample_idx, unnest(flatten(token_idxs)) as token from rows)
                    where token is not null and sample_idx is not null) group by concept)
            select s.concept, rows, matches, coalesce(positions, 0)::bigint as positions, width_p50, width_p95 from s left join p using (concept)""",
        "p3_concept_quantiles": f"""with {_CONCEPT},
            a as (select concept, quantile_disc(sample_idx, 0.25)::bigint as sample_p25, quantile_disc(sample_idx, 0.5)::bigint as sample_p50, quantile_disc(sample_idx, 0.75)::bigint as sample_p75
                  from rows where sample_idx is not null group by concept),
            t as (select concept, unnest(flatten(token_idxs)) as token from rows),
            b as (select concept, quantile_disc(token, 0.25)::bigint as token_p25, quantile_disc(token, 0.5)::bigint as token_p50, quantile_disc(token, 0.75)::bigint as token_p75
                  from t where token is not null group by concept)
            select concept, sample_p25, sample_p50, sample_p75, token_p25, token_p50, token_p75 from a full join b using (concept)""",
    }
