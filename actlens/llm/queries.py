"""Queries of the training data problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from actlens.common import read
from actlens.llm import encode, language, mixing, overlap, percentiles, term_counts, top_n


def _activation_percentiles(s, d):
    return percentiles.percentiles(percentiles.summary(read(s, d, "activations"), ["feature"], "data"), ["feature"])


def _daily_percentiles(s, d):
    """Summaries per day, then combined per feature: the same result as from the whole."""
    daily = percentiles.summary(read(s, d, "activations").withColumn("day", F.to_date("written_at")), ["feature"], "data", parts=("day",))
    return percentiles.percentiles(percentiles.combine(daily, ["feature"]), ["feature"])


_trained: dict = {}


def _weights(docs):
    """The network trained on a table: worked out once for each version of its files in this process."""
    version = docs.sparkSession.sparkContext.applicationId, tuple(sorted(docs.inputFiles())), docs.agg(F.max("_metadata.file_modification_time")).first()[0]
    if version not in _trained:
        _trained.clear()
        _trained[version] = language.train(docs)
    return _trained[version]


def _languages(s, d):
    docs = read(s, d, "documents")
    return language.identify(docs, _weights(docs)).select("doc_id", "language", F.round("confidence", 3).alias("confidence"), F.size("segments").alias("n_segments"))


def queries() -> dict:
    return {
        "p2_found": lambda s, d: overlap.pairs(read(s, d, "dataset")),
        "p2_by_source": lambda s, d: overlap.report(read(s, d, "dataset")),
        "p2_containment": lambda s, d: overlap.containment(read(s, d, "dataset")).withColumn("containment", F.round("containment", 6)),
        "p4_found": lambda s, d: term_counts.term_counts(read(s, d, "token_preference")).where("mark is not null").select("token", "mark"),
        "p4_terms": lambda s, d: term_counts.term_counts(read(s, d, "token_preference")),
        "p5_found": lambda s, d: top_n.top_n(read(s, d, "metrics"), "conceptIdx", "featureIdx", "f1Score", 10).select("conceptIdx", "featureIdx"),
        "p5_hot_groups": lambda s, d: top_n.top_n(read(s, d, "metrics"), "conceptIdx", "featureIdx", "f1Score", 10, heavy=100).select("conceptIdx", "featureIdx", "f1Score", "rank"),
        "p6_percentiles": _activation_percentiles,
        "p6_daily_combined": _daily_percentiles,
        "p6_molptr": lambda s, d: percentiles.percentiles(percentiles.summary(read(s, d, "samples"), ["chunk"], "molptr"), ["chunk"]),
        "p7_ids": lambda s, d: encode.encode_corpus(read(s, d, "documents")),
        "p8_mix": lambda s, d: mixing.mix(read(s, d, "documents"), read(s, d, "mix_targets"))[0],
        "p9_found": lambda s, d: language.found(read(s, d, "documents"), _weights(read(s, d, "documents"))),
        "p9_languages": _languages,
        "p8_at_targets": lambda s, d: mixing.mix(read(s, d, "documents"), read(s, d, "mix_targets"), fill=False)[0],
        "p8_report": lambda s, d: mixing.report(read(s, d, "documents"), read(s, d, "mix_targets")),
    }


_WS = "' ' || chr(9) || chr(10) || chr(13)"

# Tokens become single letters by rank (few distinct ones at this size), so that DuckDB's levenshtein counts tokens.
_OVERLAP = rf"""
r as (
  select record_id, lower(trim(task, {_WS})) as task, lower(trim(split, {_WS})) as split, lower(trim(source, {_WS})) as source, canon_index,
         regexp_extract_all(trim(smiles, {_WS}), '\[[^\]]+\]|%[0-9][0-9]|Br|Cl|[BCNOSPFIbcnosp().=#\-+\\/:~@?>*$0-9]') as t
  from dataset),
letters as (select token, chr((row_number() over (order by token))::int) as ch from (select distinct unnest(t) as token from r)),
spelt as (
  select record_id, string_agg(ch, '' order by i) as s from (select record_id, unnest(t) as token, generate_subscripts(t, 1) as i from r) join letters using (token) group by record_id),
x as (select r.*, s from r left join spelt using (record_id)),
pairs as (
  select a.record_id as tr, b.record_id as ev, b.split, b.source from x a join x b on a.task = b.task and a.split = 'train' and b.split in ('test', 'valid')
  where a.canon_index = b.canon_index or (abs(length(a.s) - length(b.s)) <= 3 and levenshtein(a.s, b.s) <= 3))
"""

_TERMS = f"""
latest as (select * from (select *, row_number() over (partition by run_id, feature order by written_at desc) as v from token_preference) where v = 1),
flat as (
  select rec, trim(term, {_WS}) as token, coalesce(n, 0) as n, ratio
  from (select row_number() over () as rec, token, "token_Count" as c, "token_Global_Ratio" as g from latest) q,
       lateral (select unnest(q.token) as term, unnest(q.c[1:len(q.token)]) as n, unnest(q.g[1:len(q.token)]) as ratio) where trim(term, {_WS}) <> ''),
counted as (
  select token, sum(n)::bigint as total, count(distinct rec) as records, min(ratio) filter (not isnan(ratio)) as lowest, max(ratio) filter (not isnan(ratio)) as highest from flat group by token),
marked as (
  select *, case when records < 3 or total < 5 then 'rare' when records * 2 > (select count(distinct rec) from flat) then 'common' end as mark from counted)
"""


def _percentile_sql(table: str, group: str, value: str) -> str:
    names = {0.01: "p01", 0.25: "p25", 0.5: "p50", 0.75: "p75", 0.95: "p95", 0.99: "p99"}
    return f"""with v as (select "{group}" as g, {value}::double as v from {table} where {value} is not null and not isnan({value}::double) and {value} > 0 and {value}::double < 'inf'::double and "{group}" is not null),
        q as (select g, floor(v / pow(2.0::double, floor(log2(v)) - 10)) * pow(2.0::double, floor(log2(v)) - 10) as v from v)
        select g as "{group}", count(*) as n, {", ".join(f"quantile_disc(v, {p}) as {c}" for p, c in names.items())} from q group by g"""


def oracle_sql() -> dict[str, str]:
    activations = _percentile_sql("activations", "feature", "data")
    return {
        "p2_found": f"with {_OVERLAP} select distinct least(tr, ev) as record_a, greatest(tr, ev) as record_b from pairs",
        "p2_by_source": f"with {_OVERLAP} select split, source, count(*) as pairs, count(distinct ev) as records from (select distinct * from pairs) group by split, source",
        "p2_containment": f"""with {_OVERLAP},
            k as (select task, split = 'train' as tr, s, t, min(record_id) as id from x where split in ('train', 'test', 'valid') and task is not null and s is not null group by all),
            g as (select id, tr, list_distinct([array_to_string(t[i:i + 4], ' ') for i in range(1, greatest(1, len(t) - 4) + 1)]) as g from k)
            select a.task, a.id as train_record, b.id as eval_record, round(len(list_intersect(h.g, f.g)) / len(h.g), 6) as containment, levenshtein(a.s, b.s)::int as distance
            from k a join k b on a.task = b.task and a.tr and not b.tr and abs(length(a.s) - length(b.s)) <= 3 and levenshtein(a.s, b.s) <= 3
            join g f on f.id = a.id and f.tr join g h on h.id = b.id and not h.tr""",
        "p4_found": f"with {_TERMS} select token, mark from marked where mark is not null",
        "p4_terms": f"with {_TERMS} select token, total, records, lowest, highest, mark from marked",
        "p5_found": """with b as (select "conceptIdx", "featureIdx", max("f1Score") as s from metrics where "f1Score" > 0 and "f1Score" <= 1 and not isnan("f1Score") and "conceptIdx" is not null and "featureIdx" is not null group by all)
            select "conceptIdx", "featureIdx" from b qualify row_number() over (partition by "conceptIdx" order by s desc, "featureIdx") <= 10""",
        "p5_hot_groups": """with b as (select "conceptIdx", "featureIdx", max("f1Score") as s from metrics where "f1Score" > 0 and "f1Score" <= 1 and not isnan("f1Score") and "conceptIdx" is not null and "featureIdx" is not null group by all)
            select "conceptIdx", "featureIdx", s as "f1Score", (row_number() over (partition by "conceptIdx" order by s desc, "featureIdx"))::int as rank from b qualify rank <= 10""",
        "p6_percentiles": activations,
        "p6_daily_combined": activations,
        "p6_molptr": _percentile_sql("samples", "chunk", "molptr"),
    }
