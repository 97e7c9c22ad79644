"""Queries of the activation analytics, over whole tables, with SQL for the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.common import read
from actlens.functions import smiles as S
from actlens.operators import concepts as C
from actlens.operators import molecules as M
from actlens.operators import probe as P
from actlens.operators import profile as L
from actlens.operators import sae
from actlens.plans import association, structure_sql
from actlens.sources import tables as T

LATENTS, K, THRESHOLDS, BINS = 3072, 64, [0.0, 0.5, 1.5], [(0.0, 0.5), (0.5, 1.0), (1.0, 2.0), (2.0, 4.0), (4.0, 1e300)]
SAE_LATENTS, SAE_K = 128, 8
ABLATED = {3: 0.0, 17: -1.0, 40: 5.0}


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _features(s: SparkSession) -> DataFrame:
    return s.range(LATENTS).select(F.col("id").cast("int").alias("feature"))


class _In:
    """The canonical tables of a folder."""

    def __init__(self, s: SparkSession, d: str):
        self.s, self.d = s, d
        self.samples, self.acts, self.by_token = T.samples(s, d), T.acts(s, d), T.acts(s, d, by=("sample_idx", "token_idx"))
        self.tokens, self.labels, self.concepts = T.tokens(self.samples), T.label_tokens(s, d), T.concepts(s, d)


def _reference_pairs(t: _In) -> tuple[DataFrame, DataFrame]:
    """The first sample of each string is the reference, its repetitions are variants; a variant's group is its chunk's parity."""
    first = t.samples.where("smiles <> ''").groupBy("smiles").agg(F.min("sample_idx").alias("ref_idx"))
    variants = t.samples.join(first, "smiles").where("sample_idx <> ref_idx").select(F.col("sample_idx").alias("alt_idx"), "ref_idx", F.pmod("chunk", F.lit(2)).cast("int").alias("grp")).where("grp is not null")
    return variants, first.select("ref_idx")


def _hidden(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def _weights() -> dict:
    return sae.sine_weights(64, SAE_LATENTS)


def _exploded(df: DataFrame) -> DataFrame:
    return _round(df.select("vec_id", F.posexplode("vec").alias("dim", "x")))


def _normalized(s: SparkSession, d: str) -> DataFrame:
    """(feature, dead, enc_sum, dec_sum) of the weights scaled by each latent's greatest pre-activation over the table."""
    top = {r.feature: r.max_value for r in sae.pre_max(_hidden(s, d), "vec", _weights()).collect()}  # one number per latent
    w, dead = sae.normalized(_weights(), top)
    rows = [(i, i in dead, float(w["w_enc"][:, i].sum()), float(w["w_dec"][i].sum())) for i in range(SAE_LATENTS)]
    return _round(s.createDataFrame(rows, "feature int, dead boolean, enc_sum double, dec_sum double"))


def _probe_rows(s: SparkSession, d: str) -> DataFrame:
    return P.probe_rows(read(s, d, "dataset"), read(s, d, "probe_features"))


def _scores(kind: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = _probe_rows(s, d).where(F.col("task_type") == kind)
        fit = P.logistic if kind == "cls" else P.ridge
        scored = P.predict(rows.where("split = 'test'"), fit(rows.where("split <> 'test'"), ["task"]), ["task"])
        return _round(P.classification_metrics(scored) if kind == "cls" else P.regression_metrics(scored), 4)

    return run


def _fixed(kind: str):
    """The metrics of a given linear form: the weight of feature j is sin(j) for j from 1, the intercept 0.5."""

    def run(s: SparkSession, d: str) -> DataFrame:
        w = F.array(F.lit(0.5), *(F.sin(F.lit(float(j))) for j in range(1, 13)))
        rows = _probe_rows(s, d).where(F.col("task_type") == kind)
        fitted = rows.select("task").distinct().withColumn("w", w)
        scored = P.predict(rows, fitted, ["task"]).withColumn("score", F.round("score", 6))  # rounded, so that ties are ties in any engine
        return _round(P.classification_metrics(scored) if kind == "cls" else P.regression_metrics(scored), 5)

    return run


FOLDED = 16


def _feature_sets(s: SparkSession, d: str) -> DataFrame:
    """(canon_index, path, x): the chemistry features of parsable molecules, and mean and maximum over tokens of the activations, latents folded to 16."""
    t = _In(s, d)
    pcds = read(s, d, "probe_features").where("isSmilesRDKitParsable = 1 and canon_index is not null").select("canon_index", F.lit("PcDs").alias("path"), F.transform("pcds", lambda v: v.cast("double")).alias("x"))
    fired = L.fired(t.acts.where("value < 1e6"), t.samples).withColumn("slot", F.pmod("feature", F.lit(FOLDED)))  # failed measurements would be the only feature that counts
    slots = fired.groupBy("sample_idx", "slot").agg(F.sum("mean_value").alias("mean"), F.max("max_value").alias("max"))
    out = pcds
    for pooling in ("mean", "max"):
        cell = lambda i: F.coalesce(F.sum(F.when(F.col("slot") == i, F.col(pooling))), F.lit(0.0))  # noqa: B023, E731
        x = slots.groupBy(F.col("sample_idx").alias("canon_index")).agg(F.array(*(cell(i) for i in range(FOLDED))).alias("x"))
        out = out.unionByName(x.select("canon_index", F.lit(f"SAE/{pooling}/1").alias("path"), "x"))
    return out


def _sweep_rows(s: SparkSession, d: str) -> DataFrame:
    return P.sweep_rows(P.labelled(read(s, d, "dataset"), strict=True), _feature_sets(s, d))


def _coefficients(s: SparkSession, d: str) -> DataFrame:
    fits = P.sweep(_sweep_rows(s, d))[1].withColumn("coef", F.slice("w", 2, F.size("w")))
    return _round(P.replicate_scores(fits, ["task", "method", "layer"], "rep", "coef"), 3)


def _token_rows(s: SparkSession, d: str) -> DataFrame:
    """Vectors as tokens of samples of four, decoded vectors as their reconstruction, and both as logits of the label."""
    recons = sae.reconstruct(_hidden(s, d), ["vec_id"], "vec", _weights(), SAE_K).select("vec_id", F.col("vec").alias("recons"))
    rows = _hidden(s, d).where("vec is not null").withColumnRenamed("vec", "x").join(recons, "vec_id")
    return rows.select("vec_id", F.floor(F.col("vec_id") / 4).alias("sample"), "x", "recons", F.col("x").alias("logits"), F.col("recons").alias("recons_logits"), F.col("label").alias("token"))


def _losses(s: SparkSession, d: str) -> DataFrame:
    rows, x = _token_rows(s, d), F.col("x")
    ce = lambda c: sae.cross_entropy(F.col(c), F.col("token"))
    tenth = F.transform(x, lambda v: v / 10)
    return _round(rows.select("vec_id", sae.mean_square(x, F.col("recons")).alias("mse"), sae.aux_loss(x, F.col("recons"), tenth).alias("aux"), ce("logits").alias("ce"), ce("recons_logits").alias("recons_ce")))


def _packed(t: _In) -> DataFrame:
    """The lists as text: concept:match|match;..., a match as its tokens with hyphens."""
    match = lambda m: F.array_join(m, "-")
    concept = lambda c: F.concat(c["concept_idx"].cast("string"), F.lit(":"), F.array_join(F.transform(c["matches"], match), "|"))
    return C.packed(t.labels).select("sample_idx", F.array_join(F.transform("concepts", concept), ";").alias("concepts"))


def _zscores(s: SparkSession, d: str) -> DataFrame:
    """Over the latest version of each (run_id, feature); of equally late ones the greater list."""
    latest = read(s, d, "token_preference").groupBy("feature", "run_id").agg(F.max_by("token_Global_Ratio", F.struct("written_at", "token_Global_Ratio")).alias("v"))
    return _round(P.replicate_scores(latest.where("run_id is not null and feature is not null and size(v) > 1"), ["feature"], "run_id", "v"))


def _on(query):
    return lambda s, d: query(_In(s, d))


def _fpc_rows(t: _In) -> DataFrame:
    return association.prefilter(t.acts, t.samples, t.labels, K)


def _cm(t: _In, sub: bool = False, k: int | None = None) -> DataFrame:
    """k: over the k latents of each concept only."""
    return association.chosen_confusion(t.acts, t.samples, t.labels, THRESHOLDS, k, sub) if k else C.confusion(t.acts, t.samples, t.labels, THRESHOLDS, None, sub)


def _on_acts() -> dict:
    """Queries of the canonical tables."""
    return {
        "latent_density": lambda t: _round(L.density(t.acts, t.samples, _features(t.s))),
        "latent_pooling": lambda t: _round(L.fired(t.acts, t.samples), 3),
        "bin_map": lambda t: L.bin_map(t.acts, BINS),
        "token_preference": lambda t: _round(L.token_preference(t.by_token, t.tokens)),
        "token_preference_inverse": lambda t: L.token_preference_inverse(t.by_token, t.tokens),
        "token_inverse_samples": lambda t: L.inverse_samples(t.by_token, t.tokens),
        "token_preference_summary": lambda t: _round(L.preference_summary(t.by_token, t.tokens), 10),
        "token_role_preference": lambda t: L.role_counts(t.by_token, t.tokens),
        "token_role_summary": lambda t: _round(L.preference_summary(t.by_token, t.tokens, by_role=True), 10),
        "positional_latents": lambda t: _round(L.positional(t.acts, t.samples)),
        "dead_latents": lambda t: L.dead(t.acts, _features(t.s)),
        "latent_max": lambda t: _round(L.latent_max(t.acts)),
        "act_histogram": lambda t: L.histogram(t.by_token, t.tokens, 0.25, 40),
        "smd_token": lambda t: _round(C.concept_smd(t.acts, t.samples, t.labels)),
        "smd_pooled": lambda t: _round(C.concept_smd(t.acts, t.samples, t.labels, pooled=True)),
        "repr_smd": lambda t: _round(C.representation_smd(t.acts, *_reference_pairs(t), _features(t.s))),
        "cm_all": _cm,
        "cm_substructure": lambda t: _cm(t, True),
        "concept_f1": lambda t: C.scores(_cm(t)),
        "substructure_f1": lambda t: C.scores(_cm(t, True), substructure=True),
        "concept_association": lambda t: association.associate(t.acts, t.samples, t.labels, t.concepts, THRESHOLDS, K),
        "best_latents": lambda t: association.best_latents(C.scores(_cm(t))),
        "topk_activation": lambda t: _round(sae.top_k_rows(t.acts, ["sample_idx", "token_idx"], 2)),
        "act_distribution": lambda t: _round(L.distribution(t.by_token, t.tokens, None, "^[cn]$", t.labels)),
        "fpc_topk": _fpc_rows,
        "cm_fpc": lambda t: _cm(t, k=K),
        "cm_substructure_fpc": lambda t: _cm(t, True, K),
    }


def queries() -> dict:
    return {
        **{name: _on(q) for name, q in _on_acts().items()},
        **{f"{name}_whole": _on(q) for name, q in _on_acts().items()},  # earlier names of the same queries
        "concept_labels": _on(lambda t: t.labels),
        "sampled_labels": _on(lambda t: C.sampled(t.labels, 0.2)),
        "labelled_counts": _on(lambda t: C.counts(t.labels)),
        "packed_labels": _on(_packed),
        "dense_pooling": lambda s, d: _round(L.pooled_vectors(_hidden(s, d).where("label is not null"), "label", "vec")),
        "pre_activation_max": lambda s, d: _round(sae.pre_max(_hidden(s, d), "vec", _weights())),
        "sae_losses": _losses,
        "validation_means": lambda s, d: _round(sae.validation(_token_rows(s, d), "sample", 32)),
        "layer_norm": lambda s, d: _exploded(_hidden(s, d).select("vec_id", sae.normed(F.col("vec")).alias("vec"))),
        "sae_encode": lambda s, d: _round(sae.encode(_hidden(s, d), ["vec_id"], "vec", _weights(), SAE_K)),
        "sae_decode": lambda s, d: _exploded(sae.reconstruct(_hidden(s, d), ["vec_id"], "vec", _weights(), SAE_K)),
        "sae_reconstruction_mse": lambda s, d: _round(sae.reconstruct(_hidden(s, d), ["vec_id"], "vec", _weights(), SAE_K).select("vec_id", "mse")),
        "ablate_latent": lambda s, d: _exploded(sae.reconstruct(_hidden(s, d), ["vec_id"], "vec", _weights(), SAE_K, ABLATED)),
        "normalized_weights": _normalized,
        "smiles_tokens": _on(lambda t: M.token_rows(t.samples)),
        "atom_token_map": _on(lambda t: M.atom_map(t.samples)),
        "mask_enum": _on(lambda t: M.mask_enum(t.samples)),
        "syntax_pairs": _on(lambda t: M.syntax_pairs(t.samples)),
        "branch_list": _on(lambda t: M.branches(t.samples).withColumns({c: F.array_join(c, ",") for c in ("tokens", "atoms")})),
        "bond_atom_pairs": _on(lambda t: M.bond_atoms(t.samples)),
        "pattern_labels": _on(lambda t: M.pattern_labels(t.samples, {"aromatic": r"^[a-z]$", "charged": r"^\[.*[+-].*\]$", "halogen": r"^(?:F|I|Br|Cl)$"})),
        "corrupt_smiles": _on(lambda t: M.corrupt(t.samples)),
        "probe_zscore": _zscores,
        "probe_logistic": _scores("cls"),
        "probe_ridge": _scores("reg"),
        "probe_fixed_cls": _fixed("cls"),
        "probe_fixed_reg": _fixed("reg"),
        "probe_sweep_cells": lambda s, d: _sweep_rows(s, d).groupBy("task", "method", "layer", "rep", "part").agg(F.count("*").alias("n"), F.sum("fold").alias("folds")),
        "probe_sweep": lambda s, d: _round(P.sweep(_sweep_rows(s, d))[0], 3),
        "probe_coefficients": _coefficients,
        "split_dataset": lambda s, d: P.split_rows(read(s, d, "dataset").select("record_id"), "record_id", 0.8),
    }


_WS = "' ' || chr(9) || chr(10) || chr(13)"
_TOK = r"\[[^\]]+\]|%[0-9][0-9]|Br|Cl|[BCNOSPFIbcnosp().=#\-+\\/:~@?>*$0-9]"

_BASE = rf"""
sm as (select sample_idx as s, trim(smiles, {_WS}) as smi, molptr, chunk from samples where sample_idx is not null),
samp as (select s, smi, chunk, (case when molptr between 1 and 32767 then molptr else coalesce(len(regexp_extract_all(smi, '{_TOK}')), 0) end)::int as n from sm),
tok as (select s, (generate_subscripts(x, 1) - 1)::int as t, unnest(x) as token from (select s, regexp_extract_all(smi, '{_TOK}') as x from samp)),
a as (
  select sample_idx as s, feature as f, token_idx as t, max(data::double) as v from activations
  where data > 0 and isfinite(data) and sample_idx is not null and token_idx is not null and feature is not null group by all),
ft as (select a.s, a.f, a.t, a.v, tok.token from a join tok on a.s = tok.s and a.t = tok.t),
dim as (select range::int as f from range({LATENTS})),
el as (select smiles as s, lower(trim(concept, {_WS})) as name, unnest(token_idxs) as m from eval_data where smiles is not null),
lm as (select distinct s, concept_idx as c, list_sort(list_distinct(list_filter(m, lambda x: x is not null))) as m
       from el join concepts k on el.name = lower(trim(k.concept, {_WS})) where len(list_filter(m, lambda x: x is not null)) > 0),
lab as (select s, c, (row_number() over (partition by s, c order by m) - 1)::int as i, unnest(m) as t from lm),
sp as (select distinct s, c, t from lab),
thr as (select unnest([0.0::double, 0.5::double, 1.5::double]) as thr)
"""
_ROLE = r"case when token in ('(', ')') then 'Branch' when regexp_full_match(token, '%[0-9][0-9]|[0-9]') then 'Ring' when regexp_full_match(token, '[\-=#$\\/]') then 'Bond' when token = '.' then 'Disconnection' else 'Atom' end"

_SMD = """
nn as (select s, n::bigint as n from samp),
wd as (select sp.s, c, count(*) as w from sp join nn using (s) group by all),
ps as (select s, f, sum(v) as x, sum(v * v) as xx from a group by all),
tot as (select c, f, sum(x) as x, sum(xx) as xx from wd join ps using (s) group by all),
pos as (select c, f, sum(v) as x, sum(v * v) as xx from a join sp using (s, t) group by all),
cnt as (select c, sum(w)::double as cp, sum(n - w)::double as cn from wd join nn using (s) group by c),
smd as (
  select c, f, case when cp > 0 and cn > 0 then
    (coalesce(p.x, 0) / cp - (t.x - coalesce(p.x, 0)) / cn)
    / (sqrt(greatest(0, (coalesce(p.xx, 0) / cp - pow(coalesce(p.x, 0) / cp, 2) + (t.xx - coalesce(p.xx, 0)) / cn - pow((t.x - coalesce(p.x, 0)) / cn, 2)) / 2)) + 1e-6::double)
    else 'nan'::double end as smd
  from tot t left join pos p using (c, f) join cnt using (c)),
"""


def _fpc(k: int) -> str:
    return f"""fpc as (select c, f, (row_number() over (partition by c order by f) - 1)::int as key from (
        select c, f from smd where not isnan(smd) and smd > 0 qualify row_number() over (partition by c order by smd desc, f) <= {k}))"""


_FIRE = """
fire as (select s, f, thr, (count(*) filter (v > thr))::bigint as pp from a cross join thr group by all),
pr as (select s, c, count(*) as np from sp group by all),
tpos as (select c, f, thr, (count(*) filter (v > thr))::bigint as tp from a join sp using (s, t) join samp using (s) cross join thr group by all),
"""
_SUB = """
mw as (select s, c, i, count(distinct t) as w from lab group by all),
hit as (select s, c, i, f, thr, count(*) filter (v > thr) as h from a join (select distinct * from lab) using (s, t) cross join thr group by all),
sub as (select c, f, thr, (count(*) filter (h = w))::bigint as tp_sub from hit join mw using (s, c, i) group by all),
ns as (select c, count(*) as n_sub from mw group by c),
"""
_CM = """cm as (select c, f, thr, coalesce(tp, 0)::bigint as tp, (np - coalesce(tp, 0))::bigint as fn, (pp - coalesce(tp, 0))::bigint as fp, (n - np - pp + coalesce(tp, 0))::bigint as tn from g left join tpos using (c, f, thr))"""
_ALL = _FIRE + "g as (select c, f, thr, sum(np) as np, sum(pp) as pp, sum(n) as n from pr join samp using (s) join fire using (s) group by all)," + _CM
_GIVEN = (
    _FIRE.replace("from sp group by all", "from sp where c in (select c from fpc) group by all")
    + """un as (select distinct s from pr), nt as (select coalesce(sum(n), 0) as n from samp where s in (select s from un)),
pf as (select f, thr, sum(pp) as pp from fire where s in (select s from un) group by all),
nc as (select c, sum(np) as np from pr join samp using (s) group by c),
g as (select c, f, thr, coalesce(np, 0) as np, coalesce(pp, 0) as pp, n from fpc cross join thr left join nc using (c) left join pf using (f, thr) cross join nt),"""
    + _CM
)
_CM_OUT = 'select c as concept_idx, f as feature, thr as threshold, tp, fn, fp, tn from cm'
_CM_SUB_OUT = "select c as concept_idx, f as feature, thr as threshold, tp, fn, fp, tn, coalesce(tp_sub, 0)::bigint as tp_sub, n_sub::bigint as n_sub from cm left join sub using (c, f, thr) left join ns using (c)"


def _scored(recall: str, source: str, sub: str) -> str:
    return f"""sc as (select *, tp / (tp + fp + 1e-7::double) as p, {recall} as r from {source}),
    f1 as (select *, 2 * p * r / (p + r + 1e-7::double) as f1 from sc),
    met as (select c as "conceptIdx", f as "featureIdx", round(thr, 4) as threshold, tp as "tPos", fn as "fNeg", fp as "fPos", tn as "tNeg", round(p, 4) as "precision", round(r, 4) as recall, round(f1, 4) as "f1Score", {sub} as "tPosSub" from f1 where f1 > 0)"""


_F1 = _scored("tp / (tp + fn + 1e-7::double)", "cm", "0::bigint")

_SAE = """
h as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings where embedding is not null),
mom as (select vec_id, e, list_sum(e) / len(e) as mu from h),
cen as (select vec_id, e, mu, list_transform(e, lambda x: x - mu) as y from mom),
sd as (select vec_id, e, mu, y, sqrt(list_sum(list_transform(y, lambda x: x * x)) / (len(y) - 1)) as sd from cen),
ln as (select vec_id, e, mu, sd, list_transform(y, lambda x: x / (sd + 1e-5::double)) as z from sd),
zr as (select vec_id, (generate_subscripts(z, 1) - 1) as d, unnest(z) as z, unnest(e) as e, mu, sd from ln),
w as (select d.range as d, f.range::int as f, sin(0.1::double * (d.range * 64 + f.range)) as w from range(64) d, range(128) f),
pre as (select vec_id, f, sum(z * w) as v from zr join w using (d) group by all),
lat as (select vec_id, f, v from pre qualify row_number() over (partition by vec_id order by v desc, f) <= 8),
act as (select vec_id, f, v from lat where v > 0),
"""
_DEC = """
dec as (select zr.vec_id, zr.d, coalesce(sum(act.v * w.w), 0) * any_value(zr.sd) + any_value(zr.mu) as x, any_value(zr.e) as e
        from zr left join act using (vec_id) left join w on w.d = zr.d and w.f = act.f group by zr.vec_id, zr.d)
"""
_ABLATE = """
ab as (select h.vec_id, g.f, case g.f when 3 then 0.0::double when 17 then -1.0::double when 40 then 5.0::double else coalesce(a.v, 0) end as v
       from h cross join (select range::int as f from range(128)) g left join act a on a.vec_id = h.vec_id and a.f = g.f),
ab2 as (select vec_id, f, v from (select * from ab qualify row_number() over (partition by vec_id order by v desc, f) <= 8) where v > 0),
"""


_LOSSES = f"""{_SAE} {_DEC},
di as (select vec_id, avg((x - e) * (x - e)) as mse, avg(pow(e / 10 - (e - x), 2)) / 32 as aux, max(e) as me, max(x) as mx from dec group by vec_id),
so as (select vec_id, ln(sum(exp(e - me))) + any_value(me) as ze, ln(sum(exp(x - mx))) + any_value(mx) as zx from dec join di using (vec_id) group by vec_id),
lo as (select di.vec_id, mse, aux, ze - d.e as ce, zx - d.x as recons_ce from di join so using (vec_id) join embeddings m on m.vec_id = di.vec_id left join dec d on d.vec_id = di.vec_id and d.d = m.label)
"""
_FINITE = "list_bool_and(list_transform(pcds, lambda v: v is not null and not isnan(v)))"
_LABELLED = f"""l as (select canon_index, lower(trim(task, {_WS})) as task, trim(task_type) as task_type, y from dataset where isfinite(y) and task is not null and split is not null)"""
_PROBE = f"""{_LABELLED},
x as (select canon_index, list_transform(pcds, lambda v: v::double) as x from probe_features where "isSmilesRDKitParsable" = 1 and canon_index is not null and {_FINITE}),
f as (select task, task_type, y, round(0.5 + {" + ".join(f"x[{j}] * sin({j}.0::double)" for j in range(1, 13))}, 6) as score from l join x using (canon_index))"""


def _unit(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8))::bigint / 4294967296.0::double)"


def _mean_rank(of: str) -> str:
    return f"(rank() over (partition by task order by {of}) + (count(*) over (partition by task, {of}) - 1) / 2.0)"


def _oracle_sql() -> dict[str, str]:
    fired = "select s, f, count(*) as k, n, max(v) as mx, sum(v) / n as me, sum(v * v) / n as ms from a join samp using (s) where n > 0 group by s, f, n"
    pref = "select f, token, count(*) as n from ft group by all"
    summary = lambda kind: f"""with {_BASE}, c as (select f, {kind} as kind, count(*) as n from ft group by all),
        p as (select f, n / sum(n) over (partition by f) as p from c), m as (select f, count(distinct s) as n_mol from ft group by f)
        select f as feature, count(*) as classes, round(sum(p * p), 10) as simpson_d, round(case when count(*) > 1 then 1 - (-sum(p * ln(p))) / ln(count(*)) else 0 end, 10) + 0.0::double as pielou, any_value(n_mol) as n_mol
        from p join m using (f) group by f"""  # noqa: E731
    return {
        "latent_density": f"""with {_BASE}, d as (select f, k / n as d from ({fired})), q as (select f, count(*) as n, min(d) as mi, quantile_cont(d::double, 0.25) as q1, quantile_cont(d::double, 0.5) as q2,
            quantile_cont(d::double, 0.75) as q3, max(d) as ma, avg(d) as me, stddev_pop(d) as sd from d group by f)
            select dim.f as feature, n, round(mi, 6) as "min", round(q1, 6) as q1, round(q2, 6) as median, round(q3, 6) as q3, round(ma, 6) as "max", round(me, 6) as mean, round(sd, 6) as std from dim left join q using (f)""",
        "latent_pooling": f"with {_BASE} select s as sample_idx, f as feature, k as n_active, n as n_tokens, round(mx, 3) as max_value, round(me, 3) as mean_value, round(ms, 3) as mean_square from ({fired})",
        "bin_map": f"""with {_BASE}, b as (select s, f, bit_or(case when v < 0.5 then 1 when v < 1 then 2 when v < 2 then 4 when v < 4 then 8 when v < 1e300::double then 16 else 0 end)::int as bins from a group by all)
            select s as sample_idx, f as feature, bins from b where bins <> 0""",
        "token_preference": f"""with {_BASE}, c as ({pref}), g as (select token, count(*) as total from tok group by token)
            select f as feature, token, n, round(n / total, 6) as ratio, (row_number() over (partition by f order by n desc, token))::int as rank from c join g using (token)""",
        "token_preference_inverse": f"""with {_BASE}, c as ({pref}), g as (select token, count(*) as total from tok group by token)
            select x.f as feature, g.token, g.total - coalesce(c.n, 0) as n from (select distinct f from c) x cross join g left join c on c.f = x.f and c.token = g.token where g.total - coalesce(c.n, 0) > 0""",
        "token_inverse_samples": f"""with {_BASE}, z as (select s, count(*) as size from tok group by s), k as (select s, f, count(*) as n from ft group by all)
            select f as feature, (select count(*) from z) - count(*) filter (n = size) as n_mol from k join z using (s) group by f""",
        "token_preference_summary": summary("token"),
        "token_role_preference": f"with {_BASE} select f as feature, {_ROLE} as role, count(*) as n from ft group by all",
        "token_role_summary": summary(_ROLE),
        "positional_latents": f"""with {_BASE}, r as (select s, f, row_number() over (partition by s, f order by t) as rp, rank() over (partition by s, f order by v) + (count(*) over (partition by s, f, v) - 1) / 2.0 as rv from a),
            c as (select s, f, count(*)::double as m, sum((rp - rv) * (rp - rv))::double as dd from r group by all having count(*) >= 3),
            z as (select f, n, greatest(-0.99999::double, least(0.99999::double, 1 - 6 * dd / (m * (m * m - 1)))) as rho from c join samp using (s))
            select f as feature, count(*) as n, min(n) as length_min, round(quantile_cont(n::double, 0.5), 6) as length_median, max(n) as length_max, round(avg(n), 6) as length_mean,
                   round(tanh(avg(atanh(rho))), 6) as corr_mean from z group by f""",
        "dead_latents": f"with {_BASE} select f as feature from dim where f not in (select f from a)",
        "latent_max": f"with {_BASE} select f as feature, round(max(v), 6) as max_value from a group by f",
        "act_distribution": f"""with {_BASE}, l as (select distinct s, t from lab) select ft.f as feature, ft.s as sample_idx, ft.t as token_idx, round(v, 6) as value, token,
            case when l.s is not null then 'labelled' when regexp_full_match(token, '[cn]') then 'pattern' else 'other' end as "group" from ft left join l on l.s = ft.s and l.t = ft.t""",
        "act_histogram": f"with {_BASE} select {_ROLE} as role, least(39, floor(v / 0.25::double))::int as bucket, count(*) as n from ft group by all",
        "concept_labels": f"with {_BASE} select s as sample_idx, c as concept_idx, i as match_idx, t as token_idx from lab",
        "smd_token": f"with {_BASE}, {_SMD} last as (select 1) select c as concept_idx, f as feature, round(smd, 6) as smd from smd",
        "smd_pooled": f"""with {_BASE}, nn as (select s, n::bigint as n from samp),
            wd as (select s, c, i, count(distinct t) as w from lab join nn using (s) group by all), fi as (select s, c, w from wd where i = 0),
            ps as (select s, f, sum(v) as x, sum(v * v) as xx from a group by all),
            tot as (select c, f, sum(x) as x, sum(xx) as xx from fi join ps using (s) group by all),
            pos as (select c, f, sum(v / w) as px, sum(v * v / w) as pxx, coalesce(sum(v) filter (i = 0), 0) as ox, coalesce(sum(v * v) filter (i = 0), 0) as oxx from a join (select distinct * from lab) using (s, t) join wd using (s, c, i) group by all),
            np as (select c, count(*)::double as cp from wd group by c), nq as (select c, sum(n - w)::double as cn from fi join nn using (s) group by c)
            select c as concept_idx, f as feature, round(case when cp > 0 and cn > 0 then (coalesce(px, 0) / cp - (x - coalesce(ox, 0)) / cn)
              / (sqrt(greatest(0, (coalesce(pxx, 0) / cp - pow(coalesce(px, 0) / cp, 2) + (xx - coalesce(oxx, 0)) / cn - pow((x - coalesce(ox, 0)) / cn, 2)) / 2)) + 1e-6::double) else 'nan'::double end, 6) as smd
            from tot left join pos using (c, f) join np using (c) join nq using (c)""",
        "repr_smd": f"""with {_BASE}, fi as (select smi, min(s) as r from samp where smi <> '' group by smi), va as (select s, r, (chunk % 2)::int as g from samp join fi using (smi) where s <> r and chunk is not null),
            top as (select s, f, max(v) as x from a group by all), rm as (select r, f, x from top join fi on s = r), nv as (select r, g, count(*) as k from va group by all),
            av as (select r, g, f, sum(x) as x, sum(x * x) as xx from top join va using (s) group by all),
            dn as (select nv.g, dim.f, coalesce(av.x, 0) / k as ax, coalesce(av.xx, 0) / k as axx, coalesce(rm.x, 0) as rx from nv cross join dim left join av on av.r = nv.r and av.g = nv.g and av.f = dim.f left join rm on rm.r = nv.r and rm.f = dim.f),
            rs as (select dim.f, coalesce(sum(x), 0) / (select count(*) from fi) as m, coalesce(sum(x * x), 0) / (select count(*) from fi) as mm from dim left join rm using (f) group by dim.f),
            o as (select g, f, any_value(m) as m, any_value(mm) as mm, avg(ax) as am, avg(axx) as amm, count(*) filter (rx > ax) as hi, count(*) filter (ax > rx) as lo from dn join rs using (f) group by g, f),
            q as (select *, sqrt(greatest(0, (mm - m * m + amm - am * am) / 2)) as sd from o)
            select f as feature, g as grp, round(case when sd > 0 then (m - am) / sd when m > am then 'inf'::double when m < am then '-inf'::double else 'nan'::double end, 6) as smd, hi as ref_hi, lo as alt_hi from q""",
        "fpc_topk": f"with {_BASE}, {_SMD} {_fpc(K)} select c as concept_idx, f as feature, key from fpc",
        "cm_all": f"with {_BASE}, {_ALL} {_CM_OUT}",
        "cm_fpc": f"with {_BASE}, {_SMD} {_fpc(K)}, {_GIVEN} {_CM_OUT}",
        "cm_substructure": f"with {_BASE}, {_SUB} {_ALL} {_CM_SUB_OUT}",
        "cm_substructure_fpc": f"with {_BASE}, {_SUB} {_SMD} {_fpc(K)}, {_GIVEN} {_CM_SUB_OUT}",
        "concept_f1": f"with {_BASE}, {_ALL}, {_F1} select * from met",
        "substructure_f1": f"with {_BASE}, {_SUB} {_ALL}, cs as (select cm.*, coalesce(tp_sub, 0)::bigint as tp_sub, n_sub from cm left join sub using (c, f, thr) left join ns using (c)), {_scored('tp_sub / n_sub::double', 'cs', 'tp_sub')} select * from met",
        "concept_association": f"""with {_BASE}, {_SMD} {_fpc(K)}, {_GIVEN}, {_F1} select met.*, k.concept, k.description from met join concepts k on k.concept_idx = met."conceptIdx\"""",
        "best_latents": f"""with {_BASE}, {_ALL}, {_F1} select "conceptIdx", "featureIdx", threshold, "f1Score" from met qualify row_number() over (partition by "conceptIdx" order by "f1Score" desc, "featureIdx", threshold) = 1""",
        "layer_norm": f"with {_SAE} last as (select 1) select vec_id, d::int as dim, round(z, 6) as x from zr",
        "sae_encode": f"with {_SAE} last as (select 1) select vec_id, f as feature, round(v, 6) as value from act",
        "sae_decode": f"with {_SAE} {_DEC} select vec_id, d::int as dim, round(x, 6) as x from dec",
        "sae_reconstruction_mse": f"with {_SAE} {_DEC} select vec_id, round(avg((x - e) * (x - e)), 6) as mse from dec group by vec_id",
        "ablate_latent": f"with {_SAE} {_ABLATE} {_DEC.replace('act', 'ab2')} select vec_id, d::int as dim, round(x, 6) as x from dec",
        "normalized_weights": f"""with {_SAE} mx as (select f, max(v) as m from pre group by f), wf as (select f, sum(w) as s from w group by f)
            select f as feature, coalesce(m, 0) <= 0 as dead, round(case when m <> 0 then s / m else 0 end, 6) as enc_sum, round(coalesce(s * m, 0), 6) as dec_sum from wf left join mx using (f)""",
        "sampled_labels": f"""with {_BASE}, u as (select s, {_unit("s", "42")} as u from (select distinct s from lab)),
            k as (select s from u qualify row_number() over (order by u, s) <= floor(0.2::double * count(*) over ()))
            select s as sample_idx, c as concept_idx, i as match_idx, t as token_idx from lab where s in (select s from k)""",
        "labelled_counts": f"with {_BASE} select count(distinct s) as samples, count(distinct c) as concepts, count(distinct (s, c, i)) as matches from lab",
        "packed_labels": f"""with {_BASE}, m as (select s, c, i, string_agg(t::varchar, '-' order by t) as m from lab group by all), g as (select s, c, c || ':' || string_agg(m, '|' order by i) as g from m group by s, c)
            select s as sample_idx, string_agg(g, ';' order by c) as concepts from g group by s""",
        "dense_pooling": """with r as (select label, generate_subscripts(embedding, 1) - 1 as dim, unnest(embedding)::double as x from embeddings where label is not null)
            select label, dim::int as dim, round(avg(x), 6) as mean, round(max(x), 6) as "max" from r group by all""",
        "pre_activation_max": f"with {_SAE} last as (select 1) select f as feature, round(max(v), 6) as max_value from pre group by f",
        "sae_losses": f"""with {_LOSSES} select vec_id, round(mse, 6) as mse, round(aux, 6) as aux, round(ce, 6) as ce, round(recons_ce, 6) as recons_ce from lo""",
        "validation_means": f"""with {_LOSSES}, sa as (select floor(vec_id / 4) as s, avg(mse) as mse, avg(recons_ce) - avg(ce) as dce from lo group by 1), nu as (select *, row_number() over (order by s) - 1 as n from sa),
            ba as (select count(*) as n, avg(mse) as mse, avg(dce) as dce from nu group by n // 32)
            select sum(n)::bigint as n_samples, count(*) as n_batches, round(avg(mse), 6) as mse, round(avg(dce), 6) as diff_ce from ba""",
        "branch_list": f"with {_BASE}, {structure_sql.BRANCHES}",
        "bond_atom_pairs": f"with {_BASE}, {structure_sql.BONDS_SQL}",
        "corrupt_smiles": f"with {_BASE}, {structure_sql.CORRUPT}",
        "split_dataset": f"with u as (select record_id, {_unit('record_id', '0')} as u from dataset) select record_id, case when u < 0.8 then 'train' when u < 0.8::double + (1 - 0.8::double) / 2 then 'valid' else 'test' end as part from u",
        "probe_fixed_cls": f"""with {_PROBE}, r as (select *, {_mean_rank("score")} as r, (score > 0)::int as p from f where task_type = 'cls'),
            m as (select task, count(*) as n, sum(p * y) as tp, sum(p)::double as pp, sum(y) as pos, avg((p = y)::int) as acc, sum(r * y) as ry from r group by task)
            select task, n, round(acc, 5) as accuracy, round(coalesce(case when pp * (n - pp) * pos * (n - pos) > 0 then (n * tp - pp * pos) / sqrt(pp * (n - pp) * pos * (n - pos)) end, 0), 5) + 0.0::double as mcc,
                   round(case when pos * (n - pos) > 0 then (ry - pos * (pos + 1) / 2) / (pos * (n - pos)) end, 5) as roc_auc from m""",
        "probe_fixed_reg": f"""with {_PROBE}, r as (select *, {_mean_rank("score")} as a, {_mean_rank("y")} as b from f where task_type = 'reg')
            select task, count(*) as n, round(sqrt(avg((score - y) * (score - y))), 5) as rmse, round(corr(a, b), 5) as spearman from r group by task""",
        "probe_sweep_cells": f"""with {_BASE}, {_LABELLED}, fe as (select canon_index, 'PcDs' as method, null::int as layer from probe_features where "isSmilesRDKitParsable" = 1 and canon_index is not null and {_FINITE}
              union all select distinct s, unnest(['SAE (mean)', 'SAE (max)']), 1 from a join samp using (s) where v < 1e6 and n > 0),
            r as (select l.task, method, layer, rep::int as rep, case when {_unit("l.canon_index", "rep")} >= 0.8 then 'test' else 'train' end as part, floor(5 * {_unit("l.canon_index", "'fold'", "rep")}) as fold
                  from l join fe using (canon_index) cross join (select unnest([1, 2, 3]) as rep))
            select task, method, layer, rep, part, count(*) as n, sum(fold)::bigint as folds from r group by all""",
        "topk_activation": f"with {_BASE} select s as sample_idx, t as token_idx, f as feature, round(v, 6) as value from a qualify row_number() over (partition by s, t order by v desc, f) <= 2",
        "smiles_tokens": f"with {_BASE} select s as sample_idx, t as token_idx, token, {_ROLE} as role from tok",
        "atom_token_map": f"with {_BASE} select s as sample_idx, (row_number() over (partition by s order by t) - 1)::int as atom_idx, t as token_idx from tok where regexp_matches(token, '[a-zA-Z*]')",
        "mask_enum": f"""with {_BASE}, x as (select s, regexp_extract_all(smi, '{_TOK}') as x from samp)
            select tok.s as sample_idx, tok.t as token_idx, token, array_to_string(x[1:tok.t], '') || '[MASK]' || array_to_string(x[tok.t + 2:], '') as masked from tok join x using (s)""",
        "syntax_pairs": f"""with {_BASE}, b as (select s, t, token, sum(case token when '(' then 1 else -1 end) over (partition by s order by t) + (token = ')')::int as depth from tok where token in ('(', ')')),
            c as (select *, lead(token) over w as nt, lead(t) over w as nx from b where depth > 0 window w as (partition by s, depth order by t)),
            r as (select s, t, token, row_number() over w as n, lead(t) over w as nx from tok where regexp_full_match(token, '%[0-9][0-9]|[0-9]') window w as (partition by s, token order by t))
            select s as sample_idx, 'branch' as kind, '(' as token, t as open_idx, nx as close_idx from c where token = '(' and nt = ')'
            union all select s, 'ring', token, t, nx from r where n % 2 = 1 and nx is not null""",
        "pattern_labels": f"""with {_BASE}, p as (select unnest(['aromatic', 'charged', 'halogen']) as concept, unnest(['[a-z]', '\\[.*[+-].*\\]', 'F|I|Br|Cl']) as rx)
            select s as sample_idx, concept, t as token_idx from tok join p on regexp_full_match(token, rx)""",
        "probe_zscore": """with y as (select feature, run_id, "token_Global_Ratio" as v, len("token_Global_Ratio") as n from token_preference where run_id is not null and feature is not null
              qualify row_number() over (partition by feature, run_id order by written_at desc, "token_Global_Ratio" desc) = 1), r as (select * from y where v is not null),
            e as (select feature, run_id, n, generate_subscripts(v, 1) - 1 as idx, unnest(v) as v from r where n > 1),
            m as (select feature, run_id, avg(v) as mu, stddev_samp(v) as sd from e group by all),
            z as (select e.feature, idx, case when sd > 0 then (v - mu) / sd end as z from e join m using (feature, run_id)),
            g as (select feature, idx, avg(z) as mean, stddev_pop(z) as std from z group by all)
            select feature, idx::int as idx, round(mean, 6) as mean, round(std, 6) as std, (row_number() over (partition by feature order by mean desc nulls last, idx))::int as rank from g""",
    }


def oracle_sql() -> dict[str, str]:
    given = _oracle_sql()
    return given | {f"{name}_whole": given[name] for name in _on_acts()}
