"""SQL for the structure of molecule strings and for their corruption, one edit a kind; written against the common tables `samp` and `tok` of the analytics' SQL."""

from __future__ import annotations

from actlens.operators.molecules import BONDS, ERRORS, FOR_AROMATIC, MARKS

_RING = "'%[0-9][0-9]|[0-9]'"
_DEPTH = """
run as (select *, sum(case token when '(' then 1 when ')' then -1 else 0 end) over (partition by s order by t) as run from tok),
dp as (select s, t, token, (run - least(0, min(run) over (partition by s order by t)))::int as d from run),
br as (select s, t, token, case when token = '(' then d else lag(d, 1, 0) over (partition by s order by t) end as d from dp),
cl as (select s, d, t as o, c from (
    select s, d, t, token, lead(token) over w as nt, lead(t) over w as c from br where token in ('(', ')') and d > 0 window w as (partition by s, d order by t)) where token = '(' and nt = ')')
"""

BRANCHES = f"""{_DEPTH},
own as (select s, d, t, regexp_matches(token, '[a-zA-Z*]') as atom, token, last_value(case when token = '(' then t end ignore nulls) over (partition by s, d order by t rows unbounded preceding) as o from dp),
li as (select s, case when d > 0 then o end as o, string_agg(t::varchar, ',' order by t) as tokens, coalesce(string_agg(t::varchar, ',' order by t) filter (atom), '') as atoms from own where token not in ('(', ')') group by all),
every as (select s, 0 as d, 0 as o, max(t) as c, null::int as k from tok group by s union all select s, d, o, c, o from cl)
select every.s as sample_idx, d::int as depth, every.o::int as open_idx, c::int as close_idx, coalesce(tokens, '') as tokens, coalesce(atoms, '') as atoms
from every left join li on li.s = every.s and li.o is not distinct from every.k"""

BONDS_SQL = rf"""
am as (select *, case when regexp_matches(token, '[a-zA-Z*]') then t end as a, regexp_full_match(token, {_RING}) as ring from tok),
nb as (select *, last_value(a ignore nulls) over (partition by s order by t rows between unbounded preceding and 1 preceding) as l,
       first_value(a ignore nulls) over (partition by s order by t rows between 1 following and unbounded following) as nx, row_number() over (partition by s, token order by t) as nth from am),
op as (select *, lag(l) over (partition by s, token order by t) as opened from nb),
ne as (select *, lead(ring) over w as nring, lead(nth) over w as nnth, lead(opened) over w as nopened from op window w as (partition by s order by t))
select s as sample_idx, t as token_idx, token, l as left_idx, case when nring and nnth % 2 = 0 then nopened else nx end as right_idx from ne where regexp_full_match(token, '[\-=#$\\/]')"""


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values: str, u: str) -> str:
    return f"({values})[floor({u} * len({values}))::int + 1]"


def _at(ok: str) -> str:
    return f"list_filter(range(len(t)), lambda i: {ok.replace('$', 't[i + 1]')})"


def _splice(at: str, n: str, new: str) -> str:
    return f"array_to_string(t[1:{at}], '') || {new} || array_to_string(t[{at} + {n} + 1:], '')"


def corrupt(kinds: list[str]) -> str:
    u = [f"(('0x' || substr(md5(concat_ws('|', smi, 0, error, 0, {j})), 1, 8))::bigint / 4294967296.0)" for j in range(5)]
    name = lambda n: f"(case when {n} < 10 then ({n})::varchar else '%' || ({n})::varchar end)"
    number = "replace(ring, '%', '')::int"
    near = f"case when {number} = 1 then '2' else {name(f'({number} + case when u4 < 0.5 then -1 else 1 end)')} end"
    k = "list_position(more, ring)"
    back = f"case when u3 < 0.25 then {near} when u3 < 0.5 then {_pick(f'more[1:{k} - 1] || more[{k} + 1:]', 'u4')} else '' end"
    bond, mark, c_or_n = _pick(_list(BONDS), "u2"), _pick(_list(MARKS), "u2"), _pick("['c', 'n']", "u2")
    rings = f"""case when u0 < 0.8 and len(rings) > 0 then case when u0 < 0.6 then {_splice('at2', '1', f'({back})')} else {_splice('odd2', '0', 'ring')} end
        else {_splice('floor(u1 * len(t))::int', '1', _pick('more', 'u2'))} end"""
    swap = "array_to_string(list_transform(range(len(t)), lambda i: case when i = o1 then ')' when i = c2 then '(' else t[i + 1] end), '')"
    paren = f"""case when u0 < 0.2 then {_splice('(floor(u1 * len(t))::int + 1)', '0', _pick("['(', ')']", 'u2'))}
        when u0 < 0.4 then {_splice(_pick('parens', 'u1'), '1', "''")} when u0 < 0.6 then case when o1 is not null and c2 is not null then {swap} end
        when u0 < 0.8 then {_splice('o1', '1', "')'")} else {_splice(_pick('closes', 'u1'), '1', "'('")} end"""
    arom = f"""case when u0 < 0.2 then {_splice('plain1', '1', 'lower(t[plain1 + 1])')} when u0 < 0.4 then {_splice('one1', '1', _pick(_list([''.join(x) for x in FOR_AROMATIC]), 'u2'))}
        when u0 < 0.6 then {_splice('(lower1 + floor(u3 * 2)::int)', '0', c_or_n)} when u0 < 0.8 then {_splice('two1', '1', c_or_n)} else {_splice('one1', '1', "''")} end"""
    rest = "(t[1:pair.o + 1] || t[pair.c + 1:])"
    filler = f"case when u2 < 0.5 then {_pick(f'{_list(BONDS)} || list_filter({rest}, lambda x: regexp_full_match(x, {_RING}))', 'u3')} else '' end"
    after = "(case when nearp is not null and t[nearp + 1] = '(' and u1 >= 0.5 then nearp + 1 else 0 end)"
    syntax = f"""case when u0 < 0.1 then {mark} || array_to_string(t, '') when u0 < 0.2 then array_to_string(t, '') || {mark}
        when u0 < 0.3 then {_splice('(bond1 + floor(u3 * 2)::int)', '0', bond)} when u0 < 0.4 then {_splice('ropen1', '0', bond)}
        when u0 < 0.6 then {_splice('o1', '0', f"(case when u0 < 0.5 then {bond} else '(' end)")}
        when u0 < 0.8 then case when first1 >= 0 and (len(t) - first1 + {after}) / len(t)::double >= 0.25 then {_splice(after, f'(first1 - {after})', "''")} end
        else {_splice('(pair.o + 1)', '(pair.c - pair.o - 1)', f'({filler})')} end"""
    valence = f"case when t[v1 + 1] = '=' then {_splice('v1', '1', chr(39) + '#' + chr(39))} else {_splice('v1', '0', _pick(_list(['=', '#']), 'u2'))} end"
    by = {"rings": rings, "parentheses": paren, "aromaticity": arom, "syntax": syntax, "valence": valence}
    follow = r"t[i + 1] in ('C', 'N', 'O', 'S', 'P') and regexp_full_match(coalesce(t[i + 2], ''), '=|[BCNOSPFI]|Br|Cl')"
    return f"""{_DEPTH},
cp as (select s, list({{'o': o::int, 'c': c::int}} order by c) as pairs from cl group by s),
x as (select samp.s, smi, regexp_extract_all(smi, '{TOKENS}') as t, coalesce(pairs, []) as pairs from samp left join cp using (s)),
e as (select x.*, error from x cross join (select unnest({_list(kinds)}) as error) where len(t) > 0),
d as (select *, {", ".join(f"{v} as u{j}" for j, v in enumerate(u))} from e),
p as (select *, list_sort(list_distinct(list_filter(t, lambda x: regexp_full_match(x, {_RING})))) as rings, {_at("$ = '('")} as opens, {_at("$ = ')'")} as closes, {_at("$ in ('(', ')')")} as parens,
      list_position(t, '1') - 1 as first1, {_at(f"regexp_full_match($, {_RING})")} as ringat, {_at("$ in ('C', 'N', 'O', 'S', 'P', 'B')")} as plain, {_at("$ in ('c', 'n')")} as one, {_at("$ in ('[nH]', 'o', 's')")} as two,
      {_at("regexp_matches($, '[a-z]') and not regexp_matches($, '[A-Z]')")} as lowers, {_at("$ in ('-', '=', '#')")} as bonds, {_at(follow)} as follows from d),
q as (select *, {_pick('rings', 'u1')} as ring, rings || [{name('(len(rings) + 1)')}] as more, {_pick('opens', 'u1')} as o1, {_pick('closes', 'u2')} as c2, {_pick('plain', 'u1')} as plain1, {_pick('one', 'u1')} as one1,
      {_pick('two', 'u1')} as two1, {_pick('lowers', 'u1')} as lower1, {_pick('bonds', 'u1')} as bond1, {_pick('follows', 'u1')} + 1 as v1, {_pick('pairs', 'u1')} as pair,
      list_filter(ringat, lambda i: len(list_filter(t[1:i], lambda y: y = t[i + 1])) % 2 = 0) as ropens, list_last(list_filter(parens, lambda i: i < coalesce(first1, -1))) as nearp from p),
r as (select *, {_at('$ = ring')} as own, {_pick('ropens', 'u1')} as ropen1 from q),
z as (select *, {_pick('own', 'u2')} as at2, {_pick('list_filter(own, lambda y, i: i % 2 = 1)', 'u2')} as odd2 from r)
select s as sample_idx, error, coalesce(case error {" ".join(f"when '{k}' then {by[k]}" for k in kinds)} end, array_to_string(t, '')) as error_smiles from z"""


TOKENS = r"\[[^\]]+\]|%[0-9][0-9]|Br|Cl|[BCNOSPFIbcnosp().=#\-+\\/:~@?>*$0-9]"
CORRUPT = corrupt(ERRORS)
