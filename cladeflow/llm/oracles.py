"""DuckDB SQL of the operators whose full result SQL can express."""

from __future__ import annotations

from cladeflow.llm import secret_scan

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _secrets() -> str:
    """Matches and the gaps between them alternate; their lengths place each match."""
    rules = [("assign", 0, secret_scan.ASSIGN), ("access", 1, secret_scan.ACCESS), ("hex", 2, secret_scan.HEX)]
    issued = "|".join(secret_scan.ISSUED.values())
    parts = [f"select id, t, '{k}' kind, {o} ord, regexp_extract_all(t, {_quoted(p)}) m, string_split_regex(t, {_quoted(p)}) g from d" for k, o, p in [*rules, ("issued", 3, issued)]]
    named = " ".join(f"when starts_with(v, '{secret_scan.PREFIX[k]}') then '{k}'" for k in secret_scan.ISSUED)
    ords = " ".join(f"when '{k}' then {3 + i}" for i, k in enumerate(secret_scan.ISSUED))
    return f"""
with d as (select row_number() over () id, doc_id, coalesce(text, '') t from documents),
found as ({" union all ".join(parts)}),
each_ as (select id, kind, ord, m, g, unnest(range(1, len(m) + 1)) i from found),
at_ as (select id, kind, ord, m[i] v, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) s from each_),
named as (select id, case when kind <> 'issued' then kind {named} end kind, ord, s, s + length(v) e, v from at_),
spans as (select id, kind, case kind {ords} else ord end ord, s, e from named
          where kind <> 'assign' or length(regexp_extract(v, {_quoted(secret_scan.ASSIGN)}, 2)) >= 6),
texts as (select id, count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex,
                 string_agg(concat(kind, ':', s, ':', e), ',' order by s, ord, e) filter (ord < 3) base, string_agg(concat(kind, ':', s, ':', e), ',' order by s, ord, e) spans
          from spans group by id)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join texts using (id)"""


EXACT_COPIES = """
with d as (select doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) h from documents)
select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by h) group_size, row_number() over w = 1 kept, h text_sha256
from d window w as (partition by h order by n desc, doc_id nulls last)"""

NEAR_COPIES = f"""
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
      else list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 3], ' ')) end) sh from w)),
n as (select doc_id, count(*) n from s group by doc_id),
common as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
links as (select a, b from common join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(a, b) as (select a, a from both_ways union select r.a, x.b from reach r join both_ways x on r.b = x.a),
least_ as (select a, min(b) component_id from reach group by a)
select w.doc_id, coalesce(n, 0) n_shingles, coalesce(component_id, w.doc_id) component_id from w left join n using (doc_id) left join least_ on w.doc_id = a"""

ORACLES = {"op2_secret_scan": _secrets(), "op8_exact_dedup": EXACT_COPIES, "op9_ngram_join": NEAR_COPIES}
