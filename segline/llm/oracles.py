"""The corpus queries that SQL can say, for DuckDB, each by the plainest way: all pairs, all windows, all places."""

from __future__ import annotations

import re

from .license_scan import PHRASES, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""with recursive w as (select doc_id, [x for x in string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+') if x <> ''] as w from documents),
 s as (select distinct doc_id, unnest(case when len(w) < 2 then w else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end) as sh from w),
 n as (select doc_id, count(*) as n from s group by doc_id),
 c as (select s.doc_id, s.sh, n.n from s join n using (doc_id)),
 l as (select a.doc_id as x, b.doc_id as y from c a join c b on a.sh = b.sh and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 e as (select x, y from l union all select y, x from l),
 r as (select doc_id as a, doc_id as b from documents union select r.a, e.y from r join e on r.b = e.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id, d.doc_id = m.c as kept from documents d left join n using (doc_id) join (select a, min(b) as c from r group by a) m on m.a = d.doc_id"""

#: From the definition: all pairs of equal lines, runs of them on one diagonal, and the later place of runs of 50 words.
LINES = """with l0 as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
 l1 as (select doc_id, unnest(ls) as raw, unnest(range(len(ls))) as n from l0),
 l2 as (select doc_id, n, trim(raw, ' ' || chr(9) || chr(13)) as l from l1),
 l3 as (select doc_id, n, l, greatest(1, len([x for x in string_split_regex(l, '[ \\t\\x0B\\f\\r\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+') if x <> ''])) as w from l2 where l <> ''),
 p as (select *, row_number() over (partition by doc_id order by n) as k from l3),
 eq as (select a.doc_id as a, b.doc_id as b, b.k - a.k as d, b.k as bk, b.n, b.w from p a join p b on a.l = b.l and (a.doc_id < b.doc_id or (a.doc_id = b.doc_id and a.k < b.k))),
 i as (select *, bk - row_number() over (partition by a, b, d order by bk) as isle from eq),
 r as (select b, n, sum(w) over (partition by a, b, d, isle) as words from i),
 gone as (select distinct b as doc_id, n from r where words >= 50),
 kept as (select l1.doc_id, string_agg(l1.raw, chr(10) order by l1.n) as text from l1 left join gone using (doc_id, n) where gone.n is null group by l1.doc_id)
select d.doc_id, coalesce(len(d.ls), 0)::int as n_lines, (select count(*) from gone where gone.doc_id = d.doc_id)::int as n_removed, case when d.text is null then null else coalesce(kept.text, '') end as text from l0 d left join kept using (doc_id)"""

#: All queries against all rows.
NEAREST = """with v as (select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null),
 s as (select vec_id, e from v where len(e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
 p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score from s q join s c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from p qualify rank <= 20"""


def _regex(template: str) -> str:
    """A template as a regular expression over words that each end in a space."""
    out = re.sub(r"<<var (\d+)-(\d+)>>", r" @\1@\2@ ", template)
    parts = []
    for token in re.split(r"(<<opt>>|<</opt>>|\s+)", out):
        if not token or token.isspace():
            continue
        found = re.fullmatch(r"@(\d+)@(\d+)@", token)
        parts.append("(?:" if token == "<<opt>>" else ")?" if token == "<</opt>>" else f"(?:[^ ]+ ){{{found[1]},{found[2]}}}" if found else token + " ")
    return "^" + "".join(parts)


def _license() -> str:
    firsts, whats = [], []
    for phrase, label in PHRASES:
        firsts.append((label, True, "^" + phrase + " ", 3))
    for label, template in TEMPLATES:
        firsts.append((label, False, _regex(template), 260))
    whats = ", ".join(f"('{label}', {str(base).lower()}, '{pattern}', {n})" for label, base, pattern, n in firsts)
    starts = ", ".join(f"'{x}'" for x in sorted({re.match(r"\^\(?\??:?(\w+)", p)[1] for _, _, p, _ in firsts} | {"under"}))
    return f"""with w as (select doc_id, [x for x in string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> ''] as w from documents),
 t(label, base, pattern, most) as (values {whats}),
 i as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w),
 c as (select doc_id, i, t.label, t.base, regexp_extract(array_to_string(w[i : i + t.most], ' ') || ' ', t.pattern) as hit from i, t where w[i] in ({starts})),
 h as (select doc_id, i - 1 as pos, label, base, length(hit) - length(replace(hit, ' ', '')) as n from c where hit <> ''),
 v as (select doc_id, count(distinct p) as covered from (select doc_id, unnest(range(pos, pos + n)) as p from h) group by doc_id),
 a as (select doc_id, count(*) filter (base) as n_base, min(pos) filter (base) as first_word, max(pos) filter (base) as last_word, string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels from h group by doc_id)
select w.doc_id, len(w.w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, case when len(w.w) = 0 then 0.0::double else coalesce(covered, 0) / len(w.w)::double end as score from w left join a using (doc_id) left join v using (doc_id)"""


LICENSE = _license()


def _chat() -> str:
    controls = r"<\|turn\|>|<\|end\|>|</s>|\[INST\]|\[/INST\]"
    own = ", ".join(f"(-1, {k}, '{role}', '</s>[INST] ok [/INST]')" for k, role in enumerate(["user", "assistant"]))
    return rf"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations union all values {own})),
 f as (select *, 18 + length(role) + len(regexp_extract_all(role, '[\\\n<\[]')) + length(text) + len(regexp_extract_all(text, '{controls}')) as n, case when role = 'assistant' then text else '' end as said from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256, cast(sum(length(said)) as bigint) as loss_chars, sha256(string_agg(said, '' order by turn nulls first, role, text)) as loss_sha256, cast(sum(n) as bigint) as formatted_chars from f group by conv_id"""


#: Turns joined again without a tree; a written turn is 18 characters and its escapes longer than its role and text.
CHAT = _chat()
