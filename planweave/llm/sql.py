"""Queries of the operators once more as DuckDB SQL, where SQL can express them on whole tables."""

from __future__ import annotations

from planweave.llm.clusters import CENTROIDS, COMPONENTS, ROUNDS, SCALE, SEED
from planweave.llm.negatives import HIGH, LOW, NEGATIVES, POSITIVES
from planweave.llm.url_filter import ALPHABET, BIN, HELD_OUT, LOWER, ORDER, RULES, UPPER


def _rule(field: int) -> str:
    cases = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        name, _, rest = rule.partition("/")
        cases.append(
            f"when (host = '{name}' or host like '%.{name}') and starts_with(path, '/{rest}') then '{(verdict, rule)[field]}'"
        )
    return f"case {' '.join(cases)} end"


def _level(k: int) -> str:
    """Smoothed probabilities of the grams of k characters."""
    below = f"{1.0 / ALPHABET!r}::double" if k == 1 else "{}"
    side = []
    for c in "ab":
        p = below.format(f"s.p{c}")
        side.append(f"case when n{c} > 0 then ({c} + t{c} * {p}) / (n{c} + t{c}) else {p} end as p{c}")
    lower = "" if k == 1 else f"join p{k - 1} s on s.gram = substr(c.gram, 2)"
    return f"""
p{k} as (
  select c.gram, {", ".join(side)}
  from counts c join totals t on t.k = {k} and t.context = substr(c.gram, 1, {k - 1}) {lower}
  where length(c.gram) = {k}),"""


_LONGEST = ", ".join(f"g{k}.ratio" for k in range(ORDER, 0, -1))
_LOOKUPS = "\n  ".join(
    f"left join model g{k} on g{k}.gram = substr(letters, pos - {k - 1}, {k})" for k in range(1, ORDER + 1)
)

URL_FILTER = f"""with
cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
ruled as (select *, {_rule(0)} as decided, {_rule(1)} as rule, host || path as key from parts),
urls as (
  select key, '{"^" * (ORDER - 1)}' || regexp_replace(regexp_replace(translate(key, '{UPPER}', '{LOWER}'), '[0-9]', '0', 'g'),
              '[^a-z0./_%~=&-]', '*', 'g') || '$' as letters,
         any_value(decided) as decided, ('0x' || substr(md5(key), 1, 1))::int < {HELD_OUT} as held_out
  from ruled where key <> '' group by key),
taught as (
  select decided, substr(letters, pos - k + 1, k) as gram
  from (select decided, letters, unnest(range({ORDER}, length(letters) + 1)) as pos
        from urls where decided is not null and not held_out), range(1, {ORDER + 1}) r(k)),
counts as (
  select gram, count(*) filter (decided = 'allow') as a, count(*) filter (decided = 'block') as b
  from taught group by gram),
totals as (
  select length(gram) as k, substr(gram, 1, length(gram) - 1) as context, sum(a) as na, sum(b) as nb,
         count(*) filter (a > 0) as ta, count(*) filter (b > 0) as tb
  from counts group by 1, 2),{"".join(_level(k) for k in range(1, ORDER + 1))}
model as ({" union all ".join(f"select gram, ln(pa) - ln(pb) as ratio from p{k}" for k in range(1, ORDER + 1))}),
scored as (
  select key, any_value(decided) as decided, any_value(held_out) as held_out,
         round(avg(coalesce({_LONGEST}, 0.0)), 6) as score
  from (select *, unnest(range({ORDER}, length(letters) + 1)) as pos from urls)
  {_LOOKUPS}
  group by key),
bins as (
  select cast(greatest(-{int(20 / BIN)}, least({int(20 / BIN)}, floor(score / {BIN} + 1e-9))) as int) as bin,
         count(*) filter (decided = 'allow') as a, count(*) filter (decided = 'block') as b
  from scored where decided is not null and held_out group by 1),
gains as (
  select bin, coalesce(sum(b) over w, 0) / nullif(sum(b) over (), 0) - coalesce(sum(a) over w, 0) / nullif(sum(a) over (), 0) as gain
  from bins window w as (order by bin rows between unbounded preceding and 1 preceding)),
chosen as (
  select coalesce(round((select bin from gains where gain is not null order by gain desc, bin limit 1) * {BIN}, 2), 0.0) as threshold)
select page_id, host, path, rule,
       coalesce(ruled.decided, case when coalesce(score, threshold) >= threshold then 'allow' else 'block' end) as verdict,
       score, threshold
from ruled left join scored using (key), chosen"""

SUFFIX_DEDUP = """with
texts as (select row_number() over () as row_no, doc_id, encode(coalesce(text, '')) as data from documents),
codes as (select row_no, doc_id, octet_length(data) as n_bytes, hex(data) as code from texts),
blocks as (
  select row_no, first, substr(code, 2 * first + 1, 1824) as code
  from (select row_no, code, unnest(range(0, n_bytes - 399, 512)) as first from codes where n_bytes >= 400)),
starts as (
  select row_no, first + k as s, hash(substr(code, 2 * k + 1, 800)) as string
  from (select *, unnest(range(least(512, length(code) // 2 - 399))) as k from blocks)),
repeated as (
  select row_no, s from starts where string in (select string from starts group by string having count(*) > 1)),
marked as (
  select row_no, s, coalesce(s - lag(s) over w > 400, true) as opens
  from repeated window w as (partition by row_no order by s)),
spans as (
  select row_no, min(s) as a, max(s) + 400 as b
  from (select *, sum(opens::int) over (partition by row_no order by s) as span from marked)
  group by row_no, span),
kept as (
  select row_no, 2 * coalesce(lag(b) over w, 0) as a, 2 * s.a as b
  from spans s window w as (partition by row_no order by s.a)
  union all
  select row_no, 2 * max(b), 9223372036854775807 from spans group by row_no),
joined as (
  select row_no,
         sha256(unhex(string_agg(substr(code, k.a + 1, least(k.b, length(code)) - k.a), '' order by k.a))) as kept_sha256
  from kept k join codes using (row_no) group by row_no),
sums as (select row_no, sum(b - a)::bigint as n_removed, count(*) as n_spans from spans group by row_no)
select doc_id, n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       coalesce(kept_sha256, sha256(unhex(code))) as kept_sha256
from codes left join sums using (row_no) left join joined using (row_no)"""


def _round(n: int) -> str:
    """Assignment to the centroids of round ``n``."""
    return f"""
a{n} as materialized (
  select r, arg_min(c, d * {CENTROIDS} + c) as c, min(d) as d
  from (select k.r, m.c, list_inner_product(k.v, k.v) - 2 * list_inner_product(k.v, m.v) + list_inner_product(m.v, m.v) as d
        from kept k, c{n} m) group by r)"""


def _means(n: int) -> str:
    """Centroids of round ``n`` from the assignment before it; an empty one stays."""
    return f"""
c{n} as materialized (
  select m.c, coalesce(f.v, m.v) as v from c{n - 1} m left join (
    select c, list(x order by pos) as v from (
      select c, pos, floor(sum(x) / count(*)) as x
      from (select a.c, unnest(k.v) as x, generate_subscripts(k.v, 1) as pos from kept k join a{n - 1} a using (r))
      group by c, pos) group by c) f using (c))"""


CLUSTERS = f"""with
kept as materialized (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)) as v
  from embeddings
  where len(embedding) = {COMPONENTS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {COMPONENTS}),
c0 as materialized (
  select c, v from (
    select row_number() over (order by sha256('{SEED}' || vec_id), v) - 1 as c, v from kept where vec_id is not null)
  where c < {CENTROIDS}),{",".join(_round(n) + "," + _means(n + 1) for n in range(ROUNDS))},{_round(ROUNDS)}
select k.vec_id, a.c::int as cluster, a.d::bigint as distance, sum(a.d) over (partition by a.c)::bigint as cluster_inertia,
       sum(a.d) over ()::bigint as inertia,
       sha256(array_to_string(list_transform(m.v, lambda x: x::bigint), ',')) as centroid_sha256
from kept k join a{ROUNDS} a using (r) join c{ROUNDS} m on m.c = a.c
"""

HARD_NEGATIVES = f"""with
rows_ as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as materialized (
  select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same,
         list_inner_product(a.v, r.v)::bigint as score
  from rows_ a join rows_ r on a.vec_id % 100 = 0 and r.vec_id <> a.vec_id),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= {POSITIVES})
select p.anchor_id, p.positive_id,
       row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)::int as rank,
       s.other_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
  and {LOW} * p.positive_score <= 100 * s.score and 100 * s.score <= {HIGH} * p.positive_score
qualify rank <= {NEGATIVES}
"""
