"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from weekwatch.llm import licenses, secrets, sharding

SQL: dict[str, str] = {}

SQL["op7_exact_dedup"] = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents
)
select doc_id,
       min(doc_id) over w as keep_id,
       count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept,
       text_sha256
from d
window w as (partition by text_sha256)
"""

SQL["op5_mixing"] = r"""
with d as (
  select doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::varchar, ''), coalesce(text, ''))), 1, 9))::bigint as h
  from documents
),
s as (
  select source, sum(size)::bigint as z, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w
  from d group by source
),
f as (
  select source, z, w,
         3 * sum(z) over () - 4 * coalesce(sum(z) over (order by z / w, source nulls last
                                                         rows between unbounded preceding and 1 preceding), 0) as l,
         2 * sum(w) over (order by z / w, source nulls last
                          rows between current row and unbounded following) as o,
         row_number() over (order by z / w, source nulls last) as pos
  from s
),
g as (select *, (l * w)::double / o > 2 * z as stops from f),
k as (select l as kl, o as ko from g where not stops order by pos limit 1),
t as (
  select source, z, case when stops then (2 * z)::double else (kl * w)::double / ko end as target
  from g left join k on true
),
r as (select *, case when z > 0 then floor(target / z) else 0 end as full_times from t),
c as (
  select d.*, r.z, r.target, r.full_times, r.target - r.full_times * r.z as rest,
         sum(size) over (partition by d.source order by h) as upto,
         sum(size) over (partition by d.source, h) as cell
  from d join r on d.source is not distinct from r.source
)
select doc_id, source, size, z as source_size, target,
       (full_times + case when upto <= rest or (upto - cell <= rest and upto - cell + cell / 2 <= rest)
                          then 1 else 0 end)::bigint as times,
       (size * (full_times + case when upto <= rest or (upto - cell <= rest and upto - cell + cell / 2 <= rest)
                                  then 1 else 0 end))::bigint as taken
from c
"""


def sharding_sql(shards: list[str], size: int) -> str:
    """The shards take turns in a recursion with one step per slot."""
    names = ", ".join(f"'{s}'" for s in shards)
    return f"""
with recursive s as (
  select unnest([{names}]) as shard, unnest(range({len(shards)})) as i
),
p as (
  select list((('0x' || substr(md5('offset:' || shard), 1, 15))::bigint % {size}) order by i) as o,
         list((('0x' || substr(md5('skip:' || shard), 1, 15))::bigint % ({size} - 1) + 1) order by i) as k
  from s
),
fill as (
  select 0 as turn, list_transform(range({size}), lambda x: -1) as owner, o, k from p
  union all
  select turn + 1,
         list_concat(list_concat(owner[:c], [turn % {len(shards)}]), owner[c + 2:]), o, k
  from (
    select *, list_filter(
        list_transform(range({size}), lambda j: (o[turn % {len(shards)} + 1] + j * k[turn % {len(shards)} + 1]) % {size}),
        lambda x: owner[x + 1] < 0)[1] as c
    from fill where turn < {size}
  )
),
slots as (
  select unnest(range({size})) as slot, unnest(owner) as i from fill where turn = {size}
)
select doc_id, l.slot, s.shard
from (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {size} as slot
      from documents) d
join slots l using (slot) join s using (i)
"""


def licences_sql() -> str:
    """Tags and sentences become identifiers; the rules are a chain of replacements.

    Wordings are found at every position by comparison, and those within a longer one are left out afterwards.
    """
    wordings = ", ".join(f"{{'n': '{name}', 't': ' {wording} '}}" for name, wording in licenses.SENTENCES)
    ordered = ", ".join(f"{{'name': '{n}', 'ids': '|{'|'.join(i)}|'}}" for n, i in licenses.RULES)
    names = ", ".join(f"'{n}'" for n in licenses.SPDX_NAMES)
    licence, sentence = licenses.LAST_RULE
    return f"""
with docs as (select doc_id, row_number() over () as d, lower(coalesce(text, '')) as text from documents),
numbered as (
  select d, doc_id, unnest(list_zip(range(len(p)), p)) as np
  from (select *, string_split_regex(text, '{licenses.SPDX_TAG}') as p from docs)
),
worded as (
  select d, doc_id, np[1] as i, np[2] as part, list_transform(
    regexp_extract_all(regexp_extract(np[2], '{licenses.SPDX_LINE}'), '{licenses.SPDX_WORD}'), lambda x: rtrim(x, '.')) as w
  from numbered
),
ended as (
  select *, list_position(list_transform(w, lambda y, m: m % 2 = 0 and y not in ('and', 'or', 'with')), true) as bad
  from worded
),
tagged as (
  select *, case when i = 0 then [] else list_transform(
    list_filter(case when bad > 0 then w[:bad - 1] else w end, lambda x, n: n % 2 = 1 and x in ({names})),
    lambda x: 'spdx:' || x) end as tags
  from ended
),
sentences as (
  select d, doc_id, i, tags, list_transform(string_split_regex(
      regexp_replace(regexp_replace(part, '{licenses.NO_WORD}', ' ', 'g'), '{licenses.VERSION}', '\\1version \\2', 'g'),
      '{licenses.SENTENCE_END}'), lambda x: ' ' || x || ' ') as said
  from tagged
),
found as (
  select *, list_transform(said, lambda x: flatten(list_transform(
      list_filter([{wordings}], lambda w: contains(x, w.t)),
      lambda w: list_transform(
        list_filter(range(1, len(x) + 1), lambda j: substr(x, j, len(w.t)) = w.t),
        lambda j: {{'s': j, 'e': j + len(w.t), 'n': w.n}})))) as f
  from sentences
),
alone as (
  select d, doc_id, i, list_concat(tags, flatten(list_transform(f, lambda x: list_transform(list_sort(
      list_filter(x, lambda a: len(list_filter(x, lambda b: b.s <= a.s and a.e <= b.e and b.e - b.s > a.e - a.s)) = 0)),
      lambda a: a.n)))) as ids
  from found
),
s as (select doc_id, flatten(list(ids order by i)) as ids from alone group by d, doc_id),
r as (
  select *, list_reduce([{ordered}],
    lambda a, b: {{'name': a.name || case when contains(a.ids, b.ids) then '|' || b.name else '' end,
                   'ids': replace(a.ids, b.ids, '|#|')}},
    {{'name': '', 'ids': '|' || array_to_string(ids, '|') || '|'}}).name as found
  from s
),
t as (
  select doc_id, ids, list_filter(string_split(found, '|'), lambda x, i: x <> ''
         and list_position(string_split(found, '|'), x) = i) as licences
  from r
)
select doc_id, array_to_string(ids, ',') as sentence_ids,
       case when len(licences) = 0 and list_contains(ids, '{sentence}') then '{licence}'
            else array_to_string(licences, ',') end as licences
from t
"""


def secrets_sql(rules, base) -> str:
    """Each expression is searched for in every text; positions add up from the parts between."""
    quoted = lambda rule: "'" + rule.pattern.replace("'", "''") + "'"
    each = ",\n".join(
        f"""list_filter(list_transform(
      range(1, len(regexp_extract_all(text, {quoted(r)})) + 1),
      lambda i: {{
        's': (list_sum(list_transform(string_split_regex(text, {quoted(r)})[:i], lambda x: len(x)))
             + coalesce(list_sum(list_transform(regexp_extract_all(text, {quoted(r)})[:i - 1], lambda x: len(x))), 0))::bigint,
        'n': {n},
        'l': len(regexp_extract_all(text, {quoted(r)})[i]),
        'v': len(regexp_extract_all(text, {quoted(r)}, {r.group})[i])}}), lambda x: x.v >= {r.least}) as k{n}"""
        for n, r in enumerate(rules)
    )
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    text = lambda of: (
        f"array_to_string(list_transform(list_sort({of}), "
        f"lambda x: {names}[x.n + 1] || ':' || x.s || ':' || (x.s + x.l)), ',')"
    )
    lists = lambda some: "flatten([" + ", ".join(f"k{n}" for n in some) + "])"
    counts = ", ".join(f"len(k{n}) as n_{r.kind}" for n, r in enumerate(base))
    return f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
k as (select doc_id, {each} from d)
select doc_id, {counts},
       sha256({text(lists(range(len(base))))}) as base_sha256,
       {text(lists(range(len(rules))))} as spans
from k
"""


SQL["op6_secrets"] = secrets_sql(secrets.RULES, secrets.BASE)
SQL["op2_sharding"] = sharding_sql(list(sharding.SHARDS), sharding.table_size(len(sharding.SHARDS)))
SQL["op10_licenses"] = licences_sql()
SQL["op12_warc"] = """
with p as (select page_id, coalesce(html, '') as html from pages),
r as (select page_id, strlen(html) as payload_bytes, sha1(html) as payload_digest, max(page_id) over (partition by html) as top from p),
s as (select *, payload_bytes >= 1000 and page_id < top as again from r)
select page_id, payload_bytes, payload_digest,
       case when again then 'revisit' else 'response' end as record_type,
       case when again then top end as refers_to
from s
"""
