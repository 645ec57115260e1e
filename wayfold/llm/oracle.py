"""DuckDB SQL for the llm queries that SQL can express."""

from __future__ import annotations

from itertools import combinations

SQL: dict[str, str] = {}


def quality_sql() -> str:
    """Counts, votes and the whole estimation in SQL, one step of expectation-maximisation after another."""
    from . import quality as q

    rules = list(q.RULES.values())
    n = len(rules)
    vote = ", ".join(f"case when {bad} then 0 when {good} then 1 else 2 end as v{j}" for j, (bad, good) in enumerate(rules))
    names = ", ".join(f"v{j}" for j in range(n))
    start = f"select {q.START_PRIOR!r}::double as prior, " + ", ".join(f"{g!r}::double as g{j}_{v}, {b!r}::double as b{j}_{v}" for j in range(n) for v, (g, b) in enumerate(zip(q.START_GOOD, q.START_BAD, strict=True)))
    odds = "ln(prior / (1 - prior))" + "".join(f" + case v{j} " + " ".join(f"when {v} then ln(g{j}_{v} / b{j}_{v})" for v in range(3)) + " end" for j in range(n))
    steps = []
    for i in range(q.ROUNDS):
        new = ", ".join(f"(1 + coalesce(sum(c * p) filter (v{j} = {v}), 0)) / (3 + sum(c * p)) as g{j}_{v}, (1 + coalesce(sum(c * (1 - p)) filter (v{j} = {v}), 0)) / (3 + sum(c * (1 - p))) as b{j}_{v}" for j in range(n) for v in range(3))
        steps.append(f"m{i + 1} as materialized (select (1 + sum(c * p)) / (2 + sum(c)) as prior, {new} from (select patterns.*, 1 / (1 + exp(-({odds}))) as p from patterns, m{i}))")
    return f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
cut as (select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from texts),
windows as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as x from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from cut)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) as c from windows) where c > 1),
repeats as (select doc_id, count(distinct i + k) as n_repeat_words from twice, (values (0), (1), (2)) as ks(k) group by doc_id),
counts as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint as n_capitals, (length(t) - length(replace(t, '!', '')))::bigint as n_bangs
  from cut left join repeats using (doc_id)),
voted as materialized (select *, {vote} from counts),
patterns as materialized (select {names}, count(*)::double as c from voted group by all),
m0 as ({start}),
{", ".join(steps)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({q.BASE_FAILED}) as base_failed,
  not ({q.BASE_FAILED}) and 1 / (1 + exp(-({odds}))) >= {q.THRESHOLD} as kept
from voted, m{q.ROUNDS}
"""


def url_sql() -> str:
    """The lists' log, its intervals, and the join of captures to them."""
    from . import queries as q
    from . import url_filter

    return f"""
with captures as (select page_id, nullif(lower(regexp_extract(url, '{url_filter.HOST}', 1)), '') as host, timestamp '{q.START}' + to_minutes(({q.PAGE_MINUTES} * page_id % ({q.LIST_DAYS} * 1440))::integer) as fetched_at from pages),
hosts as (select distinct host as h from captures where host is not null),
domains as (select h from (select h from hosts union select substring(h, instr(h, '.') + 1) from hosts) where length(h) % 3 = 0),
log as (select list, h as domain, action, timestamp '{q.START}' + to_days(((length(h) * 31 + k * 53 + n * 97) % {q.LIST_DAYS} + n * 40)::integer) as happened
  from domains, (values ('adult', 0), ('malware', 1), ('spam', 2)) as lists(list, k), (values ('add', 0), ('remove', 1), ('add', 2)) as steps(action, n)
  where length(h) % 4 >= k and length(h) % 5 >= n),
events as (select list, domain, happened, bool_and(action = 'add') as on_list from log group by all),
changes as (select * from (select *, lag(on_list) over (partition by list, domain order by happened) as was from events) where on_list <> coalesce(was, false)),
valid as (select * from (select list, domain, on_list, happened as valid_from, lead(happened) over (partition by list, domain order by happened) as valid_to from changes) where on_list),
found as (select page_id, list, domain from captures join valid on (host = domain or ends_with(host, '.' || domain)) and fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to))
select page_id, any_value(host) as host, count(domain) > 0 as blocked, count(domain) as n_matches, coalesce(string_agg(list || '@' || domain, ',' order by list, domain), '') as matched
from captures left join found using (page_id) group by page_id
"""


def audit_sql() -> str:
    """Every step of every order counted by itself from the documents' failures, without the lattice."""
    chosen = " and ".join(f"{a}.l <> {b}.l" for a, b in combinations("pqrst", 2))
    return f"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
failed as (select doc_id, part,
  (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as mask from texts),
said as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
counted as (select part, mask, coalesce(good, false) as good, coalesce(toxic, false) as toxic, count(*) as n from failed left join said using (doc_id) group by all),
filters(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (select p.l || q.l || r.l || s.l || t.l as o from filters p, filters q, filters r, filters s, filters t where {chosen}),
steps as (select o as filter_order, k::int as step, o[k] as letter, 1 << (ascii(o[k]) - 65) as now, coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(o[i]) - 65))), 0)::int as before from orders, range(1, 6) as r(k)),
walked as (select part, filter_order, step, letter,
  coalesce(sum(n) filter (mask & (before | now) = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & before = 0 and mask & now <> 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & before <> 0 and mask & now <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = now), 0)::bigint as unique_fails,
  coalesce(sum(n) filter (good and mask & before = 0 and mask & now <> 0), 0)::bigint as good_lost, coalesce(sum(n) filter (toxic and mask & before = 0 and mask & now <> 0), 0)::bigint as toxic_lost
  from counted, steps group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from walked
"""


def codes_sql() -> str:
    """Lloyd's rounds over all rows and entries, one statement for each round."""
    from . import vector_codes as v

    def assigned(i: int) -> str:
        far = "list_sum(list_transform(range(1, len(a.x) + 1), lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i])))"
        return f"a{i} as materialized (select n, p, arg_min(struct_pack(e := e, far := far), (far, e)) as best from (select n, p, e, {far}::bigint as far from parts a join c{i} b using (p)) group by n, p)"

    steps = [assigned(0)]
    for i in range(v.ROUNDS):
        mean = "(s - ((s % m) + m) % m) / m"
        steps.append(f"""c{i + 1} as materialized (select p, e, coalesce(y, x) as x from c{i} left join (select p, e, list(({mean})::bigint order by k) as y
  from (select p, best.e as e, k, sum(x[k])::hugeint as s, count(*)::hugeint as m from (select p, best, x, unnest(range(1, len(x) + 1)) as k from a{i} join parts using (n, p)) group by all) group by p, e) using (p, e))""".replace("/ m", "// m"))
        steps.append(assigned(i + 1))
    books = f"select sha256(string_agg(t, ',' order by p, e)) as codebooks_sha256 from (select p, e, array_to_string(x, ',') as t from c{v.ROUNDS})"
    return f"""
with kept as (select row_number() over (order by vec_id) as n, vec_id, label, list_transform(embedding, lambda x: floor({v.SCALE} * x::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select n, p, x[p * len(x) // {v.PARTS} + 1 : (p + 1) * len(x) // {v.PARTS}] as x from kept, range({v.PARTS}) as r(p)),
c0 as (select p, n - 1 as e, x from parts where n <= {v.ENTRIES}),
{", ".join(steps)},
codes as (select n, string_agg(printf('%02x', best.e), '' order by p) as code, sum(best.far)::bigint as error from a{v.ROUNDS} group by n)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join codes using (n), ({books})
"""


SQL["op12_filter_audit"] = audit_sql()
SQL["op13_vector_codes"] = codes_sql()
SQL["op6_url_lists"] = url_sql()
SQL["op5_quality_votes"] = quality_sql()
