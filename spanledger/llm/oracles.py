"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from .quality import GRAM, NAMES, ROUNDS, RULES, START, STOP_WORDS

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRIMMED = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _odds(model: str) -> str:
    """Log odds of a row with votes, given the row `model`."""
    terms = [f"case when vote_{n} is null then 0.0 else (2 * vote_{n} - 1) * ln({model}.a_{n} / (1 - {model}.a_{n})) end" for n in NAMES]
    return " + ".join([f"ln({model}.good / (1 - {model}.good))", *terms])


def quality_sql() -> str:
    votes = ", ".join(f"case when {bad} then 0 when {good} then 1 end as vote_{name}" for name, bad, good in RULES)
    names = ", ".join(f"vote_{n}" for n in NAMES)
    steps = [f"m0 as (select {START['good']}::double as good, " + ", ".join(f"{a}::double as a_{n}" for n, a in START["rules"].items()) + ")"]
    for i in range(ROUNDS):
        right = ", ".join(
            f"greatest(0.5, (coalesce(sum(case vote_{n} when 1 then n * p when 0 then n * (1 - p) end), 0) + 1) / (coalesce(sum(case when vote_{n} is not null then n end), 0) + 2)) as a_{n}" for n in NAMES
        )
        steps.append(f"m{i + 1} as materialized (select (sum(n * p) + 1) / (sum(n) + 2) as good, {right} from (select patterns.*, 1 / (1 + exp(-({_odds(f'm{i}')}))) as p from patterns, m{i}))")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    gram = " || chr(0) || ".join(f"words[p + {k}]" for k in range(GRAM))
    return f"""
    with base as (
        select row_number() over () as r, doc_id, coalesce(text, '') as text,
            list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda w: w <> '') as words,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
        from documents),
    solid as (select *, array_to_string(words, '') as s from base),
    grams as (select r, p, {gram} as g from (select r, words, unnest(range(1, len(words) - {GRAM} + 2)) as p from base where len(words) >= {GRAM})),
    again as (select r, p from (select r, p, count(*) over (partition by r, g) as c from grams) where c > 1),
    repeats as (select r, count(distinct p + k) as n from again, range({GRAM}) as ks(k) group by r),
    counted as (
        select solid.r, doc_id, len(words) as n_words, length(s) as word_chars,
            length(s) - length(regexp_replace(s, '[#*$%&|<>]', '', 'g')) as n_symbols,
            len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
            len(lines) as n_lines, length(regexp_replace(s, '[^\\p{{L}}]+', '', 'g')) as n_letters,
            len(list_filter(words, lambda w: w = '|')) as n_bars, len(list_distinct(words)) as n_distinct_words,
            length(s) - length(regexp_replace(s, '[A-Z]+', '', 'g')) as n_capitals,
            length(s) - length(regexp_replace(s, '!+', '', 'g')) as n_exclamations,
            len(list_filter(words, lambda w: w in ({stop}))) as n_stop_words
        from solid left join repeats on solid.r = repeats.r),
    voted as (select *, {votes} from counted),
    patterns as materialized (select {names}, count(*) as n from voted group by all),
    {", ".join(steps)},
    judged as (select voted.*, 1 / (1 + exp(-({_odds(f"m{ROUNDS}")}))) as p, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from voted, m{ROUNDS})
    select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
        n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and p >= 0.5 as kept, round(p, 6) as quality
    from judged"""


def line_dedup_sql(min_chars: int) -> str:
    return f"""
    with base as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
    each as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from base),
    keyed as (select *, translate(trim(line, {_TRIMMED}), '{_UPPER}', '{_LOWER}') as key from each),
    shared as (select key, min(doc_id) as first from keyed where length(key) >= {min_chars} and doc_id is not null group by key having count(distinct doc_id) > 1),
    marked as (select keyed.*, shared.key is not null and doc_id <> first as gone from keyed left join shared on keyed.key = shared.key)
    select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
        sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not coalesce(gone, false)), '')) as kept_sha256
    from marked group by r, doc_id"""


def near_dedup_sql(shingle: int, percent: int) -> str:
    gram = " || ' ' || ".join(f"words[p + {k}]" for k in range(shingle))
    return f"""
    with recursive base as (
        select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda w: w <> '') as words from documents),
    grams as (
        select distinct r, {gram} as g from (select r, words, unnest(range(1, len(words) - {shingle} + 2)) as p from base where len(words) >= {shingle})
        union all select r, array_to_string(words, ' ') from base where len(words) between 1 and {shingle - 1}),
    sizes as (select r, count(*) as n from grams group by r),
    pairs as (select a.r as u, b.r as v, count(*) as n_both from grams a join grams b on a.g = b.g and a.r < b.r group by all),
    linked as (select a.doc_id as u, b.doc_id as v from pairs
        join sizes x on x.r = u join sizes y on y.r = v join base a on a.r = u join base b on b.r = v
        where 100 * n_both >= {percent} * (x.n + y.n - n_both) and a.doc_id <> b.doc_id),
    edges as (select u, v from linked union select v, u from linked),
    reach as (select u as node, u as other from edges union select reach.node, edges.v from reach join edges on edges.u = reach.other),
    least as (select node, min(other) as component from reach group by node)
    select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component, doc_id) as component_id, coalesce(coalesce(component, doc_id) = doc_id, true) as kept
    from base left join sizes on sizes.r = base.r left join least on node = doc_id"""


#: The dated list of the query on `pages`, as CTEs; see queries.dated_entries.
_ENTRIES = """
    hosts as (select distinct host from captures where host <> ''),
    coded as (select host, ('0x' || substr(md5(host), 1, 4))::int as a, ('0x' || substr(md5(host), 5, 4))::int as b, regexp_extract(host, '([^.]+[.][^.]+[.][^.]+)$', 1) as parent from hosts),
    entries as (
        select 'malware' as list, 'host' as kind, host as pattern, 'add' as action, a % 300 as day from coded where a % 3 = 0
        union all select 'malware', 'host', host, 'remove', a % 300 + 20 + b % 100 from coded where a % 3 = 0 and b % 2 = 0
        union all select 'malware', 'host', host, 'add', a % 300 + 170 from coded where a % 3 = 0 and b % 4 = 0
        union all select 'adult', 'domain', parent, 'add', b % 200 from coded where b % 5 = 0 and parent <> ''
        union all select 'spam', 'prefix', host || '/en', 'add', b % 250 from coded where a % 4 = 1
        union all select 'spam', 'prefix', host || '/en', 'remove', b % 250 + 60 from coded where a % 4 = 1
        union all select 'allow', 'host', host, 'add', 100 from coded where a % 7 = 0)"""

_URL = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"

URL_FILTER_SQL = rf"""
    with parsed as (
        select row_number() over () as r, page_id, url, timestamp '2024-01-01' + to_days((page_id * 7919 % 366)::int) + to_seconds(page_id * 131 % 86400) as fetched_at,
            rtrim(lower(regexp_extract(coalesce(url, ''), '{_URL}(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') as host,
            list_filter(string_split(regexp_extract(coalesce(url, ''), '{_URL}[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts
        from pages),
    captures as (select *, host || '/' || array_to_string(parts, '/') || '/' as whole from parsed),
    {_ENTRIES},
    log as (select list, kind, lower(pattern) as pattern, max(action) as action, timestamp '2024-01-01' + to_days(day) as listed_at from entries group by list, kind, lower(pattern), day),
    changes as (select * from (select *, lag(action) over w as before from log window w as (partition by list, kind, pattern order by listed_at)) where before is null or before <> action),
    spans as (select * from (select *, lead(listed_at) over (partition by list, kind, pattern order by listed_at) as valid_to from changes) where action = 'add'),
    hits as (
        select r, list from captures join spans on listed_at <= fetched_at and (valid_to is null or fetched_at < valid_to) and host <> '' and case kind
            when 'host' then host = pattern
            when 'domain' then host = pattern or ends_with(host, '.' || pattern)
            else starts_with(whole, pattern || '/') end),
    found as (select r, count(*) as n_hits, string_agg(distinct list, ',' order by list) as lists, bool_or(list = 'allow') as allowed from hits group by r)
    select page_id, url, fetched_at, host, coalesce(n_hits, 0)::bigint as n_hits, coalesce(lists, '') as lists, n_hits is not null and not allowed as blocked
    from captures left join found on found.r = captures.r"""


INFILL_SQL = r"""
    with base as (
        select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
    drawn as (select *, len(units) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from base),
    cut as (
        select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
            case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form
        from drawn),
    pieces as (select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from cut)
    select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
        sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
        sha256(text) as restored_sha256
    from pieces"""


#: CRC-32 of an ASCII string: eight steps of the reflected polynomial after each byte.
_CRC = "xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(k[i])::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: case when x >= 0 then xor(c, x) when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end), 4294967295)"


def _before(state: int, after: int, kept: dict[str, int]) -> str:
    """Least cost of the edits of one turn in a state; `after` is the state that a rename leads to, kept the state after each initial."""
    keep = " ".join(f"when x = '{x}' then t + g{s}" for x, s in kept.items())
    return f"least(2 + g{state}, case when not must then least(1 + t + g{after}, case {keep} end) end)"


_BARE = [_before(0, 2, {"s": 1, "u": 2}), _before(1, 2, {"u": 2}), _before(2, 3, {"a": 3}), _before(3, 2, {"u": 2})]

CONVERSATION_SQL = f"""
    with recursive base as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
    convs as (select conv_id, row_number() over () as c from (select distinct conv_id from conversations)),
    kinds as (select *, {_CRC} % 20 as kind from base),
    rows_ as (
        select c, kinds.conv_id, turn, case when kind = 4 then 'user' else role end as role,
            case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy
        from kinds join convs on kinds.conv_id is not distinct from convs.conv_id where kind <> 0),
    sorted as (select *, row_number() over (partition by c order by turn nulls first, role, sha256(text)) as i from rows_),
    placed as (select *, row_number() over (partition by c, role, text order by i) as seen, right(rtrim(text, {_TRIMMED}), 1) as tail, role[1:1] as x from sorted),
    coded as (
        select *, case when tail = '' then 'blank' when seen > 1 then 'duplicate' when tail not in ('.', '!', '?') then 'truncated' else '' end as fault,
            lag(x) over (partition by c order by i) as x_before from placed),
    told as materialized (select c, i, x, fault in ('blank', 'duplicate') as must, case fault when 'truncated' then 5 else 0 end as t, role, text from coded),
    report as (
        select c, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
            count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where i > 1 and x_before || x not in ('su', 'ua', 'au')) as illegal, count(*) as n
        from coded group by c),
    back as (
        select c, n + 1 as i, 0 as g0, 10 as g1, 5 as g2, 0 as g3 from report
        union all
        select c, i, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3), least(b3, 5 + b2) from (
            select told.c, told.i, {", ".join(f"{b} as b{s}" for s, b in enumerate(_BARE))} from back join told on told.c = back.c and told.i = back.i - 1)),
    costs as materialized (select c, i, [g0, g1, g2, g3] as g from back),
    walk as (
        select c, 1::bigint as i, 0 as s, '' as audit, []::varchar[] as lines, false as over from report
        union all
        select c, i + (e in ('D', 'K', 'R'))::int, case e when 'K' then case x when 's' then 1 when 'u' then 2 else 3 end when 'D' then s when '' then s else nx end, audit || e,
            case e when 'D' then lines when '' then lines when 'I' then list_append(lines, nr || ':') when 'K' then list_append(lines, role || ':' || text) else list_append(lines, nr || ':' || text) end, e = ''
        from (
            select walk.*, told.x, told.role, told.text, case s when 2 then 3 else 2 end as nx, case s when 2 then 'assistant' else 'user' end as nr,
                case when told.i is null and s in (0, 3) then ''
                    when told.i is not null and h.g[s + 1] = 2 + a.g[s + 1] then 'D'
                    when h.g[s + 1] = 5 + h.g[case s when 2 then 4 else 3 end] then 'I'
                    when not must and x = case s when 2 then 'a' else 'u' end and h.g[s + 1] = t + a.g[case s when 2 then 4 else 3 end] then 'K'
                    when not must and x = 's' and s = 0 and h.g[1] = t + a.g[2] then 'K'
                    else 'R' end as e
            from walk join costs h on h.c = walk.c and h.i = walk.i left join told on told.c = walk.c and told.i = walk.i left join costs a on a.c = walk.c and a.i = walk.i + 1
            where not over))
    select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
        coalesce(g[1], 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) as repaired_sha256
    from convs left join report on report.c = convs.c left join costs on costs.c = convs.c and costs.i = 1 left join walk on walk.c = convs.c and over"""
