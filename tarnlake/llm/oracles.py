"""DuckDB SQL for the corpus queries that SQL can express over whole tables.

Beyond SQL, or too slow in it, and so held against brute force in tests/llm: op1 and op10 (possessive patterns and window entropy), op2
(tokenizer), op3 and op9 (XXH64, CRC-32), op4 (markup, trained tree).
"""

from tarnlake.llm import quality
from tarnlake.llm.urlfilter import LISTED_LABELS, RULES

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule(verdict: str, host: str, path: str) -> str:
    return f"when (host = '{host}' or suffix(host, '.{host}')) and starts_with(path, '{path}') then {{}}".format(f"'{host}{path}'" if verdict is None else f"'{verdict}'")


_ORDERED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
URL_FILTER = f"""
with split as (
    select page_id, {_LOWER.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages
), judged as (
    select *, case {" ".join(_rule(None, h, p) for _, h, p in _ORDERED)} end as rule, case {" ".join(_rule(v, h, p) for v, h, p in _ORDERED)} end as told,
    list_has_any(string_split(host, '.'), [{", ".join(f"'{x}'" for x in LISTED_LABELS)}]) as listed from split
)
select page_id, host, path, rule, coalesce(told, case when listed then 'block' else 'allow' end) as verdict, listed from judged
"""

_WORDS = f"list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
DECONTAMINATE = f"""
with docs as (select row_number() over () as rid, doc_id, {_WORDS} as w from documents),
items as (select coalesce(cast(item_id as varchar), '') as item_id, {_WORDS} as w from benchmark),
windows as (
    select distinct item_id, least(len(w), 8) as n, array_to_string(w[i + 1:i + 8], ' ') as win
    from (select item_id, w, unnest(range(0, greatest(len(w) - 7, 1))) as i from items where len(w) > 0)
), grams as (
    select rid, i, n, array_to_string(w[i + 1:i + n], ' ') as win
    from (select rid, w, n, unnest(range(0, len(w) - n + 1)) as i from docs, (select distinct n from windows) where len(w) >= n)
), hits as (select rid, i, n, item_id from grams join windows using (win, n)),
covered as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from hits) group by rid),
named as (select rid, list_sort(list(distinct item_id)) as ids from hits group by rid),
terms as (select item_id, term, min(place) as place from (select item_id, unnest(d) as term, unnest(range(0, len(d))) as place
    from (select item_id, list_filter(w, lambda x, i: list_position(w, x) = i) as d from items)) group by item_id, term),
places as (select rid, term, pos from (select rid, unnest(w) as term, unnest(range(0, len(w))) as pos from docs) where term in (select term from terms)),
counted as (select term, count(*) as n from places group by term),
ranked as (select item_id, term, row_number() over (partition by item_id order by n, place, term) as r from terms join counted using (term)),
pairs as (select a.item_id, a.term as one, b.term as other from ranked a join ranked b using (item_id) where a.r = 1 and b.r = 2),
near as (select rid, count(distinct item_id) as n_near from (select distinct one, other, a.rid from (select distinct one, other from pairs) join places a on a.term = one
    join places b on b.term = other and b.rid = a.rid and abs(a.pos - b.pos) <= 8) join pairs using (one, other) group by rid)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(ids), 0) as n_items, sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(len(ids), 0) >= 2 as contaminated,
coalesce(n_near, 0) as n_near from docs left join covered using (rid) left join named using (rid) left join near using (rid)
"""

SUFFIX_DEDUP = """
with docs as (select row_number() over () as rid, doc_id, coalesce(doc_id, 9223372036854775807) as key, hex(encode(coalesce(text, ''))) as h from documents),
parts as (select rid, key, c, substr(h, 2000 * c + 1, 2098) as part from (select rid, key, h, unnest(range(0, len(h) // 2000 + 1)) as c from docs)),
windows as (
    select rid, key, 1000 * c + j as i, substr(part, 2 * j + 1, 100) as win from (select rid, key, c, part, unnest(range(0, greatest(least(1000, len(part) // 2 - 49), 0))) as j from parts)
),
least_keys as (select win, min(key) as low from windows group by win having count(*) > 1),
starts as (select rid, i from windows join least_keys using (win) where low < key),
runs as (select rid, i, sum(fresh) over (partition by rid order by i) as run from (select rid, i, case when i - lag(i) over (partition by rid order by i) <= 50 then 0 else 1 end as fresh from starts)),
spans as (select rid, min(i) as a, max(i) + 50 as b from runs group by rid, run),
pieces as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as before from spans),
kept as (
    select rid, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as rest
    from pieces join docs using (rid) group by rid
)
select doc_id, len(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(rest, h))) as kept_sha256 from docs left join kept using (rid)
"""



def _repeated(size: int) -> str:
    """Places of words at which a window begins that stands twice or more in the text, and the words that these cover."""
    return f"""
r{size} as (
    select rid, i, g from (select rid, i, array_to_string(w[i + 1:i + {size}], ' ') as g from (select rid, w, unnest(range(0, len(w) - {size - 1})) as i from docs where len(w) >= {size}))
    qualify count(*) over (partition by rid, g) > 1
), c{size} as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + {size})) as p from r{size}) group by rid)"""


#: The longest repeat: pairs of equal windows that follow each other at the same distance.
QUALITY = f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
lines as (select rid, count(*) - count(distinct x) as n from (select rid, unnest(string_split(t, chr(10))) as x from docs) where regexp_matches(x, '[^\\x20\\x09-\\x0D]') group by rid),{_repeated(quality.WINDOW)},{_repeated(quality.SHORT)},
pairs as (select a.rid, a.i, b.i - a.i as d from r{quality.WINDOW} a join r{quality.WINDOW} b on a.rid = b.rid and a.g = b.g and a.i < b.i),
runs as (select rid, count(*) as n from (select rid, d, i - row_number() over (partition by rid, d order by i) as start from pairs) group by rid, d, start),
longest as (select rid, max(n) + {quality.WINDOW - 1} as n from runs group by rid),
counted as (
    select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(lines.n, 0) as n_dup_lines, coalesce(c{quality.WINDOW}.n, 0) as n_repeat_words,
    coalesce(c{quality.SHORT}.n, 0) as n_maximal_words, coalesce(longest.n, 0) as longest_repeat
    from docs left join lines using (rid) left join c{quality.WINDOW} using (rid) left join c{quality.SHORT} using (rid) left join longest using (rid)
)
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words
    or n_maximal_words > n_words * {quality.MOST_COVERED}::double or (longest_repeat >= {quality.LONGEST_WORDS} and longest_repeat > n_words * {quality.LONGEST_FRACTION}::double)
    or n_symbols > n_words * {quality.MOST_SYMBOLS}::double) as kept
from counted
"""

ORACLES = {"op5_quality": QUALITY, "op6_url_filter": URL_FILTER, "op7_decontaminate": DECONTAMINATE, "op8_suffix_dedup": SUFFIX_DEDUP}
