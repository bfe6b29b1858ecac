"""DuckDB SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from tidemark.llm.quality import LINE_LIMIT, NGRAM_LIMITS
from tidemark.llm.url_filters import SECOND_LABELS, STRENGTH, SURE

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK = r"\x20\x09-\x0D"


def _strength(level: str) -> str:
    low, high = STRENGTH
    rho = "(sum(n * pow(k::double / n - prior, 2) / (prior * (1 - prior))) filter (where n > 0) - count(*) filter (where n > 0)) / (sum(n) - count(*) filter (where n > 0))::double"
    return f"(select case when sum(n) is null or count(*) filter (where n > 0) = 0 or sum(n) <= count(*) filter (where n > 0) then {high} when {rho} > 0 then least({high}::double, greatest({low}::double, 1 / ({rho}) - 1)) else {high} end m from {level})"


def _below(x: float, p: str, q: str, y: str) -> str:
    """The incomplete beta function at y by 200 steps of its continued fraction, from the last one back."""
    step = f"case when i % 2 = 0 then (i // 2) * ({q} - i // 2) * {y} / (({p} + i - 1) * ({p} + i)) else -({p} + i // 2) * ({p} + {q} + i // 2) * {y} / (({p} + i - 1) * ({p} + i)) end"
    fraction = f"list_reduce(list_transform(generate_series(200, 1, -1), lambda i: {step}), lambda acc, t: 1 + t / acc, 1.0::double)"
    return f"exp(lgamma({p} + {q}) - lgamma({p}) - lgamma({q}) + {p} * ln({y}) + {q} * ln(1 - {y})) / {p} / ({fraction})"


def _url_sql() -> str:
    x = 0.5
    country = rf"regexp_matches(host, '(^|\.)({'|'.join(SECOND_LABELS)})\.[a-z]{{2}}$')"
    address = r"regexp_matches(host, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') or starts_with(host, '[')"
    last = lambda n: f"array_to_string(string_split(host, '.')[greatest(1, len(string_split(host, '.')) - {n - 1}):], '.')"
    key = r"regexp_replace(p.host, '^.*@', '')"
    clean = rf"case when starts_with({key}, '[') then regexp_replace({key}, '\].*$', ']') else regexp_replace(regexp_replace({key}, ':[0-9]*$', ''), '\.+$', '') end"
    return rf"""with q as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
 p as (select *, {clean} as key from q p),
 l as (select page_id, min((quality = 1 and coalesce(toxic, 0) = 0)::int) good from p join labels on doc_id = try_cast(regexp_extract(path, '/(\d{{1,18}})(?:\.html?)?/?$', 1) as bigint) where quality is not null group by 1),
 c as (select key host, count(good) n, coalesce(sum(good), 0) k from p left join l on l.page_id = p.page_id group by 1),
 h as (select host, n, k, case when {address} then host when {country} then {last(3)} else {last(2)} end as domain, case when {address} then host when {country} then {last(2)} else {last(1)} end suffix from c),
 b as (select (coalesce(sum(k), 0) + 1)::double / (coalesce(sum(n), 0) + 2) prior from h),
 s as (select suffix, sum(n) n, sum(k) k, any_value(prior) prior from h cross join b group by 1), sm as {_strength('s')}, sr as (select suffix, (k + m * prior) / (n + m) rate from s cross join sm),
 d as (select h.suffix, h.domain, sum(n) n, sum(k) k, any_value(rate) prior from h join sr on sr.suffix = h.suffix group by 1, 2), dm as {_strength('d')}, dr as (select domain, (k + m * prior) / (n + m) rate from d cross join dm),
 t as (select host, n, k, rate prior from h join dr on dr.domain = h.domain), tm as {_strength('t')}, tr as (select host, k + m * prior a, n + m - (k + m * prior) b from t cross join tm),
 u as (select host, case when {x} > (a + 1) / (a + b + 2) then 1 - {_below(x, 'b', 'a', str(1 - x))} else {_below(x, 'a', 'b', str(x))} end below from tr), v as (select host, below >= {SURE} blocked from u),
 r as (select page_id, p.host, path, blocked, case when (p.host = 'example.org' or ends_with(p.host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1' when (p.host = 'example.org' or ends_with(p.host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
 when (p.host = 'com' or ends_with(p.host, '.com')) and starts_with(path, '/de/') then 'com/de/' when (p.host = 'com' or ends_with(p.host, '.com')) and starts_with(path, '/fr/') then 'com/fr/' when (p.host = 'org' or ends_with(p.host, '.org')) and starts_with(path, '/') then 'org/' end as rule from p join v on v.host = p.key)
 select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when blocked then 'block' else 'allow' end verdict from r"""


def _repetition_sql() -> str:
    shares = []
    for n, limit in sorted(NGRAM_LIMITS.items()):
        gram = " || ' ' || ".join(f"lead(w, {k}) over (partition by doc_id order by p)" if k else "w" for k in range(n))
        shares.append(
            f"g{n} as (select doc_id, p, count(*) over (partition by doc_id, g) c from (select doc_id, p, {gram} g from w) where g is not null), "
            f"s{n} as (select w.doc_id, sum(length(w)) b from w join (select distinct doc_id, p + i q from g{n} cross join (select unnest(generate_series(0, {n - 1})) i) where c > 1) x on x.doc_id = w.doc_id and x.q = w.p group by 1)"
        )
    joins = " ".join(f"left join s{n} on s{n}.doc_id = d.doc_id" for n in NGRAM_LIMITS)
    within = " and ".join(f"coalesce(s{n}.b, 0)::double / total <= {limit}" for n, limit in sorted(NGRAM_LIMITS.items()))
    return rf"""with d as (select doc_id, coalesce(text, '') t from documents), w as (select doc_id, unnest(ws) w, unnest(generate_series(1, len(ws))) p from (select doc_id, regexp_extract_all(t, '[^{BLANK}]+') ws from d)),
 n as (select doc_id, count(*) n_words, sum(length(w)) total from w group by 1),
 g3 as (select doc_id, p, count(*) over (partition by doc_id, g) c from (select doc_id, p, w || ' ' || lead(w, 1) over (partition by doc_id order by p) || ' ' || lead(w, 2) over (partition by doc_id order by p) g from w) where g is not null),
 r as (select doc_id, count(distinct p + i) n_repeat from g3 cross join (select unnest(generate_series(0, 2)) i) where c > 1 group by 1),
 l as (select doc_id, line, row_number() over (partition by doc_id, line) k from (select doc_id, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^{BLANK}]')),
 dl as (select doc_id, count(*) n_dup, sum(length(regexp_replace(line, '[{BLANK}]', '', 'g'))) b from l where k > 1 group by 1), {', '.join(shares)},
 a as (select d.doc_id, coalesce(n_words, 0) n_words, length(regexp_replace(t, '[{BLANK}]', '', 'g')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, coalesce(n_dup, 0) n_dup_lines, coalesce(n_repeat, 0) n_repeat_words,
 coalesce(coalesce(dl.b, 0)::double / total <= {LINE_LIMIT} and {within}, true) fine from d left join n on n.doc_id = d.doc_id left join r on r.doc_id = d.doc_id left join dl on dl.doc_id = d.doc_id {joins})
 select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words,
 n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and fine kept from a"""


NEAR = rf"""with recursive d as (select doc_id, regexp_extract_all({LOWER}, '[^{BLANK}]+') w from documents),
 s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) g from d),
 n as (select doc_id, count(*) n from s group by 1), i as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
 e as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
 r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b), c as (select a, least(min(b), a) m from r group by 1)
 select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, coalesce(m, d.doc_id) component_id, coalesce(m, d.doc_id) = d.doc_id kept from d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id"""

CHAT = r"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
 o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) k, lag(role) over (partition by conv_id order by turn nulls first, role, text) before from t),
 x as (select *, (before is null or before <> role)::int first, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) n, length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g')) r from o)
 select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) turns_sha256, cast(length(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as bigint) loss_chars,
 sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) loss_sha256, cast(sum(n + case when first = 1 then 24 + r else 8 end) as bigint) formatted_chars from x group by 1"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATION = rf"""with b as (select item_id, regexp_extract_all({LOWER}, '{WORD}') w from benchmark), d as (select doc_id, regexp_extract_all({LOWER}, '{WORD}') w from documents),
 v as (select distinct item_id, least(len(w), 10) n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') g from (select item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) s from b where len(w) > 0)), sizes as (select distinct n from v),
 p as (select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') g from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) s from d cross join sizes where len(w) >= n)),
 h as (select p.doc_id, p.s, p.n, v.item_id from p join v on v.g = p.g and v.n = p.n), k as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(generate_series(s, s + n - 1)) q from h) group by 1),
 i as (select doc_id, count(*) n_items, string_agg(x, ',' order by x) items from (select distinct doc_id, cast(item_id as varchar) x from h) group by 1)
 select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated from d left join k on k.doc_id = d.doc_id left join i on i.doc_id = d.doc_id"""

WARC = """with p as (select page_id, coalesce(html, '') h from pages), s as (select page_id, strlen(h) n, sha1(h) x from p), f as (select x, min(page_id) m from s group by 1)
 select page_id, cast(n as bigint) payload_bytes, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(s.x || '00', cast(5 * i // 4 + 1 as integer), 3) as integer) >> (7 - 5 * i % 4)) & 31 as integer) + 1, 1)), '') payload_digest,
 case when page_id = m then 'response' else 'revisit' end record_type, case when page_id <> m then m end refers_to from s join f on f.x = s.x"""

SETS = rf"""with recursive d as (select doc_id, regexp_extract_all({LOWER}, '[^{BLANK}]+') w from documents),
 s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) end) g from d),
 n as (select doc_id, count(*) n from s group by 1), i as (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
 e as (select a, b from i join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)),
 r(a, b) as (select a, b from e union select r.a, e.b from r join e on e.a = r.b), c as (select a, least(min(b), a) m from r group by 1)
 select d.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, coalesce(m, d.doc_id) component_id from d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id"""

PHRASES = rf"""with p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') w from (select coalesce(lang, 'und') lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) piece from documents)),
 n as (select lang, sum(len(w)) n from p group by 1), k as (select unnest(generate_series(1, 5)) k),
 f as (select lang, k, g, count(*) f from (select lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) g from p cross join k where len(w) >= k) group by 1, 2, 3 having count(*) >= 100),
 c as (select f.lang, f.k, g, f.f a, c, array_to_string(string_split(g, ' ')[:c], ' ') x, array_to_string(string_split(g, ' ')[c + 1:], ' ') y from (select *, unnest(generate_series(1, k - 1)) c from f where k > 1) f),
 s as (select c.lang, c.k, c.g, a, c, x.f l, y.f r, n, (1000 * a::hugeint * n::hugeint) // (x.f::hugeint * y.f::hugeint) score from c join f x on x.lang = c.lang and x.g = c.x join f y on y.lang = c.lang and y.g = c.y join n on n.lang = c.lang),
 b as (select * from s qualify row_number() over (partition by lang, g order by score, c) = 1),
 v as (select lang, max(f) f, h from (select lang, f, unnest([array_to_string(string_split(g, ' ')[:k - 1], ' '), array_to_string(string_split(g, ' ')[2:], ' ')]) h from f where k > 2) group by lang, h),
 o as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, g) rank from b left join v on v.lang = b.lang and v.h = b.g where v.f is null or v.f < a)
 select lang, cast(rank as bigint) rank, g phrase, cast(a as bigint) a, cast(l as bigint) l, cast(r as bigint) r, cast(n as bigint) n, cast(score as bigint) score from o where rank <= 2000"""

ORACLE = {"op2_url_reputation": _url_sql(), "op3_chat_format": CHAT, "op4_near_dedup": NEAR, "op5_decontaminate": CONTAMINATION, "op7_repetition": _repetition_sql(), "op9_warc": WARC, "op11_collocations": PHRASES, "op13_jaccard_join": SETS}
