"""DuckDB SQL for the training-data queries that SQL can express whole: the same rows, found another way."""

from __future__ import annotations

from corpusloom.llm.ballkmeans import kmeans_sql
from corpusloom.llm.secrets import KINDS

def _encoded(url: str) -> str:
    """Control characters and spaces percent-encoded."""
    for k in [*range(0x21), 0x7F]:
        url = f"replace({url}, chr({k}), '%{k:02X}')"
    return url


WARC = f"""
with rows as (select page_id, {_encoded('url')} uri, strlen(coalesce(html, '')) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
firsts as (select payload_digest, min(page_id) first_id from rows where payload_bytes >= 100 group by payload_digest),
judged as (select rows.*, first_id, coalesce(first_id is not null and (page_id is null or page_id > first_id), false) again from rows left join firsts using (payload_digest))
select page_id, payload_bytes, payload_digest, if(again, 'revisit', 'response') record_type, if(again, first_id, null) refers_to,
    if(count(uri) over same < count(*) over same, null, min(uri) over same) request_uri, payload_bytes metadata_bytes
from judged window same as (partition by page_id, payload_digest)
"""


def _either_case(words: str) -> str:
    """A pattern of ASCII letters in either case; RE2's own flag would fold other letters onto them."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else c for c in words)


#: kind: (pattern, group of the value, least characters of the value).
PATTERNS = {
    "assign": ("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]{32,}", 0, 32),
    "opaque": ("[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20),
}


def _found(kind: str) -> str:
    """Matches of a kind, in texts that have any: they are fenced off, and every second piece between fences is one."""
    pattern, group, least = PATTERNS[kind]
    p, fence = "'" + pattern.replace("'", "''") + "'", "chr(1) || chr(57344) || chr(1)"
    return f"""
    select row, {KINDS.index(kind)} place, '{kind}' kind, (ends - length(piece))::bigint a, ends::bigint b, regexp_extract(piece, {p}, {group}) as value
    from (
        select row, i, pieces[i] piece, sum(length(pieces[i])) over (partition by row order by i) ends
        from (
            select row, generate_subscripts(pieces, 1) i, pieces
            from (
                select row, string_split(regexp_replace(text, '(' || {p} || ')', {fence} || '\\1' || {fence}, 'g'), {fence}) pieces
                from docs where regexp_matches(text, {p})
            )
        )
    )
    where i % 2 = 0 and length(regexp_extract(piece, {p}, {group})) >= {least}"""


SECRETS = f"""
with docs as materialized (select row_number() over () as row, doc_id, source, coalesce(text, '') as text from documents),
base as materialized ({" union all ".join(_found(k) for k in KINDS[:3])}),
runs as materialized (select * from ({_found("opaque")}) where regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')),
letters as (select row, a, n, count(*) k from (select row, a, length(value) n, unnest(string_split(value, '')) c from runs) group by row, a, n, c),
mixed as (select row, a from letters group by row, a having -sum(k / n * log2(k / n)) >= 3),
free as (select runs.* from runs semi join mixed using (row, a) anti join base on runs.row = base.row and base.a < runs.b and base.b > runs.a),
hits as materialized (select * from base union all select * from free),
held as (
    select value, count(distinct coalesce(doc_id::varchar, '')) <= 100 and count(distinct coalesce(source, '')) <= 1 live
    from hits join docs using (row) group by value
),
spans as (select row, place, kind, a, kind || ':' || a || ':' || b shown, live from hits join held using (value) where kind <> 'opaque' or live),
told as (
    select row, string_agg(shown, ',' order by a, place) spans, string_agg(shown, ',' order by a, place) filter (kind <> 'opaque') base,
        count(*) filter (kind = 'assign') n_assign, count(*) filter (kind = 'access') n_access, count(*) filter (kind = 'hex') n_hex, count(*) filter (live) n_live
    from spans group by row
)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256,
    coalesce(spans, '') spans, coalesce(n_live, 0) n_live
from docs left join told using (row)
"""


def resampling_sql(least_words: int = 20, share: int = 5, seed: int = 42, buckets: int = 10_000) -> str:
    """Importance resampling with CRC-32 as a fold over the bytes of each distinct n-gram."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    tokens = f"select doc_id, row, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from"
    step = "list_reduce([i::bigint, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: if(x & 1 = 1, xor(x >> 1, 3988292384), x >> 1))"
    byte = "('0x' || substr(hex(encode(gram)), 2 * i - 1, 2))::bigint"
    return f"""
with steps as materialized (select list_transform(range(256), lambda i: {step}) t),
rows as materialized ({tokens} (select row_number() over () as row, doc_id, text from documents) union all {tokens} (select -row_number() over () as row, null::bigint doc_id, text from benchmark)),
grams as materialized (
    select row, unnest(g) gram from (
        select row, flatten([w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])]) g
        from rows
    )
),
crcs as materialized (
    select gram, xor(list_reduce(list_transform(range(1, strlen(gram) + 1), lambda i: {byte}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {buckets} bucket
    from (select distinct gram from grams), steps
),
counts as materialized (select row, bucket, count(*) n from grams join crcs using (gram) group by row, bucket),
sums as materialized (
    select bucket, coalesce(sum(n) filter (row > 0), 0)::double s, coalesce(sum(n) filter (row < 0), 0)::double t
    from (select row, bucket, n from counts union all select 1, unnest(range({buckets})), 0) group by bucket
),
gains as (select bucket, floor(1000 * ln(((t + 1) * ((select sum(s) from sums) + {buckets})) / ((s + 1) * ((select sum(t) from sums) + {buckets}))))::bigint gain from sums),
weights as (select row, sum(n)::bigint n_features, sum(n * gain)::bigint weight from counts join gains using (bucket) where row > 0 group by row),
scored as materialized (
    select row, doc_id, len(w) >= {least_words} enough, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296)))::bigint score
    from rows left join weights using (row) where row > 0
),
places as (select row, row_number() over (order by score desc, doc_id nulls last, n_features, row) place from scored where enough)
select doc_id, n_features, weight, score, if(place <= (select count(*) * {share} // 100 from scored where enough), place, null) as rank
from scored left join places using (row)
"""


ORACLES = {"op5_warc": WARC, "op10_secrets": SECRETS, "op12_resampling": resampling_sql(), "op13_ballkmeans": kmeans_sql()}
