"""Fragments of DuckDB-flavoured SQL used by the oracle strings."""

from __future__ import annotations

WS = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def clean(c: str) -> str:
    step = rf"regexp_replace({c}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g')"
    step = rf"regexp_replace({step}, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}\b', '[redacted-email]', 'g')"
    return squeeze(step)


def canon(c: str) -> str:
    return f"lower(trim('text ' || {clean(c)}))"


def fold(c: str, dstroke: bool = True) -> str:
    base = f"strip_accents(lower({c}))"
    if dstroke:
        base = f"replace({base}, 'đ', 'd')"
    return f"trim(regexp_replace({base}, '[^a-z0-9]+', ' ', 'g'))"


def tokens(c: str, min_len: int = 3) -> str:
    return f"list_distinct(list_filter(string_split({fold(c)}, ' '), lambda t: length(t) >= {min_len}))"


def words(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"


def hexnum(c: str, chars: int) -> str:
    return f"cast('0x' || substr({c}, 1, {chars}) as ubigint)"


def truncate(c: str, n: int) -> str:
    s = squeeze(c)
    return f"case when length({s}) > {n} then substr({s}, 1, {n - 1}) || '…' else {s} end"


# Accepted-corpus base: every document with its cleaned text and content hash.
DOCS = f"""docs as (
  select doc_id, source, lang, clean, canonical, length(canonical) as canon_len, sha256(canonical) as content_sha256
  from (select doc_id, source, lang, {clean('text')} as clean, {canon('text')} as canonical from documents)
  where length(canonical) >= 40)"""

# SimHash of every distinct document, over the DOCS base.
SHINGLE_LIST = "case when len(w) < 3 then w else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end"
_VOTES = ", ".join(f"sum(cast((h >> {b}) & 1 as bigint)) as s{b}" for b in range(64))
_BITS = " + ".join(f"(case when 2 * s{b} >= n then {1 << b}::ubigint else 0::ubigint end)" for b in range(64))
SIMHASH = f"""{DOCS},
  reps as materialized (select content_sha256, min(doc_id) as ord, count(*) as copies, min(canon_len) as canon_len,
    min(canonical) as canonical from docs group by content_sha256),
  hashed as (select ord, {hexnum('sha256(g)', 16)} as h from (
    select ord, unnest({SHINGLE_LIST}) as g from (select ord, {words('canonical')} as w from reps))),
  votes as (select ord, count(*) as n, {_VOTES} from hashed group by ord),
  sims as materialized (select r.ord, r.content_sha256, r.copies, r.canon_len,
    case when n is null then 18446744073709551615::ubigint else {_BITS} end as simhash
    from reps r left join votes v on v.ord = r.ord)"""
# Near-duplicate edges between classes of equal SimHash and length.
EDGES = f"""{SIMHASH},
  classes as materialized (select simhash, canon_len, min(ord) as ord from sims group by simhash, canon_len),
  edges as materialized (
    select a.ord as src, b.ord as dst, cast(bit_count(cast(xor(a.simhash, b.simhash) as bit)) as bigint) as distance
    from classes a join classes b on a.ord < b.ord
     and least(a.canon_len, b.canon_len) / greatest(a.canon_len, b.canon_len) >= 0.9
     and bit_count(cast(xor(a.simhash, b.simhash) as bit)) <= 3)"""
# The sequential scan, as a recursion that carries the rejected rows so far.
VERDICTS = f"""{EDGES},
  steps as materialized (select dst as ord, list(src) as nb, row_number() over (order by dst) as rn from edges group by dst),
  scan as (select 0::bigint as i, []::bigint[] as rej union all
    select scan.i + 1, case when len(list_filter(s.nb, lambda x: not list_contains(scan.rej, x))) > 0
      then list_append(scan.rej, s.ord) else scan.rej end
    from scan join steps s on s.rn = scan.i + 1),
  lost as materialized (select unnest(rej) as ord from (select rej from scan order by i desc limit 1)),
  kept as (select ord from classes where ord not in (select ord from lost)),
  verdicts as materialized (select s.ord, s.content_sha256, s.copies, s.canon_len, s.simhash, k.ord is null as near
    from sims s left join kept k on k.ord = s.ord)"""
