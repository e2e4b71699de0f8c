"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations


def _table() -> list[int]:
    """The byte table of CRC-32 (reflected polynomial 0xEDB88320)."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (x & 1) * 0xEDB88320
        out.append(x)
    return out


def crc32(codes: str) -> str:
    """SQL of the CRC-32 of a list of byte values."""
    step = f"xor(a >> 8, ({_table()}::BIGINT[])[1 + (xor(a, b) & 255)])"
    return f"xor(list_reduce({codes}, lambda a, b: {step}, 4294967295::BIGINT), 4294967295)"


def ascii_codes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"


BYTE_SHARDS = f"""
with bytes as (
    select doc_id, coalesce(octet_length(encode(text)), 0) + 1 as size, hex(encode(coalesce(text, ''))) as h from documents
), sized as (
    select doc_id, size, {crc32("list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)")} as text_crc32 from bytes
), placed as (
    select *, coalesce(sum(size) over (w rows between unbounded preceding and 1 preceding), 0) as start, sum(size) over () as total from sized window w as (order by doc_id nulls first)
), dealt as (
    select *, cast(least(15, ((start * 2 + size) * 16) // (2 * total)) as integer) as shard from placed
)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by start) - 1 as slot, cast(null as integer) as grown_shard from dealt
"""

PREFIX_TRIE = f"""
with turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as pos
    from conversations where conv_id is not null
), convs as (
    select conv_id, conv_id - conv_id % 100 as giver, {crc32(ascii_codes("cast(conv_id as varchar)"))} % 6 as h from (select distinct conv_id from turns)
), parts as (
    select c.conv_id, 0 as own, pos, role, text from convs c join turns t on t.conv_id = c.giver and pos < h
    union all select c.conv_id, 1, pos, role, text from convs c join turns t on t.conv_id = c.conv_id and pos >= h
), built as (
    select c.conv_id, coalesce(s, []) as s from convs c
    left join (select conv_id, list({{'role': role, 'text': text}} order by own, pos) as s from parts group by conv_id) p on p.conv_id = c.conv_id
), steps as (
    select conv_id, len(s) as size, unnest(range(0, len(s) + 1)) as d, s from built
), nodes as (
    select list_slice(s, 1, d) as p, d as depth, min(conv_id) as conv_id, count(*) as n, list(conv_id order by conv_id) filter (where size = d) as ends
    from steps group by list_slice(s, 1, d), d
), kids as (
    select list_slice(p, 1, depth - 1) as p, depth - 1 as depth, count(*) as k from nodes where depth > 0 group by 1, 2
), own as (
    select n.*, coalesce(k, 0) as k, case when n.depth = 0 then 0 else (n - 1) * length(n.p[n.depth].text) end as cost
    from nodes n left join kids on kids.depth = n.depth and kids.p = n.p
), sums as (
    select a.p, a.depth, count(*) filter (where b.k = 0) as leaves, sum(b.cost) as saved
    from own a join own b on b.depth >= a.depth and list_slice(b.p, 1, a.depth) = a.p group by a.p, a.depth
)
select o.conv_id, o.depth, u.conv_id as parent_conv_id, o.n as n_convs, o.k as n_children, leaves as n_leaves, cast(saved as bigint) as saved_tokens,
    sha256(coalesce(array_to_string(o.ends, ','), '')) as ends_sha256
from own o join sums s on s.depth = o.depth and s.p = o.p left join own u on u.depth = o.depth - 1 and u.p = list_slice(o.p, 1, o.depth - 1)
"""

PIVOT_INDEX = """
with recursive good as (
    select vec_id, cast(embedding as double[]) as e from embeddings
    where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0
), links as (
    select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
), reach as (
    select vec_id as v, vec_id as c from embeddings union select r.v, l.b from reach r join links l on l.a = r.c
), least as (select v, min(c) as c from reach group by v)
select vec_id, (select count(*) from links where a = vec_id) as n_links, c as component_id, vec_id = c as kept from embeddings join least on v = vec_id
"""


def _add(state: str, cost: int | str, edit: str, turn: str = "''") -> str:
    """A (cost, audit, text) string with an edit added; null stays null."""
    audit, text = f"split_part(substr({state}, 11), chr(1), 1)", f"split_part({state}, chr(1), 2)"
    return f"lpad(cast(cast(left({state}, 10) as integer) + {cost} as varchar), 10, '0') || {audit} || '{edit}' || chr(1) || {text} || {turn}"


def _structure_repair() -> str:
    """The cheapest edits row by row: a state's best (cost, audit) is a string whose order is theirs."""
    ins_u, ins_a = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    two = f"least(s2, {_add('s0', 3, 'I', ins_u)}, {_add('s1', 3, 'I', ins_u)}, {_add('s3', 3, 'I', ins_u)})"
    own = "chr(10) || role || ':' || text"
    steps = {("s0", "s"): "s1", ("s0", "u"): "s2", ("s1", "u"): "s2", ("s2", "a"): "s3", ("s3", "u"): "s2"}
    new = {}
    for q in ("s0", "s1", "s2", "s3"):
        ways = [_add(q, 4, "D")]
        for (p, c), to in steps.items():
            if to == q:
                ways.append(f"case when ok and init = '{c}' then {_add(p, 'extra', 'K', own)} end")
                if c != "s":
                    turn = f"{ins_u if c == 'u' else ins_a} || text"
                    ways.append(f"case when ok then {_add(p, '3 + extra', 'R', turn)} end")
        new[q] = f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]
    fault = crc32(ascii_codes("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')"))
    ink = r"[^\x20\x09-\x0D]"
    return f"""
with recursive marked as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {fault} % 20 as f from conversations
), damaged as (
    select conv_id, turn, case when f = 4 then 'user' else role end as role, case when f = 1 then '' when f = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
        unnest(case when f = 3 then [0, 1] else [0] end) as copy
    from marked where f <> 0
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos from damaged
), told as (
    select *, left(role, 1) as init, lag(left(role, 1)) over (partition by conv_id order by pos) as before, not regexp_matches(text, '{ink}') as blank,
        row_number() over (partition by conv_id, role, text order by pos) > 1 as again, regexp_extract(text, '({ink})[\\x20\\x09-\\x0D]*$', 1) not in ('.', '!', '?') as torn
    from placed
), rows as (
    select *, not blank and not again as ok, case when torn then 3 else 0 end as extra from told
), facts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate,
        count(*) filter (where torn and ok) as truncated, count(*) filter (where before is not null and before || init not in ('su', 'ua', 'au')) as illegal, max(pos) as last
    from rows group by conv_id
), best as (
    select distinct conv_id, cast(0 as bigint) as pos, '0000000000' || chr(1) as s0, cast(null as varchar) as s1, cast(null as varchar) as s2, cast(null as varchar) as s3 from conversations
    union all
    select conv_id, pos, {new['s0']}, {new['s1']}, {new['s2']}, {new['s3']} from (
        select b.conv_id, r.pos, role, text, init, ok, extra, s0, s1, t2 as s2, least(s3, {_add('t2', 3, 'I', ins_a)}) as s3
        from (select *, {two} as t2 from best) b join rows r on r.conv_id is not distinct from b.conv_id and r.pos = b.pos + 1)
), ended as (
    select conv_id, pos, least(s0, s3, {_add('t2', 3, 'I', ins_a)}) as s from (select *, {two} as t2 from best)
)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
    cast(left(s, 10) as bigint) as cost, split_part(substr(s, 11), chr(1), 1) as audit, sha256(substr(split_part(s, chr(1), 2), 2)) as repaired_sha256
from ended e left join facts f on f.conv_id is not distinct from e.conv_id where e.pos = coalesce(f.last, 0)
"""


STRUCTURE_REPAIR = _structure_repair()
