"""SQL twins of those text queries that SQL can express over whole tables."""

from __future__ import annotations

from leafloom.llm import canon


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical(column: str) -> str:
    """The one form of a text. The tables hold no letter whose own decomposition has a look-alike base, so one pass does."""
    table = canon.build_table()
    gone = "".join(c for c, t in table.items() if not t)
    one = {c: t for c, t in table.items() if len(t) == 1}
    out = f"translate({column}, {quoted(gone)}, '')"
    out = f"translate({out}, {quoted(''.join(one))}, {quoted(''.join(one.values()))})"
    for c, t in canon.LIGATURES.items():
        out = f"replace({out}, {quoted(c)}, {quoted(t)})"
    return f"nfc_normalize({out})"


def _look(table: str, row: str, text: str) -> str:
    rows = f"(select distinct {row} as id, {text} as t, {canonical(text)} as c from {table} where {row} is not null and {text} is not null)"
    return f"select '{table}' as tbl, a.id as id_a, b.id as id_b from {rows} a join {rows} b on a.c = b.c where a.id < b.id and a.t <> b.t"


def _repeated(table: str, source: str, doc: str, row: str, lines: str) -> str:
    key = r"regexp_replace(trim(regexp_replace(lower(line), '[\s\p{Z}]+', ' ', 'g')), '\p{Nd}+', '0', 'g')"
    return f"""select distinct '{table}' as tbl, k.row_id, k.line_no from (with n as (select {source} as source, count(distinct {doc}) as n from {table} where {source} is not null and {doc} is not null group by 1),
l as (select {source} as source, {doc} as doc, {row} as row_id, cast(i - 1 as bigint) as line_no, lines[i] as line from (select *, {lines} as lines from {table} where {source} is not null and {doc} is not null and text is not null), unnest(generate_series(1, len(lines))) u(i)),
k as (select *, {key} as key from l where length(regexp_replace(line, '\\P{{L}}+', '', 'g')) >= 12), g as (select k.source, key from k join n on n.source = k.source group by k.source, key, n.n having count(distinct doc) >= greatest(5, 0.1 * n.n)) select k.* from k join g on g.source = k.source and g.key = k.key) k"""


P1 = f"select distinct * from ({_look('documents', 'doc_id', 'text')} union all {_look('review_items', 'item_no', 'vision_text')})"
P2 = f"{_repeated('documents', 'source', 'doc_id', 'doc_id', 'string_split(text, chr(10))')} union all {_repeated('page_nodes', 'book_id', 'page_id', 'node_no', '[text]')}"
P3 = r"""with recursive s as (select sample_no, list_transform(regexp_extract_all(lower(coalesce(sample_id,'')) || ' ' || lower(coalesce(image_path,'')), '(?:^|[^a-z0-9])bk[^a-z0-9/\\]{0,2}0*([0-9]{1,15})', 1), lambda x: cast(x as bigint)) as codes, nullif(lower(trim(split_name)), '') as split from samples),
c as (select distinct sample_no, split, unnest(codes) as code from s), e as (select distinct a.code as u, b.code as v from c a join c b on a.sample_no = b.sample_no),
r(u, v) as (select u, v from e union select r.u, e.v from r join e on r.v = e.u), root as (select u as code, min(v) as root from r group by u),
x as (select distinct c.sample_no, c.split, root.root from c join root on root.code = c.code), mixed as (select root from x where split is not null group by root having count(distinct split) > 1)
select distinct sample_no, 'bk' || lpad(cast(root as varchar), 7, '0') as set_key from x where root in (select root from mixed)"""
P3_STATUS = r"""with recursive s as (select distinct sample_no, list_sort(list_distinct(list_transform(regexp_extract_all(lower(coalesce(sample_id,'')) || ' ' || lower(coalesce(image_path,'')), '(?:^|[^a-z0-9])bk[^a-z0-9/\\]{0,2}0*([0-9]+)', 1), lambda x: cast(x as bigint)))) as codes, nullif(lower(trim(split_name)), '') as split from samples),
c as (select distinct codes[1] as u, unnest(codes) as v from s), e as (select u, v from c union select v, u from c), r(u, v) as (select u, v from e union select r.u, e.v from r join e on r.v = e.u), root as (select u as code, min(v) as root from r group by u),
x as (select s.*, len(codes) = 0 as bare, case when len(codes) = 0 then 'record:' || coalesce(cast(sample_no as varchar), '') else 'bk' || lpad(cast(root.root as varchar), 7, '0') end as entity from s left join root on root.code = s.codes[1]),
held as (select entity, split from x where split is not null union select x.entity, g.split from x join x g on g.bare and g.split is not null and g.sample_no is not distinct from x.sample_no), state as (select entity, min(split) as lo, max(split) as hi from held group by entity)
select distinct sample_no, x.entity as set_key, case when lo is null then 'new' when lo = hi then 'kept' else 'quarantined' end as status, case when lo = hi then lo end as kept_split from x left join state on state.entity = x.entity"""
P8 = f"""with w as (select doc_id as id, regexp_extract_all(lower({canonical('text')}), '[\\p{{L}}\\p{{N}}]+') as w from documents where text is not null), i as (select item_id as id, regexp_extract_all(lower({canonical('passage')}), '[\\p{{L}}\\p{{N}}]+') as w from test_items where passage is not null),
dg as (select distinct id, array_to_string(w[cast(k as int):cast(k + 12 as int)], ' ') as g from w, unnest(generate_series(1, len(w) - 12)) u(k)), ig as (select distinct id, array_to_string(w[cast(k as int):cast(k + 12 as int)], ' ') as g from i, unnest(generate_series(1, len(w) - 12)) u(k)) select distinct dg.id as doc_id, ig.id as item_id from dg join ig on dg.g = ig.g"""
P4 = r"""with s as (select distinct sample_no, lower(trim(split_name)) as split, regexp_replace(lower(strip_accents(array_to_string(text_lines, ' '))), '[^\p{L}\p{N}]', '', 'g') as t from samples where sample_no is not null and text_lines is not null),
k as (select t, length(t) as n, bool_or(split = 'train') as a, bool_or(split <> 'train') as b from s where length(t) >= 40 and split in ('train', 'eval', 'test') group by t),
near as (select a.t as ta, b.t as tb from k a join k b on a.a and b.b and abs(a.n - b.n) <= 0.15 * greatest(a.n, b.n) where levenshtein(a.t, b.t) <= 0.15 * greatest(a.n, b.n))
select distinct least(x.sample_no, y.sample_no) as sample_a, greatest(x.sample_no, y.sample_no) as sample_b from near join s x on x.t = ta and x.split = 'train' join s y on y.t = tb and y.split in ('eval', 'test') where x.sample_no <> y.sample_no"""
