"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, archives, conversations, divergence, licenses, line_dedup, mixing, near_dedup, packing, secrets, token_counts, toxicity, vector_graph
from .common import read, stage


def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Per document: how many lines went as exact or near duplicates, and the text that stays."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", F.col("_exact").alias("n_exact"), F.col("_near").alias("n_near"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.scored(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    arcs = stage(archives.write_arc(read(spark, sf, "pages")), "arc")
    return archives.convert(arcs).where("record_type <> 'warcinfo'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf, "documents"))


def op5_ann(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(read(spark, sf, "embeddings"))


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.secret_digest(read(spark, sf, "documents"))


def op8_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_components(read(spark, sf, "documents"))


def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.rollup_documents(read(spark, sf, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vector_graph.near_vectors(read(spark, sf, "embeddings"))


def op11_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergence(read(spark, sf, "documents"))


def op12_licenses(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.license_digest(read(spark, sf, "documents"))


def op13_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair_damaged(read(spark, sf, "conversations"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_warc, op4_packing, op5_ann, op6_mixing, op7_secrets, op8_near_dedup, op9_token_counts, op10_embedding_dedup, op11_divergence, op12_licenses, op13_conversations)}

_OP1 = r"""
with recursive cut as (
  select doc_id, string_split(text, chr(10)) ls from documents
), lines as (
  select doc_id, unnest(ls) raw, unnest(range(len(ls))) no from cut
), el as (
  select doc_id::hugeint * 2147483648 + no as place, trim(raw) line from lines where length(trim(raw)) >= 20
), firsts as (
  select line, min(place) place from el group by line
), del as (
  select place, i, hash(substr(line, 1, i - 1) || substr(line, i + 1)) h
  from (select place, line, unnest(range(1, length(line) + 1)) i from firsts)
), pairs as (
  select a.place p, b.place q from del a join del b on a.h = b.h and a.i = b.i and a.place <> b.place
  union all select d.place, f.place from del d join firsts f on d.h = hash(f.line)
  union all select f.place, d.place from del d join firsts f on d.h = hash(f.line)
), near as (
  select distinct p from pairs where q < p
), tagged as (
  select l.doc_id, l.no, l.raw,
    coalesce(l.doc_id::hugeint * 2147483648 + l.no > f.place, false) ex,
    coalesce(l.doc_id::hugeint * 2147483648 + l.no = f.place and n.p is not null, false) nr,
    n.p is not null gone
  from lines l
  left join firsts f on f.line = trim(l.raw)
  left join near n on n.p = f.place
)
select d.doc_id, coalesce(sum(ex::int), 0)::bigint n_exact, coalesce(sum(nr::int), 0)::bigint n_near,
  sha256(coalesce(string_agg(raw, chr(10) order by no) filter (where not ex and not nr), '')) kept_sha256
from documents d left join tagged t on t.doc_id = d.doc_id group by d.doc_id
"""

_OP3 = """
with p as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint payload_bytes, sha256(coalesce(html, '')) payload_digest from pages
), f as (select *, min(page_id) over (partition by payload_digest) first from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and first <> page_id then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 100 and first <> page_id then first end refers_to
from f
"""

_OP6 = r"""
with sized as (
  select doc_id, source, md5(doc_id::varchar || '/0') k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents
), src as (
  select source, sum(size)::bigint source_size, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] w from sized group by source
), room as (
  select *, 3 * source_size cap, sum(source_size) over () total from src
), lim as (
  select *, sum(w) over () - coalesce(sum(w) over b, 0) left_w, coalesce(sum(cap) over b, 0) full_cap from room
  window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)
), filled as (
  select *, (total - full_cap) * w >= cap * left_w fills from lim
), agg as (
  select *, sum(case when fills then cap else 0 end) over () cs, sum(case when fills then 0 else w end) over () ws from filled
), tgt as (
  select source, source_size, case when fills then cap::double else (total - cs)::double * w::double / ws::double end target from agg
), plan as (
  select *, row_number() over (order by source nulls last) source_no, round(target)::bigint want, greatest(1, round(source_size / 512))::bigint n_blocks from tgt
), slots as (
  select *, case when source_size = 0 then 0 else want // source_size * n_blocks + ceil(want % source_size * n_blocks / source_size) end::bigint n_slots from plan
), cum as (
  select *, sum(n_slots) over (order by source_no) hi, sum(n_slots) over () total from slots
), points as (
  select t, (t + 1) * 0.6180339887498949::double - floor((t + 1) * 0.6180339887498949::double) x from range((select coalesce(max(total), 0) from cum)::bigint) r(t)
), hit as (
  select source_no, t slot, row_number() over (partition by source_no order by t) - 1 as rank
  from points join cum on x >= (hi - n_slots)::double / total and x < hi::double / total
), late as (
  select source_no, unnest(range((select count(*) from hit h where h.source_no = c.source_no), n_slots)) as rank, total from cum c
), turns as (
  select source_no, slot, rank from hit union all select source_no, (total + rank)::bigint, rank from late
), doc as (
  select s.*, p.source_no, p.source_size, p.target, p.want, p.n_blocks,
    coalesce(sum(size) over (partition by s.source order by k, size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from sized s join plan p on s.source is not distinct from p.source
), mixed as (
  select *, case when source_size = 0 then 0 else want // source_size * size + greatest(0, least(start + size, want % source_size) - start) end::bigint taken,
    case when size > 0 then ((start + 1) * n_blocks - 1) // source_size end first_block
  from doc
)
select doc_id, size, source_size, target, taken, case when taken > 0 then slot end::bigint first_slot
from mixed m left join turns t on t.source_no = m.source_no and t.rank = m.first_block
"""


def _op7_sql() -> str:
    rules = secrets.RULES
    text = "coalesce(text, '')"
    parts = []
    for i, r in enumerate(rules):
        rx = r.regex.replace("'", "''")
        parts.append(
            f"select doc_id, {i} no, '{r.kind}' kind, {r.least} least, regexp_extract_all({text}, '{rx}', 0) hit, "
            f"regexp_extract_all({text}, '{rx}', {r.group}) val, string_split_regex({text}, '{rx}') gap from documents"
        )
    counts = ", ".join(f"count(*) filter (where no = {i})::bigint n_{r.kind}" for i, r in enumerate(rules) if r.base)
    last = max(i for i, r in enumerate(rules) if r.base)
    return f"""
with found as ({" union all ".join(parts)}
), one as (
  select doc_id, no, kind, least, hit, gap, val, unnest(range(1, len(hit) + 1)) i from found
), spans as (
  select doc_id, no, kind, length(hit[i]) n,
    list_sum(list_transform(gap[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0)::bigint pos
  from one where length(val[i]) >= least
), text as (
  select doc_id, no, pos, kind || ':' || pos || ':' || (pos + n) t from spans
)
select d.doc_id, {counts},
  sha256(coalesce(string_agg(t, ',' order by pos, no) filter (where no <= {last}), '')) base_sha256,
  coalesce(string_agg(t, ',' order by pos, no), '') spans
from documents d left join text using (doc_id) group by d.doc_id
"""


_OP8 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end sh from w
), n as (select doc_id, len(sh)::bigint n from s),
e as (select doc_id, hash(unnest(sh)) h from s),
common as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach(id, to_id) as (
  select doc_id, doc_id from n
  union select r.id, l.b from reach r join both_ways l on l.a = r.to_id
)
select n.doc_id, n.n n_shingles, min(to_id)::bigint component_id, n.doc_id = min(to_id) kept
from n join reach r on r.id = n.doc_id group by n.doc_id, n.n
"""

_OP10 = """
with recursive v as (
  select vec_id, embedding::double[] e from embeddings where embedding is not null
), ok as (
  select * from v where list_aggregate(list_transform(e, lambda x: case when x is null or isnan(x) or isinf(x) then 1 else 0 end), 'sum') = 0
    and list_aggregate(list_transform(e, lambda x: abs(x)), 'max') > 0
), links as (
  select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95
), reach(id, to_id) as (
  select vec_id, vec_id from embeddings union select r.id, l.b from reach r join links l on l.a = r.to_id
), c as (select id, min(to_id) component_id from reach group by id)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id)::bigint n_links, c.component_id, e.vec_id = c.component_id kept
from embeddings e join c on c.id = e.vec_id
"""

_OP11 = r"""
with d as (
  select coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ws from documents
), g as (select distinct lang, source from d
), kept as (
  select lang, term from (select lang, unnest(list_distinct(ws)) term from d) group by all having count(*) >= 10
), n as (
  select lang, source, term, count(*)::hugeint c from (select lang, source, unnest(ws) term from d) group by all
), v as (select lang, count(*)::hugeint v from kept group by lang
), cells as (
  select g.lang, g.source, kept.term, coalesce(n.c, 0)::hugeint c
  from g join kept using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = kept.term
), p as (
  select lang, source, term, c, 1 + (1000000000::hugeint * (c + 2)) // (sum(c) over (partition by lang, source)::hugeint + 2 * v) p
  from cells join v using (lang)
), whole as (select lang, term, sum(c)::hugeint c from cells group by all
), q as (
  select lang, term, 1 + (1000000000::hugeint * (c + 2)) // (sum(c) over (partition by lang)::hugeint + 2 * v) q from whole join v using (lang)
), sums as (
  select x.lang, x.source, y.source item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) f
  from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all
), pairs as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
  select lang, source, 'term' part, term item, (((p - q) * (p - q)) // (p + q))::bigint as value from p join q using (lang, term) where c > 0 and p > q
)
select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= 10
"""

# forward over turns: a struct (cost, audit, text) for each of the four states; ways are compared by cost, then audit
_OP13 = r"""
with recursive keyed as (
  select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') k from conversations
), crc as (
  select k, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(k, ''), lambda c: ascii(c)::ubigint)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), list_transform(range(8), lambda i: i::ubigint)),
      lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end)), 4294967295::ubigint) % 20 hit
  from (select distinct k from keyed)
), damaged as (
  select conv_id, turn, case when hit = 4 then 'user' else coalesce(role, ' ') end role,
    case hit when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text,
    unnest(range(case hit when 0 then 0 when 3 then 2 else 1 end)) dup
  from keyed join crc using (k)
), turns as (
  select *, row_number() over (partition by conv_id, role, text order by turn nulls first) > 1 again from damaged
), seq as (
  select *, left(role, 1) i, row_number() over (partition by conv_id order by turn nulls first, role, text, again) no,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1 when again then 2 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 3 else 0 end fault
  from turns
), facts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (where fault = 1) blank,
    count(*) filter (where fault = 2) duplicate, count(*) filter (where fault = 3) truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) illegal, max(no) last
  from (select *, lag(i) over (partition by conv_id order by no) || i pair from seq) group by conv_id
), walk as (
  select distinct conv_id, 0::bigint no, {'c': 0, 'a': '', 't': ''} n, {'c': 1000000000, 'a': '', 't': ''} s,
    {'c': 2, 'a': 'I', 't': 'user:'} u, {'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'} a from conversations
  union all
  select conv_id, no, n, s, u2, list_min([a1, {'c': u2.c + 2, 'a': u2.a || 'I', 't': u2.t || chr(10) || 'assistant:'}]) from (
    select *, list_min([u1, {'c': n.c + 2, 'a': n.a || 'I', 't': case when n.t = '' then '' else n.t || chr(10) end || 'user:'},
      {'c': s.c + 2, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'}, {'c': a1.c + 2, 'a': a1.a || 'I', 't': a1.t || chr(10) || 'user:'}]) u2
    from (
      select w.conv_id, r.no, {'c': w.n.c + 3, 'a': w.n.a || 'D', 't': w.n.t} n,
        list_min([{'c': w.s.c + 3, 'a': w.s.a || 'D', 't': w.s.t}, {'c': w.n.c + more + if(i = 's', 0, 1000000000), 'a': w.n.a || 'K', 't': r.role || ':' || r.text}]) s,
        list_min([{'c': w.u.c + 3, 'a': w.u.a || 'D', 't': w.u.t}] || list_transform([w.n, w.s, w.a], lambda x:
          {'c': x.c + more + if(i = 'u', 0, 2), 'a': x.a || if(i = 'u', 'K', 'R'), 't': case when x.a = '' or x.t = '' then '' else x.t || chr(10) end || if(i = 'u', r.role, 'user') || ':' || r.text})) u1,
        list_min([{'c': w.a.c + 3, 'a': w.a.a || 'D', 't': w.a.t},
          {'c': w.u.c + more + if(i = 'a', 0, 2), 'a': w.u.a || if(i = 'a', 'K', 'R'), 't': w.u.t || chr(10) || if(i = 'a', r.role, 'assistant') || ':' || r.text}]) a1
      from walk w join (select *, case when fault in (1, 2) then 1000000000 when fault = 3 then 1 else 0 end more from seq) r
        on r.conv_id is not distinct from w.conv_id and r.no = w.no + 1
    )
  )
), ends as (
  select w.conv_id, list_min([n, a]) best from walk w left join facts f on f.conv_id is not distinct from w.conv_id where w.no = coalesce(f.last, 0)
)
select e.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate, coalesce(truncated, 0)::bigint truncated,
  coalesce(illegal, 0)::bigint illegal, best.c::bigint as cost, best.a audit, sha256(best.t) repaired_sha256
from ends e left join facts f on f.conv_id is not distinct from e.conv_id
"""

ORACLE_SQL = {"op1_line_dedup": _OP1, "op3_warc": _OP3, "op6_mixing": _OP6, "op7_secrets": _op7_sql(), "op8_near_dedup": _OP8, "op10_embedding_dedup": _OP10, "op11_divergence": _OP11, "op13_conversations": _OP13}
