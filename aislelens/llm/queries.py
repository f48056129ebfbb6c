"""Queries of the corpus operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import licenses
from .align import alignment_links
from .common import new_folder, table
from .html_text import extract_text
from .mixing import REPEATS, SHARE, mix_documents
from .near_dedup import near_duplicates
from .packing import pack_documents
from .repeats import deduplicate_documents
from .store import stored_documents, write_store
from .tokens import vocabulary
from .topk import exact_topk
from .toxicity import score_toxicity
from .variants import document_words, spelling_variants
from .vector_dedup import embedding_duplicates
from .warc import read_archives, resolved_pages, write_archives

Query = Callable[[SparkSession, str], DataFrame]


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "store")
    write_store(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder)
    return stored_documents(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), folder)
    return resolved_pages(read_archives(manifest, folder, payloads=False))


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": lambda s, d: score_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op2_exact_topk": lambda s, d: exact_topk(table(s, d, "embeddings")),
        "op3_html_extraction": lambda s, d: extract_text(table(s, d, "pages")),
        "op4_near_dedup": lambda s, d: near_duplicates(table(s, d, "documents")),
        "op5_embedding_dedup": lambda s, d: embedding_duplicates(table(s, d, "embeddings")),
        "op6_mixing": lambda s, d: mix_documents(table(s, d, "documents")),
        "op7_packing": lambda s, d: pack_documents(table(s, d, "documents"), vocabulary("byte_bpe_50k.json")),
        "op8_token_store": op8,
        "op9_licenses": lambda s, d: licenses.scan_licenses(table(s, d, "documents")),
        "op10_suffix_dedup": lambda s, d: deduplicate_documents(table(s, d, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"),
        "op11_token_alignment": lambda s, d: alignment_links(table(s, d, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")),
        "op12_spelling_variants": lambda s, d: spelling_variants(document_words(table(s, d, "documents"), drop_one_in=31)),
        "op13_warc": op13,
    }


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _licence_sql() -> str:
    """The rules as DuckDB SQL: one CTE a rule."""
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.known_sentences().items())
    longest = max(map(len, licenses.known_sentences())) * 2
    sql = f"""
with known(sentence, name) as (values {known}),
pieces as (
  select doc_id, row_no, unnest(string_split_regex(text, '[.!?;]+[ \\t\\r\\n]+|[.!?;]*[\\r\\n]+|[.!?;]+$')) as s,
         generate_subscripts(string_split_regex(text, '[.!?;]+[ \\t\\r\\n]+|[.!?;]*[\\r\\n]+|[.!?;]+$'), 1) as place
  from (select doc_id, row_number() over () as row_no, coalesce(text, '') as text from documents)
),
named as (
  select p.row_no, p.place, k.name from pieces p join known k
    on k.sentence = trim(regexp_replace(lower(p.s), '[^a-z0-9]+', ' ', 'g'))
  where length(p.s) <= {longest}
),
ids(lower_, id) as (values {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in licenses.known_ids().items())}),
words as (
  select row_no, unnest(w) as word, generate_subscripts(w, 1) as place
  from (select row_number() over () as row_no, list_transform(string_split_regex(lower(array_to_string(regexp_extract_all(text, {_quoted(licenses.EXPRESSION)}, 1), ' ')), {_quoted(licenses.BETWEEN)}), lambda x: rtrim(x, '.')) as w from documents)
),
declared as (select row_no, list(id order by place) as ids from (select row_no, id, min(place) as place from words join ids on word = lower_ group by all) group by row_no),
seqs as (select row_no, count(*) as n, string_agg(name, ',' order by place) as ids from named group by row_no),
r0 as (
  select d.doc_id, coalesce(e.ids, []) as declared, coalesce(s.n, 0) as n_sentences, coalesce(s.ids, '') as sentence_ids, '' as got, case when s.ids is null then ',' else ',' || s.ids || ',' end as rest
  from (select doc_id, row_number() over () as row_no from documents) d left join seqs s using (row_no) left join declared e using (row_no)
)"""
    for k, (name, sequence) in enumerate(licenses.RULES):
        needle = _quoted("," + ",".join(sequence) + ",")
        new = _quoted("," + name)
        sql += f""",
r{k + 1} as (
  select doc_id, declared, n_sentences, sentence_ids,
         case when contains(rest, {needle}) and not contains(got || ',', {_quoted("," + name + ",")}) then got || {new} else got end as got,
         replace(rest, {needle}, ',') as rest
  from r{k}
)"""
    kinds = " ".join(f"when list_has_any(names, [{', '.join(map(_quoted, members))}]) then {_quoted(kind)}" for kind, members in licenses.KINDS.items())
    return sql + f"""
select doc_id, n_sentences, sentence_ids, array_to_string(names, ',') as licenses,
       case when len(names) = 0 then 'none' {kinds} else 'permissive' end as category
from (select *, list_concat(hits, list_filter(declared, lambda x: not list_contains(hits, x))) as names
      from (select *, case when got = '' then [] else string_split(substr(got, 2), ',') end as hits from r{len(licenses.RULES)}))"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
        "op5_embedding_dedup": """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93
),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select e.vec_id, coalesce(n.n, 0) as n_links, least(e.vec_id, coalesce(c.m, e.vec_id)) as component_id,
       e.vec_id = least(e.vec_id, coalesce(c.m, e.vec_id)) as kept
from embeddings e
left join (select a, count(*) as n from links group by a) n on n.a = e.vec_id
left join (select a, min(b) as m from reach group by a) c on c.a = e.vec_id""",
        "op6_mixing": f"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as order_key
  from documents
),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select *, cast([5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as double) as weight,
         cast(source_size * {REPEATS} as double) as cap
  from s
),
r as (
  select *, sum(cap) over (order by cap / weight) as full_, coalesce(sum(weight) over (order by cap / weight desc range unbounded preceding), 0) as open_,
         (select sum(source_size) * {SHARE} from s) as demand
  from w
),
u as (select min(cap / weight) as upper_ from (select cap, weight, full_, demand, (select coalesce(sum(x.weight), 0) from w x where x.cap / x.weight > r.cap / r.weight) as more from r) where full_ + more * (cap / weight) >= demand),
l as (
  select ((select sum(source_size) * {SHARE} from s) - coalesce(sum(case when cap / weight < upper_ then cap end), 0))
         / sum(case when cap / weight >= upper_ then weight end) as level
  from w, u
),
t as (select source, source_size, coalesce(least(cap, weight * level), 0.0) as target from w, l),
p as (
  select d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) over (partition by d.source order by d.order_key rows between unbounded preceding and 1 preceding), 0) as begin_
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       cast(greatest(0, least(size, round(target) - begin_)) + greatest(0, least(size, round(target) - begin_ - source_size)) as bigint) as taken
from p""",
        "op9_licenses": _licence_sql(),
        "op13_warc": """
with p as (select page_id, coalesce(html, '') as html from pages),
w as (
  select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest,
         row_number() over (partition by html order by page_id) as rn, min(page_id) over (partition by html) as first_page
  from p
)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and rn > 1 then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and rn > 1 then first_page end as refers_to
from w""",
    }
