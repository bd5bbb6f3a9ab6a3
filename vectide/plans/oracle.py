"""The registered queries again, as SQL over the same tables.

Used only to check results; written from the operators' rules, not from
their Spark form.
"""

from __future__ import annotations

from vectide.plans.inputs import DATABASES, DIM, EXTRACTED_SQL, FREE_SIDECAR_SQL, FREE_VECTORS_SQL, LATENCY_SQL, NOISE_SQL, SCALED_SQL, SIDECAR_SQL
from vectide.plans.registered import ITERATIONS

# Patterns of the cleaner and of the hash encoder.
HYPHENATED = r"([\p{L}\p{N}_]+)-([\p{L}\p{N}_]+)"
BREAKS = r"[^\p{L}\p{N}_]+"


def collapse(t: str) -> str:
    return f"regexp_replace({t}, ' {{2,}}', ' ', 'g')"


def strip_breaks(t: str) -> str:
    return f"replace(replace(replace({t}, chr(10), ''), '.,', '.'), chr(9), '')"


def join_words(t: str) -> str:
    return rf"regexp_replace({t}, '{HYPHENATED}', '\1\2', 'g')"


def strip_marks(t: str) -> str:
    return rf"regexp_replace({t}, '\(cid:\p{{Nd}}+\)', ' ', 'g')"


def cleaned(source: str, key: str, text: str = "text") -> str:
    """Subquery ``key, text``: passes repeat while double spaces are left."""
    once = strip_marks(join_words(strip_breaks(collapse(text))))
    again = strip_marks(join_words(strip_breaks(collapse("text"))))
    return f"""(
      with recursive passes as (
        select {key}, {once} as text, 1 as pass from {source}
        union all
        select {key}, {again}, pass + 1 from passes where contains(text, '  ')
      )
      select {key}, case when starts_with(text, ' ') then substr(text, 2) else text end as text
      from passes where not contains(text, '  ')
    )"""


def chunks(source: str, columns: str, size: int = 1000, overlap: int = 20) -> str:
    step = size - overlap
    return f"""(
      select {columns}, k as chunk, substring(text, (k - 1) * {step} + 1, {size}) as text
      from (select *, unnest(range(1, cast(ceil(length(text) / {step}.0) as bigint) + 1)) as k from {source})
    )"""


def embedded(source: str, key: str) -> str:
    """Subquery ``key, pos, x``: 64 elements per row of ``source(key, text)``, rounded to float."""
    return f"""(
      with source as (select {key}, text from {source}),
      tokens as (select {key}, unnest(string_split_regex(lower(text), '{BREAKS}')) as token from source),
      codes as (
        select {key}, cast('0x' || substr(md5(token), 1, 8) as bigint) % {2 * DIM} as code
        from tokens where token <> ''
      ),
      sums as (
        select {key}, code % {DIM} as pos, sum(case when code < {DIM} then 1 else -1 end) as total
        from codes group by all
      ),
      norms as (select {key}, sqrt(cast(sum(total * total) as double)) as norm from sums group by all)
      select g.{key}, g.pos,
        cast(case when n.norm > 0 then coalesce(s.total, 0) / n.norm else 0 end as float) as x
      from (select {key}, unnest(range({DIM})) as pos from source) g
      left join sums s on s.{key} = g.{key} and s.pos = g.pos
      left join norms n on n.{key} = g.{key}
    )"""


def embedded_lists(source: str, key: str) -> str:
    return f"(select {key}, list(cast(x as double) order by pos) as vector from {embedded(source, key)} group by {key})"


def top(stored: str, asked: str, metric: str, where: str = "true", k: int = 5) -> str:
    """Hits of ``asked(query_id, vector)`` on ``stored(id, values)``, lists of any float type."""
    raw = "list_inner_product(cast(v.values as double[]), cast(q.vector as double[]))"
    if metric == "cosine":
        raw = f"""{raw} / (sqrt(list_inner_product(cast(v.values as double[]), cast(v.values as double[])))
                  * sqrt(list_inner_product(cast(q.vector as double[]), cast(q.vector as double[]))))"""
    return f"""(
      select query_id, cast(rank as bigint) as rank, id, score from (
        select *, row_number() over (partition by query_id order by score desc, id) as rank from (
          select q.query_id, v.id, round({raw}, 6) as score from {stored} v cross join {asked} q where {where}
        ) where not isnan(score)
      ) where rank <= {k}
    )"""


ASKED = "(select vec_id as query_id, embedding as vector from embeddings)"
CLEAN_DOCUMENTS = cleaned("documents", "doc_id")
NAMED_CHUNKS = f"""(
  select sha256(doc_id || ':' || chunk) as id, doc_id, chunk, text from {chunks(CLEAN_DOCUMENTS, 'doc_id')}
)"""
STORED_CHUNKS = f"(select id, vector as values from {embedded_lists(NAMED_CHUNKS, 'id')})"
PROMPT_VECTORS = f"(select item_id as query_id, vector from {embedded_lists('benchmark', 'item_id')})"


def hits_with_text(metric: str = "cosine") -> str:
    return f"""
      select h.query_id, h.rank, h.id, h.score, c.doc_id || '.pdf' as filename, cast(c.chunk as bigint) as chunk, c.text
      from {top(STORED_CHUNKS, PROMPT_VECTORS, metric)} h join {NAMED_CHUNKS} c on c.id = h.id"""


FIRST_SIDECAR = f"""(
  select * from (select *, row_number() over (partition by digest order by pos) as rn from {SIDECAR_SQL}) where rn = 1
)"""


def ingested(source: str) -> str:
    """Chunks of ``source(doc_id, text)`` that survive ingest, with dense ids and metadata."""
    described = f"""(
      select d.doc_id, d.text, cast(s.file_size as varchar) as size, substr(s.date, 1, 10) as created_at
      from {source} d join {FIRST_SIDECAR} s on s.digest = cast(d.doc_id as varchar) where length(d.text) > 0
    )"""
    parts = chunks(cleaned(described, "doc_id, size, created_at"), "doc_id, size, created_at")
    return f"""(
      select cast(row_number() over (order by doc_id, chunk) - 1 as bigint) as id,
        sha256(doc_id || ':' || chunk) as key, doc_id || '.pdf' as filename, size, created_at,
        cast(chunk as bigint) as chunk, text
      from {parts}
    )"""


def with_sums(source: str, key: str) -> str:
    """Rows of ``source`` with the sum of their embedding."""
    return f"""(
      select c.*, s.vector_sum from {source} c
      join (select {key}, round(sum(cast(x as double)), 4) as vector_sum from {embedded(source, key)} group by {key}) s
      on s.{key} = c.{key}
    )"""


INGESTED = ingested("documents")
INGESTED_EXTRACTED = ingested(EXTRACTED_SQL)
FIRST_RUN = "(select * from documents where lang = 'en')"
SECOND_RUN = "(select * from documents where lang is distinct from 'en')"


def version(mark: str, shift: int = 0) -> str:
    return f"""(
      select 'label' || label as namespace, cast(vec_id + {shift} as varchar) as id,
        round(list_sum(cast(embedding as double[])), 4) as vector_sum, 'set' || label as filename,
        cast(len(embedding) as varchar) as size, '2024-01-01' as created_at, cast(label as bigint) as chunk,
        '{mark} ' || vec_id as text
      from embeddings
    )"""


UPSERTED = f"""(
  select * from {version('second', 100)}
  union all
  select * from {version('first')} a where not exists (
    select 1 from {version('second', 100)} b where b.namespace = a.namespace and b.id = a.id)
)"""

SUMMARY_COLUMNS = """count(*) as n_requests,
  cast(sum(cast(seconds as decimal(18,6))) as double) as total_request,
  (max(epoch_us(started) + cast(round(seconds * 1000000) as bigint)) - min(epoch_us(started))) / 1000000.0 as total_wall"""


def summary(by: str) -> str:
    return f"""(
      select {by}, n_requests, total_request / n_requests as mean_request, total_wall / n_requests as mean_wall,
        total_request, cast(total_wall as double) as total_wall
      from (select {by}, {SUMMARY_COLUMNS} from {LATENCY_SQL} group by all)
    )"""


def three_digits(x: str) -> str:
    size = f"cast(floor(log10(abs({x}))) as integer)"
    return f"""(case when {x} = 0 then 0.0::double
      when {size} > 2 then round({x} / pow(10.0, {size} - 2)) * pow(10.0, {size} - 2)
      else round({x} * pow(10.0, 2 - {size})) / pow(10.0, 2 - {size}) end)"""


ROUNDED = f"""(
  select database, n_requests, {", ".join(f"{three_digits(c)} as {c}" for c in (
      "mean_request", "mean_wall", "total_request", "total_wall"))}
  from {summary("database")}
)"""
COMPARED = " union all ".join(
    f"select '{m}' as metric, " + ", ".join(f"max(case when database = '{d}' then {m} end) as {d}" for d in DATABASES)
    + f" from {ROUNDED}"
    for m in ("mean_request", "mean_wall", "total_request", "total_wall")
)

PEAK = f"(select max(abs(cast(x as double))) as peak from (select unnest(values) as x from {SCALED_SQL}))"
UNIT_SCALED = f"""(
  select id, list_transform(values, lambda x: cast(x as double) / norm) as values
  from (select id, values, sqrt(list_inner_product(cast(values as double[]), cast(values as double[]))) as norm from {SCALED_SQL})
)"""
UNIT_ASKED = """(
  select vec_id as query_id, list_transform(embedding, lambda x: cast(x as double) / norm) as vector
  from (select *, sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) as norm from embeddings)
)"""
UNIT_PEAK = f"(select max(abs(x)) as peak from (select unnest(values) as x from {UNIT_SCALED}))"


def coded(source: str, col: str, key: str) -> str:
    return f"""(
      select {key}, list_transform({col}, lambda x: greatest(-127.0, least(127.0, round(x / peak * 127)))) as {col}
      from {source} cross join {UNIT_PEAK}
    )"""


CANDIDATES = top(coded(UNIT_SCALED, "values", "id"), coded(UNIT_ASKED, "vector", "query_id"), "ip", k=20)
RESCORED = f"""
  select query_id, cast(rank as bigint) as rank, id, score from (
    select *, row_number() over (partition by query_id order by score desc, id) as rank from (
      select c.query_id, c.id, round(list_inner_product(cast(v.values as double[]), cast(q.embedding as double[])) / (
          sqrt(list_inner_product(cast(v.values as double[]), cast(v.values as double[])))
          * sqrt(list_inner_product(cast(q.embedding as double[]), cast(q.embedding as double[])))), 6) as score
      from {CANDIDATES} c join {SCALED_SQL} v on v.id = c.id join embeddings q on q.vec_id = c.query_id
    )
  ) where rank <= 5"""

PAIR = f"{SCALED_SQL} a join {SCALED_SQL} b on b.id = a.id + 1"
PAIR_PRODUCT = "list_inner_product(cast(a.values as double[]), cast(b.values as double[]))"

ALL_LAYOUTS = "(select unnest(['typed', 'namespaced', 'payload']) as layout)"
HITS = "select query_id, rank, id, score from "

ORACLE: dict[str, str] = {
    # text
    "collapse_spaces": f"select doc_id, {collapse('text')} as text from {NOISE_SQL}",
    "strip_newlines_tabs": f"select doc_id, {strip_breaks('text')} as text from {NOISE_SQL}",
    "fix_dot_comma": f"select doc_id, replace(text, '.,', '.') as text from {NOISE_SQL}",
    "join_hyphenated": f"select doc_id, {join_words('text')} as text from {NOISE_SQL}",
    "strip_cid": f"select doc_id, {strip_marks('text')} as text from {NOISE_SQL}",
    "clean_text": f"select doc_id, text from {cleaned(NOISE_SQL, 'doc_id')}",
    "strip_lead_space": """
      select doc_id, case when starts_with(text, ' ') then substr(text, 2) else text end as text
      from (select doc_id, case lang when 'en' then '  ' when 'fr' then ' ' else '' end || text as text from documents)""",
    "clean_web_pages": f"select page_id, text from {cleaned('pages', 'page_id', 'html')}",
    "chunk_text": f"select * from {chunks('documents', 'doc_id')}",
    "chunk_stats": f"""
      select lang, count(*) as n_chunks, cast(sum(length(text)) as bigint) as n_chars, max(chunk) as longest_document
      from {chunks('documents', 'lang', 300, 50)} group by lang""",
    "digest_of": r"""
      select doc_id, replace(replace(replace(filename, '.pdf', ''), 'data', ''), '\', '') as digest,
        source || '-' || doc_id as strict_digest
      from (select doc_id, source, 'data\' || source || '-' || doc_id || '.pdf' as filename from documents)""",
    # documents
    "assemble_pages": "select conv_id, string_agg(text, '' order by turn) as text from conversations group by conv_id",
    "limit_documents": "select doc_id, lang, n_chars from documents order by doc_id limit 50",
    "split_empty": f"select doc_id, 'no_text' as reason from {EXTRACTED_SQL} where length(text) = 0",
    "keep_with_text": f"select doc_id, lang, text from {EXTRACTED_SQL} where length(text) > 0",
    "remove_quarantined": """
      select doc_id, text from documents where doc_id not in (select doc_id from labels where quality = 0)""",
    "first_match": f"select digest, file_size, pos from {FIRST_SIDECAR}",
    "attach_metadata": f"""
      select d.doc_id, s.digest, cast(s.file_size as varchar) as size, substr(s.date, 1, 10) as created_at, d.text
      from documents d join {FIRST_SIDECAR} s on s.digest = cast(d.doc_id as varchar)""",
    "missing_metadata": """
      select doc_id, 'no_metadata' as reason from documents where doc_id not in (select doc_id from labels)""",
    "ingest_report": """
      select source, count(*) as n_documents, cast(sum(length(text)) as bigint) as n_chars from documents group by source""",
    # ids
    "assign_dense_ids": f"""
      select cast(row_number() over (order by doc_id, chunk) - 1 as varchar) as id, doc_id, chunk
      from {chunks('documents', 'doc_id')}""",
    "content_ids": f"""
      select sha256(doc_id || ':' || chunk) as id, doc_id, chunk from {chunks('documents', 'doc_id')}""",
    "batch_rows": f"""
      select cast(floor(id / 500) as bigint) as batch_id, count(*) as n_rows, min(id) as first_id
      from (select cast(row_number() over (order by doc_id, chunk) - 1 as bigint) as id from {chunks('documents', 'doc_id')})
      group by 1""",
    # embedding
    "embed_hash": f"select doc_id, pos, round(cast(x as double), 6) as x from {embedded('documents', 'doc_id')}",
    "embed_udf": f"select doc_id, pos, round(cast(x as double), 6) as x from {embedded('documents', 'doc_id')}",
    # layouts
    "typed_layout": f"""
      select id, vector_sum, filename, size, cast(null as varchar) as created_at, chunk, text
      from {with_sums(INGESTED, 'id')}""",
    "payload_layout": f"""
      select id, vector_sum, created_at, chunk as chunk_part, filename as document_id, text
      from {with_sums(INGESTED, 'id')}""",
    "namespaced_layout": f"""
      select 'development' as namespace, key as id, vector_sum, filename, size, created_at, chunk, text
      from {with_sums(INGESTED, 'id')}""",
    "read_document_files": """
      select d.doc_id || '.txt' as filename,
        case when coalesce(l.quality, 1) <> 0 and coalesce(l.toxic, 0) <> 1 and length(d.text) > 0 then d.text end as text,
        case when coalesce(l.quality, 1) = 0 or coalesce(length(d.text), 0) = 0 and coalesce(l.toxic, 0) <> 1 then 'empty_file'
          when l.toxic = 1 then 'not_utf8' end as reason
      from documents d left join labels l on d.doc_id = l.doc_id""",
    "read_sidecar": f"""
      select digest, file_size, date || ' "a",' || chr(10) || 'b' as date from (
        select *, row_number() over (partition by digest order by pos) as place from {SIDECAR_SQL}) where place = 1""",
    "constraint_rejects": f"""
      select sha256(doc_id || ':' || chunk) as id, 'text_too_long' as reason
      from {chunks('documents', 'doc_id', 6000, 100)} where length(text) > 5000""",
    # vector tables
    "create_collection": f"""
      select layout, cast({DIM} as bigint) as dim, case layout when 'typed' then 'ip' else 'cosine' end as metric,
        (select count(*) from embeddings) as n_rows
      from {ALL_LAYOUTS}""",
    "append_vectors": f"""
      select cast(id as bigint) as id, vector_sum, filename, size, cast(null as varchar) as created_at, chunk, text
      from (select * from {version('first')} union all select * from {version('second', 100)})""",
    "upsert_vectors": f"select * from {UPSERTED}",
    "compact_collection": f"select * from {UPSERTED}",
    "upsert_payload": f"""
      select cast(id as bigint) as id, vector_sum, created_at, chunk as chunk_part, filename as document_id, text from (
        select * from {version('second', 100)}
        union all select * from {version('first')}
          where id not in (select id from {version('second', 100)}))""",
    "clear_namespace": f"select * from {UPSERTED} where namespace <> 'label3'",
    "clear_collection": f"select * from {version('reloaded')}",
    "fan_out_tables": f"select layout, id, vector_sum, text from {version('first')} cross join {ALL_LAYOUTS}",
    "load_rejects": f"""
      select layout, cast(vec_id as varchar) as id, case when label = 3 then 'wrong_dimension' else 'stored' end as outcome
      from embeddings cross join {ALL_LAYOUTS}""",
    "write_json_roundtrip": f"""
      select 'development' as namespace, key as id, vector_sum, filename, size, created_at, chunk, text
      from {with_sums(INGESTED, 'id')}""",
    "dump_results": "select item_id, text from benchmark",
    "deliver_committed": """
      select doc_id, cast(1 as bigint) as n_sent, true as fits, cast(length(text) as bigint) as n_chars from documents""",
    "attach_late_metadata_stream": f"""
      select d.doc_id, cast(d.doc_id as varchar) as digest, cast(s.file_size as varchar) as size, s.date,
        case when s.digest is null then 'no_metadata' end as reason
      from documents d left join {FIRST_SIDECAR} s on s.digest = cast(d.doc_id as varchar)""",
    "deliver_batches": "select count(*) as n_rows, cast(0 as bigint) as n_failed from documents",
    # search
    "inner_product": f"select a.id, round({PAIR_PRODUCT}, 6) as score from {PAIR}",
    "cosine": f"""
      select a.id, round({PAIR_PRODUCT} / (sqrt(list_inner_product(cast(a.values as double[]), cast(a.values as double[])))
        * sqrt(list_inner_product(cast(b.values as double[]), cast(b.values as double[])))), 6) as score
      from {PAIR}""",
    "knn_ip": HITS + top(SCALED_SQL, ASKED, "ip"),
    "knn_cosine": HITS + top(SCALED_SQL, ASKED, "cosine"),
    "knn_block": HITS + top(SCALED_SQL, ASKED, "ip"),
    # Ids of a namespaced table are strings, and ties follow their order.
    "knn_namespace": "select query_id, rank, cast(id as bigint) as id, score from " + top(
        "(select cast(vec_id as varchar) as id, embedding as values, label from embeddings)", ASKED, "cosine", "v.label = 3"),
    "query_collection": f"""
      select h.query_id, h.rank, h.id, h.score, c.filename, c.chunk, c.text
      from {top(f"(select key as id, vector as values from {embedded_lists(INGESTED, 'key')})", PROMPT_VECTORS, 'cosine')} h
      join {INGESTED} c on c.key = h.id""",
    "knn_filtered": HITS + top(SCALED_SQL, ASKED, "cosine", "v.label >= 5"),
    "quantize_int8": f"""
      select id, pos - 1 as pos, cast(round(cast(values[pos] as double) / peak * 127) as bigint) as code
      from (select id, values, unnest(range(1, {DIM + 1})) as pos from {SCALED_SQL}) cross join {PEAK}""",
    "knn_int8_rescored": RESCORED,
    "build_index": f"""
      select vec_id as id, true as has_cell, cast({DIM} as bigint) as n_values, cast({DIM} as bigint) as n_q8
      from embeddings""",
    "knn_int8_stored": RESCORED,
    "knn_ivf": HITS + top(SCALED_SQL, ASKED, "cosine"),
    "knn_int8_bounded": HITS + top(SCALED_SQL, ASKED, "cosine"),
    "query_indexed": "select method, query_id, rank, cast(id as bigint) as id, score from " + top(
        """(select cast(vec_id + 100 as varchar) as id, embedding as values from embeddings where label = 3
            union all
            select cast(vec_id as varchar), embedding from embeddings
            where label = 3 and vec_id - 100 not in (select vec_id from embeddings where label = 3))""",
        ASKED, "cosine") + " cross join (select unnest(['ivf', 'int8']) as method)",
    "knn_ivf_all_cells": HITS + top(SCALED_SQL, ASKED, "cosine"),
    "knn_ivf_blocks": HITS + top(SCALED_SQL, ASKED, "cosine"),
    # text search and evaluation
    "flagship_search": hits_with_text(),
    "text_search_ids": HITS + top(STORED_CHUNKS, PROMPT_VECTORS, "ip"),
    "shape_hits": f"""
      select h.query_id, h.rank, h.id, h.score, round(list_sum(c.values), 4) as vector_sum,
        true as no_metadata, true as no_text
      from {top(STORED_CHUNKS, PROMPT_VECTORS, 'cosine')} h join {STORED_CHUNKS} c on c.id = h.id""",
    "hydrate_hits": f"""
      select h.query_id, h.rank, h.id, d.lang, d.text
      from {top(SCALED_SQL, ASKED, 'cosine')} h left join documents d on d.doc_id = h.id""",
    "hydrate_hits_filtered": f"""
      select h.query_id, h.rank, h.id, d.lang, d.text
      from {top(SCALED_SQL, ASKED, 'cosine')} h left join documents d on d.doc_id = h.id""",
    "result_agreement": f"""
      select query_id, count(in_a) as n_a, count(in_b) as n_b, count(in_a + in_b) as n_both,
        round(count(in_a + in_b) / cast(greatest(count(in_a), count(in_b)) as double), 6) as overlap
      from (select query_id, id, 1 as in_a from {top(SCALED_SQL, ASKED, 'ip')}) a
      full join (select query_id, id, 1 as in_b from {top(SCALED_SQL, ASKED, 'cosine')}) b using (query_id, id)
      group by query_id""",
    "quality_run_saved": hits_with_text(),
    "replicate_workload": f"""
      select item_id * {ITERATIONS} + iteration as request_id, item_id as query_id, iteration, text
      from benchmark cross join (select unnest(range({ITERATIONS})) as iteration)""",
    "workload_hits": f"""
      select query_id, iteration, rank, id, score
      from {top(SCALED_SQL, ASKED, 'ip')} cross join (select unnest(range({ITERATIONS})) as iteration)""",
    "latency_summary": f"""
      select database, phase, n_requests, round(mean_request, 6) as mean_request, round(mean_wall, 6) as mean_wall,
        round(total_request, 6) as total_request, round(total_wall, 6) as total_wall
      from {summary('database, phase')}""",
    "latency_quantiles": f"""
      select database, probability, n_requests, n_requests as n_counted, true as within_error
      from (select database, count(seconds) as n_requests from {LATENCY_SQL} group by database having count(seconds) > 0)
      cross join (select unnest([0.5::double, 0.95::double, 0.99::double]) as probability)""",
    "rounded_summary": f"select * from {ROUNDED}",
    "compare_report": COMPARED,
    "sig3": f"select event_id, {three_digits('value')} as value from events",
    "ingest_run_rejects": f"""
      select doc_id, 'no_text' as reason from {EXTRACTED_SQL} where length(text) = 0
      union all
      select doc_id, 'no_metadata' from documents where doc_id not in (select doc_id from labels)""",
    "ingest_run_long_chunks": f"""
      select doc_id, outcome, count(*) as n from (
        select doc_id, case when length(text) = 0 then 'no_text' else 'no_metadata' end as outcome from documents
        where length(text) = 0 or doc_id not in (select doc_id from labels)
        union all
        select doc_id, case when length(text) > 5000 then 'text_too_long' else 'stored' end
        from {chunks(cleaned("(select * from documents where length(text) > 0 and doc_id in (select doc_id from labels))", "doc_id"), "doc_id", 6000, 0)}
      ) group by all""",
    "ingest_run_loaded": f"""
      select layout, cast(id as varchar) as id, vector_sum, text
      from {with_sums(INGESTED_EXTRACTED, 'id')} cross join {ALL_LAYOUTS}""",
    "free_metadata_loaded": f"""
      select layout, cast(i.id as varchar) as id, s.lang, cast(s.quality as bigint) as quality, s.source, s.later, i.text
      from {INGESTED} i join {FREE_SIDECAR_SQL} s on s.digest || '.pdf' = i.filename and not s.later cross join {ALL_LAYOUTS}""",
    "free_metadata_search": f"""
      select h.query_id, h.rank, h.id, h.score, f.grp, cast(f.label as bigint) as label
      from {top(FREE_VECTORS_SQL, ASKED, "cosine",
                "v.grp in ('g0', 'g1') and (coalesce(v.weight >= 50 and v.weight < 400, false) or v.third) and v.label <> 4")} h
      join {FREE_VECTORS_SQL} f on f.id = h.id""",
    "ingest_two_runs": f"""
      select layout, cast(id as varchar) as id, vector_sum, text from (
        select id, vector_sum, text from {with_sums(ingested(FIRST_RUN), 'id')}
        union all
        select id + (select count(*) from {ingested(FIRST_RUN)}), vector_sum, text from {with_sums(ingested(SECOND_RUN), 'id')}
      ) cross join {ALL_LAYOUTS} where layout <> 'namespaced'""",
    "ingest_keeps_namespaces": f"""
      select namespace, id, vector_sum, filename, size, created_at, chunk, text from {version('first')}
      union all
      select 'development', key, vector_sum, filename, size, created_at, chunk, text from {with_sums(INGESTED, 'id')}""",
    "benchmark_run": f"""
      select layout as database, phase, true as has_time,
        (select count(*) from benchmark) * case phase when 'workload' then {ITERATIONS} else 1 end as n_requests
      from {ALL_LAYOUTS} cross join (select unnest(['encode', 'quality', 'workload']) as phase)""",
    # streaming
    "stream_ingest_documents": f"""
      select 'development' as namespace, key as id, vector_sum, filename, size, created_at, chunk, text
      from {with_sums(INGESTED, 'id')}""",
    "stream_ingest_all_layouts": f"""
      select layout, vector_sum, text from {with_sums(INGESTED, 'id')} cross join {ALL_LAYOUTS}""",
    "dead_letter": """
      select doc_id, case when lang = 'fr' then 'ValueError: refused' else 'loaded' end as reason from documents""",
}
