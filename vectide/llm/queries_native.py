"""Queries of the operators that use DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import chat, exact_dedup, mixing
from vectide.llm.common import table, whole_text


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, carry={"doc_id": F.col("doc_id"), "source": F.col("source")})
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(concat_ws('|', doc_id::varchar, text)), 1, 15))::bigint as hash
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight
  from sized group by source),
shares as (
  select *, 3 * source_size as most,
    (sum(source_size) over () - coalesce(sum(3 * source_size) over before, 0))::double
      / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as share
  from sources
  window before as (order by (3 * source_size)::double / weight::double, source nulls last rows between unbounded preceding and 1 preceding)),
goals as (
  select source, source_size, case when share * weight > most then most::double
    else least(most::double, max(share) filter (share * weight <= most) over () * weight) end as target
  from shares),
plan as (
  select *, case when source_size > 0 then least(3, floor(target / source_size)) else 0 end as whole from goals),
budgets as (
  select *, case when whole < 3 then target - whole * source_size else 0 end as budget from plan),
running as (
  select source, hash, sum(size) as size, sum(sum(size)) over (partition by source order by hash) as through
  from sized group by source, hash),
boundary as (
  select b.source, min(r.hash) as at from budgets b join running r on b.source is not distinct from r.source
  where b.budget > 0 and r.through > b.budget group by b.source),
limits as (
  select b.source, case when r.through - b.budget < b.budget - (r.through - r.size) then r.hash else r.hash - 1 end as threshold
  from boundary x join budgets b on b.source is not distinct from x.source
  join running r on r.source is not distinct from x.source and r.hash = x.at)
select s.doc_id, s.size, b.source_size, b.target,
  (s.size * (b.whole + case when s.hash <= coalesce(l.threshold, -1) then 1 else 0 end))::bigint as taken
from sized s join budgets b on s.source is not distinct from b.source
left join limits l on l.source is not distinct from s.source
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = exact_dedup.mark_copies(docs, carry={"doc_id": F.col("doc_id"), "text_sha256": F.sha2(whole_text(), 256)})
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), own.alias("text"))
    chats = chat.format_chats(turns.unionByName(extra))
    chats = chats.withColumns({"read": chat.read_turns(F.col("formatted")), "learned": chat.loss_text(F.col("segments"))})
    told = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")


OP8_SQL = """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, lag(role, 1, 'start') over told as before, row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) as back,
    case role when 'system' then 19 when 'user' then 15 when 'assistant' then 5
      else 19 + length(regexp_replace(role, '([\\[<\\\\])', '\\1\\\\', 'g')) end
    + length(regexp_replace(text, '([\\[<\\\\])', '\\1\\\\', 'g')) as chars
  from turns window told as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  (3 + sum(chars))::bigint as formatted_chars,
  bool_and(before || ' ' || role in ('start system', 'start user', 'system user', 'user assistant', 'assistant user'))
    and bool_or(back = 1 and role = 'assistant') as valid
from marked group by conv_id
"""

QUERIES = {"op4_mix_sources": op4_mix_sources, "op7_exact_dedup": op7_exact_dedup, "op8_chat_format": op8_chat_format}
SQL = {"op4_mix_sources": OP4_SQL, "op7_exact_dedup": OP7_SQL, "op8_chat_format": OP8_SQL}
