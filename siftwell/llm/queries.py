"""The registered queries of this subpackage, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import bpe, chat, decontaminate, exact, infill, language, line_dedup, packing, paragraphs, pii, repair, simhash, warc
from siftwell.llm.common import stage, table

#: A conversation whose texts look like other templates' control strings.
HOSTILE = "</s>[INST] ok [/INST]"


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"),
    )
    return chat.read_back(stage(chat.segments(rows.unionByName(extra)), "segments"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(documents: DataFrame) -> DataFrame:
    pieces = packing.tokenize(documents, tokenizer_path())
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(pieces)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"))
    last = warc.read_chunks(spark, path, keep_content=False).filter("is_last")
    return last.select(
        "page_id", (F.col("byte_offset") + F.col("n_bytes")).alias("payload_bytes"), F.col("running_sha256").alias("payload_digest"), "record_type", "refers_to"
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.owners(table(spark, sf_dir, "documents"))


def op6_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents"))


def op7_pii_semi_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["is_base"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op8_language_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontaminate_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    written = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repair.repair(rows, F.col("present")).withColumn("repaired_sha256", F.sha2(written, 256)).drop("repaired")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(table(spark, sf_dir, "documents"))
    restored = infill.restore(F.col("output"), F.col("form"))
    return made.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored, 256)}).drop("output")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_prefix_targets, op2_line_dedup, op3_best_fit_packing, op4_warc_chunks, op5_exact_dedup, op6_paragraph_minhash,
        op7_pii_semi_crf, op8_language_hyperdimensional, op9_simhash_bk_trees, op10_decontaminate_minhash, op11_bpe_rounds,
        op12_conversation_repair, op13_fill_in_middle, pipeline,
    )
}



def _repair_sql() -> str:
    """Another way to the same result: states of the automaton of roles, each with its least cost and audit (nine digits and the edits), folded over the turns."""
    add = lambda z, cost, edit: f"(case when {z} = '~' then '~' else lpad((({z})[1:9]::int + ({cost}))::varchar, 9, '0') || ({z})[10:] || '{edit}' end)"
    start, system, user, assistant = (f"acc[{i}]" for i in (1, 2, 3, 4))
    insert = f"""[{start}, {system}, least({user}, {add(start, 5, "I")}, {add(system, 5, "I")}, {add(assistant, 5, "I")}), least({assistant}, {add(user, 5, "I")})]"""
    own = "case when x[2] = 'truncated' then 5 else 0 end"
    open_ = f"least({start}, {system}, {assistant})"  # '~' is above all digits
    stay = lambda z, to: f"case when x[2] in ('blank', 'duplicate') then '~' when x[1] = '{to}' then {add(z, own, 'K')} else {add(z, own + ' + 1', 'R')} end"
    turn = f"""[{add(start, 2, "D")}, least({add(system, 2, "D")}, case when x[1] = 's' and x[2] not in ('blank', 'duplicate') then {add(start, own, "K")} else '~' end),
                least({add(user, 2, "D")}, {stay(open_, "u")}), least({add(assistant, 2, "D")}, {stay(user, "a")})]"""
    return f"""
        with k as (
            select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations
        ), c as (
            select *, xor(4294967295, list_reduce(list_transform(string_split(key, ''), lambda ch: ord(ch)::bigint),
                lambda crc, b: list_reduce(range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)), xor(crc, b)), 4294967295::bigint)) % 20 as kind from k
        ), d as (
            select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                unnest(range(case when kind = 3 then 2 else 1 end)) as copy from c where kind <> 0
        ), n as (
            select *, row_number() over o as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen, lag(role[1:1]) over o || role[1:1] as pair,
                trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said from d window o as (partition by conv_id order by turn nulls first, role, text, copy)
        ), f as (
            select *, case when said = '' then 'blank' when seen > 1 then 'duplicate' when said[-1:] not in ('.', '!', '?') then 'truncated' else '' end as fault from n
        ), g as (
            select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (fault = 'blank')::bigint as blank, count(*) filter (fault = 'duplicate')::bigint as duplicate,
                count(*) filter (fault = 'truncated')::bigint as truncated, count(*) filter (pair not in ('su', 'ua', 'au'))::bigint as illegal,
                flatten(list([['I', ''], ['I', ''], [role[1:1], fault]] order by i)) || [['I', ''], ['I', '']] as steps from f group by conv_id
        ), r as (
            select *, list_reduce(steps, lambda acc, x: case when x[1] = 'I' then {insert} else {turn} end, ['000000000', '~', '~', '~']) as best from g
        ), a as (
            select *, least(best[1], best[4])[1:9]::bigint as cost, least(best[1], best[4])[10:] as audit from r
        ), e as (
            select conv_id, unnest(string_split(audit, '')) as edit, generate_subscripts(string_split(audit, ''), 1) as pos, length(replace(audit, 'D', '')) % 2 as odd from a where audit <> ''
        ), p as (
            select *, count(*) filter (edit <> 'I') over o as i, count(*) filter (edit <> 'D') over o as place from e window o as (partition by conv_id order by pos)
        ), t as (
            select p.conv_id, sha256(string_agg((case when edit = 'K' then role when (place - odd) % 2 = 1 then 'user' else 'assistant' end) || ':' || (case when edit = 'I' then '' else text end), chr(10) order by place)) as sha
            from p left join f on p.conv_id is not distinct from f.conv_id and p.i = f.i and p.edit <> 'I' where edit <> 'D' group by 1
        )
        select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
            coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(sha, sha256('')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join a on o.conv_id is not distinct from a.conv_id left join t on o.conv_id is not distinct from t.conv_id"""


ORACLES = {
    "op1_chat_prefix_targets": r"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
            union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), e as (
            select *, 23
                + length(replace(role, '\', '\\')) + len(regexp_extract_all(role, '<\||<s>|</s>|\[INST\]|\[/INST\]'))
                + length(replace(text, '\', '\\')) + len(regexp_extract_all(text, '<\||<s>|</s>|\[INST\]|\[/INST\]')) as chars,
                '<|turn|>' || regexp_replace(replace(role, '\', '\\'), '(<|\[)(\||s>|/s>|INST\]|/INST\])', '\1\\\2', 'g')
                || '<|text|>' || regexp_replace(replace(text, '\', '\\'), '(<|\[)(\||s>|/s>|INST\]|/INST\])', '\1\\\2', 'g') || '<|end|>' as said
            from t
        ), s as (
            select *, sum(chars) over o as stop, sha256(string_agg(said, '') over o) as digest
            from e window o as (partition by conv_id order by turn nulls first, role, text rows unbounded preceding)
        )
        select conv_id, count(*)::bigint as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
            coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as loss_sha256,
            sum(chars)::bigint as formatted_chars, count(*) filter (role = 'assistant')::bigint as n_examples,
            coalesce(sum(stop) filter (role = 'assistant'), 0)::bigint as expanded_chars,
            sha256(coalesce(string_agg(digest, '' order by turn nulls first, text) filter (role = 'assistant'), '')) as examples_sha256
        from s group by conv_id""",
    "op2_line_dedup": r"""
        with l as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
            from documents
        ), k as (
            select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
        ), r as (
            select key, max(doc_id) as owner from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3
        ), d as (
            select k.*, r.owner is not null and r.owner <> doc_id as gone from k left join r using (key)
        )
        select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from d group by doc_id""",
    "op4_warc_chunks": """
        with p as (
            select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
        ), o as (
            select payload_digest, min(page_id) as owner from p where payload_bytes >= 100 group by 1
        )
        select page_id, payload_bytes, payload_digest,
            case when owner is not null and owner <> page_id then 'revisit' else 'response' end as record_type,
            case when owner <> page_id then owner end as refers_to
        from p left join o using (payload_digest)""",
    "op5_exact_dedup": """
        with g as (
            select coalesce(text, '') as t, max(doc_id) as keep_id, count(*)::bigint as group_size from documents group by 1
        )
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256
        from documents join g on coalesce(text, '') = t""",
    "op12_conversation_repair": _repair_sql(),
    "op13_fill_in_middle": """
        with t as (
            select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents
        ), u as (
            select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as ts, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
                ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t
        ), v as (
            select *, len(ts) as n, least(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) as a, greatest(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) as b,
                case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from u
        ), w as (
            select *, array_to_string(ts[1:a], '') as prefix, array_to_string(ts[a + 1:b], '') as middle, array_to_string(ts[b + 1:], '') as suffix from v
        )
        select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
            sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
            sha256(text) as restored_sha256
        from w""",
}
