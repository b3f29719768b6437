"""One query per operator over the given tables, and the SQL with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runweave.llm import byte_bpe, language, pieces, quality
from runweave.llm.chat import format_chat
from runweave.llm.common import LOWER, UPPER, table
from runweave.llm.decontaminate import contamination
from runweave.llm.exact import exact_duplicates
from runweave.llm.html_text import main_text
from runweave.llm.jaccard import near_duplicates
from runweave.llm.resampling import resample
from runweave.llm.sharding import shard_by_bytes
from runweave.llm.spelling import spelling_groups
from runweave.llm.warc import captures

Query = Callable[[SparkSession, str], DataFrame]
SHARDS = 40
# Folds by the checksum of the id, and the one that nothing is learned from.
LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 3, 1
QUALITY_FOLDS, QUALITY_HELD_OUT = 4, 2
CHAT_FOLDS, CHAT_HELD_OUT = 3, 1
QUALITY_GOOD = 0.7
VARIED, WORD_LENGTH, WORD_COUNT, FORM_TIMES = 97, 5, 3, 2
BUCKETS, FEATURE_WORDS, DRAW_SEED, DRAW_PERCENT, DRAW_WORDS = 10_000, 1, 2024, 10, 20
BYTE_RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="largest").drop("n_bytes")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, language.id_remainder(LANGUAGE_FOLDS) != LANGUAGE_HELD_OUT)
    held_out = F.coalesce(language.id_remainder(LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT, F.lit(False))
    found = language.identify(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "lang_score")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.load(pieces.MODEL_PATH)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, vocabulary, pieces.N_BEST)
    return encoded.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "ids",
        "score",
        "others",
        "round_trip",
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = language.id_remainder(CHAT_FOLDS, "conv_id")
    found = format_chat(table(spark, sf_dir, "conversations"), F.coalesce(remainder != CHAT_HELD_OUT, F.lit(False)))
    held_out = F.coalesce(remainder == CHAT_HELD_OUT, F.lit(False))
    return found.withColumn("held_out", held_out)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = captures(table(spark, sf_dir, "pages"), payloads=False)
    return found.select(
        F.col("capture.metadata.page_id").alias("page_id"),
        F.col("capture.answer.n_bytes").alias("payload_bytes"),
        F.col("capture.answer.digest").alias("payload_digest"),
        F.col("capture.answer.kind").alias("record_type"),
        F.col("capture.metadata.refers_to").alias("refers_to"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), percent=90, k=3)
    return found.select("doc_id", "n_shingles", "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(language.id_remainder(QUALITY_FOLDS) == QUALITY_HELD_OUT, F.lit(False))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), language.id_remainder(QUALITY_FOLDS) != QUALITY_HELD_OUT)
    return quality.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_GOOD).cast("int").alias("predicted")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"), VARIED, WORD_LENGTH, WORD_COUNT, FORM_TIMES)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = resample(docs, target, DRAW_PERCENT, DRAW_SEED, FEATURE_WORDS, BUCKETS, DRAW_WORDS)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_bpe.load(public_tokenizers.path(BYTE_RANKS))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return found.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_chat_format": op4_chat_format,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op10_html_text": op10_html_text,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_byte_bpe": op13_byte_bpe,
}

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
# The 256 steps of CRC-32 (reversed polynomial 3988292384), and a checksum by them.
_CRC_TABLE = """
        crc_table as (
            select list(step order by i) as steps
            from (
                select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                    lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as step
                from (select cast(range as bigint) as i from range(256))
            )
        )"""


def _crc_sql(text: str) -> str:
    return f"""xor(4294967295, list_reduce(
        list_concat([4294967295], list_transform(range(strlen({text})), lambda i: cast('0x' || hex({text})[2 * i + 1:2 * i + 2] as bigint))),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"""


ORACLES: dict[str, str] = {
    "op1_exact_dedup": f"""
        with t as (select doc_id, {_LOWERED} as norm from documents)
        select doc_id,
               max(doc_id) over (partition by norm) as keep_id,
               count(*) over (partition by norm) as group_size,
               doc_id = max(doc_id) over (partition by norm) as kept,
               sha256(norm) as text_sha256
        from t
    """,
    "op5_warc": """
        with p as (
            select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as h
            from pages
        ), q as (
            select *, min(page_id) over (partition by h) as first_id,
                   [cast('0x' || h[5 * i + 1:5 * i + 5] as integer) for i in range(8)] as parts
            from p
        )
        select page_id, payload_bytes,
               array_to_string([
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x >> 15) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x >> 10) % 32 + 1]
                   || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x >> 5) % 32 + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[x % 32 + 1]
                   for x in parts], '') as payload_digest,
               case when page_id = first_id then 'response' else 'revisit' end as record_type,
               case when page_id <> first_id then first_id end as refers_to
        from q
    """,
    "op6_decontamination": f"""
        with i as (
            select item_id, list_filter(string_split_regex({_LOWERED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
            from benchmark
        ), iw as (
            select distinct item_id, least(len(w), 13) as n,
                   array_to_string(w[s:s + least(len(w), 13) - 1], ' ') as win
            from (select item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) as s from i where len(w) > 0)
        ), d as (
            select doc_id, row_number() over () as r, list_filter(string_split_regex({_LOWERED}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
            from documents
        ), lengths as (select distinct n from iw),
        places as (select r, w, n, unnest(generate_series(1, len(w) - n + 1)) as s from d, lengths where len(w) >= n),
        hits as (
            select r, s, p.n, item_id
            from (select r, s, n, array_to_string(w[s:s + n - 1], ' ') as win from places) p
            join iw on iw.win = p.win and iw.n = p.n
        ), words as (
            select r, count(distinct pos) as n_hit
            from (select r, unnest(generate_series(s, s + n - 1)) as pos from (select distinct r, s, n from hits))
            group by r
        ), items as (
            select r, count(distinct item_id) as n_items,
                   string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as listed
            from hits group by r
        )
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit,
               coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from d left join words using (r) left join items using (r)
    """,
    "op11_spelling_variants": f"""
        with recursive {_CRC_TABLE},
        runs as (
            select coalesce(cast(doc_id as varchar), '') as id,
                   unnest(regexp_extract_all({_LOWERED}, '[a-z\u00C0-\u00FF]+')) as run
            from documents
        ), counted as (select id, run, count(*) as times from runs where length(run) >= {WORD_LENGTH} group by all),
        named as (select *, id || ':' || run as name from counted),
        hashed as (select run, times, {_crc_sql("name")} as h from named, crc_table),
        varied as (
            select case when h % {VARIED} = 0 then run[1:h % length(run)] || run[h % length(run) + 2:] else run end as word, times
            from hashed
        ), words as (
            select word, cast(sum(times) as bigint) as n from varied where length(word) >= {WORD_LENGTH}
            group by word having sum(times) >= {WORD_COUNT}
        ), places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
        less as (select word, n, i, word[1:i - 1] || word[i + 1:] as rest from places),
        near as (
            select distinct a.word, b.word as near, b.n as near_n
            from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word
            union
            select less.word, words.word, words.n from less join words on less.rest = words.word
            union
            select words.word, less.word, less.n from less join words on less.rest = words.word
        ), best as (
            select word, count(*) as n_near, max(near_n) as top, arg_min(near, (-near_n, near)) as near from near group by word
        ), forms as (
            select words.word, words.n, coalesce(n_near, 0) as n_near,
                   case when top >= {FORM_TIMES} * n then near end as form,
                   case when top >= {FORM_TIMES} * n then top end as form_n
            from words left join best using (word)
        ), walk as (
            select word, form as root from forms where form is not null
            union all
            select walk.word, forms.form from walk join forms on forms.word = walk.root where forms.form is not null
        ), ends as (
            select walk.word, walk.root from walk join forms on forms.word = walk.root where forms.form is null
        )
        select word, form, coalesce(root, word) as root, n, n_near, form_n from forms left join ends using (word)
    """,
    "op12_importance_resampling": f"""
        with {_CRC_TABLE},
        texts as (
            select 's' as side, row_number() over () as r, doc_id, text from documents
            union all select 't', 0, null, text from benchmark
        ), words as (
            select side, r, unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word from texts
        ), counted as (select side, r, word, count(*) as n from words group by all),
        buckets as (
            select word, {_crc_sql("word")} % {BUCKETS} as bucket from (select distinct word from counted), crc_table
        ), held as (select side, r, bucket, sum(n) as n from counted join buckets using (word) group by all),
        sums as (
            select cast(coalesce(sum(n) filter (where side = 's'), 0) as double) as s_all,
                   cast(coalesce(sum(n) filter (where side = 't'), 0) as double) as t_all
            from held
        ), sides as (
            select bucket, cast(coalesce(sum(n) filter (where side = 's'), 0) as double) as s,
                   cast(coalesce(sum(n) filter (where side = 't'), 0) as double) as t
            from held group by bucket
        ), gains as (
            select bucket, cast(floor(1000 * ln((t + 1) * (s_all + {BUCKETS}) / ((s + 1) * (t_all + {BUCKETS})))) as bigint) as gain
            from sides, sums
        ), weights as (
            select r, cast(sum(n) as bigint) as n_features, cast(sum(n * gain) as bigint) as weight
            from held join gains using (bucket) where side = 's' group by r
        ), weighed as (
            select r, doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
                   cast('0x' || sha256('{DRAW_SEED}:' || coalesce(cast(doc_id as varchar), ''))[1:8] as bigint) as h
            from texts left join weights using (r) where side = 's'
        ), scored as (
            select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) as score from weighed
        ), ranked as (
            select r, row_number() over (order by score desc, doc_id nulls last) as place,
                   count(*) over () as eligible
            from scored where n_features >= {DRAW_WORDS}
        )
        select doc_id, n_features, weight, score, case when place <= {DRAW_PERCENT} * eligible // 100 then place end as rank
        from scored left join ranked using (r)
    """,
}
