"""Registered queries of this package: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation_trie, decontam, filter_audit, fingerprints, html_extract, jaccard_join, linededup, neardup, packing, secret_scan, sharding, toxicity

#: Vocabulary of the packing query, by its name in the installed tokenizer files.
TOKENIZER = "word_bpe_49k.json"
#: Score from which a document counts as toxic.
TOXIC_FROM = 0.7
SHARDS = 24


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = html_extract.main_texts(read(spark, sf_dir, "pages"))
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"), any_two=True)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"), secret_scan.span_text(F.col("spans")).alias("spans"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -7 whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat.format_chats(turns)
    back = done.withColumn("turns", chat.read_back(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["piece"])), "")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("loss_text", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fingerprints.compared(read(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text("own").alias("fingerprint"), fingerprints.as_text("changed").alias("edited_fingerprint"),
        "near_edited", "near_next", "contained_edited",
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), inconsistent=True)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_spans(read(spark, sf_dir, "documents"), whole_lines=True)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, tokenizer_path())
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests, docs.count())


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on the labels whose crc32(id as text) mod 3 is not 1."""
    learnt = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).select("doc_id", F.col("toxic").alias("label"))
    return toxicity.fit(toxicity.training_rows(docs, learnt))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.turn_lists(read(spark, sf_dir, "conversations"))
    return conversation_trie.trie(conversation_trie.branched(turns))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents"))


LLM_QUERIES = {f.__name__: f for f in (op1_html_text, op2_secrets, op3_chat_format, op4_near_duplicates, op5_sharding, op6_fingerprints, op7_decontamination, op8_line_dedup, op9_packing, op10_toxicity, op11_conversation_trie, op12_filter_audit, op13_jaccard_join)}

def _sql_spans(pattern: str, kind: str, rank: int, keep: str) -> str:
    """SQL for the matches of a pattern as structs (start, rank, stop, kind): pieces and matches take turns."""
    quoted = pattern.replace("'", "''")
    return f"""[{{'s': CAST(coalesce(list_sum([length(g) FOR g IN gaps[1:i]]), 0) + coalesce(list_sum([length(h) FOR h IN hits[1:i - 1]]), 0) AS BIGINT), 'k': {rank},
        'e': CAST(coalesce(list_sum([length(g) FOR g IN gaps[1:i]]), 0) + coalesce(list_sum([length(h) FOR h IN hits[1:i]]), 0) AS BIGINT), 'n': '{kind}'}}
        FOR i IN range(1, len(hits) + 1) IF {keep}] AS {kind}_
        FROM (SELECT *, string_split_regex(body, '{quoted}') AS gaps, regexp_extract_all(body, '{quoted}') AS hits, regexp_extract_all(body, '{quoted}', {2 if kind == "assign" else 0}) AS vals FROM"""


_JOINED = "coalesce(array_to_string([concat(x.n, ':', x.s, ':', x.e) FOR x IN base], ','), '')"
# the weak spans of op2 need a complement nearby; the given tables hold none, so this states the strong ones
_SECRETS_SQL = f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        a AS (SELECT doc_id, body, {_sql_spans(secret_scan.ASSIGN, "assign", 0, "length(vals[i]) >= 6")} t)),
        b AS (SELECT doc_id, body, assign_, {_sql_spans("AKIA[A-Z0-9]+", "access", 1, "length(hits[i]) >= 20")} a)),
        c AS (SELECT doc_id, assign_, access_, {_sql_spans("[0-9a-f]+", "hex", 2, "length(hits[i]) >= 24")} b)),
        d AS (SELECT *, list_sort(list_concat(list_concat(assign_, access_), hex_)) AS base FROM c)
        SELECT doc_id, len(assign_) AS n_assign, len(access_) AS n_access, len(hex_) AS n_hex, sha256({_JOINED}) AS base_sha256, {_JOINED} AS spans FROM d
"""

def _links_sql(width: int, percent: int, kept: str = "") -> str:
    """SQL of the components that links of shingle sets make."""
    return f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
                ELSE list_distinct([array_to_string(ws[i:i + {width - 1}], ' ') FOR i IN range(1, len(ws) - {width - 2})]) END AS sh
            FROM w),
        n AS (SELECT doc_id, len(sh) AS n FROM s),
        u AS (SELECT doc_id, unnest(sh) AS x FROM s),
        p AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS common FROM u l JOIN u r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {percent} * (na.n + nb.n - common)),
        reach AS (SELECT doc_id AS v, doc_id AS r FROM n UNION SELECT reach.v, e.b FROM reach JOIN e ON reach.r = e.a),
        c AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
        SELECT doc_id, n AS n_shingles, component_id{kept} FROM n JOIN c ON c.v = n.doc_id
    """


# crc32 of the id's digits: a byte goes in, eight shifts follow
_CRC = """xor(4294967295, list_reduce(
        list_concat([4294967295], flatten([[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN regexp_extract_all(CAST(conv_id AS VARCHAR), '.')])),
        lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
_TRIE_SQL = f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        own AS (
            SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, md5(concat(length(role), ':', role, text))) AS said, {_CRC} % 4 AS h
            FROM t GROUP BY conv_id),
        made AS (
            SELECT o.conv_id, list_concat(coalesce(b.said[1:o.h], []), o.said[o.h + 1:]) AS said
            FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
        spot AS (SELECT conv_id, d, len(said) AS n, said[d].t AS last, sha256(CAST(said[1:d] AS VARCHAR) || d) AS k, sha256(CAST(said[1:d - 1] AS VARCHAR) || (d - 1)) AS up
            FROM (SELECT conv_id, said, unnest(range(len(said) + 1)) AS d FROM made)),
        node AS (
            SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
                any_value(len([x FOR x IN string_split_regex(CASE WHEN d = 0 THEN '' ELSE last END, '[\\x20\\x09-\\x0D]+') IF x <> ''])) AS words,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
            FROM spot GROUP BY k, d),
        kids AS (SELECT up AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY up),
        -- a node lies below the nodes of its smallest member up to its own depth
        below AS (
            SELECT a.k, sum(CASE WHEN kids.k IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((x.n_convs - 1) * x.words)::BIGINT AS saved_tokens
            FROM node x JOIN spot a ON a.conv_id = x.conv_id AND a.d <= x.d LEFT JOIN kids ON kids.k = x.k GROUP BY a.k)
        SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n_children, 0) AS n_children,
            below.n_leaves, below.saved_tokens, x.ends_sha256
        FROM node x JOIN below ON below.k = x.k LEFT JOIN kids ON kids.k = x.k LEFT JOIN node p ON x.d > 0 AND p.k = x.up
"""
_AUDIT_SQL = """
        WITH RECURSIVE w AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
                [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws
            FROM documents),
        marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT w.doc_id, part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
                (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
                + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body))::INT
                + 8 * regexp_matches(body, '[#$%&*|]')::INT
                + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY body), FALSE)::INT AS mask
            FROM w LEFT JOIN marks ON marks.doc_id = w.doc_id),
        cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, mask),
        letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        walk(prefix, applied, step) AS (
            SELECT '', 0, 0
            UNION ALL
            SELECT prefix || letter, applied | bit, step + 1 FROM walk, letters WHERE applied & bit = 0),
        steps AS (
            SELECT o.prefix AS filter_order, i.step, l.letter, l.bit, b.applied
            FROM walk o, (SELECT unnest(range(1, 6)) AS step) i JOIN letters l ON l.letter = o.prefix[i.step] JOIN walk b ON b.prefix = o.prefix[1:i.step - 1]
            WHERE o.step = 5),
        counted AS (
            SELECT c.part, s.filter_order, s.step, s.letter,
                coalesce(sum(n) FILTER (mask & (applied | bit) = 0), 0)::BIGINT AS kept,
                coalesce(sum(n) FILTER (mask & applied = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (mask & applied <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
                coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (mask & applied = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
                coalesce(sum(toxic) FILTER (mask & applied = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
            FROM steps s, cells c GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley
        FROM counted
"""

LLM_ORACLES = {
    "op2_secrets": _SECRETS_SQL,
    "op4_near_duplicates": _links_sql(5, 75, ", doc_id = component_id AS kept"),
    "op11_conversation_trie": _TRIE_SQL,
    "op12_filter_audit": _AUDIT_SQL,
    "op13_jaccard_join": _links_sql(3, 90),
    "op3_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        m AS (
            SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, FALSE) AS goes_on,
                length(regexp_replace(replace(text, '\\', '\\\\'), '(<|\\[)(\\||/?s>|<SYS>>|</SYS>>|/?INST\\])', '\\1#\\2', 'g')) AS marked
            FROM t)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(marked + CASE WHEN goes_on THEN 11 ELSE 12 + length(role) + 11 + 11 END)::BIGINT AS formatted_chars
        FROM m GROUP BY conv_id
    """,
}
