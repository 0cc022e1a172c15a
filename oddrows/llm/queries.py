"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddrows.llm import chat, countjoin, lm, mixing, neardup, packing, parsing, periodic, prefixes, quality, suffixes, tokenizers_io, toxicity, warc
from oddrows.llm.common import table, text_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = 50_257  # ids of the byte-level tokenizer


def query(name: str, sql: str | None = None):
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def bpe_encoder():
    """The byte-level vocabulary of the installed tokenizer files."""
    import public_tokenizers as files

    return tokenizers_io.byte_bpe(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)


@query("op1_best_fit_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(spark, folder, "documents"), bpe_encoder())
    # Only digests and lengths go on; the ids stay in the task that made them.
    rows = packing.numbered(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.place(rows)


@query("op2_warc_round_trip", """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM (SELECT page_id, n, digest, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first_id
      FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages))
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.warc_round_trip(table(spark, folder, "pages"))
    return records.select(
        "page_id", F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("digest")).alias("payload_digest"), "record_type", "refers_to",
    )


MIX_SQL = """
WITH RECURSIVE sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS size FROM documents GROUP BY source),
rates AS (SELECT source, CASE WHEN size > 0 THEN pow(size, 0.5) / sum(pow(size, 0.5)) OVER () * sum(size) OVER () / size ELSE 1 END AS rate FROM sizes),
steps AS (
    SELECT source, rate, 0 AS k, -rate AS log, exp(-rate) AS cdf FROM rates
    UNION ALL SELECT source, rate, k + 1, log + ln(rate / (k + 1)), cdf + exp(log + ln(rate / (k + 1))) FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 24)
),
drawn AS (SELECT doc_id, source, text, (CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.cdf <= d.u) AS n FROM drawn d),
copies AS (SELECT doc_id, source, text, unnest(range(n)) AS copy FROM counted)
SELECT doc_id, source, md5(text) AS text_md5, CAST(copy AS INTEGER) AS copy,
       (CAST('0x' || substr(md5('18:' || doc_id || ':' || copy), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496 AS shuffle_key
FROM copies
"""


@query("op3_mix_sources", MIX_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "source", F.md5("text").alias("text_md5"), "copy", "shuffle_key")


CHAT_SQL = """
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
marked AS (
    SELECT *, CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 3 WHEN 'system' THEN 3 ELSE 5 + length(role) END AS tag,
           length(regexp_replace(text, '([<\\[])(\\\\*)(/?s>|/?(INST|ANS|SYS)\\]|/?ROLE:[^\\]\\s]*\\])', '\\1\\2\\\\\\3', 'g')) AS body
    FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(3 + tag + 2 + 1 + body + 1 + tag + 3 + 4) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query("op6_chat_format", CHAT_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text")
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.format_turns(turns))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Index:
    return toxicity.fit(docs, labels.where(~toxicity.held_out()))


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(docs, table(spark, folder, "labels")), carry=["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


@query("op7_quality_rules")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


@query("op8_parsing_fingerprints")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return parsing.compare_with_edits(table(spark, folder, "documents"))


@query("op5_near_duplicates")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.classes(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "copies")


@query("op4_suffix_array_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.report(table(spark, folder, "documents"))


@query("op10_lm_scores")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"), bpe_encoder(), VOCABULARY)


#: SQL: the crc32 table from its rule, and the crc32 of a short ASCII string.
CRC_TABLE = (
    "SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS crc_table "
    "FROM range(256) r(i)"
)


def crc_sql(text: str) -> str:
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i::INT, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda x, y: xor(x >> 8, crc_table[(xor(x, y) & 255) + 1])), 4294967295)"


#: Equal words at each distance q, in stretches of neighbours: those long enough are runs, of the smallest such q.
RUNS_SQL = f"""
WITH crc AS ({CRC_TABLE}),
docs AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc_sql("doc_id::VARCHAR")} AS h
    FROM documents, crc
),
plans AS (SELECT r, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM docs),
places AS (SELECT *, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM plans),
words AS (
    SELECT r, n, i, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS word
    FROM (SELECT *, unnest(range(n)) AS i FROM places)
),
equal AS (SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
    SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM equal)
    GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)
),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
best AS (
    SELECT r, count(*) AS n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256,
           arg_max({{'s': start, 'n': length, 'q': period}}, [length, -start, -period]) AS b
    FROM runs GROUP BY r
),
dropped AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.n AS length, b.q AS period, 1000 * b.n // b.q AS exponent_milli,
       coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


def planted_period() -> Column:
    """The text; one in ten by id repeats its words from some word on, as the query's contract says."""
    words = F.regexp_extract_all(text_of(), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    at = lambda w: F.pmod(F.floor(h / 10), F.size(w))
    period = lambda w: 1 + F.floor((F.size(w) - at(w)) / (3 + F.pmod(F.floor(h / 10), F.lit(8))))

    def repeated(w: Column) -> Column:
        a, p = at(w), period(w)
        place = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.element_at(w, (1 + F.when(i < a, i).otherwise(a + F.pmod(i - a, p))).cast("int")))
        return F.array_join(place, " ")

    # (A one-element array binds the words once.)
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.element_at(F.transform(F.array(words), repeated), 1)).otherwise(text_of())


@query("op13_periodic_runs", RUNS_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", planted_period().alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("before"), (-r.period).alias("short"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = periodic.find_runs(docs).select("doc_id", "runs", "collapsed", best.alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.short")).alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


TRIE_SQL = f"""
WITH crc AS ({CRC_TABLE}),
turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
    SELECT c, list(sha256(length(role) || ':' || role || text) ORDER BY pos) AS t,
           list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY pos) AS w, {crc_sql("c::VARCHAR")} % 4 AS h
    FROM turns, crc GROUP BY c, crc_table
),
built AS (
    SELECT a.c, list_concat(coalesce(b.t[:a.h], []), a.t[a.h + 1:]) AS t, list_concat(coalesce(b.w[:a.h], []), a.w[a.h + 1:]) AS w
    FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 20
),
steps AS (
    SELECT c, d, md5(array_to_string(t[:d], '')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(t[:d - 1], '')) END AS above,
           CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, d = len(t) AS ends
    FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM built)
),
nodes AS (
    SELECT d, node, any_value(above) AS above, min(c) AS c, count(*) AS n, any_value(words) AS words,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
    FROM steps GROUP BY d, node
),
kids AS (SELECT d - 1 AS d, above AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (d, node)),
sums AS (
    SELECT s.d, s.node, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n - 1) * n.words) AS saved
    FROM full_nodes n JOIN steps s ON s.c = n.c AND s.d <= n.d GROUP BY s.d, s.node
)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, n.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s USING (d, node) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.above
"""


@query("op12_prefix_trie", TRIE_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    sequences, _ = prefixes.encode(table(spark, folder, "conversations"))
    nodes = prefixes.prefix_trie(prefixes.rebuilt(sequences))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


JACCARD_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
),
grams AS (
    SELECT DISTINCT r, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
    FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM words UNION SELECT reach.a, steps.b FROM reach JOIN steps ON steps.a = reach.b)
SELECT w.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(t.doc_id) AS component_id
FROM words w LEFT JOIN sizes s USING (r) JOIN reach ON reach.a = w.r JOIN words t ON t.r = reach.b
GROUP BY w.r, w.doc_id
"""


@query("op11_ngram_jaccard", JACCARD_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return countjoin.link_components(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")
