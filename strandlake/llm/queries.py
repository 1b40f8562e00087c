"""One query for each operator of this subpackage, over whole tables, with SQL where it can say the same."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, centroids, chat_format, conversation_repair, language_id, line_dedup, mixing, mtree, multi_index, ngram_join, paragraph_dedup, pii, suffix_dedup
from strandlake.llm.common import table


def op1_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.mtree_top_k(table(spark, sf_dir, "embeddings"), k=10)


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.documents_with_repeats(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"), length=400)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    chats = chat_format.parse_chats(chat_format.format_chats(rows.unionByName(more)))
    told = F.array_join(F.flatten(F.transform("turns", lambda t: F.array(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescaped(s["text"], chat_format.DEFAULT)), "")
    out = chats.select("conv_id", "valid", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "valid")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), vocabulary())


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *map(count, pii.BASE), F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.written(pii.all_spans(F.col("base"), F.col("added"))).alias("spans"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(table(spark, sf_dir, "embeddings"), k=10)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), least_docs=5, least_chars=40)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, salt="2:")
    spread = {r["cluster"]: int(r["t"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("t")).collect()}  # a row a centroid
    told = [(i, spread.get(i, 0), sum(spread.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found)]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    done = conversation_repair.repair(conversation_repair.damaged(rows))
    counts = conversation_repair.COUNTS
    # both parts know their own digests, so only the few conversations in pieces are joined
    names = ["conv_id", *counts, "audit", "repaired_sha256"]
    found = conversation_repair.with_sha256(done).select(*names)
    ids = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    out = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return out.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_mtree_top_k, op2_paragraph_dedup, op3_language_id, op4_suffix_dedup, op5_chat_format, op6_mixing, op7_ngram_jaccard_join, op8_bpe, op9_pii, op10_multi_index, op11_line_dedup, op12_centroids, op13_conversation_repair)}

def _centroid_sql(k: int, rounds: int, dims: int, scale: int, salt: str) -> str:
    """The rounds written out one after the other; sums of squares are taken apart, in whole numbers below 2**53."""
    square = lambda t: f"list_inner_product({t}, {t})"
    nearest = lambda i: f"""a{i} AS MATERIALIZED (SELECT r, min((d, c)) AS best FROM (SELECT r, c, CAST({square("v.x")} + {square("c.x")} - 2 * list_inner_product(v.x, c.x) AS BIGINT) AS d FROM v, c{i} AS c) GROUP BY r)"""
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * CAST(e AS DOUBLE)) for e in embedding] AS x FROM embeddings WHERE len(embedding) = {dims} AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('{salt}' || vec_id) AS h, x FROM v ORDER BY h NULLS LAST, x LIMIT {k}))",
    ]
    for i in range(rounds):
        steps += [
            nearest(i),
            f"s{i} AS (SELECT a.best[2] AS c, t.i, CAST(sum(v.x[t.i]) AS BIGINT) AS s, count(*) AS n FROM a{i} AS a JOIN v ON a.r = v.r, range(1, {dims + 1}) AS t(i) GROUP BY 1, 2)",
            f"n{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS x FROM s{i} GROUP BY c)",
            f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.x, o.x) AS x FROM c{i} AS o LEFT JOIN n{i} AS n ON o.c = n.c)",
        ]
    return f"""WITH {", ".join([*steps, nearest(rounds)])}
        SELECT v.vec_id, CAST(a.best[2] AS INTEGER) AS cluster, a.best[1] AS distance, CAST(sum(a.best[1]) OVER (PARTITION BY a.best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(a.best[1]) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string([CAST(e AS BIGINT) for e in c.x], ',')) AS centroid_sha256
        FROM v JOIN a{rounds} AS a ON v.r = a.r JOIN c{rounds} AS c ON a.best[2] = c.c"""


#: M-trees, sampled codebooks, learned models, merge lists, suffix arrays and bootstrapped patterns are beyond SQL; tests/llm compares
#: those with brute force. Digests of the chats need the planted conversation beside the table.
ORACLE: dict[str, str] = {
    "op5_chat_format": """
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
          before AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM rows),
          judged AS (SELECT *, coalesce(CASE role WHEN 'system' THEN prev IS NULL WHEN 'user' THEN prev IS NULL OR prev IN ('system', 'assistant') WHEN 'assistant' THEN prev = 'user' ELSE false END, false) AS ok FROM before),
          said AS (SELECT conv_id, turn, role, text, ok, back, length(text) + length(replace(text, '\\', '')) * 0 + (length(text) - length(replace(text, '\\', ''))) + (length(text) - length(replace(text, '#', ''))) + (length(text) - length(replace(text, '<', ''))) + (length(text) - length(replace(text, ':', ''))) AS width FROM judged)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(6 + length(role) + 9 + width) AS BIGINT) AS formatted_chars, bool_and(ok) AND bool_and(back <> 1 OR role IN ('assistant', 'user')) AS valid
        FROM said GROUP BY conv_id""",
    "op6_mixing": """
        WITH d AS (SELECT doc_id, source, CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) AS BIGINT) AS size FROM documents),
          s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
          w AS (SELECT *, CASE (i - 1) % 3 WHEN 0 THEN 5.0e0 WHEN 1 THEN 2.0e0 ELSE 1.0e0 END AS weight, 2.0e0 * source_size AS cap FROM s),
          l AS (SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0e0)) AS level FROM w),
          v AS (SELECT min(level) FILTER (WHERE cap > level * weight) AS level FROM (SELECT * FROM l WHERE cap > level * weight ORDER BY cap / weight, i LIMIT 1)),
          g AS (SELECT l.source, l.source_size, CASE WHEN v.level IS NULL OR l.cap / l.weight <= v.level THEN l.cap ELSE v.level * l.weight END AS target FROM l CROSS JOIN v),
          q AS (SELECT d.*, e, CAST('0x' || substr(md5('mix' || CAST(e AS VARCHAR) || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM d CROSS JOIN (SELECT unnest([0, 1]) AS e) WHERE size > 0),
          c AS (SELECT q.*, g.target, sum(size) OVER (PARTITION BY q.source ORDER BY e, h, doc_id ROWS UNBOUNDED PRECEDING) / g.target AS finish FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source),
          t AS (SELECT *, sum(size) OVER (ORDER BY finish, coalesce('=' || source, '~'), h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM c),
          k AS (SELECT doc_id, source, count(*) AS copies FROM t WHERE upto <= (SELECT sum(target) FROM g) GROUP BY doc_id, source)
        SELECT d.doc_id, d.source, d.size, g.source_size, g.target, CAST(d.size * coalesce(k.copies, 0) AS BIGINT) AS taken
        FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN k ON d.doc_id = k.doc_id AND d.source IS NOT DISTINCT FROM k.source""",
    "op7_ngram_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS t FROM documents),
          s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')] ELSE [t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] FOR i IN range(1, len(t) - 1)] END) AS g FROM w),
          n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
          common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
          e AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
          both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
          reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a)
        SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = w.doc_id) AS component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id""",
    "op11_line_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
          l AS (SELECT r, doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS line FROM d),
          k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
          c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 5),
          m AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last AS gone FROM k LEFT JOIN c ON k.key = c.key)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY r""",
    "op12_centroids": _centroid_sql(k=40, rounds=5, dims=64, scale=256, salt="2:"),
    # the checksum is worked out byte by byte from its polynomial; edits row by row, each from at most two inserts and an edit of the row
    "op13_conversation_repair": """
        WITH RECURSIVE step AS (SELECT [list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for i in range(256)] AS t),
          base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
          judged AS (SELECT *, xor(list_reduce(list_concat([4294967295], [CAST(ascii(c) AS BIGINT) for c in string_split(k, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault FROM base, step),
          after AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM judged, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
          placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, coalesce(conv_id, -9223372036854775808) AS c FROM after),
          r AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN bare[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault, role[1] AS at, lag(role[1]) OVER (PARTITION BY c ORDER BY i) || role[1] AS pair FROM placed),
          moves AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (0, 2, 3, 'I', 'user:'), (0, 3, 6, 'II', 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 3, 'I', 'user:'), (1, 3, 6, 'II', 'user:' || chr(10) || 'assistant:'), (2, 2, 0, '', ''), (2, 3, 3, 'I', 'assistant:'), (3, 3, 0, '', ''), (3, 2, 3, 'I', 'user:'), (3, 3, 6, 'II', 'user:' || chr(10) || 'assistant:')) AS m(a, z, cost, audit, told)),
          edits AS (SELECT * FROM (VALUES (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3), (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2)) AS e(a, edit, role, z)),
          best AS (SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS told FROM r
            UNION ALL SELECT c, i, state, cost, audit, told FROM (
              SELECT b.c, b.i + 1 AS i, e.z AS state, b.cost + m.cost + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.edit <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END AS cost, b.audit || m.audit || e.edit AS audit,
                list_concat(b.told, CASE WHEN m.told = '' THEN [] ELSE [m.told] END, CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE e.z WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text] END) AS told
              FROM best AS b JOIN r ON r.c = b.c AND r.i = b.i + 1 JOIN moves AS m ON m.a = b.state JOIN edits AS e ON e.a = m.z WHERE (e.role IS NULL OR e.role = r.at) AND (e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate'))
            ) QUALIFY row_number() OVER (PARTITION BY c, state ORDER BY cost, audit) = 1),
          done AS (SELECT b.c, b.cost + m.cost AS cost, b.audit || m.audit AS audit, array_to_string(list_concat(b.told, CASE WHEN m.told = '' THEN [] ELSE [m.told] END), chr(10)) AS told
            FROM best AS b JOIN (SELECT c, max(i) AS n FROM r GROUP BY c) AS l ON b.c = l.c AND b.i = l.n JOIN moves AS m ON m.a = b.state WHERE m.z IN (0, 3) QUALIFY row_number() OVER (PARTITION BY b.c ORDER BY b.cost + m.cost, b.audit || m.audit) = 1),
          n AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c)
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(told, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN n ON n.c = coalesce(o.conv_id, -9223372036854775808) LEFT JOIN done ON done.c = n.c""",
}
