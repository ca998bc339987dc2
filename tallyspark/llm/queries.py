"""The thin queries that the entry point registers, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontam, hosts, mil, neardup, packing, repeats, resample, rules, secrets, simple8b, toxic
from .common import staged, table

VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_files(table(spark, sf_dir, "documents"), vocabulary(), end_id=1)


def op2_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("attention")


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels")))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page shows the document that the number at the end of its path names, and is bad if that document is labelled low or toxic."""
    shown = F.regexp_extract(hosts.host_and_path(F.col("url"))[1], r"/([0-9]{1,18})[^/]*/?$", 1)
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0)
    known = labels.select("doc_id", bad.alias("bad")).where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    return pages.select("page_id", F.when(shown != "", shown).cast("long").alias("doc_id")).where("doc_id is not null").join(known, "doc_id").select("page_id", "bad")


def op4_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return hosts.judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).drop("bad_rate", "bound")


def op5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"), secrets.fit(secrets.made_findings(spark)))


def op8_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    hostile = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hostile)
    return chat.digests(staged(chat.windows(turns), "op13-windows"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simple8b": op1_simple8b,
    "op2_mil": op2_mil,
    "op3_rules": op3_rules,
    "op4_hosts": op4_hosts,
    "op5_segments": op5_segments,
    "op6_repeats": op6_repeats,
    "op7_secrets": op7_secrets,
    "op8_automaton": op8_automaton,
    "op9_minhash": op9_minhash,
    "op10_packing": op10_packing,
    "op11_align": op11_align,
    "op12_resample": op12_resample,
    "op13_chat": op13_chat,
}

SQL: dict[str, str] = {
    "op4_hosts": r"""
        WITH u AS (SELECT page_id, url, strpos(url, '://') AS sep FROM pages),
        rest AS (SELECT page_id, CASE WHEN sep > 0 THEN substr(url, sep + 3) ELSE '' END AS t FROM u),
        p AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        rules(rule, verdict, rh, rp) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
        fits AS (SELECT DISTINCT page_id, host, path, rule, verdict FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
        best AS (SELECT page_id, arg_max(rule, (length(rule), rule)) AS rule, arg_max(verdict, (length(rule), rule)) AS verdict FROM fits GROUP BY page_id),
        shown AS (SELECT page_id, try_cast(regexp_extract(path, '/([0-9]{1,18})[^/]*/?$', 1) AS BIGINT) AS doc_id FROM p),
        known AS (SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS bad FROM shown JOIN labels USING (doc_id) GROUP BY 1),
        h AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM p LEFT JOIN known USING (page_id) GROUP BY host),
        hd AS (SELECT *, CASE WHEN regexp_extract(host, '[^.]+[.][^.]+$') <> '' THEN regexp_extract(host, '[^.]+[.][^.]+$') ELSE host END AS domain FROM h),
        d AS (SELECT domain, regexp_extract(domain, '[^.]*$') AS suffix, sum(n) AS n, sum(k) AS k FROM hd GROUP BY domain),
        s AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM h) AS m FROM d GROUP BY suffix),
        s0 AS (SELECT 1 / least(greatest(coalesce((sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.0001), 0.0001), 0.9) - 1 AS w FROM s WHERE n > 0),
        dm AS (SELECT d.*, (s.k + w * m) / (s.n + w) AS m FROM d JOIN s USING (suffix), s0),
        s1 AS (SELECT 1 / least(greatest(coalesce((sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.0001), 0.0001), 0.9) - 1 AS w FROM dm WHERE n > 0),
        hm AS (SELECT hd.host, hd.n, hd.k, (dm.k + w * m) / (dm.n + w) AS m FROM hd JOIN dm USING (domain), s1),
        s2 AS (SELECT 1 / least(greatest(coalesce((sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.0001), 0.0001), 0.9) - 1 AS w FROM hm WHERE n > 0),
        ab AS (SELECT host, k + w * m AS a, n - k + w * (1 - m) AS b FROM hm, s2),
        bound AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS low FROM ab)
        SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN best USING (page_id) LEFT JOIN bound USING (host)
    """,
    "op9_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, sh FROM (
                SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS sh FROM w WHERE len(w) > 0
            )
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
        edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT x AS doc_id, y AS other FROM edges UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other),
        low AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, coalesce(low, d.doc_id) >= d.doc_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
    """,
    "op8_automaton": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS k
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
        ),
        sizes AS (SELECT DISTINCT n FROM windows),
        places AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
        found AS (SELECT doc_id, item_id, p, places.n FROM places JOIN windows ON places.k = windows.k AND places.n = windows.n),
        hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op12_resample": r"""
        WITH RECURSIVE bits(i, k, c) AS (
            SELECT i, 0, i::BIGINT FROM range(256) r(i)
            UNION ALL SELECT i, k + 1, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
        ),
        steps AS (SELECT list(c ORDER BY i) AS v FROM bits WHERE k = 8),
        d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
        b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
        words AS (SELECT w, hex(w) AS h FROM (SELECT w FROM d UNION SELECT w FROM b)),
        octets AS (SELECT w, list_transform(range(0, length(h) // 2), lambda k: ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) AS o FROM words),
        bucket AS (
            SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, o), lambda c, x: xor(c >> 8, v[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS k FROM octets, steps
        ),
        dn AS MATERIALIZED (SELECT doc_id, k, count(*) AS n FROM d JOIN bucket USING (w) GROUP BY ALL),
        s AS (SELECT k, sum(n) AS n FROM dn GROUP BY k),
        t AS (SELECT k, count(*) AS n FROM b JOIN bucket USING (w) GROUP BY k),
        totals AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t),
        gain AS (SELECT s.k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (totals.s + 10000) / ((s.n + 1)::DOUBLE * (totals.t + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (k), totals),
        weights AS (SELECT doc_id, sum(n) AS n, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM dn JOIN gain USING (k) GROUP BY doc_id),
        h AS (SELECT doc_id, ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents),
        score AS (
            SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM h LEFT JOIN weights USING (doc_id)
        ),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM score)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM ranked
    """,
    "op13_chat": r"""
        WITH RECURSIVE t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ),
        n AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role) - 1 AS pos,
                   len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]')) + 2 AS n,
                   length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '<</?SYS>>|</?s>|\[/?INST\]|\[/?TURN\]|\[SAYS\]')) AS body,
                   length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '<</?SYS>>|</?s>|\[/?INST\]|\[/?TURN\]|\[SAYS\]')) AS named
            FROM t
        ),
        c AS (
            SELECT *, body + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + named END AS chars, pos = 0 AND role = 'system' AS led FROM n
        ),
        p AS MATERIALIZED (
            SELECT *, (sum(CASE WHEN led THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY pos) - n)::BIGINT AS start,
                   greatest(384 - max(CASE WHEN led THEN n ELSE 0 END) OVER (PARTITION BY conv_id), 1) AS room,
                   max(CASE WHEN led THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS lead
            FROM c
        ),
        u AS MATERIALIZED (SELECT *, start // 8192 AS cell FROM p WHERE NOT led),
        later AS MATERIALIZED (
            SELECT a.conv_id, a.start, min(b.start) AS up FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.cell = b.cell AND b.start > a.start AND b.start + b.n - a.start > a.room GROUP BY ALL
        ),
        w AS (SELECT conv_id, min(start) AS start FROM u GROUP BY conv_id, cell UNION ALL SELECT w.conv_id, up FROM w JOIN later ON later.conv_id = w.conv_id AND later.start = w.start),
        again AS (SELECT w.conv_id, sum(u.chars) AS chars FROM w JOIN u ON u.conv_id = w.conv_id AND u.start >= w.start - 128 AND u.start < w.start GROUP BY ALL),
        shown AS (SELECT conv_id, count(*) AS n FROM w GROUP BY conv_id),
        whole AS (
            SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
                   coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss, sum(CASE WHEN led THEN 0 ELSE chars END) AS chars, max(lead) AS lead
            FROM p GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               (whole.chars + coalesce(again.chars, 0) + lead * coalesce(shown.n, 1))::BIGINT AS formatted_chars
        FROM whole LEFT JOIN again USING (conv_id) LEFT JOIN shown USING (conv_id)
    """,
}
