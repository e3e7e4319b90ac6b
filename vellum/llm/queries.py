"""The operators' queries over their whole tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import without_duplicates

    return without_duplicates(table(spark, sf_dir, "documents"), size=35)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_binary import encoded_tokens

    return encoded_tokens(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identified

    return identified(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_features

    return media_features(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged

    return judged(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import proven

    return proven(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audited

    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_substring_dedup, op3_sentencepiece, op4_token_binary, op5_language_id, op6_media_columns, op7_url_filter, op8_packing, op9_exact_dedup, op10_pii,
        op11_html_extraction, op12_merkle_manifest, op13_filter_audit,
    )
}

ORACLE_SQL = {
    "op7_url_filter": r"""
        WITH rules(rhost, rpath, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
                                               ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        p AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host,
                     regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        f AS (SELECT page_id, host, path, rhost || rpath AS r, v,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
              FROM p LEFT JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath))
        SELECT page_id, host, path, r AS rule, coalesce(v, 'allow') AS verdict FROM f WHERE k = 1""",
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)""",
    "op12_merkle_manifest": r"""
        WITH RECURSIVE
        f AS (SELECT doc_id, lang, text, strlen(doc_id::varchar) || ':' || doc_id AS i, coalesce(strlen(source) || ':' || source, '-') AS s, coalesce(strlen(lang) || ':' || lang, '-') AS l,
                     coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') AS n,
                     xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
                         lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)) + z)), 4294967295) % 3 = 0 AS hit FROM documents),
        h AS (SELECT doc_id, lang, l AS grp, sha256(i || s || l || n || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                     CASE WHEN hit THEN sha256(i || s || l || n || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS bad FROM f),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM h),
        nodes AS (SELECT grp, 0 AS lev, idx, n, leaf AS h FROM leaves UNION ALL
                  SELECT grp, lev + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY grp, lev, idx // 8, n),
        subs AS (SELECT grp, h, row_number() OVER (ORDER BY (SELECT any_value(lang) FROM h WHERE h.grp = nodes.grp) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
        upper AS (SELECT 0 AS lev, idx, n, h FROM subs UNION ALL
                  SELECT lev + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY lev, idx // 8, n),
        every AS (SELECT * FROM nodes UNION ALL SELECT 'all', * FROM upper),
        seg AS (SELECT a.grp, a.lev, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
                FROM every a JOIN every b ON a.grp = b.grp AND a.lev = b.lev AND a.idx // 8 = b.idx // 8 AND a.idx <> b.idx OR a.grp = b.grp AND a.lev = b.lev AND a.idx = b.idx GROUP BY ALL),
        fold AS (SELECT doc_id, leaf, grp, 0 AS lev, idx, n, coalesce(bad, leaf) AS acc, '' AS proof FROM leaves UNION ALL
                 SELECT doc_id, leaf, f.grp, f.lev + 1, f.idx // 8, (n + 7) // 8, sha256(l || acc || r), proof || l || r FROM fold f JOIN seg s ON f.grp = s.grp AND f.lev = s.lev AND f.idx = s.idx WHERE n > 1),
        mid AS (SELECT doc_id, leaf, f.acc, proof, s.h AS subroot, s.idx, s.n FROM fold f JOIN subs s ON f.grp = s.grp WHERE f.n = 1),
        fold2 AS (SELECT doc_id, leaf, subroot, 0 AS lev, idx, n, acc, proof FROM mid UNION ALL
                  SELECT doc_id, leaf, subroot, f.lev + 1, f.idx // 8, (n + 7) // 8, sha256(l || acc || r), proof || l || r FROM fold2 f JOIN seg s ON s.grp = 'all' AND f.lev = s.lev AND f.idx = s.idx WHERE n > 1)
        SELECT doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = (SELECT h FROM upper WHERE n = 1) AS verified
        FROM fold2 WHERE n = 1""",
    "op13_filter_audit": r"""
        WITH letters(k, f) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
        orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM letters a, letters b, letters c, letters d, letters e
                   WHERE (1 << a.k) | (1 << b.k) | (1 << c.k) | (1 << d.k) | (1 << e.k) = 31),
        d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
        firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
        lab AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        x AS (SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
                     100 * len(regexp_extract_all(w.t, '[A-Z]')) > 3 * length(w.t) AS c, regexp_matches(w.t, '[#$%&*|]') AS d, coalesce(w.doc_id > least, false) AS e,
                     coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
              FROM w JOIN firsts ON w.t = firsts.t LEFT JOIN lab ON w.doc_id = lab.doc_id),
        m AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failed,
                     count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM x GROUP BY ALL),
        s AS (SELECT o, i AS step, substr(o, i, 1) AS own, substr(o, 1, i - 1) AS before FROM orders, range(1, 6) r(i)),
        y AS (SELECT part, o, step, n, good, toxic, contains(failed, own) AS fails, failed = own AS only_it, own,
                     length(translate(failed, before, '')) < length(failed) AS gone FROM m, s),
        z AS (SELECT part, o AS filter_order, step, any_value(own) AS own, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed,
                     sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_it THEN n ELSE 0 END) AS unique_fails,
                     sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
              FROM y GROUP BY part, o, step)
        SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
               good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::bigint AS shapley FROM z""",
}
