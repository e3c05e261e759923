"""The registered queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_extract, importance, licenses, mixing, ngram_join, phrases, quality_model, quality_rules, simhash, substring, url_filter, url_labels
from .common import table


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[bytes, str]:
    """Rank file and pattern of a public tokenizer that is installed beside Python."""
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *tokenizer())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), labelled=url_labels.table(spark))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_fingerprints(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.best_phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_quality_rules, op3_url_filter, op4_quality_classifier, op5_near_dup, op6_mixing, op7_substring_dedup, op8_licenses, op9_exact_dedup, op10_html, op11_importance, op12_simhash, op13_phrases)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Queries that SQL can express whole; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op7_substring_dedup": r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        s AS (SELECT r, i, w[i] AS word, CASE WHEN i + 34 <= len(w) THEN array_to_string(w[i:i + 34], ' ') END AS win FROM p), c AS (SELECT r, i, word, CASE WHEN win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 THEN 1 ELSE 0 END AS again FROM s),
        g AS (SELECT *, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c), a AS (SELECT r, count(*) AS n, count(*) FILTER (gone = 1) AS x, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY 1)
        SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(x, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (r)""",
    "op5_near_dup": rf"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents), h AS (SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT r, count(*) AS n FROM h GROUP BY 1), k AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM h a JOIN h b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2), l AS (SELECT a, b FROM k JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        t(r, c) AS (SELECT r, r FROM d UNION SELECT e.b, t.c FROM t JOIN e ON e.a = t.r) SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.m AS component_id FROM d LEFT JOIN n USING (r) JOIN (SELECT t.r, min(o.doc_id) AS m FROM t JOIN d o ON o.r = t.c GROUP BY 1) m ON m.r = d.r""",
    "op9_exact_dedup": f"""SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS t FROM documents) WINDOW g AS (PARTITION BY t)""",
    "op13_phrases": rf"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
        g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w), f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS ph, k, count(*) AS f FROM g, range(1, 6) r(k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3 HAVING count(*) >= 100), c AS (SELECT lang, ph, k, f, string_split(ph, ' ') AS ws FROM f WHERE k > 1),
        x AS (SELECT DISTINCT s.lang, s.ph FROM (SELECT lang, f, array_to_string(ws[i:j], ' ') AS ph FROM c, range(1, 5) a(i), range(2, 6) b(j) WHERE i < j AND j <= k AND j - i + 1 < k) s JOIN c ON c.lang = s.lang AND c.ph = s.ph AND 100 * s.f >= 100 * c.f),
        u AS (SELECT c.lang, c.ph, c.f AS a, cut, p.f AS l, q.f AS r, n, (1000::HUGEINT * c.f * n) // (p.f::HUGEINT * q.f) AS score FROM c JOIN n USING (lang) JOIN range(1, 5) r(cut) ON cut < k JOIN f p ON p.lang = c.lang AND p.ph = array_to_string(ws[:cut], ' ') JOIN f q ON q.lang = c.lang AND q.ph = array_to_string(ws[cut + 1:], ' ') WHERE NOT EXISTS (FROM x WHERE x.lang = c.lang AND x.ph = c.ph)),
        b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, ph) AS rank, ph AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM b QUALIFY rank <= 2000""",
    "op6_mixing": r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS stop, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
        l AS (SELECT *, total - coalesce(sum(stop) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights FROM w WINDOW b AS (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v AS (SELECT coalesce(arg_min(rest / weights, stop / weight) FILTER (rest / weights <= stop / weight), 'inf'::DOUBLE) AS level FROM l),
        t AS (SELECT source, source_size, least(weight * level, stop) AS target FROM l, v),
        p AS (SELECT *, least(CAST(floor(coalesce(target / nullif(source_size, 0), 0)) AS BIGINT), 3) AS passes FROM t),
        o AS (SELECT d.*, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN before + size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o""",
}
