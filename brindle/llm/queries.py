"""The registered query of each operator, over whole tables and with production parameters."""

from __future__ import annotations

from brindle.llm.common import documents, vocabulary


def op1_license_compression(spark, sf_dir):
    from brindle.llm.licences import scan_licences

    return scan_licences(documents(spark, sf_dir))


def op2_nnls_packing(spark, sf_dir):
    from brindle.llm.packing import pack

    return pack(documents(spark, sf_dir), vocabulary(), window=1024, end_id=0)


def op3_tokeniser_fertility(spark, sf_dir):
    from brindle.llm.quality_rules import quality_rules

    return quality_rules(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"), second=vocabulary("byte_bpe_multi_50k.tiktoken"))


def op4_source_mixing(spark, sf_dir):
    from brindle.llm.mixing import mix_sources

    return mix_sources(documents(spark, sf_dir))


def op5_bloom_exact_dedup(spark, sf_dir):
    from brindle.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op6_huffman_ids(spark, sf_dir):
    from brindle.llm.huffman import ids_round_trip

    return ids_round_trip(documents(spark, sf_dir), vocabulary(), end_id=2)


def op7_signature_tree_join(spark, sf_dir):
    from brindle.llm.jaccard import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op8_weak_labels(spark, sf_dir):
    from brindle.llm.weak_labels import weak_label_scores

    return weak_label_scores(documents(spark, sf_dir))


def op9_pii_spans(spark, sf_dir):
    from brindle.llm.pii import pii_digest

    return pii_digest(documents(spark, sf_dir))


def op10_language_profiles(spark, sf_dir):
    from brindle.llm.language_id import identify_language

    return identify_language(documents(spark, sf_dir))


def base_counts(spark, sf_dir):
    """What ``op3`` counts before any tokeniser, so far as SQL can say it."""
    from brindle.llm.quality_rules import quality_rules

    rows = quality_rules(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mix_targets(spark, sf_dir):
    """Sizes and targets of ``op4``, without the draws: one row for each document, targets to a thousandth."""
    return op4_source_mixing(spark, sf_dir).selectExpr("doc_id", "size", "source_size", "round(target, 3) AS target", "taken <= 3 * size AS within_limit")


def pii_base_counts(spark, sf_dir):
    """The base kinds of ``op9``, without places."""
    return op9_pii_spans(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


_OPERATORS = (op1_license_compression, op2_nnls_packing, op3_tokeniser_fertility, op4_source_mixing, op5_bloom_exact_dedup, op6_huffman_ids, op7_signature_tree_join, op8_weak_labels, op9_pii_spans, op10_language_profiles)
#: One query for each operator, and those parts of them that SQL can express where it can't express the whole.
QUERIES = {f.__name__: f for f in (*_OPERATORS, base_counts, mix_targets, pii_base_counts)}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
ORACLES = {
    "op5_bloom_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(folded) AS text_sha256
        FROM (SELECT doc_id, {_FOLD} AS folded FROM documents) WINDOW w AS (PARTITION BY folded)""",
    "op7_signature_tree_join": f"""
        WITH RECURSIVE docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents),
        shingles AS (SELECT DISTINCT r, s FROM (SELECT r, unnest(
            CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs)),
        sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
        shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        reach AS (SELECT r AS a, r AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least AS component_id
        FROM docs d LEFT JOIN sizes USING (r) JOIN (SELECT a, min(doc_id) AS least FROM reach JOIN docs ON r = b GROUP BY a) ON a = d.r""",
    "base_counts": f"""
        WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
        windows AS (SELECT r, i, w[i:i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
        again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
        covered AS (SELECT r, count(DISTINCT i + j) AS n FROM again, (VALUES (0), (1), (2)) o(j) GROUP BY r),
        lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{_WORD}') GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
               length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
               len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed
        FROM docs LEFT JOIN covered USING (r) LEFT JOIN lines USING (r)""",
    "mix_targets": f"""
        WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
        sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS sid FROM docs GROUP BY source),
        weighed AS (SELECT *, ((sid - 1) % 3 + 1)::DOUBLE AS weight, 3.0 * source_size AS cap FROM sources),
        shared AS (SELECT *, row_number() OVER o AS place,
            (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM weighed WINDOW o AS (ORDER BY cap / weight, sid)),
        level AS (SELECT min_by(share, place) AS share, min(place) AS place FROM shared WHERE cap / weight > share),
        targets AS (SELECT s.source, s.source_size, CASE WHEN level.place IS NULL OR s.place < level.place THEN s.cap ELSE level.share * s.weight END AS target FROM shared s, level)
        SELECT doc_id, size, source_size, round(target::DOUBLE, 3) AS target, true AS within_limit
        FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source""",
    "pii_base_counts": r"""
        WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS t FROM documents),
        cards AS (SELECT r, count(*) AS n FROM (SELECT r, list_reverse(list_transform(regexp_extract_all(m, '[0-9]'), lambda x: x::INT)) AS d
                  FROM (SELECT r, unnest(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+')) AS m FROM docs))
                  WHERE len(d) BETWEEN 12 AND 19 AND list_sum(list_transform(d, lambda x, i: CASE WHEN i % 2 = 1 THEN x WHEN x > 4 THEN 2 * x - 9 ELSE 2 * x END)) % 10 = 0 GROUP BY r)
        SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
               len(list_filter(regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
                   lambda m: len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR lpad(right(p, 3), 3, '0') > '255')) = 0)) AS n_ip,
               coalesce(cards.n, 0) AS n_card,
               len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone
        FROM docs LEFT JOIN cards USING (r)""",
}
