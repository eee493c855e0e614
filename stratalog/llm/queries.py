"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.bpe import decode_ids, encode_texts, piece_table
from stratalog.llm.collocations import best_collocations, collocations
from stratalog.llm.decontam import contamination, contamination_digest
from stratalog.llm.exact import exact_groups
from stratalog.llm.html import extract_main_text
from stratalog.llm.jaccard import similar_groups
from stratalog.llm.licenses import scan_licenses
from stratalog.llm.mixing import mix_sources
from stratalog.llm.ordinal import fit_on_labels, grade_documents, select_documents
from stratalog.llm.periodic import periodic_runs, run_digest, with_repeats
from stratalog.llm.shared import Workspace, read_table
from stratalog.llm.substring import repeated_windows
from stratalog.llm.tokens import token_counts
from stratalog.llm.warc import read_archive, write_archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str = "") -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


@query(
    "op1_warc",
    """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS h FROM pages
    ), q AS (
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id,
               sha1(h) AS hex
        FROM p
    ), letters AS (
        SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * k, 5))::INT >> (15 - 5 * j)) & 31), 1), '' ORDER BY k, j) AS digest
        FROM (SELECT DISTINCT hex FROM q), range(8) a(k), range(4) b(j) GROUP BY hex
    )
    SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM q JOIN letters USING (hex)
    """,
)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "op1")
    write_archive(read_table(spark, sf_dir, "pages"), space, f"{space.path}/archive")
    return read_archive(space, f"{space.path}/archive").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op2_substring_dedup",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), windows AS (
        SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
        FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
    ), firsts AS (
        SELECT h, min(doc_id) AS least FROM windows GROUP BY h
    ), gone AS (
        SELECT DISTINCT r, unnest(range(i, i + 50)) AS j FROM windows JOIN firsts USING (h) WHERE least < doc_id OR (doc_id IS NULL AND least IS NOT NULL)
    ), kept AS (
        SELECT r, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n
        FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d) LEFT JOIN (SELECT r, j, 1 AS out FROM gone) USING (r, j)
        WHERE out IS NULL GROUP BY r
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (r)
    """,
)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_windows(docs, Workspace(spark, "op2")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(
    "op3_ngram_jaccard_join",
    r"""
    WITH RECURSIVE d AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), shingles AS (
        SELECT DISTINCT r, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
    ), sizes AS (
        SELECT r, count(*) AS n FROM shingles GROUP BY r
    ), met AS (
        SELECT a.r AS a, b.r AS b, count(*) AS common FROM shingles a JOIN shingles b USING (s) WHERE a.r < b.r GROUP BY a.r, b.r
    ), links AS (
        SELECT a, b FROM met JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * common >= 90 * (x.n + y.n - common)
    ), edges AS (
        SELECT a, b FROM links UNION ALL SELECT b, a FROM links
    ), reach(r, m) AS (
        SELECT r, r FROM d UNION SELECT reach.r, b FROM reach JOIN edges ON a = m
    )
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
    FROM d LEFT JOIN sizes USING (r) JOIN reach USING (r) JOIN d o ON o.r = m GROUP BY d.r, d.doc_id, n
    """,
)
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return similar_groups(docs, Workspace(spark, "op3"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query(
    "op4_benchmark_decontamination",
    r"""
    WITH low AS (
        SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
    ), d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low
    ), b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), bw AS (
        SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0
    ), phrases AS (
        SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM bw
    ), lengths AS (
        SELECT DISTINCT k FROM phrases
    ), dw AS (
        SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k
    ), hits AS (
        SELECT r, i, x.k, item_id FROM (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS p FROM dw) x JOIN phrases USING (k, p)
    ), covered AS (
        SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r
    ), items AS (
        SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
        FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits) GROUP BY r
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
    """,
)
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(contamination(docs, read_table(spark, sf_dir, "benchmark")))


@query(
    "op5_mix_sources",
    r"""
    WITH sizes AS (
        SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
    ), weighed AS (
        SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) AS weight, source_size * 2.0::DOUBLE AS cap
        FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)
    ), placed AS (
        SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(weight) OVER b, 0) AS weight_before, sum(source_size) OVER () * 1.5::DOUBLE AS whole,
               sum(weight) OVER () AS weights, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place
        FROM weighed WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), levels AS (
        SELECT *, (whole - cap_before) / (weights - weight_before) AS level FROM placed
    ), targets AS (
        SELECT source, source_size, least(cap, coalesce(weight * (SELECT level FROM levels WHERE cap > weight * level ORDER BY place LIMIT 1), cap)) AS target FROM levels
    ), shards AS (
        SELECT greatest(1, round_even(count(*) / 2048.0, 0))::BIGINT AS n FROM sizes
    ), dealt AS (
        SELECT s.*, ('0x' || substr(md5(concat_ws(':', doc_id, '20')), 1, 8))::BIGINT % n AS shard, md5(concat_ws(':', doc_id, '21')) AS line_key FROM sizes s, shards
    ), strata AS (
        SELECT shard, d.source, source_size, target, sum(size)::BIGINT AS stratum, CASE WHEN source_size > 0 THEN target * sum(size)::DOUBLE / source_size ELSE 0 END AS part
        FROM dealt d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source GROUP BY shard, d.source, source_size, target
    ), seats AS (
        SELECT shard, source, row_number() OVER (PARTITION BY shard ORDER BY part / (2 * seat - 1) DESC, source NULLS LAST, seat) AS place FROM strata, range(1, 4097) x(seat) WHERE part > 0
    ), quotas AS (
        SELECT shard, source, count(*) AS quota FROM seats WHERE place <= 4096 GROUP BY shard, source
    ), cut AS (
        SELECT s.*, floor(stratum * 2.0)::BIGINT AS most, least(floor(coalesce(quota, 0) * (sum(part) OVER (PARTITION BY s.shard) / 4096) + 0.5), floor(stratum * 2.0))::BIGINT AS first_tokens
        FROM strata s LEFT JOIN quotas q ON q.shard = s.shard AND q.source IS NOT DISTINCT FROM s.source
    ), rest AS (
        SELECT *, least(floor(target + 0.5), sum(most) OVER (PARTITION BY source)) - sum(first_tokens) OVER (PARTITION BY source) AS rest FROM cut
    ), rooms AS (
        SELECT *, CASE WHEN rest > 0 THEN most - first_tokens ELSE first_tokens END AS room FROM rest
    ), sums AS (
        SELECT *, sum(room) OVER (PARTITION BY source)::DOUBLE AS every, sum(room) OVER (PARTITION BY source ORDER BY shard ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto FROM rooms
    ), balanced AS (
        SELECT *, greatest(0, least(most, first_tokens + CASE WHEN every > 0 THEN floor(rest * (upto / every) + 0.5) - floor(rest * ((upto - room) / every) + 0.5) ELSE 0 END))::BIGINT AS tokens FROM sums
    ), lines AS (
        SELECT *, sum(size) OVER (PARTITION BY shard, source ORDER BY line_key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM dealt
    )
    SELECT doc_id, size, source_size::BIGINT AS source_size, target::DOUBLE AS target,
           CASE WHEN stratum > 0 THEN tokens // stratum * size + greatest(0, least(size, tokens % stratum - (l.upto - size))) ELSE 0 END::BIGINT AS taken
    FROM lines l JOIN balanced b ON b.shard = l.shard AND b.source IS NOT DISTINCT FROM l.source
    """,
)
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, Workspace(spark, "op5")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on_labels(docs, read_table(spark, sf_dir, "labels"))
    return select_documents(grade_documents(docs, model)).drop("text")


@query(
    "op7_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs, Workspace(spark, "op7"))


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their source and language are directories, 64 more below those."""
    docs = read_table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.pmod("doc_id", F.lit(64)).cast("string"))
    docs = docs.select("doc_id", "text", F.concat(folder, F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    return scan_licenses(docs, Workspace(spark, "op9"))


@query("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"), Workspace(spark, "op10"))


@query("op11_bpe_roundtrip")
def op11_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    encoded = encode_texts(read_table(spark, sf_dir, "documents"), tokenizer, Workspace(spark, "op11"))
    found = decode_ids(encoded, piece_table(spark, tokenizer))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op12_collocations",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), w AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
    ), totals AS (
        SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
    ), grams AS (
        SELECT lang, k, w[i:i + k - 1] AS g
        FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) x(k) WHERE len(w) >= k)
    ), f AS (
        SELECT lang, k, g, count(*) AS f FROM grams GROUP BY lang, k, g HAVING count(*) >= 30
    ), cuts AS (
        SELECT c.lang, c.g, c.f AS a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
        FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
        JOIN f x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN f y ON y.lang = c.lang AND y.g = c.g[j + 1:]
    ), lowest AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1
    ), inside AS (
        SELECT lang, g[i:i + m - 1] AS g, max(f) AS longer
        FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM f, range(2, 4) x(m) WHERE m < k) GROUP BY ALL
    ), ranked AS (
        SELECT lowest.lang, array_to_string(lowest.g, ' ') AS phrase, a, l, r, score
        FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.g = lowest.g
        WHERE longer IS NULL OR 100 * longer < 80 * a
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM ranked JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("text", "lang")
    return best_collocations(collocations(docs, Workspace(spark, "op12")))


@query(
    "op13_periodic_runs",
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), steps AS (
        SELECT r, list_concat([4294967295], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ascii(c)], [-1, -1, -1, -1, -1, -1, -1, -1])))) AS s
        FROM d WHERE doc_id IS NOT NULL
    ), crc AS (
        SELECT r, xor(list_reduce(s, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x::BIGINT) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h
        FROM (SELECT r, s::BIGINT[] AS s FROM steps)
    ), shape AS (
        SELECT d.r, doc_id, w, h, h // 10 AS g, len(w) AS n FROM d LEFT JOIN crc USING (r)
    ), planned AS (
        SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM shape
    ), t AS (
        SELECT r, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM planned
    ), factors AS (
        SELECT r, i, md5(array_to_string(w[i + 1:i + 16], ' ')) AS x FROM (SELECT r, w, unnest(range(0, len(w) - 15)) AS i FROM t WHERE len(w) >= 24)
    ), met AS (
        SELECT a.r, b.i - a.i AS q, a.i FROM factors a JOIN factors b ON a.r = b.r AND a.x = b.x AND a.i < b.i
    ), islands AS (
        SELECT r, q, min(i) AS start, max(i) - min(i) + 16 + q AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM met) GROUP BY r, q, island
    ), stretches AS (
        SELECT * FROM islands WHERE length >= greatest(24, 3 * q)
    ), runs AS (
        SELECT * FROM stretches s WHERE NOT EXISTS (
            SELECT 1 FROM stretches o WHERE o.r = s.r AND o.q < s.q AND o.start <= s.start AND o.start + o.length >= s.start + s.length)
    ), gone AS (
        SELECT DISTINCT r, unnest(range(start + q, start + length)) AS j FROM runs
    ), kept AS (
        SELECT r, string_agg(word, ' ' ORDER BY j) AS c
        FROM (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS j FROM t) LEFT JOIN (SELECT *, 1 AS out FROM gone) USING (r, j)
        WHERE out IS NULL GROUP BY r
    ), listed AS (
        SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY r
    ), best AS (
        SELECT * FROM runs b WHERE NOT EXISTS (
            SELECT 1 FROM runs o WHERE o.r = b.r AND (o.length * b.q > b.length * o.q OR (o.length * b.q = b.length * o.q AND (o.start, o.q) < (b.start, b.q))))
    )
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, q::BIGINT AS period,
           (1000 * length // q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
    FROM t LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
    """,
)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(with_repeats(read_table(spark, sf_dir, "documents"))))
