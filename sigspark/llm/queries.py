"""The thin queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, elkan, htmltext, labelled, linededup, periodic, quality, quotes, simhash, tokenbin, toxicity, urlfilter, warc

END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


URL_RULES = [
    urlfilter.Rule("allow", "com"),
    urlfilter.Rule("block", "example.com", "/en/"),
    urlfilter.Rule("allow", "www.example.com", "/en/"),
    urlfilter.Rule("block", "net", "/es/"),
    urlfilter.Rule("block", "net", "/fr/"),
]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.flagged(toxicity.score(docs, model, keep=["doc_id"]))
    return scored.select("doc_id", (labelled.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", "n_links", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.link_quotes(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return out.select("thread_id", "conv_id", "turn", "role", "reply_conv", "reply_turn", "n_quotes", "n_linked", F.col("own_text").alias("text"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_on(docs, _table(spark, sf_dir, "labels"))
    return quality.judge(docs, model, keep=["doc_id"])


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_path("byte_bpe_50k.json"), tokenizer_pattern()
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = tokenbin.write_files(docs, lambda texts: bpe.encoder_of_json(path, pattern).encode(texts), tokenbin.new_folder(spark), end_id=END_ID)
    read = tokenbin.read_files(manifest, "n_read bigint, ids_crc32 bigint", tokenbin.crc_of_runs, ["doc_id", "start"])
    return read.select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern(), keep=["doc_id"])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, keep=["doc_id"]).select("doc_id", "fingerprint", "component_id")


def op11_elkan_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = elkan.cluster(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return elkan.with_cluster_values(found, centroids, "vec_id")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.select("doc_id", periodic.with_planted_period(F.col("text"), h).alias("text"))
    return periodic.digests(periodic.find_runs(docs, keep=["doc_id"]))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    manifest = warc.write_archives(pages, warc.shared_dir(spark))
    found = warc.by_row(warc.read_records(warc.index_of(manifest)), "page_id", pages.schema["page_id"].dataType.simpleString())
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_url_filters": op3_url_filters,
    "op4_line_dedup": op4_line_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_binary": op8_token_binary,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash": op10_simhash,
    "op11_elkan_clustering": op11_elkan_clustering,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_warc": op13_warc,
    "pipeline": pipeline,
}


def _kmeans_sql(dim: int = 64, k: int = 40, rounds: int = 5) -> str:
    """Each round unrolled: the nearest of all centroids by exact distances, then floors of means."""
    parts = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
          WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, 'null')) AS h, v FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    squares = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (kept.v[i] - c.v[i]) * (kept.v[i] - c.v[i])))::BIGINT"
    for r in range(rounds + 1):
        parts.append(f"a{r} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT rid, vec_id, kept.v AS v, c.c AS c, {squares} AS d FROM kept, c{r} c) GROUP BY rid)")
        if r < rounds:
            parts.append(
                f"""m{r} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, (s - ((s % n) + n) % n) // n AS m FROM
                  (SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i)) GROUP BY c)"""
            )
            parts.append(f"c{r + 1} AS (SELECT c{r}.c AS c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} ON c{r}.c = m{r}.c)")
    last = f"a{rounds}"
    return (
        "WITH " + ", ".join(f"{x.split(' AS ', 1)[0]} AS MATERIALIZED {x.split(' AS ', 1)[1]}" for x in parts)
        + f""" SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
          sha256(array_to_string(cv, ',')) AS centroid_sha256 FROM (SELECT {last}.*, c{rounds}.v AS cv FROM {last} JOIN c{rounds} ON {last}.c = c{rounds}.c)"""
    )


def _terms(terms: tuple[str, ...]) -> str:
    return ", ".join(f"'{t}'" for t in terms)


ORACLE_SQL: dict[str, str] = {
    "op2_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS g
               FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT m FROM iw),
        dw AS (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS g
               FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, lens WHERE len(w) >= m)),
        hit AS (SELECT doc_id, item_id, p, m FROM dw JOIN iw USING (m, g)),
        n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM hit) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
          sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op3_url_filters": rf"""
        WITH u AS (
          SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
            CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
            CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
          FROM pages),
        r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fits AS (
          SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
          FROM u, r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
        words AS (
          SELECT page_id, count(*) FILTER (WHERE w IN ({_terms(urlfilter.STRICT)})) AS n_strict, count(*) FILTER (WHERE w IN ({_terms(urlfilter.SOFT)})) AS n_soft
          FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(low, '[a-z0-9]+')) AS w FROM u) GROUP BY page_id)
        SELECT u.page_id, host, path, rule, coalesce(fits.verdict, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END) AS verdict
        FROM u LEFT JOIN fits USING (page_id) LEFT JOIN words USING (page_id)""",
    # the halves of lines within an edit: the same exact candidates, and levenshtein to judge them
    "op4_line_dedup": r"""
        WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
        l AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM raw),
        d AS (SELECT DISTINCT line, length(line) AS n FROM l WHERE line <> ''),
        k AS (SELECT line, n, n AS t, 0 AS s, unnest([0, 1]) AS j FROM d UNION ALL SELECT line, n, n - 1, 1, unnest([0, 1]) FROM d),
        e AS (SELECT line, n, t, s, j, CASE WHEN j = 1 THEN left(line, (t // 2)::INT) ELSE right(line, (t - t // 2)::INT) END AS half FROM k),
        near AS (SELECT DISTINCT least(a.line, b.line) AS a, greatest(a.line, b.line) AS b FROM e a JOIN e b ON a.t = b.t AND a.j = b.j AND a.half = b.half AND a.s = 0 AND a.line <> b.line
                 WHERE levenshtein(a.line, b.line) <= least(1, least(a.n, b.n) // 10)),
        both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
        reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, w.b FROM reach JOIN both_ways w ON reach.b = w.a),
        root AS (SELECT a AS line, min(b) AS root FROM reach GROUP BY a),
        links AS (SELECT a AS line, count(*) AS links FROM both_ways GROUP BY a),
        m AS (SELECT l.doc_id, l.pos, l.raw, l.line, coalesce(links, 0) AS links, row_number() OVER (PARTITION BY coalesce(root, l.line) ORDER BY l.doc_id, l.pos) AS nth
              FROM l LEFT JOIN root USING (line) LEFT JOIN links USING (line)),
        per AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE line <> '' AND nth > 1) AS n_dropped, sum(links) AS n_links,
                  string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE line = '' OR nth = 1) AS kept FROM m GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped, coalesce(n_links, 0)::BIGINT AS n_links,
          CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS text_sha256
        FROM documents d LEFT JOIN per USING (doc_id)""",
    "op11_elkan_clustering": _kmeans_sql(),
    "op13_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, body, upper(sha1(body)) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
        SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
          array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || h[1 + 5 * (i // 4) : 5 + 5 * (i // 4)])::INT // (32 ** (3 - i % 4))::INT) % 32)]), '') AS payload_digest,
          CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d""",
}
