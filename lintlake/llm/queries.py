"""The operators of this subpackage as queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm import decontaminate, licenses, lines, pages, pieces, quality, runs, simhash, spelling, suffixes, urls, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the tests they hold to a half or more."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "marked", "n_tokens", "coverage")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("kept_md5"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("spans")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), check_col="lossless")
    n_pieces = F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long")
    return coded.select("doc_id", n_pieces.alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "lossless")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_k(table(spark, sf_dir, "embeddings"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in one document of ten the words from a place on repeat with a period,
    both drawn from the id."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    own = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    own = own.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, words).alias("w"))
    own = own.withColumn("n", F.when(F.size("w") > 0, F.size("w"))).withColumn("a", F.col("g") % F.col("n"))
    own = own.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return own.select("doc_id", F.coalesce(repeated, "text").alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_with_periods(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    spelt = F.array_join(F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(spelt, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_main_text": op2_main_text,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_warc": op6_warc,
    "op7_licenses": op7_licenses,
    "op8_suffixes": op8_suffixes,
    "op9_simhash": op9_simhash,
    "op10_pieces": op10_pieces,
    "op11_spelling": op11_spelling,
    "op12_top_k": op12_top_k,
    "op13_runs": op13_runs,
}

def _canonical_sql(text: str) -> str:
    """The canonical form of ``licenses`` in DuckDB's functions."""
    low = f"lower({text})"
    for old, new in licenses.SPELLINGS:
        low = f"replace({low}, '{old}', '{new}')"
    lines = licenses.COPYRIGHT_LINE.replace("(?dm)", "(?m)")
    marks = licenses.PUNCTUATION.replace("'", "''")
    plain = f"regexp_replace(regexp_replace({low}, '{lines}', '', 'g'), '{marks}', ' ', 'g')"
    return f"regexp_replace({plain}, ' *\\n *', chr(10), 'g')"


def _flat_sql(form: str) -> str:
    return f"trim(regexp_replace({form}, '[ \\n]+', ' ', 'g'))"


_KNOWN = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.KNOWN)
_BASE32 = (
    "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +"
    " ((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '')"
)

_CRC_TABLE = [0] * 256
for _i in range(256):
    _CRC_TABLE[_i] = _i
    for _ in range(8):
        _CRC_TABLE[_i] = (_CRC_TABLE[_i] >> 1) ^ (0xEDB88320 * (_CRC_TABLE[_i] & 1))


def _crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes in DuckDB's functions."""
    digits = f"hex(encode({text}))"
    byte = f"CAST('0x' || substr({digits}, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)"
    step = f"xor(c >> 8, {_CRC_TABLE}[CAST(1 + (xor(c, b) & 255) AS INTEGER)])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(strlen({text})), lambda i: {byte})), lambda c, b: {step}), 4294967295)"


_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES = {
    "op11_spelling": rf"""
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_A_Z}', '{_A_Z.lower()}'), '[a-zÀ-ÿ]+')) AS run FROM documents
), counted AS (
  SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT *, coalesce({_crc32_sql("CAST(doc_id AS VARCHAR) || ':' || run")}, 1) AS h FROM counted
), spoilt AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) + 2 AS INTEGER)) ELSE run END AS word
  FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), cut AS (
  SELECT word, n, i, left(word, CAST(i - 1 AS INTEGER)) || substr(word, CAST(i + 1 AS INTEGER)) AS rest FROM places
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), way(word, top) AS (
  SELECT word, word FROM judged
  UNION SELECT way.word, j.form FROM way JOIN judged j ON j.word = way.top WHERE j.form IS NOT NULL
)
SELECT j.word, j.form, w.top AS root, j.n, j.n_near, j.form_n
FROM judged j JOIN way w ON w.word = j.word JOIN judged e ON e.word = w.top WHERE e.form IS NULL
""",
    "op12_top_k": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_inner_product(q.x, c.x) AS BIGINT)) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.x) = len(q.x) GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
""",
    "op13_runs": rf"""
WITH split AS (
  SELECT row_number() OVER () AS row_no, doc_id, {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), drawn AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM split
), words AS (
  SELECT row_no, i, w[CASE WHEN a IS NULL OR i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM drawn)
), equal AS (
  SELECT x.row_no, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.row_no = y.row_no AND x.word = y.word AND y.i > x.i
  JOIN drawn d ON d.row_no = x.row_no WHERE 4 * (y.i - x.i) <= d.n
), islands AS (
  SELECT row_no, q, min(i) AS s, count(*) + q AS len
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row_no, q ORDER BY i) AS island FROM equal) GROUP BY row_no, q, island
), long AS (
  SELECT * FROM islands WHERE len >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM long r WHERE NOT EXISTS (
    SELECT 1 FROM long p WHERE p.row_no = r.row_no AND p.q < r.q AND r.q % p.q = 0 AND p.s <= r.s AND p.s + p.len >= r.s + r.len)
), listed AS (
  SELECT row_no, count(*) AS n_runs, string_agg(concat(s, ',', len, ',', q, chr(10)), '' ORDER BY s, q) AS spelt,
         first(struct_pack(s := s, len := len, q := q) ORDER BY len DESC, s, q) AS best
  FROM runs GROUP BY row_no
), kept AS (
  SELECT w.row_no, string_agg(w.word, ' ' ORDER BY w.i) AS rest FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.row_no = w.row_no AND w.i >= r.s + r.q AND w.i < r.s + r.len) GROUP BY w.row_no
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.len AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
       CAST(1000 * best.len // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(spelt, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM drawn d LEFT JOIN listed USING (row_no) LEFT JOIN kept USING (row_no)
""",
    "op6_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS size, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM d
""",
    "op7_licenses": f"""
WITH known AS (SELECT {_flat_sql(_canonical_sql("body"))} AS unit, min(license) AS license FROM (VALUES {_KNOWN}) AS k(license, body) GROUP BY 1),
forms AS (SELECT doc_id, {_canonical_sql("text")} AS form FROM documents WHERE text IS NOT NULL),
units AS (
  SELECT doc_id, 'text' AS scope, {_flat_sql("form")} AS unit FROM forms
  UNION ALL SELECT doc_id, 'paragraph', {_flat_sql("part")} FROM (SELECT doc_id, unnest(string_split_regex(form, '\n\n+')) AS part FROM forms)
  UNION ALL SELECT doc_id, 'line', trim(part) FROM (SELECT doc_id, unnest(string_split(form, chr(10))) AS part FROM forms)
)
SELECT doc_id, license, scope, count(*) AS n_units FROM units JOIN known USING (unit) WHERE unit <> '' GROUP BY ALL
""",
    "op5_url_filter": r"""
WITH raw AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM raw
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(r.verdict, length(rule_host || rule_path)) AS verdict
  FROM parts p JOIN rules r
    ON (p.host = r.rule_host OR p.host LIKE '%.' || r.rule_host) AND starts_with(p.path, r.rule_path)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule,
       coalesce(b.verdict, CASE
         WHEN regexp_matches(p.host || p.path,
           '(^|[.-])casino[.-]|(^|[.-])free-bets[.-]|(^|[.-])ads-track[.-]|(^|[.-])(porn|xxx-\w+)[.-]')
           OR regexp_matches(p.host || p.path, '^([^/]*\.)?doubleclick\.')
           OR regexp_matches(p.host || p.path, '/wp-login\.php$')
         THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
""",
}
