"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm import (
    alignment,
    chat,
    collocations,
    crosspolytope,
    langid,
    licenses,
    linededup,
    mixing,
    packing,
    personal,
    tgm,
    warc,
    winnow,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TOKENIZER_FILE = "byte_bpe_50k.json"
PIECES_FILE = "piece_bpe_32k.model"


def _register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(file: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(file)


@_register("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(
        _table(spark, sf_dir, "documents"),
        tokenizer_path(),
        digest={"ids_crc32": F.crc32("ids")},
    ).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LINES_SQL = f"""
WITH docs AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM docs
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12)
    || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS k FROM lines
), held AS (
  SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT doc_id, pos, line, top IS NOT NULL AND doc_id <> top AS gone
  FROM keyed LEFT JOIN held USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines,
  (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
    AS kept_sha256
FROM judged GROUP BY doc_id
"""


@_register("op6_line_dedup", _LINES_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_repeated_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, source_size * 3 AS cap,
    ((sum(source_size) OVER ())
      - coalesce(sum(source_size * 3) OVER (ORDER BY (source_size * 3)::DOUBLE / weight,
          source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY (source_size * 3)::DOUBLE / weight,
          source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM named
), shared AS (
  SELECT *, cap::DOUBLE < level * weight AS capped FROM levels
), aimed AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
    (max(CASE WHEN NOT capped THEN level END) OVER ()) * weight END AS target
  FROM shared
), sources AS (
  SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS certain FROM aimed
), wanting AS (
  SELECT *, target - certain * source_size AS wanted,
    (target - certain * source_size) / greatest(source_size, 1) AS p FROM sources
), uniform AS (
  SELECT *, (('0x' || substr(md5('7:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5)
    / 4503599627370496.0 AS u FROM sized
), ranked AS (
  SELECT d.doc_id, d.source, size, source_size, target, certain, wanted,
    CASE WHEN p > 0 THEN u / (1 - u) / (p / greatest(1 - p, 1e-15)) END AS q
  FROM uniform d JOIN wanting s ON d.source IS NOT DISTINCT FROM s.source
), ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked
), chosen AS (
  SELECT *, q IS NOT NULL AND upto <= wanted AS in_order FROM ordered
), gaps AS (
  SELECT *, wanted - coalesce(max(CASE WHEN in_order THEN upto END)
    OVER (PARTITION BY source), 0) AS gap FROM chosen
), closing AS (
  SELECT *, CASE WHEN NOT in_order AND q IS NOT NULL AND abs(size - gap) < gap THEN
    row_number() OVER (PARTITION BY source, NOT in_order AND q IS NOT NULL
      AND abs(size - gap) < gap ORDER BY abs(size - gap), q, doc_id) END AS nearest
  FROM gaps
)
SELECT doc_id, size, source_size, target,
  size * (certain + CASE WHEN in_order OR coalesce(nearest, 0) = 1 THEN 1 ELSE 0 END) AS taken
FROM closing
"""


@_register("op7_mixing", _MIX_SQL)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


@_register("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(
        F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False)
    )
    model = langid.fit(docs.where(~held_out))
    return docs.select(
        "doc_id",
        held_out.alias("held_out"),
        langid.language(F.col("text"), model).alias("_found"),
    ).select(
        "doc_id",
        "held_out",
        F.col("_found.lang").alias("lang_pred"),
        F.col("_found.score").alias("score"),
    )


@_register("op2_winnowing")
def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_edit(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnow.digest(F.col("chosen")).alias("fingerprint"),
        winnow.digest(F.col("edited_chosen")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@_register("op8_ngram_jaccard")
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tgm.jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


@_register("op3_cross_polytope")
def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.nearest(
        _table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 50 == 0
    )


def _license_sql() -> str:
    values = ", ".join(
        f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in licenses.TEMPLATES
    )
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
    runs = "[array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]"
    return f"""
WITH templates(license, text) AS (VALUES {values}),
wanted AS (SELECT DISTINCT license, unnest({runs}) AS s FROM
  (SELECT license, {words} AS ws FROM templates)),
totals AS (SELECT license, count(*) AS total FROM wanted GROUP BY license),
held AS (SELECT DISTINCT doc_id, unnest({runs}) AS s FROM
  (SELECT doc_id, {words} AS ws FROM documents)),
hits AS (SELECT doc_id, license, count(*)::BIGINT AS matched
  FROM held JOIN wanted USING (s) GROUP BY doc_id, license)
SELECT doc_id, license, matched, total::BIGINT AS total, matched::DOUBLE / total AS containment
FROM hits JOIN totals USING (license) WHERE matched::DOUBLE / total >= 0.8
"""


@_register("op5_license_scan", _license_sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


_CHAT_SQL = """
WITH clean AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM clean
), prefixes AS (
  SELECT conv_id, place, n_turns, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>'
    || chr(10), '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM placed
), wholes AS (
  SELECT min(conv_id) AS conv_id, n_turns, prefix FROM prefixes WHERE place = n_turns
  GROUP BY n_turns, prefix
)
SELECT conv_id, n_turns::BIGINT AS n_turns, prefix AS chat FROM wholes w
WHERE NOT EXISTS (SELECT 1 FROM prefixes p
  WHERE p.place < p.n_turns AND p.place = w.n_turns AND p.prefix = w.prefix)
"""


@_register("op9_chat_snapshots", _CHAT_SQL)
def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


#: Pages in an archive file, and which records of the second replica are damaged; foreign ones stand
#: beside sound records of the same key. Pages without an id are filed by their URL.
PAGES_PER_FILE = 1024
_ROT, _CUT, _LOST, _FOREIGN = (97, 13), (193, 7), (251, 5), (311, 17)
_WARC_SQL = f"""
WITH bodies AS (
  SELECT page_id, coalesce(page_id // {PAGES_PER_FILE},
      -1 - ('0x' || left(md5(coalesce(url, '')), 4))::BIGINT) AS file, coalesce(url, '') AS url,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8'
      || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS body,
    coalesce(html, '') AS html FROM pages
), records AS (
  SELECT page_id, file, html, url, 149 + strlen(page_id::VARCHAR) + strlen(url)
    + strlen(strlen(body)::VARCHAR) + strlen(body) + 4 AS length FROM bodies
), placed AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM records
), damaged AS (
  SELECT *, page_id % {_LOST[0]} = {_LOST[1]} AS lost, CASE
    WHEN page_id % {_CUT[0]} = {_CUT[1]} THEN left(html, length(html) // 2)
    WHEN page_id % {_ROT[0]} = {_ROT[1]} THEN left(html, length(html) - 1) || '#'
    ELSE html END AS found_html FROM placed
), sized AS (
  SELECT *, length - strlen(html) + strlen(found_html)
    - strlen((59 + strlen(html))::VARCHAR) + strlen((59 + strlen(found_html))::VARCHAR) AS now
  FROM damaged
), ends AS (
  SELECT file, sum(length) AS file_end FROM records GROUP BY file
), foreign_records AS (
  SELECT file, page_id, 149 + strlen(page_id::VARCHAR) + strlen(url) + 6 + 2 + 59 + 4 AS length
  FROM sized WHERE page_id % {_FOREIGN[0]} = {_FOREIGN[1]} AND NOT lost AND found_html = html
)
SELECT file, page_id, "offset", length::BIGINT AS length,
  CASE WHEN lost THEN 0 ELSE now END::BIGINT AS found,
  CASE WHEN lost THEN 'missing' WHEN now <> length THEN 'resized' ELSE 'changed' END AS state
FROM sized WHERE lost OR found_html <> html
UNION ALL
SELECT file, page_id, (file_end + coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT, NULL, length::BIGINT, 'extra'
FROM foreign_records JOIN ends USING (file)
"""


@_register("op10_warc_fixity", _WARC_SQL)
def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica of all pages: some records rotted, were cut, got lost or came from elsewhere."""
    page, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    n = F.length(html)
    damaged = (
        F.when(page % _CUT[0] == _CUT[1], F.left(html, F.floor(n / 2).cast("int")))
        .when(page % _ROT[0] == _ROT[1], F.concat(F.left(html, n - 1), F.lit("#")))
        .otherwise(html)
    )
    unnamed = -1 - F.conv(F.left(F.md5(F.coalesce("url", F.lit(""))), F.lit(4)), 16, 10).cast("long")
    file = F.coalesce(F.floor(page / PAGES_PER_FILE).cast("long"), unnamed)
    pages = _table(spark, sf_dir, "pages").withColumn("file", file)
    lost = F.coalesce(page % _LOST[0] == _LOST[1], F.lit(False))

    def records(rows: DataFrame, url: Column, content: Column) -> DataFrame:
        record = warc.response_record(page, url, content)
        return rows.select("file", page.alias("key"), record.alias("record"))

    url = F.col("url")
    ours = warc.index(warc.digests(records(pages, url, html)))
    foreign = pages.where(
        (page % _FOREIGN[0] == _FOREIGN[1]) & ~lost & (damaged == html)
    )
    replica = records(pages.where(~lost), url, damaged).union(
        records(foreign, F.concat(F.coalesce(url, F.lit("")), F.lit("#again")), F.lit(""))
    )
    theirs = warc.held(warc.digests(replica), ours)
    return warc.audit(ours, theirs).withColumnRenamed("key", "page_id").select(
        "file",
        "page_id",
        "offset",
        "length",
        F.coalesce("found", F.lit(0)).alias("found"),
        "state",
    )


_PHRASES_SQL = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), totals AS (
  SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY lang
), counts AS (
  SELECT lang, m, phrase, count(*) AS a FROM (
    SELECT lang, m, unnest([array_to_string(ws[i:i + m - 1], ' ') for i in range(1, len(ws) - m + 2)])
      AS phrase FROM pieces, (SELECT unnest(range(1, 6)) AS m))
  GROUP BY lang, m, phrase HAVING count(*) >= 100
), candidates AS (
  SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM counts WHERE m > 1
), inner_parts AS (
  SELECT c.lang, array_to_string(c.ws[i:i + k - 1], ' ') AS phrase, max(c.a) AS longer
  FROM candidates c, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 5)) AS k)
  WHERE k < c.m AND i + k - 1 <= c.m GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_parts p USING (lang, phrase)
  WHERE p.longer IS NULL OR 100 * p.longer < 100 * c.a
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, n,
    (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM kept c, (SELECT unnest(range(1, 5)) AS k), counts l, counts r, totals t
  WHERE k < c.m AND t.lang = c.lang
    AND l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:k], ' ')
    AND r.lang = c.lang AND r.phrase = array_to_string(c.ws[k + 1:c.m], ' ')
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM weakest QUALIFY rank <= 2000
"""


@_register("op12_collocations", _PHRASES_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


@_register("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(
        _table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES_FILE)
    )


@_register("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return personal.find(docs, personal.fit(docs))
