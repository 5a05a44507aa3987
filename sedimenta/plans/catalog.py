"""All queries of the archive engine by name, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions import codecs, kernels, policy
from sedimenta.functions import constants as C
from sedimenta.operators import archive, chunking, folds, micro, ordering, planning, similarity
from sedimenta.sources import files as sources

CHUNK = 1024
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str = ""):
    def add(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# ---- views in SQL

FILES = f"""files AS (
  SELECT doc_id AS file_index, lang || '/' || source || '/' || doc_id || '.' || e AS path, e AS ext, CAST(strlen(text) AS BIGINT) AS raw_size, text, hex(encode(text)) AS hx
  FROM (SELECT *, list_extract([{_list(sources.EXTENSIONS)}], CAST(CAST(substr(source, 4, 10) AS INTEGER) % {len(sources.EXTENSIONS)} + 1 AS INTEGER)) AS e FROM documents))"""
CHUNKS = f"""chunks AS (
  SELECT file_index, chunk_no, CAST(length(part) / 2 AS BIGINT) AS raw_len, sha256(unhex(part)) AS h32
  FROM (SELECT file_index, chunk_no, substr(hx, CAST(chunk_no * {2 * CHUNK} + 1 AS BIGINT), {2 * CHUNK}) AS part
        FROM (SELECT file_index, hx, unnest(range(CAST(ceil(raw_size / {CHUNK}) AS BIGINT))) AS chunk_no FROM files)))"""
FIRST = """firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h32 ORDER BY file_index, chunk_no) AS rn FROM chunks) WHERE rn = 1)"""
BLOCKS = "blocks AS (SELECT h32, file_index, chunk_no, raw_len, row_number() OVER (ORDER BY file_index, chunk_no) AS block_id FROM firsts)"
SPANS = """spans AS (
  SELECT c.file_index, c.chunk_no AS span_no, b.block_id, c.raw_len AS span_raw_len,
         CASE WHEN c.chunk_no = max(c.chunk_no) OVER (PARTITION BY c.file_index) THEN 1 ELSE 0 END AS span_flags
  FROM chunks c JOIN blocks b USING (h32))"""


def _with(*views: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(views) + "\n"


def _files(spark: SparkSession, d: str) -> DataFrame:
    return sources.document_files(spark, d)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(_files(spark, d), CHUNK)


# ---- chunks, blocks, spans


@query(_with(FILES, CHUNKS, FIRST) + f"""
SELECT f.file_index, CAST(ceil(f.raw_size / {CHUNK}) AS BIGINT) AS chunks, coalesce(n.new_chunks, 0) AS new_chunks, f.raw_size AS raw_bytes, CAST(coalesce(n.new_bytes, 0) AS BIGINT) AS new_bytes,
       CASE WHEN f.raw_size > 0 THEN round(coalesce(n.new_bytes, 0) / f.raw_size, 6) ELSE 0.0 END AS kept_ratio
FROM files f LEFT JOIN (SELECT file_index, count(*) AS new_chunks, sum(raw_len) AS new_bytes FROM firsts GROUP BY 1) n USING (file_index)""")
def chunk_dedupe(spark, d):
    return chunking.dedupe_report(_files(spark, d), CHUNK)


@query(_with(FILES, CHUNKS, FIRST) + """
SELECT d.source, count(*) AS chunks, count(DISTINCT c.h32) AS distinct_chunks, CAST(sum(CASE WHEN o.source <> d.source THEN 1 ELSE 0 END) AS BIGINT) AS from_other_sources
FROM chunks c JOIN firsts f USING (h32) JOIN documents d ON d.doc_id = c.file_index JOIN documents o ON o.doc_id = f.file_index GROUP BY 1""")
def chunk_reuse_by_source(spark, d):
    docs = sources.table(spark, d, "documents").select(F.col("doc_id").alias("file_index"), "source")
    parts = _chunks(spark, d).join(docs, "file_index")
    first = parts.groupBy("h32").agg(F.min(F.struct("file_index", "chunk_no", "source")).alias("f")).select("h32", F.col("f.source").alias("origin"))
    return parts.join(first, "h32").groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct("h32").alias("distinct_chunks"), F.sum((F.col("origin") != F.col("source")).cast("long")).alias("from_other_sources"))


@query(_with(FILES, CHUNKS, FIRST, BLOCKS) + "SELECT block_id, file_index, chunk_no, raw_len, h32 FROM blocks")
def block_ids(spark, d):
    return chunking.blocks(_chunks(spark, d)).select("block_id", "file_index", "chunk_no", "raw_len", "h32")


@query(_with(FILES, CHUNKS, FIRST, BLOCKS, SPANS) + """
SELECT s.file_index, s.span_no, s.block_id, s.span_raw_len, CAST(s.span_flags AS INTEGER) AS span_flags, b.raw_len = s.span_raw_len AS whole FROM spans s JOIN blocks b USING (block_id)""")
def spans_blocks_join(spark, d):
    parts = _chunks(spark, d)
    known = chunking.blocks(parts)
    return chunking.spans(parts, known).join(known.select("block_id", "raw_len"), "block_id").select("file_index", "span_no", "block_id", "span_raw_len", "span_flags", (F.col("raw_len") == F.col("span_raw_len")).alias("whole"))


@query(_with(FILES, CHUNKS, FIRST, BLOCKS, SPANS) + """
SELECT file_index, count(*) AS missing, CAST(sum(span_raw_len) AS BIGINT) AS missing_bytes FROM spans WHERE block_id NOT IN (SELECT block_id FROM blocks WHERE block_id % 7 <> 0) GROUP BY 1""")
def missing_blocks_anti(spark, d):
    parts = _chunks(spark, d)
    known = chunking.blocks(parts)
    kept = known.where("block_id % 7 <> 0").select("block_id")  # as if every seventh block were lost
    return chunking.spans(parts, known).join(kept, "block_id", "left_anti").groupBy("file_index").agg(F.count("*").alias("missing"), F.sum("span_raw_len").alias("missing_bytes"))


@query(_with(FILES, CHUNKS, FIRST, BLOCKS, SPANS) + """
SELECT f.file_index, f.raw_size, CAST(coalesce(sum(s.span_raw_len), 0) AS BIGINT) AS span_bytes, coalesce(sum(s.span_raw_len), 0) = f.raw_size AS ok, coalesce(max(s.span_flags), 0) = 1 OR f.raw_size = 0 AS ended
FROM files f LEFT JOIN spans s USING (file_index) GROUP BY f.file_index, f.raw_size""")
def verify_sizes(spark, d):
    sums = chunking.spans(_chunks(spark, d)).groupBy("file_index").agg(F.sum("span_raw_len").alias("b"), F.max("span_flags").alias("e"))
    known = _files(spark, d).select("file_index", "raw_size").join(sums, "file_index", "left")
    n = F.coalesce("b", F.lit(0)).cast("long")
    return known.select("file_index", "raw_size", n.alias("span_bytes"), (n == F.col("raw_size")).alias("ok"), ((F.coalesce("e", F.lit(0)) == 1) | (F.col("raw_size") == 0)).alias("ended"))


# ---- listings and totals


@query(_with(FILES) + "SELECT raw_size, path FROM files")
def list_files(spark, d):
    return _files(spark, d).select("raw_size", "path")


@query(_with(FILES) + "SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS path_index FROM files")
def path_sort_index(spark, d):
    return ordering.path_index(_files(spark, d).select("path")).select("path", F.col("path_index").cast("long"))


@query(_with(FILES) + "SELECT file_index, substr(path, length(split_part(path, '/', 1)) + 2) AS below_lang, path AS outside FROM files")
def relative_paths(spark, d):
    f = _files(spark, d).select("file_index", "path")
    below = sources.relative_path("path", F.element_at(F.split("path", "/"), 1))
    return f.select("file_index", below.alias("below_lang"), sources.relative_path("path", "nowhere").alias("outside"))


@query(_with(FILES, CHUNKS, FIRST) + """
SELECT 'files' AS item, count(*) AS n, CAST(sum(raw_size) AS BIGINT) AS bytes FROM files UNION ALL SELECT 'chunks', count(*), CAST(sum(raw_len) AS BIGINT) FROM chunks UNION ALL SELECT 'blocks', count(*), CAST(sum(raw_len) AS BIGINT) FROM firsts""")
def info_totals(spark, d):
    f, parts = _files(spark, d), _chunks(spark, d)
    row = lambda name, df, c: df.agg(F.count("*").alias("n"), F.sum(c).alias("bytes")).select(F.lit(name).alias("item"), "n", "bytes")
    return row("files", f, "raw_size").unionByName(row("chunks", parts, "raw_len")).unionByName(row("blocks", chunking.first_seen(parts), "raw_len"))


@query(_with(FILES) + "SELECT file_index, path, raw_size, sha256(text) AS sha256 FROM files")
def extract_manifest(spark, d):
    return _files(spark, d).select("file_index", "path", "raw_size", F.sha2("content", 256).alias("sha256"))


@query(_with(FILES) + "SELECT ext, count(*) AS files, count(DISTINCT sha256(text)) AS distinct_files, CAST(sum(raw_size) AS BIGINT) AS bytes FROM files GROUP BY 1")
def sha256_by_extension(spark, d):
    f = _files(spark, d).select("ext", "raw_size", F.sha2("content", 256).alias("h"))
    return f.groupBy("ext").agg(F.count("*").alias("files"), F.countDistinct("h").alias("distinct_files"), F.sum("raw_size").alias("bytes"))


@query(_with(FILES) + """
SELECT file_index, CAST(json_object('class_id', 0, 'file_flags', 0, 'path', path, 'raw_size', raw_size) AS VARCHAR) AS head FROM files""")
def head_json(spark, d):
    return _files(spark, d).select("file_index", F.to_json(F.struct(F.lit(0).alias("class_id"), F.lit(0).alias("file_flags"), "path", "raw_size")).alias("head"))


# ---- features


@query(_with(FILES) + f"""
SELECT file_index, CASE WHEN lower(ext) IN ({_list(C.CLASS_MEDIA)}) THEN 'media' WHEN lower(ext) IN ({_list(C.CLASS_DOC)}) THEN 'doc' WHEN lower(ext) IN ({_list(C.CLASS_TEXT)}) THEN 'text' ELSE 'bin' END AS class_tag FROM files""")
def file_class(spark, d):
    return _files(spark, d).select("file_index", policy.file_class(F.col("ext")).alias("class_tag"))


@query(_with(FILES) + f"SELECT file_index, lower(ext) IN ({_list(C.CONTAINERS)}) OR hx LIKE '25504446%' OR hx LIKE '504B0304%' AS is_container FROM files")
def container_sniff(spark, d):
    return _files(spark, d).select("file_index", policy.is_container(F.col("ext"), F.col("content")).alias("is_container"))


def _features(spark, d, *wanted):
    return kernels.features_of(_files(spark, d).select("file_index", "ext", "content"), wanted)


PROBES = f"""probes AS (SELECT file_index, off, substr(hx, CAST(2 * off + 1 AS BIGINT), {2 * C.PROBE_BYTES}) AS part FROM (
  SELECT file_index, hx, unnest(CASE WHEN ext IN ({_list(C.CLASS_MEDIA)}) AND raw_size > {2 * C.PROBE_BYTES} THEN [0, CAST(floor(raw_size * 0.25) AS BIGINT), CAST(floor(raw_size * 0.75) AS BIGINT)] ELSE [0] END) AS off FROM files))"""


@query(_with(FILES, PROBES) + """
SELECT file_index, round(avg(coalesce(e, 0.0)), 6) AS entropy FROM probes LEFT JOIN (
  SELECT file_index, off, -sum(p * log2(p)) / 8 AS e FROM (SELECT file_index, off, n / sum(n) OVER (PARTITION BY file_index, off) AS p FROM (
    SELECT file_index, off, substr(part, CAST(2 * i + 1 AS BIGINT), 2) AS b, count(*) AS n FROM (SELECT file_index, off, part, unnest(range(length(part) // 2)) AS i FROM probes) GROUP BY 1, 2, 3)) GROUP BY 1, 2) USING (file_index, off) GROUP BY 1""")
def entropy(spark, d):
    return _features(spark, d, "entropy").select("file_index", F.round("entropy", 6).alias("entropy"))


@query(_with(FILES, PROBES) + """
SELECT file_index, round(avg(CASE WHEN n < 2 THEN 1.0 ELSE len(list_distinct([substr(part, CAST(2 * i + 1 AS BIGINT), 4) FOR i IN range(n - 1)])) / (n - 1) END), 6) AS uniq FROM (SELECT *, length(part) // 2 AS n FROM probes) GROUP BY 1""")
def uniq_bigram(spark, d):
    return _features(spark, d, "uniq").select("file_index", F.round("uniq", 6).alias("uniq"))


@query(_with(FILES) + f"""
SELECT file_index, CASE WHEN n < 64 THEN 0.0 ELSE round(1 - len(list_distinct(w)) / len(w), 6) END AS motif_score
FROM (SELECT file_index, n, [substr(hx, CAST(8 * i + 1 AS BIGINT), 64) FOR i IN range(CASE WHEN n < 64 THEN 1 ELSE least((n - 32) // 4 + 1, 4096) END)] AS w FROM (SELECT *, least(raw_size, {C.PROBE_BYTES}) AS n FROM files))""")
def motif_score(spark, d):
    return _features(spark, d, "motif_score").select("file_index", F.round("motif_score", 6).alias("motif_score"))


_ZERO = crc32(bytes(4))
_CRC = f"[{', '.join(str(crc32((1 << k).to_bytes(4, 'big')) ^ _ZERO) for k in range(32))}]"
SIMHASH = f"""grams AS (SELECT file_index, CAST(('0x' || substr(hx, CAST(8 * i + 1 AS BIGINT), 8)) AS BIGINT) AS v, i FROM (SELECT file_index, hx, unnest(range(greatest(least(raw_size, 8192) - 3 + 3, 0) // 4)) AS i FROM files)),
sums AS (SELECT file_index, i, xor({_ZERO}, bit_xor(CASE WHEN (v >> k) & 1 = 1 THEN list_extract({_CRC}, CAST(k + 1 AS INTEGER)) ELSE 0 END)) AS h FROM (SELECT *, unnest(range(32)) AS k FROM grams) GROUP BY file_index, i),
votes AS (SELECT file_index, k, sum(2 * ((h >> k) & 1) - 1) AS up FROM (SELECT *, unnest(range(32)) AS k FROM sums) GROUP BY 1, 2),
simhash AS (SELECT file_index, CAST(sum(CASE WHEN up >= 0 THEN 1::BIGINT << k ELSE 0 END) AS BIGINT) AS low,
  CAST(sum(CASE WHEN (CASE WHEN ({C.SEEDED_CRC} >> k) & 1 = 1 THEN -up ELSE up END) >= 0 THEN 1::BIGINT << k ELSE 0 END) AS BIGINT) AS high FROM votes GROUP BY 1)"""


@query(_with(FILES, SIMHASH) + "SELECT f.file_index, CASE WHEN raw_size = 0 THEN 0 WHEN raw_size < 4 THEN 4294967295 ELSE low END AS low, CASE WHEN raw_size = 0 THEN 0 WHEN raw_size < 4 THEN 4294967295 ELSE high END AS high FROM files f LEFT JOIN simhash USING (file_index)")
def simhash(spark, d):
    fp = F.col("pi_hash64")
    return _features(spark, d, "pi_hash64").select("file_index", fp.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftrightunsigned(fp, 32).alias("high"))


_SIG = "[substr(hx, CAST(16 * i + 1 AS BIGINT), 64) FOR i IN range(CASE WHEN raw_size < 32 THEN 0 ELSE least((raw_size - 32) // 8 + 1, 512) END)]"


@query(_with(FILES) + f"""
SELECT a.file_index, round(CASE WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) END, 6) AS similarity
FROM (SELECT file_index, list_distinct({_SIG}) AS s FROM files) a JOIN (SELECT file_index, list_distinct({_SIG}) AS s FROM files) b ON b.file_index = a.file_index - a.file_index % 10""")
def pi_signature_jaccard(spark, d):
    f = _features(spark, d, "pi_sig")
    base = f.where("file_index % 10 = 0").select(F.col("file_index").alias("base_index"), F.col("pi_sig").alias("base_sig"))
    return f.join(base, F.col("base_index") == F.col("file_index") - F.col("file_index") % 10).select("file_index", F.round(similarity.jaccard("pi_sig", "base_sig"), 6).alias("similarity"))


@query(_with(FILES) + """
, w AS (SELECT file_index, substr(hx, CAST(8 * i + 1 AS BIGINT), 64) AS motif, 4 * i AS pos FROM (SELECT file_index, hx, unnest(range(CASE WHEN raw_size < 32 THEN 0 ELSE (raw_size - 32) // 4 + 1 END)) AS i FROM files))
SELECT file_index, motif, n, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY file_index ORDER BY n DESC, pos) AS rank FROM (SELECT file_index, motif, count(*) AS n, min(pos) AS pos FROM w GROUP BY 1, 2 HAVING count(*) > 1)) WHERE rank <= 512""".replace("\n, w", ", w", 1))
def top_motifs(spark, d):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(i, m.hex().upper(), n, p, k + 1) for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for k, (m, n, p) in enumerate(codecs.top_motifs(b or b""))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["file_index", "motif", "n", "pos", "rank"])

    return _files(spark, d).select("file_index", "content").mapInArrow(run, "file_index long, motif string, n long, pos long, rank long")


@query()
def feature_rows(spark, d):
    """All features of each file, as the planner takes them."""
    return planning.features(_files(spark, d)).withColumn("windows", F.size("pi_sig")).drop("pi_sig")


# ---- similarity search

FP = "fps AS (SELECT f.file_index, ext, CASE WHEN raw_size < 4 THEN 4294967295 ELSE high END AS hi, CASE WHEN raw_size < 4 THEN 4294967295 ELSE low END AS lo FROM files f LEFT JOIN simhash USING (file_index) WHERE raw_size > 0)"
HAM = "CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER)"


@query(_with(FILES, SIMHASH, FP) + f"""
SELECT file_index, base_index, hamming, CAST(rank AS INTEGER) AS rank FROM (
  SELECT file_index, base_index, hamming, row_number() OVER (PARTITION BY file_index ORDER BY hamming, base_index) AS rank FROM (
    SELECT a.file_index, b.file_index AS base_index, {HAM} AS hamming, row_number() OVER (PARTITION BY a.file_index, b.hi >> {32 - C.PI_BUCKET_BITS} ORDER BY b.file_index DESC) AS age
    FROM fps a JOIN fps b ON a.ext = b.ext AND b.file_index < a.file_index AND ((a.hi >> {32 - C.PI_BUCKET_BITS}) - (b.hi >> {32 - C.PI_BUCKET_BITS}) + {1 << C.PI_BUCKET_BITS}) % {1 << C.PI_BUCKET_BITS} IN (0, 1, {(1 << C.PI_BUCKET_BITS) - 1}))
  WHERE age <= {C.PI_BUCKET_KEPT}) WHERE rank <= {C.PI_CANDIDATES}""")
def asof_band_join(spark, d):
    """The candidates for a base of each file, by its fingerprint."""
    f = kernels.features_of(_files(spark, d).where("raw_size > 0").select("file_index", "ext", "content"), ("pi_hash64",))
    return similarity.candidates(f.withColumnRenamed("pi_hash64", "fp"))


@query()
def plan_files(spark, d):
    """The lane of each file, from its content: features, hint, base and plan."""
    return planning.planned(planning.features(_files(spark, d)))


@query()
def observed_gain(spark, d):
    """What the chunked lane saves of each file."""
    return planning.observed_gains(archive.build(_files(spark, d), chunk_size=CHUNK * 4))


@query(_with(FILES, """edges AS (SELECT file_index, CASE WHEN file_index % 5 = 0 THEN NULL ELSE file_index - 1 END AS base FROM files),
chain(file_index, base, depth) AS (SELECT file_index, base, 0 FROM edges UNION ALL SELECT c.file_index, e.base, c.depth + 1 FROM chain c JOIN edges e ON e.file_index = c.base)""") + "SELECT file_index, CAST(max(depth) AS INTEGER) AS depth FROM chain GROUP BY 1")
def base_chain_depth(spark, d):
    edges = _files(spark, d).select("file_index", F.when(F.col("file_index") % 5 == 0, None).otherwise(F.col("file_index") - 1).alias("base"))
    return archive.chain_depth(edges)


# ---- policies, on features derived from every order line

SYNTH = f"""synth AS (
  SELECT l_orderkey * 8 + l_linenumber AS file_index,
         CASE WHEN l_linenumber % 3 = 0 THEN (l_orderkey * 7919 + l_partkey * 104729) % 70000 ELSE (l_orderkey * 7919 + l_partkey * 104729) % 300000000 END AS size,
         list_extract([{_list(sources.EXTENSIONS)}], CAST(l_partkey % 12 + 1 AS INTEGER)) AS ext, 0.9 + l_discount AS entropy, l_tax * 5 AS gain, l_quantity / 200 AS motif,
         CASE WHEN l_suppkey % 4 = 0 THEN l_tax * 12 ELSE 0.0 END AS similarity, l_partkey % 12 IN (4, 5, 7, 8, 9) AS container FROM lineitem)"""
WORK = "CASE WHEN entropy <= 0.965 THEN 1.0::DOUBLE WHEN entropy >= 0.995 THEN 0.0::DOUBLE ELSE (1.0 - (entropy - 0.965::DOUBLE) / (0.995::DOUBLE - 0.965::DOUBLE)) * (1.0 - (entropy - 0.965::DOUBLE) / (0.995::DOUBLE - 0.965::DOUBLE)) END"
BUMP = "CASE WHEN entropy <= 0.965 THEN 0.0::DOUBLE WHEN entropy >= 0.995 THEN 0.2::DOUBLE ELSE (entropy - 0.965::DOUBLE) / (0.995::DOUBLE - 0.965::DOUBLE) * 0.2::DOUBLE END"
STATE = f"""CASE WHEN entropy >= 0.985 OR gain <= 0.02 THEN CASE WHEN container THEN 'CONTAINER_ENTROPIC' ELSE 'RAW_ENTROPIC' END
  WHEN motif >= 0.12 AND NOT container AND ext IN ({_list(C.TEXT_LIKE)}) THEN 'STRUCT_MOTIF' WHEN container THEN 'CONTAINER_COMPRESSIBLE' ELSE 'GENERIC_COMPRESSIBLE' END"""
LEVEL = "CASE WHEN gain >= 0.30 THEN 7 WHEN gain >= 0.18 THEN 5 ELSE 3 END"
CLASS = f"CASE WHEN ext IN ({_list(C.CLASS_MEDIA)}) THEN 'media' WHEN ext IN ({_list(C.CLASS_DOC)}) THEN 'doc' WHEN ext IN ({_list(C.CLASS_TEXT)}) THEN 'text' ELSE 'bin' END"


def _synth(spark, d):
    size = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729) % F.when(F.col("l_linenumber") % 3 == 0, 70000).otherwise(300000000)
    number = F.col("l_partkey") % 12
    return sources.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("file_index"), size.alias("size"), F.element_at(F.array(*[F.lit(e) for e in sources.EXTENSIONS]), (number + 1).cast("int")).alias("ext"),
        (0.9 + F.col("l_discount")).alias("entropy"), (F.col("l_tax") * 5).alias("gain"), (F.col("l_quantity") / 200).alias("motif"),
        F.when(F.col("l_suppkey") % 4 == 0, F.col("l_tax") * 12).otherwise(0.0).alias("similarity"), number.isin(4, 5, 7, 8, 9).alias("container"),
    )


@query(_with(SYNTH) + f"""
SELECT file_index, ext IN ({_list(C.FAST_MEDIA)}) OR size <= 33554432 AS no_structure, ext IN ({_list(C.FAST_MEDIA)}) AS force_whole, 16384 AS probe_bytes, 1 AS probe_level, CASE WHEN size >= 8388608 THEN 1048576 ELSE 262144 END AS chunk_size FROM synth""")
def gate_hint(spark, d):
    return _synth(spark, d).select("file_index", policy.gate_hint(F.col("size"), F.col("ext")).alias("h")).select("file_index", "h.no_structure", "h.force_whole", "h.probe_bytes", "h.probe_level", "h.chunk_size")


@query(_with(SYNTH, f"h AS (SELECT *, ext IN ({_list(C.FAST_MEDIA)}) AS whole, ext IN ({_list(C.FAST_MEDIA)}) OR size <= 33554432 AS closed FROM synth)") + """
SELECT file_index, CASE WHEN whole THEN greatest(entropy, 7.95) ELSE entropy END AS entropy, CASE WHEN whole THEN least(gain, 0.0) ELSE gain END AS gain,
       CASE WHEN closed THEN 0.0 ELSE motif END AS motif, container, CASE WHEN closed THEN 0.0 ELSE similarity END AS similarity FROM h""")
def hint_application(spark, d):
    f = _synth(spark, d)
    own = policy.hinted(policy.gate_hint(F.col("size"), F.col("ext")), *[F.col(c) for c in ("entropy", "gain", "motif", "container", "similarity")])
    return f.select("file_index", own.alias("f")).select("file_index", "f.*")


@query(_with(SYNTH) + f"SELECT file_index, {STATE} AS state FROM synth")
def classify_state(spark, d):
    c = [F.col(n) for n in ("entropy", "gain", "motif", "container", "ext")]
    return _synth(spark, d).select("file_index", policy.state(*c).alias("state"))


@query(_with(SYNTH) + f"SELECT file_index, round({WORK}, 9) AS work, round({BUMP}, 9) AS bump, {LEVEL} AS level FROM synth")
def bh_policy(spark, d):
    e = F.col("entropy")
    return _synth(spark, d).select("file_index", F.round(policy.work_factor(e), 9).alias("work"), F.round(policy.threshold_bump(e), 9).alias("bump"), policy.level_for_gain(F.col("gain")).alias("level"))


PLAN = f"""p0 AS (SELECT *, {CLASS} AS class_tag, {WORK} AS work, {BUMP} AS bump, {STATE} AS state0 FROM synth),
p1 AS (SELECT *, least(greatest(CASE class_tag WHEN 'text' THEN 0.0 WHEN 'doc' THEN 0.03::DOUBLE WHEN 'bin' THEN 0.12::DOUBLE ELSE 0.30::DOUBLE END, CASE WHEN size <= 262144 THEN 0.02::DOUBLE ELSE 0.05::DOUBLE END + 0.0 + bump, 0.0), 0.40::DOUBLE) AS threshold,
  size BETWEEN 32768 AND 268435456 AND similarity >= 0.20 AS base FROM p0),
p2 AS (SELECT *, base AND similarity >= 0.80 AS bypass, CASE WHEN work > 0 THEN {LEVEL} ELSE 3 END AS level0,
  CASE WHEN size <= 65536 AND work > 0 THEN 'MICRO' ELSE 'WHOLE' END AS kept, gain * CAST(least(size, 65536) AS DOUBLE) - 96 * ceil(size / 262144) AS net FROM p1),
p3 AS (SELECT *, CASE WHEN base AND (work > 0.05 OR bypass) THEN 'STRUCT_GENERATIVE' WHEN work <= 0.05 THEN CASE WHEN container THEN 'CONTAINER_ENTROPIC' ELSE 'RAW_ENTROPIC' END ELSE state0 END AS state FROM p2),
plans AS (SELECT *, CASE WHEN size > 33554432 AND state NOT LIKE 'STRUCT%' THEN 'LARGE' WHEN size > 268435456 AND state LIKE 'STRUCT%' THEN 'CAP'
  WHEN state = 'STRUCT_MOTIF' AND work > 0.2 AND gain >= greatest(0.03::DOUBLE, 0.7::DOUBLE * threshold) THEN 'MOTIF' WHEN state = 'STRUCT_GENERATIVE' AND (work > 0.2 OR bypass) THEN 'BASE'
  WHEN state LIKE '%ENTROPIC' THEN 'ENTROPIC' WHEN state = 'CONTAINER_COMPRESSIBLE' AND gain >= greatest(threshold, 0.20::DOUBLE) THEN 'CONTAINER'
  WHEN state <> 'CONTAINER_COMPRESSIBLE' AND gain >= threshold AND net > 0 AND work > 0 THEN 'GAIN' ELSE 'NO_GAIN' END AS reason FROM p3),
lanes AS (SELECT file_index, class_tag, size, state, CASE reason WHEN 'MOTIF' THEN 'DNA' WHEN 'BASE' THEN 'PI' WHEN 'ENTROPIC' THEN kept WHEN 'NO_GAIN' THEN kept ELSE 'CDC' END AS action,
  CASE WHEN reason = 'ENTROPIC' THEN 3 ELSE level0 END AS level, threshold, reason FROM plans)"""


def _lanes(spark, d):
    c = {n: F.col(n) for n in ("size", "ext", "entropy", "gain", "motif", "container", "similarity")}
    made = policy.plan(**c, bias=F.lit(0.0), dedupe=False)
    return _synth(spark, d).select("file_index", policy.file_class(F.col("ext")).alias("class_tag"), "size", made.alias("p")).select("file_index", "class_tag", "size", "p.*")


@query(_with(SYNTH, PLAN) + "SELECT file_index, state, action, level, round(threshold, 6) AS threshold, reason FROM lanes")
def plan_lane(spark, d):
    return _lanes(spark, d).select("file_index", "state", "action", "level", F.round("threshold", 6).alias("threshold"), "reason")


@query(_with(SYNTH, PLAN) + "SELECT class_tag, action, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM lanes GROUP BY GROUPING SETS ((class_tag), (action), (class_tag, action), ())")
def lane_stats_grouping_sets(spark, d):
    _lanes(spark, d).createOrReplaceTempView("sedimenta_lanes")
    return spark.sql("SELECT class_tag, action, count(*) AS files, sum(size) AS bytes FROM sedimenta_lanes GROUP BY GROUPING SETS ((class_tag), (action), (class_tag, action), ())")


PRESET = f"""s AS (SELECT row_number() OVER (ORDER BY file_index) AS k, ext IN ({_list(C.FAST_MEDIA)}) AS media, size >= 8388608 AS big, entropy >= 0.97 AS hi, gain <= 0.03 AS lo FROM synth QUALIFY k <= 64),
r AS (SELECT *, sum(CAST(media OR big OR hi OR lo AS INTEGER)) OVER (ORDER BY k) AS scored, sum(CAST(hi AS INTEGER)) OVER (ORDER BY k) AS his FROM s),
stop AS (SELECT coalesce(min(k), (SELECT count(*) FROM s)) AS n FROM r WHERE k >= 16 AND his / k >= 0.75 AND scored / k >= 0.35)"""


@query(_with(SYNTH, PRESET) + """
SELECT CASE WHEN avg(CAST(media OR big OR hi OR lo AS INTEGER)) >= 0.35 THEN 'fast-game' ELSE 'default' END AS preset, count(*) AS sampled, round(avg(CAST(media OR big OR hi OR lo AS INTEGER)), 6) AS score,
  round(avg(CAST(media AS INTEGER)), 6) AS media_frac, round(avg(CAST(hi AS INTEGER)), 6) AS hi_ent_frac, round(avg(CAST(lo AS INTEGER)), 6) AS lo_gain_frac, round(avg(CAST(big AS INTEGER)), 6) AS big_frac FROM s WHERE k <= (SELECT n FROM stop)""")
def preset_early_exit(spark, d):
    first = _synth(spark, d).orderBy("file_index").limit(C.AUTO_FILES)  # the sample is the feature
    k = F.row_number().over(Window.orderBy("file_index"))
    s = first.select(k.alias("k"), F.lower("ext").isin(C.FAST_MEDIA).cast("int").alias("media"), (F.col("size") >= C.FAST_BIG_FILE).cast("int").alias("big"), (F.col("entropy") >= C.AUTO_ENTROPY).cast("int").alias("hi"), (F.col("gain") <= C.AUTO_GAIN).cast("int").alias("lo"))
    s = s.withColumn("any", F.greatest("media", "big", "hi", "lo"))
    so_far = Window.orderBy("k")
    strong = (F.col("k") >= 16) & (F.sum("hi").over(so_far) / F.col("k") >= 0.75) & (F.sum("any").over(so_far) / F.col("k") >= C.AUTO_SCORE)
    s = s.withColumn("strong", strong).withColumn("stop", F.coalesce(F.min(F.when(F.col("strong"), F.col("k"))).over(Window.partitionBy()), F.lit(C.AUTO_FILES)))
    rate = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return s.where("k <= stop").agg(F.when(F.avg("any") >= C.AUTO_SCORE, "fast-game").otherwise("default").alias("preset"), F.count("*").alias("sampled"), rate("any", "score"), rate("media", "media_frac"), rate("hi", "hi_ent_frac"), rate("lo", "lo_gain_frac"), rate("big", "big_frac"))


@query(_with(SYNTH) + f"""
SELECT class_tag, count(*) AS files, round(avg(CAST(entropy >= 0.97 AS INTEGER)), 6) AS hi_ent_frac, round(avg(CAST(gain <= 0.03 AS INTEGER)), 6) AS lo_gain_frac, round(avg(CAST(size >= 8388608 AS INTEGER)), 6) AS big_frac FROM (SELECT *, {CLASS} AS class_tag FROM synth) GROUP BY 1""")
def preset_sample_score(spark, d):
    rate = lambda c, name: F.round(F.avg(c.cast("int")), 6).alias(name)
    return _synth(spark, d).groupBy(policy.file_class(F.col("ext")).alias("class_tag")).agg(F.count("*").alias("files"), rate(F.col("entropy") >= C.AUTO_ENTROPY, "hi_ent_frac"), rate(F.col("gain") <= C.AUTO_GAIN, "lo_gain_frac"), rate(F.col("size") >= C.FAST_BIG_FILE, "big_frac"))


# ---- folds

FOLD = """o AS (SELECT grp, gain, row_number() OVER (PARTITION BY grp ORDER BY idx) AS k FROM g),
f AS (SELECT grp, 0::BIGINT AS k, 0.0::DOUBLE AS ema, 0.0::DOUBLE AS bias FROM (SELECT DISTINCT grp FROM o)
  UNION ALL
  SELECT grp, k, e, least(0.20::DOUBLE, greatest(-0.05::DOUBLE, bias + CASE WHEN e < 0.06::DOUBLE THEN least(0.01::DOUBLE, (0.06::DOUBLE - e) * 0.05::DOUBLE) ELSE -least(0.01::DOUBLE, (e - 0.06::DOUBLE) * 0.02::DOUBLE) END))
  FROM (SELECT o.grp, o.k, f.bias, (1.0::DOUBLE - 0.12::DOUBLE) * f.ema + 0.12::DOUBLE * o.gain AS e FROM f JOIN o ON o.grp = f.grp AND o.k = f.k + 1))"""
_FOLD_END = "SELECT f.grp, f.k AS n, round(f.ema, 6) AS ema, round(f.bias, 6) AS bias FROM f JOIN (SELECT grp, max(k) AS k FROM o GROUP BY 1) m ON m.grp = f.grp AND m.k = f.k"


def _rounded(df):
    return df.select("grp", "n", F.round("ema", 6).alias("ema"), F.round("bias", 6).alias("bias"))


@query(_with("g AS (SELECT event_type AS grp, event_id AS idx, value / 500 AS gain FROM events)", FOLD) + _FOLD_END)
def ema_fold(spark, d):
    return _rounded(folds.adaptive_bias(sources.table(spark, d, "events").select(F.col("event_type").alias("grp"), F.col("event_id").alias("idx"), (F.col("value") / 500).alias("gain"))))


@query(_with("g AS (SELECT event_type AS grp, event_id AS idx, value / 500 AS gain FROM events)", FOLD, "n AS (SELECT grp, idx, row_number() OVER (PARTITION BY grp ORDER BY idx) AS k FROM g)") + """
SELECT n.grp, n.idx, round(f.ema, 6) AS ema, round(f.bias, 6) AS bias FROM n JOIN f ON f.grp = n.grp AND f.k = n.k - 1""")
def ema_before_each(spark, d):
    """The moving average and the bias that a planner has when it comes to each row."""
    out = folds.before_each(sources.table(spark, d, "events").select(F.col("event_type").alias("grp"), F.col("event_id").alias("idx"), (F.col("value") / 500).alias("gain")))
    return out.select("grp", "idx", F.round("ema", 6).alias("ema"), F.round("bias", 6).alias("bias"))


@query(_with(FILES, f"g0 AS (SELECT {CLASS} AS grp, file_index AS idx, (file_index % 17) / 100.0::DOUBLE AS gain FROM files), g AS (SELECT * FROM g0 UNION ALL SELECT 'all', idx, gain FROM g0)", FOLD) + _FOLD_END)
def ema_by_class(spark, d):
    own = _files(spark, d).select(policy.file_class(F.col("ext")).alias("grp"), F.col("file_index").alias("idx"), ((F.col("file_index") % 17) / 100.0).alias("gain"))
    return _rounded(folds.adaptive_bias(own.unionByName(own.withColumn("grp", F.lit("all")))))


@query(_with(FILES, """o AS (SELECT file_index, raw_size, coalesce(sum(CASE WHEN raw_size > 2048 THEN 1 ELSE 0 END) OVER (ORDER BY file_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM files),
m AS (SELECT file_index, raw_size, CAST(island AS BIGINT) AS island, row_number() OVER (PARTITION BY island ORDER BY file_index) AS k FROM o WHERE raw_size <= 2048),
p(file_index, island, k, block_no, entry, off, used) AS (SELECT file_index, island, k, 0, 0, 0::BIGINT, raw_size FROM m WHERE k = 1
  UNION ALL SELECT m.file_index, m.island, m.k, CASE WHEN full_ THEN p.block_no + 1 ELSE p.block_no END, CASE WHEN full_ THEN 0 ELSE p.entry + 1 END, CASE WHEN full_ THEN 0 ELSE p.used END, CASE WHEN full_ THEN m.raw_size ELSE p.used + m.raw_size END
  FROM (SELECT p.*, m2.raw_size AS next_size, p.used + m2.raw_size > 4096 OR p.entry + 1 >= 4 AS full_ FROM p JOIN m m2 ON m2.island = p.island AND m2.k = p.k + 1) p JOIN m ON m.island = p.island AND m.k = p.k + 1)""") + "SELECT file_index, island, CAST(block_no AS BIGINT) AS block_no, CAST(entry AS BIGINT) AS entry, off AS \"offset\" FROM p")
def micro_pack(spark, d):
    return micro.pack(_files(spark, d), cutoff=2048, block_max=4096, entry_max=4)


@query(_with(FILES, "o AS (SELECT file_index, raw_size, file_index // 10 AS block_id, row_number() OVER (PARTITION BY file_index // 10 ORDER BY file_index) - 1 AS entry FROM files)") + """
SELECT file_index, block_id, CAST(entry AS BIGINT) AS entry, CAST(coalesce(sum(raw_size) OVER (PARTITION BY block_id ORDER BY file_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", raw_size AS span_raw_len, true AS fits FROM o""")
def micro_entries_join(spark, d):
    return archive.micro_entry_spans(_files(spark, d).select("file_index", "raw_size", (F.col("file_index") / 10).cast("long").alias("block_id")))


# ---- scalar codecs


@query(f"""SELECT l_orderkey * 8 + l_linenumber AS id, (l_linenumber << 16) | 3 AS flags, l_linenumber AS aux, 3 AS base FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem)""")
def span_flags_codec(spark, d):
    flags = F.shiftleft(F.col("l_linenumber").cast("long"), 16).bitwiseOR(F.lit(C.SPAN_LAST | C.SPAN_MICRO).cast("long"))
    out = sources.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), flags.alias("flags"))
    return out.select("id", "flags", F.shiftrightunsigned("flags", 16).alias("aux"), F.col("flags").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("base"))


@query("SELECT o_orderkey AS n, CAST(greatest(1, ceil(length(ltrim(bin(o_orderkey * 1000003), '0')) / 7)) AS INTEGER) AS bytes, o_orderkey * 1000003 AS back FROM orders")
def uvarint_len(spark, d):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            coded = [codecs.put_uvarint(n * 1000003) for n in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in coded], pa.int32()), pa.array([codecs.get_uvarint(c)[0] for c in coded], pa.int64())], names=["n", "bytes", "back"])

    return sources.table(spark, d, "orders").select(F.col("o_orderkey").alias("n")).mapInArrow(run, "n long, bytes int, back long")


@query("SELECT p_partkey AS id, bit_count(p_size) AS ones, lpad(bin(p_size), 8, '0') || lpad(bin(p_partkey % 16), 4, '0') AS bits FROM part")
def bitpack(spark, d):
    binary = lambda c, n: F.lpad(F.conv(c.cast("string"), 10, 2), n, "0")
    return sources.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.bit_count("p_size").cast("byte").alias("ones"), F.concat(binary(F.col("p_size"), 8), binary(F.col("p_partkey") % 16, 4)).alias("bits"))


# ---- encoded lanes: no SQL; each row says whether decoding gave the file back


@query()
def crc32_file(spark, d):
    return _files(spark, d).select("file_index", F.crc32("content").alias("crc32"), "raw_size")


@query()
def compress_probe(spark, d):
    return archive.probe(_files(spark, d))


@query()
def codec_choice(spark, d):
    return archive.codec_counts(archive.encode_whole(_files(spark, d)))


@query()
def roundtrip_lanes(spark, d):
    return archive.roundtrip(_files(spark, d))


@query()
def roundtrip_delta(spark, d):
    return archive.roundtrip_delta(_files(spark, d))


@query()
def archive_verify(spark, d):
    return archive.verify(archive.build(_files(spark, d), chunk_size=CHUNK * 4))
