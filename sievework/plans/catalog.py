"""The registered queries: each applies an operator to the driver's tables, beside SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import classify, schedule, text
from sievework.operators import constants, findings, heuristics, integrity, inventory, matching, rows, runs, taint, vulnerability

QUERIES: dict = {}
ORACLES: dict = {}
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- rules of the example pack ------------------------------------------------------------------------------------

SIGNATURES = [
    (0, "lit:script", "Inline script", "injection", "suspicious"), (1, "lit:track", "Tracking call", "tracking", "infected"), (2, "lit:style", "Inline style", "markup", "info"),
    (3, "rx:entity", "Entity run", "obfuscation", "suspicious"), (4, "rx:query", "Query link", "link", "infected"), (5, "rx:upper", "Shouting", "spam", "info"),
]
LITERALS = [(0, 0, 0, "file_html", "<script"), (1, 1, 1, "file_any", "track("), (2, 2, 2, "file_html", "<style>p{margin"), (3, 3, 2, "file_any", "then the")]
REGEXES = [
    (0, 3, "/&[a-z]+;/", False, [], ["file_html", "file_any"]), (1, 4, "/[?&]page=[0-9]+/", False, [], ["file_any"]), (2, 5, "/[A-Z]{3,}/", True, [], ["file_any"]), (3, 3, "/(thth|onon)[a-z]*/i", False, [3], ["file_any"]),
]
SIG_SQL = ", ".join(f"({a}, '{b}', '{c}', '{d}', '{e}')" for a, b, c, d, e in SIGNATURES)
LIT_SQL = ", ".join(f"({p}, {lit}, {s}, '{t}', '{x}')" for p, lit, s, t, x in LITERALS)
RANK_SQL = "CASE {} WHEN 'integrity' THEN 4 WHEN 'infected' THEN 3 WHEN 'suspicious' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
RULES = f"sig(sig, sig_id, name, category, tier) AS (VALUES {SIG_SQL}), lit(position, lit, sig, target, x) AS (VALUES {LIT_SQL})"


def rule_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame(SIGNATURES, "sig int, sig_id string, name string, category string, tier string"),
        spark.createDataFrame(LITERALS, "position int, lit int, sig int, target string, text string"),
    )


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as html files of one chunk."""
    targets = matching.targets_of(F.lit("page.html"), F.lit("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.lit(0).alias("chunk"), F.lit(True).alias("first"), F.lit(0).alias("line_base"), F.col("html").alias("text"), targets.alias("targets"))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = matching.targets_of(F.lit("x.html"), F.lit("html"))
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk"), F.lit(True).alias("first"), F.lit(0).alias("line_base"), "text", targets.alias("targets"))


def excerpt_sql(t: str, p: str) -> str:
    return f"substring(regexp_replace(substring({t}, greatest({p} - 80, 1), 240), '[^\\x09\\x0A\\x20-\\x7E]', '?', 'g'), 1, 512)"


def line_sql(t: str, p: str) -> str:
    return f"(length(substring({t}, 1, {p} - 1)) - length(replace(substring({t}, 1, {p} - 1), chr(10), '')) + 1)::INT"


LITERAL_SQL = f"""
WITH {RULES}, m AS (
  SELECT page_id, position, sig, instr({LOWER.format('html')}, x) AS pos, html FROM pages, lit WHERE target IN ('file_html', 'file_any')
), h AS (SELECT page_id, position, sig, pos, {line_sql('html', 'pos')} AS line, {excerpt_sql('html', 'pos')} AS excerpt FROM m WHERE pos > 0)
"""


@register(LITERAL_SQL + f""", b AS (
  SELECT page_id, list(sig_id ORDER BY position) AS ids, max({RANK_SQL.format('tier')}) AS rank, first(line ORDER BY position) AS line, first(excerpt ORDER BY position) AS excerpt, first(category ORDER BY position) AS category
  FROM h JOIN sig USING (sig) GROUP BY page_id)
SELECT page_id, list_filter(ids, lambda x, i: list_position(ids, x) = i) AS signature_ids, CASE rank WHEN 3 THEN 'infected' WHEN 2 THEN 'suspicious' ELSE 'info' END AS tier,
       CASE WHEN rank = 3 THEN 'alert' ELSE 'review' END AS severity, category, line, excerpt FROM b""")
def scan_pages(spark, sf_dir):
    """Literal rules over pages, one assembled finding a page."""
    sig, lit = rule_tables(spark)
    found = matching.named(matching.literal_matches(page_chunks(spark, sf_dir), lit, key=("page_id", "chunk")), sig)
    out = findings.assemble(found, "page_id")
    return out.select("page_id", "signature_ids", "tier", findings.severity(F.col("tier"), F.lit(0)).alias("severity"), "category", "line", "excerpt")


@register(LITERAL_SQL + "SELECT page_id, position, sig, pos, line, excerpt FROM h")
def literal_first_match(spark, sf_dir):
    found = matching.literal_matches(page_chunks(spark, sf_dir), rule_tables(spark)[1], key=("page_id", "chunk"))
    return found.select("page_id", "position", "sig", "pos", "line", "excerpt")


WORDS_SQL = "list_distinct(list_filter(regexp_split_to_array(" + LOWER + ", '[^a-z0-9_]+'), lambda w: w <> ''))"
CAND_SQL = f"""
WITH {RULES}, l AS (SELECT lit, {WORDS_SQL.format('x')} AS ws FROM (SELECT DISTINCT lit, x FROM lit)), d AS (SELECT doc_id, {WORDS_SQL.format('text')} AS ws FROM documents), c AS (
  SELECT doc_id, lit FROM d, l WHERE len(list_intersect(l.ws, d.ws)) = len(l.ws))
"""


@register(CAND_SQL + "SELECT * FROM c")
def word_prefilter_candidates(spark, sf_dir):
    return matching.candidates(document_chunks(spark, sf_dir), rule_tables(spark)[1], key=("doc_id",))


@register(CAND_SQL + f""", m AS (SELECT doc_id, position, sig, instr({LOWER.format('text')}, x) AS pos FROM c JOIN lit USING (lit) JOIN documents USING (doc_id))
SELECT doc_id, position, sig, pos FROM m WHERE pos > 0""")
def literal_after_prefilter(spark, sf_dir):
    chunks, lit = document_chunks(spark, sf_dir), rule_tables(spark)[1]
    have = matching.candidates(chunks, lit, key=("doc_id", "chunk"))
    return matching.literal_matches(chunks, lit, have, key=("doc_id", "chunk")).select("doc_id", "position", "sig", "pos")


RX_SQL = " UNION ALL ".join(
    f"SELECT page_id, {p} AS position, {s} AS sig, CASE WHEN regexp_matches(html, '{'(?i)' if x.endswith('i') else ''}{x.strip('/i')}') THEN instr(html, regexp_extract(html, '{'(?i)' if x.endswith('i') else ''}{x.strip('/i')}', 0)) ELSE 0 END AS pos, html, {3 in lits} AS needs FROM pages"
    for p, s, x, _, lits, _ in REGEXES
)


@register(f"WITH r AS ({RX_SQL}) SELECT page_id, position, sig, pos, {line_sql('html', 'pos')} AS line FROM r WHERE pos > 0 AND (NOT needs OR contains({LOWER.format('html')}, 'then the'))")
def regex_match(spark, sf_dir):
    chunks, key = page_chunks(spark, sf_dir), ("page_id", "chunk")
    needed = rule_tables(spark)[1].filter(F.col("lit").isin(*{x for r in REGEXES for x in r[4]}))
    found = matching.located(chunks, needed, matching.possible(chunks, needed, key), key)  # anywhere, also inside words
    return matching.regex_matches(chunks, REGEXES, found.select(*key, "lit"), key).select("page_id", "position", "sig", "pos", "line")


PACK_SQL = """r AS (SELECT w, (row_number() OVER (ORDER BY w) - 1)::INT AS position FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) WHERE length(w) >= 4)"""


@register(f"""WITH {PACK_SQL}, h AS (SELECT doc_id, position, text, regexp_extract(text, w || ' +[a-z]+') AS m FROM documents, r WHERE contains({LOWER.format('text')}, w))
SELECT doc_id, position, instr(text, m)::INT AS pos FROM h WHERE m <> ''""")
def large_pack_match(spark, sf_dir):
    """A pack of a pattern for each word of the benchmark, over every document. Each pattern begins with its literal, which leads to it."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).filter(F.length("w") >= 4).distinct()
    pack = sorted(r.w for r in words.collect())  # a pack is a bounded table
    rules = [(i, i, f"/{w} +[a-z]+/", False, [i], ["file_any"]) for i, w in enumerate(pack)]
    return matching.regex_matches(document_chunks(spark, sf_dir), rules, key=("doc_id", "chunk")).select("doc_id", "position", "pos")


# rule hits drawn from words, for the order-dependent rules: 40 rules a document in two layers
HITS_SQL = """
h AS (
  SELECT doc_id, CASE WHEN p % 4 = 0 THEN 1 ELSE 2 END AS layer, p::INT AS position, CASE hash_ % 3 WHEN 0 THEN 'infected' WHEN 1 THEN 'suspicious' ELSE 'info' END AS tier
  FROM (SELECT doc_id, p, (n_chars * 31 + p * p * 7 + doc_id) AS hash_ FROM documents, range(40) r(p)) WHERE (hash_ // 3) % 2 = 0
)
"""


def drawn_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("p"))
    h = F.col("n_chars") * 31 + F.col("p") * F.col("p") * 7 + F.col("doc_id")
    docs = docs.withColumn("h", h).filter(F.floor(F.col("h") / 3) % 2 == 0)
    tier = F.when(F.col("h") % 3 == 0, "infected").when(F.col("h") % 3 == 1, "suspicious").otherwise("info")
    return docs.select("doc_id", F.when(F.col("p") % 4 == 0, 1).otherwise(2).alias("layer"), F.col("p").cast("int").alias("position"), tier.alias("tier"))


@register(f"""WITH {HITS_SQL}, w AS (
  SELECT *, coalesce(sum((tier = 'infected')::INT) OVER b, 0) AS seen, sum(CASE WHEN layer = 1 AND tier = 'infected' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS fst,
         coalesce(sum(CASE WHEN layer = 2 AND tier = 'infected' THEN 1 ELSE 0 END) OVER b, 0) AS rx
  FROM h WINDOW b AS (PARTITION BY doc_id ORDER BY layer, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, layer, position, tier FROM w WHERE layer = 1 OR (rx < greatest(1, 10 - fst) AND NOT (tier = 'suspicious' AND seen > 0))""")
def suppressed_matches(spark, sf_dir):
    return matching.suppress(drawn_hits(spark, sf_dir), key="doc_id")


@register(f"WITH {HITS_SQL}, m AS (SELECT doc_id, max({RANK_SQL.format('tier')}) AS r FROM h GROUP BY doc_id) SELECT doc_id, CASE r WHEN 3 THEN 'infected' WHEN 2 THEN 'suspicious' ELSE 'info' END AS tier FROM m")
def max_tier(spark, sf_dir):
    return findings.max_tier(drawn_hits(spark, sf_dir), "doc_id")


SMALL_CHUNK, SMALL_OVERLAP = 1000, 200
CHUNK_SQL = f"""
c AS (SELECT doc_id, i::INT AS chunk, (i * {SMALL_CHUNK - SMALL_OVERLAP})::INT AS offset_, substring(text, i * {SMALL_CHUNK - SMALL_OVERLAP} + 1, {SMALL_CHUNK}) AS t, text FROM documents,
      LATERAL (SELECT unnest(range(CASE WHEN length(text) <= {SMALL_CHUNK} THEN 1 ELSE ((length(text) - {SMALL_CHUNK} + {SMALL_CHUNK - SMALL_OVERLAP} - 1) // {SMALL_CHUNK - SMALL_OVERLAP}) + 1 END)) AS i))
"""


@register(f"WITH {CHUNK_SQL} SELECT doc_id, chunk, offset_ AS \"offset\", chunk = 0 AS first, chunk = max(chunk) OVER (PARTITION BY doc_id) AS last, (length(substring(text, 1, offset_)) - length(replace(substring(text, 1, offset_), chr(10), '')))::INT AS line_base, length(t)::INT AS n FROM c")
def chunked_reader(spark, sf_dir):
    from sievework.sources.files import chunks

    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.translate(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), "", ""), "ISO-8859-1").alias("content"))
    return chunks(docs, SMALL_CHUNK, SMALL_OVERLAP).select("doc_id", "chunk", "offset", "first", "last", "line_base", F.length("text").alias("n"))


@register(f"""WITH {CHUNK_SQL}, m AS (SELECT doc_id, chunk, s.sig, instr(t, s.x) AS pos FROM c, (VALUES (0, 'th'), (1, 'on'), (2, '.')) s(sig, x)), h AS (SELECT * FROM m WHERE pos > 0)
SELECT h.doc_id, h.chunk, h.sig, h.pos FROM h LEFT JOIN h p ON p.doc_id = h.doc_id AND p.sig = h.sig AND p.chunk = h.chunk - 1
WHERE NOT (h.chunk > 0 AND h.pos <= {SMALL_OVERLAP} AND coalesce(p.chunk * {SMALL_CHUNK - SMALL_OVERLAP} + p.pos - 1, -1) >= h.chunk * {SMALL_CHUNK - SMALL_OVERLAP})""")
def chunk_overlap_dedup(spark, sf_dir):
    from sievework.sources.files import chunks

    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", "?"), "ISO-8859-1").alias("content"))
    rules = F.array(*[F.struct(F.lit(i).alias("sig"), F.lit(x).alias("x")) for i, x in enumerate(("th", "on", "."))])
    hits = chunks(docs, SMALL_CHUNK, SMALL_OVERLAP).withColumn("r", F.explode(rules)).select("doc_id", "chunk", "r.sig", F.expr("instr(text, r.x)").alias("pos")).filter("pos > 0")
    return matching.drop_overlaps(hits, SMALL_CHUNK - SMALL_OVERLAP, SMALL_OVERLAP, "doc_id").select("doc_id", "chunk", "sig", "pos")


# --- hashes and integrity -----------------------------------------------------------------------------------------

FILES_SQL = "f AS (SELECT doc_id, text, md5(text) AS md5, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size FROM documents)"


def hashed_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


HASH_RULES_SQL = "r AS (SELECT 'md5' AS kind, md5(text) AS hex, (doc_id % 7)::INT AS sig FROM documents WHERE doc_id % 20 = 0 UNION ALL SELECT 'sha256', sha256(text), (doc_id % 5)::INT FROM documents WHERE doc_id % 30 = 0)"


@register(f"WITH {FILES_SQL}, {HASH_RULES_SQL} SELECT DISTINCT doc_id, CASE kind WHEN 'md5' THEN 0 ELSE 1 END AS position, sig FROM f JOIN r ON (kind = 'md5' AND hex = md5) OR (kind = 'sha256' AND hex = sha256)")
def hash_lookup(spark, sf_dir):
    f = hashed_documents(spark, sf_dir)
    r = f.filter("doc_id % 20 = 0").selectExpr("'md5' AS kind", "md5 AS hex", "CAST(doc_id % 7 AS INT) AS sig").unionByName(f.filter("doc_id % 30 = 0").selectExpr("'sha256' AS kind", "sha256 AS hex", "CAST(doc_id % 5 AS INT) AS sig"))
    return matching.hash_matches(f, r, "doc_id").distinct()


@register(f"WITH {FILES_SQL}, a AS (SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN md5 ELSE md5 || 'O' || size END AS k FROM f WHERE doc_id % 9 = 0) SELECT doc_id, EXISTS (SELECT 1 FROM a WHERE k = md5 OR k = md5 || 'O' || size) AS is_allowed FROM f")
def allowlist_anti(spark, sf_dir):
    f = hashed_documents(spark, sf_dir).withColumn("path", F.col("doc_id").cast("string"))
    a = f.filter("doc_id % 9 = 0").select(F.when(F.col("doc_id") % 2 == 0, F.col("md5")).otherwise(F.concat("md5", F.lit("O"), F.col("size").cast("string"))).alias("key")).distinct()
    return matching.allowed(f, a).select("doc_id", "is_allowed")


@register(f"""WITH {FILES_SQL}, l AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [md5] WHEN doc_id % 3 = 1 THEN [md5('x' || md5), md5('y' || md5)] END AS md5s FROM f WHERE doc_id % 3 < 2)
SELECT f.doc_id, CASE WHEN doc_id % 10 = 9 THEN 'match' WHEN doc_id % 11 = 0 THEN 'unknown' WHEN l.md5s IS NULL THEN 'unknown' WHEN list_contains(l.md5s, md5) THEN 'match' ELSE 'mismatch' END AS integrity,
       CASE WHEN doc_id % 10 <> 9 AND doc_id % 11 <> 0 AND NOT list_contains(l.md5s, md5) THEN l.md5s[1] END AS expected_md5 FROM f LEFT JOIN l USING (doc_id)""")
def integrity_status(spark, sf_dir):
    f = hashed_documents(spark, sf_dir)
    path = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("wp-content/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("dir/"), F.col("doc_id").cast("string")))
    f = f.select("doc_id", "md5", path.alias("path"), F.lit("core").alias("package"), F.col("doc_id").cast("string").alias("package_path"))
    wrong = lambda x: F.md5(F.concat(F.lit(x), F.col("md5")))
    lists = f.filter("doc_id % 3 < 2").select("package", F.col("package_path").alias("path"), F.when(F.col("doc_id") % 3 == 0, F.array("md5")).otherwise(F.array(wrong("x"), wrong("y"))).alias("md5s"))
    own = f.filter("doc_id % 10 = 9").select("path", "md5")
    return integrity.status(f, integrity.checksum_rows(lists), own).select("doc_id", "integrity", "expected_md5")


# --- classification -----------------------------------------------------------------------------------------------

PATH_SQL = """
p AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'wp-content/plugins/' || s || '/a.php' WHEN 1 THEN 'wp-content/themes/' || s || '/b.js' WHEN 2 THEN 'wp-content/mu-plugins/' || s || '.php' WHEN 3 THEN 'wp-content/uploads/' || s || '/' || s || '/' || s || '/x.php'
  WHEN 4 THEN 'wp-admin/images/' || s || '.png' WHEN 5 THEN upper(substring(s, 1, 2)) || lower(substring(s, 3, 2)) || upper(substring(s, 5, 1)) || 'x/i.htm' WHEN 6 THEN s || page_id || 'qzkvbnwxrt/.htaccess' ELSE 'wp-' || s || '.php' END AS path
  FROM (SELECT page_id, regexp_extract(url, '//(?:m\\.)?([a-z]+)', 1) AS s FROM pages))
"""


def page_paths(spark, sf_dir):
    s, n = F.col("s"), F.col("page_id")
    at = n % 8
    lit = F.lit
    path = (
        F.when(at == 0, F.concat(lit("wp-content/plugins/"), s, lit("/a.php"))).when(at == 1, F.concat(lit("wp-content/themes/"), s, lit("/b.js"))).when(at == 2, F.concat(lit("wp-content/mu-plugins/"), s, lit(".php")))
        .when(at == 3, F.concat(lit("wp-content/uploads/"), s, lit("/"), s, lit("/"), s, lit("/x.php"))).when(at == 4, F.concat(lit("wp-admin/images/"), s, lit(".png")))
        .when(at == 5, F.concat(F.upper(F.substring(s, 1, 2)), F.lower(F.substring(s, 3, 2)), F.upper(F.substring(s, 5, 1)), lit("x/i.htm")))
        .when(at == 6, F.concat(s, n.cast("string"), lit("qzkvbnwxrt/.htaccess"))).otherwise(F.concat(lit("wp-"), s, lit(".php")))
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract("url", r"//(?:m\.)?([a-z]+)", 1).alias("s"))
    return pages.select("page_id", "html", path.alias("path"))


ORIGIN_SQL = """CASE WHEN regexp_matches(path, '^wp-content/plugins/[^/]+/') THEN CASE WHEN regexp_extract(path, '^wp-content/plugins/([^/]+)/', 1) IN ('thth', 'ththth', 'ththre') THEN 'plugin:' || regexp_extract(path, '^wp-content/plugins/([^/]+)/', 1) ELSE 'other' END
  WHEN regexp_matches(path, '^wp-content/themes/[^/]+/') THEN CASE WHEN regexp_extract(path, '^wp-content/themes/([^/]+)/', 1) IN ('thther') THEN 'theme:thther' ELSE 'other' END
  WHEN starts_with(path, 'wp-content/mu-plugins/') THEN 'mu' WHEN starts_with(path, 'wp-content/uploads/') THEN 'uploads'
  WHEN starts_with(path, 'wp-admin/') OR starts_with(path, 'wp-includes/') OR path IN ('index.php', 'xmlrpc.php') OR regexp_matches(path, '^wp-[^/]*\\.php$') THEN 'core' ELSE 'other' END"""
SLUGS = ("plugin:thth", "plugin:ththth", "plugin:ththre", "theme:thther")


def with_origin(df):
    return df.withColumn("origin", classify.origin(F.col("path"), F.array(*map(F.lit, SLUGS))))


@register(f"WITH {PATH_SQL} SELECT page_id, path, {ORIGIN_SQL} AS origin FROM p")
def origin_tag(spark, sf_dir):
    return with_origin(page_paths(spark, sf_dir)).select("page_id", "path", "origin")


KIND_SQL = """CASE WHEN regexp_matches(substring(t, 1, 4096), '(?i)<\\?php') OR contains(substring(t, 1, 64), '<?=') THEN 'php' WHEN starts_with(t, 'MZ') OR starts_with(t, '#!') THEN 'binary' WHEN regexp_matches(substring(t, 1, 4096), '(?i)<script|<html|<!doctype') THEN 'html'
  WHEN ext IN ('js', 'mjs') THEN 'js' WHEN ext IN ('php', 'phtml', 'php5', 'php7', 'phar', 'inc') THEN 'php' ELSE 'other' END"""
KIND_FROM = f"""{PATH_SQL}, k AS (SELECT 'page' AS src, page_id AS id, CASE WHEN page_id % 3 = 0 THEN '<?php ' || html ELSE html END AS t, regexp_extract(lower(path), '\\.([^./]*)$', 1) AS ext FROM p JOIN pages USING (page_id)
  UNION ALL SELECT 'doc', doc_id, CASE WHEN doc_id % 5 = 0 THEN '#!' || text ELSE text END, CASE doc_id % 4 WHEN 0 THEN 'js' WHEN 1 THEN 'inc' ELSE 'txt' END FROM documents)"""


def kinds_of(spark, sf_dir):
    php = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<?php "), F.col("html"))).otherwise(F.col("html"))
    pages = page_paths(spark, sf_dir).select(F.lit("page").alias("src"), F.col("page_id").alias("id"), php.alias("t"), text.extension(F.col("path")).alias("ext"))
    shell = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("#!"), F.col("text"))).otherwise(F.col("text"))
    ext = F.when(F.col("doc_id") % 4 == 0, "js").when(F.col("doc_id") % 4 == 1, "inc").otherwise("txt")
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), shell.alias("t"), ext.alias("ext"))
    head = F.substring(F.encode("t", "UTF-8"), 1, classify.HEAD)
    return pages.unionByName(docs).withColumn("kind", classify.content_kind(head, F.col("ext")))


@register(f"WITH {KIND_FROM} SELECT src, id, ext, {KIND_SQL} AS kind FROM k")
def content_kind(spark, sf_dir):
    return kinds_of(spark, sf_dir).select("src", "id", "ext", "kind")


@register(f"WITH {KIND_FROM} SELECT {KIND_SQL} AS kind, count(*) AS n FROM k GROUP BY 1")
def kind_stats(spark, sf_dir):
    return inventory.kinds(kinds_of(spark, sf_dir))


ENTROPY_SQL = "(SELECT coalesce(-sum(c * 1.0 / l * log2(c * 1.0 / l)), 0) FROM (SELECT count(*) AS c, max(length({0})) AS l FROM (SELECT unnest(string_split({0}, '')) AS ch) WHERE ch <> '' GROUP BY ch))"


@register(f"""WITH {PATH_SQL}, s AS (SELECT page_id, path, string_split(path, '/')[1] AS root, string_split(path, '/')[:-2] AS d FROM p), c AS (SELECT page_id, unnest(string_split(path, '')) AS ch, length(path) AS l FROM s),
e AS (SELECT page_id, -sum(n * 1.0 / l * log2(n * 1.0 / l)) AS entropy FROM (SELECT page_id, ch, l, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL) GROUP BY page_id)
SELECT page_id, round(entropy, 6) AS entropy, len(list_filter(range(1, length(root)), lambda i: regexp_matches(substring(root, i, 2), '^([a-z][A-Z]|[A-Z][a-z])$')))::INT AS transitions,
  len(list_filter(range(3, len(d) + 1), lambda i: d[i] <> '' AND d[i] = d[i - 1] AND d[i] = d[i - 2])) > 0 AS nested FROM s JOIN e USING (page_id)""")
def path_shape(spark, sf_dir):
    root = F.substring_index("path", "/", 1)
    return page_paths(spark, sf_dir).select("page_id", F.round(text.entropy(F.col("path")), 6).alias("entropy"), text.case_transitions(root).alias("transitions"), classify.nested_same_dir(F.col("path")).alias("nested"))


@register(f"""WITH {PATH_SQL}, o AS (SELECT page_id, path, {ORIGIN_SQL} AS origin, CASE WHEN page_id % 5 = 0 THEN 'php' ELSE 'html' END AS kind, page_id % 4 < 2 AS core, page_id % 6 = 0 AS good, string_split(path, '/')[1] AS root, regexp_extract(path, '\\.([^./]*)$', 1) AS ext, string_split(path, '/')[:-2] AS d FROM p),
c AS (SELECT page_id, unnest(string_split(root, '')) AS ch, length(root) AS l FROM o), e AS (SELECT page_id, -sum(n * 1.0 / l * log2(n * 1.0 / l)) AS h FROM (SELECT page_id, ch, l, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL) GROUP BY page_id),
r AS (SELECT page_id, list_filter([
  CASE WHEN kind = 'php' AND origin = 'uploads' THEN {{'k': 'php_in_uploads', 'w': 60}} END, CASE WHEN NOT core AND origin = 'core' AND (starts_with(path, 'wp-admin/') OR starts_with(path, 'wp-includes/')) THEN {{'k': 'unknown_core_path', 'w': 60}} END,
  CASE WHEN len(list_filter(range(3, len(d) + 1), lambda i: d[i] <> '' AND d[i] = d[i - 1] AND d[i] = d[i - 2])) > 0 THEN {{'k': 'nested_same_dir', 'w': 50}} END,
  CASE WHEN contains(path, '/') AND root NOT IN ('wp-admin', 'wp-includes', 'wp-content') AND CASE WHEN length(root) >= 8 THEN NOT regexp_matches(root, '(?i)[aeiou]') OR h > 3.5 WHEN length(root) >= 5 THEN len(list_filter(range(1, length(root)), lambda i: regexp_matches(substring(root, i, 2), '^([a-z][A-Z]|[A-Z][a-z])$'))) >= 2 ELSE false END THEN {{'k': 'random_root_dir', 'w': 40}} END,
  CASE WHEN origin = 'mu' AND NOT good THEN {{'k': 'mu_plugin_unknown', 'w': 30}} END, CASE WHEN kind = 'php' AND ext NOT IN ('php', 'phtml', 'inc', 'phar') THEN {{'k': 'php_disguised', 'w': 40}} END,
  CASE WHEN NOT core AND regexp_matches(path, '^(wp-admin|wp-includes)/(.*/)?images/[^/]+$') AND ext = 'png' THEN {{'k': 'fake_core_asset', 'w': 50}} END,
  CASE WHEN ends_with(path, '/.htaccess') AND NOT starts_with(path, 'wp-admin/') AND NOT starts_with(path, 'wp-content/uploads/') THEN {{'k': 'stray_htaccess', 'w': 20}} END], lambda x: x IS NOT NULL) AS rs FROM o JOIN e USING (page_id))
SELECT page_id, least(100, coalesce(list_sum(list_transform(rs, lambda x: x.w)), 0))::INT AS score, list_transform(rs, lambda x: x.k) AS reasons FROM r""")
def path_signal(spark, sf_dir):
    p, n = with_origin(page_paths(spark, sf_dir)), F.col("page_id")
    kind = F.when(n % 5 == 0, "php").otherwise("html")
    rules = classify.signals(F.col("path"), F.col("origin"), kind, n % 4 < 2, n % 6 == 0)
    return p.withColumn("s", classify.path_signal(rules)).select("page_id", "s.score", "s.reasons")


# --- rows ---------------------------------------------------------------------------------------------------------

ROW_RULES = [("db_post", 0, "/thth[a-z]+on/i", "%thth%"), ("db_post", 1, "/(queja|enque)\\w*/", "%que%"), ("db_post", 2, "/[0-9]{3,}/", "%sch%")]
ROW_WHERE = "(text ILIKE '%thth%' OR text ILIKE '%que%' OR text ILIKE '%sch%')"
ROW_PATTERNS = ["(?i)thth[a-z]+on", "(queja|enque)[0-9A-Za-z_]*", "[0-9]{3,}"]
ROW_HITS = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {i} END" for i, p in enumerate(ROW_PATTERNS))


@register(f"SELECT src, id, sigs FROM (SELECT 'doc' AS src, doc_id AS id, list_filter([{ROW_HITS}], lambda x: x IS NOT NULL) AS sigs FROM documents WHERE {ROW_WHERE} UNION ALL SELECT 'conv', conv_id * 1000 + turn, list_filter([{ROW_HITS}], lambda x: x IS NOT NULL) FROM conversations WHERE {ROW_WHERE}) WHERE len(sigs) > 0")
def row_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text")
    conv = table(spark, sf_dir, "conversations").select(F.lit("conv").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return rows.match_rows(docs.unionByName(conv), ROW_RULES, ["text"]).select("src", "id", F.transform("matches", lambda m: m["sig"]).alias("sigs"))


@register("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%build%' AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)")
def new_members(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return rows.new_members(c.filter(F.col("c_mktsegment").ilike("%build%")).select("c_custkey").distinct(), c.filter("c_nationkey < 12").select("c_custkey"), "c_custkey")


@register("SELECT event_id, CASE event_type WHEN 'view' THEN 'yes' WHEN 'click' THEN 'no' ELSE 'auto' END AS autoload FROM events WHERE (event_type <> 'click' OR contains(props, '7')) AND NOT starts_with(event_type, 'err')")
def option_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    auto = F.when(F.col("event_type") == "view", "yes").when(F.col("event_type") == "click", "no").otherwise("auto")
    name = F.when(F.col("props").contains("7"), F.concat("event_type", F.lit("_widget"))).otherwise(F.col("event_type"))
    return rows.options_rows(e.select("event_id", auto.alias("autoload"), name.alias("option_name")), ["siteurl"], ["err"]).select("event_id", "autoload")


# --- findings -----------------------------------------------------------------------------------------------------

FIND_SQL = """f AS (SELECT event_id, sha256('file|' || event_id) AS locator_hash, 'file' AS type, CAST(event_id AS VARCHAR) AS locator, CASE event_id % 5 WHEN 0 THEN 'acknowledged' WHEN 1 THEN 'ignored' ELSE 'new' END AS state,
  CASE WHEN value > 10 THEN 'alert' ELSE 'review' END AS severity, user_id AS last_seen, event_id % 1000 AS first_seen, event_type AS reason FROM events)"""


def event_findings(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    state = F.when(n % 5 == 0, "acknowledged").when(n % 5 == 1, "ignored").otherwise("new")
    locator = n.cast("string")
    return e.select(
        "event_id", findings.fingerprint(F.lit("file"), locator).alias("locator_hash"), F.lit("file").alias("type"), locator.alias("locator"), F.array("event_type").alias("signature_ids"), state.alias("state"),
        F.when(F.col("value") > 10, "alert").otherwise("review").alias("severity"), F.col("user_id").alias("last_seen"), (n % 1000).alias("first_seen"), F.col("event_type").alias("reason"), F.lit(0).cast("long").alias("state_changed_at"),
    )


@register(f"WITH {FIND_SQL} SELECT state, severity, count(*) AS n FROM f GROUP BY ALL")
def findings_counts_by_state_severity(spark, sf_dir):
    return findings.counts(event_findings(spark, sf_dir))


@register(f"WITH {FIND_SQL} SELECT s.state, v.severity, count(f.event_id) AS n FROM (VALUES ('new'), ('acknowledged'), ('ignored')) s(state) CROSS JOIN (VALUES ('alert'), ('review')) v(severity) LEFT JOIN (SELECT * FROM f WHERE state <> 'ignored') f ON f.state = s.state AND f.severity = v.severity GROUP BY ALL")
def findings_counts_dense(spark, sf_dir):
    return findings.dense_counts(event_findings(spark, sf_dir).filter("state <> 'ignored'"))


@register(f"WITH {FIND_SQL} SELECT event_id, locator_hash, state, last_seen FROM f WHERE severity = 'alert' AND contains(lower(reason), 'e') ORDER BY last_seen DESC, locator_hash LIMIT 50 OFFSET 50")
def findings_page(spark, sf_dir):
    chosen = findings.select_findings(event_findings(spark, sf_dir).withColumn("signature_ids", F.array().cast("array<string>")).withColumn("locator", F.translate("locator", "e", "")), severity="alert", search="E")
    return findings.page(chosen, 2).select("event_id", "locator_hash", "state", "last_seen")


@register(f"WITH {FIND_SQL} SELECT event_id, locator_hash, last_seen, (SELECT count(*) FROM f WHERE severity = 'alert') AS total FROM f WHERE severity = 'alert' ORDER BY last_seen DESC, locator_hash LIMIT 50 OFFSET 100")
def findings_page_with_total(spark, sf_dir):
    return findings.page_with_total(findings.select_findings(event_findings(spark, sf_dir), severity="alert"), 3).select("event_id", "locator_hash", "last_seen", "total")


@register(f"""WITH {FIND_SQL}, k AS (SELECT last_seen AS s, locator_hash AS h FROM f ORDER BY last_seen DESC, locator_hash LIMIT 1 OFFSET 50)
SELECT event_id, locator_hash, last_seen FROM f, k WHERE last_seen < s OR last_seen = s AND locator_hash > h ORDER BY last_seen DESC, locator_hash LIMIT 50""")
def findings_page_after(spark, sf_dir):
    f = event_findings(spark, sf_dir)
    last = findings.page(f, 2, 50).select("last_seen", "locator_hash").first()  # one row: where the reader's page ended
    return findings.page_after(f, F.lit(last.last_seen), F.lit(last.locator_hash)).select("event_id", "locator_hash", "last_seen")


@register(f"""WITH {FIND_SQL}, d AS (SELECT s AS state, t AS type FROM unnest(['new', 'acknowledged', 'ignored']) a(s), unnest(['file', 'integrity', 'db', 'vulnerability']) b(t)),
n AS (SELECT state, ['file', 'integrity', 'db', 'vulnerability'][event_id % 3 + 1] AS type, count(*) AS n FROM f GROUP BY ALL) SELECT state, type, coalesce(n, 0) AS n FROM d LEFT JOIN n USING (state, type)""")
def findings_by_type(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, findings.TYPES)), (F.col("event_id") % 3).cast("int"))
    return findings.counts_by_type(event_findings(spark, sf_dir).withColumn("type", kind))


@register(f"WITH {FIND_SQL} SELECT count(*) FILTER (state <> 'ignored') AS \"all\", count(*) FILTER (state = 'new' AND severity = 'alert') AS alerts, count(*) FILTER (state = 'new' AND severity = 'review') AS review, count(*) FILTER (state = 'acknowledged') AS acknowledged, count(*) FILTER (state = 'ignored') AS ignored FROM f")
def findings_views(spark, sf_dir):
    return findings.chips(event_findings(spark, sf_dir))


@register(f"WITH {FIND_SQL} SELECT event_id, severity FROM f WHERE state = 'new' AND first_seen >= 700")
def findings_new_since(spark, sf_dir):
    return findings.new_since(event_findings(spark, sf_dir), F.lit(700)).select("event_id", "severity")


@register(f"WITH {FIND_SQL} SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'ignored' ELSE state END AS state, CASE WHEN event_id % 7 = 0 THEN 5000 ELSE 0 END::BIGINT AS state_changed_at FROM f")
def findings_set_state(spark, sf_dir):
    f = event_findings(spark, sf_dir)
    return findings.set_state(f, f.filter("event_id % 7 = 0"), "ignored", F.lit(5000).cast("long")).select("event_id", "state", "state_changed_at")


@register(f"WITH {FIND_SQL}, t AS (SELECT count(*) AS total FROM f WHERE severity = 'alert') SELECT locator_hash, severity, 'ALERT: ' || locator AS line, total FROM f, t WHERE severity = 'alert' ORDER BY severity, locator_hash LIMIT 20")
def findings_digest(spark, sf_dir):
    return findings.digest(event_findings(spark, sf_dir))


MERGE_SQL = """
b AS (SELECT doc_id, sha256('file|' || doc_id) AS k, CASE doc_id % 3 WHEN 0 THEN ['a'] WHEN 1 THEN ['a', 'b'] ELSE ['c'] END AS ids, CASE doc_id % 4 WHEN 0 THEN 'infected' WHEN 1 THEN 'suspicious' ELSE 'info' END AS tier,
  CASE doc_id % 4 WHEN 0 THEN 'alert' ELSE 'review' END AS severity, CASE doc_id % 5 WHEN 0 THEN 'ignored' WHEN 1 THEN 'acknowledged' ELSE 'new' END AS state FROM documents WHERE doc_id % 10 < 7),
n AS (SELECT doc_id, sha256('file|' || doc_id) AS k, CASE n_chars % 3 WHEN 0 THEN ['a'] WHEN 1 THEN ['b', 'd'] ELSE ['c'] END AS ids, CASE n_chars % 4 WHEN 0 THEN 'infected' WHEN 1 THEN 'suspicious' ELSE 'info' END AS tier,
  CASE n_chars % 4 WHEN 0 THEN 'alert' ELSE 'review' END AS severity FROM documents WHERE doc_id % 10 >= 3)
"""


def _half(spark, sf_dir, by, where):
    ids = F.when(by % 3 == 0, F.array(F.lit("a"))).when(by % 3 == 1, F.array(F.lit("a"), F.lit("b")) if by is not None and where == "old" else F.array(F.lit("b"), F.lit("d"))).otherwise(F.array(F.lit("c")))
    tier = F.when(by % 4 == 0, "infected").when(by % 4 == 1, "suspicious").otherwise("info")
    d = table(spark, sf_dir, "documents").filter("doc_id % 10 < 7" if where == "old" else "doc_id % 10 >= 3")
    n = F.col("doc_id")
    return d.select(
        findings.fingerprint(F.lit("file"), n.cast("string")).alias("locator_hash"), F.lit("file").alias("type"), n.cast("string").alias("locator"), ids.alias("signature_ids"), tier.alias("tier"), F.when(by % 4 == 0, "alert").otherwise("review").alias("severity"),
        F.lit(where).alias("category"), F.lit(1).alias("line"), F.lit("").alias("excerpt"), F.lit(where).alias("reason"), F.lit(100).cast("long").alias("first_seen"), F.lit(100).cast("long").alias("last_seen"),
        F.when(n % 5 == 0, "ignored").when(n % 5 == 1, "acknowledged").otherwise("new").alias("state"), F.lit(0).cast("long").alias("state_changed_at"),
    )


@register(f"""WITH {MERGE_SQL}, j AS (SELECT coalesce(b.k, n.k) AS locator_hash, b.ids AS oi, n.ids AS ni, b.tier AS ot, n.tier AS nt, b.severity AS os, n.severity AS ns, b.state AS st, b.k AS bk, n.k AS nk, list_concat(b.ids, list_filter(n.ids, lambda x: NOT list_contains(b.ids, x))) AS un,
  {RANK_SQL.format('n.tier')} >= {RANK_SQL.format('b.tier')} AS rise FROM b FULL JOIN n USING (k))
SELECT locator_hash, CASE WHEN nk IS NULL THEN oi WHEN bk IS NULL THEN ni ELSE un END AS signature_ids, CASE WHEN nk IS NULL OR (bk IS NOT NULL AND NOT rise) THEN ot ELSE nt END AS tier, CASE WHEN nk IS NULL OR (bk IS NOT NULL AND NOT rise) THEN os ELSE ns END AS severity,
  CASE WHEN nk IS NULL THEN 'old' ELSE 'new' END AS category, CASE WHEN bk IS NULL THEN 'new' WHEN nk IS NOT NULL AND st = 'ignored' AND len(un) > len(oi) THEN 'new' ELSE st END AS state,
  CASE WHEN bk IS NULL THEN 900 ELSE 100 END::BIGINT AS first_seen, CASE WHEN nk IS NULL THEN 100 ELSE 900 END::BIGINT AS last_seen, CASE WHEN nk IS NOT NULL AND bk IS NOT NULL AND st = 'ignored' AND len(un) > len(oi) THEN 900 ELSE 0 END::BIGINT AS state_changed_at FROM j""")
def findings_merge(spark, sf_dir):
    old, new = _half(spark, sf_dir, F.col("doc_id"), "old"), _half(spark, sf_dir, F.col("n_chars"), "new")
    out = findings.merge(old, new, F.lit(900).cast("long"))
    return out.select("locator_hash", "signature_ids", "tier", "severity", "category", "state", "first_seen", "last_seen", "state_changed_at")


@register(f"WITH {HITS_SQL}, l AS (SELECT doc_id, max({RANK_SQL.format('tier')}) AS r FROM h GROUP BY doc_id) SELECT doc_id, quality, CASE WHEN r = 3 OR (r = 2 AND quality * 60 >= 40) THEN 'alert' ELSE 'review' END AS severity FROM l JOIN labels USING (doc_id)")
def finding_severity(spark, sf_dir):
    t = findings.max_tier(drawn_hits(spark, sf_dir), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    return t.select("doc_id", "quality", findings.severity(F.col("tier"), F.col("quality") * 60).alias("severity"))


# --- inventory ----------------------------------------------------------------------------------------------------

INV_SQL = """i AS (SELECT doc_id, source || '/' || doc_id AS path, sha256(source || '/' || doc_id) AS path_hash, n_chars AS size, doc_id % 97 AS mtime, CASE WHEN doc_id % 13 = 0 THEN '' ELSE md5(text) END AS md5, CASE doc_id % 17 WHEN 0 THEN 'unreadable' ELSE lang END AS kind,
  doc_id % 4 = 0 AS known_good, (doc_id % 3)::INT AS scanned_bundle, (doc_id % 101)::INT AS path_signal, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 2 END AS seen_run FROM documents)"""


def inventory_rows(spark, sf_dir):
    n = F.col("doc_id")
    path = F.concat("source", F.lit("/"), n.cast("string"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", path.alias("path"), inventory.path_hash(path).alias("path_hash"), F.col("n_chars").alias("size"), (n % 97).alias("mtime"), F.when(n % 13 == 0, "").otherwise(F.md5("text")).alias("md5"), F.lit("x").alias("sha256"),
        F.when(n % 17 == 0, "unreadable").otherwise(F.col("lang")).alias("kind"), F.lit("other").alias("origin"), (n % 4 == 0).alias("known_good"), (n % 3).cast("int").alias("scanned_bundle"), (n % 101).cast("int").alias("path_signal"), F.when(n % 6 == 0, 1).otherwise(2).alias("seen_run"),
    )


QUEUE = "NOT known_good AND scanned_bundle <> 2 AND md5 <> '' AND kind <> 'unreadable'"


@register(f"WITH {INV_SQL} SELECT doc_id, path FROM i WHERE {QUEUE} AND starts_with(path, 'src1')")
def queue_filter(spark, sf_dir):
    return inventory.queue(inventory_rows(spark, sf_dir), 2, "src1").select("doc_id", "path")


@register(f"WITH {INV_SQL} SELECT count(*) AS files, count(*) FILTER (known_good) AS known_good, count(*) FILTER ({QUEUE}) AS queued, count(*) FILTER (md5 = '') AS unhashed, count(*) FILTER (path_signal >= 40) AS signalled, round(100.0 * count(*) FILTER (known_good) / greatest(count(*), 1), 1) AS known_good_percent FROM i")
def index_statistics(spark, sf_dir):
    return inventory.statistics(inventory_rows(spark, sf_dir), 2)


@register(f"""WITH {INV_SQL}, s AS (SELECT * FROM i WHERE doc_id % 10 < 8), w AS (SELECT path_hash, path, CASE WHEN doc_id % 7 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 9 = 0 THEN mtime + 1 ELSE mtime END AS mtime, 50 AS path_signal FROM i WHERE doc_id % 10 >= 2),
j AS (SELECT coalesce(s.path_hash, w.path_hash) AS path_hash, w.path_hash IS NOT NULL AS seen, s.path_hash IS NULL AS fresh, coalesce(s.size <> w.size OR s.mtime <> w.mtime, false) AS changed, s.*, w.size AS ws, w.path_signal AS wp FROM s FULL JOIN w ON s.path_hash = w.path_hash)
SELECT path_hash, CASE WHEN seen THEN ws ELSE size END AS size, CASE WHEN fresh OR changed THEN '' ELSE md5 END AS md5, CASE WHEN fresh OR changed THEN false ELSE known_good END AS known_good, CASE WHEN fresh OR changed THEN 0 ELSE scanned_bundle END AS scanned_bundle, coalesce(path_signal, wp) AS path_signal,
  CASE WHEN seen THEN 3 ELSE seen_run END AS seen_run, CASE WHEN fresh THEN 'added' WHEN changed THEN 'changed' WHEN seen THEN 'same' ELSE 'missing' END AS change FROM j""")
def inventory_diff(spark, sf_dir):
    i, n = inventory_rows(spark, sf_dir), F.col("doc_id")
    walk = i.filter("doc_id % 10 >= 2").select("path_hash", "path", F.when(n % 7 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(n % 9 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"), "origin", F.lit(50).alias("path_signal"))
    return inventory.upsert(i.filter("doc_id % 10 < 8"), walk, 3).select("path_hash", "size", "md5", "known_good", "scanned_bundle", "path_signal", "seen_run", "change")


@register(f"WITH {INV_SQL} SELECT doc_id FROM i WHERE seen_run < 2")
def vanished_files(spark, sf_dir):
    return inventory.vanished(inventory_rows(spark, sf_dir), 2).select("doc_id")


@register(f"WITH {INV_SQL} SELECT doc_id, scanned_bundle > 0 AND scanned_bundle >= 2 AND doc_id % 8 <> 3 AS only_new FROM i")
def incremental_candidates(spark, sf_dir):
    i = inventory_rows(spark, sf_dir)
    return inventory.only_new_rules(i, i.filter("doc_id % 8 = 3").select("path_hash"), 2, True, "changed").select("doc_id", "only_new")


@register("SELECT DISTINCT md5(text) AS sig_id FROM benchmark WHERE item_id % 3 <> 0 AND md5(text) NOT IN (SELECT md5(text) FROM benchmark WHERE item_id % 3 = 0)")
def new_rules(spark, sf_dir):
    from sievework.sources.pack import new_signatures

    b = table(spark, sf_dir, "benchmark").select("item_id", F.md5("text").alias("sig_id"))
    return new_signatures(b.filter("item_id % 3 = 0"), b.filter("item_id % 3 <> 0").select("sig_id").distinct())


# --- vulnerabilities ----------------------------------------------------------------------------------------------

VERSION_SQL = """CASE p_partkey % 6 WHEN 0 THEN p_size || '.' || p_partkey % 12 WHEN 1 THEN p_size || '.' || p_partkey % 12 || '.' || p_partkey % 5 WHEN 2 THEN p_size || '.0-beta' || p_partkey % 4 WHEN 3 THEN p_size || '.0rc' || p_partkey % 3 WHEN 4 THEN p_size || '.0' ELSE p_size || '' END"""


def key_sql(v: str) -> str:
    parts = f"list_filter(string_split(regexp_replace(regexp_replace(translate(lower({v}), '-_+', '...'), '([0-9])([^0-9.])', '\\1.\\2', 'g'), '([^0-9.])([0-9])', '\\1.\\2', 'g'), '.'), lambda p: p <> '')"
    return f"list_append(list_transform({parts}, lambda p: {{'r': CASE WHEN regexp_full_match(p, '[0-9]+') THEN 4 WHEN starts_with(p, 'beta') THEN 2 WHEN starts_with(p, 'rc') THEN 3 ELSE -1 END, 'n': coalesce(try_cast(p AS BIGINT), -1)}}), {{'r': 4, 'n': -1::BIGINT}})"


RANGE_SQL = f"v AS (SELECT p_partkey, p_brand, {VERSION_SQL} AS version FROM part), r(p_brand, lo, hi, hi_in) AS (SELECT DISTINCT p_brand, (length(p_brand) + ascii(right(p_brand, 1)) % 9) || '.0', (20 + ascii(right(p_brand, 1)) % 25) || '.3', ascii(right(p_brand, 1)) % 2 = 0 FROM part)"


@register(f"WITH {RANGE_SQL} SELECT p_partkey, version FROM v JOIN r USING (p_brand) WHERE {key_sql('version')} >= {key_sql('lo')} AND ({key_sql('version')} < {key_sql('hi')} OR (hi_in AND {key_sql('version')} = {key_sql('hi')}))")
def version_range_match(spark, sf_dir):
    p, n, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size").cast("string")
    lit, t = F.lit, (lambda c: c.cast("string"))
    version = (
        F.when(n % 6 == 0, F.concat(s, lit("."), t(n % 12))).when(n % 6 == 1, F.concat(s, lit("."), t(n % 12), lit("."), t(n % 5))).when(n % 6 == 2, F.concat(s, lit(".0-beta"), t(n % 4)))
        .when(n % 6 == 3, F.concat(s, lit(".0rc"), t(n % 3))).when(n % 6 == 4, F.concat(s, lit(".0"))).otherwise(s)
    )
    software = p.select("p_partkey", lit("plugin").alias("kind"), F.col("p_brand").alias("slug"), version.alias("version"))
    a = F.ascii(F.substring("p_brand", -1, 1))
    rng = F.struct(F.concat(t(F.length("p_brand") + a % 9), lit(".0")).alias("from_version"), F.concat(t(20 + a % 25), lit(".3")).alias("to_version"), lit(True).alias("from_inclusive"), (a % 2 == 0).alias("to_inclusive"))
    entry = F.struct(lit("plugin").alias("type"), F.col("p_brand").alias("slug"), F.col("p_brand").alias("name"), lit(True).alias("patched"), F.array(lit("99.9")).alias("patched_versions"), F.create_map(lit("any"), rng).alias("affected_versions"))
    records = p.select("p_brand").distinct().select(F.col("p_brand").alias("id"), F.col("p_brand").alias("title"), lit(False).alias("informational"), F.array(entry).alias("software"))
    hits = vulnerability.matches(software.select("kind", "slug", "version").distinct(), records).select("kind", "slug", "version")
    return software.join(hits, ["kind", "slug", "version"], "left_semi").select("p_partkey", "version")


# --- runs ---------------------------------------------------------------------------------------------------------

RUN_SQL = "r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'done' END AS status FROM orders)"


def run_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("done").alias("status"))


@register(f"WITH {RUN_SQL} SELECT * FROM r ORDER BY id DESC LIMIT 10")
def run_latest(spark, sf_dir):
    return runs.latest(run_rows(spark, sf_dir))


@register(f"WITH {RUN_SQL} SELECT * FROM r ORDER BY id DESC LIMIT 50")
def run_prune(spark, sf_dir):
    return runs.pruned(run_rows(spark, sf_dir))


@register(f"WITH {RUN_SQL}, t AS (SELECT * FROM r ORDER BY id DESC LIMIT 10) SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM t u WHERE u.id >= t.id AND u.status <> 'failed')) AS streak FROM t")
def failure_streak(spark, sf_dir):
    return runs.failure_streak(run_rows(spark, sf_dir))


@register(f"WITH {FIND_SQL}, {RUN_SQL} SELECT CASE WHEN a > 0 THEN 'crit' WHEN n = 0 THEN 'unknown' WHEN s = 'failed' THEN 'warn' ELSE 'ok' END AS verdict, a AS alerts, n AS runs FROM (SELECT (SELECT count(*) FROM f WHERE state = 'new' AND severity = 'alert' AND value_ > 24) AS a, (SELECT count(*) FROM r) AS n, (SELECT status FROM r ORDER BY id DESC LIMIT 1) AS s)".replace("event_type AS reason FROM", "event_type AS reason, value AS value_ FROM"))
def status_verdict(spark, sf_dir):
    high = table(spark, sf_dir, "events").filter("value > 24").select("event_id")
    alerts = event_findings(spark, sf_dir).filter("state = 'new' AND severity = 'alert'").join(high, "event_id", "left_semi").agg(F.count(F.lit(1)).alias("alerts"))
    r = run_rows(spark, sf_dir)
    log = r.agg(F.count(F.lit(1)).alias("runs"), F.max_by("status", "id").alias("last"), F.max(F.when(F.col("status") == "done", F.col("id"))).alias("success"))
    v = runs.verdict(F.col("alerts"), F.col("runs"), F.col("last"), F.col("success"), F.lit(0), F.lit(0))
    return alerts.join(F.broadcast(log)).select(v.alias("verdict"), "alerts", "runs")


@register("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR WHEN 1 THEN CASE WHEN date_trunc('day', ts) + INTERVAL 3 HOUR > ts THEN date_trunc('day', ts) + INTERVAL 3 HOUR ELSE date_trunc('day', ts) + INTERVAL 27 HOUR END
  WHEN 2 THEN CASE WHEN date_trunc('day', ts) + INTERVAL 3 HOUR > ts THEN date_trunc('day', ts) + INTERVAL 3 HOUR ELSE date_trunc('day', ts) + INTERVAL 171 HOUR END END AS due, CASE event_id % 4 WHEN 0 THEN 3600 WHEN 1 THEN 86400 WHEN 2 THEN 604800 ELSE 0 END AS every FROM events""")
def next_due(spark, sf_dir):
    n = F.col("event_id") % 4
    s = F.when(n == 0, "hourly").when(n == 1, "daily").when(n == 2, "weekly").otherwise("off")
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.select("event_id", schedule.next_due(F.col("at"), s, F.lit(3)).cast("timestamp_ntz").alias("due"), schedule.interval_seconds(s).alias("every"))


# --- heuristics ---------------------------------------------------------------------------------------------------

CODE_SQL = r"""c AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<?php' || chr(10) || '/* Plugin Name: ' || page_id || ' */' || chr(10) ELSE '<?php' || chr(10) END
  || CASE page_id % 3 WHEN 0 THEN 'error_reporting(0);' || chr(10) ELSE '' END || '$a = $_POST["x"];' || chr(10) || CASE page_id % 5 WHEN 0 THEN '$b = trim($a);' || chr(10) || 'eval($b);' WHEN 1 THEN 'unlink("fixed.txt");' WHEN 2 THEN 'system($a . " -l");' ELSE 'echo 1;' END AS t,
  CASE page_id % 2 WHEN 0 THEN 'uploads' ELSE 'mu' END AS origin FROM pages)"""


def code_pages(spark, sf_dir):
    n, nl = F.col("page_id"), F.lit("\n")
    t = F.concat(
        F.when(n % 4 == 0, F.concat(F.lit("<?php\n/* Plugin Name: "), n.cast("string"), F.lit(" */\n"))).otherwise(F.lit("<?php\n")), F.when(n % 3 == 0, F.lit("error_reporting(0);\n")).otherwise(F.lit("")), F.lit('$a = $_POST["x"];'), nl,
        F.when(n % 5 == 0, F.lit("$b = trim($a);\neval($b);")).when(n % 5 == 1, F.lit('unlink("fixed.txt");')).when(n % 5 == 2, F.lit('system($a . " -l");')).otherwise(F.lit("echo 1;")),
    )
    return table(spark, sf_dir, "pages").select("page_id", t.alias("text"), F.when(n % 2 == 0, "uploads").otherwise("mu").alias("origin"))


@register(f"""WITH {CODE_SQL} SELECT page_id, list_transform(x, lambda y: y.reason) AS reasons, list_transform(x, lambda y: y.line) AS lines FROM (SELECT page_id, list_filter([CASE WHEN page_id % 4 = 0 AND origin = 'uploads' THEN {{'reason': 'plugin header in an uploads file', 'line': 2}} END, CASE WHEN page_id % 3 = 0 THEN {{'reason': 'errors silenced before request input is used', 'line': CASE WHEN page_id % 4 = 0 THEN 3 ELSE 2 END}} END], lambda x: x IS NOT NULL) AS x FROM c)""")
def disguise_signals(spark, sf_dir):
    found = code_pages(spark, sf_dir).select("page_id", heuristics.disguise(F.col("text"), F.col("origin"), F.lit(False)).alias("x"))
    return found.select("page_id", F.transform("x", lambda y: y["reason"]).alias("reasons"), F.transform("x", lambda y: y["line"]).alias("lines"))


@register("SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'eval' ELSE 'system' END AS sink FROM pages WHERE page_id % 5 IN (0, 2)")
def source_to_sink(spark, sf_dir):
    found = taint.findings(code_pages(spark, sf_dir).withColumn("path", F.col("page_id").cast("string")))
    return found.select(F.col("path").cast("long").alias("page_id"), "sink").distinct()


PROGRAM_SQL = """w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{6,}') AS ws FROM documents), s AS (
  SELECT doc_id, i, ws[i] AS read, ws[i + 1] AS target, starts_with(ws[i], 'c') AS direct FROM w, LATERAL (SELECT unnest(range(1, len(ws))) AS i))"""


@register(f"""WITH RECURSIVE {PROGRAM_SQL}, t AS (SELECT doc_id, target AS var, min(i) AS at FROM s WHERE direct GROUP BY ALL
  UNION SELECT s.doc_id, s.target, s.i FROM t JOIN s ON s.doc_id = t.doc_id AND s.read = t.var AND s.i > t.at WHERE NOT s.direct)
SELECT DISTINCT doc_id, var AS variable FROM t""")
def tainted_calls(spark, sf_dir):
    """Each document as a program: every word is assigned from the word before it, words in c come from the request, and in the end
    every word is called. Which calls does request input reach?"""
    words = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{6,}"), F.lit(0)).alias("ws"))
    line = lambda target, read: F.concat(F.lit("$"), target, F.lit(" = trim( "), F.when(read.startswith("c"), "$_GET").otherwise(F.concat(F.lit("$"), read)), F.lit(" );\n"))
    rest = F.slice("ws", 2, F.greatest(F.size("ws"), F.lit(1)))
    lines = F.slice(F.zip_with(rest, "ws", line), 1, F.greatest(F.size("ws") - 1, F.lit(0)))
    calls = F.transform(F.array_distinct("ws"), lambda w: F.concat(F.lit("$"), w, F.lit("( 1 );\n")))
    code = words.filter(F.size("ws") > 1).select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("<?php\n"), F.array_join(lines, ""), F.array_join(calls, "")).alias("text"))
    return taint.findings(code).select(F.col("path").cast("long").alias("doc_id"), F.substring("sink", 2, 1000).alias("variable"))


@register("SELECT page_id, 'base64_decode' AS decoder, '<?php eval(1); ' || url AS payload FROM pages")
def decoded_payload(spark, sf_dir):
    raw = F.concat(F.lit("<?php eval(1); "), F.col("url"))
    page = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<?php eval(base64_decode("'), F.base64(F.encode(raw, "UTF-8")), F.lit('"));')).alias("text"))
    found = constants.decoded(page.withColumn("path", F.col("page_id").cast("string")))
    return found.select(F.col("path").cast("long").alias("page_id"), F.array_join("chain", "→").alias("decoder"), "payload")


@register("""WITH w AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z_]+')), lambda x: length(x) >= 9) AS ws FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z\\s]', '', 'g') AS text FROM documents)),
u AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) + 1), lambda i: {'i': i, 'w': ws[i]}), recursive := true) FROM w), c AS (SELECT doc_id, i, w, unnest(string_split(w, '')) AS ch FROM u), k AS (SELECT doc_id, i, w, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL),
e AS (SELECT doc_id, i, w, -sum(n * 1.0 / length(w) * log2(n * 1.0 / length(w))) AS h FROM k GROUP BY ALL)
SELECT doc_id, count(*)::INT AS n, round(avg(h), 6) AS entropy, round(avg(CASE WHEN regexp_matches(w, '^[O0Il_]{4,}$') OR (length(w) >= 10 AND NOT regexp_matches(w, '(?i)[aeiou]')) THEN 1.0 ELSE 0.0 END), 6) AS generated FROM e GROUP BY doc_id""")
def identifier_entropy(spark, sf_dir):
    clean = F.regexp_replace("text", r"[^A-Za-z\t\n\f\r ]", "")
    names = F.filter(F.array_distinct(F.regexp_extract_all(clean, F.lit("[A-Za-z_]+"), F.lit(0))), lambda x: F.length(x) >= 9)
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(heuristics.identifier_entropy(names))).alias("e"))  # a generated row is measured once
    return d.filter("e.n > 0").select("doc_id", "e.n", "e.entropy", "e.generated")


# --- formatting ---------------------------------------------------------------------------------------------------


@register("""SELECT doc_id, CASE WHEN length(text) > 60 THEN rtrim(substring(text, 1, 59)) || '…' ELSE text END AS short, substring(trim(regexp_replace(text, '[\\x00-\\x1F\\x7F]+', ' ', 'g')), 1, 120) AS line,
 CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', round(n_chars / 1024.0, 1)) WHEN n_chars < 1073741824 THEN printf('%.1f MB', round(n_chars / 1048576.0, 1)) ELSE printf('%.1f GB', round(n_chars / 1073741824.0, 1)) END AS size FROM documents""")
def formatted_cells(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.truncated(F.col("text"), 60).alias("short"), text.clean_line(F.col("text")).alias("line"), text.human_bytes(F.col("n_chars")).alias("size"))

