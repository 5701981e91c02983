"""Registered queries of the operators in this package, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_rules as qr
from . import (
    chat, decontaminate, filter_audit, html_extract, langid, merkle, packing, pu_quality, secret_scan, simhash, suffix_dedup,
    warc,
)
from .common import read_table


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss text is cut out of the formatted text by the operator's loss spans."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))])
    probe = spark.range(1).select(F.lit(-1).alias("conv_id"), F.inline(turns)).withColumn(
        "text", F.lit("</s>[INST] ok [/INST]"))
    probe = probe.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    chats = chat.format_chats(rows.unionByName(probe))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: chat.unescape(
        F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), flat.alias("flat"),
                        loss.alias("loss"), "formatted").select(
        "conv_id", "n_turns", F.sha2(F.col("flat").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
d AS (SELECT page_id, strlen(b)::BIGINT AS payload_bytes, sha1(b) AS x, min(page_id) OVER (PARTITION BY b) AS f FROM p),
e AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || x[5 * i + 1:5 * i + 5])::BIGINT) AS g FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g[j // 4 + 1] >> (5 * (3 - j % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM e
"""

OP6_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 16 + length(role) END
    + length(text) + CASE WHEN regexp_matches(text, '\[/?INST\]|</?s>|<</?SYS>>|\[ROLE [^\[\]<>]*\]|\[/ROLE\]|\\(3c|5b|3e|5d|5c)')
    THEN 2 * length(regexp_replace(text, '[^\\<\[]', '', 'g')) ELSE 0 END AS size FROM r),
c AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS flat,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    (sum(size) + count(*) - 1)::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(flat) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars FROM c
"""


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(read_table(spark, sf_dir, "documents"), str(tokenizer_path))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return qr.quality_rules(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", *[q[n].alias(n) for n in names]
    )


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
w AS (SELECT *, CASE WHEN len(ws) < {w} THEN [] ELSE
        list_transform(range(1, len(ws) - {w} + 2), lambda i: array_to_string(ws[i:i + {w} - 1], ' ')) END AS sh FROM t),
g AS (SELECT doc_id, any_value(sh) AS sh, unnest(range(1, len(any_value(sh)) + 1)) AS i, unnest(any_value(sh)) AS s
      FROM w GROUP BY doc_id),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g),
cov AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup WHERE c > 1),
rep AS (SELECT doc_id, sum(least({w}, coalesce(nx - i, {w})))::BIGINT AS n FROM cov GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda x: list_contains([{stop}], lower(x))))::BIGINT AS n_stop
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {verdict} AS kept FROM b
"""


def _verdict_sql(rules=qr.RULES) -> str:
    parts = []
    for r in rules:
        num, _, den = r.value.partition(" / ")
        num, den = (x.replace("n_stop_words", "n_stop") for x in (num, den))
        v = f"(CASE WHEN {den} = 0 THEN 0.0 ELSE {num}::DOUBLE / {den} END)" if den else f"{num}::DOUBLE"
        tests = [f"{v} >= {r.low}"] * (r.low is not None) + [f"{v} <= {r.high}"] * (r.high is not None)
        parts.append(f"(n_words < {r.min_words} OR ({' AND '.join(tests)}))")
    return " AND ".join(parts)


def _op10_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(qr.STOP_WORDS)))
    return OP10_SQL.format(w=qr.WINDOW, stop=stop, verdict=_verdict_sql())


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_folder(spark)
    warc.write_captures(read_table(spark, sf_dir, "pages"), path, min_revisit_bytes=0)
    captures = warc.assemble(warc.without_payloads(warc.read_records(spark, path)))
    page = F.regexp_extract(F.element_at("metadata", 1)["warc_fields"], r"pageId: (-?\d+)", 1)
    origin = F.regexp_extract("response.refers_to", r"urn:capture:(-?\d*):", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    return captures.select(
        number(page).alias("page_id"), "response.payload_bytes", "response.payload_digest", "response.record_type",
        number(origin).alias("refers_to"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contaminated(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared",
                        "containment").distinct()


OP2_SQL = r"""
WITH words AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') FROM benchmark),
sizes AS (SELECT DISTINCT least(5, len(w)) AS k FROM words WHERE side = 1 AND len(w) > 0),
items AS (SELECT id AS item_id, least(5, len(w)) AS k, unnest(list_distinct(list_transform(
    range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' ')))) AS s
  FROM words WHERE side = 1 AND len(w) > 0),
docs AS (SELECT DISTINCT id AS doc_id, unnest(list_transform(
    range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM words, sizes WHERE side = 0 AND len(w) >= k),
n AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= 0.8::DOUBLE * n_shingles
"""


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(read_table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.remove_repeats(docs, min_len=200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    comp = simhash.simhash_components(read_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)
    return comp.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An owner is a source, and a document a repository of it."""
    rows = secret_scan.scan(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("long")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secret_scan.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secret_scan.span_list(F.array_sort(F.concat("base", "added"))).alias("spans"), "n_example", "n_live")


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
p(kind, re) AS (VALUES
  (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]{24,}'), (3, '[A-Za-z0-9][A-Za-z0-9+/_.=-]{10,}[A-Za-z0-9]')),
m AS (
  SELECT r, doc_id, source, 0 AS kind, regexp_extract_all(t, (SELECT re FROM p WHERE kind = 0)) AS ms,
    string_split_regex(t, (SELECT re FROM p WHERE kind = 0)) AS gaps FROM d
  UNION ALL SELECT r, doc_id, source, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, doc_id, source, 2, regexp_extract_all(t, '[0-9a-f]{24,}'), string_split_regex(t, '[0-9a-f]{24,}') FROM d
  UNION ALL SELECT r, doc_id, source, 3, regexp_extract_all(t, (SELECT re FROM p WHERE kind = 3)),
    string_split_regex(t, (SELECT re FROM p WHERE kind = 3)) FROM d),
f AS (SELECT r, doc_id, source, kind, ms[i] AS span,
    list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0)),
v AS (SELECT *, (a + length(span))::BIGINT AS z,
    CASE WHEN kind = 0 THEN regexp_extract(span, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE span END AS val FROM f),
k AS (SELECT *, length(val) >= 12 AND len(list_distinct(string_split(val, ''))) >= 8 AND regexp_matches(val, '[0-9]')
      AND regexp_matches(val, '[A-Za-z]') AS live,
    length(val) >= 20 AND len(list_distinct(string_split(val, ''))) >= 12 AND regexp_matches(val, '[0-9]')
      AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') AS strong
  FROM v WHERE kind = 2 OR kind = 3 OR (kind = 0 AND length(val) >= 6) OR (kind = 1 AND length(span) >= 20)),
c AS (SELECT * FROM k WHERE kind < 3 UNION ALL SELECT * FROM k x WHERE kind = 3 AND live
    AND NOT EXISTS (SELECT 1 FROM k b WHERE b.r = x.r AND b.kind < 3 AND b.a < x.z AND x.a < b.z)),
o AS (SELECT val, count(DISTINCT coalesce('+' || source, '-')) AS owners, count(DISTINCT (source, doc_id)) AS repos,
    bool_or(kind < 3) AS known FROM c GROUP BY val),
g AS (SELECT c.*, owners >= 3 OR repos >= 100 AS example, owners = 1 AND owners < 3 AND repos < 100 AND live AS own,
    known FROM c JOIN o USING (val)),
h AS (SELECT *, list_extract(['assign', 'access', 'hex', 'owned'], kind + 1) || ':' || a::BIGINT || ':' || z AS said,
    kind < 3 OR (own AND (strong OR known)) AS shown FROM g),
s AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex, string_agg(said, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
    string_agg(said, ',' ORDER BY a, kind) FILTER (shown) AS spans,
    count(*) FILTER (example) AS n_example, count(*) FILTER (own) AS n_live FROM h GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example,
  coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN s USING (r)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", read_table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws),
     100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
     regexp_matches(text, '[#$%&*|]'),
     coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t,
    len(list_filter(fails, lambda x: x)) AS k FROM f GROUP BY part, fails),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT ord, step, ord[step] AS own, ord[:step - 1] AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
j AS (SELECT c.*, s.*, fails[own] AS bad, len(list_filter(earlier, lambda e: fails[e])) > 0 AS gone FROM c, s)
SELECT part, array_to_string(list_transform(ord, lambda i: substr('ABCDE', i::INT, 1)), '') AS filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (bad AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (bad AND gone), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (bad AND k = 1), 0)::BIGINT AS unique_fails,
  coalesce(sum(g) FILTER (bad AND NOT gone), 0)::BIGINT AS good_lost,
  coalesce(sum(t) FILTER (bad AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(k, 1))) FILTER (bad), 0)::BIGINT AS shapley
FROM j GROUP BY part, ord, step
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows are tampered with: their text loses its line breaks."""
    row = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in merkle.COLUMNS]
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(read_table(spark, sf_dir, "documents"), forged=F.when(odd, merkle.digest_of(*row)))


OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS forged
  FROM (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1),
    lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)), lambda c, b: list_reduce(
      list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)), 4294967295::BIGINT) AS crc
    FROM documents)),
e AS (SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM t),
leaves AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(forged) || ':' || forged, '-')) AS changed FROM e),
docs AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY s) AS n FROM leaves),
nodes AS (SELECT s, 0 AS lvl, i, n, leaf AS h FROM docs
  UNION ALL SELECT s, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1
    GROUP BY s, lvl, i // 3, n),
subroots AS (SELECT s, h, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, s AS i, n, h FROM subroots
  UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1
    GROUP BY lvl, i // 3, n),
runs AS (SELECT s, lvl, i // 3 AS p, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT lvl, i // 3 AS p, list(h ORDER BY i) AS hs FROM tops WHERE n > 1 GROUP BY ALL),
up AS (SELECT doc_id, leaf, s, 0 AS lvl, i, n, changed AS now, '' AS sib FROM docs
  UNION ALL SELECT u.doc_id, u.leaf, u.s, u.lvl + 1, u.i // 3, (u.n + 2) // 3,
    sha256(array_to_string(hs[:u.i % 3], '') || u.now || array_to_string(hs[u.i % 3 + 2:], '')),
    u.sib || array_to_string(hs[:u.i % 3], '') || array_to_string(hs[u.i % 3 + 2:], '')
  FROM up u JOIN runs r ON r.s = u.s AND r.lvl = u.lvl AND r.p = u.i // 3 WHERE u.n > 1),
over_sources AS (SELECT u.doc_id, u.leaf, r.h AS subroot, 0 AS lvl, u.s AS i, r.n, u.now, u.sib
    FROM up u JOIN subroots r USING (s) WHERE u.n = 1
  UNION ALL SELECT u.doc_id, u.leaf, u.subroot, u.lvl + 1, u.i // 3, (u.n + 2) // 3,
    sha256(array_to_string(hs[:u.i % 3], '') || u.now || array_to_string(hs[u.i % 3 + 2:], '')),
    u.sib || array_to_string(hs[:u.i % 3], '') || array_to_string(hs[u.i % 3 + 2:], '')
  FROM over_sources u JOIN top_runs r ON r.lvl = u.lvl AND r.p = u.i // 3 WHERE u.n > 1)
SELECT doc_id, leaf, subroot, root.h AS root, sha256(sib) AS proof_sha256, now AS folded_root, now = root.h AS verified
FROM over_sources, (SELECT h FROM tops WHERE n = 1) root WHERE n = 1
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontaminate": op2_decontaminate,
    "op3_html": op3_html,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_simhash": op5_simhash,
    "op6_chat": op6_chat,
    "op7_langid": op7_langid,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_secrets": op11_secrets,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle": op13_merkle,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op6_chat": OP6_SQL, "op2_decontaminate": OP2_SQL, "op10_quality_rules": _op10_sql(),
            "op11_secrets": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_merkle": OP13_SQL}
